"""Repair of conversation structure against a plain dynamic program over whole conversations."""

import hashlib
import random
import re
import zlib

import pytest

from scorelens.llm.structure_repair import auction, cheapest_edits, edits_of, repair
from scorelens.llm.structure_repair_query import audit, damage

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile("[^\x20\x09-\x0d]")


def faults_of(turns):
    seen, out = set(), []
    for role, text in turns:
        solid = text.rstrip(" \t\n\x0b\f\r")
        if not BLANK.search(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plan(turns, faults):
    """(cost, edits, repaired turns) by a table over all suffixes and states; states are what is due next."""
    n = len(turns)
    # state: (due letter, may a system turn come, may it end)
    states = {"start": "u", "s": "u", "u": "a", "a": "u"}
    best = {}
    for k in range(n, -1, -1):
        for _ in range(3):  # inserts stay at k
            for state, due in states.items():
                options = []
                if k == n and state in ("start", "a"):
                    options.append((0, "", []))
                if (k, due) in best:
                    c, e, r = best[k, due]
                    options.append((c + 5, "I" + e, [("user" if due == "u" else "assistant", "")] + r))
                if k < n:
                    role, text = turns[k]
                    c, e, r = best[k + 1, state]
                    options.append((c + 2, "D" + e, r))
                    if faults[k] not in ("blank", "duplicate"):
                        extra = 5 if faults[k] == "truncated" else 0
                        initial = role[:1]
                        if initial == due or (initial == "s" and state == "start"):
                            c, e, r = best[k + 1, initial]
                            options.append((c + extra, "K" + e, [(role, text)] + r))
                        c, e, r = best[k + 1, due]
                        options.append((c + 1 + extra, "R" + e, [("user" if due == "u" else "assistant", text)] + r))
                if options:
                    least = min(options, key=lambda o: (o[0], o[1]))
                    if (k, state) not in best or (least[0], least[1]) < best[k, state][:2]:
                        best[k, state] = least
    return best[0, "start"]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows if r[0] is not None}:
        mine = [(t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[1:] for r in mine]
        faults = faults_of(turns)
        known = [t for t, _, _ in mine if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, edits, repaired = plan(turns, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, edits, digest)
    return out


def random_rows(rng, conversations, longest):
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "unknown"]
    texts = ["Yes.", "No!", "cut", "", " \t", None, "Why?  ", "a\nb.", "x" * 30 + ".", "é.", " "]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"t{turn}."))
    return rows


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_repairs_equal_the_dynamic_program(spark):
    rows = random_rows(random.Random(5), 400, 9) + random_rows(random.Random(6), 3, 1)
    rows += [(1000 + c, *r[1:]) for c in range(3) for r in random_rows(random.Random(c), 1, 90)]
    rows += [(None, 0, "user", "lost."), (-5, None, None, None), (-5, None, None, None), (2000, 0, "user", "y" * 300_000 + ".")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pos", pytest.importorskip("pyspark.sql.functions").lit("clash")).repartition(5)
    assert got(repair(df)) == expected(rows)


def test_edits_of_long_conversations_are_cheapest_and_linear():
    rng = random.Random(1)
    letters = "".join(rng.choice("suaoSUAO0123") for _ in range(20_000))
    cost, edits = cheapest_edits(letters)
    assert len(edits.replace("I", "")) == len(letters)
    short = letters[:300]
    kinds = {**dict.fromkeys("suao", ""), **dict.fromkeys("SUAO", "truncated"), **dict.fromkeys("0123", "blank")}
    turns = [("suao"["0123".index(t)] if t in "0123" else t.lower(), f"{k}") for k, t in enumerate(short)]
    want = plan(turns, [kinds[t] for t in short])
    assert cheapest_edits(short) == want[:2]
    assert cheapest_edits("") == (0, "")
    assert list(edits_of("a", cheapest_edits("a")[1])) == [(1, "D", None, None)]


def test_prices_on_cheapest_paths_are_true_costs():
    rng = random.Random(3)
    for _ in range(50):
        n = 12
        arcs = [[(rng.randint(0, 4), "", rng.randint(i + 1, n)) for _ in range(3)] for i in range(n)] + [[]]
        price = [0] * (n + 1)
        auction(arcs, price, 0)
        true = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            true[i] = min(c + true[j] for c, _, j in arcs[i])
        assert price[0] == true[0] and all(p <= t for p, t in zip(price, true))


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        if conv is None:
            continue
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_damage_and_conversations_of_which_nothing_is_left(spark):
    rows = random_rows(random.Random(8), 120, 6)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(str, map(tuple, damage(df).collect()))) == sorted(map(str, damaged(rows)))
    want = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in rows}
    want.update(expected(damaged(rows)))
    assert got(audit(df)) == want
    assert any(w[5] == 0 and w[6] == "" for w in want.values())


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(empty).collect() == [] and audit(empty).collect() == []


def test_one_conversation_with_a_third_of_the_rows(spark):
    rows = random_rows(random.Random(2), 150, 6)
    rows += [(9000, t, ["user", "assistant"][t % 2], "again." if t % 3 else f"new {t}.") for t in range(len(rows) // 2)]
    assert got(repair(spark.createDataFrame(rows, SCHEMA).repartition(6))) == expected(rows)
