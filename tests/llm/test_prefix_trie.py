"""Prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from scorelens.llm.ordered_digest import ordered_sha256
from scorelens.llm.prefix_trie import list_ranks
from scorelens.llm.prefix_trie_query import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 9
        remainder = abs(conv) % 5 * (1 if conv >= 0 else -1)
        out[conv] = turns.get(conv - remainder, [])[:h] + own[h:]
    return out


def expected(rows):
    members, ends = {}, {}
    for conv, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
        ends.setdefault(tuple(turns), []).append(conv)
    children = {}
    for prefix in members:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        below = children.get(prefix, [])
        leaves[prefix] = sum(leaves[c] for c in below) if below else 1
        saved[prefix] = sum(saved[c] for c in below) + (len(members[prefix]) - 1) * (len(prefix[-1][1]) if prefix else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def random_rows(rng, conversations, longest):
    roles, texts = ["user", "assistant", None, "", "system"], ["a", "é", "", None, "long " * 5, "b"]
    return [
        (conv, rng.choice([turn, turn, None]), rng.choice(roles), rng.choice(texts))
        for conv in range(conversations) for turn in range(rng.randint(1, longest))
    ]


def test_nodes_equal_a_dictionary_of_prefixes(spark):
    rows = random_rows(random.Random(4), 250, 9)
    rows += [(-7, 0, "user", "a"), (-7, 0, "user", "a"), (None, 0, "user", "a"), (1003, 0, "user", "z" * 200_000)]
    # a first turn and a whole conversation that a third of all rows share
    rows += [(5000 + 5 * k, t, "user", "hello") for k in range(150) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).withColumn("s0", F.lit(1)).repartition(6)
    assert got(trie(df)) == expected(rows)


def test_deep_and_wide_tries(spark):
    rows = [(0, t, "user", f"turn {t}") for t in range(300)] + [(5 * k, 0, "user", f"first {k}") for k in range(1, 200)]
    assert got(trie(spark.createDataFrame(rows, SCHEMA).repartition(4))) == expected(rows)


def test_members_without_turns_and_empty_tables(spark):
    rows = [(5 * k + 1, 0, "user", "only") for k in range(30)]  # the first of the five is absent
    want = expected(rows)
    assert any(len(t) == 0 for t in rebuilt(rows).values())
    assert got(trie(spark.createDataFrame(rows, SCHEMA))) == want
    assert trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_list_ranks(spark):
    order = list(range(77))
    random.Random(1).shuffle(order)
    arcs = [(a, 0, 0, b, None if b is None else 0, None if b is None else 0) for a, b in zip(order, [*order[1:], None])]
    ranks = list_ranks(spark.createDataFrame(arcs, "c long, d long, x int, nc long, nd long, nx int")).collect()
    assert {r.c: r.left for r in ranks} == {a: len(order) - 1 - k for k, a in enumerate(order)}


def test_digests_of_long_groups(spark, monkeypatch):
    rows = [(g, k, None if k % 7 == 3 else f"line {k} é") for g in (1, 2, None) for k in range(3000)] + [(4, 0, None)]
    df = spark.createDataFrame(rows, "g long, k long, line string").repartition(5)
    found = {r.g: r.digest for r in ordered_sha256(df, ["g"], "k", "line", "\n", "digest").collect()}
    one = hashlib.sha256("\n".join(f"line {k} é" for k in range(3000) if k % 7 != 3).encode()).hexdigest()
    assert found == {1: one, 2: one, None: one}
