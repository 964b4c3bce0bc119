"""Base spans and disclosing terms against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from scorelens.llm.disclosure import CONTEXT_CHARS, GENERALISE_SHARE, MIN_CONTEXTS, TERM_WORDS, sanitise
from scorelens.llm.disclosure_query import digest


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end(), "email:" + m[0].lower()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end(), "ip:" + m[0]))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end(), "card:" + d))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        d = re.sub("[^0-9]", "", m[0])
        if 9 <= len(d) <= 15:
            out.append(("phone", m.start(), m.end(), "phone:" + d))
    return out


TERM = r"[^\W_]{3,}"


def contexts_of(text, a, b):
    """The words beside a span with their places; words that go on beyond the rim are left out."""
    begin = max(0, a - CONTEXT_CHARS)
    left = text[begin:a]
    if begin:
        cut = len(re.match(r"[^\W_]*", left)[0])
        begin, left = begin + cut, left[cut:]
    right = text[b : b + CONTEXT_CHARS]
    if len(right) == CONTEXT_CHARS:
        right = re.sub(r"[^\W_]*$", "", right)
    return (begin, left), (b, right)


def surroundings(text, free):
    """For each term of a text and of the text without spans: the words around all its places, in any order."""
    words = re.split(r"[\W_]+", f"{text} {free}".lower())
    out = defaultdict(list)
    for i, w in enumerate(words):
        if len(w) >= 3:
            first = max(i - TERM_WORDS, 0)
            out[w].append(" ".join(words[first : first + 2 * TERM_WORDS + 1]))
    return {w: tuple(sorted(near)) for w, near in out.items()}


def brute(texts):
    copies = Counter(texts)
    n = len(texts)
    df = Counter(w for t in texts for w in set(re.split(r"[\W_]+", t.lower())))
    spans = {t: base(t) for t in copies}
    free = {}
    for t in copies:
        blank = list(t)
        for _, a, b, _ in spans[t]:
            blank[a:b] = " " * (b - a)
        free[t] = "".join(blank)
    holders, contexts, where, near = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    beside = defaultdict(list)
    for t in copies:
        for _, a, b, entity in spans[t]:
            holders[entity].add(t)
            for at, context in contexts_of(t, a, b):
                beside[entity, t].append(context)
                for m in re.finditer(TERM, context):
                    contexts[entity, m[0].lower()].add(context)
                    near[entity, m[0].lower()].add(t)
                    where[entity, m[0].lower()].add((t, at + m.start(), at + m.end()))
    # whole documents count for entities of several texts
    keys, met = defaultdict(set), defaultdict(set, {k: set(v) for k, v in near.items()})
    for entity, held in holders.items():
        if len(held) >= MIN_CONTEXTS:
            for t in held:
                for term, around in surroundings(t, free[t]).items():
                    met[entity, term].add(t)
                    keys[entity, term].add((tuple(sorted(beside[entity, t])), around))

    def share(co, term, entities):
        return min(math.log(co * n / (df[term] * entities)) / math.log(n / entities), 1) if entities < n else -1

    marks = defaultdict(set)
    for (entity, term), held in met.items():
        together = contexts.get((entity, term), set())
        if df[term] == 0 or max(len(keys[entity, term]), len(together)) < MIN_CONTEXTS:
            continue
        everywhere = share(sum(copies[t] for t in held), term, sum(copies[t] for t in holders[entity]))
        close = share(len(together), term, len(holders[entity])) if len(together) >= MIN_CONTEXTS else -1
        if max(everywhere, close) >= GENERALISE_SHARE:
            for t, a, b in where.get((entity, term), ()):
                if not any(x < b and a < y for _, x, y, _ in spans[t]):
                    marks[t].add((a, b))
        if everywhere >= GENERALISE_SHARE:
            for t in held:
                marks[t].update(m.span() for m in re.finditer(TERM, free[t]) if m[0].lower() == term)
    return {t: ([s[:3] for s in spans[t]], [("term", *x) for x in sorted(marks[t])]) for t in copies}


def corpus():
    rng = random.Random(4)
    words = ["über", "and", "the", "Müller", "of", "street", "berlin", "1234", "x", "was"]
    bits = ["a.b@c.de", "x@y", "n.01@mail.example.com,", "a@b.c_d@e.f.g", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "001.02.3.0004", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+1 (017) 555-7713", "+49 30 1234567 ", "+1.2", "+", "1 2 3 4 5 6 7 8 9 0 1 2 3", "ö@ü.de", "@", "+1 4111 1111 1111 1111", "9" * 25, "5500 0000 0000 0004 1.1.1.1"]
    texts = []
    for _ in range(300):
        texts.append(" ".join(rng.choice(words if rng.random() < 0.8 else bits) for _ in range(rng.randint(1, 60))))
    for i in range(6):
        texts.append(f"{rng.choice(words)} Secretname said {i} call +1 (999) 555-0{i}11 or secret.mail@host.example.com with Codeword{'s' * (i % 2)} {rng.choice(words)} {i}")
    return texts + texts[:5] + ["", "nothing here", "a@b.cd", "😀 é+1 (017) 555-7713", "@" * 50, "." * 50]


def test_spans_equal_brute_force(spark):
    texts = corpus()
    rows = [(i, t, "z") for i, t in enumerate(texts)]
    want = brute(texts)
    got = {r.doc_id: r for r in digest(spark.createDataFrame(rows, "doc_id long, text string, base string").repartition(5)).collect()}
    assert len(got) == len(rows)
    flagged = 0
    for i, t, _ in rows:
        spans, terms = want[t]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans + terms), t
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        flagged += len(terms)
    assert flagged > 3


def test_masks_long_runs_nulls_repeats_and_no_rows(spark):
    long = ["7" * 100000, "a" * 50000, "1.2." * 2000, "+1" + " 1" * 50000, "a@" + "b." * 50000, "1 " * 50000, "+1 " * 30000]
    rows = [(1, "mail a.b@c.de now", None), (1, "mail a.b@c.de now", None), (None, None, "x"), (2, "", "y"), (3, "+1 (017) 555-7713 x 1.2.3.4", "z")]
    docs = spark.createDataFrame(rows + [(10 + i, t, None) for i, t in enumerate(long)], "doc_id long, text string, found string")
    got = sanitise(docs).collect()
    assert len(got) == len(rows) + len(long)
    texts = sorted((str(r.doc_id), r.sanitised) for r in got if (r.doc_id or 0) < 10)
    assert texts == [("1", "mail [EMAIL] now"), ("1", "mail [EMAIL] now"), ("2", ""), ("3", "[PHONE] x [IP]"), ("None", None)]
    for r in got:
        if (r.doc_id or 0) >= 10:
            assert [(s.kind, s.start, s.end) for s in r.base] == [s[:3] for s in base(long[r.doc_id - 10])]
    assert sanitise(docs.limit(0)).collect() == []


def test_copies_of_a_text_keep_its_disclosing_terms(spark):
    told = "Wexford asks secret@host.example.com because Wexford waits"
    texts = [told] * 60 + [f"nothing to see in page {i}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.sanitised for r in sanitise(docs).filter("doc_id < 60").collect()} == {" asks [EMAIL] because  waits"}


def test_terms_far_from_their_entity_are_found_and_masked(spark):
    far = "and so on " * 12
    texts = [f"{w} Wexford {w} {far} mail secret@host.example.com {w} now" for w in ("dear", "poor")]
    # Banfield stands beside the entity once and far from it in the same text; the last text names Wexford alone
    texts += [f"Banfield {far} ask Banfield at other@host.example.com as Banfield says", "poor Wexford alone", far]
    # near copies that differ far from both are one context
    texts += [f"Lone {far} {w} {far} third@host.example.com" for w in ("left", "right")]
    texts += [f"the mail and so on now dear poor ask says page {i}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.sanitised for r in sanitise(docs).filter("doc_id < 7").collect()}
    assert got[0] == texts[0].replace("Wexford", "").replace("secret@host.example.com", "[EMAIL]")
    assert got[1] == texts[1].replace("Wexford", "").replace("secret@host.example.com", "[EMAIL]")
    assert got[2] == texts[2].replace("Banfield", "").replace("other@host.example.com", "[EMAIL]")
    assert got[3] == texts[3]
    assert "Lone" in got[5] and "Lone" in got[6]


def test_a_text_of_very_many_entities_takes_work_in_proportion(spark):
    import time

    docs = spark.createDataFrame([(k, " ".join(f"user{k}x{i}@host{i % 7}.example.com wrote {i}" for i in range(n))) for k, n in enumerate((16_000, 300))], "doc_id long, text string")
    sanitise(docs.where("doc_id = 1")).collect()
    began = time.time()
    rows = {r.doc_id: r for r in sanitise(docs).collect()}
    assert time.time() - began < 60  # it was more than that many times over when the work grew with the square
    assert len(rows[0].base) == 16_000 and "@" not in rows[0].sanitised and "@" not in rows[1].sanitised
