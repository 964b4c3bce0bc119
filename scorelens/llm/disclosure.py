"""Information-theoretic sanitisation of personal data.

Base: e-mail addresses, IP addresses, card numbers and phone numbers are found by pattern in every whole text. Their
values are the protected entities.

Disclosure: for a term ``t`` and an entity ``e``, corpus counts give the pointwise mutual information

    PMI(t, e) = log(co(t, e) * N / (df(t) * df(e)))          IC(e) = log(N / df(e))

with ``N`` documents, document counts ``df`` over the whole corpus and ``co(t, e)`` the number of documents that hold
both, wherever they stand. All four count rows, copies included. A second estimate takes the number of different
contexts for ``co`` and of different texts for ``df(e)``, so that an entity's repeated meetings with a term inside one
document count; inside the contexts the larger one holds, elsewhere in the documents the first. ``PMI / IC`` is the share of the entity's information that the term gives away. From
``GENERALISE_SHARE`` on, the term is replaced by its class wherever it stands in a document of the entity, from
``REMOVE_SHARE`` on it is removed. A single context, and copies of it, are no evidence: ``MIN_CONTEXTS`` different ones
are needed. These are either the words beside the entity, where they hold the term, or the surroundings of both in
different documents: near copies that differ elsewhere are one context.

Everything is DataFrame functions. Contexts of entities, a few words each, are exploded with their entity, whole
documents only for entities of ``MIN_CONTEXTS`` or more different texts: others have no evidence beyond their contexts.
The corpus-wide term counts combine map-side, and all texts are read in place: only those with an entity move.

Null texts are empty and stay null in the sanitised column. Rows with a null id, repeated rows and extra columns are
kept as they are; the added columns are listed in each docstring and replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.operators.ranks import join_hot_values
from scorelens.storage import join_on, materialize

#: Code points of context on each side of an entity.
CONTEXT_CHARS = 60
#: Words on each side of a term that are its surroundings.
TERM_WORDS = 4
#: Code points a block of a text from which pieces are cut.
BLOCK_CHARS = 1024
#: Different contexts in which a term must meet an entity.
MIN_CONTEXTS = 2
GENERALISE_SHARE = 0.5
REMOVE_SHARE = 0.9
#: Letters or digits of the shortest term.
TERM = r"[\p{L}\p{N}]{3,}"
NOT_TERM = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    trigger: str  # no match without it
    mask: str


# The patterns match what their plain forms match; look-behinds and possessive loops only keep runs of one class from
# being tried again at each of their characters, and the matcher from recursion.
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "[EMAIL]"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", "[IP]"),
    Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+", "", "[CARD]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", "[PHONE]"),
]
SPAN = "struct<start:int,end:int,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    size = F.length(digits)

    def worth(i: Column) -> Column:  # i-th digit from the right, from 0
        digit = F.substring(digits, size - i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it in a loop."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def _blocks(text: Column) -> Column:
    """The text in blocks of ``BLOCK_CHARS`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text in blocks; the work follows the piece, not its place."""
    first = F.floor(start / BLOCK_CHARS).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK_CHARS).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(near, start - first * BLOCK_CHARS + 1, end - start)).otherwise("")


def _reached(ends: Column) -> Column:
    """For every place of an array: the greatest of the numbers before it, 0 before the first; and once more behind the last.

    Taken over blocks and within a block, as the places of ``_located``.
    """
    block = 256

    def reached(numbers: Column, blocks: Column) -> Column:
        def before(i: Column) -> Column:
            full = F.floor(i / block).cast("int")
            return F.greatest(
                F.lit(0), F.array_max(F.slice(blocks, 1, full)), F.array_max(F.slice(numbers, full * block + 1, i - full * block))
            )

        return F.transform(F.sequence(F.lit(0), F.size(numbers)), before)

    def summed(numbers: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / block).cast("int")), lambda b: F.array_max(F.slice(numbers, b * block + 1, F.lit(block))))
        return _let(blocks, lambda greatest: reached(numbers, greatest))

    return _let(ends, summed)


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches.

    The texts between matches and the matches alternate, so places are running sums of lengths. They are taken over
    blocks and within the last block, which keeps a text with very many matches far from quadratic work.
    """
    block = 256

    def spans(hits: Column, steps: Column, blocks: Column) -> Column:
        def span(hit: Column, i: Column) -> Column:
            full = F.floor(i / block).cast("int")
            end = _total(F.slice(blocks, 1, full)) + _total(F.slice(steps, full * block + 1, i - full * block + 1))
            return _let(end, lambda e: F.struct((e - F.length(hit)).alias("start"), e.alias("end"), hit.alias("value")))

        return F.transform(hits, span)

    def summed(hits: Column, steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / block).cast("int")), lambda b: _total(F.slice(steps, b * block + 1, F.lit(block))))
        return _let(blocks, lambda sums: spans(hits, steps, sums))

    def stepped(hits: Column) -> Column:
        steps = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.length(gap) + F.coalesce(F.length(hit), F.lit(0)))
        return _let(steps, lambda lengths: summed(hits, lengths))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), stepped)


def _validity(kind: str):
    return lambda span: _valid(kind, span["value"])


def _as_entities(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda s: F.struct(_entity(kind, s["value"]).alias("entity"), s["start"].alias("start"), s["end"].alias("end")))


def _as_masked(kind: Kind) -> Column:
    return F.transform(f"_{kind.name}", lambda s: F.struct(
        F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind.mask).alias("mask")))


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add one column ``_<kind>`` of spans for each kind."""
    none = F.array().cast(f"array<{SPAN}>")
    whole = F.col(text)
    for kind in KINDS:
        there = whole.contains(kind.trigger) if kind.trigger else whole.rlike("[0-9]")
        # most texts have none: they are only searched once
        hits = F.when(there & whole.rlike(kind.pattern), _located(whole, kind.pattern)).otherwise(none)
        docs = docs.withColumn(f"_{kind.name}", F.filter(hits, _validity(kind.name)))
    return docs


def _entity(kind: str, value: Column) -> Column:
    plain = F.lower(value) if kind == "email" else _digits(value) if kind in ("card", "phone") else value
    return F.concat(F.lit(f"{kind}:"), plain)


def _mentions(hits: DataFrame) -> DataFrame:
    """(_doc, copies, entity, offset, context): the words on either side of every entity.

    ``offset`` is the place of the context in the text. Words cut at the rim of a context are left out.
    """
    spans = F.concat(*[_as_entities(kind.name) for kind in KINDS])

    def beside(blocks: Column, size: Column) -> Column:
        def sides(s: Column) -> Column:
            begin = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
            stop = F.least(s["end"] + CONTEXT_CHARS, size)
            return F.struct(
                s["entity"].alias("entity"), begin.alias("begin"), s["end"].alias("end"),
                _piece(blocks, begin, s["start"]).alias("before"), _piece(blocks, s["end"], stop).alias("after"),
            )

        return F.transform(spans, sides)

    # cut out before the entities are exploded, so that rows don't carry the text
    cut_out = _let(_blocks(F.col("text")), lambda blocks: _let(F.length("text"), lambda size: beside(blocks, size)))
    each = hits.select("_doc", "copies", F.explode(cut_out).alias("s")).select("_doc", "copies", "s.*")
    # a word that goes on beyond the rim
    cut = F.when(F.col("begin") > 0, F.length(F.regexp_extract("before", r"^[\p{L}\p{N}]*", 0))).otherwise(0)
    whole_after = F.when(F.length("after") < CONTEXT_CHARS, F.col("after")).otherwise(F.regexp_replace("after", r"[\p{L}\p{N}]*$", ""))
    sides = F.array(
        F.struct((F.col("begin") + F.col("_cut")).alias("offset"), F.expr("substring(before, _cut + 1)").alias("context")),
        F.struct(F.col("end").alias("offset"), F.col("_after").alias("context")),
    )
    each = each.withColumns({"_cut": cut, "_after": whole_after})
    return each.select("_doc", "copies", "entity", F.explode(sides).alias("side")).select("_doc", "copies", "entity", "side.*")


def _sum_of(name: str) -> Column:
    """A hash of the values of a group, whatever their order; shifted, so that the sum fits."""
    return F.sum(F.shiftright(F.xxhash64(name), 20))


def _replaced(text: Column, ordered: Column, mask) -> Column:
    """The text with ``mask(span, done)`` in place of spans ordered by start; ``done`` is where earlier spans have ended."""

    def cut(blocks: Column, reached: Column) -> Column:
        parts = F.zip_with(ordered, F.slice(reached, 1, F.size(ordered)), lambda s, done: F.concat(_piece(blocks, done, s["start"]), mask(s, done)))
        return F.concat(F.array_join(parts, ""), _piece(blocks, F.element_at(reached, -1), F.length(text)))

    ends = F.transform(ordered, lambda s: s["end"])
    return _let(_blocks(text), lambda blocks: _let(_reached(ends), lambda reached: cut(blocks, reached)))


def _blanked(text: Column, ordered: Column) -> Column:
    """The text with spaces in place of the spans, which are ordered by start."""
    return _replaced(text, ordered, lambda s, done: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(done, s["start"]), F.lit(0))))


def _all_spans() -> Column:
    return F.array_sort(F.concat(*[F.transform(f"_{kind.name}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for kind in KINDS]))


def _doc_terms(once: DataFrame) -> DataFrame:
    """(_doc, term, around): the terms of whole texts, also those that touch a span, and a hash of their surroundings."""
    words = F.split(F.lower(F.concat_ws(" ", "text", "_free")), NOT_TERM)

    def placed(all_words: Column) -> Column:
        return F.transform(all_words, lambda w, i: F.struct(
            w.alias("term"), F.array_join(F.slice(all_words, F.greatest(i - TERM_WORDS + 1, F.lit(1)), F.lit(2 * TERM_WORDS + 1)), " ").alias("near")))

    each = once.select("_doc", F.explode(F.filter(_let(words, placed), lambda w: F.length(w["term"]) >= 3)).alias("w")).select("_doc", "w.*")
    return each.groupBy("_doc", "term").agg(_sum_of("near").alias("around"))


def _pairs(once: DataFrame, mentions: DataFrame) -> DataFrame:
    """(entity, term, _doc, copies, key): the terms of an entity's contexts, and of its documents if it has several.

    ``key`` names the surroundings of both in the document; without one, the pair only counts by its contexts.
    """
    near = mentions.select("entity", F.explode(F.transform(F.regexp_extract_all("context", F.lit(TERM), F.lit(0)), lambda w: F.lower(w))).alias("term"), "_doc", "copies")
    holders = materialize(mentions.groupBy("entity", "_doc").agg(F.max("copies").alias("copies"), _sum_of("context").alias("beside")), "holders")
    # one row an entity; those with very many texts are joined without a shuffle
    several = holders.groupBy("entity").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_CONTEXTS).withColumn("_several", F.lit(True))
    marked = join_hot_values(holders, materialize(several, "several"), ["entity"], "_several")
    holders = materialize(marked.filter("_several").drop("_several"), "holders")
    terms = _doc_terms(once.join(holders.select("_doc").distinct(), "_doc", "left_semi"))
    whole = holders.join(terms, "_doc").select("entity", "term", "_doc", "copies", F.xxhash64("beside", "around").alias("key"))
    both = near.withColumn("key", F.lit(None).cast("long")).unionByName(whole)
    return both.groupBy("entity", "term", "_doc").agg(F.max("copies").alias("copies"), F.max("key").alias("key"))


def disclosing_terms(docs: DataFrame, mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(entity, term, share, beside) of the terms that give away ``GENERALISE_SHARE`` of an entity's information or more.

    ``share`` holds in the documents of the entity, ``beside`` in its contexts; the smaller may be below or NULL.
    """
    total = docs.count()
    words = F.array_distinct(F.split(F.lower(F.col("text")), NOT_TERM))
    met = mentions.select("entity", "context", F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all("context", F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))).alias("term"))
    # copies of a context are no evidence, but rows as any other
    contexts = met.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"))
    together = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("co"), F.count_distinct("key").alias("keys"))
    together = together.join(contexts, ["entity", "term"], "left").filter((F.col("keys") >= MIN_CONTEXTS) | (F.col("contexts") >= MIN_CONTEXTS))
    pairs = materialize(together, "proven")
    entities = mentions.groupBy("entity", "_doc").agg(F.max("copies").alias("copies")).groupBy("entity").agg(F.sum("copies").alias("df_entity"), F.count("*").alias("texts"))
    terms = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df_term"))
    counted = pairs.join(terms, "term").join(entities, "entity")

    def share(co: str, df_entity: str) -> Column:
        pmi = F.log(F.col(co) * F.lit(float(total)) / (F.col("df_term") * F.col(df_entity)))
        # an entity of all documents has no information
        return F.when(F.col(df_entity) < total, F.least(pmi / F.log(F.lit(float(total)) / F.col(df_entity)), F.lit(1.0)))

    shares = counted.select("entity", "term", share("co", "df_entity").alias("share"), F.when(F.col("contexts") >= MIN_CONTEXTS, share("contexts", "texts")).alias("beside"))
    return shares.withColumn("beside", F.greatest("share", "beside")).filter(F.col("beside") >= GENERALISE_SHARE)


def sanitise(docs: DataFrame) -> DataFrame:
    """Add ``base`` and ``found`` (arrays of (kind, start, end) by kind, then start) and ``sanitised`` to docs (text, ...).

    ``base`` holds the spans found by pattern, ``found`` those and the disclosing terms. Ends are exclusive; places are
    code points.
    """
    columns = [c for c in docs.columns if c not in ("base", "found", "sanitised")]
    plain = docs.select(*columns).withColumn("text", F.col("text").cast("string"))
    searched = with_base_spans(plain)
    some = F.lit(False)
    for kind in KINDS:
        some = some | (F.size(f"_{kind.name}") > 0)
    # same text, same spans: repeated rows share one key
    hits = materialize(searched.filter(some).withColumn("_doc", F.concat(F.xxhash64("text").cast("string"), F.lit(":"), F.hash("text").cast("string"))), "hits")
    once = hits.groupBy("_doc").agg(F.count("*").alias("copies"), F.first("text").alias("text"), *[F.first(f"_{k.name}").alias(f"_{k.name}") for k in KINDS])
    once = materialize(once.withColumn("_free", _blanked(F.col("text"), _all_spans())), "once")
    mentions = materialize(_mentions(once), "mentions")
    pairs = materialize(_pairs(once, mentions), "pairs")
    shares = materialize(disclosing_terms(plain, mentions, pairs), "shares")
    located = mentions.select("_doc", "entity", "offset", F.explode(_located(F.col("context"), TERM)).alias("s"))
    located = located.select("_doc", "entity", (F.col("offset") + F.col("s.start")).alias("start"), (F.col("offset") + F.col("s.end")).alias("end"), F.col("s.value").alias("word"))
    near = located.withColumn("term", F.lower("word")).join(shares, ["entity", "term"]).select("_doc", "start", "end", "word", F.col("beside").alias("share"))
    told = pairs.join(shares.filter(F.col("share") >= GENERALISE_SHARE), ["entity", "term"]).groupBy("_doc", "term").agg(F.max("share").alias("share"))
    told = materialize(told.groupBy("_doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("_shares")), "told")
    whole = once.join(told, "_doc").select("_doc", "_shares", F.explode(_located(F.col("_free"), TERM)).alias("s"))
    whole = whole.select("_doc", "s.start", "s.end", F.col("s.value").alias("word"), F.element_at(F.col("_shares"), F.lower(F.col("s.value"))).alias("share")).filter("share is not null")
    flagged = near.unionByName(whole).groupBy("_doc", "start", "end", "word").agg(F.max("share").alias("share"))
    words = flagged.groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", "word", "share"))).alias("_words"))
    marked = join_on(hits, materialize(words, "words"), ["_doc"], "left")

    def mask(word: Column, share: Column) -> Column:
        kind = F.when(word.rlike(r"^\p{N}+$"), "[NUMBER]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        return F.when(share >= REMOVE_SHARE, "").otherwise(kind)

    none = F.array().cast("array<struct<kind:string,start:int,end:int,mask:string>>")
    marked = marked.withColumn("_base", F.concat(*[_as_masked(kind) for kind in KINDS]))
    # terms inside a span found by pattern are masked with it: they are blank in the text without spans
    some_words = F.coalesce("_words", F.array().cast("array<struct<start:int,end:int,word:string,share:double>>"))
    free = F.when(F.size(some_words) == 0, some_words).otherwise(_let(
        _blocks(_blanked(F.col("text"), _all_spans())),
        lambda blocks: F.filter(some_words, lambda w: _piece(blocks, w["start"], w["end"]) == w["word"]),
    ))
    terms = F.transform(free, lambda w: F.struct(F.lit("term").alias("kind"), w["start"].alias("start"), w["end"].alias("end"), mask(w["word"], w["share"]).alias("mask")))
    marked = marked.withColumn("_all", F.concat("_base", terms))
    ordered = F.array_sort("_all", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    masked = _replaced(F.col("text"), ordered, lambda s, done: F.when(s["start"] >= done, s["mask"]).otherwise(""))
    marked = marked.withColumn("sanitised", masked)

    def narrow(spans: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    marked = marked.select(*columns, narrow("_base").alias("base"), narrow("_all").alias("found"), "sanitised")
    rest = searched.filter(~F.coalesce(some, F.lit(False))).select(
        *columns, none.cast("array<struct<kind:string,start:int,end:int,mask:string>>").alias("_none"),
    ).withColumn("base", narrow("_none")).withColumn("found", narrow("_none")).withColumn("sanitised", F.col("text")).drop("_none")
    return rest.unionByName(marked)
