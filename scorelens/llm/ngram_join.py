"""Jaccard self-join of documents on word n-grams, by vertical partitioning of the global n-gram order.

The global order is the order of 64-bit n-gram hashes. It is cut into fragments; every document's set falls into
segments, one per fragment.

* Candidates. Two sets with similarity ``t`` and at most ``h`` n-grams each differ in at most ``d = 2h(1-t)/(1+t)``
  n-grams, which touch at most ``d`` of the fragments, and fewer in large sets, where several fall into one. So of any
  ``touched + 1`` non-empty segments of either set at least one is the same in both. Every set takes its rarest ones, by
  the number of different sets that have a segment, and documents meet on (size class, fragment, segment hash) of these.
  Segments that a widespread passage fills are the most frequent ones and are left to the documents that have hardly any
  other. Small sets meet on their rarest n-grams.
* Bounds. Every set has a profile, its counts in ``PROFILE_CELLS`` equal ranges of the order. The sum of the smaller
  counts bounds a pair's overlap from above; pairs whose bound is too low are no links.
* Overlaps. For the pairs left the common n-grams are counted in every fragment separately and summed per pair.
* Large groups. In a segment shared by many documents every document is first compared with one pivot only, one of those
  that share most segments with others, as the originals of near copies do. Only nodes that are in different components
  afterwards go on, so the members of a large group of near copies are not paired with each other, and no link between
  components is lost.
* Differences. In a segment of two nodes these are then paired. In larger ones every node is described by its difference
  A from a reference, a node of the segment: the n-grams that only one of the two has. As
  ``|a ^ b| = |A ^ B| = |A| + |B| - 2 |A & B|``, two similar nodes that are not both similar to the reference have so
  many n-grams of their differences in common, one at least, that the first common one, from the rarest in the group on,
  leaves enough of both behind it. Only such pairs are compared. Copies that were changed in different places have little
  but the reference in common, and that is in no difference.

Documents with equal sets count as one node, identified by a 64-bit hash of the set.

Rules: words are split at ASCII white space after lower-casing A to Z. A document with fewer words than ``n`` has its
whole sequence as the only n-gram. Null or empty texts have no n-grams and link with nothing. Repeated rows stay.
Extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.llm.components import connected_components
from scorelens.llm.textscan import gram_hashes, mix, row_bounds, text_slices, word_hashes, words
from scorelens.storage import Scratch, materialize

#: Sets up to this size meet on prefix n-grams, larger ones on segments.
SMALL_SET = 37
#: Ratio of the largest to the smallest size of a size class.
CLASS_RATIO = 1.25
#: Fragments in which overlaps are counted.
OVERLAP_FRAGMENTS = 8
#: Ranges of the order in which a set's n-grams are counted.
PROFILE_CELLS = 256
#: Fragments for each n-gram in which similar sets may differ.
FRAGMENTS = 1.5
#: Chance, for a similar pair, of more touched fragments than assumed.
MISSED = 1e-12
#: The lowest bits of a meeting key hold its size class.
LEVEL_BITS = 7
#: Set hashes that a task remembers to send the keys of equal sets once.
SEEN_SETS = 1 << 18


def _share(similarity: float) -> Fraction:
    return Fraction(similarity).limit_denominator(1000)


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of every row."""
    starts, ends, rows = words(data, offsets)
    hashes = word_hashes(data, starts, ends, lower=True)
    grams, first = gram_hashes(hashes, rows, n)
    n_rows = len(offsets) - 1
    word_at = row_bounds(rows, n_rows)
    gram_at = np.searchsorted(first, word_at)
    for i in range(n_rows):
        a, b = word_at[i], word_at[i + 1]
        if b == a:
            yield grams[:0]
        elif b - a < n:
            yield gram_hashes(hashes[a:b], rows[a:b], int(b - a))[0] + np.uint64(b - a)
        else:
            yield np.unique(grams[gram_at[i] : gram_at[i + 1]])


def _class_edges(limit: int) -> list[int]:
    edges = [SMALL_SET + 1]
    while edges[-1] <= limit:
        edges.append(int(edges[-1] * CLASS_RATIO) + 1)
    return edges


def _touched(differ: int, fragments: int) -> int:
    """Fragments that ``differ`` random n-grams touch, but for a chance of ``MISSED``."""
    expected = fragments * (1 - math.exp(-differ / fragments))
    return min(differ, math.ceil(expected + math.sqrt(differ * -math.log(MISSED) / 2)))


def meeting_keys(grams: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Keys of a sorted set, and by size class how many of them it may leave out.

    Of two sets of at least this similarity with any such choice of keys in their common class, in one global order
    of keys, at least one key is chosen by both.
    """
    n = len(grams)
    if n == 0:
        return grams, []
    # partners have n * similarity to n / similarity n-grams
    largest = n * similarity.denominator // similarity.numerator
    least = -(-n * similarity.numerator // similarity.denominator)
    mask = np.uint64((1 << LEVEL_BITS) - 1)
    keys, spares = [], []
    if least <= SMALL_SET:
        keys.append(np.unique(mix(grams) & ~mask))
        spares.append((0, len(keys[-1]) - (n - least + 1)))
    edges = _class_edges(largest)
    mixed = None
    for level in range(1, len(edges)):
        low, high = edges[level - 1], edges[level] - 1
        # pairs meet in the class of their larger set
        if largest < low or n > high:
            continue
        differ = int(2 * high * (1 - similarity) / (1 + similarity))
        fragments = int(FRAGMENTS * (differ + 1)) + 8
        place = ((grams >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
        if mixed is None:
            mixed = mix(grams ^ np.uint64(0x5851F42D4C957F2D))
        begins = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        sums = np.add.reduceat(mixed, begins)
        keys.append(np.unique((mix(sums + mix(place[begins] + np.uint64(level << 32))) & ~mask) | np.uint64(level)))
        spares.append((level, len(keys[-1]) - (_touched(differ, fragments) + 1)))
    return np.concatenate(keys), [(level, spare) for level, spare in spares if spare > 0]


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def set_hash(grams: np.ndarray) -> int:
    return int(_signed(mix(mix(grams).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(grams))))[0])


def profile_of(grams: np.ndarray) -> np.ndarray:
    """Counts of n-grams by range of the order; the greatest value stands for any number."""
    cell = (grams >> np.uint64(64 - PROFILE_CELLS.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=PROFILE_CELLS), 0xFFFF).astype(np.uint16)


def set_keys(docs: DataFrame, n: int, similarity: float, key: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, node, keys, spares, profile): set size, set hash (null: empty set), meeting keys, by
    size class the number of them that may be left out (shifted by the class), counts by range.

    A task sends the keys and profile of equal sets once.
    """
    share = _share(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(1)):
                sizes, nodes, keys, spares, profiles = [], [], [], [], []
                for grams in _sets(data, offsets, n):
                    sizes.append(len(grams))
                    keys.append(None)
                    spares.append(None)
                    profiles.append(None)
                    if len(grams) == 0:
                        nodes.append(None)
                        continue
                    node = set_hash(grams)
                    nodes.append(node)
                    if node in seen:
                        continue
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(node)
                    met, spare = meeting_keys(grams, share)
                    keys[-1], spares[-1] = _signed(met), [(s << LEVEL_BITS) + level for level, s in spare]
                    profiles[-1] = profile_of(grams).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(sizes)),
                        pa.array(sizes, pa.int64()),
                        pa.array(nodes, pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(spares, pa.list_(pa.int64())),
                        pa.array(profiles, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "node", "keys", "spares", "profile"],
                )

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, node long, keys array<long>, spares array<long>, profile binary")


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, node): rows of keys with two nodes or more, once each."""
    held_key = held_node = None  # first row of the open run
    sent = False
    last_node = None
    for batch in batches:
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if held_key is not None:
            fresh = np.ones(len(key), dtype=bool)
            fresh[0] = key[0] != held_key or node[0] != last_node
        else:
            fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[fresh], node[fresh]
        if len(key) == 0:
            continue
        carried = held_key is not None and key[0] == held_key
        if carried:
            key, node = np.concatenate(([held_key], key)), np.concatenate(([held_node], node))
        begins = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))
        ends = np.concatenate((begins[1:], [True]))
        out = ~(begins & ends)
        if carried and sent:
            out[0] = False
        last = len(key) - 1
        held_key, held_node, last_node = key[last], node[first[last]], node[last]
        sent = bool(first[last] != last)
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out])], names=["key", "node"])


def rarest_postings(shared: DataFrame, spares: DataFrame) -> DataFrame:
    """Of postings (key, node) without keys of one node: those of the rarest keys that each node must keep.

    ``spares`` (node, spares) says by size class how many keys a node may leave out; it leaves out its most frequent ones.
    """
    level_mask = (1 << LEVEL_BITS) - 1
    counted = shared.groupBy("key").agg(F.count("*").alias("n"))
    each = spares.select("node", F.explode("spares").alias("s")).select(
        "node", F.col("s").bitwiseAND(level_mask).alias("level"), F.shiftright("s", LEVEL_BITS).alias("spare")
    )
    placed = shared.join(counted, "key").withColumn("level", F.col("key").bitwiseAND(level_mask))
    frequent = Window.partitionBy("node", "level").orderBy(F.desc("n"), F.desc("key"))
    ranked = placed.withColumn("rank", F.row_number().over(frequent))
    return ranked.join(each, ["node", "level"], "left").where("spare is null or rank > spare").select("key", "node")


def fragments_of(docs: DataFrame, n: int) -> DataFrame:
    """(node, size, fragment, grams): n-gram hashes of documents (node, size, text), cut by fragment of the order.

    Texts whose set isn't the one that ``node`` stands for are left out.
    """
    keep = ["node", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array([(i << 64) // OVERLAP_FRAGMENTS for i in range(1, OVERLAP_FRAGMENTS)], dtype=np.uint64)
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(len(keep))):
                index, fragment, parts = [], [], []
                nodes = batch.column(0).slice(row, len(offsets) - 1).to_pylist()
                for i, grams in enumerate(_sets(data, offsets, n)):
                    if len(grams) == 0 or set_hash(grams) != nodes[i]:
                        continue
                    for f, part in enumerate(np.split(grams, np.searchsorted(grams, cuts))):
                        index.append(row + i)
                        fragment.append(f)
                        parts.append(_signed(part))
                rows = pa.array(index, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(rows) for c in batch.columns[: len(keep)]), pa.array(fragment, pa.int32()), pa.array(parts, pa.list_(pa.int64()))],
                    names=[*keep, "fragment", "grams"],
                )

    source = docs.select(*keep, "text")
    fields = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{fields}, fragment int, grams array<long>")


def possible_pairs(pairs: DataFrame, profiles: DataFrame, similarity: float) -> DataFrame:
    """Of ``pairs`` (src, dst) those whose profiles (node, size, profile) allow the similarity."""
    share = _share(similarity)
    a = profiles.select(F.col("node").alias("src"), F.col("size").alias("_m"), F.col("profile").alias("_a"))
    b = profiles.select(F.col("node").alias("dst"), F.col("size").alias("_n"), F.col("profile").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                src, dst, m, n = (part.column(i).to_numpy() for i in range(4))
                left, right = (
                    np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(-1, PROFILE_CELLS) for i in (4, 5)
                )
                least = np.minimum(left, right)
                most = np.where((least == 0xFFFF).any(axis=1), np.minimum(m, n), np.minimum(least.sum(axis=1, dtype=np.int64), np.minimum(m, n)))
                fits = most * share.denominator >= (m + n - most) * share.numerator
                yield pa.RecordBatch.from_arrays([pa.array(src[fits]), pa.array(dst[fits])], names=["src", "dst"])

    joined = pairs.join(a, "src").join(b, "dst")
    return joined.select("src", "dst", "_m", "_n", "_a", "_b").mapInArrow(run, "src long, dst long")


def similar_pairs(pairs: DataFrame, profiles: DataFrame, segments: DataFrame, similarity: float) -> DataFrame:
    """Of ``pairs`` (src, dst) those that are similar, by partial overlaps per fragment summed per pair."""
    share = _share(similarity)
    pairs = materialize(possible_pairs(pairs, profiles, similarity), "possible")
    left = segments.select(F.col("node").alias("src"), "fragment", F.col("grams").alias("_a"), F.col("size").alias("_m"))
    right = segments.select(F.col("node").alias("dst"), "fragment", F.col("grams").alias("_b"), F.col("size").alias("_n"))
    partial = pairs.join(left, "src").join(right, ["dst", "fragment"]).select(
        "src", "dst", "fragment", "_m", "_n", F.size(F.array_intersect("_a", "_b")).alias("_common")
    )
    # a repeated row gives a fragment twice
    partial = partial.groupBy("src", "dst", "fragment").agg(*[F.max(c).alias(c) for c in ("_common", "_m", "_n")])
    common = partial.groupBy("src", "dst").agg(F.sum("_common").alias("common"), F.max("_m").alias("_m"), F.max("_n").alias("_n"))
    union = F.col("_m") + F.col("_n") - F.col("common")
    return common.filter(F.col("common") * share.denominator >= union * share.numerator).select("src", "dst")


def _labelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of keys whose nodes are in more than one component, with the label of each node."""
    named = materialize(
        postings.select("key", "node").join(labels, "node", "left")
        .select("key", "node", F.coalesce("label", "node").alias("label")), "labelled",
    )
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return materialize(named.join(mixed, "key"), "mixed")


def _weighed(postings: DataFrame) -> DataFrame:
    """Postings (key, node, weight) with the order of magnitude of the number of nodes that a node meets."""
    size = postings.groupBy("key").agg(F.count("*").alias("n"))
    weight = postings.select("key", "node").join(size, "key").groupBy("node").agg(F.floor(2 * F.log2(F.sum("n"))).cast("int").alias("weight"))
    return postings.select("key", "node").join(weight, "node")


def _star(rows: DataFrame) -> DataFrame:
    """One pivot (src, dst) for each node: a heavy node of its segments."""
    rank = F.struct("weight", F.xxhash64("node").alias("draw"), "node")
    heavy = rows.groupBy("key").agg(F.max(rank).alias("top")).select("key", F.col("top.node").alias("pivot"))
    return _most_frequent(rows.join(materialize(heavy, "heavy"), "key").filter("node <> pivot"), "node", "pivot")


def _most_frequent(rows: DataFrame, node: str, partner: str) -> DataFrame:
    """(src, dst): the partner that each node meets most often, the smallest of equals."""
    counted = rows.groupBy(node, partner).agg(F.count("*").alias("n"))
    return counted.groupBy(F.col(node).alias("src")).agg(F.max(F.struct(F.col("n"), (-F.col(partner)).alias("p"))).alias("best")).select(
        "src", (-F.col("best.p")).alias("dst")
    )


def _references(large: DataFrame) -> DataFrame:
    """(node, ref) of postings (key, node): by key the node that meets most others is the reference of the rest."""
    size = large.groupBy("key").agg(F.count("*").alias("n"))
    weight = large.join(size, "key").groupBy("node").agg(F.sum("n").alias("weight"))
    heavy = large.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top"))
    heavy = materialize(heavy.select("key", F.col("top.node").alias("ref")), "heavy")
    return large.join(heavy, "key").filter("node <> ref").select("node", "ref").distinct()


def _differences(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(node, ref, size, ref_size, fragment, grams) of ``pairs`` (node, ref): the n-grams that one of the two has."""
    own = segments.withColumnRenamed("grams", "_a")
    other = segments.select(F.col("node").alias("ref"), "fragment", F.col("size").alias("ref_size"), F.col("grams").alias("_b"))
    # few nodes are references; written first, they are mostly small enough to be broadcast
    other = materialize(other.join(pairs.select("ref").distinct(), "ref"), "reference_sets")
    grams = F.concat(F.array_except("_a", "_b"), F.array_except("_b", "_a"))
    return pairs.join(own, "node").join(other, ["ref", "fragment"]).select("node", "ref", "size", "ref_size", "fragment", grams.alias("grams"))


def _near_by_differences(differences: DataFrame, measured: DataFrame, similarity: float) -> DataFrame:
    """Pairs (src, dst) of nodes of different labels whose differences from one reference may have enough in common.

    ``measured`` has (node, ref, label, differ, size): the number of n-grams in the difference. With ``s = num / den``
    and ``need = differ (den + num) - size (den - num)``, similar nodes have ``2 (den + num) |A & B| >= need + need'``.
    """
    share = _share(similarity)
    both, either = share.denominator + share.numerator, share.denominator - share.numerator
    each = differences.select("ref", "node", F.explode("grams").alias("gram"))
    often = materialize(each.groupBy("ref", "gram").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    shared = materialize(each.join(often, ["ref", "gram"]), "shared")
    found = shared.groupBy("ref", "node").agg(F.count("*").alias("found"))
    rare = Window.partitionBy("ref", "node").orderBy("n", "gram")
    # n-grams of one difference only come first; left: the n-grams from this one on
    left = F.col("found") - F.row_number().over(rare) + 1
    ranked = shared.join(found, ["ref", "node"]).withColumn("left", left).join(measured, ["ref", "node"])
    need = F.col("differ") * both - F.col("size") * either
    rows = materialize(ranked.select("ref", "gram", "node", "label", need.alias("need"), (2 * both * F.col("left") - need).alias("most")), "ranked")
    # no other node of the n-gram needs so little
    range_ = rows.groupBy("ref", "gram").agg(
        F.min("need").alias("_least"), F.max("most").alias("_most"), F.min("label").alias("_low"), F.max("label").alias("_high")
    ).filter("_low <> _high")
    rows = materialize(rows.join(range_, ["ref", "gram"]).filter("most >= _least and need <= _most").drop("_least", "_most", "_low", "_high"), "ranked")
    a, b = rows.alias("a"), rows.alias("b")
    meet = (F.col("a.ref") == F.col("b.ref")) & (F.col("a.gram") == F.col("b.gram")) & (F.col("a.label") < F.col("b.label"))
    enough = (F.col("a.most") >= F.col("b.need")) & (F.col("b.most") >= F.col("a.need"))
    return a.join(b, meet & enough).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst")).distinct()


def _last_links(mixed: DataFrame, links: DataFrame, profiles: DataFrame, segments: DataFrame, similarity: float) -> DataFrame:
    """Links (src, dst) that join all components of ``links`` which a similar pair of ``mixed`` (key, node, label) joins."""
    share = _share(similarity)
    both, either = share.denominator + share.numerator, share.denominator - share.numerator
    # nodes without a text are similar to no other
    placed = mixed.select("key", "node", "label").join(segments.select("node").distinct(), "node")
    size = placed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("src"), F.max("node").alias("dst"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    size = materialize(size.filter("low <> high"), "sizes")
    two = size.filter("n = 2").select("src", "dst").distinct()
    large = placed.join(size.filter("n > 2").select("key"), "key").select("key", "node")
    refs = materialize(_references(large), "references")
    # a repeated row gives a fragment twice
    needed = segments.join(large.select("node").distinct(), "node").dropDuplicates(["node", "fragment"])
    differences = materialize(_differences(refs, materialize(needed, "needed")), "differences")
    measured = materialize(
        differences.groupBy("node", "ref").agg(F.sum(F.size("grams")).alias("differ"), F.max("size").alias("size"), F.max("ref_size").alias("ref_size")), "measured",
    )
    to_ref = measured.filter(F.col("differ") * both <= (F.col("size") + F.col("ref_size")) * either)
    found = materialize(to_ref.select(F.col("node").alias("src"), F.col("ref").alias("dst")), "links")
    labels = connected_components(links.union(found))
    measured = measured.join(labels, "node", "left").select("node", "ref", "differ", "size", F.coalesce("label", "node").alias("label"))
    near = _near_by_differences(differences, materialize(measured, "measured"), similarity)
    rest = materialize(two.union(near), "rest")
    return found.union(materialize(similar_pairs(rest, profiles, segments, similarity), "links"))


def similar_components(docs: DataFrame, n: int = 4, similarity: float = 0.85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id reachable over pairs of at least ``similarity``."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark) as wide:
        keyed = materialize(set_keys(docs, n, similarity, key, text), "keys")
        rows = keyed.filter("keys is not null").select(F.explode("keys").alias("key"), "node")
        postings = wide.keep(
            rows.repartition(tasks, "key").sortWithinPartitions("key", "node").mapInArrow(_shared_keys, "key long, node long"), "postings",
        )
        spares = keyed.filter("keys is not null").select("node", "spares").dropDuplicates(["node"])
        postings = wide.keep(rarest_postings(postings, spares), "postings")
        sets = wide.keep(keyed.select("doc_id", "n_shingles", "node"), "sets")
        met = postings.select("node").distinct()
        profiles = keyed.filter("profile is not null").select("node", F.col("n_shingles").alias("size"), "profile")
        profiles = wide.keep(profiles.join(met, "node").dropDuplicates(["node"]), "profiles")
    with Scratch(spark) as inner:
        labels = inner.keep(_labels(docs, sets, postings, profiles, n, similarity, key, text), "components")
    named = sets.select("doc_id", "n_shingles", "node").join(labels, "node", "left").withColumn("group", F.coalesce("label", "node"))
    first = materialize(named.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id")), "first")
    return named.join(first, "group", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _labels(docs: DataFrame, sets: DataFrame, postings: DataFrame, profiles: DataFrame, n: int, similarity: float, key: str, text: str) -> DataFrame:
    """(node, label) of the nodes that are similar to another one."""
    postings = materialize(_weighed(postings), "weighed")
    chosen = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"))
    wanted = chosen.join(profiles.select("node"), "node").filter("doc_id is not null")
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    segments = materialize(fragments_of(source.join(wanted, "doc_id").select("node", "size", "text"), n), "segments")
    links = materialize(similar_pairs(_star(postings), profiles, segments, similarity), "links")
    labels = connected_components(links)
    mixed = _labelled(postings, labels)
    if mixed.isEmpty():
        return labels
    last = _last_links(mixed, links, profiles, segments, similarity)
    return labels if last.isEmpty() else connected_components(links.union(last))
