"""Prefix trie of conversations, with subtree sums by the Euler-tour technique.

* Nodes. Every turn is hashed with its depth; the running sums of four 32-bit lanes of these hashes name the prefix that
  ends with the turn, so prefixes are named without putting a conversation into one task. Equal names of equal depth are
  one node. Different prefixes get the same name with a chance of about 2^-120. A node is known by its smallest
  member and its depth.
* Tour. Every node has an enter and an exit arc. The arc after an enter arc enters the first child or, in a leaf, is the
  node's own exit; the arc after an exit arc enters the next sibling or is the parent's exit. Siblings are numbered by
  range partitioned positions, so a node with very many children is no large group.
* List ranking. Every arc jumps to the arc after its next one until all have reached the end; distances double in
  each round, so the rounds grow with the logarithm of the number of nodes. Every arc is the next one of one arc only,
  so the joins have no hot keys. Each round is a table in the shared folder.
* Sums. Leaves and saved bytes are running totals at arc positions; what a subtree holds is the difference between a
  node's exit and enter arcs.

Rules: null roles and texts are empty. Turns are ordered by turn, null first, then role and text; repeated rows are turns
of their own. Rows without a conversation id are no conversation. Extra columns are dropped. Without members there are no
nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.ordered_digest import ordered_sha256
from scorelens.operators.ranks import join_hot_values, ordered_index, running_totals
from scorelens.storage import Scratch, materialize

LANES = range(4)
KEY = ["depth", *[f"s{i}" for i in LANES]]


def number_turns(rows: DataFrame, name: str = "pos") -> DataFrame:
    """(conv_id, turn, role, text) with nulls filled and the 1-based place of each turn in its conversation."""
    filled = rows.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return ordered_index(filled, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], name)


def prefixes(turns: DataFrame) -> DataFrame:
    """Numbered turns (conv_id, depth, role, text) to (conv_id, depth, s0..s3, p0..p3, bytes): names of prefix and parent."""
    said = F.concat_ws(":", F.col("depth").cast("string"), F.length("role").cast("string"), F.concat("role", "text"))
    hashed = turns.select("conv_id", "depth", F.sha2(said, 256).alias("_hash"), F.octet_length("text").cast("long").alias("bytes"))
    lanes = [F.conv(F.substring("_hash", 8 * i + 1, 8), 16, 10).cast("long").alias(f"l{i}") for i in LANES]
    summed = running_totals(hashed.select("conv_id", "depth", "bytes", *lanes), ["conv_id"], ["depth"], {f"s{i}": f"l{i}" for i in LANES})
    return summed.select("conv_id", *KEY, *[(F.col(f"s{i}") - F.col(f"l{i}")).alias(f"p{i}") for i in LANES], "bytes")


def _nodes(named: DataFrame, members: DataFrame) -> DataFrame:
    """One row a node with its smallest member, its parent's smallest member and its numbers of members and children."""
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(f"s{i}") for i in LANES], "conv_id", "n_convs",
        F.lit(0).cast("long").alias("bytes"), *[F.lit(None).cast("long").alias(f"p{i}") for i in LANES],
    )
    rest = named.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
        *[F.max(f"p{i}").alias(f"p{i}") for i in LANES],
    )
    bare = materialize(rest.unionByName(root), "nodes")
    # children under the parent's name
    up = bare.where("depth > 0").select(F.col("depth").alias("_depth"), "conv_id", (F.col("depth") - 1).alias("depth"),
                                        *[F.col(f"p{i}").alias(f"s{i}") for i in LANES])
    counted = materialize(up.groupBy(*KEY).agg(F.count("*").alias("n_children")), "children")
    full = materialize(bare.join(counted, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    parents = full.where("n_children > 0").select(*KEY, F.col("n_children").alias("n"), F.col("conv_id").alias("parent_conv_id"))
    above = join_hot_values(up, parents, KEY, "parent_conv_id").select("conv_id", F.col("_depth").alias("depth"), "parent_conv_id")
    return materialize(full.join(above, ["conv_id", "depth"], "left"), "nodes")


def _tour(nodes: DataFrame) -> DataFrame:
    """Arcs (c, d, x) of the tour and the arcs after them (nc, nd, nx); x is 0 for enter and 1 for exit."""
    siblings = ordered_index(
        nodes.where("depth > 0").select("conv_id", "depth", "parent_conv_id"), ["parent_conv_id", "depth"], ["conv_id"], "k"
    )
    siblings = materialize(siblings, "siblings")
    first = siblings.where("k = 1").select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.col("conv_id").alias("first"))
    following = siblings.select("parent_conv_id", "depth", (F.col("k") - 1).alias("k"), F.col("conv_id").alias("following"))
    placed = siblings.join(following, ["parent_conv_id", "depth", "k"], "left").select("conv_id", "depth", "following")
    linked = nodes.select("conv_id", "depth", "parent_conv_id").join(first, ["conv_id", "depth"], "left").join(placed, ["conv_id", "depth"], "left")
    has_child, has_next, d = F.col("first").isNotNull(), F.col("following").isNotNull(), F.col("depth")
    arcs = F.array(
        F.struct(
            F.lit(0).alias("x"), F.coalesce("first", "conv_id").alias("nc"),
            F.when(has_child, d + 1).otherwise(d).alias("nd"), F.when(has_child, 0).otherwise(1).alias("nx"),
        ),
        F.struct(
            F.lit(1).alias("x"), F.coalesce("following", "parent_conv_id").alias("nc"),
            F.when(has_next, d).when(d > 0, d - 1).alias("nd"), F.when(has_next, 0).when(d > 0, 1).alias("nx"),
        ),
    )
    return linked.select(F.col("conv_id").alias("c"), d.alias("d"), F.inline(arcs))


def list_ranks(arcs: DataFrame) -> DataFrame:
    """(c, d, x, left): how many arcs come after each one, by pointer jumping. A null ``nc`` ends the list."""
    state = materialize(arcs.withColumn("left", F.when(F.col("nc").isNull(), 0).otherwise(1).cast("long")), "arcs")
    while not state.where("nc is not null").isEmpty():
        ahead = state.select(
            F.col("c").alias("nc"), F.col("d").alias("nd"), F.col("x").alias("nx"),
            F.col("nc").alias("jc"), F.col("nd").alias("jd"), F.col("nx").alias("jx"), F.col("left").alias("further"),
        )
        jumped = state.where("nc is not null").join(ahead, ["nc", "nd", "nx"]).select(
            "c", "d", "x", F.col("jc").alias("nc"), F.col("jd").alias("nd"), F.col("jx").alias("nx"),
            (F.col("left") + F.col("further")).alias("left"),
        )
        state = materialize(state.where("nc is null").unionByName(jumped), "arcs")
    return state.select("c", "d", "x", "left")


def _subtrees(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) from running totals over the tour."""
    ranked = list_ranks(_tour(nodes))
    weights = nodes.select(
        F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saving"),
    )
    entering = F.col("x") == 0
    weighted = ranked.join(weights, ["c", "d"]).select(
        "c", "d", "x", (-F.col("left")).alias("place"), F.when(entering, F.col("leaf")).otherwise(0).alias("leaf"),
        F.when(entering, F.col("saving")).otherwise(0).alias("saving"),
    )
    totals = running_totals(weighted, [], ["place"], {"leaves": "leaf", "saved": "saving"})

    def inside(total: str, own: str):
        return F.max(F.when(F.col("x") == 1, F.col(total))) - F.max(F.when(F.col("x") == 0, F.col(total) - F.col(own)))

    return totals.groupBy(F.col("c").alias("conv_id"), F.col("d").alias("depth")).agg(
        inside("leaves", "leaf").alias("n_leaves"), inside("saved", "saving").alias("saved_tokens")
    )


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes of the trie over numbered ``turns`` (conv_id, depth, role, text) of ``members`` (conv_id, distinct).

    Returns per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of
    last texts that members share, over the subtree) and ends_sha256 (ids of the members that end here). A member without turns
    ends at the root.
    """
    with Scratch(turns.sparkSession) as scratch:
        named = materialize(prefixes(turns), "prefixes")
        nodes = _nodes(named, members)
        # the last prefix of every member; the root for those without turns
        last = named.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("_last"))
        origin = F.struct(*[F.lit(0).cast("long").alias(c) for c in KEY])
        ends = members.join(last, "conv_id", "left").select("conv_id", F.coalesce("_last", origin).alias("_last"))
        ends = ends.select("_last.*", "conv_id", F.col("conv_id").cast("string").alias("line"))
        digests = materialize(ordered_sha256(ends, KEY, "conv_id", "line", ",", "ends_sha256"), "ends")
        full = nodes.join(digests, KEY, "left").join(_subtrees(nodes), ["conv_id", "depth"]).select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
        return scratch.keep(full, "trie")
