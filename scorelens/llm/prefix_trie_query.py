"""Query of the conversation prefix trie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.llm.prefix_trie import number_turns, prefix_trie
from scorelens.llm.registry import CRC32_SQL, query, table
from scorelens.storage import Scratch, materialize

#: Conversations that share a beginning, and the number of different lengths of it.
SHARING, LENGTHS = 5, 9


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns of the rebuilt conversations, and their ids.

    Every conversation takes the first turns of the first of its ``SHARING`` neighbours and goes on with its own. At most
    ``SHARING`` conversations take at most ``LENGTHS`` - 1 turns from one, so the join has no hot keys.
    """
    numbered = materialize(number_turns(conversations), "turns")
    members = materialize(numbered.select("conv_id").distinct(), "members")
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(LENGTHS))
    base = (F.col("conv_id") - F.col("conv_id") % SHARING).alias("base")
    heads = numbered.where(F.col("pos") < LENGTHS).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    shared = members.select("conv_id", base, taken.alias("taken")).join(heads, "base").where("pos <= taken")
    own = numbered.where(F.col("pos") > taken)
    rows = shared.select("conv_id", F.col("pos").alias("turn"), "role", "text").unionByName(
        own.select("conv_id", (F.col("pos") + LENGTHS).alias("turn"), "role", "text")
    )
    return number_turns(rows, "depth"), members


def trie(conversations: DataFrame) -> DataFrame:
    with Scratch(conversations.sparkSession) as scratch:
        turns, members = rebuild(conversations.select("conv_id", "turn", "role", "text"))
        return scratch.keep(prefix_trie(turns, members), "trie")


@query("op12_conversation_prefix_trie", f"""
WITH crc AS ({CRC32_SQL}), numbered AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), members AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, crc32_of % 9 AS h FROM (
        SELECT conv_id, xor(list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda x, b: xor(x >> 8, steps[(xor(x, b) & 255) + 1])), 4294967295) AS crc32_of
        FROM (SELECT DISTINCT conv_id FROM numbered), crc)
), rebuilt AS (
    SELECT m.conv_id, 0 AS part, pos, role, text FROM members m JOIN numbered n ON n.conv_id = m.base AND n.pos <= m.h
    UNION ALL
    SELECT m.conv_id, 1, pos, role, text FROM members m JOIN numbered n ON n.conv_id = m.conv_id AND n.pos > m.h
), turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, strlen(text) AS bytes,
        sha256(length(role) || ':' || role || text) AS said
    FROM rebuilt
), prefixes AS (
    SELECT conv_id, depth, bytes, md5(string_agg(said, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS name FROM turns
    UNION ALL SELECT conv_id, 0, 0, '' FROM members
), nodes AS (
    SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM prefixes GROUP BY depth, name
), linked AS (
    SELECT n.*, up.conv_id AS parent_conv_id FROM nodes n
    LEFT JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
    LEFT JOIN nodes up ON up.depth = p.depth AND up.name = p.name
), children AS (
    SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), counted AS (
    SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children USING (conv_id, depth)
), subtrees AS (
    SELECT p.depth, p.name, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved_tokens
    FROM counted u JOIN prefixes p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY ALL
), ends AS (
    SELECT depth, name, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM (
        SELECT * FROM prefixes QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens,
    coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM counted JOIN subtrees USING (depth, name) LEFT JOIN ends USING (depth, name)
""")
def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie over all rebuilt conversations."""
    return trie(table(spark, sf_dir, "conversations"))
