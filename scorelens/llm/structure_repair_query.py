"""Query of the conversation structure repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.llm.registry import CRC32_SQL, query, table
from scorelens.llm.structure_repair import repair


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with a conversation id after damage by the CRC-32 of ``conv_id:turn``; nulls are one space."""
    space = F.lit(" ")
    filled = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        F.pmod(F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("string"), space))), F.lit(20)).alias("kind"),
    )
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.sequence(F.lit(1), F.lit(1)))
    return filled.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    ).drop("copy")


def audit(conversations: DataFrame) -> DataFrame:
    """Repair of the damaged rows; conversations of which nothing is left are there too."""
    ids = conversations.where("conv_id is not null").select("conv_id").distinct()
    whole = ids.join(repair(damage(conversations)), "conv_id", "left")
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return whole.select("conv_id", *[F.coalesce(c, none.get(c, F.lit(0))).alias(c) for c in whole.columns[1:]])


def _plus(value: str, cost: str, letter: str) -> str:
    """A ten-digit cost with the edits behind it, one edit earlier."""
    return f"(printf('%010d', {value}[1:10]::BIGINT + {cost}) || '{letter}' || {value}[11:])"


def _best(state: str, due: str, kept: str) -> str:
    """Cheapest way on over a turn without inserts before it; ``kept`` names the initials that may stay."""
    keeps = "".join(f", CASE WHEN NOT doomed AND initial = '{i}' THEN {_plus(s, 'extra', 'K')} END" for i, s in (pair.split(">") for pair in kept.split()))
    return f"least({_plus(state, '2', 'D')}, CASE WHEN NOT doomed THEN {_plus(due, '1 + extra', 'R')} END{keeps})"


@query("op11_conversation_repair", f"""
WITH RECURSIVE crc AS ({CRC32_SQL}), source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(
            string_split(conv_id || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
        lambda x, b: xor(x >> 8, steps[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS kind
    FROM conversations, crc WHERE conv_id IS NOT NULL
), damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM source, range(2) AS copy(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged
), marked AS (
    SELECT *, left(role, 1) AS initial, CASE
        WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
    FROM placed
), turns AS (
    SELECT *, fault IN ('blank', 'duplicate') AS doomed, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra FROM marked
), counts AS (
    SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM turns GROUP BY conv_id
), onward(conv_id, pos, b, s, u, a) AS (
    SELECT conv_id, n + 1, '0000000000', '0000000010II', '0000000005I', '0000000000' FROM counts
    UNION ALL
    SELECT conv_id, pos, least(b, {_plus('v', '5', 'I')}), least(s, {_plus('v', '5', 'I')}), v, least(a, {_plus('u', '5', 'I')}) FROM (
        SELECT *, least(u, {_plus('a', '5', 'I')}) AS v FROM (
            SELECT t.conv_id, t.pos, {_best('b', 'u', 's>s u>u')} AS b, {_best('s', 'u', 'u>u')} AS s,
                {_best('u', 'a', 'a>a')} AS u, {_best('a', 'u', 'u>u')} AS a
            FROM onward o JOIN turns t ON t.conv_id = o.conv_id AND t.pos = o.pos - 1))
), plans AS (
    SELECT conv_id, b[1:10]::BIGINT AS cost, b[11:] AS audit FROM onward WHERE pos = 1
), edits AS (
    SELECT conv_id, i, audit[i] AS edit, sum(CASE WHEN audit[i] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY i) AS pos
    FROM plans, range(1, 100000) AS steps(i) WHERE i <= length(audit)
), kept AS (
    SELECT e.*, t.role, t.text, t.initial, row_number() OVER (PARTITION BY e.conv_id ORDER BY i) AS j
    FROM edits e LEFT JOIN turns t ON t.conv_id = e.conv_id AND t.pos = e.pos WHERE edit <> 'D'
), parity AS (
    SELECT *, j + max(CASE WHEN j = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS place FROM kept
), repaired AS (
    SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role ELSE CASE place % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END
        || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS repaired_sha256
    FROM parity GROUP BY conv_id
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
    coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM source) LEFT JOIN counts USING (conv_id) LEFT JOIN plans USING (conv_id) LEFT JOIN repaired USING (conv_id)
""")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair all conversations after damage."""
    return audit(table(spark, sf_dir, "conversations"))
