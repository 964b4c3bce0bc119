"""Query of the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.llm.registry import query, table
from scorelens.llm.url_reputation import BLOCK_RATE, BOUND_WIDTH, LEAST_CORRELATION, MOST_CORRELATION, UNKNOWN_CORRELATION, judge_urls

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: A page with so many words that end in three equal marks is bad.
BAD_MARKS = 5
MARKS = r"###|\$\$\$|%%%|&&&|\*\*\*"


def bad_page():
    """Outcome of a page by its own markup; null for a page without any."""
    return F.when(F.col("html").isNotNull(), (F.regexp_count("html", F.lit(MARKS)) >= BAD_MARKS).cast("int"))


def _strength(name: str, children: str, by: str) -> str:
    return f"""{name} AS (
    SELECT 1 / least(greatest(CASE WHEN scale <> 0 THEN (spread - noise) / scale ELSE {UNKNOWN_CORRELATION} END, {LEAST_CORRELATION}), {MOST_CORRELATION}) - 1 AS k FROM (
        SELECT sum(square - bad * (bad / n)) AS spread, sum(bad / n * (1 - bad / n) * (k - 1)) AS noise,
            sum(bad / n * (1 - bad / n) * (n - nn / n - (k - 1))) AS scale
        FROM (SELECT sum(n) AS n, sum(bad) AS bad, count(*) AS k, sum(bad * (bad / n)) AS square, sum(n * n) AS nn
            FROM {children} GROUP BY {by})))"""


SQL = f"""
WITH rest AS (
    SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, CASE WHEN html IS NOT NULL THEN CAST(len(regexp_extract_all(html, '{MARKS}')) >= {BAD_MARKS} AS INT) END AS bad,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
), hosts AS (
    SELECT host, CASE WHEN len(labels) < 2 THEN host ELSE labels[-2] || '.' || labels[-1] END AS domain, labels[-1] AS suffix, n, bad
    FROM (SELECT host, string_split(host, '.') AS labels, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad
        FROM parts WHERE bad IS NOT NULL GROUP BY host)
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL
), suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL
), {_strength("ks", "suffixes", "true")}, {_strength("kd", "domains", "suffix")}, {_strength("kh", "hosts", "domain")}
, base AS (SELECT sum(bad) / sum(n) AS base FROM suffixes
), ps AS (SELECT suffix, m AS prior, m * (1 - m) / (n + k + 1) AS v FROM (SELECT *, (bad + k * base) / (n + k) AS m FROM suffixes, ks, base)
), pd AS (SELECT domain, m AS prior, m * (1 - m) / (n + k + 1) + (k / (n + k)) ** 2 * v AS v FROM (
    SELECT domain, n, k, v, (bad + k * prior) / (n + k) AS m FROM domains JOIN ps USING (suffix), kd)
), ph AS (SELECT host, m AS rate, m - {BOUND_WIDTH} * sqrt(m * (1 - m) / (n + k + 1) + (k / (n + k)) ** 2 * v) AS lower FROM (
    SELECT host, n, k, v, (bad + k * prior) / (n + k) AS m FROM hosts JOIN pd USING (domain), kh)
), named AS (
    SELECT parts.*, rate, lower,
        CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM parts LEFT JOIN ph USING (host)
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
        WHEN lower > {BLOCK_RATE} THEN 'block' ELSE 'allow' END AS verdict,
    round(rate, 6) AS bad_rate
FROM named
"""


@query("op10_url_filter", SQL)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    return judge_urls(table(spark, sf_dir, "pages"), RULES, bad_page())
