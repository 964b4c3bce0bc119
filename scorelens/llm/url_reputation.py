"""URL filter by rules and by empirical-Bayes host reputation.

Rules (host, path) come first; the longest that fits wins. For other urls the host's rate of bad pages decides. Rates
are beta-binomial and shrink down a chain: all pages give the prior of a suffix (last label), a suffix that of a
registered domain (last two labels), a domain that of a host. The strength of each prior is estimated from the spread
of the children's rates by moments. A host is blocked if even the lower bound of its posterior is above a limit.

Only counts of hosts leave the page scan, combined map-side, so a host with a third of all pages is one row; all later
levels are sums over hosts. All steps are DataFrame functions.

A null url, or one without ``://``, has an empty host and path and shares the reputation of the empty host. Pages with
a null outcome count for nothing. An empty table gives no rows. Repeated rows count each. Extra columns are dropped.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.storage import materialize

#: Lower posterior bound of the bad-page rate from which a host is blocked.
BLOCK_RATE = 0.2
#: Standard deviations between posterior mean and bound.
BOUND_WIDTH = 1.645
#: Limits of the estimated correlation of outcomes within a parent; its inverse less one is the prior's weight in pages.
LEAST_CORRELATION, MOST_CORRELATION = 0.001, 0.5
#: The correlation where no parent has two children.
UNKNOWN_CORRELATION = 0.1

Rule = tuple[str, str, str]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path of a url."""
    known = url.isNotNull() & url.contains("://")
    rest = F.when(known, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and action of the longest fitting rule (action, host, path); null if none fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        name = F.when(fits, F.lit(domain + prefix)).otherwise(name)
        action = F.when(fits, F.lit(what)).otherwise(action)
    return name, action


def _strength(children: DataFrame, by: list[str]) -> float:
    """Weight of the prior over ``children`` (n, bad) within parents ``by``, in pages; one row comes to the driver."""
    rate = F.col("bad") / F.col("n")
    parents = children.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("k"),
        F.sum(F.col("bad") * rate).alias("square"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    )
    mean = F.col("bad") / F.col("n")
    row = parents.agg(
        F.sum(F.col("square") - F.col("bad") * mean).alias("spread"),
        F.sum(mean * (1 - mean) * (F.col("k") - 1)).alias("noise"),
        F.sum(mean * (1 - mean) * (F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1))).alias("scale"),
    ).first()
    correlation = (row["spread"] - row["noise"]) / row["scale"] if row["scale"] else UNKNOWN_CORRELATION
    correlation = min(max(correlation, LEAST_CORRELATION), MOST_CORRELATION)
    return 1 / correlation - 1


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, rate, lower) from outcomes (host, bad 0/1 or null): posterior mean and lower bound per host."""
    hosts = outcomes.filter("bad is not null").groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")
    )
    labels = F.split("host", r"\.", -1)
    hosts = materialize(hosts.select(
        "host", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"),
        F.element_at(labels, -1).alias("suffix"), "n", "bad",
    ), "hosts")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    base = (total["bad"] or 0) / total["n"] if total["n"] else 0.0
    all_of = suffixes.withColumn("all", F.lit(0))
    k_suffix, k_domain, k_host = _strength(all_of, ["all"]), _strength(domains, ["suffix"]), _strength(hosts, ["domain"])

    def posterior(weight: float, prior: Column) -> Column:
        return (F.col("bad") + weight * prior) / (F.col("n") + weight)

    def spread(weight: float, above: Column) -> Column:
        """Variance of a rate: its own, and what the prior's leaves."""
        own = F.col("rate") * (1 - F.col("rate")) / (F.col("n") + weight + 1)
        return own + F.pow(weight / (F.col("n") + weight), 2) * above

    def level(children: DataFrame, keep: list[str], weight: float, prior: Column, above: Column) -> DataFrame:
        rated = children.withColumn("rate", posterior(weight, prior)).withColumn("variance", spread(weight, above))
        return rated.select(*keep, F.col("rate").alias("prior"), F.col("variance").alias("above"))

    suffixes = materialize(level(suffixes, ["suffix"], k_suffix, F.lit(base), F.lit(0.0)), "suffixes")
    domains = materialize(level(domains.join(suffixes, "suffix"), ["domain"], k_domain, F.col("prior"), F.col("above")), "priors")
    rated = level(hosts.join(domains, "domain"), ["host", "n", "bad"], k_host, F.col("prior"), F.col("above"))
    return rated.select("host", "n", "bad", F.col("prior").alias("rate"), (F.col("prior") - BOUND_WIDTH * F.sqrt("above")).alias("lower"))


def judge_urls(pages: DataFrame, rules: list[Rule], bad: Column, block_rate: float = BLOCK_RATE) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate) of pages (page_id, url, ...); ``bad`` is a page's outcome, 0, 1 or null."""
    host, path = url_parts(F.col("url"))
    reputation = materialize(host_reputation(pages.select(host.alias("host"), bad.alias("bad"))), "reputation")
    name, action = rule_columns(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).join(reputation.select("host", "rate", "lower"), "host", "left")
    method = F.when(F.col("lower") > block_rate, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(action, method).alias("verdict"),
        F.round("rate", 6).alias("bad_rate"),
    )
