"""URL filters: fixed rules, then an empirical-Bayes reputation of hosts.

Labelled outcomes of pages are summed per host, registered domain and suffix. Each level's good rates follow a beta
distribution around the posterior mean of the level above, whose strength comes from the spread of the
rates by moments; the host's posterior then gives a bound, and pages whose host is bad beyond doubt are blocked.

A host without outcomes is judged by its registered domain, that by its suffix, and only a suffix without outcomes by the overall rate.

Nulls: a null URL, or one without ``://``, has an empty host and path and, without outcomes, the overall rate.
Outcomes with a null mark are left out. Repeated rows are judged and counted one by one; of equally long rules the one
later in code point order wins. Empty tables of outcomes leave every page to the rules and allow the rest. Columns other
than the named ones are ignored. Sums are partial per task before the shuffle, so a host may hold any share of the pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmerge.session import checkpointed

#: Labels that make a suffix of two labels together with an ending of two letters (co.uk, com.mx); other suffixes are the last label.
SECOND_LABELS = ("ac", "co", "com", "edu", "gov", "net", "org")
LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"\A([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"\A[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule ``host/path`` that fits the host or a parent of it and the path's beginning."""

    def fit(rule: str, verdict: str) -> Column:
        own, start = rule.split("/", 1)
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{start}"))
        return F.when(fits, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))

    fitted = [fit(*rule) for rule in rules]
    return F.greatest(*fitted) if len(fitted) > 1 else fitted[0]


def host_levels(host: Column, second_labels: Sequence[str] = SECOND_LABELS) -> dict[str, Column]:
    """Suffix and registered domain of a host, without user and port."""
    name = F.regexp_replace(F.regexp_replace(host, r"\A.*@", ""), r":\d*\z", "")
    pair = F.substring_index(name, ".", -2)
    double = pair.rlike(rf"\A(?:{'|'.join(second_labels)})\.[a-z]{{2}}\z")
    suffix = F.when(double, pair).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(double, F.substring_index(name, ".", -3)).otherwise(pair)
    return {"suffix": suffix, "domain": domain}


def _spread(groups: DataFrame, least: float = 1.0, most: float = 1000.0) -> DataFrame:
    """One row: the strength of the beta prior, from how far the groups' rates (k of n) are from their prior means."""
    expected = F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior")))
    found = F.sum(F.pow(F.col("k") - F.col("n") * F.col("prior"), 2))
    extra = F.sum(F.col("n") * (F.col("n") - 1) * F.col("prior") * (1 - F.col("prior")))
    correlation = (found - expected) / F.nullif(extra, F.lit(0.0))
    strength = F.when(correlation > 0, 1 / correlation - 1).otherwise(most)
    return groups.agg(F.coalesce(F.least(F.lit(most), F.greatest(F.lit(least), strength)), F.lit(most)).alias("strength"))


def reputations(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """Beta posteriors (``a``, ``b``) by host from outcomes (host, good), also for ``hosts`` (host) that have none.

    A host without outcomes takes part with none of none: sums and strengths stay as they are, and its posterior is the prior of its level.
    """
    counted = outcomes.where("good is not null").select("host", F.col("good").cast("long").alias("k"), F.lit(1).alias("n"))
    unseen = hosts.select("host", F.lit(0).cast("long").alias("k"), F.lit(0).alias("n"))
    counts = counted.unionByName(unseen).groupBy("host").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    counts = checkpointed(counts.withColumns(host_levels(F.col("host"))))
    total = counts.agg(F.sum("k"), F.sum("n")).first()
    rate = ((total[0] or 0) + 1.0) / ((total[1] or 0) + 2.0)
    above = None
    for level in LEVELS:
        keys = [name for name in LEVELS if LEVELS.index(name) <= LEVELS.index(level)]
        groups = counts.groupBy(*keys).agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
        groups = groups.withColumn("prior", F.lit(rate)) if above is None else groups.join(above, keys[:-1])
        strength = _spread(groups).first()[0]
        a, b = F.col("k") + strength * F.col("prior"), F.col("n") - F.col("k") + strength * (1 - F.col("prior"))
        posterior = groups.select(*keys, a.alias("a"), b.alias("b"))
        above = posterior.select(*keys, (F.col("a") / (F.col("a") + F.col("b"))).alias("prior"))
    return posterior.select("host", "a", "b")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], least_good: float = 0.5, z: float = 1.645) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, and the host's ``good_rate`` and its upper ``bound``.

    ``outcomes``: (url, good), good 1 or 0. Without a fitting rule a page is blocked when the upper
    posterior bound of its host's good rate is below ``least_good``.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    by_host = reputations(outcomes.select(host_of(F.col("url")).alias("host"), "good"), parts)
    judged = parts.join(by_host, "host")
    rate = F.col("a") / (F.col("a") + F.col("b"))
    deviation = F.sqrt(rate * (1 - rate) / (F.col("a") + F.col("b") + 1))
    judged = judged.withColumns({"good_rate": rate, "bound": rate + z * deviation, "fit": matching_rule(F.col("host"), F.col("path"), rules)})
    own = F.when(F.col("bound") < least_good, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "good_rate", "bound")
