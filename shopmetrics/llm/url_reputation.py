"""URL filter by empirical-Bayes host reputation (operator 5).

Labelled page outcomes (good or bad) are counted by host, registered domain and
suffix. Each level has a beta prior centred on the mean of the level above; the prior's
weight is fitted from the spread of the level's own counts (moments of the beta-binomial
distribution). A host's posterior is bounded from below; a page whose host's bound
reaches the threshold is allowed. Fixed rules on host and path go before.

Counts are exact integers, and sums over hosts are of integers too, so the result does
not depend on how Spark groups the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import ascii_lower, materialize

SCALE = 1_000_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is (verdict, host + path).

    The rules are an argument that the caller writes down, so their number is bounded.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is outermost
        at = text.index("/")
        own, start = text[:at], text[at:]
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> Column:
    """Registered domain, taken as the last two labels of the host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def prior_weight(g: int, n: int, k: int, nn: int, kk: int) -> float:
    """Prior weight of a level by the moments of the beta-binomial distribution.

    Over its groups of at least two labelled pages: g groups, n pages, k good ones, nn the sum of
    n^2, kk the sum of floor(SCALE k^2 / n). With v = p (1 - p), the variance between groups is
    (S - (g - 1) v) / (n - nn / n), S = sum of k^2 / n - k p; the weight is v / variance - 1, held
    between 1 and 1000; 10 where nothing can be estimated.
    """
    if g < 2:
        return 10.0
    p = float(k) / float(n)
    v = p * (1.0 - p)
    room = float(n) - float(nn) / float(n)
    if room <= 0 or v <= 0:
        return 10.0
    between = (float(kk) / float(SCALE) - float(k) * p - (float(g) - 1.0) * v) / room
    return 1000.0 if between <= 0 else min(1000.0, max(1.0, v / between - 1.0))


def _moments(level: DataFrame, k: str, n: str):
    """The five exact sums that ``prior_weight`` takes, as one row."""
    return level.where(F.col(n) >= 2).agg(
        F.count(F.lit(1)).alias("g"),
        F.coalesce(F.sum(n), F.lit(0)).alias("n"),
        F.coalesce(F.sum(k), F.lit(0)).alias("k"),
        F.coalesce(F.sum(F.col(n) * F.col(n)), F.lit(0)).alias("nn"),
        F.coalesce(F.sum(F.expr(f"({k} * {k} * {SCALE}) div {n}")), F.lit(0)).alias("kk"),
    ).first()


def host_bounds(hosts: DataFrame, z: float = 1.0) -> DataFrame:
    """``host``, ``n`` labelled pages, ``k`` good ones -> with ``mean`` and ``bound`` (lower posterior bound).

    Posterior mean of a level: (k + weight * mean above) / (n + weight); bound: mean - z * standard
    deviation of the beta posterior, at least 0. Above the suffixes is the mean of all labelled pages,
    with one good and one bad page added. A host with n = 0 has its domain's mean.
    """
    hosts = materialize(hosts.select("host", "n", "k").withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "host-outcomes")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk")), "domain-outcomes")
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk")), "suffix-outcomes")
    total = suffixes.agg(F.coalesce(F.sum("sk"), F.lit(0)).alias("k"), F.coalesce(F.sum("sn"), F.lit(0)).alias("n")).first()
    overall = (total["k"] + 1) / (total["n"] + 2)
    w_suffix, w_domain, w_host = (prior_weight(*_moments(*level)) for level in ((suffixes, "sk", "sn"), (domains, "dk", "dn"), (hosts, "k", "n")))

    def shrunk(k: str, n: str, above: Column, weight: float) -> Column:
        return (F.col(k).cast("double") + F.lit(weight) * above) / (F.col(n).cast("double") + F.lit(weight))

    suffix_means = suffixes.select("suffix", shrunk("sk", "sn", F.lit(overall), w_suffix).alias("s_mean"))
    domain_means = domains.join(suffix_means, "suffix").select("domain", shrunk("dk", "dn", F.col("s_mean"), w_domain).alias("d_mean"))
    domain_means = materialize(domain_means, "domain-means")
    deviation = F.sqrt(F.col("mean") * (F.lit(1.0) - F.col("mean")) / (F.col("n").cast("double") + F.lit(w_host + 1.0)))
    known = hosts.join(domain_means, "domain").withColumn("mean", shrunk("k", "n", F.col("d_mean"), w_host))
    return known.select("host", "n", "k", "mean", F.greatest(F.lit(0.0), F.col("mean") - F.lit(z) * deviation).alias("bound"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    outcome_id_col: str = "doc_id",
    outcome_col: str = "quality",
    threshold: float = 0.4,
    z: float = 1.0,
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``, ``bound``.

    ``outcomes`` labels pages by id, 1 good and 0 bad; of several labels of a page the mean decides
    (a half or more is good); null ids and null labels count nowhere. A host without a labelled page
    takes its domain's, suffix's or overall mean as its own with no pages of its own. A null url, or
    one without ``://``, has empty host and path, and is judged as the host that is empty. Repeated pages
    are judged each. Other columns are not read.
    """
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = outcomes.where(F.col(outcome_id_col).isNotNull() & F.col(outcome_col).isNotNull())
    labels = labels.groupBy(F.col(outcome_id_col).alias("id")).agg(F.avg(F.col(outcome_col).cast("double")).alias("_q"))
    labels = labels.select("id", (F.col("_q") >= 0.5).cast("int").alias("good"))
    seen = urls.join(labels, "id", "left").select("host", "good")
    # Hosts without an outcome take part with n = 0, so every host has a row.
    hosts = seen.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("k"))
    bounds = materialize(host_bounds(hosts, z), "host-bounds")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    out = urls.join(bounds.select("host", "bound"), "host", "left")
    method = F.when(F.col("bound") >= F.lit(threshold), F.lit("allow")).otherwise(F.lit("block"))
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"), "bound")
