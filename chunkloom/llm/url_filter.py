"""URL filters: exact rules, then empirical-Bayes host reputation.

A rule names a host and the start of a path; it fits the host and its
subdomains, and the longest that fits decides. Other pages are judged by their
host: labelled outcomes are counted by host, and a host's rate is shrunk
through beta priors from its registered domain, that domain's from its suffix,
and the suffix's from the rate of all. The strength of each prior is fitted by
the method of moments for beta-binomial counts. A host is blocked when even
the lower posterior bound of its rate of bad pages, its mean less z standard
deviations of the beta posterior, is above a threshold. Counts by host are cut
once, and all that follows reads them.

Defined results: rules of equal length that fit one page can only be one rule
given twice, of which the first counts; a null url or one without :// has an empty host and path and
takes the prior of all pages; without labels every page that no rule fits is
allowed; a page with several labels counts each; repeated rows stay; an empty
table gives an empty result; extra columns go along, and one with the name of
an added column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept, cut

#: Second-level labels that, below a two-letter top level, belong to the suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Strengths that a fitted prior may take.
LEAST, MOST = 1.0, 1000.0


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_suffix(host: Column) -> Column:
    return F.regexp_extract(host, rf"((?:(?:^|(?<=\.))(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|(?:^|(?<=\.))[^.]*))$", 1)


def url_domain(host: Column) -> Column:
    """The suffix and one label more."""
    return F.regexp_extract(host, rf"((?:[^.]+\.)?(?:(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|[^.]*))$", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, or null. rules: (verdict, host, path start)."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1]))
    fits = [F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<verdict:string,rule:string>")


def prior_strength(counts: DataFrame) -> float:
    """Of groups with n trials, k hits and prior mean m: method of moments for the beta-binomial.

    With Pearson's statistic X = sum((k - n m)^2 / (n m (1 - m))), the
    expected excess over the number of groups is rho * sum(n - 1), and the
    strength is 1 / rho - 1. One row comes to the driver.
    """
    used = counts.where((F.col("n") > 0) & (F.col("m") > 0) & (F.col("m") < 1))
    x = used.agg(F.sum(F.round(F.pow(F.col("k") - F.col("n") * F.col("m"), 2) / (F.col("n") * F.col("m") * (1 - F.col("m"))), 9).cast("decimal(30,9)")).cast("double").alias("x"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") - 1).alias("t")).first()
    if not x["g"] or not x["t"]:
        return MOST
    rho = (x["x"] - x["g"]) / x["t"]
    return MOST if rho <= 1 / (MOST + 1) else LEAST if rho >= 1 / (LEAST + 1) else 1 / rho - 1


def reputation(outcomes: DataFrame, z: float = 1.645) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """(host, bad 0/1) -> tables of posterior rates of hosts, domains and suffixes, and the rate of all.

    The host table has host, n, bound; the others a key and the prior (mean and
    strength) that a host below them takes when it has no labels.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = cut(hosts.withColumns({"domain": url_domain(F.col("host")), "suffix": url_suffix(F.col("host"))}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = (total["k"] + 0.5) / (total["n"] + 1.0) if total["n"] else 0.0

    def shrunk(counts: DataFrame, strength: float) -> Column:
        return (F.col("k") + F.lit(strength) * F.col("m")) / (F.col("n") + F.lit(strength))

    suffixes = suffixes.withColumn("m", F.lit(rate))
    s0 = prior_strength(suffixes)
    suffixes = suffixes.select("suffix", shrunk(suffixes, s0).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").withColumnRenamed("suffix_rate", "m")
    s1 = prior_strength(domains)
    domains = domains.select("domain", shrunk(domains, s1).alias("domain_rate"))
    hosts = hosts.join(domains, "domain").withColumnRenamed("domain_rate", "m")
    s2 = prior_strength(hosts)
    hosts = hosts.select("host", "n", lower_bound(F.col("k") + F.lit(s2) * F.col("m"), F.col("n") + F.lit(s2), z).alias("bound"))
    domains = domains.select("domain", lower_bound(F.lit(s2) * F.col("domain_rate"), F.lit(s2), z).alias("domain_bound"))
    suffixes = suffixes.select("suffix", lower_bound(F.lit(s2) * F.col("suffix_rate"), F.lit(s2), z).alias("suffix_bound"))
    return hosts, domains, suffixes, max(0.0, rate - z * (rate * (1 - rate) / (s2 + 1)) ** 0.5)


def lower_bound(a: Column, total: Column, z: float) -> Column:
    """Mean less ``z`` deviations of a beta with ``a`` hits of ``total``."""
    mean = a / total
    return F.greatest(F.lit(0.0), mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (total + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], threshold: float = 0.2, z: float = 1.645) -> DataFrame:
    """``pages`` (page_id, url, ...) with url_host, url_path, url_rule, url_verdict, url_labels and url_bound.

    ``outcomes``: (url, bad), bad 1 for a page that should not be kept. Labels
    of a hot host are summed before they move; pages move without their html.
    """
    labelled = outcomes.where("bad is not null").select(url_host(F.col("url")).alias("host"), F.col("bad").cast("long").alias("bad"))
    hosts, domains, suffixes, rest = reputation(labelled, z)
    kept = Kept(pages, "url_", ("url_host", "url_path", "url_rule", "url_verdict", "url_labels", "url_bound"))
    x = kept.df.withColumns({"url_host": url_host(F.col("url")), "url_path": url_path(F.col("url"))})
    # every host once, with the bound of the nearest level that has labels; then one join to the pages
    known = x.select("url_host").distinct().withColumns({"domain": url_domain(F.col("url_host")), "suffix": url_suffix(F.col("url_host"))})
    known = known.join(hosts, F.col("url_host") == F.col("host"), "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    known = known.select(F.col("url_host").alias("url_h"), F.coalesce("n", F.lit(0)).alias("url_labels"), F.round(F.coalesce("bound", "domain_bound", "suffix_bound", F.lit(rest)), 6).alias("url_bound"))
    x = x.join(known, F.col("url_host") == F.col("url_h"), "left").withColumn("url_fit", rule_of(F.col("url_host"), F.col("url_path"), rules))
    by_host = F.when(F.col("url_bound") > F.lit(threshold), F.lit("block")).otherwise(F.lit("allow"))
    return x.select(*kept.columns, "url_host", "url_path", F.col("url_fit.rule").alias("url_rule"), F.coalesce("url_fit.verdict", by_host).alias("url_verdict"), "url_labels", "url_bound")
