"""Host reputation by empirical Bayes, with url rules that override it.

Labelled pages are outcomes (bad or not) of their host. A beta-binomial prior
passes from all pages to the public suffix, from there to the registered domain
and on to the host: each level's strength is the moment estimate of how much
its groups differ from their parents. A host's own outcomes are left out of its
prior on every level, and no strength exceeds the number of other labelled hosts
that stand behind it, so a few labels never speak for the whole web. A host is
blocked when the lower bound of its posterior, the 5 % quantile of the beta
distribution, exceeds the limit.

Everything is aggregation and joins on hosts, so a host with a third of all
pages is one row after the map-side aggregate; the join back to the pages is
left to AQE, which broadcasts the host table only under its size threshold and
splits skewed partitions otherwise.

Defined cases: a null url or one without ``://`` has an empty host and path, no
rule, and the reputation of the empty host. Repeated pages each give a row;
repeated labels of a page count once, as bad if any says so. Labels that are
null are no outcome. Without labels nothing is blocked but by rule; where no other
host is labelled, the prior is one good page. The share of all pages starts from half a bad page in two. Urls of any length are taken whole.
Further columns of pages are not returned, whatever their names. An empty table
gives no row. Rules of equal length: a block comes before an allow. A null page id has
no label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved

#: Second-level labels below which country domains register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is host and path prefix, as ``example.org/en/``."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


#: The rules of the production query.
RULES = (
    Rule("org/", "allow"),
    Rule("example.org/es/", "block"),
    Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], value: str) -> Column:
    """The longest fitting rule's field, or null; of equal lengths a block comes first."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.verdict == "block", r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, value))).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or the last two below a country."""
    two = r"((?:%s)\.[a-z][a-z])$" % "|".join(SECOND_LEVEL)
    deep = F.regexp_extract(host, r"\." + two, 1)
    return F.when(deep != "", deep).otherwise(F.element_at(F.split(host, r"\."), -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and the label before it; the host itself where there is none."""
    rest = F.expr("substring(_host, 1, length(_host) - length(_suffix) - 1)")
    return F.when(F.length(host) <= F.length(suffix) + 1, host).otherwise(
        F.concat(F.element_at(F.split(rest, r"\."), -1), F.lit("."), suffix)
    )


def _strength(groups: DataFrame) -> DataFrame:
    """Prior strength from children (_k bad of _n) about their parents' mean _m: one row.

    The moment estimate of the spread starts from a half, so it takes pages of several groups to show that groups are
    alike; with one group, or one page in each, the strength is one page.
    """
    v, some = F.col("_m") * (1 - F.col("_m")), F.count(F.lit(1))
    excess = F.greatest(F.sum(F.col("_n") * F.pow(F.col("_k") / F.col("_n") - F.col("_m"), 2) - v), F.lit(0.0))
    scale = F.sum(v * (F.col("_n") - 1)) * (some - 1) / F.greatest(some, F.lit(1))
    rho = F.least(F.greatest((F.coalesce(excess, F.lit(0.0)) + 0.5) / (F.coalesce(scale, F.lit(0.0)) + 1), F.lit(0.001)), F.lit(0.9))
    return groups.where("_n > 0").agg((1 / rho - 1).alias("_s"))


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of positive numbers: Stirling's series eight places up, and the way back down."""
    up = z + 8
    stirling = (up - 0.5) * F.log(up) - up + 0.9189385332046727 + 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * F.pow(up, F.lit(5.0)))
    way = F.lit(0.0)
    for i in range(8):
        way = way + F.log(z + i)
    return stirling - way


#: Beyond this sum of parameters the quantile is the normal one; up to it the series has this many terms.
LARGE, TERMS = 200.0, 400


def quantile_exceeds(a: Column, b: Column, x: float) -> Column:
    """Whether the 5 % quantile of the beta distribution (a, b) exceeds x: whether less than 5 % of it lies at or below x."""
    # the incomplete beta function as a series of positive terms, each (a + b + j) / (a + 1 + j) * x of the one before
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def longer(acc: Column, j: Column) -> Column:
        term = acc["term"] * (a + b + j) / (a + 1 + j) * x
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(0), F.lit(TERMS)), start, longer)["sum"]
    front = F.exp(log_gamma(a + b) - log_gamma(a + 1) - log_gamma(b) + a * float(np.log(x)) + b * float(np.log1p(-x)))
    mean = a / (a + b)
    normal = mean - 1.645 * F.sqrt(mean * (1 - mean) / (a + b + 1)) > x
    exact = F.when(a <= 0, F.lit(False)).when(b <= 0, F.lit(True)).otherwise(front * series < 0.05)
    return F.when(a + b > LARGE, normal).otherwise(exact)


def reputation(pages: DataFrame, outcomes: DataFrame, max_bad: float = 0.3) -> DataFrame:
    """One row per host: host, n_labelled, n_bad, bad_mean (posterior mean), strength (of its prior) and bad.

    ``outcomes`` has page_id and bad (boolean).
    """
    bad = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("_bad"))
    hosts = (
        pages.select("page_id", host_of(F.col("url")).alias("_host"))
        .join(bad, "page_id", "left")
        .groupBy("_host")
        .agg(F.count("_bad").alias("_n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("_k"))
        .withColumn("_suffix", suffix_of(F.col("_host")))
        .withColumn("_domain", domain_of(F.col("_host"), F.col("_suffix")))
        .withColumn("_h", (F.col("_n") > 0).cast("long"))
    )
    hosts = saved(hosts, "hosts")

    def sums(mark: str) -> list[Column]:
        return [F.coalesce(F.sum(c), F.lit(0)).alias(c + mark) for c in ("_n", "_k", "_h")]

    top = hosts.agg(*sums("0"))  # one row
    share = F.when(F.col("_n0") > 0, (F.col("_k0") + 0.5) / (F.col("_n0") + 2)).otherwise(0.0)  # without labels nothing is bad

    def shrunk(groups: DataFrame, mark: str, name: str) -> DataFrame:
        """groups with the strength of this level (one row, broadcast) and their own mean for the level below."""
        s = _strength(groups.select(F.col("_n" + mark).alias("_n"), F.col("_k" + mark).alias("_k"), "_m")).withColumnRenamed("_s", name)
        return groups.join(F.broadcast(s), how="cross").withColumn("_m", (F.col("_k" + mark) + F.col(name) * F.col("_m")) / (F.col("_n" + mark) + F.col(name)))

    suffixes = hosts.groupBy("_suffix").agg(*sums("1")).join(F.broadcast(top), how="cross").withColumn("_m", share)
    suffixes = shrunk(suffixes, "1", "_s1").withColumnRenamed("_suffix", "_suffix_of")
    domains = hosts.groupBy("_domain", "_suffix").agg(*sums("2")).join(suffixes, F.col("_suffix") == F.col("_suffix_of")).drop("_suffix_of", "_suffix")
    domains = shrunk(domains, "2", "_s2").withColumnRenamed("_domain", "_domain_of")
    leaves = saved(hosts.join(domains, F.col("_domain") == F.col("_domain_of")).drop("_domain_of"), "host-priors")
    leaves = leaves.join(F.broadcast(_strength(leaves).withColumnRenamed("_s", "_s3")), how="cross")

    # the host's prior from the outcomes of others: share and strength of all, then of its suffix, then of its domain
    others = F.col("_h0") - F.col("_h")
    mean = F.when(others > 0, (F.col("_k0") - F.col("_k") + 0.5) / (F.col("_n0") - F.col("_n") + 2)).otherwise(0.0)
    leaves = leaves.withColumns({"_p": mean, "_e": F.when(others > 0, F.least(F.col("_s1"), others.cast("double"))).otherwise(1.0)})
    for mark, strength in (("1", "_s2"), ("2", "_s3")):
        n, k, h = (F.col(c + mark) - F.col(c) for c in ("_n", "_k", "_h"))
        leaves = leaves.withColumns({"_p": (k + F.col("_e") * F.col("_p")) / (n + F.col("_e")), "_e": F.least(F.col(strength), h + F.col("_e"), F.greatest(others, F.lit(1)).cast("double"))})
    a, b = F.col("_k") + F.col("_e") * F.col("_p"), F.col("_n") - F.col("_k") + F.col("_e") * (1 - F.col("_p"))
    return leaves.select(
        F.col("_host").alias("host"), F.col("_n").alias("n_labelled"), F.col("_k").alias("n_bad"), (a / (a + b)).alias("bad_mean"),
        F.col("_e").alias("strength"), quantile_exceeds(a, b, max_bad).alias("bad"),
    )


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, max_bad: float = 0.3
) -> DataFrame:
    """Every page with host, path, rule, verdict, bad_mean and strength. ``pages`` has page_id and url."""
    known = reputation(pages, outcomes, max_bad).withColumnRenamed("host", "_host_of")
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    by_method = F.when(F.col("bad"), "block").otherwise("allow")
    return judged.join(known, host == F.col("_host_of"), "left").select(
        "page_id",
        "url",
        "host",
        "path",
        rule_of(host, path, rules, "pattern").alias("rule"),
        F.coalesce(rule_of(host, path, rules, "verdict"), by_method).alias("verdict"),
        "bad_mean",
        "strength",
    )


def outcomes_of(labels: DataFrame) -> DataFrame:
    """A labelled page is bad when its text is toxic or of low quality."""
    bad = F.when(F.col("quality").isNull() & F.col("toxic").isNull(), None).otherwise(
        (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    )
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
