"""URL filtering by rules and empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (good / bad) are counted per host; beta-binomial priors
then shrink them down a tree: all pages -> public suffix -> registered domain ->
host.  At each level the prior's mean is the parent's posterior mean and its
strength is estimated by moments from the spread of the children around their
parents.  A host is blocked when even the upper bound of its posterior good
rate lies under the threshold; a host without labels inherits its parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import Scratch, UPPER, pack, unpack

#: Public suffixes of two labels that registrars use; all others have one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br",
                      "co.in", "co.za", "com.cn", "com.mx", "com.tr")
ADDED = ["host", "path", "rule", "verdict", "n_labelled", "posterior", "upper_bound"]
MIN_STRENGTH, MAX_STRENGTH = 2.0, 200.0


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.coalesce(F.regexp_substr(rest, F.lit(r"\A[^/?#]+")), F.lit("")), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    tail = F.regexp_replace(rest, r"\A[^/?#]*", "")
    return F.coalesce(F.regexp_substr(tail, F.lit(r"\A[^?#]+")), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict; ``rules`` holds (verdict, host, path prefix)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):   # longer ones last: they win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _strength(children: DataFrame) -> float:
    """Pooled beta-binomial strength of children (n, k) around their parents' mean (pm), by moments.

    E[n (k/n - pm)^2] = pm (1 - pm) (1 + (n - 1) rho) with strength = 1/rho - 1.
    """
    n, pm = F.col("n").cast("double"), F.col("pm")
    v = pm * (1.0 - pm)
    s, sv, svn = children.where("n > 0").agg(
        F.sum(n * (F.col("k") / n - pm) * (F.col("k") / n - pm)), F.sum(v), F.sum(v * n)).first()     # one row
    if s is None or svn <= sv or s <= sv:
        return MAX_STRENGTH
    return min(max((svn - sv) / (s - sv) - 1.0, MIN_STRENGTH), MAX_STRENGTH)


def _shrink(children: DataFrame) -> DataFrame:
    """Posterior alpha, beta and mean of each child under the prior strength * parent mean."""
    s = _strength(children)
    return (children.withColumn("a", s * F.col("pm") + F.col("k"))
            .withColumn("b", s * (1.0 - F.col("pm")) + F.col("n") - F.col("k"))
            .withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """Per host of ``hosts`` (host): n_labelled, posterior mean and upper bound, from ``outcomes`` (host, good).

    Rows of ``outcomes`` with a null host or outcome don't count; without any
    outcome every host has the posterior of the uniform prior.
    """
    seen = outcomes.where("host is not null and good is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    h = hosts.groupBy("host").agg(F.lit(1)).select("host").join(seen, "host", "left").select(
        "host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))
    h = Scratch(h.sparkSession, "hosts").write(h, "hosts")        # small: the jobs below read it
    good, labelled = h.agg(F.sum("k"), F.sum("n")).first()
    mean = ((good or 0) + 0.5) / ((labelled or 0) + 1.0)
    suffixes = _shrink(h.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.lit(mean).alias("pm")))
    domains = _shrink(h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
                      .join(suffixes.select("suffix", F.col("mean").alias("pm")), "suffix"))
    posterior = _shrink(h.join(domains.select("domain", "suffix", F.col("mean").alias("pm")), ["domain", "suffix"]))
    a, b = F.col("a"), F.col("b")
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0)))
    return posterior.select("host", F.col("n").alias("n_labelled"), F.col("mean").alias("posterior"),
                            F.least(F.col("mean") + z * sd, F.lit(1.0)).alias("upper_bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], *, url: str = "url",
               threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """``pages`` plus host, path, rule, verdict, n_labelled, posterior and upper_bound.

    Defined cases: a null url or one without ``://`` has empty host and path
    and is judged like any other host; an input column named like an added one
    gives way; repeated pages are judged alike; an empty table gives an empty
    one.  A host may hold any share of the pages: labels are pre-aggregated per
    host, and the join back to the pages is one that Spark can split.
    """
    host, path = url_host(F.coalesce(pages[url], F.lit(""))), url_path(F.coalesce(pages[url], F.lit("")))
    p = pack(pages, host=host, path=path)
    rep = host_reputation(outcomes, p.select("host"), z).withColumnRenamed("host", "_host")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    out = (p.join(rep, p["host"] == rep["_host"], "left").withColumn("rule", rule)
           .withColumn("verdict", F.coalesce(verdict, F.when(F.col("upper_bound") < threshold, F.lit("block"))
                                             .otherwise(F.lit("allow")))))
    return unpack(out, pages.columns, ADDED)
