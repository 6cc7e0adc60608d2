import math

from pyspark.sql import functions as F

from ticketlens.llm import url_reputation as u

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return host.translate({i: i + 32 for i in range(65, 91)}), tail[:end]


def best(host, path):
    fit = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fit)[1], max(fit)[2]) if fit else (None, None)


URLS = ["http://A.Example.ORG/en/12?x#y", "https://example.org/es/", "x://example.org", "http://notexample.org/es/a", "ftp://com/fr/", "a.com/de/1",
        None, "", "http://", "http:///de/", "http://b.com?/de/", "http://b.com/de/#z", "http://É.com/fr/", "p://q://r.com/de/", "http://b.com#://c.org/x"]


def test_parts_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    none = spark.createDataFrame([], "host string, good boolean")
    got = {r.page_id: r for r in u.judge_urls(df, none, RULES).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = parts(url)
        rule, verdict = best(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow")
    assert u.judge_urls(df.where("false"), none, RULES).collect() == []


def test_shrinkage_down_the_tree(spark):
    seen = [("bad.a.net", 0)] * 40 + [("good.a.net", 1)] * 40 + [("x.b.net", 1)] * 30 + [("few.b.net", 0)] * 2 + [(None, 1), ("x.b.net", None)]
    outcomes = spark.createDataFrame(seen, "host string, good int")
    hosts = ["bad.a.net", "good.a.net", "x.b.net", "few.b.net", "new.a.net", "new.b.net", "z.co.uk"]
    got = {r.host: r for r in u.host_reputation(outcomes, spark.createDataFrame([(h,) for h in hosts], "host string")).collect()}
    assert got["bad.a.net"].upper_bound < 0.5 < got["few.b.net"].upper_bound
    assert got["bad.a.net"].posterior < got["new.a.net"].posterior < got["good.a.net"].posterior
    assert got["new.a.net"].posterior < got["new.b.net"].posterior
    assert got["few.b.net"].posterior > 0.0 and got["z.co.uk"].n_labelled == 0
    assert all(0 < r.posterior < 1 and r.posterior <= r.upper_bound <= 1 for r in got.values())
    df = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string")
    verdict = {r.host: r.verdict for r in u.judge_urls(df, outcomes, RULES).collect()}
    assert verdict["bad.a.net"] == "block" and verdict["good.a.net"] == "allow" and verdict["few.b.net"] == "allow"


def test_strength_by_moments(spark):
    """200 hosts drawn from a beta prior of strength 10: the estimate comes near it."""
    import numpy as np
    rng = np.random.default_rng(4)
    rows = [(60, int(rng.binomial(60, rng.beta(7, 3))), 0.7) for _ in range(400)]
    s = u._strength(spark.createDataFrame(rows, "n long, k long, pm double"))
    assert math.isclose(s, 10, rel_tol=0.3)
