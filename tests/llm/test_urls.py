import math
from collections import Counter

from pyspark.sql import functions as F

from pulsemart.llm import urls as u

SCHEMA = "page_id long, url string, html string, host string, verdict string, label string"
ODD = [
    None, "", "no scheme", "http://", "HTTP://WWW.EXAMPLE.COM/en/x?q=1#f", "https://a.example.com/en/1", "https://a.example.com/en",
    "http://x.net/es/1", "http://x.net/de/1", "http://net/fr/", "http://notnet/fr/", "a://b://c.com/p", "http://com", "http://com/",
    "http://q.com?x=/en/", "http://h.com#/", "http://ÄÖ.com/é?a&b", "http://example.com/en/" + "y" * 5000, "http://sub.www.example.com/en/a",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def frame(spark, urls):
    return spark.createDataFrame([(i, url, "", "h", "v", "l") for i, url in enumerate(urls)], SCHEMA)


def test_rules_equal_brute_force(spark, sf_dir):
    urls = ODD + [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()]
    got = u.judge(frame(spark, urls)).orderBy("page_id").collect()
    assert len(got) == len(urls)
    for row, url in zip(got, urls):
        host, path, rule, verdict = brute(url)
        assert (row.host, row.path, row.rule) == (host, path, rule), url
        assert row.verdict == verdict if verdict else row.verdict in ("allow", "block")


def test_features(spark):
    row = u.lexical(u.host_and_path(frame(spark, ["http://a-b.net/x/12?p=1&q=2#t"]))).first()
    text = "http://a-b.net/x/12?p=1&q=2#t"
    entropy = -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())
    assert math.isclose(row.entropy, entropy) and row.depth == 2 and row.n_params == 2 and row.suffix == "net"
    assert row.n_hyphens == 1 and row.has_fragment == 1 and math.isclose(row.digit_ratio, 4 / len(text))


def test_trees_learn_from_labels(spark):
    good = [f"http://site{i}.org/page/{i}" for i in range(120)]
    bad = [f"http://x-{i}-y-z.org/{i}{i}{i}{i}{i}{i}?a={i}&b=2&c=3" for i in range(120)]
    labelled = frame(spark, good[:80] + bad[:80]).withColumn("label", (F.col("page_id") >= 80).cast("int"))
    got = u.judge(frame(spark, good[80:] + bad[80:]), labelled, rules=[]).orderBy("page_id").collect()
    right = sum((r.verdict == "block") == (r.page_id >= 40) for r in got)
    assert right / len(got) > 0.95


def test_no_or_one_kind_of_label(spark):
    assert {r.verdict for r in u.judge(frame(spark, ["http://a.org/", None])).collect()} == {"allow"}
    assert {r.verdict for r in u.judge(frame(spark, ["http://a.net/fr/", "http://b.org/"])).collect()} == {"block"}


def test_empty(spark):
    assert u.judge(frame(spark, ["x"]).limit(0)).collect() == []


def test_both_verdicts_where_no_rule_fits(spark):
    judged = u.op7_url_verdicts(spark, "/root/testdata/sf0.1").where("rule is null")
    found = {r.verdict: r["count"] for r in judged.groupBy("verdict").count().collect()}
    assert min(found.get("allow", 0), found.get("block", 0)) > 100


def test_a_rule_left_out_is_judged_by_likeness(spark):
    """The trees learn without one rule and judge its URLs; what they can know is the likeness to the others."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    ruled = u.with_rule(u.host_and_path(pages)).where("rule is not null").cache()
    right = {}
    for rule in ("net/es/", "net/fr/"):
        known = ruled.where(F.col("rule") != rule).select("url", (F.col("rule_verdict") == "block").cast("int").alias("label"))
        got = u.judge(ruled.where(F.col("rule") == rule).select("page_id", "url"), known, rules=[])
        right[rule] = got.agg(F.avg((F.col("verdict") == "block").cast("double"))).first()[0]
    assert min(right.values()) > 0.9, right


def test_out_of_fold_statistics_leave_the_own_label_out(spark):
    rows = [("s", 0, 1.0), ("s", 0, 1.0), ("s", 1, 0.0), ("t", 2, 1.0)]
    got = {(r.suffix, r.fold): r.suffix_block_rate for r in u.out_of_fold_statistics(spark.createDataFrame(rows, "suffix string, fold int, label double")).collect()}
    assert got == {("s", 0): 5 / 11, ("s", 1): 7 / 12, ("t", 2): 0.5}
