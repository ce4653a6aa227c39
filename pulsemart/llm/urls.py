"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest.

Everything is a DataFrame expression or a Spark ML estimator; no Python runs on the executors.
The trees learn from labelled URLs; without others these are the URLs that the rules judge.
A table of all labelled URLs trains the model, so nothing is sampled. The suffix statistic is the
smoothed share of blocks of a suffix among the labelled URLs; a URL that the trees learn from gets it from
the hosts of other folds, so that it does not contain its own label, and one of an unknown suffix gets one
half. Counts of a suffix are left out: they tell the rules' hosts from all others and nothing else.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
judged by the trees on the features of an empty string; with no labelled URLs the verdict is allow,
with labels of one kind only it is that kind; repeated rows each get a row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsemart.llm import common

# Verdict, host and path of each rule.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
FEATURES = [
    "n_chars", "host_chars", "path_chars", "depth", "labels_in_host", "digit_ratio", "entropy", "n_params",
    "n_hyphens", "has_fragment", "suffix_block_rate",
]
TREES, DEPTH, PRIOR_ROWS, FOLDS = 20, 4, 10.0, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(pages: DataFrame) -> DataFrame:
    """Adds host and path to (page_id, url)."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    return (
        pages.withColumn("rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), UPPER, LOWER))
        .withColumn("path", F.regexp_extract("rest", r"^[^/?#]*(/[^?#]*)?", 1))
        .drop("rest")
    )


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds the longest rule that fits (host + path) and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = (
            ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        )
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits."""
    n = F.length(text).cast("double")

    def add(total: Column, c: Column) -> Column:
        share = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return total - share * F.log2(share)

    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), add)).otherwise(F.lit(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features and the suffix (last label of the host)."""
    text = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)

    def count(column: Column, part: str) -> Column:
        return (F.length(column) - F.length(F.replace(column, F.lit(part), F.lit("")))).cast("double")

    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return urls.select(
        "*",
        F.length(text).cast("double").alias("n_chars"),
        F.length("host").cast("double").alias("host_chars"),
        F.length("path").cast("double").alias("path_chars"),
        count(F.col("path"), "/").alias("depth"),
        count(F.col("host"), ".").alias("labels_in_host"),
        (digits / F.greatest(F.length(text), F.lit(1))).cast("double").alias("digit_ratio"),
        _entropy(text).alias("entropy"),
        F.when(query != "", count(query, "&") + 1).otherwise(0.0).alias("n_params"),
        count(text, "-").alias("n_hyphens"),
        F.contains(text, F.lit("#")).cast("double").alias("has_fragment"),
        F.element_at(F.split("host", r"\."), -1).alias("suffix"),
    )


def _rate(blocked: Column, n: Column) -> Column:
    """The share of blocks, drawn to one half by a few rows."""
    return ((blocked + 0.5 * PRIOR_ROWS) / (n + PRIOR_ROWS)).alias("suffix_block_rate")


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """suffix_block_rate per suffix of the labelled URLs."""
    return labelled.groupBy("suffix").agg(_rate(F.sum("label"), F.count("*")))


def out_of_fold_statistics(labelled: DataFrame) -> DataFrame:
    """suffix_block_rate per suffix and fold, from the rows of the other folds."""
    parts = labelled.groupBy("suffix", "fold").agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
    whole = parts.groupBy("suffix").agg(F.sum("blocked").alias("all_blocked"), F.sum("n").alias("all_n"))
    return parts.join(whole, "suffix").select("suffix", "fold", _rate(F.col("all_blocked") - F.col("blocked"), F.col("all_n") - F.col("n")))


def _features(urls: DataFrame, statistics: DataFrame, *keys: str) -> DataFrame:
    joined = urls.join(statistics, list(keys), "left").fillna({"suffix_block_rate": 0.5})
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(joined)


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    ``labelled``: url and label (1 block, 0 allow); by default the URLs that a rule judges.
    """
    urls = lexical(with_rule(host_and_path(pages.select("page_id", "url")), rules))
    if labelled is None:
        known = urls.where("rule is not null").withColumn("label", (F.col("rule_verdict") == "block").cast("double"))
    else:
        known = lexical(host_and_path(labelled.select("url", F.col("label").cast("double").alias("label")).where("label is not null")))
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).alias("fold")
    known = common.stored(known.select("suffix", fold, "label", *FEATURES[:-1]), "labelled-urls")
    kinds = {row[0] for row in known.select("label").distinct().limit(3).collect()}
    out = ["page_id", "host", "path", "rule"]
    if len(kinds) < 2:
        verdict = F.lit("block" if kinds == {1.0} else "allow")
        return urls.select(*out, F.coalesce("rule_verdict", verdict).alias("verdict"))
    statistics = common.stored(suffix_statistics(known), "suffixes")
    folded = common.stored(out_of_fold_statistics(known), "suffix-folds")
    model = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7
    ).fit(_features(known, folded, "suffix", "fold"))
    judged = model.transform(_features(urls, statistics, "suffix"))
    verdict = F.when(F.col("prediction") > 0.5, "block").otherwise("allow")
    return judged.select(*out, F.coalesce("rule_verdict", verdict).alias("verdict"))


def op7_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))


SQL: dict[str, str] = {}  # the trees have none; tests compare the rules with brute force
QUERIES = {"op7_url_verdicts": op7_url_verdicts}
