"""URL filtering: rules first, gradient-boosted trees on lexical features for every URL that no rule names.

The trees learn from the URLs that the rules label: a hash sample of about ``TRAIN_ROWS`` of them (all, if there are
fewer), features and verdicts of all URLs staying in the JVM. Suffix statistics (how often each last host label is
labelled, and its smoothed share of blocks) are grouped sums over all labelled URLs, joined by suffix.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the trees on
its features. Repeated URLs get equal verdicts. Long URLs are read whole. If the rules label no URL, or label all alike,
there is nothing to learn and the rest takes that one label, or ``allow``. Extra columns play no part. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanok.llm.tables import ascii_lower, staged

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
TRAIN_ROWS, TREES, DEPTH, STEP = 20_000, 10, 4, 0.3
#: Labelled URLs at which a suffix counts half with its own share and half with that of all.
SMOOTH = 20.0
FEATURES = ["length", "host_length", "labels", "depth", "path_length", "digits", "entropy", "params", "hyphens", "suffix_seen", "suffix_block"]
SPREAD = 1 << 20


def located(pages: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``keep`` columns with url, host and path."""
    url = F.coalesce("url", F.lit(""))
    pattern = "(?s)://([^/?#]*)([^?#]*)"
    return pages.select(*keep, url.alias("url"), ascii_lower(F.regexp_extract(url, pattern, 1)).alias("host"), F.regexp_extract(url, pattern, 2).alias("path"))


def ruled(rows: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add rule and label: those of the longest rule whose host is the URL's or above it and whose path begins the URL's."""
    rule = label = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, label = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(label)
    return rows.withColumn("rule", rule).withColumn("label", label)


def _count(text: Column, what: str) -> Column:
    return F.regexp_count(text, F.lit(what)).cast("double")


def lexical(rows: DataFrame) -> DataFrame:
    """Add the lexical features of each URL, and its suffix (the last label of the host)."""
    url, n = F.col("url"), F.length("url").cast("double")
    kinds = F.array_distinct(F.filter(F.split("url", ""), lambda c: c != ""))
    share = lambda c: (n - F.length(F.replace(url, c))) / n
    entropy = F.aggregate(kinds, F.lit(0.0), lambda sum_, c: sum_ - share(c) * F.log2(share(c)))
    query = F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1)
    return rows.select(
        "*",
        F.regexp_extract("host", r"([^.:]*)(:[0-9]*)?$", 1).alias("suffix"),
        n.alias("length"),
        F.length("host").cast("double").alias("host_length"),
        _count(F.col("host"), r"[^.]+").alias("labels"),
        _count(F.col("path"), r"[^/]+").alias("depth"),
        F.length("path").cast("double").alias("path_length"),
        (_count(url, "[0-9]") / F.greatest(n, F.lit(1.0))).alias("digits"),
        F.coalesce(entropy, F.lit(0.0)).alias("entropy"),
        _count(query, "[^&;]+").alias("params"),
        _count(F.col("host"), "-").alias("hyphens"),
    )


def _with_suffixes(rows: DataFrame) -> DataFrame:
    """Add how often the suffix is labelled (log) and its share of blocks, drawn towards that of all labelled URLs."""
    blocked = F.sum(F.when(F.col("label") == "block", 1).otherwise(0))
    labelled = rows.filter("label is not null")
    overall = F.lit(labelled.agg(blocked / F.count("*")).first()[0] or 0.0)  # one number
    by = labelled.groupBy("suffix").agg(F.count("*").alias("_seen"), blocked.alias("_blocked"))
    share = (F.coalesce("_blocked", F.lit(0)) + SMOOTH * overall) / (F.coalesce("_seen", F.lit(0)) + SMOOTH)
    joined = rows.join(by, "suffix", "left")
    return joined.withColumns({"suffix_seen": F.log1p(F.coalesce("_seen", F.lit(0))), "suffix_block": share}).drop("_seen", "_blocked")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score), one row per row of ``pages(page_id, url)``.

    ``block_score`` is the trees' probability of a block, null where a rule decides.
    """
    rows = staged(_with_suffixes(staged(lexical(ruled(located(pages), rules)), "lexical")), "features")
    seen = {r["label"]: r["n"] for r in rows.filter("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    out = ["page_id", "host", "path", "rule"]
    if len(seen) < 2:
        rest = next(iter(seen), "allow")
        return rows.select(*out, F.coalesce("label", F.lit(rest)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    share = int(SPREAD * min(1.0, train_rows / sum(seen.values())))
    chosen = rows.filter(F.col("label").isNotNull() & (F.pmod(F.xxhash64("url", "page_id"), F.lit(SPREAD)) < share))
    train = vectors.transform(chosen.select(*FEATURES, F.when(F.col("label") == "block", 1.0).otherwise(0.0).alias("_y"))).select("_features", "_y")
    trees = GBTClassifier(featuresCol="_features", labelCol="_y", predictionCol="_block", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7)
    model = trees.fit(staged(train, "url-sample"))
    scored = model.transform(vectors.transform(rows))
    learnt = F.when(F.col("_block") == 1.0, "block").otherwise("allow")
    score = F.when(F.col("label").isNull(), vector_to_array("probability")[1])
    return scored.select(*out, F.coalesce("label", learnt).alias("verdict"), score.alias("block_score"))
