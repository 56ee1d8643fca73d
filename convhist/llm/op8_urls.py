"""URL filter: host and path rules first, then gradient-boosted trees on lexical features.

Features: length, depth, digit ratio, character entropy, number of parameters, parts and length of the host, and the
smoothed share of blocked URLs among all labelled ones with its last one and two host parts. The trees are fitted on at most
TRAIN_ROWS labelled URLs (those with the least hash); everything else covers all rows. Without labels of both kinds the verdict of
the method is the one kind there is, or allow.

Defined cases: a null url, or one without ://, has empty host and path, no rule and the features of an empty text; ids and
repeated rows play no part; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convhist.llm.common import materialize

TRAIN_ROWS = 20_000
SMOOTHING = 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict) of the rules in use.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
FEATURES = ["length", "depth", "digit_ratio", "entropy", "params", "host_parts", "host_length", "suffix_share", "site_share"]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. A rule fits its host and all subdomains."""
    rule = verdict = F.lit(None).cast("string")
    for name, prefix, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _parts(pages: DataFrame, url_col: str, id_col: str) -> DataFrame:
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    named = pages.select(F.col(f"`{id_col}`").alias("page_id"), url.alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    parts = F.split("host", r"\.")
    n = F.length("url")
    chars = F.array_distinct(F.split("url", ""))
    shares = F.transform(F.filter(chars, lambda c: c != ""), lambda c: (n - F.length(F.replace(F.col("url"), c, F.lit("")))) / n)
    query = F.regexp_extract("url", r"(?s)\A[^?#]*\?([^#]*)", 1)
    return named.withColumns(
        {
            "length": n.cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double"),
            "digit_ratio": F.when(n > 0, F.length(F.regexp_replace("url", "[^0-9]", "")) / n).otherwise(0.0),
            "entropy": F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
            "params": F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double"),
            "host_parts": F.when(F.col("host") == "", 0.0).otherwise(F.size(parts).cast("double")),
            "host_length": F.length("host").cast("double"),
            "suffix": F.element_at(parts, -1),
            "site": F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)),
        }
    )


class UrlModel:
    """Trees and suffix statistics fitted on labelled URLs (url, label with 1 to block)."""

    def __init__(self, labelled: DataFrame, max_rows: int = TRAIN_ROWS, trees: int = 10, depth: int = 4, seed: int = 5):
        known = labelled.filter("url is not null and label is not null").select(F.col("url"), F.col("label").cast("double").alias("label"))
        totals = (F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        counts = materialize(_parts(known, "url", "label").withColumnRenamed("page_id", "label").groupBy("suffix", "site").agg(*totals))
        said = counts.agg((F.sum("bad") / F.sum("n")).alias("share"), F.min("low").alias("low"), F.max("high").alias("high")).head()
        self.prior = said["share"] or 0.0
        self.constant = None if said["low"] != said["high"] else (said["low"] or 0.0) > 0.5
        self.shares: dict[str, DataFrame] = {}
        if self.constant is None:
            for name, column in (("suffix_share", "suffix"), ("site_share", "site")):
                self.shares[name] = materialize(counts.groupBy(column).agg(((F.sum("bad") + SMOOTHING * self.prior) / (F.sum("n") + SMOOTHING)).alias(name)))
            sample = known.orderBy(F.xxhash64("url"), "url", "label").limit(max_rows)
            rows = _parts(sample, "url", "label").withColumnRenamed("page_id", "label").persist()
            trained = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(self.with_shares(rows))
            self.trees = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label").fit(trained)
            rows.unpersist()

    def with_shares(self, rows: DataFrame) -> DataFrame:
        for name, column in (("suffix_share", "suffix"), ("site_share", "site")):
            rows = rows.join(self.shares[name].hint("merge"), column, "left").withColumn(name, F.coalesce(name, F.lit(self.prior)))
        return rows

    def blocks(self, rows: DataFrame) -> DataFrame:
        """Rows with a column `blocked`."""
        if self.constant is not None:
            return rows.withColumn("blocked", F.lit(self.constant))
        scored = self.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(self.with_shares(rows)))
        return scored.withColumn("blocked", vector_to_array("probability")[1] > 0.5)


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    scored = model.blocks(_parts(pages, url_col, id_col))
    own = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs whose path names a labelled document by number: to block if the document is of low quality or toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html|/)?$", 1)
    named = pages.select("url", F.when(number != "", number).cast("long").alias("doc_id")).filter("doc_id is not null")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1.0).otherwise(0.0)
    return named.join(labels.groupBy("doc_id").agg(F.max(bad).alias("label")), "doc_id").select("url", "label")


def op8_url_verdicts(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(pages, UrlModel(labelled_urls(pages, labels)))
