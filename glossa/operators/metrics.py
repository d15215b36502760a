"""Evaluation: confusion counts, accuracy, macro F1, rule statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual")).pivot(predicted, labels).agg(F.count(F.lit(1))).na.fill(0)


def top_confusions(df: DataFrame, actual: str, predicted: str, k: int = 25) -> DataFrame:
    """The k most frequent mistakes and their share of the actual class."""
    counts = confusion(df, actual, predicted).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))
    return counts.where("actual != predicted").orderBy(F.desc("n"), F.desc("share"), "actual", "predicted").limit(k)


def mistakes(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.where(F.col(actual) != F.col(predicted)).groupBy(F.concat_ws(" -> ", actual, predicted).alias("mistake")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def class_f1(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """F1 of every label that occurs as actual or predicted, from confusion counts."""
    sides = F.explode(F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("s")
    hits = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    rows = counts.select(*by, hits.alias("hit"), sides).select(*by, "s.label", "s.t", "s.p", F.when(F.col("s.t") > 0, F.col("hit")).otherwise(F.lit(0)).alias("hit"))
    return rows.groupBy(*by, "label").agg((2 * F.sum("hit") / F.sum(F.col("t") + F.col("p"))).alias("f1"))


def macro_f1(df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean F1 over the union of actual and predicted labels."""
    return class_f1(confusion(df, actual, predicted, by), by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def rule_stats(df: DataFrame, rule: Callable[[Column], Column], text_col: str = "Snippet", label_col: str = "Language") -> DataFrame:
    """Matches, samples and share of a predicate by language."""
    hit = rule(F.col(text_col)).cast("long")
    return df.groupBy(F.col(label_col).alias("Language")).agg(F.sum(hit).alias("NMatches"), F.count(F.lit(1)).alias("NSamples"), F.avg(hit).alias("Occurrence"))


def token_stats(featured: DataFrame, tokens: list[str], label_col: str = "Language") -> DataFrame:
    """rule_stats of every token at once, from `active`: one pass, counts by (language, token) only."""
    sizes = featured.groupBy(F.col(label_col).alias("Language")).agg(F.count(F.lit(1)).alias("NSamples"))
    hits = featured.select(F.col(label_col).alias("Language"), F.explode("active").alias("idx")).groupBy("Language", "idx").agg(F.count(F.lit(1)).alias("NMatches"))
    every = sizes.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(len(tokens) - 1))))
    n = F.coalesce("NMatches", F.lit(0).cast("long"))
    return every.join(hits, ["Language", "idx"], "left").select("Language", "idx", n.alias("NMatches"), "NSamples", (n / F.col("NSamples")).alias("Occurrence"))


def top_n_accuracy(df: DataFrame, actual_class: str, scores: str, n: int) -> DataFrame:
    """Share of rows whose class number is among the n highest scores; ties count in its favour."""
    own = F.element_at(F.col(scores), F.col(actual_class) + 1)
    above = F.size(F.filter(F.col(scores), lambda s: s > own))
    return df.agg(F.avg((above < n).cast("double")).alias("accuracy"))


def top_k_confusions_markdown(rows: DataFrame) -> str:
    """A small report (top_confusions) as a Markdown table."""
    head = "| actual | predicted | n | share |\n|-|-|-|-|\n"
    return head + "".join(f"| {r.actual} | {r.predicted} | {r.n} | {r.share:.1%} |\n" for r in rows.collect())
