"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Words are summed by source and hash bucket; the running sum of a source's buckets shows in which
bucket its budget runs out, only that bucket is split further, and one threshold per source is left.
A document is taken when its hash is under the threshold, so nothing is sorted, reruns agree, and a
smaller budget takes a subset of a larger one.

Nulls and odd inputs: a null source is a source of its own, after all others; a null text has size 0;
documents without words have size 0 and follow the threshold like others; rows with equal ids share a
hash and so a decision; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import count_words, materialize

#: Bits of the hash that one histogram resolves, and the number of histograms.
BITS, LEVELS = 12, 3
#: Sources up to this many are joined by broadcast: at most 100,000 rows of five numbers and a name.
BROADCAST_SOURCES = 100_000


def hash36(id_col: str):
    """36 bits of the md5 of the id's text: the same in every SQL engine."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], ratio: float, most: float) -> DataFrame:
    """(source, source_size) -> adds target: `ratio` of all sizes shared by cyclic weights, none above `most` times its source.

    Excess is reshared by weight: sources fill up in the order of cap / weight, and the common level is
    the first that the rest can all hold.
    """
    total = Window.partitionBy()
    ranked = sizes.withColumn("__i", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    ranked = ranked.withColumn("__w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("__i") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("__cap", F.col("source_size") * F.lit(float(most))).withColumn("__full", F.col("__cap") / F.col("__w"))
    before = Window.orderBy("__full", "__i").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(total) * F.lit(float(ratio)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    share = F.sum("__w").over(total) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    levels = ranked.withColumn("__level", left / share)
    level = F.min_by(F.when(F.col("__level") <= F.col("__full"), F.col("__level")), F.when(F.col("__level") <= F.col("__full"), F.struct("__full", "__i"))).over(total)
    target = F.least(F.coalesce(F.col("__w") * level, F.col("__cap")), F.col("__cap"))
    return levels.select("source", "source_size", target.alias("target"))


def mix_plan(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), ratio: float = 1.5, most: int = 2) -> DataFrame:
    """sized(source, size, hash) -> one row per source: source_size, target, repeats, threshold."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, ratio, most)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = materialize(plan.withColumn("repeats", repeats).withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size")), "mix-plan")
    edge = plan.select("source", "rest", F.lit(0).cast("long").alias("prefix"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        key = F.shiftrightunsigned("hash", shift).alias("bucket")
        if level == 1:
            inside = sized.select("source", "size", key)
        else:
            e = edge.select(F.col("source").alias("__glossa_s"), "prefix")
            inside = sized.join(F.broadcast(e) if few else e, F.col("source").eqNullSafe(F.col("__glossa_s")) & (F.shiftrightunsigned("hash", shift + BITS) == F.col("prefix"))).select("source", "size", key)
        hist = inside.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
        e = edge.select(F.col("source").alias("__glossa_s"), "rest")
        here = hist.join(e, F.col("source").eqNullSafe(F.col("__glossa_s"))).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
        edge = materialize(here.select("source", (F.col("rest") - F.col("before")).alias("rest"), F.col("bucket").alias("prefix"), "n"), "mix-edge")
        few = edge.count() <= BROADCAST_SOURCES
    near = (F.col("prefix") + F.when(F.col("n") - F.col("rest") < F.col("rest"), 1).otherwise(0)).alias("threshold")
    e = edge.select(F.col("source").alias("__glossa_s"), near)
    joined = plan.join(e, F.col("source").eqNullSafe(F.col("__glossa_s")), "left")
    return joined.select("source", "source_size", "target", "repeats", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def with_copies(df: DataFrame, plan: DataFrame, source_col: str = "source", hash_col: str = "hash") -> DataFrame:
    """Add source_size, target and copies (how often the mix takes the row) to rows that carry a source and a hash."""
    p = plan.select(F.col("source").alias("__glossa_s"), F.col("source_size").alias("__glossa_source_size"), F.col("target").alias("__glossa_target"), F.col("repeats").alias("__glossa_repeats"), F.col("threshold").alias("__glossa_threshold"))
    if plan.count() <= BROADCAST_SOURCES:
        p = F.broadcast(p)
    copies = (F.col("__glossa_repeats") + (F.col(hash_col) < F.col("__glossa_threshold")).cast("long")).alias("__glossa_copies")
    return df.join(p, df[source_col].eqNullSafe(F.col("__glossa_s"))).select(*[df[c] for c in df.columns], "__glossa_source_size", "__glossa_target", copies)


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size in words, hash), written once: the whole texts are read a single time."""
    return materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), hash36(id_col).alias("hash")), "mix-sized")


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    sized = sized_rows(docs)
    out = with_copies(sized, mix_plan(sized, **options))
    return out.select("doc_id", "size", F.col("__glossa_source_size").alias("source_size"), F.col("__glossa_target").alias("target"), (F.col("size") * F.col("__glossa_copies")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: rows of `docs`, all their columns, each as often as the mix takes it (0 to 2 times)."""
    plan = mix_plan(sized_rows(docs, id_col, text_col, source_col), **options)
    taken = with_copies(docs.withColumn("__glossa_hash", hash36(id_col)), plan, source_col, "__glossa_hash").where("__glossa_copies > 0")
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__glossa_copies"))).alias("__glossa_copy")
    return taken.select(*docs.columns, again).drop("__glossa_copy")
