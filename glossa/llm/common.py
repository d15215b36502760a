"""Helpers shared by the corpus operators."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.sources.scratch import materialize, release, scratch_scope  # noqa: F401  shared with the engine

#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; all-ASCII texts take the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def crc_mod(doc_id: int | None, n: int) -> int:
    """crc32 of the decimal text of an id, modulo n; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % n


def crc_mod_col(doc_id: Column, n: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % n


def buckets_for(rows: int, per_bucket: int = 200_000) -> int:
    """How many hash buckets keep a group that holds all rows at about per_bucket rows each."""
    return max(16, -(-rows // per_bucket))


def rank_in_group(df: DataFrame, keys: list[str], order: list[str], rank: str, buckets: int) -> DataFrame:
    """Number the rows of each group from 0 without sorting a group in one task.

    Rows go to `buckets` hash buckets of the order columns; a bucket's first number is the sum of the
    counts before it. Keys must be non-null. `df` is read twice: pass a materialized frame.
    """
    df = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    by = [*keys, "__b"]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*by, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*by).orderBy(*order)
    ranked = df.join(base, by).withColumn(rank, F.col("__base") + F.row_number().over(within) - 1)
    return ranked.drop("__b", "__base")


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], counts: DataFrame, by: str, how: str = "inner", total: int | None = None, most: int | None = None) -> DataFrame:
    """Join many rows a key with the one row of that key in `one`, gathering no key in one task.

    counts(*keys, __n) has the rows of each key in `many`. A key of more than `most` rows (by default a
    thousandth of all, and 100 at least) is dealt over parts by a hash of column `by`, and its row in
    `one` is repeated for each part; at most all / most such keys are broadcast. `total`, the rows of
    `many`, is counted where it is not known.
    """
    if most is None:
        if total is None:
            total = counts.agg(F.sum("__n")).first()[0] or 0
        most = max(100, total // 1000)
    heavy = F.broadcast(counts.where(F.col("__n") > most).select(*keys, F.ceil(F.col("__n") / most).alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    many = many.join(heavy, keys, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts)).drop("__parts")
    one = one.join(heavy, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
    return many.join(one, [*keys, "__part"], how).drop("__part")
