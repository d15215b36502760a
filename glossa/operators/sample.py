"""Sampling and splitting by hash order: the same rows at any partitioning, in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.sources.scratch import materialize


def hash_order(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)).cast("binary"))


def numbered(df: DataFrame, by: list[str], order: Column, ties: list[str]) -> DataFrame:
    """Add __i, the number (from 1) of each row of its group in the order of a hexadecimal hash, and __n, the group's size.

    A group is cut by the first four digits of the hash, which keep its order, so no task sorts a whole
    group: a row's number is its number among those with the same digits plus the counts before them.
    """
    keyed = df.withColumn("__h", order).withColumn("__b", F.substring("__h", 1, 4))
    counts = keyed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__b").alias("__bb"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(whole).alias("__n"))
    same = F.col("__b") == F.col("__bb")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    within = Window.partitionBy(*by, "__b").orderBy("__h", *ties)  # ties: further columns that tell equal hashes apart
    return keyed.join(base, same).withColumn("__i", F.col("__before") + F.row_number().over(within)).select(*df.columns, "__i", "__n")


def _numbered(df: DataFrame, by: list[str], id_col: str, seed: str) -> DataFrame:
    return numbered(df, by, hash_order(id_col, seed), [id_col])


def stratified_sample(df: DataFrame, fraction: float, label_col: str = "Language", id_col: str = "FileId", seed: str = "0") -> DataFrame:
    """round(fraction * n), half to even, rows of each class."""
    return _numbered(df, [label_col], id_col, seed).where(F.col("__i") <= F.rint(F.col("__n") * fraction)).drop("__i", "__n")


def stratified_split(df: DataFrame, test_share: float = 0.2, label_col: str = "Language", id_col: str = "FileId", seed: str = "42") -> DataFrame:
    """Add `split`: ceil(test_share * n) rows are `test`, dealt to the classes by largest remainder, then by label."""
    sizes = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("__k"))
    every = Window.partitionBy()
    exact = F.ceil(F.sum("__k").over(every) * test_share) * F.col("__k") / F.sum("__k").over(every)
    quota = sizes.withColumn("__e", exact).withColumn("__f", F.floor("__e")).withColumn("__left", F.ceil(F.sum("__k").over(every) * test_share) - F.sum("__f").over(every))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__e") - F.col("__f"), 9)), F.asc_nulls_last(label_col)))
    quota = quota.select(F.col(label_col).alias("__label"), (F.col("__f") + (rank <= F.col("__left")).cast("long")).alias("__quota"))
    numbered = _numbered(df, [label_col], id_col, seed)
    joined = numbered.join(quota, numbered[label_col].eqNullSafe(quota["__label"]))
    return joined.withColumn("split", F.when(F.col("__i") <= F.col("__quota"), "test").otherwise("train")).select(*df.columns, "split")


def prefix_sums(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Add __before_<c> for each column: its sum over the rows of smaller keys, in as many range partitions as there are shuffle partitions.

    Keys must be distinct and non-null. The partitioning is written out, as its bounds differ from one run to the next.
    """
    parts = materialize(rows.repartitionByRange(key).withColumn("__p", F.spark_partition_id()), "prefix-sums")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("__p").agg(*[F.sum(c).alias(c) for c in columns])
    base = totals.select("__p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__base_{c}") for c in columns])
    within = Window.partitionBy("__p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    added = [(F.col(f"__base_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"__before_{c}") for c in columns]
    return parts.join(base, "__p").select(*rows.columns, *added)


def systematic_sample(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """Every max(1, floor(total / n))-th row in order, n at most; rows of equal order value are in hash order, null ones left out.

    Only the distinct order values are sorted, with their counts; rows come in by the at most n values that hold a picked row.
    """
    keyed = df.where(F.col(order_col).isNotNull())
    counts = keyed.groupBy(F.col(order_col).alias("__key")).agg(F.count(F.lit(1)).alias("__c"))
    placed = prefix_sums(counts, "__key", ["__c"])
    total = placed.agg(F.coalesce(F.sum("__c"), F.lit(0))).first()[0]
    step = max(1, total // n)
    first = F.col("__before___c")
    hit = F.ceil(first / step) * step  # the first picked place from here on
    picked = placed.where((hit < first + F.col("__c")) & (hit < step * n)).select("__key", first.alias("__first"))
    found = keyed.join(picked, F.col(order_col) == F.col("__key"))
    ranked = numbered(found, ["__key"], F.md5(F.to_json(F.struct(*df.columns)).cast("binary")), [])
    place = F.col("__first") + F.col("__i") - 1
    return ranked.where((place % step == 0) & (place < step * n)).select(*df.columns)


def skip_take(df: DataFrame, skip: int, take: int, label_col: str, id_col: str) -> DataFrame:
    """Rows skip+1 to skip+take of each class in id order."""
    i = F.row_number().over(Window.partitionBy(label_col).orderBy(id_col))
    return df.withColumn("__i", i).where((F.col("__i") > skip) & (F.col("__i") <= skip + take)).drop("__i")


def subset_of_split(df: DataFrame, subset: float, split_col: str, id_col: str, seed: str = "42") -> DataFrame:
    """max(1, int(n * subset)) rows of each split, in hash order; a share of 0 or less is an error."""
    if subset <= 0:
        raise ValueError("subset must be positive")
    most = F.greatest(F.lit(1), F.floor(F.col("__n") * min(subset, 1.0)))
    return _numbered(df, [split_col], id_col, seed).where(F.col("__i") <= most).drop("__i", "__n")


def head_of_groups(df: DataFrame, n: int, label_col: str, order_col: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy(label_col).orderBy(order_col))
    return df.withColumn("__i", i).where(F.col("__i") <= n).drop("__i")
