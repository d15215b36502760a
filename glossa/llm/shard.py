"""Sharding by longest processing time: the largest group goes to the least-loaded shard, again and again.

Groups of equal texts stay together. Groups of nearly the same size are interchangeable, so only a
histogram of group sizes comes to the driver: sizes are rounded to `MANTISSA` significant bits, which
bounds it to about 2**MANTISSA * 40 rows at any corpus size. Within a size class the heap hands its
groups out by number, and each group finds its shard from its number in the class.

A group of more than a thousandth of all rows is dealt over parts when its shard goes back to its rows.

Nulls and odd inputs: a null text has no bytes (size 1) and is grouped with empty texts; rows that
repeat an id are placed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import buckets_for, materialize, rank_in_group, release, spread_join

MANTISSA = 9


def size_class(size):
    """The size without the bits below its MANTISSA leading ones."""
    low = F.greatest(F.length(F.bin(size)) - MANTISSA, F.lit(0))
    return F.expr("shiftleft(shiftright(__bytes, __low), __low)"), low


def schedule(classes: list[tuple[int, int, float]], shards: int) -> list[tuple[int, int, int, int]]:
    """classes (key, groups, mean size), any order -> (key, first, end, shard): which numbers of a class go to which shard.

    Groups of one class are equal, so the heap's choice for all of them is the `groups` smallest values
    of the shards' arithmetic progressions load, load + size, ...; their counts are found by bisection
    and the few last ones by the heap itself.
    """
    loads = [0.0] * shards
    plan = []
    for key, groups, size in sorted(classes, key=lambda c: (-c[2], c[0])):
        take = [0] * shards
        if groups > 4 * shards:
            low, high = min(loads), max(loads) + size * groups
            for _ in range(100):
                mid = (low + high) / 2
                if sum(max(0, int((mid - x) // size)) for x in loads) <= groups:
                    low = mid
                else:
                    high = mid
            take = [max(0, int((low - x) // size)) for x in loads]
        heap = [(loads[i] + take[i] * size, i) for i in range(shards)]
        heapq.heapify(heap)
        for _ in range(groups - sum(take)):
            load, i = heap[0]
            take[i] += 1
            heapq.heapreplace(heap, (load + size, i))
        first = 0
        for i, n in enumerate(take):
            if n:
                plan.append((key, first, first + n, i))
                loads[i] += n * size
                first += n
    return plan


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard; law `bytes`."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2")),
        "shard-rows",
    )
    group = ["h1", "h2", "size"]
    groups = rows.groupBy(*group).agg((F.col("size") * F.count(F.lit(1))).alias("__bytes"))
    cls, low = size_class(F.col("__bytes"))
    groups = materialize(groups.withColumn("__low", low.cast("int")).withColumn("cls", cls).select(*group, "cls", "__bytes"), "shard-groups")
    hist = groups.groupBy("cls").agg(F.count(F.lit(1)), F.avg("__bytes")).collect()
    plan = spark.createDataFrame(schedule([tuple(r) for r in hist], shards), "cls long, first long, end long, shard int")
    ranked = rank_in_group(groups.drop("__bytes"), ["cls"], group, "n", buckets_for(groups.count()))
    n = F.col("n")
    placed = ranked.join(F.broadcast(plan), "cls").where((n >= F.col("first")) & (n < F.col("end"))).select(*group, "shard")
    counts = groups.select(*group, (F.col("__bytes") / F.col("size")).cast("long").alias("__n"))
    placed = materialize(spread_join(rows, placed, group, counts, "doc_id").select("doc_id", "size", "text_crc32", "shard"), "shard-placed")
    release(rows, groups)
    out = rank_in_group(placed, ["shard"], ["doc_id", "text_crc32"], "slot", buckets_for(placed.count()))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
