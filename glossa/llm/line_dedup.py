"""Dropping lines that many documents share (DataFrame functions only).

Each document gives its distinct line keys once, as a 96-bit hash; documents are counted per hash in
two steps, so a line that stands in every document is never gathered in one task; only the hashes over
the threshold come back to their documents, the most frequent in several parts each; documents keep
their other lines in place.

Nulls and odd inputs: null and empty texts are one empty line; rows with a null id are neither counted
nor changed; rows that repeat an id count as one document; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import SPACE, lower_ascii, materialize, spread_join

_DROPS = "array<struct<h1:bigint,h2:int>>"
FEW = 16


def line_key(line: Column) -> Column:
    return F.btrim(lower_ascii(line), F.lit(SPACE))


def _fingerprint(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))


def common_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(id, drops): for each document the fingerprints of the lines it loses."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    keys = F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= min_chars)  # distinct as texts, which are hashed; structs are compared one by one
    seen = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__glossa_id"), F.explode(F.transform(F.array_distinct(keys), _fingerprint)).alias("k")).select("__glossa_id", "k.h1", "k.h2")
    seen = materialize(seen.distinct(), "line-keys")  # read twice: to count, and to bring the counts back
    counted = seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("__n"), F.max("__glossa_id").alias("keeper")).where(F.col("__n") >= min_docs)
    counted = materialize(counted, "line-counts")
    lost = spread_join(seen, counted.drop("__n"), ["h1", "h2"], counted.drop("keeper"), "__glossa_id").where(F.col("__glossa_id") != F.col("keeper"))
    return lost.groupBy("__glossa_id").agg(F.sort_array(F.collect_set(F.struct("h1", "h2"))).alias("__glossa_drops"))


def _holds(drops: Column, x: Column) -> Column:
    """Whether sorted drops hold x: by a scan if they are few, else by bisection."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(drops) + 1)).cast("int"))
    ends = F.struct(F.lit(0).alias("low"), F.size(drops).alias("high"))

    def halve(e: Column, _: Column) -> Column:
        mid = F.shiftright(e["low"] + e["high"], 1)
        right = F.get(drops, mid) < x
        return F.struct(F.when(right, mid + 1).otherwise(e["low"]).alias("low"), F.when(right, e["high"]).otherwise(mid).alias("high"))

    found = F.aggregate(steps, ends, halve, lambda e: F.coalesce(F.get(drops, e["low"]) == x, F.lit(False)))
    return F.when(F.size(drops) > FEW, found).otherwise(F.array_contains(drops, x))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All columns of `docs`, the text without its common lines, and n_lines and n_dropped (replacing columns of those names).

    A key is the line, stripped of ASCII white space and with A-Z lower-cased. Keys of at least
    `min_chars` code points found in at least `min_docs` documents lose all their lines except in the
    document with the largest id that holds them.
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*rest)
    drops = common_lines(docs, id_col, text_col, min_chars, min_docs)
    known = docs.where(F.col(id_col).isNotNull()).join(drops, F.col(id_col) == F.col("__glossa_id"), "left").drop("__glossa_id")
    every = known.unionByName(docs.where(F.col(id_col).isNull()).withColumn("__glossa_drops", F.lit(None).cast(_DROPS)))
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    keyed = F.transform(lines, lambda x: F.struct(x.alias("line"), line_key(x).alias("key")))
    kept = F.filter(keyed, lambda x: ~((F.length(x["key"]) >= min_chars) & _holds(F.col("__glossa_drops"), _fingerprint(x["key"]))))
    kept = F.transform(kept, lambda x: x["line"])
    every = every.withColumn("__glossa_kept", F.when(F.col("__glossa_drops").isNotNull(), kept))
    n_lines = F.size(lines).cast("long")
    text = F.when(F.col("__glossa_kept").isNotNull(), F.array_join("__glossa_kept", "\n")).otherwise(F.col(text_col)).alias(text_col)
    dropped = F.when(F.col("__glossa_kept").isNotNull(), n_lines - F.size("__glossa_kept")).otherwise(F.lit(0)).cast("long")
    return every.select(*[text if c == text_col else F.col(c) for c in rest], n_lines.alias("n_lines"), dropped.alias("n_dropped"))
