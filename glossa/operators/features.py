"""Feature extraction: presence, frequency, words and n-grams of a vocabulary."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.sample import prefix_sums


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: inside a lambda, a plain column would be computed anew for each element."""
    return F.transform(F.array(value), use)[0]


def active(text: Column, tokens: list[str], normalize: bool = True) -> Column:
    """Indices of the tokens that occur in the text, case-sensitive; null gives none."""
    text = F.coalesce(T.normalize_newlines(text) if normalize else text, F.lit(""))
    vocabulary = F.from_json(F.lit(json.dumps(tokens)), "array<string>")
    return bound(text, lambda t: F.filter(F.transform(vocabulary, lambda x, i: F.when(F.contains(t, x), i)), lambda i: i.isNotNull()))


def active_arrow(text: Column, tokens: list[str], normalize: bool = True) -> Column:
    """The same by Arrow batches."""

    def find(texts: pd.Series) -> pd.Series:
        clean = texts.fillna("")
        if normalize:
            clean = clean.str.replace("\r\n", "\n", regex=False).str.replace("\r", "\n", regex=False)
        return pd.Series([[i for i, t in enumerate(tokens) if t in s] for s in clean], dtype=object)

    return F.pandas_udf(find, "array<int>")(text)


def with_features(df: DataFrame, tokens: list[str], text_col: str = "Snippet", engine: str = "native", normalize: bool = True) -> DataFrame:
    """Add `active`, the sorted indices of the tokens that occur."""
    make = {"native": active, "arrow": active_arrow}[engine]
    return df.withColumn("active", make(F.col(text_col), tokens, normalize))


def presence(active_col: str, size: int) -> Column:
    """Indices as an array of booleans, one for each token."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(F.col(active_col), i))


def indicator_vectors(df: DataFrame, active_col: str, size: int, output_col: str = "features") -> DataFrame:
    """Add a sparse vector with 1 at the indices."""
    names = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], "__glossa_names", output_col, binary=True)
    return names.transform(df.withColumn("__glossa_names", F.col(active_col).cast("array<string>"))).drop("__glossa_names")


def token_frequency(text: Column, tokens: list[str]) -> Column:
    """Occurrences of each token by length of the text; 0 for an empty text."""
    n = F.length(text)
    return F.array(*[F.when(n > 0, T.count_substring(text, t) / n).otherwise(F.lit(0.0)) for t in tokens])


def _terms(text: Column) -> Column:
    """Lower-cased words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{T.WORD_CHAR}]{{2,}})"), F.lit(1))


def counted(terms: Column) -> Column:
    """Struct array of the distinct terms of an array, in order, and their counts, without a shuffle."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return bound(starts, lambda b: F.transform(b, lambda x, k: F.struct(F.get(s, x).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - x).cast("long").alias("n"))))

    return bound(F.array_sort(terms), lambda s: F.when(F.size(s) > 0, runs(s)))


def bag_of_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, n): the terms of each row and their counts; a row is a document."""
    return df.select(id_col, F.inline(counted(_terms(F.col(text_col)))))


def term_vocabulary(df: DataFrame, text_col: str, min_docs: int = 1) -> DataFrame:
    """(idx, term): the terms of at least min_docs rows in code-point order, numbered from 0 by range partitions."""
    terms = df.select(F.explode(F.array_distinct(_terms(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_docs)
    return prefix_sums(terms.select("term", F.lit(1).alias("one")), "term", ["one"]).select(F.col("__before_one").cast("long").alias("idx"), "term")


def bag_vectors(df: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, indices, counts): each row's terms as a sparse vector over the vocabulary; rows without known terms have none. Ids must be distinct."""
    known = bag_of_words(df, id_col, text_col).join(vocabulary, "term").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", "n"))).alias("__v"))
    out = df.select(id_col).join(known, id_col, "left")
    at = lambda name, kind: F.coalesce(F.col(f"__v.{name}"), F.array().cast(f"array<{kind}>"))
    return out.select(id_col, at("idx", "long").alias("indices"), at("n", "long").alias("counts"))


def mixed_matrix(df: DataFrame, tokens: list[str], text_col: str, short: int = 4) -> DataFrame:
    """Add `active`: longer tokens count as whole words, shorter ones as substrings."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_distinct(T.word_tokens(text, 0))
    tests = [F.when(F.array_contains(words, t) if len(t) > short else F.contains(text, F.lit(t)), F.lit(i)) for i, t in enumerate(tokens)]
    return df.withColumn("active", F.array_compact(F.array(*tests)))


def feature_fingerprint(df: DataFrame, tokens: list[str], text_col: str, label_col: str) -> str:
    """Twelve hex digits that change with the rows, their texts and labels, and the vocabulary."""
    rows = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(text_col).cast("decimal(38,0)")).alias("h"))
    parts = rows.select(F.concat_ws("|", F.coalesce(label_col, F.lit("")), "n", F.col("h").cast("string")).alias("x")).agg(F.array_join(F.sort_array(F.collect_list("x")), "\n").alias("x"))
    return parts.select(F.sha2(F.concat(F.lit("\n".join(tokens) + "\0"), "x"), 256)).first()[0][:12]
