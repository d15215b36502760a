"""Mining tokens that tell languages apart: relative frequency, TF-IDF and Gini concentration, all relational."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.sample import prefix_sums

COLUMNS = ["Substring", "BestLanguage", "BestFreq", "RestMean", "Ratio", "Gini", "LangCount", "RestCount", "TfIdf", "TfIdfRatio"]


def mine_tokens(df: DataFrame, text_col: str = "Snippet", label_col: str = "Language", min_count: int = 3) -> DataFrame:
    """One row per token found at least `min_count` times; documents without any token don't count. Null labels or texts raise."""
    checked = F.when(F.col(label_col).isNull() | F.col(text_col).isNull(), F.raise_error(F.lit("null label or text"))).otherwise(F.col(label_col))
    docs = df.select(checked.cast("string").alias("lang"), F.length(text_col).alias("chars"), T.word_tokens(F.col(text_col)).alias("words"))
    docs = docs.where(F.size("words") > 0)
    totals = docs.groupBy("lang").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("docs"))
    # A row is a document, so a token's document frequency comes from the row's distinct tokens and nothing is counted by document.
    share = 1 / F.size("words")
    each = F.transform("words", lambda w: F.struct(w.alias("token"), F.lit(1).alias("n"), share.alias("tf"), F.lit(0).alias("df")))
    once = F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("token"), F.lit(0).alias("n"), F.lit(0.0).alias("tf"), F.lit(1).alias("df")))
    tokens = docs.select("lang", F.inline(F.concat(each, once)))
    counts = tokens.groupBy("token", "lang").agg(F.sum("n").alias("n"), F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    joined = counts.join(totals, "lang")
    stats = joined.groupBy("token").agg(
        F.sum("n").alias("total"), F.sum("df").alias("df"),
        F.sort_array(F.collect_list(F.struct((F.col("n") / F.col("chars")).alias("freq"), F.col("lang"), F.col("n"), (F.col("tf") / F.col("docs")).alias("tfd")))).alias("langs"),
    ).where(F.col("total") >= min_count)
    all_langs = totals.agg(F.count(F.lit(1)).alias("k"), F.sum("docs").alias("all_docs"))
    stats = stats.crossJoin(F.broadcast(all_langs))  # one row
    total_freq = F.aggregate("langs", F.lit(0.0), lambda a, x: a + x["freq"])
    # The best language is the first of those with the greatest frequency.
    best = F.aggregate("langs", F.element_at("langs", 1), lambda a, x: F.when(x["freq"] > a["freq"], x).otherwise(a))
    stats = stats.withColumn("best", best).withColumn("sum_freq", total_freq)
    absent = F.col("k") - F.size("langs")  # languages without the token have frequency 0 and come first in the sorted order
    cumulative = F.aggregate("langs", F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("all")), lambda a, x: F.struct((a["run"] + x["freq"]).alias("run"), (a["all"] + a["run"] + x["freq"]).alias("all")), lambda a: a["all"])
    k, others = F.col("k"), F.greatest(F.col("k") - 1, F.lit(1))
    gini = F.when(F.col("sum_freq") > 0, (k + 1 - 2 * cumulative / F.col("sum_freq")) / k * F.log1p("sum_freq")).otherwise(F.lit(0.0))
    idf = F.log((1 + F.col("all_docs")) / (1 + F.col("df"))) + 1.0
    sum_tfidf = F.aggregate("langs", F.lit(0.0), lambda a, x: a + x["tfd"]) * idf
    rest_mean = F.when(k > 1, (F.col("sum_freq") - F.col("best.freq")) / others).otherwise(F.lit(0.0))
    tfidf = F.col("best.tfd") * idf
    rest_tfidf = F.when(k > 1, (sum_tfidf - tfidf) / others).otherwise(F.lit(0.0))
    return stats.where(absent >= 0).select(
        F.col("token").alias("Substring"), F.col("best.lang").alias("BestLanguage"), F.col("best.freq").alias("BestFreq"), rest_mean.alias("RestMean"),
        (F.col("best.freq") / (rest_mean + 1e-12)).alias("Ratio"), gini.alias("Gini"), F.col("best.n").alias("LangCount"), (F.col("total") - F.col("best.n")).alias("RestCount"),
        tfidf.alias("TfIdf"), (tfidf / (rest_tfidf + 1e-12)).alias("TfIdfRatio"),
    )


def top_tokens(mined: DataFrame, k: int = 186) -> DataFrame:
    """The k tokens of the greatest TF-IDF ratio, then ratio, then Gini; compared to nine places, so that the order of additions doesn't decide."""
    place = lambda c: F.desc(F.round(F.log10(c), 9))
    return mined.orderBy(place("TfIdfRatio"), place("Ratio"), F.desc(F.round("Gini", 9)), "Substring").limit(k)


def gini_of(df: DataFrame, value_col: str) -> DataFrame:
    """Gini concentration of a column, by a running sum over its distinct values; one row.

    A value that occurs c times after a running sum of b adds c * b + v * c * (c + 1) / 2 to the sum of running sums.
    """
    values = df.groupBy(F.col(value_col).alias("v")).agg(F.count(F.lit(1)).alias("c")).where(F.col("v").isNotNull())
    before = prefix_sums(values.withColumn("vc", F.col("v") * F.col("c")), "v", ["vc"])
    sums = before.agg(F.sum("c").alias("n"), F.sum("vc").alias("t"), F.sum(F.col("c") * F.col("__before_vc") + F.col("v") * F.col("c") * (F.col("c") + 1) / 2).alias("s"))
    return sums.select(F.when(F.col("t") != 0, (F.col("n") + 1 - 2 * F.col("s") / F.col("t")) / F.col("n")).otherwise(F.lit(0.0)).alias("gini"))
