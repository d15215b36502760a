"""Removing embedded languages, cutting files into line chunks, and filtering junk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators.sample import numbered

FENCE = "```"
#: Languages left out before chunking, and the limits of the junk filter.
SKIPPED = ["Text", "Less", "SCSS", "Diff"]
MIN_CHARS, MAX_CHARS, MAX_LINES, LETTERS, PUNCTUATION, MAX_DIGITS = 75, 50_000, 100, (0.01, 0.9), (0.01, 0.4), 0.5


def empty_fences(text: Column) -> Column:
    return F.regexp_replace(text, f"(?s){FENCE}.*?{FENCE}", FENCE * 2)


def odd_fences(text: Column) -> Column:
    return T.count_substring(text, FENCE) % 2 != 0


def _opener(tag: str) -> str:
    return rf"<{tag}(?![\p{{L}}\p{{N}}])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"


def strip_tag(text: Column, tag: str) -> Column:
    """Delete what stands between <tag ...> and </tag>, keeping both; quoted > don't end the opener."""
    return F.regexp_replace(text, rf"(?is)({_opener(tag)}).*?(</{tag}>)", "$1$2")


def strip_tag_compat(text: Column, tag: str) -> Column:
    """strip_tag, but with what stands before a look-alike tag (<scripts>) lost, and its first letters too, as in models' old training data."""
    before = rf"(?:(?!<{tag})(?s:.))*+"
    return F.regexp_replace(text, rf"(?i)({before}{_opener(tag)})(?s:.*?)(</{tag}>)|{before}<{tag}(?=[\p{{L}}\p{{N}}])", "$1$2")


def unclosed_tag(text: Column, tag: str) -> Column:
    """Whether an opener stays once all pairs are gone."""
    rest = F.regexp_replace(text, rf"(?is){_opener(tag)}.*?</{tag}>", "")
    return rest.rlike(rf"(?i)<{tag}(?![\p{{L}}\p{{N}}])")


def drop_html(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)<html\b.*?>.*?</html>", "")


def remove_sub_languages(df: DataFrame, text_col: str = "Snippet", label_col: str = "Language", mode: str = "quarantine", compat: bool = False) -> DataFrame:
    """Clean the text by its label. Malformed files get their reason in `error` and keep their text, or with mode `fail` end the job.

    With `compat`, texts before look-alike tags are lost (strip_tag_compat).
    """
    t, label, strip = F.col(text_col), F.col(label_col), strip_tag_compat if compat else strip_tag
    markup = label.isin("PHP", "HTML")
    clean = F.when(label == "Markdown", empty_fences(t)).when(label == "SQL", drop_html(t)).when(markup, strip(strip(t, "script"), "style")).otherwise(t)
    error = (
        F.when((label == "Markdown") & odd_fences(t), F.lit("uneven code fences"))
        .when(markup & unclosed_tag(t, "script"), F.lit("unclosed script"))
        .when(markup & unclosed_tag(strip_tag(t, "script"), "style"), F.lit("unclosed style"))
    )
    out = df.withColumn("error", error).withColumn(text_col, F.when(error.isNull(), clean).otherwise(t))
    if mode == "fail":
        checked = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col(text_col))
        return out.withColumn(text_col, checked.cast("string")).drop("error")
    return out


def keep_labels(df: DataFrame, skipped: list[str] = SKIPPED, label_col: str = "Language") -> DataFrame:
    """Rows whose label is not among the skipped; rows without a label stay."""
    return df.where(F.col(label_col).isNull() | ~F.col(label_col).isin(skipped))


def chunks(text: Column, limit: int = 10) -> Column:
    """Chunks of `limit` non-blank lines; the last two are always joined, so the last has up to twice as many.

    One possessive expression takes `limit` times blank lines and a non-blank one; what it can't take is the rest.
    """
    even = F.regexp_replace(F.regexp_replace(text, T.LINE_END, "\n"), r"\n\z", "")
    parts = F.regexp_extract_all(F.concat(even, F.lit("\n")), F.lit(rf"((?:[{T.SPACES}]*+[^{T.SPACES}][^\n]*+\n){{{limit}}}|(?s:.+))"), F.lit(1))
    lines = F.transform(parts, lambda p: F.regexp_replace(p, r"\n\z", ""))
    n = F.size(lines)
    joined = F.concat(F.slice(lines, 1, F.greatest(n - 2, F.lit(0))), F.array(F.concat(F.element_at(lines, -2), F.lit("\n"), F.element_at(lines, -1))))
    return F.when(n >= 2, joined).when(n == 1, lines).otherwise(F.array(F.lit("")))


def chunk_metrics(text: Column) -> Column:
    """Struct of character and line counts and of the shares of letters, digits, white space, punctuation and alphanumerics."""
    total = F.length(text)
    letters, digits, space = T.count_chars(text, r"\p{L}"), T.count_chars(text, T.DIGIT), T.count_chars(text, T.SPACES)
    lines = T.split_lines(text)
    share = lambda n: F.when(total > 0, n / total).otherwise(F.lit(0.0))
    return F.struct(
        total.alias("total_chars"), F.size(lines).alias("line_count"), F.size(F.filter(lines, lambda x: x.rlike(f"[^{T.SPACES}]"))).alias("non_empty_lines"),
        share(letters).alias("letter_ratio"), share(digits).alias("digit_ratio"), share(space).alias("whitespace_ratio"), share(total - letters - digits - space).alias("punct_ratio"),
        share(T.count_chars(text, r"\p{L}\p{N}")).alias("alnum_ratio"),
    )


def is_junk(m: Column) -> Column:
    return (
        (m["total_chars"] < MIN_CHARS) | (m["total_chars"] > MAX_CHARS) | (m["line_count"] > MAX_LINES) | (m["letter_ratio"] < LETTERS[0]) | (m["letter_ratio"] > LETTERS[1])
        | (m["punct_ratio"] < PUNCTUATION[0]) | (m["punct_ratio"] > PUNCTUATION[1]) | (m["digit_ratio"] > MAX_DIGITS)
    )


def digit_heavy(m: Column) -> Column:
    return m["digit_ratio"] > 0.9


def split_snippets(df: DataFrame, limit: int = 10, id_col: str = "Id", text_col: str = "Snippet", label_col: str = "Language", keep_junk: bool = False) -> DataFrame:
    """(FileId, Language, chunk_id, Snippet) of all chunks that aren't junk; rows with a null text are left out."""
    out = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("FileId"), F.col(label_col).alias("Language"), F.posexplode(chunks(F.col(text_col), limit)).alias("chunk_id", "Snippet"))
    return out if keep_junk else out.where(~F.exists(F.array(chunk_metrics(F.col("Snippet"))), is_junk))  # the counts once, not for each bound


def rebalance(df: DataFrame, label_col: str = "Language", id_cols: tuple[str, ...] = ("FileId", "chunk_id"), most: float = 2.0, seed: str = "0") -> DataFrame:
    """Thin out the largest class to the size of the second if it is more than `most` times as large, by hash of the ids."""
    top = df.groupBy(label_col).count().orderBy(F.desc("count"), F.asc_nulls_last(label_col)).limit(2).collect()
    if len(top) < 2 or top[0]["count"] <= most * top[1]["count"]:
        return df
    largest = F.col(label_col).eqNullSafe(F.lit(top[0][label_col]))
    order = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in id_cols]).cast("binary"))
    thinned = numbered(df.where(largest), [label_col], order, list(id_cols)).where(F.col("__i") <= top[1]["count"]).drop("__i", "__n")
    return thinned.unionByName(df.where(~largest))


def running_chunks(df: DataFrame, limit: int, id_col: str, text_col: str) -> DataFrame:
    """The chunks by a running count over exploded lines: the window form of `chunks`, for files too long for one row."""
    lines = df.select(id_col, F.posexplode(T.split_lines(F.col(text_col))).alias("pos", "line"))
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    full = lines.withColumn("c", F.floor(F.coalesce(F.sum(F.col("line").rlike(f"[^{T.SPACES}]").cast("int")).over(before), F.lit(0)) / limit))
    last = F.greatest(F.max("c").over(Window.partitionBy(id_col)) - 1, F.lit(0))
    rows = full.withColumn("chunk_id", F.least("c", last)).groupBy(id_col, "chunk_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("x"))
    return rows.select(id_col, F.col("chunk_id").cast("int").alias("chunk_id"), F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("Snippet"))
