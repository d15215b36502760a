"""The engine's queries over the driver's tables: documents stand for source files, lang for their language."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import rules, vocab
from glossa.functions import text as T
from glossa.operators import analyze, checks, clean, features, metrics, mining, sample, train
from glossa.operators.model import LinearModel, add_at, constant, encode, explain, predict
from glossa.plans.queries import query
from glossa.sources.scratch import materialize

VOCAB = vocab.vocabulary()
#: Tokens and labels of a fixed model, whose weights are eighths so that every engine adds them without rounding.
TOKENS = [" the ", " und ", " de ", " la ", "tion", "ing ", "en ", "ß", "é", "ó", "que", ".\n"]
CLASSES = ["de", "en", "es", "fr"]
MODEL = LinearModel(TOKENS, CLASSES, np.array([[((7 * c + 5 * i) % 13 - 6) / 8 for i in range(len(TOKENS))] for c in range(len(CLASSES))]), np.array([0.25, 0.5, -0.125, 0.0]))
LABELS = {"en": "English", "de": "German", "fr": "French"}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under the engine's column names; an input of fewer partitions than cores is dealt out, as the work per byte is high."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores)
    return docs.select(F.col("doc_id").alias("FileId"), F.col("lang").alias("Language"), F.col("text").alias("Snippet"))


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    show = lambda v: lit(v) if isinstance(v, str) else f"({v})::DOUBLE" if isinstance(v, float) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({names})"


_VOCAB_SQL = values(list(enumerate(VOCAB)), "idx, token")
_TOKENS_SQL = values(list(enumerate(TOKENS)), "idx, token")
_WEIGHTS_SQL = values([(c, name, i, float(MODEL.coef[c, i])) for c, name in enumerate(CLASSES) for i in range(len(TOKENS))], "c, name, idx, w")
_BIAS_SQL = values([(c, name, float(b)) for c, (name, b) in enumerate(zip(CLASSES, MODEL.intercept.tolist(), strict=True))], "c, name, b")


@query(f"""
WITH v AS (SELECT * FROM {_VOCAB_SQL}), sizes AS (SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY lang),
hits AS (SELECT lang, idx, count(*)::BIGINT AS m FROM documents, v WHERE contains(text, token) GROUP BY lang, idx)
SELECT s.lang AS "Language", v.idx, coalesce(m, 0)::BIGINT AS "NMatches", n AS "NSamples", coalesce(m, 0) / n::DOUBLE AS "Occurrence"
FROM sizes s CROSS JOIN v LEFT JOIN hits h ON h.lang = s.lang AND h.idx = v.idx""")
def token_stats(spark, sf_dir):
    return metrics.token_stats(features.with_features(files(spark, sf_dir), VOCAB, engine="arrow"), VOCAB)


@query("SELECT lang AS \"Language\", count(*)::BIGINT AS \"count\" FROM documents GROUP BY lang")
def lang_counts(spark, sf_dir):
    return files(spark, sf_dir).groupBy("Language").count().orderBy("Language")


@query("WITH c AS (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) AS i FROM documents GROUP BY lang) SELECT max(n) FILTER (WHERE i = 1) / (max(n) FILTER (WHERE i = 2))::DOUBLE AS ratio FROM c WHERE i <= 2")
def dominant_ratio(spark, sf_dir):
    top = files(spark, sf_dir).groupBy("Language").count().orderBy(F.desc("count"), "Language").limit(2)
    return top.agg((F.max("count") / F.min("count")).alias("ratio"))


@query("SELECT round(avg(length(text)), 6) AS mean_len, count(DISTINCT lang)::BIGINT AS n_labels FROM documents")
def mean_len(spark, sf_dir):
    return files(spark, sf_dir).agg(F.round(F.avg(F.length("Snippet")), 6).alias("mean_len"), F.count_distinct("Language").alias("n_labels"))


@query("SELECT sum(CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END)::BIGINT AS loc FROM documents")
def loc_total(spark, sf_dir):
    return files(spark, sf_dir).agg(F.sum(F.size(T.split_lines(F.col("Snippet"))).cast("long")).alias("loc"))


@query("SELECT doc_id AS \"FileId\", lang AS \"Language\" FROM documents WHERE lang IN ('en', 'fr')")
def isin_filter(spark, sf_dir):
    return files(spark, sf_dir).where(F.col("Language").isin("en", "fr")).select("FileId", "Language")


@query("SELECT doc_id AS \"FileId\", lang AS \"Language\" FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'fr')")
def not_isin_filter(spark, sf_dir):
    return clean.keep_labels(files(spark, sf_dir), ["en", "fr"]).select("FileId", "Language")


@query("SELECT doc_id AS \"FileId\", CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' END AS name FROM documents")
def label_remap(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return files(spark, sf_dir).select("FileId", F.element_at(names, F.col("Language")).alias("name"))


@query("SELECT doc_id AS \"FileId\", md5(regexp_replace(replace(text, '. ', chr(13) || chr(10)), '\\r\\n?', chr(10), 'g')) AS h FROM documents")
def newline_normalize(spark, sf_dir):
    text = T.normalize_newlines(F.replace("Snippet", F.lit(". "), F.lit("\r\n")))
    return files(spark, sf_dir).select("FileId", F.md5(text.cast("binary")).alias("h"))


@query("SELECT doc_id AS \"FileId\", md5(regexp_replace(replace(text, '. ', '```'), '(?s)```.*?```', '``````', 'g')) AS h, (length(replace(text, '. ', '```')) - length(replace(replace(text, '. ', '```'), '```', ''))) // 3 % 2 <> 0 AS odd FROM documents")
def fence_empty(spark, sf_dir):
    text = F.replace("Snippet", F.lit(". "), F.lit("```"))
    return files(spark, sf_dir).select("FileId", F.md5(clean.empty_fences(text).cast("binary")).alias("h"), clean.odd_fences(text).alias("odd"))


_STRIP = r"""(?is)(<TAG(?:(?:[^\p{L}\p{N}>"'']|"[^"]*"|''[^'']*'')(?:[^>"'']|"[^"]*"|''[^'']*'')*)?>).*?(</TAG>)"""


@query(f"SELECT page_id, md5(regexp_replace(regexp_replace(html, '{_STRIP.replace('TAG', 'script')}', '\\1\\2', 'g'), '{_STRIP.replace('TAG', 'style')}', '\\1\\2', 'g')) AS h FROM pages")
def strip_script(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.md5(clean.strip_tag(clean.strip_tag(F.col("html"), "script"), "style").cast("binary")).alias("h"))


def _chunks_sql(limit: int) -> str:
    return f"""
l AS (SELECT doc_id, lang, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS pos FROM documents),
b AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(line, '[^\\s]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {limit} AS c FROM l),
m AS (SELECT *, least(c, greatest(max(c) OVER (PARTITION BY doc_id) - 1, 0)) AS k FROM b),
chunks AS (SELECT doc_id, lang, k::INT AS chunk_id, string_agg(line, chr(10) ORDER BY pos) AS chunk FROM m GROUP BY doc_id, lang, k)"""


def _chunk_query(limit: int):
    @query(f"WITH {_chunks_sql(limit)} SELECT doc_id AS \"FileId\", chunk_id, md5(chunk) AS h FROM chunks", name=f"chunk{limit}")
    def chunk(spark, sf_dir):
        return clean.split_snippets(files(spark, sf_dir), limit, "FileId", keep_junk=True).select("FileId", "chunk_id", F.md5(F.col("Snippet").cast("binary")).alias("h"))


_chunk_query(10)
_chunk_query(20)


@query(f"WITH {_chunks_sql(3)} SELECT doc_id AS \"FileId\", chunk_id, md5(chunk) AS h FROM chunks")
def chunk_running(spark, sf_dir):
    rows = clean.running_chunks(files(spark, sf_dir), 3, "FileId", "Snippet")
    return rows.select("FileId", "chunk_id", F.md5(F.col("Snippet").cast("binary")).alias("h"))


_METRICS_SQL = r"""
SELECT *, length(chunk) AS total, length(regexp_replace(chunk, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(chunk, '[^\p{Nd}²³¹]', '', 'g')) AS digits,
  length(regexp_replace(chunk, '[^\s\x0b]', '', 'g')) AS spaces, length(regexp_replace(chunk, '[^\p{L}\p{N}]', '', 'g')) AS alnums,
  CASE WHEN chunk = '' THEN 0 ELSE len(string_split(regexp_replace(chunk, '\n$', ''), chr(10))) END AS lines FROM chunks"""


@query(f"WITH {_chunks_sql(10)}, m2 AS ({_METRICS_SQL}) SELECT doc_id AS \"FileId\", chunk_id, total::INT AS total_chars, lines::INT AS line_count, round(letters / total::DOUBLE, 6) AS letter_ratio, round(digits / total::DOUBLE, 6) AS digit_ratio, round(spaces / total::DOUBLE, 6) AS whitespace_ratio, round((total - letters - digits - spaces) / total::DOUBLE, 6) AS punct_ratio, round(alnums / total::DOUBLE, 6) AS alnum_ratio FROM m2")
def chunk_metrics(spark, sf_dir):
    rows = clean.split_snippets(files(spark, sf_dir), 10, "FileId", keep_junk=True).withColumn("m", clean.chunk_metrics(F.col("Snippet")))
    shares = [F.round(f"m.{k}_ratio", 6).alias(f"{k}_ratio") for k in ("letter", "digit", "whitespace", "punct", "alnum")]
    return rows.select("FileId", "chunk_id", "m.total_chars", "m.line_count", *shares)


_JUNK_SQL = "total < 75 OR total > 50000 OR lines > 100 OR letters / total::DOUBLE < 0.01 OR letters / total::DOUBLE > 0.9 OR (total - letters - digits - spaces) / total::DOUBLE < 0.01 OR (total - letters - digits - spaces) / total::DOUBLE > 0.4 OR digits / total::DOUBLE > 0.5"


@query(f"WITH {_chunks_sql(10)}, m2 AS ({_METRICS_SQL}) SELECT doc_id AS \"FileId\", chunk_id FROM m2 WHERE NOT ({_JUNK_SQL})")
def junk_filter(spark, sf_dir):
    return clean.split_snippets(files(spark, sf_dir), 10, "FileId").select("FileId", "chunk_id")


@query("""
WITH c AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang NULLS LAST) AS i FROM documents GROUP BY lang),
d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0|' || doc_id::VARCHAR), doc_id) AS r FROM documents)
SELECT d.doc_id AS "FileId", d.lang AS "Language" FROM d JOIN c ON d.lang IS NOT DISTINCT FROM c.lang
WHERE c.i > 1 OR c.n <= 2 * (SELECT n FROM c WHERE i = 2) OR d.r <= (SELECT n FROM c WHERE i = 2)""")
def rebalance(spark, sf_dir):
    return clean.rebalance(files(spark, sf_dir), id_cols=("FileId",)).select("FileId", "Language")


@query(f"WITH v AS (SELECT * FROM {_VOCAB_SQL}) SELECT doc_id AS \"FileId\", coalesce(string_agg(idx::VARCHAR, ',' ORDER BY idx), '') AS active FROM documents LEFT JOIN v ON contains(text, token) GROUP BY doc_id")
def presence_active(spark, sf_dir):
    rows = features.with_features(files(spark, sf_dir), VOCAB)
    return rows.select("FileId", F.concat_ws(",", F.col("active").cast("array<string>")).alias("active"))


@query(f"WITH v AS (SELECT * FROM {_VOCAB_SQL}) SELECT doc_id AS \"FileId\", coalesce(string_agg(idx::VARCHAR, ',' ORDER BY idx), '') AS active FROM documents LEFT JOIN v ON contains(text, token) GROUP BY doc_id")
def presence_arrow(spark, sf_dir):
    rows = features.with_features(files(spark, sf_dir), VOCAB, engine="arrow")
    return rows.select("FileId", F.concat_ws(",", F.col("active").cast("array<string>")).alias("active"))


@query(f"WITH v AS (SELECT * FROM {_TOKENS_SQL}) SELECT doc_id AS \"FileId\", idx, round((length(text) - length(replace(text, token, ''))) / length(token)::DOUBLE / length(text), 9) AS freq FROM documents, v")
def token_freq(spark, sf_dir):
    rows = files(spark, sf_dir).select("FileId", F.posexplode(features.token_frequency(F.col("Snippet"), TOKENS)).alias("idx", "freq"))
    return rows.select("FileId", "idx", F.round("freq", 9).alias("freq"))


@query(f"SELECT doc_id AS \"FileId\", {rules.active_rules_sql()} AS active FROM documents")
def rules_active(spark, sf_dir):
    return files(spark, sf_dir).select("FileId", F.concat_ws(",", rules.active_rules(F.col("Snippet"))).alias("active"))


@query(r"""SELECT doc_id AS "FileId", regexp_matches(text, '(^|[^\p{L}\p{N}_])is($|[^\p{L}\p{N}_])') AS word, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])') AS any_case,
  regexp_matches(text, '(?m)^[\t ]*The') AS line, regexp_matches(text, '(?m)^[^#\n]*:[ \t]*(#|$)') AS colon, regexp_matches(text, '</\p{L}') AS closing, regexp_matches(text, '\$[\p{L}_]') AS dollar,
  regexp_matches(text, '[\p{L}\p{N}_]!') AS bang, regexp_matches(text, '(?m)^[\t ]*[\p{L}\p{N}_-]*[\p{L}\p{N}][\p{L}\p{N}_-]*: ') AS yaml FROM documents""")
def word_tests(spark, sf_dir):
    t = F.col("Snippet")
    return files(spark, sf_dir).select(
        "FileId", T.has_word(t, "is").alias("word"), T.has_word(F.lower(t), "the").alias("any_case"), T.line_starts_with(t, "The").alias("line"), T.has_indent_colon(t).alias("colon"),
        t.rlike(r"</\p{L}").alias("closing"), t.rlike(r"\$[\p{L}_]").alias("dollar"), t.rlike(r"[\p{L}\p{N}_]!").alias("bang"), T.yaml_key_value(t).alias("yaml"),
    )


def _early_rules(experiment: int):
    table = rules.EXPERIMENTS[experiment]

    @query(f"SELECT doc_id AS \"FileId\", {rules.active_rules_sql(rules=table)} AS active FROM documents", name=f"rules_exp{experiment}")
    def early(spark, sf_dir):
        return files(spark, sf_dir).select("FileId", F.concat_ws(",", rules.active_rules(F.col("Snippet"), table)).alias("active"))


for _k in (1, 2, 3, 5):
    _early_rules(_k)


@query(f"""SELECT doc_id AS "FileId", list_aggregate(list_filter(string_split({rules.active_rules_sql(rules=rules.EXPERIMENTS[3])}, ','), lambda x: x <> '' AND x NOT IN ({', '.join(lit(k) for k in rules.EXPERIMENTS[1])})), 'string_agg', ',') AS added FROM documents""")
def rules_added(spark, sf_dir):
    """Rules of the third experiment that hold and that the first doesn't have."""
    names = rules.rules_not_in(rules.active_rules(F.col("Snippet"), rules.EXPERIMENTS[3]), rules.EXPERIMENTS[1])
    return files(spark, sf_dir).select("FileId", F.when(F.size(names) > 0, F.concat_ws(",", names)).alias("added"))


@query(r"""SELECT doc_id AS "FileId", regexp_matches(t, '(^|[\n]) {2}[^\n]*[^\s]') AS two, regexp_matches(t, '(^|[\n]) {4}[^\n]*[^\s]') AS four FROM (SELECT doc_id, replace(text, '. ', chr(10) || '   ') AS t FROM documents)""")
def leading_indent(spark, sf_dir):
    t = F.replace("Snippet", F.lit(". "), F.lit("\n   "))
    return files(spark, sf_dir).select("FileId", T.has_leading_indent(t, 2).alias("two"), T.has_leading_indent(t, 4).alias("four"))


_RAW = """
SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'Markdown' WHEN 'de' THEN 'SQL' WHEN 'fr' THEN 'PHP' ELSE 'Go' END AS label,
  CASE lang WHEN 'en' THEN replace(text, '. ', '```') WHEN 'de' THEN replace(replace(text, ', ', '<html a>'), '. ', '</html>') WHEN 'fr' THEN replace(replace(text, ', ', '<script x>'), '. ', '</script>') ELSE text END AS t FROM documents
UNION ALL SELECT -1 - page_id, 'HTML', html FROM pages"""
_OPENER = """<TAG(?:(?:[^\\p{L}\\p{N}>"'']|"[^"]*"|''[^'']*'')(?:[^>"'']|"[^"]*"|''[^'']*'')*)?>""".replace("\\\\", "\\")


def _pair(tag: str, keep: bool) -> str:
    opener = _OPENER.replace("TAG", tag)
    return f"'(?is)({opener}).*?(</{tag}>)', '\\1\\2', 'g'" if keep else f"'(?is){opener}.*?</{tag}>', '', 'g'"


_NO_SCRIPT = f"regexp_replace(t, {_pair('script', True)})"
_OPEN = "regexp_matches(regexp_replace({}, {}), '(?i)<{}([^\\p{{L}}\\p{{N}}]|$)')"


@query(f"""WITH raw AS ({_RAW}), judged AS (SELECT *, CASE
  WHEN label = 'Markdown' AND (length(t) - length(replace(t, '```', ''))) // 3 % 2 <> 0 THEN 'uneven code fences'
  WHEN label IN ('PHP', 'HTML') AND {_OPEN.format('t', _pair('script', False), 'script')} THEN 'unclosed script'
  WHEN label IN ('PHP', 'HTML') AND {_OPEN.format(_NO_SCRIPT, _pair('style', False), 'style')} THEN 'unclosed style' END AS error FROM raw)
SELECT id AS "Id", label AS "Language", error, md5(CASE WHEN error IS NOT NULL THEN t WHEN label = 'Markdown' THEN regexp_replace(t, '(?s)```.*?```', '``````', 'g')
  WHEN label = 'SQL' THEN regexp_replace(t, '(?is)<html\\b.*?>.*?</html>', '', 'g') WHEN label IN ('PHP', 'HTML') THEN regexp_replace({_NO_SCRIPT}, {_pair('style', True)}) ELSE t END) AS h FROM judged""")
def sub_languages(spark, sf_dir):
    """The nested-language cleaner over documents with fences, tags and markup put in, and over pages."""
    t, put = F.col("Snippet"), lambda *pairs: _replaced(F.col("Snippet"), pairs)
    label = F.when(F.col("Language") == "en", "Markdown").when(F.col("Language") == "de", "SQL").when(F.col("Language") == "fr", "PHP").otherwise("Go")
    text = F.when(F.col("Language") == "en", put((". ", "```"))).when(F.col("Language") == "de", put((", ", "<html a>"), (". ", "</html>"))).when(F.col("Language") == "fr", put((", ", "<script x>"), (". ", "</script>"))).otherwise(t)
    docs = files(spark, sf_dir).select(F.col("FileId").alias("Id"), label.alias("Language"), text.alias("Snippet"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select((-1 - F.col("page_id")).alias("Id"), F.lit("HTML").alias("Language"), F.col("html").alias("Snippet"))
    cleaned = clean.remove_sub_languages(docs.unionByName(pages))
    return cleaned.select("Id", "Language", "error", F.md5(F.col("Snippet").cast("binary")).alias("h"))


def _replaced(text, pairs):
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


@query("SELECT count(*)::BIGINT AS rows, count(*) FILTER (WHERE length(text) > 1000)::BIGINT AS hits, round(100.0::DOUBLE * count(*) FILTER (WHERE length(text) > 1000) / count(*), 9) AS percent FROM documents")
def share_of_rows(spark, sf_dir):
    return checks.share_of_rows(files(spark, sf_dir), F.length("Snippet") > 1000).withColumn("percent", F.round("percent", 9))


@query("SELECT DISTINCT lang AS value FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('en', 'fr')")
def unmapped_labels(spark, sf_dir):
    return checks.unmapped(files(spark, sf_dir), "Language", spark.createDataFrame([("en",), ("fr",)], "code string"), "code")


@query("SELECT lang AS \"Language\", printf('%.1f', avg(length(text))) AS mean_chars, CASE WHEN lang = 'en' THEN '—' ELSE '50.0%' END AS shown FROM documents GROUP BY lang")
def display_formats(spark, sf_dir):
    means = files(spark, sf_dir).groupBy("Language").agg(F.avg(F.length("Snippet")).alias("m"))
    half = F.when(F.col("Language") == "en", F.lit(float("nan"))).otherwise(F.lit(0.5))
    return means.select("Language", checks.show_number(F.col("m")).alias("mean_chars"), checks.show_percent(half).alias("shown"))


@query(f'SELECT doc_id AS "FileId", {rules.decide_sql()} AS pred FROM documents')
def regex_decision_list(spark, sf_dir):
    return files(spark, sf_dir).select("FileId", rules.decide(F.col("Snippet")).alias("pred"))


@query("WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_]+')) AS token FROM documents) SELECT token, count(*)::BIGINT AS n FROM w WHERE length(token) > 4 GROUP BY token")
def word_tokens(spark, sf_dir):
    return files(spark, sf_dir).select(F.explode(T.word_tokens(F.col("Snippet"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH g AS (SELECT unnest([text[i:i + 1] FOR i IN range(1, length(text))]) AS gram FROM documents
  UNION ALL SELECT unnest([text[i:i + 2] FOR i IN range(1, length(text) - 1)]) FROM documents UNION ALL SELECT unnest([text[i:i + 3] FOR i IN range(1, length(text) - 2)]) FROM documents)
SELECT gram, count(*)::BIGINT AS n FROM g WHERE regexp_full_match(gram, '[\x00-\x7f]*') AND NOT regexp_matches(gram, '^\s|\s$') GROUP BY gram""")
def char_ngrams(spark, sf_dir):
    return files(spark, sf_dir).select(F.explode(T.char_ngrams(F.col("Snippet"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) SELECT doc_id AS ""FileId"", term, count(*)::BIGINT AS n FROM w GROUP BY doc_id, term".replace('""', '"'))
def bow_counts(spark, sf_dir):
    return features.bag_of_words(files(spark, sf_dir), "FileId", "Snippet")


_BOW_SQL = r"""
bow AS (SELECT doc_id, lang, term, count(*) AS n FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) GROUP BY ALL),
terms AS (SELECT term, row_number() OVER (ORDER BY term COLLATE "C") - 1 AS idx FROM (SELECT DISTINCT term FROM bow))"""


@query(f"WITH {_BOW_SQL} SELECT idx::BIGINT AS idx, term FROM terms")
def bow_vocabulary(spark, sf_dir):
    return features.term_vocabulary(files(spark, sf_dir), "Snippet")


@query(f"""WITH {_BOW_SQL} SELECT d.doc_id AS "FileId", coalesce(string_agg(idx || ':' || n, ' ' ORDER BY idx), '') AS vector FROM documents d LEFT JOIN bow b ON b.doc_id = d.doc_id LEFT JOIN terms t ON t.term = b.term GROUP BY d.doc_id""")
def bow_vectors(spark, sf_dir):
    docs = files(spark, sf_dir)
    vectors = features.bag_vectors(docs, features.term_vocabulary(docs, "Snippet"), "FileId", "Snippet")
    return vectors.select("FileId", F.array_join(F.zip_with("indices", "counts", lambda i, n: F.concat_ws(":", i.cast("string"), n.cast("string"))), " ").alias("vector"))


_BAG_NS = [50, 200, 1000]


@query(f"""WITH {_BOW_SQL}, cls AS (SELECT * FROM (VALUES (0, 'de'), (1, 'en'), (2, 'es'), (3, 'fr')) v(c, name)), ns AS (SELECT unnest({_BAG_NS}) AS n),
sn AS (SELECT ns.n, d.doc_id, d.lang, c, name, coalesce(sum(b.n * ((7 * c + 5 * idx) % 13 - 6) / 8::DOUBLE), 0) AS s FROM ns CROSS JOIN documents d CROSS JOIN cls
  LEFT JOIN (SELECT doc_id, idx, bow.n FROM bow JOIN terms ON terms.term = bow.term) b ON b.doc_id = d.doc_id AND b.idx < ns.n GROUP BY ns.n, d.doc_id, d.lang, c, name),
bn AS (SELECT n, doc_id, any_value(lang) AS lang, min_by(name, (-s, c)) AS pred FROM sn GROUP BY n, doc_id),
f AS (SELECT n, label, 2 * sum(hit) / sum(t + p)::DOUBLE AS f1 FROM (SELECT n, lang AS label, 1 AS t, 0 AS p, CASE WHEN lang = pred THEN 1 ELSE 0 END AS hit FROM bn UNION ALL SELECT n, pred, 0, 1, 0 FROM bn) GROUP BY n, label)
SELECT n AS "N", round(avg(f1), 9) AS "F1" FROM f GROUP BY n""")
def bow_curve_fixed(spark, sf_dir):
    docs = files(spark, sf_dir)
    terms = materialize(features.term_vocabulary(docs, "Snippet"), "bow-terms")
    vectors = features.bag_vectors(docs, terms, "FileId", "Snippet").join(docs.select("FileId", "Language"), "FileId")
    weights = terms.select("idx", F.explode(F.sequence(F.lit(0), F.lit(len(CLASSES) - 1))).alias("c")).withColumn("w", ((7 * F.col("c") + 5 * F.col("idx")) % 13 - 6) / 8)
    return analyze.bag_curve(vectors, weights, CLASSES, _BAG_NS, "Language", "FileId").select("N", F.round("F1", 9).alias("F1"))


_MINE_SQL = """
w AS (SELECT doc_id, lang, length(text) AS chars, list_filter(regexp_extract_all(text, '[A-Za-z_]+'), lambda x: length(x) > 4) AS words FROM documents),
d AS (SELECT * FROM w WHERE len(words) > 0), tot AS (SELECT lang, sum(chars) AS chars, count(*) AS docs FROM d GROUP BY lang),
pd AS (SELECT doc_id, lang, len(words) AS size, unnest(words) AS token FROM d), pt AS (SELECT doc_id, lang, size, token, count(*) AS n FROM pd GROUP BY ALL),
c AS (SELECT token, lang, sum(n) AS n, sum(n / size::DOUBLE) AS tf, count(*) AS df FROM pt GROUP BY token, lang),
g AS (SELECT token, sum(n) AS total, sum(df) AS df FROM c GROUP BY token HAVING sum(n) >= 3),
f AS (SELECT g.token, g.total, g.df, t.lang, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / t.chars::DOUBLE AS freq, coalesce(c.tf, 0) / t.docs * (ln((1 + (SELECT sum(docs) FROM tot)) / (1 + g.df)::DOUBLE) + 1) AS tfidf
  FROM g CROSS JOIN tot t LEFT JOIN c ON c.token = g.token AND c.lang = t.lang),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY freq DESC, lang) AS best, sum(freq) OVER (PARTITION BY token ORDER BY freq ROWS UNBOUNDED PRECEDING) AS run FROM f),
s AS (SELECT token, count(*) AS k, sum(freq) AS sf, sum(tfidf) AS st, sum(run) AS sr, max(lang) FILTER (WHERE best = 1) AS bl, max(freq) AS bf, max(n) FILTER (WHERE best = 1) AS bn, max(tfidf) FILTER (WHERE best = 1) AS bt, max(total) AS total FROM r GROUP BY token),
mined AS (SELECT token AS "Substring", bl AS "BestLanguage", bf AS "BestFreq", (sf - bf) / greatest(k - 1, 1) AS "RestMean", bf / ((sf - bf) / greatest(k - 1, 1) + 1e-12) AS "Ratio", (k + 1 - 2 * sr / sf) / k * ln(1 + sf) AS "Gini",
  bn::BIGINT AS "LangCount", (total - bn)::BIGINT AS "RestCount", bt AS "TfIdf", bt / ((st - bt) / greatest(k - 1, 1) + 1e-12) AS "TfIdfRatio" FROM s)"""


@query(f'WITH {_MINE_SQL} SELECT "Substring", "BestLanguage", round("BestFreq", 9) AS "BestFreq", round("RestMean", 9) AS "RestMean", round("Gini", 9) AS "Gini", "LangCount", "RestCount", round("TfIdf", 9) AS "TfIdf" FROM mined')
def mine_tokens(spark, sf_dir):
    mined = mining.mine_tokens(files(spark, sf_dir))
    return mined.select("Substring", "BestLanguage", *[F.round(c, 9).alias(c) for c in ("BestFreq", "RestMean", "Gini")], "LangCount", "RestCount", F.round("TfIdf", 9).alias("TfIdf"))


@query(f'''WITH {_MINE_SQL} SELECT "Substring", "BestLanguage", "LangCount", "RestCount", round(log10("TfIdfRatio"), 6) AS tfidf_ratio, round(log10("Ratio"), 6) AS ratio, round("Gini", 6) AS gini
  FROM mined ORDER BY round(log10("TfIdfRatio"), 9) DESC, round(log10("Ratio"), 9) DESC, round("Gini", 9) DESC, "Substring" COLLATE "C" LIMIT 186''')
def mine_topk(spark, sf_dir):
    top = mining.top_tokens(mining.mine_tokens(files(spark, sf_dir)))
    return top.select("Substring", "BestLanguage", "LangCount", "RestCount", F.round(F.log10("TfIdfRatio"), 6).alias("tfidf_ratio"), F.round(F.log10("Ratio"), 6).alias("ratio"), F.round("Gini", 6).alias("gini"))


@query("SELECT (count(*) + 1 - 2 * sum(c) / max(c)) / count(*) AS gini FROM (SELECT length(text)::DOUBLE AS v, sum(length(text)::DOUBLE) OVER (ORDER BY length(text) ROWS UNBOUNDED PRECEDING) AS c FROM documents)".replace("SELECT (count", "SELECT round((count").replace("count(*) AS gini", "count(*), 9) AS gini"))
def length_gini(spark, sf_dir):
    return mining.gini_of(files(spark, sf_dir).select(F.length("Snippet").cast("double").alias("v")), "v").select(F.round("gini", 9).alias("gini"))


_ORDER = "row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || '{}'), doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n"


@query(f"SELECT doc_id AS \"FileId\" FROM (SELECT doc_id, {_ORDER.format(0)} FROM documents) WHERE i <= round_even(n * 0.1, 0)")
def stratified_sample(spark, sf_dir):
    return sample.stratified_sample(files(spark, sf_dir).select("FileId", "Language"), 0.1).select("FileId")


@query(f"""
WITH d AS (SELECT doc_id, lang, {_ORDER.format(42)} FROM documents), s AS (SELECT lang, count(*) AS k, sum(count(*)) OVER () AS t FROM documents GROUP BY lang),
q AS (SELECT *, ceil(t * 0.2::DOUBLE) * k / t::DOUBLE AS e FROM s), z AS (SELECT *, floor(e) AS f, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, lang NULLS LAST) AS r, ceil(t * 0.2::DOUBLE) - sum(floor(e)) OVER () AS rest FROM q)
SELECT doc_id AS "FileId", CASE WHEN i <= f + CASE WHEN r <= rest THEN 1 ELSE 0 END THEN 'test' ELSE 'train' END AS split FROM d JOIN z ON d.lang IS NOT DISTINCT FROM z.lang""")
def stratified_split(spark, sf_dir):
    return sample.stratified_split(files(spark, sf_dir).select("FileId", "Language")).select("FileId", "split")


@query("SELECT doc_id AS \"FileId\" FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, greatest(1, count(*) OVER () // 30) AS step FROM documents) WHERE i % step = 0 AND i < 30 * step")
def systematic_sample(spark, sf_dir):
    return sample.systematic_sample(files(spark, sf_dir).select("FileId"), 30, "FileId")


@query("SELECT doc_id AS \"FileId\" FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents) WHERE i > 5 AND i <= 25")
def skip_take(spark, sf_dir):
    return sample.skip_take(files(spark, sf_dir).select("FileId", "Language"), 5, 20, "Language", "FileId").select("FileId")


_CENTROIDS_SQL = f"""
v AS (SELECT * FROM {_TOKENS_SQL}), a AS (SELECT doc_id, lang, idx FROM documents JOIN v ON contains(text, token)), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
cent AS (SELECT a.lang, idx, count(*) / any_value(n.n)::DOUBLE AS mean FROM a JOIN n ON a.lang = n.lang GROUP BY a.lang, idx)"""


@query(f"WITH {_CENTROIDS_SQL} SELECT lang AS label, idx, round(mean, 9) AS mean FROM cent")
def centroids(spark, sf_dir):
    rows = features.with_features(files(spark, sf_dir), TOKENS)
    return train.centroids(rows, len(TOKENS)).select("label", "idx", F.round("mean", 9).alias("mean"))


@query(f"""
WITH {_CENTROIDS_SQL}, norm AS (SELECT lang, sum(mean * mean) AS norm FROM cent GROUP BY lang), size AS (SELECT doc_id, count(*) AS k FROM a GROUP BY doc_id),
dot AS (SELECT a.doc_id, c.lang, sum(mean) AS dot FROM a JOIN cent c ON a.idx = c.idx GROUP BY a.doc_id, c.lang),
dist AS (SELECT d.doc_id, norm.lang, round(coalesce(k, 0) + norm - 2 * coalesce(dot, 0), 9) AS d FROM documents d CROSS JOIN norm LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN dot ON dot.doc_id = d.doc_id AND dot.lang = norm.lang)
SELECT doc_id AS "FileId", min_by(lang, (d, lang)) AS pred FROM dist GROUP BY doc_id""")
def centroid_predict(spark, sf_dir):
    rows = features.with_features(files(spark, sf_dir), TOKENS)
    return train.nearest_centroid(rows, train.centroids(rows, len(TOKENS)), "FileId")


_SCORES_SQL = f"""
w AS (SELECT * FROM {_WEIGHTS_SQL}), v AS (SELECT * FROM {_TOKENS_SQL}), b AS (SELECT * FROM {_BIAS_SQL}), act AS (SELECT doc_id, idx FROM documents JOIN v ON contains(text, token)),
score AS (SELECT d.doc_id, d.lang, b.c, b.name, b.b, b.b + coalesce(sum(w.w), 0) AS s FROM documents d CROSS JOIN b LEFT JOIN act ON act.doc_id = d.doc_id LEFT JOIN w ON w.idx = act.idx AND w.c = b.c GROUP BY d.doc_id, d.lang, b.c, b.name, b.b),
prob AS (SELECT *, exp(s - max(s) OVER p) / sum(exp(s - mx)) OVER p AS pr FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS mx FROM score) WINDOW p AS (PARTITION BY doc_id)),
best AS (SELECT doc_id, any_value(lang) AS lang, min_by(name, (-s, c)) AS pred, max(pr) AS prob FROM prob GROUP BY doc_id)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(features.with_features(files(spark, sf_dir), TOKENS), MODEL)


@query(f"WITH {_SCORES_SQL} SELECT doc_id AS \"FileId\", c AS class_idx, s AS score FROM score")
def linear_logits(spark, sf_dir):
    return _scored(spark, sf_dir).select("FileId", F.posexplode("scores").alias("class_idx", "score"))


@query(f"WITH {_SCORES_SQL} SELECT doc_id AS \"FileId\", pred, round(prob, 9) AS prob FROM best")
def softmax_argmax(spark, sf_dir):
    return _scored(spark, sf_dir).select("FileId", "pred", F.round("prob", 9).alias("prob"))


@query(f"WITH {_SCORES_SQL}, own AS (SELECT doc_id, s FROM score WHERE name = lang), above AS (SELECT s.doc_id, count(*) FILTER (WHERE s.s > own.s) AS k FROM score s JOIN own ON own.doc_id = s.doc_id GROUP BY s.doc_id) SELECT avg(CASE WHEN k < 2 THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM above")
def topn_hit(spark, sf_dir):
    place = (F.array_position(F.array(*map(F.lit, CLASSES)), F.col("Language")) - 1).cast("int")
    return metrics.top_n_accuracy(_scored(spark, sf_dir).withColumn("y", place).where("y >= 0"), "y", "scores", 2)


@query(f"WITH {_SCORES_SQL} SELECT doc_id AS \"FileId\", c AS class_idx, name AS \"class\", b AS bias, s - b AS weight, s AS score, round(pr, 9) AS prob, round((s - min(s) OVER q) / greatest(1e-6, max(s) OVER q - min(s) OVER q), 9) AS alpha FROM prob WINDOW q AS (PARTITION BY doc_id)")
def explain_scores(spark, sf_dir):
    rows = explain(features.with_features(files(spark, sf_dir), TOKENS), MODEL, "FileId")
    return rows.withColumn("prob", F.round("prob", 9)).withColumn("alpha", F.round("alpha", 9))


@query(f"WITH {_SCORES_SQL} SELECT lang AS actual, pred AS predicted, count(*)::BIGINT AS n FROM best GROUP BY lang, pred")
def confusion(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir), "Language", "pred")


@query(f"WITH {_SCORES_SQL} SELECT lang AS actual, " + ", ".join(f"count(*) FILTER (WHERE pred = '{c}')::BIGINT AS {c}" for c in CLASSES) + " FROM best GROUP BY lang")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_scored(spark, sf_dir), "Language", "pred", CLASSES)


@query(f"WITH {_SCORES_SQL}, k AS (SELECT lang, pred, count(*)::BIGINT AS n, count(*) / (sum(count(*)) OVER (PARTITION BY lang))::DOUBLE AS share FROM best GROUP BY lang, pred) SELECT lang AS actual, pred AS predicted, n, round(share, 9) AS share FROM k WHERE lang <> pred ORDER BY n DESC, share DESC, actual, predicted LIMIT 25")
def top_confusions(spark, sf_dir):
    return metrics.top_confusions(_scored(spark, sf_dir), "Language", "pred").withColumn("share", F.round("share", 9))


@query(f"WITH {_SCORES_SQL} SELECT lang || ' -> ' || pred AS mistake, count(*)::BIGINT AS n FROM best WHERE lang <> pred GROUP BY lang, pred")
def mistakes(spark, sf_dir):
    return metrics.mistakes(_scored(spark, sf_dir), "Language", "pred")


@query(f"WITH {_SCORES_SQL} SELECT avg(CASE WHEN lang = pred THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM best")
def accuracy(spark, sf_dir):
    return metrics.accuracy(_scored(spark, sf_dir), "Language", "pred")


_F1 = "(SELECT {by} label, 2 * sum(hit) / sum(t + p)::DOUBLE AS f1 FROM (SELECT {by} lang AS label, 1 AS t, 0 AS p, CASE WHEN lang = pred THEN 1 ELSE 0 END AS hit FROM {src} UNION ALL SELECT {by} pred, 0, 1, 0 FROM {src}) GROUP BY {by} label)"


@query(f"WITH {_SCORES_SQL} SELECT round(avg(f1), 9) AS macro_f1 FROM {_F1.format(by='', src='best')}")
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(_scored(spark, sf_dir), "Language", "pred").select(F.round("macro_f1", 9).alias("macro_f1"))


@query(f"WITH {_SCORES_SQL} SELECT doc_id AS \"FileId\", lang AS \"Language\", pred AS \"Pred\", round(prob, 9) AS \"Prob\" FROM best WHERE lang <> pred")
def wrong_rows(spark, sf_dir):
    wrong = _scored(spark, sf_dir).where("Language != pred")
    return wrong.select("FileId", "Language", F.col("pred").alias("Pred"), F.round("prob", 9).alias("Prob"))


@query(f"WITH {_SCORES_SQL}, occ AS (SELECT idx, count(*)::BIGINT AS k FROM act GROUP BY idx) SELECT w.idx, any_value(token) AS feature, round(avg(abs(w.w)), 9) AS mean_abs, round(stddev_pop(abs(w.w)), 9) AS std_abs, round(coalesce(any_value(k), 0) / (SELECT count(*) FROM documents)::DOUBLE, 9) AS mean_value, coalesce(any_value(k), 0)::BIGINT AS occurrences FROM w JOIN v ON v.idx = w.idx LEFT JOIN occ ON occ.idx = w.idx GROUP BY w.idx")
def feature_importance(spark, sf_dir):
    rows = analyze.feature_importance(features.with_features(files(spark, sf_dir), TOKENS), MODEL)
    return rows.select("idx", "feature", *[F.round(c, 9).alias(c) for c in ("mean_abs", "std_abs", "mean_value")], "occurrences")


_NS = [1, 3, 6, 9, 12]


@query(f"""WITH {_SCORES_SQL}, ns AS (SELECT unnest({_NS}) AS n),
sn AS (SELECT ns.n, d.doc_id, d.lang, b.c, b.name, b.b + coalesce(sum(w.w), 0) AS s FROM ns CROSS JOIN documents d CROSS JOIN b LEFT JOIN act ON act.doc_id = d.doc_id AND act.idx < ns.n LEFT JOIN w ON w.idx = act.idx AND w.c = b.c GROUP BY ns.n, d.doc_id, d.lang, b.c, b.name, b.b),
bn AS (SELECT n, doc_id, any_value(lang) AS lang, min_by(name, (-s, c)) AS pred FROM sn GROUP BY n, doc_id)
SELECT n AS "N", round(avg(f1), 9) AS "F1" FROM {_F1.format(by="n,", src="bn")} GROUP BY n""")
def f1_curve_fixed(spark, sf_dir):
    rows = features.with_features(files(spark, sf_dir), TOKENS)
    return analyze.f1_curve(rows, MODEL, "Language", decimals=None, ns=_NS).select("N", F.round("F1", 9).alias("F1"))


@query(f"""WITH {_SCORES_SQL}, ord AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '42'), doc_id) AS i, count(*) OVER () AS n FROM documents),
prev AS (SELECT a.doc_id, b.doc_id AS other FROM ord a JOIN ord b ON a.i = b.i % b.n + 1), ks AS (SELECT unnest(range(-1, {len(TOKENS)})) AS k),
sw AS (SELECT k, doc_id, idx FROM ks JOIN act ON idx <> k UNION ALL SELECT act.idx, prev.doc_id, act.idx FROM prev JOIN act ON act.doc_id = prev.other),
sn AS (SELECT ks.k, d.doc_id, d.lang, b.c, b.name, b.b + coalesce(sum(w.w), 0) AS s FROM ks CROSS JOIN documents d CROSS JOIN b LEFT JOIN sw ON sw.k = ks.k AND sw.doc_id = d.doc_id LEFT JOIN w ON w.idx = sw.idx AND w.c = b.c GROUP BY ks.k, d.doc_id, d.lang, b.c, b.name, b.b),
bn AS (SELECT k, doc_id, any_value(lang) AS lang, min_by(name, (-s, c)) AS pred FROM sn GROUP BY k, doc_id), f AS (SELECT k, avg(f1) AS f1 FROM {_F1.format(by="k,", src="bn")} GROUP BY k)
SELECT k::INT AS idx, any_value(token) AS feature, round(any_value(f1), 9) AS "F1", round((SELECT f1 FROM f WHERE k = -1) - any_value(f1), 9) AS "drop" FROM f JOIN v ON v.idx = f.k GROUP BY k""")
def permutation_importance(spark, sf_dir):
    rows = features.with_features(files(spark, sf_dir), TOKENS)
    moved = analyze.permutation_importance(rows, MODEL, "Language", "FileId")
    return moved.select("idx", "feature", F.round("F1", 9).alias("F1"), F.round("drop", 9).alias("drop"))


_ALL_NS = list(range(1, len(TOKENS) + 1))


@query(f"""WITH {_SCORES_SQL}, ns AS (SELECT unnest({_ALL_NS}) AS n),
sn AS (SELECT ns.n, d.doc_id, d.lang, b.c, b.name, b.b + coalesce(sum(w.w), 0) AS s FROM ns CROSS JOIN documents d CROSS JOIN b LEFT JOIN act ON act.doc_id = d.doc_id AND act.idx < ns.n LEFT JOIN w ON w.idx = act.idx AND w.c = b.c GROUP BY ns.n, d.doc_id, d.lang, b.c, b.name, b.b),
bn AS (SELECT n, doc_id, any_value(lang) AS lang, min_by(name, (-s, c)) AS pred FROM sn GROUP BY n, doc_id), curve AS (SELECT n, avg(f1) AS f1 FROM {_F1.format(by="n,", src="bn")} GROUP BY n),
fell AS (SELECT coalesce(max(n), 0) AS n FROM curve WHERE f1 < (SELECT f1 FROM curve WHERE n = {len(TOKENS)}) - 0.01)
SELECT n, round(f1, 9) AS f1 FROM curve WHERE n = (SELECT n + 1 FROM fell)""")
def ideal_size_fixed(spark, sf_dir):
    rows = materialize(features.with_features(files(spark, sf_dir), TOKENS).select("active", "Language"), "ideal-size")
    best = analyze.ideal_size(rows, MODEL, "Language", decimals=None, block=5)
    return spark.createDataFrame([(best.n, round(best.f1, 9))], "n int, f1 double")


_ROUNDED_SQL = _SCORES_SQL.split("score AS")[0].strip().rstrip(",")


@query(f"""WITH {_ROUNDED_SQL}, ds AS (SELECT unnest(range(0, 5)) AS d), wr AS (SELECT d, c, idx, round_even(w, d::INT) AS w FROM ds CROSS JOIN w), br AS (SELECT d, c, name, round_even(b, d::INT) AS b FROM ds CROSS JOIN b),
sn AS (SELECT br.d, x.doc_id, x.lang, br.c, br.name, br.b + coalesce(sum(wr.w), 0) AS s FROM br CROSS JOIN documents x LEFT JOIN act ON act.doc_id = x.doc_id LEFT JOIN wr ON wr.idx = act.idx AND wr.c = br.c AND wr.d = br.d GROUP BY br.d, x.doc_id, x.lang, br.c, br.name, br.b),
bn AS (SELECT d, doc_id, any_value(lang) AS lang, min_by(name, (-round(s, 9), c)) AS pred FROM sn GROUP BY d, doc_id)
SELECT d::INT AS "Decimals", round(avg(f1), 9) AS "F1" FROM {_F1.format(by="d,", src="bn")} GROUP BY d""")
def rounding_curve_fixed(spark, sf_dir):
    rows = features.with_features(files(spark, sf_dir), TOKENS)
    return analyze.rounding_curve(rows, MODEL, "Language", 4).select("Decimals", F.round("F1", 9).alias("F1"))


@query(f"WITH q AS (SELECT c, idx, round_even(w / (6 / 8::DOUBLE / 127), 0)::INT AS q FROM (SELECT * FROM {_WEIGHTS_SQL})), {_ROUNDED_SQL}, s AS (SELECT d.doc_id, q.c, sum(q) FILTER (WHERE act.idx IS NOT NULL)::BIGINT AS q FROM documents d CROSS JOIN q LEFT JOIN act ON act.doc_id = d.doc_id AND act.idx = q.idx GROUP BY d.doc_id, q.c) SELECT doc_id AS \"FileId\", c, coalesce(q, 0)::BIGINT AS q FROM s")
def int8_scores(spark, sf_dir):
    """Scores, before the intercept, of the model's weights as its int8 encoding stores them."""
    stored = np.frombuffer(encode(MODEL, "int8"), np.int8, offset=8)[: MODEL.coef.size].reshape(MODEL.coef.shape)
    rows = features.with_features(files(spark, sf_dir), TOKENS)
    sums = add_at(F.col("active"), constant(stored.T.astype(int).tolist(), "array<array<bigint>>"), constant([0] * len(CLASSES), "array<bigint>"))
    return rows.select("FileId", F.posexplode(sums).alias("c", "q"))


@query(f"WITH v AS (SELECT * FROM {_TOKENS_SQL}), f AS (SELECT idx, (length(text) - length(replace(text, token, ''))) / length(token)::DOUBLE / length(text) AS x FROM documents, v) SELECT idx, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std FROM f GROUP BY idx")
def scaler_stats(spark, sf_dir):
    rows = files(spark, sf_dir).select(features.token_frequency(F.col("Snippet"), TOKENS).alias("x"))
    mean, std = train.scaler(rows, "x", len(TOKENS))
    return spark.createDataFrame([(i, round(float(m), 9), round(float(s), 9)) for i, (m, s) in enumerate(zip(mean, std, strict=True))], "idx int, mean double, std double")


def _trained(spark, sf_dir, tokens: list[str]) -> DataFrame:
    rows = features.with_features(files(spark, sf_dir), tokens, engine="arrow").select("FileId", "Language", "active")
    return materialize(sample.stratified_split(materialize(rows, "active")), "train-split")


@query()
def lr_train_predict(spark, sf_dir):
    """Logistic regression on the whole default vocabulary, predictions of the held-out rows."""
    rows = _trained(spark, sf_dir, VOCAB)
    model = train.train_logistic(rows.where("split = 'train'"), VOCAB)
    return predict(rows.where("split = 'test'"), model).select("FileId", "Language", "pred", "prob")


def _classifier_query(kind: str):
    @query(name=f"classify_{kind}")
    def classify(spark, sf_dir):
        rows = materialize(features.with_features(files(spark, sf_dir), VOCAB, engine="arrow").select("active", "Language"), "active")
        ready = materialize(train.training_rows(rows, CLASSES, len(VOCAB), "Language"), "training-rows")
        fitted = train.classifier(kind, len(VOCAB), len(CLASSES)).fit(ready)
        return fitted.transform(ready).groupBy(F.col("y").alias("actual"), F.col("prediction").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


for _kind in ("bernoulli_nb", "multinomial_nb", "linear_svc", "perceptron", "random_forest"):
    _classifier_query(_kind)


@query()
def forest_nodes(spark, sf_dir):
    """The node table of a small random forest."""
    rows = features.with_features(files(spark, sf_dir), TOKENS).select("active", "Language")
    ready = materialize(train.training_rows(rows, CLASSES, len(TOKENS), "Language"), "training-rows")
    return train.forest_nodes(train.classifier("random_forest", len(TOKENS), len(CLASSES)).setNumTrees(10).setMaxDepth(10).fit(ready))
