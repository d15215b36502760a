"""The engine's operators on small cases worked out by hand or by plain Python."""

import gzip
import random
import sqlite3
import struct
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.functions import rules, vocab
from glossa.functions import text as T
from glossa.operators import analyze, checks, clean, features, metrics, mining, sample, train
from glossa.operators.model import LinearModel, clips, compact_values, decode, encode, explain, first_max, predict, softmax
from glossa.sources import io


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


def reference_chunks(text, limit):
    chunks, lines, filled = [], [], 0
    for line in text.splitlines():
        lines.append(line)
        filled += bool(line.strip())
        if filled >= limit:
            chunks.append(lines)
            lines, filled = [], 0
    if lines:
        chunks.append(lines)
    if len(chunks) > 1:
        last = chunks.pop()
        chunks[-1] = chunks[-1] + last
    return ["\n".join(c) for c in chunks] or [""]


def test_chunks_equal_a_sequential_model(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", " b", "\n", "\n\n", " \n", "\r\n", "\t", "\x85", "é\n"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["", "\n", "\n" * 50_000, "x" * 100_000, "a\n" * 30_000]
    for limit in (1, 2, 10):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", clean.chunks(F.col("t"), limit).alias("c"))
        assert {r.i: r.c for r in df.collect()} == {i: reference_chunks(t, limit) for i, t in enumerate(texts)}


def test_lines_and_newlines(spark):
    for text in ("", "a", "a\n", "\n", "a\r\nb\rc\x0bd\u2028e\n\n"):
        assert value(spark, text, T.split_lines) == text.splitlines()
    assert value(spark, "a\r\nb\rc", T.normalize_newlines) == "a\nb\nc"
    assert value(spark, "a\\r\\nb\\nc", T.preview) == "a\nb"
    assert value(spark, "a\tb\n", T.escape_newlines) == "a\\tb\\n"


@pytest.mark.parametrize(
    ("text", "column", "want"),
    [
        ("constant const", lambda t: T.has_word(t, "const"), True), ("my_const", lambda t: T.has_word(t, "const"), False), ("éconst", lambda t: T.has_word(t, "const"), False),
        (".PHONY: x", lambda t: T.has_word(t, ".PHONY"), True), ("if x:  # c", T.has_indent_colon, True), ("# x:", T.has_indent_colon, False), ("a\n   \n  b", lambda t: T.has_leading_indent(t, 2), True),
        ("a\n    \n", lambda t: T.has_leading_indent(t, 2), False), ("x\n\t @a", lambda t: T.line_starts_with(t, "@"), True), ("x @a", lambda t: T.line_starts_with(t, "@"), False),
        ("- key: v", T.yaml_key_value, False), (" a-b: v", T.yaml_key_value, True), ("aaaa", lambda t: T.count_substring(t, "aa"), 2), ("fn(a) alpha beta_x ab", T.word_tokens, ["alpha", "beta_x"]),
        ("ab c", T.char_ngrams, ["ab", "b c", "ab c"]),
    ],
)
def test_text_functions(spark, text, column, want):
    assert value(spark, text, column) == want


def test_rules(spark):
    assert len(rules.RULES) == 186
    found = value(spark, "import os\nclass A:\n    def f(self): return None", rules.active_rules)
    assert {"HasImport", "HasClass", "HasDef", "HasSelf", "HasNoneTC", "HasIndentColon", "HasIndentFourSpaces", "HasDefLineColon"} <= set(found)
    assert value(spark, None, rules.active_rules) == []
    js = lambda t: rules.active_rules(t, dialect="js")
    assert "HasConst" in value(spark, "éconst x", js) and "HasConst" not in value(spark, "éconst x", rules.active_rules)
    assert "HasDollarVar" in value(spark, "$é", rules.active_rules) and "HasDollarVar" not in value(spark, "$é", js)
    for text, want in {"func main() {": "go", "SELECT 1": "unknown", "def a(x):\n  pass": "python", "def a\n  1\nend": "ruby", "<?php echo": "php", "function a() { var x; window.y }": "javascript", "public class A {": "java"}.items():
        assert value(spark, text, rules.decide) == want


def test_cleaning(spark):
    data = [("HTML", '<SCRIPT a=">">x</SCRIPT>y'), ("HTML", "<p><scripts>z"), ("PHP", "<script>x"), ("Markdown", "a```x```b"), ("Markdown", "```"), ("SQL", "a<html b>c</html>d"), ("Go", "<script>"), ("HTML", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "Id int, Language string, Snippet string")
    got = {r.Id: (r.Snippet, r.error) for r in clean.remove_sub_languages(df).collect()}
    assert got[0] == ('<SCRIPT a=">"></SCRIPT>y', None) and got[1] == ("<p><scripts>z", None) and got[2] == ("<script>x", "unclosed script")
    assert got[3] == ("a``````b", None) and got[4] == ("```", "uneven code fences") and got[5] == ("ad", None) and got[6] == ("<script>", None) and got[7] == (None, None)
    with pytest.raises(Exception, match="unclosed script|uneven code fences"):
        clean.remove_sub_languages(df, mode="fail").collect()
    assert value(spark, '<script a="' + "x" * 200_000 + '">y</script>', lambda t: F.length(clean.strip_tag(t, "script"))) == 200_022
    assert [r.Id for r in clean.keep_labels(spark.createDataFrame([(1, "Text"), (2, None), (3, "Go")], "Id int, Language string")).collect()] == [2, 3]


def test_metrics_of_chunks(spark):
    m = value(spark, "ab 1;", clean.chunk_metrics)
    assert (m.total_chars, m.letter_ratio, m.digit_ratio, m.whitespace_ratio, m.punct_ratio, m.alnum_ratio, m.line_count) == (5, 0.4, 0.2, 0.2, 0.2, 0.6, 1)
    assert value(spark, "", clean.chunk_metrics).letter_ratio == 0.0
    assert value(spark, "short", lambda t: clean.is_junk(clean.chunk_metrics(t)))


def test_rebalance(spark):
    df = spark.createDataFrame([(i, "a" if i < 50 else "b" if i < 60 else "c") for i in range(65)], "FileId int, Language string")
    counts = {r.Language: r["count"] for r in clean.rebalance(df, id_cols=("FileId",)).groupBy("Language").count().collect()}
    assert counts == {"a": 10, "b": 10, "c": 5}
    assert clean.rebalance(df.where("Language = 'a'"), id_cols=("FileId",)).count() == 50


def test_presence_engines_agree(spark):
    df = spark.createDataFrame([("As\r\nas\t",), (None,), ("",)], "Snippet string")
    tokens = vocab.vocabulary(["As", "as", "\n", "\t", "s\na"])
    a, b = (([r.active for r in features.with_features(df, tokens, engine=e).collect()]) for e in ("native", "arrow"))
    assert a == b == [[0, 1, 2, 3, 4], [], []]
    assert value(spark, "aaaa", lambda t: features.token_frequency(t, ["aa"])) == [0.5] and value(spark, "", lambda t: features.token_frequency(t, ["a"])) == [0.0]


def test_fingerprint_sees_content(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "Snippet string, Language string")
    one = features.feature_fingerprint(df, ["t"], "Snippet", "Language")
    assert one == features.feature_fingerprint(df.repartition(5), ["t"], "Snippet", "Language") and len(one) == 12
    assert one != features.feature_fingerprint(df.replace("a", "c"), ["t"], "Snippet", "Language")


def test_mining_and_gini(spark):
    df = spark.createDataFrame([(1, "en", "hello hello world"), (2, "fr", "bonjour hello"), (3, "fr", "ab")], "FileId int, Language string, Snippet string")
    row = {r.Substring: r for r in mining.mine_tokens(df).collect()}
    assert set(row) == {"hello"} and row["hello"].BestLanguage == "en" and row["hello"].LangCount == 2 and row["hello"].RestCount == 1
    assert row["hello"].BestFreq == pytest.approx(2 / 17)
    gini = lambda v: mining.gini_of(spark.createDataFrame([(float(x),) for x in v], "v double"), "v").first().gini
    assert gini([0, 0, 0, 4]) == 0.75 and gini([0, 0]) == 0.0
    with pytest.raises(Exception, match="null label"):
        mining.mine_tokens(df.union(spark.createDataFrame([(4, None, "some words")], df.schema))).collect()


def test_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(103)], "FileId int, Language string").repartition(5)
    split = sample.stratified_split(df)
    assert split.where("split = 'test'").count() == 21
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, sample.stratified_split(df.coalesce(1)).collect()))
    assert sorted(r.FileId for r in sample.systematic_sample(df, 10, "FileId").collect()) == list(range(0, 100, 10))
    assert sample.subset_of_split(df.withColumnRenamed("Language", "split"), 0.001, "split", "FileId").count() == 2
    with pytest.raises(ValueError, match="positive"):
        sample.subset_of_split(df, 0, "Language", "FileId")
    assert sample.skip_take(df, 2, 3, "Language", "FileId").count() == 6 and sample.head_of_groups(df, 5, "Language", "FileId").count() == 10


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "s array<double>")
    assert df.select(first_max(F.col("s")).alias("i")).first().i == 1
    assert spark.createDataFrame([([0.0, 0.0],)], "s array<double>").select(softmax(F.col("s")).alias("p")).first().p == [0.5, 0.5]
    model = LinearModel(["a", "b"], ["x", "y"], np.array([[1.0, 0.0], [0.0, 2.0]]), np.array([0.5, 0.0]))
    rows = features.with_features(spark.createDataFrame([("aaaaaa",), ("bbbbbb",), ("b",)], "Snippet string"), model.features)
    assert [r.pred for r in predict(rows, model, text_col="Snippet").collect()] == ["x", "y", None]
    assert [(r.score, round(r.alpha, 3)) for r in explain(rows.limit(1), model, "Snippet").collect()] == [(1.5, 1.0), (0.0, 0.0)]


def test_macro_f1_counts_unknown_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "u"), ("b", "b")], "y string, p string")
    assert metrics.macro_f1(df, "y", "p").first().macro_f1 == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert metrics.confusion_matrix(df, "y", "p", ["a", "b", "u"]).orderBy("actual").first()["u"] == 1
    assert "| a | u | 1 | 50.0% |" in metrics.top_k_confusions_markdown(metrics.top_confusions(df, "y", "p"))
    assert metrics.rule_stats(df.withColumnsRenamed({"y": "Language", "p": "Snippet"}), lambda t: t == "a").orderBy("Language").first().Occurrence == 0.5


def small_model():
    rng = np.random.default_rng(0)
    return LinearModel([f"t{i}" for i in range(5)], ["a", "b", "c"], rng.normal(size=(3, 5)), rng.normal(size=3))


def test_model_codecs(tmp_path):
    m = small_model()
    for kind, tolerance in {"json": 0.051, "json_flat": 0.051, "tsv": 0.051, "tsv_int10": 0.051, "float32": 1e-6, "float16": 2e-3, "int8": 0.02, "int8_fixed": 0.051}.items():
        coef, bias = decode(encode(m, kind), kind)
        assert np.abs(coef - m.coef).max() <= tolerance and np.abs(bias - m.intercept).max() <= tolerance, kind
    assert encode(m, "float32")[:4] == struct.pack("<HH", 3, 5)
    assert clips(LinearModel(["a"], ["x"], np.array([[99.0]]), np.array([0.0]))) and not clips(m)
    assert compact_values(np.array([0.25, 2.0, -0.04]), 1) == [0.2, 2, 0]
    r = LinearModel(["a"], ["x"], np.array([[-0.04]]), np.array([0.25])).rounded(1)
    assert str(r.coef[0, 0]) == "0.0" and r.intercept[0] == 0.2
    assert LinearModel.load(m.save(tmp_path / "m.json")).to_dict() == m.to_dict()
    ordered, places = m.by_importance()
    assert (ordered.coef == m.coef[:, places]).all() and m.first(2).size_kb() < m.size_kb()


def test_curves_and_ideal_size(spark):
    m = LinearModel(["a", "b", "c"], ["x", "y"], np.array([[2.0, 0.5, 0.0], [-2.0, 1.0, 0.0]]), np.array([0.0, 0.1]))
    df = spark.createDataFrame([([0], "x"), ([1], "y"), ([0, 1], "x"), ([], "y")], "active array<int>, Language string")
    curve = {r.N: r.F1 for r in analyze.f1_curve(df, m, "Language", steps=3, decimals=None).collect()}
    assert set(curve) == {1, 2, 3} and curve[3] == 1.0
    assert analyze.ideal_size(df, m, "Language").n == 1 and analyze.ideal_size(df, m, "Language", f1_delta=0).n == 3
    assert analyze.ideal_size(df, m, "Language", compat=True).n == 1
    assert [r.Decimals for r in analyze.rounding_curve(df, m, "Language", 2).orderBy("Decimals").collect()] == [0, 1, 2]
    assert analyze.feature_importance(df, m).first().feature == "a"
    with pytest.raises(ValueError, match="steps"):
        analyze.grid(5, 1)


def test_logistic_regression_is_at_the_optimum(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 300)
    on = rng.random((300, 6)) < np.where(np.arange(6) % 3 == y[:, None], 0.7, 0.3)
    df = spark.createDataFrame([([int(i) for i in np.flatnonzero(r)], "abc"[k]) for r, k in zip(on, y, strict=True)], "active array<int>, Language string")
    m = train.train_logistic(df, list("uvwxyz"))
    z = on @ m.coef.T + m.intercept
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    w = 300 / (3 * np.bincount(y))[y]
    gradient = ((p - np.eye(3)[y]) * w[:, None]).T @ on + m.coef
    assert np.abs(gradient).max() < 1e-3
    means = train.centroids(df, 6)
    near = train.nearest_centroid(df.withColumn("id", F.monotonically_increasing_id()), means, "id")
    assert near.count() == 300 and near.select("pred").distinct().count() == 3
    assert train.classifier("random_forest", 6, 3).fit(train.training_rows(df, list("abc"), 6, "Language")).numClasses == 3


def test_sources(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("create table snippets(snippet text, language text)")
    db.executemany("insert into snippets values (?, ?)", [("a", "Go"), ("b", "C")])
    db.commit()
    df = io.read_sqlite(spark, str(tmp_path / "x.db"), "select snippet, language from snippets", "Snippet string, Language string")
    assert sorted(map(tuple, df.collect())) == [("a", "Go"), ("b", "C")]
    io.write_snippets(df, str(tmp_path / "p"))
    assert io.read_snippets(spark, str(tmp_path / "p")).count() == 2
    io.write_csv(spark.createDataFrame([('a"b\nc', "Go")], "Snippet string, Language string"), str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c"), "Snippet string, Language string").first().Snippet == 'a"b\nc'
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("Snippet", pa.string())])) as w:
        w.write(pa.record_batch([["x", None]], names=["Snippet"]))
    assert [r.Snippet for r in io.read_arrow(spark, [str(tmp_path / "t.arrow")]).collect()] == ["x", None]
    blobs = spark.createDataFrame([(bytearray(gzip.compress("é".encode("latin-1"))), "latin-1"), (bytearray(gzip.compress(b"\xff")), None), (None, None)], "content binary, src_encoding string")
    assert [r.Snippet for r in io.decode_blobs(blobs).collect()] == ["é", "\ufffd", None]
    script = "import sys, json\nfor x in sys.stdin: print(json.dumps({'predicted': json.loads(x)['snippet'][:1]}))"
    assert sorted(r.predicted for r in io.external_classifier(df, ["python", "-c", script], "Snippet").collect()) == ["a", "b"]


def test_stream_scores_like_batch(spark, tmp_path):
    from glossa.streaming.score import read_stream, score_stream, write_stream

    m = LinearModel(["a", "b"], ["x", "y"], np.array([[1.0, 0.0], [0.0, 2.0]]), np.array([0.5, 0.0]))
    df = spark.createDataFrame([("aaaaaa",), ("bbbbbb",)], "Snippet string")
    df.write.parquet(str(tmp_path / "in"))
    write_stream(score_stream(read_stream(spark, str(tmp_path / "in"), "Snippet string"), m), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.Snippet, r.pred) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("aaaaaa", "x"), ("bbbbbb", "y")]


def test_rules_one_by_one(spark):
    """For every rule a text that it holds for, written by hand, with all other rules that hold for it."""
    holds = {
        "None": "HasNoneTC", "self": "HasSelf", "True": "HasTrueTC", "False": "HasFalseTC", "lambda": "HasLambda", "x:": "HasIndentColon", "'''": "HasTripleQuotes", "f'a'": "HasPythonFString",
        "public": "HasPublic HasTsAccessMod", "static": "HasStatic", "void": "HasVoid", "new": "HasNew", "package": "HasPackage HasGoPackage", "extends": "HasExtends", "implements": "HasImplements HasTsImplements",
        "a@": "HasAtSymbol", "let": "HasLet", "const": "HasConst", "var": "HasVar", "=>": "HasFatArrow", "export": "HasExport HasShellExport", "default": "HasDefault", "func": "HasFunc", ":=": "HasColonEquals",
        "defer": "HasDefer", "go": "HasGoKeyword", "chan": "HasChan", "a<-": "HasLeftArrow", "end": "HasEnd", "module": "HasModule", "require": "HasRequire", "do": "HasDo HasShellDo", "puts": "HasPuts",
        "<?php": "HasPhpTag HasAngleQuestion", "$é": "HasDollarVar", "namespace": "HasNamespace", "use": "HasUse", "echo": "HasEcho", "a->b": "HasThinArrow", "a::b": "HasDoubleColon", "async": "HasAsync",
        "await": "HasAwait", "def": "HasDef", "function": "HasFunction", "import": "HasImport", "import or from": "HasImport HasFromImport HasSqlFrom",
        "from a import b": "HasImport HasFromImport HasFromImportOrder HasSqlFrom", "import a from 'b'": "HasImport HasFromImport HasImportFromOrder HasSqlFrom", "import a as b": "HasImport HasImportAs HasTsAs",
        "import * as b": "HasImport HasImportAs HasImportStarAs HasTsAs", "import 'a'": "HasImport HasImportQuoteLine", "class": "HasClass", "a;": "HasSemicolon", "a#": "HasHashComment",
        "@": "HasAtSymbol HasDecoratorLine", "this.": "HasThisDot", "$this->a": "HasThisArrow HasDollarThis HasDollarVar HasThinArrow HasShellVar", "$this": "HasDollarThis HasDollarVar HasShellVar",
        "**kwargs": "HasKwargs", "*args": "HasArgs", "<?": "HasAngleQuestion", "<>": "HasAngleBrackets", "($": "HasDollarParen", ".+": "HasDotPlus", "(+=": "HasPlusEquals", "&$": "HasAmpDollar",
        "( : )": "HasSpaceColonSpace", "/*#": "HasSlashStarHash HasHashComment", "private": "HasPrivate HasTsAccessMod", "protected": "HasProtected HasTsAccessMod", "bool": "HasBool", "boolean": "HasBoolean",
        "str": "HasStr", "string": "HasString", "String": "HasStringTC", "std::string": "HasStdString HasString HasDoubleColon HasStdNamespace", "cstring": "HasCString", "char": "HasChar", "byte": "HasByte",
        "bytes": "HasBytes", "strlen": "HasStrlen", "a\tb": "HasTabs", "  a": "HasIndentTwoSpaces", "    a": "HasIndentTwoSpaces HasIndentFourSpaces", "def a(b): c": "HasDef HasDefLineColon",
        "<? extends": "HasGenericWildcard HasExtends HasAngleQuestion", "diff --git": "HasDiffHeader", "@@": "HasAtSymbol HasDecoratorLine HasDiffHunk", "+++": "HasDiffFilePlus",
        "---": "HasDiffFileMinus HasYamlDocMarker HasMarkdownUnderlineHeading", "a: ": "HasMakeTarget HasIndentColon", "$(a": "HasMakeVar", ".PHONY": "HasPhony", "a =": "HasMakeAssign", "a ?=": "HasMakeAssign",
        "$(shell a": "HasMakeVar HasMakeShell", "\t?": "HasTabs HasMakeRecipeTab", "#include <stdio": "HasHashComment HasIncludeStdIO HasMarkdownHeading HasIniComment", "printf": "HasPrintf", "scanf": "HasScanf",
        "#include <iostream": "HasHashComment HasIostream HasMarkdownHeading HasIniComment", "std::": "HasStdNamespace HasDoubleColon HasIndentColon", "template": "HasTemplate", "fn a(b) -> c": "HasRustFnArrow HasThinArrow",
        "use a::b": "HasUse HasDoubleColon HasRustUse", "macro_rules!": "HasRustMacroRules", "#[derive": "HasHashComment HasRustDerive HasMarkdownHeading HasIniComment", "let mut": "HasLet HasLetMut",
        "match": "HasRustMatch", "import (": "HasImport HasGoImportBlock", "(color: red": "HasCssProperty", "$-a:b": "HasScssVar", "(@mixin": "HasAtSymbol HasScssMixin HasLessVarUse",
        "(@include": "HasAtSymbol HasScssInclude HasLessVarUse", "(@extend": "HasAtSymbol HasScssExtend HasLessVarUse", "(#{": "HasHashComment HasScssInterp", "&.": "HasScssNestedAmp", "(@-a:b": "HasAtSymbol HasLessVar HasLessVarUse",
        "(@{": "HasAtSymbol HasLessInterp", "when (": "HasLessGuard", "(@import (": "HasAtSymbol HasImport HasGoImportBlock HasLessImportOpts HasLessVarUse", "(.a (": "HasLessMixinCall", "(@a": "HasAtSymbol HasLessVarUse",
        "Select": "HasSqlSelect", "From": "HasSqlFrom", "Where": "HasSqlWhere", "Create Table": "HasSqlCreateTable", "Insert Into": "HasSqlInsertInto", '{"a":1}': "HasJsonObject", "[a]": "HasIniSection",
        "a = b": "HasMakeAssign HasIniKeyValue", ";": "HasSemicolon HasIniComment", "- ": "HasYamlList HasMarkdownList", "...": "HasYamlDocMarker HasLuaConcat", "a: b": "HasMakeTarget HasYamlKeyValue",
        "#": "HasHashComment HasMarkdownHeading HasIniComment", "* ": "HasMarkdownList", "1. ": "HasMarkdownOrdered", ">": "HasMarkdownQuote", "====": "HasMarkdownUnderlineHeading", "(```": "HasMarkdownFence",
        "](": "HasMarkdownLink", "<?xml": "HasXmlDecl HasAngleQuestion", "xmlns": "HasXmlNs", "Query": "HasGraphQlQuery", "Mutation": "HasGraphQlMutation", "Fragment": "HasGraphQlFragment",
        "(... on": "HasGraphQlSpread HasLuaConcat", "interface": "HasTsInterface", "type": "HasTsTypeAlias", "enum": "HasTsEnum", "as": "HasTsAs", "readonly": "HasTsReadonly",
        "#!": "HasHashComment HasMarkdownHeading HasIniComment HasShebang", "if [": "HasShellIf", "fi": "HasShellFi", "then": "HasShellThen HasLuaThen", "done": "HasShellDone", "$a": "HasDollarVar HasShellVar",
        "use strict": "HasUse HasPerlStrict", "use warnings": "HasUse HasPerlWarnings", "my $": "HasPerlMySigil", "(@ARGV": "HasAtSymbol HasPerlArgv HasLessVarUse", "s/a/b/": "HasPerlRegexSub", "local": "HasLuaLocal",
        "elseif": "HasLuaElseIf", "a..b": "HasLuaConcat", "a <- b": "HasLeftArrow HasRAssign", "library": "HasRLibrary", "data.frame(": "HasRDataFrame HasLessMixinCall", "ggplot(": "HasRGgplot",
        "set.seed(": "HasRSetSeed HasLessMixinCall", "TRUE": "HasRTrueFalse", "FALSE": "HasRTrueFalse", "int main(": "HasMainFunc", "return 0;": "HasSemicolon HasReturnZero", "Imports": "HasVbImports",
        "Module": "HasVbModule", "Sub": "HasVbSub", "End Sub": "HasVbSub HasVbEndSub", "Dim": "HasVbDim", "As": "HasVbAs", "xconst": "", "selfish": "", "a": "", "": "",
    }
    assert {name for names in holds.values() for name in names.split()} == set(rules.RULES)
    df = spark.createDataFrame(list(holds.items()), "t string, want string")
    got = df.select("*", rules.active_rules(F.col("t")).alias("got")).collect()
    assert {r.t: set(r.got) ^ set(r.want.split()) for r in got if set(r.got) != set(r.want.split())} == {}
    for r in got:
        assert r.got == [k for k in rules.RULES if k in r.got]


def test_rules_of_earlier_experiments(spark):
    assert {k: len(v) for k, v in rules.EXPERIMENTS.items()} == {1: 31, 2: 84, 3: 102, 5: 80, 6: 186}
    holds = {
        "xconsts": ("HasConst", "HasConst"), "True None": ("HasNone HasTrueUpper", "HasNoneTC HasTrueTC"), "#!sh": ("", "HasHashBang HasShebang"), " #!sh": ("", ""), " % x": ("", "HasMatlabPercentComment"),
        "x %": ("", ""), "</a": ("", "HasClosingTag"), "</ a": ("", ""), "println!": ("", "HasRustMacro"), "!a": ("", ""), "k-1: v": ("", "HasYamlKeyValue"), "some Data.": ("", "HasAbapData"),
        "fi then": ("", "HasThen HasFi HasFiElse HasLuaThen"), "macro": ("", "HasNemerleMacro HasCrystalMacro HasHaxeMacro"), "attr_reader": ("", "HasRubyAttrAccessor"), "endmodule": ("HasModule", "HasModule HasEndModule"),
    }
    df = spark.createDataFrame([(k, *v) for k, v in holds.items()], "t string, first string, third string")
    got = df.select("*", rules.active_rules(F.col("t"), rules.EXPERIMENTS[1]).alias("a"), rules.active_rules(F.col("t"), rules.EXPERIMENTS[3]).alias("b")).collect()
    for r in got:
        assert (set(r.a), set(r.b)) == (set(r.first.split()), set(r.third.split())), r.t
    assert "HasPythonFString" not in rules.EXPERIMENTS[5] and "HasDiffHeader" not in rules.EXPERIMENTS[5]


def test_systematic_sample_equals_row_numbers(spark):
    """Over many rows, columns and partitions, and with ties and nulls in the order."""
    df = spark.range(400_000).select((F.col("id") * 7919 % 400_000).alias("k"), F.col("id").alias("v"), F.lit("x").alias("w"))
    for parts in (1, 7):
        got = sample.systematic_sample(df.repartition(parts), 4000, "k")
        assert got.columns == df.columns and sorted(r.k for r in got.collect()) == list(range(0, 400_000, 100))
    ties = spark.createDataFrame([(i // 40 if i < 90 else None, i) for i in range(100)], "k int, v int")
    got = [tuple(r) for r in sample.systematic_sample(ties.repartition(3), 9, "k").collect()]
    assert sorted(k for k, _ in got) == [0, 0, 0, 0, 1, 1, 1, 1, 2] and len(set(got)) == 9
    assert sorted(got) == sorted(tuple(r) for r in sample.systematic_sample(ties.coalesce(1), 9, "k").collect())
    assert sample.systematic_sample(ties.where("k > 5"), 3, "k").count() == 0


def test_gini_over_many_values(spark):
    values = np.random.default_rng(3).exponential(size=60_000).round(4)
    got = mining.gini_of(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").first().gini
    x = np.sort(values)
    assert got == pytest.approx((len(x) + 1 - 2 * np.cumsum(x).sum() / x.sum()) / len(x), abs=1e-9)


def test_prefix_predictions_of_a_large_model_plan_fast(spark):
    rng = np.random.default_rng(5)
    m = LinearModel([f"t{i}" for i in range(697)], [f"c{k:02}" for k in range(31)], rng.normal(size=(31, 697)), rng.normal(size=31))
    active = [sorted(rng.choice(697, rng.integers(0, 80), replace=False).tolist()) for _ in range(20)]
    df = spark.createDataFrame([(i, a, m.classes[i % 31]) for i, a in enumerate(active)], "id int, active array<int>, Language string")
    ns = analyze.grid(697, 50)
    started = time.perf_counter()
    preds = analyze.prefix_predictions(df, m, ns, "Language")
    assert time.perf_counter() - started < 5
    want = sorted((n, m.classes[i % 31], m.classes[int((m.intercept + m.coef[:, [j for j in a if j < n]].sum(axis=1)).argmax())]) for i, a in enumerate(active) for n in ns)
    assert sorted(map(tuple, preds.collect())) == want
    got = predict(df, m).orderBy("id").collect()
    for r, a in zip(got, active, strict=True):
        z = m.intercept + m.coef[:, a].sum(axis=1)
        assert r.pred == m.classes[int(z.argmax())] and r.prob == pytest.approx(float((np.exp(z - z.max()) / np.exp(z - z.max()).sum()).max()))


def test_bag_of_words(spark):
    df = spark.createDataFrame([(1, "Über über a BB bb_1 bb"), (2, ""), (3, None), (4, "cc, bb")], "id int, t string")
    assert sorted(map(tuple, features.bag_of_words(df, "id", "t").collect())) == [(1, "bb", 2), (1, "bb_1", 1), (1, "über", 2), (4, "bb", 1), (4, "cc", 1)]
    terms = features.term_vocabulary(df, "t")
    assert sorted(map(tuple, terms.collect())) == [(0, "bb"), (1, "bb_1"), (2, "cc"), (3, "über")]
    got = {r.id: (r.indices, r.counts) for r in features.bag_vectors(df, terms, "id", "t").collect()}
    assert got == {1: ([0, 1, 3], [2, 1, 2]), 2: ([], []), 3: ([], []), 4: ([0, 2], [1, 1])}


def test_greedy_selection(spark):
    rng = np.random.default_rng(8)
    m = LinearModel(list("pqrs"), ["a", "b", "c"], rng.integers(-3, 4, size=(3, 4)).astype(float), np.array([0.5, 0.25, 0.0]))
    rows = [(np.flatnonzero(rng.random(4) < 0.5).tolist(), rng.choice(m.classes)) for _ in range(60)]
    got = analyze.greedy_selection(spark.createDataFrame(rows, "active array<int>, Language string"), m, "Language", 3)

    def f1(chosen):
        preds = [m.classes[int((m.intercept + m.coef[:, [i for i in a if i in chosen]].sum(axis=1)).argmax())] for a, _ in rows]
        truth, scores = [y for _, y in rows], []
        for c in set(truth) | set(preds):
            scores.append(2 * sum(p == y == c for p, y in zip(preds, truth, strict=True)) / (preds.count(c) + truth.count(c)))
        return sum(scores) / len(scores)

    chosen = []
    for i, value in got:
        best = max((j for j in range(4) if j not in chosen), key=lambda j: (round(f1([*chosen, j]), 12), -j))
        chosen.append(best)
        assert i == best and value == pytest.approx(f1(chosen))
    assert len(got) == 3


def test_checks_and_formats(spark):
    assert checks.check_map({"a": "x", "b": None}, ["a", "b", "c"], ["x"]) == {"a": "x"}
    with pytest.raises(ValueError, match=r"unknown keys \['z'\], unknown values \['y'\]"):
        checks.check_map({"z": "y"}, ["a"], ["x"])
    df = spark.createDataFrame([(1.0,), (3.26,), (None,), (float("nan"),), (float("-inf"),)], "x double")
    assert checks.require_rows(df, 5) is df
    with pytest.raises(ValueError, match="5 rows instead of 4"):
        checks.require_rows(df, 4)
    assert tuple(checks.share_of_rows(df, F.col("x") < 2).first()) == (5, 2, 40.0) and tuple(checks.share_of_rows(df.limit(0), F.col("x") < 2).first()) == (0, 0, 0.0)
    assert [tuple(r) for r in df.select(checks.show_number(F.col("x")), checks.show_percent(F.col("x"), 0)).collect()] == [("1.0", "100%"), ("3.3", "326%"), ("—", "—"), ("—", "—"), ("—", "—")]
    told = []
    with checks.Stopwatch("work", told.append) as watch:
        time.sleep(0.01)
    assert 0.01 <= watch.seconds < 5 and watch.per_second(10) == pytest.approx(10 / watch.seconds) and told[0].startswith("work: ")


def test_lookalike_tags_compat(spark):
    strip = lambda t: clean.strip_tag_compat(t, "script")
    for text, want in {"<p><scripts>z": "s>z", "a<script>x</script>b<scripty>c": "a<script></script>y>c", "<scripts>a<script b>c</script>d": "s>a<script b></script>d", "plain": "plain", "x" * 100_000 + "<script>y</script>": "x" * 100_000 + "<script></script>"}.items():
        assert value(spark, text, strip) == want
    df = spark.createDataFrame([("HTML", "<p><scripts>z")], "Language string, Snippet string")
    assert clean.remove_sub_languages(df, compat=True).first().Snippet == "s>z"


def test_model_cache_and_forest_nodes(spark, tmp_path):
    df = spark.createDataFrame([([0], "t a", "x"), ([1], "t b", "y"), ([0, 1], "t c", "x"), ([], "t d", "y")] * 5, "active array<int>, Snippet string, Language string")
    first, hit = train.cached_logistic(df, ["p", "q"], tmp_path, max_iter=20)
    again, hit_again = train.cached_logistic(df, ["p", "q"], tmp_path, max_iter=20)
    assert (hit, hit_again) == (False, True) and again.to_dict() == first.to_dict()
    assert not train.cached_logistic(df, ["p", "q"], tmp_path, max_iter=21)[1] and len(list(tmp_path.iterdir())) == 2
    fitted = train.classifier("random_forest", 2, 2).setNumTrees(3).fit(train.training_rows(df, ["x", "y"], 2, "Language"))
    nodes = train.forest_nodes(fitted).collect()
    assert len(nodes) == fitted.totalNumNodes and {n.tree for n in nodes} == {0, 1, 2}
    ids = {(n.tree, n.id) for n in nodes}
    assert all((n.left == -1) == (n.right == -1) and (n.left == -1 or {(n.tree, n.left), (n.tree, n.right)} <= ids) for n in nodes)


def test_external_classifier_errors(spark):
    script = "import sys, json\nfor x in sys.stdin:\n t = json.loads(x)['snippet']\n if t == 'end': break\n print()\n print(json.dumps({'error': 'no'} if t == 'bad' else {'predicted': t[:1] or None}), flush=True)"
    df = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, None)], "id int, Snippet string").withColumn("error", F.lit("old")).coalesce(1)
    got = {r.id: (r.predicted, r.error) for r in io.external_classifier(df, ["python", "-c", script], "Snippet").collect()}
    assert got == {1: ("a", None), 2: (None, "no"), 3: (None, None)}
    filled = io.external_classifier(df.replace("abc", "end"), ["python", "-c", script], "Snippet", fill="").collect()
    assert [(r.predicted, r.error) for r in filled] == [("", "the process has ended")] * 3
