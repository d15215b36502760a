"""The pipeline's stages on a small corpus, each against the plain version of its operator."""

from pathlib import Path

import corpus_pipeline as P
from glossa.llm import common
from tests.llm.test_operators import SCHEMA, brute_components, brute_lines, rows


def test_stages(spark):
    data = [r for r in rows() if r[0] != 904]
    docs = spark.createDataFrame(data, SCHEMA)
    stage = dict(P.STAGES)
    kept = stage["language"](spark, docs, "")
    assert kept.columns == P.COLUMNS
    gone = {r[0] for r in data} - {r.doc_id for r in kept.collect()}
    assert {900, 901, 902, 907} <= gone
    lined = stage["line_dedup"](spark, docs, "")
    assert lined.columns == P.COLUMNS
    assert sorted((r.doc_id, r.text or "") for r in lined.collect()) == [(d, t) for d, _, _, t in brute_lines([(d, t) for d, t, *_ in data])]
    near = stage["near_dedup"](spark, docs, "")
    assert near.columns == P.COLUMNS and {r.doc_id for r in near.collect()} == {k for k, v in brute_components(data).items() if k == v}
    mixed = stage["mix_sources"](spark, docs, "")
    assert mixed.columns == P.COLUMNS
    packed = stage["pack"](spark, mixed, "")
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_stages_of_an_empty_table_and_of_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in P.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0 and (name == "pack" or out.columns == P.COLUMNS)
    more = spark.createDataFrame([r for r in rows()[:12]], SCHEMA).selectExpr("*", "1 AS score", "2 AS kept", "3 AS component_id", "'x' AS lang_pred", "4 AS n_lines")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, more, "").columns == P.COLUMNS, name


def test_scratch_is_released(spark):
    with common.scratch_scope():
        inner, kept = common.materialize(spark.range(3), "test"), common.materialize(spark.range(3), "test", scoped=False)
    folder = lambda df: Path(df.scratch_path.removeprefix("file://"))
    assert not folder(inner).exists() and kept.count() == 3
    common.release(kept, spark.range(3))
    assert not folder(kept).exists()


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
