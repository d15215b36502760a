"""Scoring a stream: the batch columns on an unbounded input, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from glossa.operators.features import with_features
from glossa.operators.model import LinearModel, predict


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def score_stream(stream: DataFrame, model: LinearModel, text_col: str = "Snippet", min_length: int = 5) -> DataFrame:
    return predict(with_features(stream, model.features, text_col), model, text_col=text_col, min_length=min_length).drop("active", "scores")


def write_stream(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
