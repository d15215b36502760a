"""Readers and writers: Parquet, CSV, SQLite, Arrow files, gzip blobs, JSON-lines workers."""

from __future__ import annotations

import gzip
import json
import sqlite3
import subprocess
from collections.abc import Iterator
from contextlib import closing
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema


def read_snippets(spark: SparkSession, path: str, text_col: str = "Snippet", label_col: str = "Language") -> DataFrame:
    """Parquet with the two columns under their common names."""
    df = spark.read.parquet(path)
    return df.withColumnsRenamed({text_col: "Snippet", label_col: "Language"})


def write_snippets(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str, per_task: int = 50_000) -> DataFrame:
    """A query run inside SQLite, each task reading its rows from the file in shared storage, which must not change meanwhile.

    With a JDBC driver on the class path use spark.read.format("jdbc").
    """
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        total = db.execute(f"select count(*) from ({query})").fetchone()[0]
    names = spark.createDataFrame([], schema).columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
            for first in (int(i) for pdf in frames for i in pdf.id):
                yield pd.DataFrame(db.execute(f"select * from ({query}) limit ? offset ?", (per_task, first)).fetchall(), columns=names, dtype=object)

    parts = max(1, -(-total // per_task))
    return spark.range(0, parts * per_task, per_task, numPartitions=parts).mapInPandas(run, schema)


def _arrow_batches(data: pa.Buffer) -> pa.RecordBatchReader | Iterator[pa.RecordBatch]:
    try:
        file = pa.ipc.open_file(data)
        return (file.get_batch(i) for i in range(file.num_record_batches)), file.schema
    except pa.ArrowInvalid:
        stream = pa.ipc.open_stream(data)
        return stream, stream.schema


def read_arrow(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Arrow IPC files or streams, also as saved by dataset libraries; each executor reads its files from shared storage, and only a schema comes to the driver."""
    files = spark.read.format("binaryFile").load(paths).select("content")

    def schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([_arrow_batches(c.as_buffer())[1].serialize().to_pybytes() for c in batch.column(0)], pa.binary())], names=["schema"])

    first = files.limit(1).mapInArrow(schemas, "schema binary").first()
    schema = pa.ipc.read_schema(pa.py_buffer(bytes(first.schema))) if first else pa.schema([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part in _arrow_batches(content.as_buffer())[0]:
                    yield from pa.Table.from_batches([part]).cast(schema).to_batches()

    return files.mapInArrow(run, from_arrow_schema(schema))


def decode_blobs(df: DataFrame, content_col: str = "content", encoding_col: str = "src_encoding") -> DataFrame:
    """Add Snippet: gzip bytes unpacked and decoded with their encoding, utf-8 where it is null; bad bytes are replaced."""

    def decode(content: pd.Series, encoding: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else gzip.decompress(c).decode(e or "utf-8", "replace") for c, e in zip(content, encoding, strict=True)], dtype=object)

    return df.withColumn("Snippet", F.pandas_udf(decode, "string")(content_col, encoding_col))


def external_classifier(df: DataFrame, command: list[str], text_col: str, fill: str | None = None, window: int = 64) -> DataFrame:
    """Add predicted and error: one process a partition reads {"snippet": ...} lines and answers {"predicted": ...} or {"error": ...} lines, in order.

    A null text is sent as an empty one. `window` lines are sent before their answers are read; a process that ends early is an
    error of the rows it left unanswered. With `fill`, rows without a prediction get that value.
    """
    kept = [c for c in df.columns if c not in ("predicted", "error")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        process = None
        for pdf in frames:
            if process is None:
                process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8")
            predicted, errors = [], []
            for first in range(0, len(pdf), window):
                texts = pdf[text_col].iloc[first : first + window]
                try:
                    process.stdin.write("".join(json.dumps({"snippet": t if isinstance(t, str) else ""}) + "\n" for t in texts))
                    process.stdin.flush()
                except BrokenPipeError:
                    pass
                for _ in texts:
                    line = process.stdout.readline()
                    while line.isspace():
                        line = process.stdout.readline()
                    answer = json.loads(line) if line else {"error": "the process has ended"}
                    predicted.append(answer.get("predicted"))
                    errors.append(answer.get("error"))
            yield pdf.assign(predicted=pd.Series(predicted, dtype=object).where(lambda p: p.notna(), fill).to_numpy(), error=errors)
        if process is not None:
            process.stdin.close()
            process.wait()

    return df.select(*kept).mapInPandas(run, df.select(*kept).schema.add("predicted", "string").add("error", "string"))


def write_model_json(text: str, path: str) -> Path:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")
    return p
