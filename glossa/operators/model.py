"""Linear models: scoring as columns, rounding, JSON and compact encodings."""

from __future__ import annotations

import gzip
import json
import struct
from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearModel:
    """coef is (classes, features); a model of two classes has two rows like any other."""

    features: list[str]
    classes: list[str]
    coef: np.ndarray
    intercept: np.ndarray

    def to_dict(self) -> dict:
        return {"features": list(self.features), "classes": list(self.classes), "coef": self.coef.tolist(), "intercept": self.intercept.tolist()}

    @classmethod
    def from_dict(cls, d: dict) -> LinearModel:
        return cls(list(d["features"]), list(d["classes"]), np.asarray(d["coef"], float), np.asarray(d["intercept"], float))

    def rounded(self, decimals: int | None) -> LinearModel:
        """Weights to so many decimals, half to even; negative zeros become zeros; None changes nothing."""
        if decimals is None:
            return self
        return replace(self, coef=np.round(self.coef, decimals) + 0.0, intercept=np.round(self.intercept, decimals) + 0.0)

    def first(self, n: int | None) -> LinearModel:
        return self if n is None else replace(self, features=self.features[:n], coef=self.coef[:, :n])

    def by_importance(self) -> tuple[LinearModel, list[int]]:
        """Features by mean absolute weight, greatest first, ties by place; and their old places."""
        order = np.argsort(-np.abs(self.coef).mean(axis=0), kind="stable")
        return replace(self, features=[self.features[i] for i in order], coef=self.coef[:, order]), order.tolist()

    def json(self, compact: bool = True) -> str:
        return json.dumps(self.to_dict(), separators=(",", ":")) if compact else json.dumps(self.to_dict(), indent=2)

    def save(self, path: str | Path, compact: bool = True) -> Path:
        path = Path(path)
        path.write_text(self.json(compact), encoding="utf-8")
        return path

    @classmethod
    def load(cls, path: str | Path) -> LinearModel:
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    def file_name(self, rows: int) -> str:
        return f"model__N={rows}_F={len(self.features)}_L={len(self.classes)}.json"

    def size_kb(self) -> float:
        return len(gzip.compress(self.json().encode())) / 1024


def compact_values(values: np.ndarray, decimals: int) -> list:
    """Rounded values with whole numbers as integers."""
    small = lambda v: int(v) if float(v).is_integer() else float(v)
    rounded = np.round(values, decimals)
    return [small(v) for v in rounded] if rounded.ndim == 1 else [[small(v) for v in row] for row in rounded]


def constant(values, kind: str) -> Column:
    """Nested lists as one literal: a column for each number would take the driver minutes for large models."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def add_at(places: Column, rows: Column, start: Column) -> Column:
    """start plus the rows at the places, element by element; places without a row add nothing. Places are computed once."""
    return F.aggregate(places, start, lambda a, i: F.coalesce(F.zip_with(a, F.get(rows, i), lambda x, y: x + y), a))


def logits(model: LinearModel, active: Column) -> Column:
    """Intercept plus the weights of the active features, for every class."""
    return add_at(active, constant(model.coef.T.tolist(), "array<array<double>>"), constant(model.intercept.tolist(), "array<double>"))


def softmax(scores: Column) -> Column:
    e = F.transform(F.array(F.array_max(scores)), lambda m: F.transform(scores, lambda s: F.exp(s - m)))[0]
    return F.transform(F.array(e), lambda v: F.transform(F.array(F.aggregate(v, F.lit(0.0), lambda a, y: a + y)), lambda t: F.transform(v, lambda x: x / t))[0])[0]


def first_max(scores: Column) -> Column:
    """Place (from 0) of the greatest score, the first on ties."""
    return F.transform(F.array(scores), lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))[0]


def predict(df: DataFrame, model: LinearModel, active_col: str = "active", text_col: str | None = None, min_length: int = 5) -> DataFrame:
    """Add scores, pred and prob; with text_col, texts of at most min_length characters get no prediction."""
    df = df.withColumn("scores", logits(model, F.col(active_col)))
    names = F.array(*map(F.lit, model.classes))
    gate = F.lit(True) if text_col is None else F.length(text_col) > min_length
    return df.withColumn("pred", F.when(gate, F.element_at(names, first_max(F.col("scores")) + 1))).withColumn("prob", F.when(gate, F.array_max(softmax(F.col("scores")))))


def explain(df: DataFrame, model: LinearModel, id_col: str, active_col: str = "active") -> DataFrame:
    """Per row and class: bias, weight of the active features, score, prob, and the shade between lowest and highest score."""
    scored = df.select(id_col, logits(model, F.col(active_col)).alias("s"))
    spread = F.greatest(F.lit(1e-6), F.array_max("s") - F.array_min("s"))
    scored = scored.withColumn("p", softmax(F.col("s"))).withColumn("alpha", F.transform("s", lambda s: (s - F.array_min("s")) / spread))
    rows = scored.select(id_col, F.posexplode(F.arrays_zip("s", "p", "alpha")).alias("class_idx", "z"))
    name, bias = F.element_at(F.array(*map(F.lit, model.classes)), F.col("class_idx") + 1), F.element_at(F.array(*[F.lit(float(b)) for b in model.intercept]), F.col("class_idx") + 1)
    return rows.select(id_col, "class_idx", name.alias("class"), bias.alias("bias"), (F.col("z.s") - bias).alias("weight"), F.col("z.s").alias("score"), F.col("z.p").alias("prob"), F.col("z.alpha").alias("alpha"))


def encode(model: LinearModel, kind: str, decimals: int = 1, scale: float = 0.1) -> bytes:
    """Weights as bytes: json, json_flat, tsv, tsv_int10, float32, float16, int8 (own scale), int8_fixed (given scale, clipped)."""
    coef, bias = model.coef, model.intercept
    if kind in ("json", "json_flat"):
        rows = compact_values(coef, decimals)
        body = {"coef": rows} if kind == "json" else {"coef": [v for row in rows for v in row], "coef_shape": list(coef.shape)}
        return json.dumps(body | {"intercept": compact_values(bias, decimals)}, separators=(",", ":")).encode()
    if kind in ("tsv", "tsv_int10"):
        show = (lambda v: str(int(round(v * 10)))) if kind == "tsv_int10" else str
        return "\n".join("\t".join(map(show, row)) for row in [compact_values(bias, decimals), *compact_values(coef, decimals)]).encode()
    values = np.concatenate([coef.ravel(), bias]).astype("<f4")
    if kind in ("float32", "float16"):
        return struct.pack("<HH", *coef.shape) + values.astype("<f4" if kind == "float32" else "<f2").tobytes()
    if kind == "int8":
        scale = float(np.abs(values).max()) / 127 or 1.0
    elif kind != "int8_fixed":
        raise ValueError(f"unknown encoding: {kind}")
    return struct.pack("<HHf", *coef.shape, scale) + np.clip(np.round(values / scale), -128, 127).astype(np.int8).tobytes()


def clips(model: LinearModel, scale: float = 0.1) -> bool:
    """Whether int8_fixed loses the size of a weight."""
    q = np.round(np.concatenate([model.coef.ravel(), model.intercept]).astype("<f4") / scale)
    return bool(((q < -128) | (q > 127)).any())


def decode(data: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(coef, intercept) as float32."""
    if kind in ("json", "json_flat"):
        d = json.loads(data)
        return np.array(d["coef"], np.float32).reshape(d.get("coef_shape", np.shape(d["coef"]))), np.array(d["intercept"], np.float32)
    if kind in ("tsv", "tsv_int10"):
        rows = [np.array(line.split("\t"), np.float32) / (10 if kind == "tsv_int10" else 1) for line in data.decode().split("\n")]
        return np.array(rows[1:], np.float32), rows[0]
    k, n = struct.unpack_from("<HH", data)
    if kind in ("float32", "float16"):
        values = np.frombuffer(data, "<f4" if kind == "float32" else "<f2", offset=4).astype(np.float32)
    else:
        values = np.frombuffer(data, np.int8, offset=8).astype(np.float32) * struct.unpack_from("<f", data, 4)[0]
    return values[: k * n].reshape(k, n), values[k * n :]


def compressed_sizes(data: bytes) -> dict[str, int]:
    """Raw, gzip, and where installed zstd and brotli sizes."""
    sizes = {"raw": len(data), "gzip": len(gzip.compress(data))}
    try:
        import zstandard

        sizes["zstd"] = len(zstandard.ZstdCompressor().compress(data))
    except ImportError:
        pass
    try:
        import brotlicffi

        sizes["brotli"] = len(brotlicffi.compress(data))
    except ImportError:
        pass
    return sizes
