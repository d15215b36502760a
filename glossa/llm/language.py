"""Language identification with hyperdimensional profiles.

Every letter has a random vector of DIM signs, made from its code point. A trigram binds the vectors of
its letters, permuted by their place, by multiplication; a text bundles its trigrams by addition, and a
language bundles its texts into a prototype. A document's language is that of the most similar
prototype by cosine, after the part that all prototypes share has been taken out of both.

Nulls and odd inputs: null texts and texts without a letter are `und` with score 0 and teach nothing;
rows without a language teach nothing; with nothing to learn from, every text is `und`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import crc_mod_col
from glossa.llm.words import text_batches

DIM = 1024
CACHE = 32_768  # trigram vectors that a worker keeps
BLOCK = 64  # documents scored together
UNKNOWN = "und"
#: A text is no language's if its score is under SLACK times the least of the rows of its size that teach, where those are FEWEST at least.
SLACK, FEWEST = 0.8, 100


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0 (which stands for any gap)."""
    points = np.zeros(0x110000, np.int64)
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] == "L":
            points[cp] = cp
    return points


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of the letters, gaps joined into one, and their counts."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate([[0], points, [0]])
    points = points[(points != 0) | np.concatenate([[True], points[:-1] != 0])]
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:], return_counts=True)


class Space:
    """Vectors of letters and trigrams, made when first met."""

    def __init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((CACHE, DIM), np.int8)

    def letter(self, cp: int) -> np.ndarray:
        if cp not in self.letters:
            self.letters[cp] = np.random.default_rng(cp).integers(0, 2, DIM, dtype=np.int8) * 2 - 1
        return self.letters[cp]

    def bind(self, code: int) -> np.ndarray:
        mask = (1 << 21) - 1
        return np.roll(self.letter(code >> 42), 2) * np.roll(self.letter(code >> 21 & mask), 1) * self.letter(code & mask)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) > CACHE:
            return np.stack([self.bind(c) for c in codes.tolist()])
        if len(self.rows) + len(codes) > CACHE:
            self.rows.clear()
        at = []
        for c in codes.tolist():
            row = self.rows.get(c)
            if row is None:
                row = self.rows[c] = len(self.rows)
                self.table[row] = self.bind(c)
            at.append(row)
        return self.table[at]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(DIM, np.int64)
        for i in range(0, len(codes), 4096):
            total += counts[i : i + 4096] @ self.vectors(codes[i : i + 4096]).astype(np.int64)
        return total


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, teaches: Column) -> dict[str, np.ndarray]:
    """Prototype of each language, from all rows that teach: each task bundles its rows, and only one vector a language leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(), {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def fold(lang: str) -> None:
            codes, at = np.unique(np.concatenate([c for c, _ in held[lang]]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([n for _, n in held.pop(lang)])).astype(np.int64)
            sums[lang] = sums.get(lang, 0) + space.bundle(codes, counts)

        for batch, texts in text_batches(batches, 0):
            for lang, text in zip(batch.column(1).to_pylist(), texts, strict=True):
                codes, counts = trigrams(text.decode())
                if len(codes):
                    held.setdefault(lang, []).append((codes, counts))
                    if len(held[lang]) >= 512:
                        fold(lang)
        for lang in list(held):
            fold(lang)
        rows = [(k, i, int(x)) for k, v in sums.items() for i, x in enumerate(v)]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["lang", "i", "x"])

    taught = docs.where(teaches & F.col(lang_col).isNotNull()).select(text_col, F.col(lang_col).alias("__glossa_lang"))
    sums = taught.mapInArrow(run, "lang string, i int, x long").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    prototypes: dict[str, np.ndarray] = {}
    for lang, i, x in sums.collect():
        prototypes.setdefault(lang, np.zeros(DIM))[i] = x
    return prototypes


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, size: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score), or with `keep` those columns of docs and lang_pred, score; with `size` also a column of that name, the number of trigrams.

    The score is the cosine, at least 0, of what the document and its language have beyond the mean of the prototypes.
    """
    langs = sorted(prototypes)
    unit = np.stack([prototypes[k] / max(np.linalg.norm(prototypes[k]), 1e-9) for k in langs]) if langs else np.empty((0, DIM))
    mean = unit.mean(axis=0) if len(langs) > 1 else np.zeros(DIM)
    shared = mean / max(np.linalg.norm(mean), 1e-9)
    own = unit - np.outer(unit @ shared, shared)
    own = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    shared = shared.astype(np.float32)
    columns = keep if keep is not None else [id_col]
    names = [*(keep if keep is not None else ["doc_id"]), "lang_pred", "score", *([size] if size else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space()
        for batch, texts in text_batches(batches, len(columns)):
            predicted, score, sizes = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for first in range(0, len(texts) if langs else 0, BLOCK):
                grams = [trigrams(t.decode()) for t in texts[first : first + BLOCK]]
                codes, at = np.unique(np.concatenate([c for c, _ in grams]), return_inverse=True)
                row = np.repeat(np.arange(len(grams)), [len(c) for c, _ in grams])
                counts = np.zeros((len(grams), len(codes)), np.float32)
                counts[row, at] = np.concatenate([n for _, n in grams])
                bundles = np.zeros((len(grams), DIM), np.float32)
                for i in range(0, len(codes), 4096):
                    bundles += counts[:, i : i + 4096] @ space.vectors(codes[i : i + 4096]).astype(np.float32)
                bundles -= np.outer(bundles @ shared, shared)
                cosine = bundles @ own.T / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
                best = cosine.argmax(axis=1)
                for i, (c, n) in enumerate(grams):
                    if len(c):
                        sizes[first + i] = n.sum()
                        predicted[first + i] = langs[best[i]]
                        score[first + i] = min(1.0, max(0.0, round(float(cosine[i, best[i]]), 6)))
            yield pa.record_batch([*batch.columns[: len(columns)], pa.array(predicted, pa.string()), pa.array(score, pa.float64()), *([pa.array(sizes)] if size else [])], names=names)

    kept = docs.select(*columns) if keep is not None else docs.select(F.col(id_col).cast("long").alias("doc_id"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema) + "lang_pred string, score double" + (f", `{size}` long" if size else "")
    source = docs.select(*[F.col(c) for c in columns], F.col(text_col).alias("__glossa_text")) if keep is not None else docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return source.mapInArrow(run, schema)


def language_table(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Per document: doc_id, held_out (crc32 of the id modulo `folds` is 0), lang_pred, score; learned from the others."""
    held_out = crc_mod_col(F.col("doc_id"), folds) == 0
    prototypes = learn(docs, "doc_id", "text", "lang", ~held_out)
    return predict(docs, prototypes).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def _size_class(size: Column) -> Column:
    """0 for under 4 trigrams, 1 for under 16, and so on by powers of 4."""
    return F.floor((F.length(F.bin(size)) - 1) / 2).cast("int")


def least_scores(taught: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> dict[int, float]:
    """By size class, the score under which a text is not similar enough; classes with too few rows have none."""
    size = "__glossa_size"
    scored = predict(taught, prototypes, text_col=text_col, keep=[], size=size).where(F.col("lang_pred") != UNKNOWN)
    least = scored.groupBy(_size_class(F.col(size)).alias("class")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    return {r["class"]: SLACK * r["least"] for r in least.collect() if r["n"] >= FEWEST}


def keep_known_languages(docs: DataFrame, least: float = 1e-6, folds: int = 5) -> DataFrame:
    """The rows of `docs`, all their columns, that have a language: not `und`, and not less similar to it than `least` and than texts of their size are.

    The bound of a size comes from the rows that teach (least_scores), so none of them goes; a size with too few of
    them takes the bound of the next smaller size that has one.
    """
    teaches = crc_mod_col(F.col("doc_id"), folds) != 0
    prototypes = learn(docs, "doc_id", "text", "lang", teaches)
    bounds = least_scores(docs.where(teaches & F.col("lang").isNotNull()), prototypes)
    size, inner = "__glossa_size", [f"__glossa_{i}" for i in range(len(docs.columns))]  # the columns may be called lang_pred or score
    judged = predict(docs.toDF(*inner), prototypes, text_col=inner[docs.columns.index("text")], keep=inner, size=size)
    bound = F.lit(least)
    for k in sorted(bounds):
        bound = F.when(_size_class(F.col(size)) >= k, F.lit(max(least, bounds[k]))).otherwise(bound)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= bound)).select(*inner).toDF(*docs.columns)
