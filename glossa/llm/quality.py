"""Quality classifier: a generalised additive model with pairwise interactions.

Features are measured on whole texts. Boosting goes round the features again and again, each time
adding a shallow tree on one feature, so that a lookup table for each feature is left; then trees on
the strongest pairs of features add small two-way tables. A score is a sum of looked-up values.

Nulls and odd inputs: a null text is an empty one; labels that are null or not 0 or 1 and labels of
unknown documents teach nothing; several labels of one document each count; without labels of both
kinds the score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import crc_mod_col, materialize, release
from glossa.llm.words import hash_words, text_batches

FEATURES = [
    "log_bytes", "log_words", "bytes_per_word", "share_letters", "share_digits", "share_upper", "share_symbols", "share_stops", "share_pipes",
    "share_high", "lines_per_word", "entropy", "distinct_words", "top_word", "repeat_next", "share_brackets", "share_common", "run_words",
]
_CLASS = np.zeros(256, np.int64)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9, 10, 11, 12, 13]] = 3
_STOPS, _PIPES, _BRACKETS = list(b".,;:!?"), list(b"|/\\"), list(b"<>[]{}()=")
_SYMBOLS = [c for c in range(33, 127) if _CLASS[c] == 0 and c not in _STOPS]


def measure(texts: list[bytes]) -> np.ndarray:
    """The features of each text, a row each."""
    words, at = hash_words(texts)
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    for i, (text, a, b) in enumerate(zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if not text:
            continue
        n, w = len(text), b - a
        count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        by = np.bincount(_CLASS, count, 4)
        share = count[count > 0] / n
        own = words[a:b]
        each = np.unique(own, return_counts=True)[1] if w else np.zeros(1, int)
        same = own[1:] == own[:-1]
        out[i] = (
            np.log1p(n), np.log1p(w), n / max(w, 1), by[1] / n, by[2] / n, count[65:91].sum() / n, count[_SYMBOLS].sum() / n, count[_STOPS].sum() / max(w, 1), count[_PIPES].sum() / max(w, 1),
            count[128:].sum() / n, count[10] / max(w, 1), -(share * np.log2(share)).sum(), len(each) / max(w, 1), each.max() / max(w, 1), same.mean() if w > 1 else 0, count[_BRACKETS].sum() / n, np.sort(each)[-10:].sum() / max(w, 1), same.sum(),
        )
    return out


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features array<float>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, 1):
            x = measure(texts)
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), pa.float32()))
            yield pa.record_batch([batch.column(0), column], names=["doc_id", "features"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, features array<float>")


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps of the best tree with few leaves over ordered bins, a value for each bin."""
    edges = [0, len(gradient)]
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            cuts = np.arange(a + 1, b)
            if len(cuts):
                gain = value(a, cuts) + value(cuts, b) - value(a, b)
                best = max(best, (float(gain.max()), int(cuts[gain.argmax()])))
        if not best[1]:
            break
        edges = sorted([*edges, best[1]])
    step = np.zeros(len(gradient))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return step


def _table_step(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best cut of a two-way table into four by one cut on each axis."""
    n = len(gradient)
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (gradient, weight))
    i, j = np.meshgrid(np.arange(1, n), np.arange(1, n), indexing="ij")
    quarters = lambda x: (x[i, j], x[i, n] - x[i, j], x[n, j] - x[i, j], x[n, n] - x[i, n] - x[n, j] + x[i, j])
    gain = sum(a**2 / (b + 1) for a, b in zip(quarters(g), quarters(h), strict=True))
    at = np.unravel_index(gain.argmax(), gain.shape)
    values = [a[at] / (b[at] + 1) for a, b in zip(quarters(g), quarters(h), strict=True)]
    step = np.empty((n, n))
    r, c = at[0] + 1, at[1] + 1
    step[:r, :c], step[:r, c:], step[r:, :c], step[r:, c:] = values
    return float(gain.max()), step


class AdditiveModel:
    """Lookup tables of single features and of pairs of them."""

    def __init__(self, bins: int = 32, coarse: int = 8, rounds: int = 150, pairs: int = 8, pair_rounds: int = 50, rate: float = 0.1, leaves: int = 4) -> None:
        self.options = (bins, coarse, rounds, pairs, pair_rounds, rate, leaves)
        self.cuts: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.coarse: list[np.ndarray] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> AdditiveModel:
        bins, coarse, rounds, n_pairs, pair_rounds, rate, leaves = self.options
        if not len(y):
            return self
        w = np.ones(len(y)) if weight is None else weight
        share = float(np.average(y, weights=w))
        if not 0 < share < 1:
            self.base = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
            return self
        self.base = float(np.log(share / (1 - share)))
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        at = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        logit = np.full(len(y), self.base)
        for _ in range(rounds):
            for f, b in enumerate(at):
                p = 1 / (1 + np.exp(-logit))
                step = rate * _tree(np.bincount(b, w * (y - p), len(self.tables[f])), np.bincount(b, w * p * (1 - p), len(self.tables[f])), leaves)
                self.tables[f] += step
                logit += step[b]
        self.coarse = [np.arange(len(t)) * coarse // len(t) for t in self.tables]
        low = [c[b] for c, b in zip(self.coarse, at, strict=True)]
        p = 1 / (1 + np.exp(-logit))
        grid = lambda i, j, v: np.bincount(low[i] * coarse + low[j], v, coarse * coarse).reshape(coarse, coarse)
        gains = sorted(((_table_step(grid(i, j, w * (y - p)), grid(i, j, w * p * (1 - p)))[0], i, j) for i, j in combinations(range(len(at)), 2)), reverse=True)
        self.pairs = [(i, j, np.zeros((coarse, coarse))) for _, i, j in gains[:n_pairs]]
        for _ in range(pair_rounds):
            for i, j, values in self.pairs:
                p = 1 / (1 + np.exp(-logit))
                step = rate * _table_step(grid(i, j, w * (y - p)), grid(i, j, w * p * (1 - p)))[1]
                values += step
                logit += step[low[i], low[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        at = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]
        for b, t in zip(at, self.tables, strict=True):
            logit += t[b]
        for i, j, values in self.pairs:
            logit += values[self.coarse[i][at[i]], self.coarse[j][at[j]]]
        return 1 / (1 + np.exp(-logit))


def fit(features: DataFrame, labels: DataFrame, label_col: str = "quality", most_rows: int = 100_000, folds: int = 4, held: int = 2, **options) -> AdditiveModel:
    """Fit on labelled rows outside the held-out fold, of which a hash takes about `most_rows`, the stated bound of the sample.

    Equal rows, of labels and of labelled documents, are one row that weighs their number, so the bound holds
    where ids repeat. The sampled labels are broadcast; features are not moved before they are few.
    """
    usable = labels.where((crc_mod_col(F.col("doc_id"), folds) != held) & F.col(label_col).isin(0, 1)).groupBy("doc_id", F.col(label_col).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    sample = usable.where(_share(most_rows, usable.count(), F.col("doc_id")))
    found = features.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y", "features").agg(F.sum("n").alias("n"))
    found = materialize(found, "quality-sample")
    rows = found.where(_share(most_rows, found.count(), F.col("doc_id"), F.col("y"), F.col("features"))).toPandas()
    release(found)
    x = np.stack(rows.features.to_list()) if len(rows) else np.empty((0, len(FEATURES)))
    order = np.lexsort((*x.T[::-1], rows.y, rows.doc_id))
    return AdditiveModel(**options).fit(x[order], rows.y.to_numpy(float)[order], rows.n.to_numpy(float)[order])


def _share(most: int, total: int, *columns: Column) -> Column:
    """A hash condition that keeps about `most` of `total` rows, all where there are no more."""
    return F.lit(True) if total <= most else F.pmod(F.xxhash64(*columns, F.lit("fit")), F.lit(1 << 20)) < int(most / total * (1 << 20))


def quality_table(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    features = materialize(feature_table(docs), "quality-features")
    model = fit(features, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            score = np.round(model.score(x), 9)
            yield pa.record_batch([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = features.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (crc_mod_col(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
