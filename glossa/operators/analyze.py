"""Model size against macro F1: curves over the number of features and of decimals, and the ideal size.

All points of a curve are scored in one pass over the rows: a point takes the active features that come
before its size in the order of importance.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators import metrics
from glossa.operators.features import bound
from glossa.operators.model import LinearModel, add_at, constant, first_max, logits
from glossa.operators.sample import hash_order, numbered


def grid(total: int, steps: int) -> list[int]:
    if steps < 2:
        raise ValueError("steps must be at least 2")
    ns = np.rint(np.linspace(1, total, steps)).astype(int).tolist()
    return sorted({1, *ns, total})


def _names(model: LinearModel, place: Column) -> Column:
    return F.get(constant(model.classes, "array<string>"), place)


def prefix_places(model: LinearModel, active: Column, ns: list[int]) -> Column:
    """The class number predicted from the first n features, for each n in order, in one pass: scores grow from one n to the next."""
    rows, start = constant(model.coef.T.tolist(), "array<array<double>>"), constant(model.intercept.tolist(), "array<double>")
    spans = constant([[a, b] for a, b in zip([0, *ns], ns, strict=False)], "array<array<int>>")

    def walk(act: Column) -> Column:
        grow = lambda state, span: F.struct(
            add_at(F.filter(act, lambda i: (i >= span[0]) & (i < span[1])), rows, state["scores"]).alias("scores"),
            F.concat(state["places"], F.array(first_max(state["scores"]))).alias("places"),
        )
        # Each step adds the place of the scores before it, so the first place, of no features, goes.
        end = lambda state: F.slice(F.concat(state["places"], F.array(first_max(state["scores"]))), 2, len(ns))
        return F.aggregate(spans, F.struct(start.alias("scores"), F.array().cast("array<int>").alias("places")), grow, end)

    return bound(active, walk)


def prefix_predictions(df: DataFrame, model: LinearModel, ns: list[int], label_col: str, active_col: str = "active") -> DataFrame:
    """(top, label, pred) for every row and every number of features: the prediction from the first `top` features."""
    ns = sorted(ns)
    places = df.select(F.col(label_col).alias("label"), prefix_places(model, F.col(active_col), ns).alias("places"))
    rows = places.select("label", F.posexplode("places").alias("k", "place"))
    return rows.select(F.get(constant(ns, "array<int>"), F.col("k")).alias("top"), "label", F.get(constant(model.classes, "array<string>"), F.col("place")).alias("pred"))


def f1_curve(df: DataFrame, model: LinearModel, label_col: str, steps: int = 50, decimals: int | None = 1, ns: list[int] | None = None) -> DataFrame:
    """(N, F1, SizeKb) by number of features; model features must be in order of importance."""
    rounded = model.rounded(decimals)
    ns = ns or grid(len(model.features), steps)
    f1 = metrics.macro_f1(prefix_predictions(df, rounded, ns, label_col), "label", "pred", ("top",))
    sizes = df.sparkSession.createDataFrame([(n, rounded.first(n).size_kb()) for n in ns], "top int, SizeKb double")
    return f1.join(F.broadcast(sizes), "top").select(F.col("top").alias("N"), F.col("macro_f1").alias("F1"), "SizeKb")


def rounding_curve(df: DataFrame, model: LinearModel, label_col: str, max_decimals: int = 17, n_features: int | None = None, active_col: str = "active") -> DataFrame:
    """(Decimals, F1, SizeKb, ByteLength) by decimals kept."""
    models = [model.first(n_features).rounded(d) for d in range(max_decimals + 1)]
    near = lambda scores: F.transform(scores, lambda s: F.round(s, 9))  # noqa: E731  sums of decimals that are equal on paper are ties
    per_d = [F.struct(F.lit(d).alias("d"), _names(m, first_max(near(logits(m, F.col(active_col))))).alias("pred")) for d, m in enumerate(models)]
    preds = df.select(F.col(label_col).alias("label"), F.explode(F.array(*per_d)).alias("x")).select("x.d", "label", "x.pred")
    f1 = metrics.macro_f1(preds, "label", "pred", ("d",))
    sizes = df.sparkSession.createDataFrame([(d, m.size_kb(), len(json.dumps(m.to_dict()))) for d, m in enumerate(models)], "d int, SizeKb double, ByteLength long")
    return f1.join(F.broadcast(sizes), "d").select(F.col("d").alias("Decimals"), F.col("macro_f1").alias("F1"), "SizeKb", "ByteLength")


class IdealSize(NamedTuple):
    n: int
    f1: float


def ideal_size(df: DataFrame, model: LinearModel, label_col: str, f1_delta: float = 0.01, decimals: int | None = 1, compat: bool = False, block: int = 64) -> IdealSize:
    """The fewest features, scanning down from all, before macro F1 falls more than f1_delta; sizes are scored a block at a time.

    With compat, f1 is that of the last size looked at, even if it fell too far, and sizes whose last
    weight is zero for all classes take the value of the size above without scoring.
    """
    rounded, total = model.rounded(decimals), len(model.features)
    score = lambda ns: dict(metrics.macro_f1(prefix_predictions(df, rounded, ns, label_col), "label", "pred", ("top",)).collect())
    full = score([total])[total]
    if f1_delta == 0:
        return IdealSize(total, full)
    best, last = IdealSize(total, full), full
    zero = (rounded.coef == 0).all(axis=0)
    for top in range(total, 0, -block):
        ns = list(range(top, max(0, top - block), -1))
        scores = score([n for n in ns if not (compat and zero[n - 1])] or [total])
        for n in ns:
            last = last if compat and zero[n - 1] else scores[n]
            if last < full - f1_delta:
                return IdealSize(best.n, last) if compat else best
            best = IdealSize(n, last)
    return best


def feature_importance(df: DataFrame, model: LinearModel, active_col: str = "active") -> DataFrame:
    """(idx, feature, mean_abs, std_abs, mean_value, occurrences) by feature, greatest mean_abs first."""
    weights = np.abs(model.coef)
    table = df.sparkSession.createDataFrame([(i, f, float(weights[:, i].mean()), float(weights[:, i].std())) for i, f in enumerate(model.features)], "idx int, feature string, mean_abs double, std_abs double")
    hits = df.select(F.explode(active_col).alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("occurrences"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    n = F.coalesce("occurrences", F.lit(0).cast("long"))
    out = table.join(hits, "idx", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("idx", "feature", "mean_abs", "std_abs", (n / F.greatest("total", F.lit(1))).alias("mean_value"), n.alias("occurrences")).orderBy(F.desc("mean_abs"), "idx")


def greedy_selection(df: DataFrame, model: LinearModel, label_col: str, k: int, active_col: str = "active") -> list[tuple[int, float]]:
    """Up to k features, each the one that adds most to macro F1 (the first on ties), with the F1 reached; one pass over the rows for each."""
    rows, start = constant(model.coef.T.tolist(), "array<array<double>>"), constant(model.intercept.tolist(), "array<double>")
    chosen: list[tuple[int, float]] = []
    for _ in range(min(k, len(model.features))):
        taken = [i for i, _ in chosen]
        rest = constant([i for i in range(len(model.features)) if i not in taken], "array<int>")
        held = F.filter(F.col(active_col), lambda i: F.array_contains(constant(taken, "array<int>"), i))  # noqa: B023
        scores = add_at(held, rows, start)
        with_one = lambda s: F.transform(rest, lambda i: F.struct(i.alias("idx"), first_max(F.when(F.array_contains(active_col, i), F.zip_with(s, F.get(rows, i), lambda x, y: x + y)).otherwise(s)).alias("place")))  # noqa: B023, E731
        preds = df.select(F.col(label_col).alias("label"), F.inline(bound(scores, with_one)))
        f1 = metrics.macro_f1(preds.select("idx", "label", _names(model, F.col("place")).alias("pred")), "label", "pred", ("idx",))
        best = f1.orderBy(F.desc(F.round("macro_f1", 12)), "idx").first()
        if best is None:
            break
        chosen.append((best.idx, best.macro_f1))
    return chosen


def bag_curve(vectors: DataFrame, weights: DataFrame, classes: list[str], ns: list[int], label_col: str, id_col: str) -> DataFrame:
    """(N, F1) from the first n terms of a bag of words: vectors(id, label, indices, counts), weights(idx, c, w) with c the class number.

    Weights may be as many as terms times classes, so they are joined; rows without terms score 0 for every class, and the first class wins ties.
    """
    terms = vectors.select(id_col, F.inline(F.arrays_zip("indices", "counts"))).withColumnRenamed("indices", "idx")
    sums = terms.join(weights, "idx").groupBy(id_col, "c").agg(F.array(*[F.sum(F.when(F.col("idx") < n, F.col("counts") * F.col("w")).otherwise(F.lit(0.0))) for n in ns]).alias("s"))
    by_row = sums.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("c", "s"))).alias("m"))
    rows = vectors.select(id_col, F.col(label_col).alias("label")).join(by_row, id_col, "left").select("label", F.posexplode(constant(ns, "array<int>")).alias("k", "top"), "m")
    scores = F.transform(F.sequence(F.lit(0), F.lit(len(classes) - 1)), lambda c: F.coalesce(F.get(F.element_at("m", c), F.col("k")), F.lit(0.0)))
    preds = rows.select("top", "label", F.get(constant(classes, "array<string>"), bound(scores, first_max)).alias("pred"))
    return metrics.macro_f1(preds, "label", "pred", ("top",)).select(F.col("top").alias("N"), F.col("macro_f1").alias("F1"))


def permutation_importance(df: DataFrame, model: LinearModel, label_col: str, id_col: str, active_col: str = "active", seed: str = "42") -> DataFrame:
    """(idx, feature, F1, drop) by feature: macro F1 after its values moved one row on in a hash order, and what that loses.

    Every row is scored once for each feature; idx -1 in between is the model as it is. Ids must be distinct.
    """
    rows = numbered(df.select(id_col, label_col, active_col), [], hash_order(id_col, seed), [id_col])
    before = rows.select((F.col("__i") % F.col("__n") + 1).alias("__i"), F.col(active_col).alias("__other"))
    moved = rows.join(before, "__i").withColumn("idx", F.explode(F.sequence(F.lit(-1), F.lit(len(model.features) - 1))))
    without = F.array_remove(active_col, F.col("idx"))
    values = F.when(F.array_contains("__other", F.col("idx")), F.concat(without, F.array("idx"))).otherwise(without)
    preds = moved.select("idx", F.col(label_col).alias("label"), _names(model, first_max(logits(model, values))).alias("pred"))
    f1 = metrics.macro_f1(preds, "label", "pred", ("idx",))
    whole = f1.where("idx = -1").select(F.col("macro_f1").alias("__whole"))
    table = df.sparkSession.createDataFrame(list(enumerate(model.features)), "idx int, feature string")
    out = table.join(f1, "idx").crossJoin(F.broadcast(whole))  # one row
    return out.select("idx", "feature", F.col("macro_f1").alias("F1"), (F.col("__whole") - F.col("macro_f1")).alias("drop"))
