"""Training: balanced multinomial logistic regression, nearest centroid, and other classifiers of Spark ML."""

from __future__ import annotations

import json
import uuid
import warnings
from pathlib import Path

import numpy as np
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.operators.features import feature_fingerprint, indicator_vectors, presence
from glossa.operators.model import LinearModel, add_at, constant
from glossa.sources.scratch import scratch_root


def class_labels(df: DataFrame, label_col: str) -> list[str]:
    """Distinct labels in order; the label set comes to the driver."""
    return [r[0] for r in df.select(label_col).distinct().orderBy(label_col).collect()]


def training_rows(df: DataFrame, classes: list[str], size: int, label_col: str, active_col: str = "active", shift: float = 0.0) -> DataFrame:
    """features (vector, sparse unless shifted), y (class number) and w (balanced weight n / (k * n of the class))."""
    y = (F.array_position(constant(classes, "array<string>"), F.col(label_col)) - 1).cast("double")
    if shift:
        x = F.transform(presence(active_col, size), lambda b: b.cast("double") - shift)
        rows = df.select(array_to_vector(x).alias("features"), y.alias("y"))
    else:
        rows = indicator_vectors(df.select(active_col, y.alias("y")), active_col, size).select("features", "y")
    counts = df.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n"))  # a row for each class
    weights = counts.select("y", (F.sum("n").over(Window.partitionBy()) / (len(classes) * F.col("n"))).alias("w"))
    return rows.join(F.broadcast(weights), "y")


def train_logistic(df: DataFrame, tokens: list[str], label_col: str = "Language", c: float = 1.0, max_iter: int = 1000, intercept: bool = True, shift: float = 0.0) -> LinearModel:
    """The optimum of the balanced, L2-penalised multinomial log-loss with inverse penalty c."""
    classes = class_labels(df, label_col)
    rows = training_rows(df, classes, len(tokens), label_col, shift=shift).cache()
    try:
        n = max(rows.count(), 1)
        lr = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", family="multinomial", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, fitIntercept=intercept, maxIter=max_iter, tol=1e-9)
        fitted = lr.fit(rows)
    finally:
        rows.unpersist()
    if fitted.summary.totalIterations >= max_iter:
        warnings.warn("logistic regression reached max_iter; raise it or rescale the features", stacklevel=2)
    coef, bias = fitted.coefficientMatrix.toArray(), np.array(fitted.interceptVector.toArray())
    return LinearModel(list(tokens), classes, coef, bias - shift * coef.sum(axis=1))


def cached_logistic(df: DataFrame, tokens: list[str], folder: str | Path, text_col: str = "Snippet", label_col: str = "Language", **options) -> tuple[LinearModel, bool]:
    """train_logistic through a cache of model files, and whether it was a hit; the key holds rows, texts, labels, vocabulary and all options."""
    key = feature_fingerprint(df, [*tokens, json.dumps(options, sort_keys=True)], text_col, label_col)
    path = Path(folder) / f"model-{key}.json"
    if path.exists():
        return LinearModel.load(path), True
    model = train_logistic(df, tokens, label_col, **options)
    path.parent.mkdir(parents=True, exist_ok=True)
    model.save(path)
    return model, False


def forest_nodes(fitted) -> DataFrame:
    """(tree, id, prediction, impurity, gain, left, right, feature, threshold) of a fitted forest or tree: leaves have -1 as left and right.

    Nodes come from the table that the model's own writer makes, in the shared folder.
    """
    spark = SparkSession.active()
    path = f"{scratch_root(spark)}/forest-{uuid.uuid4().hex}"
    fitted.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    flat = data.select(F.col("treeID").alias("tree"), "nodeData.*") if "nodeData" in data.columns else data.select(F.lit(0).alias("tree"), "*")
    return flat.select(
        "tree", "id", "prediction", "impurity", "gain", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )


def centroids(df: DataFrame, size: int, label_col: str = "Language", active_col: str = "active") -> DataFrame:
    """(label, idx, mean) of the features that a class has at all."""
    n = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    hits = df.select(F.col(label_col).alias("label"), F.explode(active_col).alias("idx")).groupBy("label", "idx").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(n, "label").select("label", "idx", (F.col("hits") / F.col("n")).alias("mean"))


def nearest_centroid(df: DataFrame, means: DataFrame, id_col: str, active_col: str = "active") -> DataFrame:
    """(id, pred): the class with the least squared distance, the first on ties. Classes times features must be small."""
    table = sorted(((r.label, r.idx, r["mean"]) for r in means.collect()), key=lambda r: (r[0], r[1]))
    labels = sorted({label for label, _, _ in table})
    weights = np.zeros((max((i for _, i, _ in table), default=0) + 1, len(labels)))
    for label, i, mean in table:
        weights[i, labels.index(label)] = mean
    dots = add_at(F.col(active_col), constant(weights.tolist(), "array<array<double>>"), constant([0.0] * len(labels), "array<double>"))
    norms, names = constant((weights**2).sum(axis=0).tolist(), "array<double>"), constant(labels, "array<string>")
    distances = F.zip_with(F.zip_with(dots, norms, lambda dot, norm: F.round(F.size(active_col) + norm - 2 * dot, 9)), names, lambda d, name: F.struct(d.alias("d"), name.alias("label")))
    return df.select(id_col, F.array_min(distances)["label"].alias("pred"))


def scaler(df: DataFrame, vector_col: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation (1 where it is 0) of an array column."""
    x = F.posexplode(vector_col).alias("i", "x")
    rows = df.select(x).groupBy("i").agg(F.avg("x"), F.stddev_pop("x")).collect()
    mean, std = np.zeros(size), np.ones(size)
    for i, m, s in rows:
        mean[i], std[i] = m, s or 1.0
    return mean, std


def scaled(vector_col: str, mean: np.ndarray, std: np.ndarray) -> Column:
    m, s = (constant(a.tolist(), "array<double>") for a in (mean, std))
    return F.zip_with(F.zip_with(vector_col, m, lambda x, y: x - y), s, lambda x, y: x / y)


def classifier(kind: str, n_features: int, n_classes: int, seed: int = 42):
    """Other estimators by name; all take features, y and, where they can, w."""
    common = {"featuresCol": "features", "labelCol": "y"}
    match kind:
        case "bernoulli_nb":
            return NaiveBayes(modelType="bernoulli", smoothing=1.0, **common)
        case "multinomial_nb":
            return NaiveBayes(modelType="multinomial", smoothing=1.0, **common)
        case "linear_svc":
            return OneVsRest(classifier=LinearSVC(maxIter=20, regParam=1e-3), **common)
        case "log_loss":
            return OneVsRest(classifier=LogisticRegression(maxIter=100), **common)
        case "perceptron":
            return MultilayerPerceptronClassifier(layers=[n_features, n_classes], seed=seed, **common)
        case "random_forest":
            return RandomForestClassifier(numTrees=100, seed=seed, **common)
        case "boosting":
            return OneVsRest(classifier=GBTClassifier(maxIter=20, seed=seed), **common)
    raise ValueError(f"unknown classifier: {kind}")
