"""Cross-lingual document classification on topic weights.

One-versus-rest logistic regression with an L2 penalty for every model, class and regularisation
strength at once. A Newton step is one pass over the training rows: every task sums the
gradients and curvatures of all systems over its rows, and the sums of a system, as many numbers
as features squared, come to the driver, which solves it. Rows never leave their tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingospan.operators.metrics import feature_split
from lingospan.operators.sharding import sum_arrays
from lingospan.storage import store

# The inverse regularisation strengths that are tried.
C_GRID = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)
STEPS, FLAT = 60, 1e-9


def _design(features: pd.Series) -> np.ndarray:
    """Feature rows with a column of ones behind them."""
    x = np.stack(features.to_numpy()).astype(np.float64)
    return np.hstack([x, np.ones((len(x), 1))])


def logistic_sums(x: np.ndarray, label: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Curvature, gradient and loss of some rows, one row of sums per system.

    ``label`` is 0 or 1 by row and system, ``weights`` has a row per system.
    """
    score = x @ weights.T
    p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
    loss = np.logaddexp(0, np.where(label == 1, -score, score)).sum(axis=0)
    gradient = (p - label).T @ x
    bend = p * (1 - p)
    curvature = np.stack([((x * bend[:, [s]]).T @ x).ravel() for s in range(weights.shape[0])])
    return np.hstack([curvature, gradient, loss[:, None]])


class Systems:
    """The one-versus-rest systems of one model: a row of weights per class and strength."""

    def __init__(self, classes: list, width: int, grid: Sequence[float]):
        self.classes, self.d = classes, width
        self.c = np.tile(np.asarray(grid, np.float64), len(classes))
        self.class_id = np.repeat(np.arange(len(classes)), len(grid))
        self.weights = np.zeros((len(self.c), width))
        self.base, self.step = self.weights.copy(), self.weights.copy()
        self.objective = np.full(len(self.c), np.inf)
        self.gradient = np.full((len(self.c), width), np.inf)
        self.scale = np.ones(len(self.c))
        self.open = np.ones(len(self.c), bool)

    def labels(self, label: np.ndarray) -> np.ndarray:
        return np.stack([label == self.classes[k] for k in self.class_id], axis=1).astype(np.float64)

    def advance(self, sums: np.ndarray) -> None:
        """One step of every open system: forward by Newton, or half back if the objective rose."""
        d, penalty = self.d, np.append(np.ones(self.d - 1), 0.0)
        for s in np.flatnonzero(self.open):
            curvature, gradient, loss = sums[s, : d * d].reshape(d, d), sums[s, d * d : -1], sums[s, -1]
            objective = self.c[s] * loss + 0.5 * (penalty * self.weights[s] ** 2).sum()
            if objective > self.objective[s] + 1e-9 * abs(self.objective[s]) and self.scale[s] > 1e-6:
                self.scale[s] /= 2
                self.weights[s] = self.base[s] - self.scale[s] * self.step[s]
                continue
            self.gradient[s] = self.c[s] * gradient + penalty * self.weights[s]
            self.objective[s], self.base[s], self.scale[s] = objective, self.weights[s].copy(), 1.0
            if np.abs(self.gradient[s]).max() <= FLAT * max(1.0, loss):
                self.open[s] = False
                continue
            bend = self.c[s] * curvature + np.diag(penalty) + 1e-12 * np.eye(d)
            self.step[s] = np.linalg.solve(bend, self.gradient[s])
            self.weights[s] = self.base[s] - self.step[s]


def fit_logistic(train: DataFrame, keys: Sequence[str], grid: Sequence[float] = C_GRID) -> dict[tuple, Systems]:
    """Fitted systems by model, from ``train(keys…, label, features)``.

    Only models, classes and sums of systems are on the driver. A model whose rows all have one class
    has one class and always predicts it. The intercept bears no penalty.
    """
    keys = list(keys)
    found = train.groupBy(*keys).agg(F.sort_array(F.collect_set("label")).alias("classes"), F.max(F.size("features")).alias("d"))
    models = {tuple(r)[:-2]: Systems(r["classes"], r["d"] + 1, grid) for r in found.collect()}
    for systems in models.values():
        systems.open &= len(systems.classes) > 1
    fields = [train.schema[k] for k in keys] + [T.StructField("system", T.IntegerType())]
    schema = T.StructType([*fields, T.StructField("_order", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    n_buckets = max(1, len(models))

    for _ in range(STEPS):
        if not any(s.open.any() for s in models.values()):
            break

        def partial(batches):
            held: dict[tuple, np.ndarray] = {}
            for pdf in batches:
                for key, rows in pdf.groupby(keys, sort=False):
                    systems = models[key]
                    if systems.open.any():
                        sums = logistic_sums(_design(rows["features"]), systems.labels(rows["label"].to_numpy()), systems.weights)
                        held[key] = held[key] + sums if key in held else sums
            part = TaskContext.get().partitionId()
            for key, sums in held.items():
                out = pd.DataFrame([key] * len(sums), columns=keys)
                yield out.assign(system=np.arange(len(sums)), _order=part, sums=list(sums))

        partials = train.select(*keys, "label", "features").mapInPandas(partial, schema)
        sums = sum_arrays(partials, [*keys, "system"], ["sums"], n_buckets).toPandas()
        for key, rows in sums.groupby(keys, sort=False):
            models[key].advance(np.stack(rows.sort_values("system")["sums"].to_numpy()))
    return models


def fitted_rows(train: DataFrame, keys: Sequence[str], models: dict[tuple, Systems]) -> DataFrame:
    """``(keys…, class, c, feature, weight, gradient)``; the last feature is the intercept."""
    label = train.schema["label"]
    names = [*keys, "class", "c", "feature", "weight", "gradient"]
    rows = []
    for key, s in models.items():
        for i in range(len(s.c)) if len(s.classes) > 1 else []:
            rows += [(*key, s.classes[s.class_id[i]], float(s.c[i]), j, float(s.base[i, j]), float(s.gradient[i, j])) for j in range(s.d)]
    kinds = [T.StructField("class", label.dataType)] + [T.StructField(n, T.IntegerType() if n == "feature" else T.DoubleType()) for n in names[-4:]]
    return train.sparkSession.createDataFrame(rows, T.StructType([train.schema[k] for k in keys] + kinds))


def accuracies(held_out: DataFrame, keys: Sequence[str], models: dict[tuple, Systems]) -> DataFrame:
    """``(keys…, c, part, accuracy)`` of every strength on ``held_out(keys…, part, label, features)``.

    The class of the highest score counts, the first of equal ones.
    """
    keys = list(keys)
    fields = [held_out.schema[k] for k in keys] + [T.StructField("c", T.DoubleType()), T.StructField("part", T.StringType())]
    schema = T.StructType([*fields, T.StructField("hits", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches):
        for pdf in batches:
            for key, rows in pdf.groupby([*keys, "part"], sort=False):
                systems = models.get(key[:-1])
                if systems is None:
                    continue
                grid = np.unique(systems.c)
                score = _design(rows["features"]) @ systems.base.T
                score = score.reshape(len(rows), len(systems.classes), len(grid))
                predicted = np.asarray(systems.classes)[score.argmax(axis=1)]
                hits = (predicted == rows["label"].to_numpy()[:, None]).sum(axis=0)
                out = pd.DataFrame([key[:-1]] * len(grid), columns=keys)
                yield out.assign(c=grid, part=key[-1], hits=hits, n=len(rows))[schema.names]

    counted = held_out.select(*keys, "part", "label", "features").mapInPandas(count, schema)
    return counted.groupBy(*keys, "c", "part").agg((F.sum("hits") / F.sum("n")).alias("accuracy"))


def crosslingual_samples(corpus: DataFrame, src_lang: str, tgt_lang: str, keys: Sequence[str]) -> DataFrame:
    """``(keys…, part, label, features)`` of ``corpus(keys…, lang, class, data_type, theta)``."""
    rows = feature_split(corpus, src_lang, tgt_lang)
    return rows.select(*keys, "part", F.col("class").alias("label"), F.col("theta").cast("array<double>").alias("features"))


def crosslingual_accuracy(samples: DataFrame, keys: Sequence[str], grid: Sequence[float] = C_GRID) -> tuple[DataFrame, DataFrame]:
    """Best strength of every model with its accuracies, and the fitted weights.

    ``samples(keys…, part, label, features)``: source-language train and dev rows, target-language test rows. The
    strength with the best dev accuracy is chosen, the smallest of equal ones. First frame:
    ``(keys…, c, dev_acc, test_acc)``; an accuracy without rows is null.
    """
    keys = list(keys)
    samples = store(samples.filter(F.col("label").isNotNull()), "samples")
    train = samples.filter("part = 'train'")
    models = fit_logistic(train, keys, sorted(grid))
    scores = accuracies(samples.filter("part <> 'train'"), keys, models)
    wide = scores.groupBy(*keys, "c").agg(*[F.max(F.when(F.col("part") == p, F.col("accuracy"))).alias(f"{p}_acc") for p in ("dev", "test")])
    order = W.partitionBy(*keys).orderBy(F.desc_nulls_last("dev_acc"), "c")
    best = wide.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return best, fitted_rows(train, keys, models)
