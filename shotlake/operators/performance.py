"""Query performance: the feature vector of a ranking, its score, advice, and the fit of the model behind it."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import agreement, compactness, probability

#: The features in their order, and the version of a saved model.
FEATURES = ("margin_2", "margin_n", "agreement", "compactness", "confidence", "fallback", "filled")
VERSION = 1


def margin(ranked: DataFrame, depth: int, name: str = "margin", digits: int = 9) -> DataFrame:
    """(query_id, name): how far the score falls from rank 1 to `depth` or the last one, as a share of the first; 0 for fewer than two ranks or a first score that isn't positive."""
    best = F.max_by("score", -F.col("rank"))
    low = F.max_by("score", F.col("rank"))
    agg = ranked.where(F.col("rank") <= depth).groupBy("query_id").agg(best.alias("top"), low.alias("low"), F.count(F.lit(1)).alias("n"))
    fall = F.greatest(F.lit(0.0), (F.col("top") - F.col("low")) / F.col("top"))
    return agg.select("query_id", F.round(F.when((F.col("n") < 2) | (F.col("top") <= 0), 0.0).otherwise(fall), digits).alias(name))


def features(candidates: DataFrame, rankings: DataFrame, specs: DataFrame, videos: DataFrame, channels: list[str], top_k: int, margin_n: int = 10, agreement_n: int = 20, compact_n: int = 10) -> DataFrame:
    """(query_id, FEATURES): one row for each query of specs (query_id, spec); a query without candidates has zeros."""
    n = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    parts = [margin(candidates, 2, "margin_2"), margin(candidates, margin_n, "margin_n"), agreement(rankings, channels, agreement_n), compactness(candidates, videos, compact_n), n]
    out = specs.select("query_id", F.coalesce("spec.confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("spec.source") == "fallback", 1.0).otherwise(0.0).alias("fallback"))
    for p in parts:
        out = out.join(p, "query_id", "left")
    filled = F.least(F.coalesce("n", F.lit(0)) / F.lit(float(top_k)), F.lit(1.0)) if top_k > 0 else F.lit(0.0)
    return out.withColumn("filled", filled).select("query_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES])


class Model(NamedTuple):
    coef: list[float]
    intercept: float
    target_k: int
    xs: list[float] | None = None
    ys: list[float] | None = None

    def saved(self) -> dict:
        return {"artifact_version": VERSION, "feature_names": list(FEATURES), "coef": self.coef, "intercept": self.intercept, "target_k": self.target_k, "calibration": {"x": self.xs, "y": self.ys} if self.xs else None}

    @classmethod
    def read(cls, told: dict) -> Model:
        """A saved model; one of another version or other features is an error."""
        if told.get("artifact_version") != VERSION or tuple(told.get("feature_names", ())) != FEATURES:
            raise ValueError("the model has another version or other features")
        c = told.get("calibration") or {}
        return cls(told["coef"], told["intercept"], told["target_k"], c.get("x"), c.get("y"))


def advise(rows: DataFrame, model: Model, threshold: float, digits: int = 9) -> DataFrame:
    """(query_id, p_hit, target_k, hint) of feature rows; a hint where the probability is below the threshold."""
    p = probability([F.col(c) for c in FEATURES], model.coef, model.intercept, model.xs, model.ys)
    told = rows.select("query_id", F.round(p, digits).alias("p_hit"), F.lit(model.target_k).alias("target_k"))
    text = F.concat(F.lit(f"target unlikely in top {model.target_k} (P="), F.bround(100 * F.col("p_hit")).cast("int").cast("string"), F.lit("%); consider escalating"))
    return told.withColumn("hint", F.when(F.col("p_hit") < threshold, text))


def _fit(x: np.ndarray, y: np.ndarray, c: float, rounds: int = 100) -> np.ndarray:
    """Weights and intercept of a logistic model by Newton steps; the weights are held by an L2 penalty of 1 / (2 c), the intercept is free."""
    z = np.hstack([x, np.ones((len(x), 1))])
    hold = np.diag([1 / c] * x.shape[1] + [0.0])
    w = np.zeros(z.shape[1])

    def loss(v: np.ndarray) -> float:
        m = z @ v
        return float(np.logaddexp(0, m).sum() - y @ m + v @ hold @ v / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ w)))
        slope = z.T @ (p - y) + hold @ w
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + hold + 1e-12 * np.eye(len(w)), slope)
        size = 1.0
        while size > 1e-8 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return w


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of the non-decreasing fit of y over x by pooled neighbours; equal x are one knot."""
    xs, at = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []
    for i in range(len(xs)):
        own = y[at == i]
        blocks.append([float(own.mean()), float(len(own)), i, i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    ys = np.empty(len(xs))
    for value, _, first, last in blocks:
        ys[int(first) : int(last) + 1] = value
    return xs.tolist(), np.clip(ys, 0, 1).tolist()


def train(rows: DataFrame, target_k: int, c: float = 1.0, calibrated: bool = False, most: int = 100_000) -> tuple[Model, float, list[tuple[str, float, float]]]:
    """A model from feature rows with a label `hit`, its leave-one-out Brier score and the probabilities behind it.

    Rows are the cases of a fixture, written by people: more than `most` are an
    error, as is a single label.
    """
    cases = rows.select("query_id", *FEATURES, F.col("hit").cast("double").alias("hit")).orderBy("query_id").limit(most + 1).collect()
    if len(cases) > most:
        raise ValueError(f"more than {most} cases")
    x, y = np.array([[r[f] for f in FEATURES] for r in cases], np.float64), np.array([r.hit for r in cases])
    if len(set(y.tolist())) < 2:
        raise ValueError("hits and misses are both needed")
    w = _fit(x, y, c)
    left = np.arange(len(y))
    loo = []
    for i in left:
        rest = left != i
        if len(set(y[rest].tolist())) < 2:
            loo.append(float(y[rest].mean()))
            continue
        v = _fit(x[rest], y[rest], c)
        loo.append(float(1 / (1 + np.exp(-(x[i] @ v[:-1] + v[-1])))))
    xs, ys = isotonic(np.array(loo), y) if calibrated else (None, None)
    brier = float(np.mean((np.array(loo) - y) ** 2))
    return Model(w[:-1].tolist(), float(w[-1]), target_k, xs, ys), brier, [(r.query_id, p, r.hit) for r, p in zip(cases, loo, strict=True)]
