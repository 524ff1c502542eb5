"""Small regressions on item vectors: least squares, absolute-error lasso, one hidden layer, nearest items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.similarity import _matrix


def _moments(df: DataFrame, weigh) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wy with an intercept, summed in each partition, one small row a partition to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0))
            x = np.concatenate([np.ones((len(x), 1)), x], 1)
            y = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            w = weigh(x, y)
            part = np.concatenate([(x * w[:, None]).T @ x, ((x * w[:, None]).T @ y)[:, None]], 1)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["m"])

    sums = df.select("vec", F.col("y").cast("double")).mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    flat = np.array([r["v"] for r in sums])
    d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    m = flat.reshape(d, d + 1)
    return m[:, :d], m[:, d]


def least_squares(df: DataFrame, ridge: float = 1e-9) -> np.ndarray:
    """Coefficients, intercept first, of y on vec over all rows."""
    a, b = _moments(df, lambda x, y: np.ones(len(x)))
    return np.linalg.solve(a + ridge * np.eye(len(a)), b)


def absolute_lasso(df: DataFrame, penalty: float, rounds: int = 30, eps: float = 1e-4) -> np.ndarray:
    """Coefficients that minimise mean absolute error plus `penalty` times the absolute coefficients, by iteratively
    reweighted least squares; each round is one pass. Approximates the linear program to about `eps`."""
    n = df.count()
    beta = least_squares(df)
    for _ in range(rounds):
        a, b = _moments(df, lambda x, y, beta=beta: 1 / np.maximum(np.abs(y - x @ beta), eps))
        shrink = n * penalty / np.maximum(np.abs(beta), eps)
        shrink[0] = 0
        new = np.linalg.solve(a + np.diag(shrink) + 1e-9 * np.eye(len(a)), b)
        if np.abs(new - beta).max() < eps:
            return new
        beta = new
    return beta


def predict(df: DataFrame, beta: np.ndarray) -> DataFrame:
    """Adds `prediction`."""
    terms = F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(c)) for c in beta[1:]]), lambda x, c: x.cast("double") * c), F.lit(float(beta[0])), lambda s, x: s + x)
    return df.withColumn("prediction", terms)


def neighbour_mean(train: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """Adds `prediction`: the mean y of the k training items nearest by Euclidean distance."""
    from wayfold.operators.coreset import nearest

    near = nearest(test, train, k, "euclidean").join(train.select(F.col("id").alias("rep"), F.col("y").alias("__y")), "rep")
    return test.join(near.groupBy("id").agg(F.avg("__y").alias("prediction")), "id")


def mean_absolute_error(df: DataFrame) -> float:
    return df.agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]


#: Rows that the hidden-layer model is fitted on at most, taken by hash of their id.
FIT_ROWS = 50_000


def hidden_layer(df: DataFrame, hidden: int = 64, epochs: int = 200, rate: float = 0.01, seed: int = 0, fit_rows: int = FIT_ROWS):
    """Weights of one hidden rectified layer with squared loss, fitted on at most `fit_rows` rows; use with
    `predict_hidden`, which covers all rows."""
    rows = df.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("vec", "y").collect()
    x, y = np.array([r["vec"] for r in rows], float), np.array([r["y"] for r in rows], float)
    rng = np.random.default_rng(seed)
    w1, b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden)
    w2, b2 = rng.normal(0, 1 / np.sqrt(hidden), hidden), float(y.mean())
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w1, b1, w2)] + [[0.0, 0.0]]
    for t in range(1, epochs + 1):
        h = np.maximum(x @ w1 + b1, 0)
        err = 2 * (h @ w2 + b2 - y) / len(y)
        back = np.outer(err, w2) * (h > 0)
        grads = [x.T @ back, back.sum(0), h.T @ err, float(err.sum())]
        new = []
        for s, p, g in zip(state, (w1, b1, w2, b2), grads):
            s[0], s[1] = 0.9 * s[0] + 0.1 * g, 0.999 * s[1] + 0.001 * g * g
            new.append(p - rate * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.999**t)) + 1e-8))
        w1, b1, w2, b2 = new
    return w1, b1, w2, b2


def predict_hidden(df: DataFrame, model) -> DataFrame:
    w1, b1, w2, b2 = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = np.maximum(_matrix(b.column(1)) @ w1 + b1, 0) @ w2 + b2
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p)], names=["id", "y", "prediction"])

    return df.select(F.col("id").cast("long"), "vec", F.col("y").cast("double")).mapInArrow(run, "id long, y double, prediction double")


def bagged_total(items: DataFrame, reps: DataFrame, weights: DataFrame, share: float) -> DataFrame:
    """One row (total, by_weights, by_fit): the target of all items, estimated by a blend of the representatives' weighted
    targets and a fit on the representatives that predicts the rest. `items` and `reps` have id, vec, worth, y."""
    fit = least_squares(reps.select("vec", (F.col("y") * F.col("worth")).alias("y")), ridge=0.1)
    rest = items.join(reps.select("id"), "id", "left_anti")
    fitted = (predict(rest, fit).agg(F.sum("prediction")).first()[0] or 0.0) + (reps.agg(F.sum(F.col("y") * F.col("worth"))).first()[0] or 0.0)
    weighted = weights.join(reps.select(F.col("id").alias("rep"), "y"), "rep").agg(F.sum(F.col("weight") * F.col("y"))).first()[0] or 0.0
    row = (share * weighted + (1 - share) * fitted, weighted, fitted)
    return items.sparkSession.createDataFrame([tuple(map(float, row))], "total double, by_weights double, by_fit double")


def boosted_total(items: DataFrame, reps: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row (total): nearest representative's target for each item, corrected by a fit of the representatives' residuals
    against their own second-nearest neighbours' targets."""
    from wayfold.operators.coreset import nearest

    other = nearest(reps, reps, 2).filter("place = 2").select("id", "rep").join(reps.select(F.col("id").alias("rep"), F.col("y").alias("guess")), "rep")
    residual = reps.join(other.select("id", "guess"), "id").select("vec", (F.col("y") - F.col("guess")).alias("y"))
    fit = least_squares(residual, ridge=1.0)
    guess = items.join(assigned, "id").join(reps.select(F.col("id").alias("rep"), F.col("y").alias("guess")), "rep")
    return predict(guess, fit).agg(F.sum(F.col("worth") * (F.col("guess") + F.when(F.col("id") == F.col("rep"), 0.0).otherwise(F.col("prediction")))).alias("total"))


def regression_weights(items: DataFrame, reps: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """(rep, weight): what each representative's value counts for when the values of all other items are predicted by a
    fit on the representatives. The fit is linear in the values, so predicting and adding up is a weighting:
    own worth + x'(X'X + ridge)^-1 s, s being the sum over the others of worth times vector. A design search on these
    weights therefore optimises the model with the fit inside. `items` and `reps` have id, vec, worth; an intercept is
    added. Weights may be negative."""
    rest = items.join(reps.select("id"), "id", "left_anti")
    full = F.concat(F.array(F.lit(1.0)), F.col("vec").cast("array<double>"))
    s = rest.select("worth", F.posexplode(full).alias("k", "x")).groupBy("k").agg(F.sum(F.col("worth") * F.col("x")).alias("s")).collect()
    a, _ = _moments(reps.select("vec", F.lit(0.0).alias("y")), lambda x, y: np.ones(len(x)))
    total = np.zeros(len(a))
    for r in s:
        total[r["k"]] = r["s"]
    beta = np.linalg.solve(a + ridge * np.eye(len(a)), total)
    return predict(reps, beta).select(F.col("id").alias("rep"), (F.col("prediction") + F.col("worth")).alias("weight"))


def bagged_weights(items: DataFrame, reps: DataFrame, assigned: DataFrame, share: float = 0.5, ridge: float = 1e-6) -> DataFrame:
    """(rep, weight): `share` of the weights by nearest representatives and the rest of those of a fit."""
    from wayfold.operators.coreset import assignment_weights

    near = assignment_weights(items, reps, assigned).select("rep", (F.col("weight") * share).alias("weight"))
    fit = regression_weights(items, reps, ridge).select("rep", (F.col("weight") * (1 - share)).alias("weight"))
    return near.unionByName(fit).groupBy("rep").agg(F.sum("weight").alias("weight"))


def boosted_weights(items: DataFrame, reps: DataFrame, assigned: DataFrame, ridge: float = 1.0) -> DataFrame:
    """(rep, weight): nearest representatives' values corrected by a fit of what each representative's nearest other one
    gets wrong. The fit is linear in the values: with z the pull of the fit on a representative, it counts for its assigned
    potential, plus z, less the z of those whose nearest other one it is."""
    from wayfold.operators.coreset import assignment_weights, nearest

    near = assignment_weights(items, reps, assigned)
    own = reps.select(F.col("id").alias("rep"), "worth")
    pull = regression_weights(items, reps, ridge).join(own, "rep").select("rep", (F.col("weight") - F.col("worth")).alias("z"))
    other = nearest(reps, reps, 2).filter("place = 2").select(F.col("id").alias("rep"), F.col("rep").alias("other")).join(pull, "rep")
    parts = near.unionByName(pull.select("rep", F.col("z").alias("weight"))).unionByName(other.select(F.col("other").alias("rep"), (-F.col("z")).alias("weight")))
    return parts.groupBy("rep").agg(F.sum("weight").alias("weight"))


def fit_loss(values: DataFrame, ridge: float = 1e-6) -> float:
    """Sum of absolute errors of a fit of y on vec."""
    fit = least_squares(values, ridge)
    return predict(values, fit).agg(F.sum(F.abs(F.col("y") - F.col("prediction")))).first()[0] or 0.0
