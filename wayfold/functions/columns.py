"""Column functions: penalties, accessibility decay, route scores, vectors. All stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slopes before and after the threshold, and the threshold, of each decay of accessibility with minutes.
DECAY = {"exp": (0.75 / 20, 0.25 / 40, 20), "linear": (1 / 60, 0.0, 60), "rec": (0.001, 0.942 / 2, 58)}


#: First slope, second slope, threshold and cap of the accessibility that similarity graphs are made from, of
#: the synthetic and of the real network.
GRAPH_DECAY = {"synthetic": (0.001, (1 - 0.06) / 10, 60, None), "real": (0.001, (1 - 0.001 * 28) / 2, 28, 30)}


def betas(beta_1: float, limit: float, most: float) -> tuple[float, float, float]:
    """Level beyond `most`, slope up to `limit`, slope from there to reach the level at `most`."""
    return 1.0, beta_1, (1.0 - beta_1 * limit) / (most - limit) if most > limit else 0.0


def penalty(t: Column, beta: tuple[float, float, float], limit: float, most: float) -> Column:
    """Piecewise linear in minutes: both limits inclusive, the full level beyond."""
    return F.when(t <= limit, t * beta[1]).when(t <= most, beta[1] * limit + beta[2] * (t - limit)).otherwise(F.lit(beta[0]))


def decayed_access(t: Column, variant: str, longest: Column, cap: float = 60.0) -> Column:
    """Accessibility left after t minutes; unreachable (null or negative) counts as the longest time; capped."""
    first, second, threshold = DECAY[variant]
    t = F.least(F.when(t.isNull() | (t < 0), longest).otherwise(t), F.lit(cap))
    return 1 - t * first - F.greatest(t - threshold, F.lit(0.0)) * (second - first)


def time_penalty(t: Column, beta: tuple[float, float, float], limit: float) -> Column:
    """Penalty of a matrix entry: negative or null means unreachable and costs the full level."""
    gone = t.isNull() | (t < 0)
    return F.when(gone, F.lit(beta[0])).otherwise(t * beta[1] + F.when(t > limit, (t - limit) * (beta[2] - beta[1])).otherwise(0.0))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a, b) -> Column:
    """1 minus the cosine; null for a vector of length zero."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def euclidean_distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def run_score(covered: Column, alpha: float) -> Column:
    """Sum over maximal runs of true of length * alpha^length, of an array of booleans."""
    start = F.struct(F.lit(0.0).alias("u"), F.lit(0).alias("n"))
    worth = lambda n: n * F.pow(F.lit(alpha), n)
    step = lambda s, c: F.struct(F.when(c, s["u"]).otherwise(s["u"] + worth(s["n"])).alias("u"), F.when(c, s["n"] + 1).otherwise(0).alias("n"))
    return F.aggregate(covered, start, step, lambda s: s["u"] + worth(s["n"]))


def softmax_expectation(v: Column) -> Column:
    """Sum of softmax(v) * v over an array; shifted by its maximum, so large values do not overflow."""
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.zip_with(e, v, lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x) / total


def consecutive_pairs(nodes: Column) -> Column:
    """Neighbouring elements as structs (a, b)."""
    n = F.size(nodes)
    return F.when(n < 2, F.array().cast("array<struct<a:bigint,b:bigint>>")).otherwise(
        F.zip_with(F.slice(nodes, 1, F.greatest(n - 1, F.lit(1))), F.slice(nodes, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")))
    )


def subsequences(nodes: Column) -> Column:
    """All contiguous parts of two elements or more."""
    n = F.size(nodes)
    parts = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(F.lit(2), n - i + 1), lambda k: F.slice(nodes, i, k)))
    return F.when(n < 2, F.array().cast("array<array<bigint>>")).otherwise(F.flatten(parts))


def minutes_to_metres(minutes: Column, km_per_hour: float = 15.0) -> Column:
    return minutes * km_per_hour * 1000 / 60


def metres_to_minutes(metres: Column, km_per_hour: float = 15.0) -> Column:
    return metres / (km_per_hour * 1000 / 60)


def computed_once(df, **values: Column):
    """Adds columns that are computed once a row: the generator keeps the optimiser from moving them into a lambda, where
    they would be computed again for every element."""
    boxed = df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in values.items()]))).alias("__once"))
    return boxed.select(*df.columns, *[F.col(f"__once.{n}").alias(n) for n in values])


def list_literal(text: Column) -> Column:
    """`[1, 2]` to an array of whole numbers; what is not a list gives null, an empty list an empty array."""
    return F.from_json(F.regexp_replace(text, r"\s+", " "), "array<bigint>")
