"""Mixing sources to target weights by capped water-filling.

A source that cannot fill its share even at its greatest number of repetitions is clamped there; what it leaves free is
given to the others in proportion to their weights, until all targets are feasible. A source's target becomes whole
repetitions of all its documents and one seeded fraction: the documents of lowest seeded hash, up to the missing tokens.
The fraction's last document is found by refining hash bins, so no task sorts or sums a source as a whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.session import checkpointed

#: Sources a mix may name; the plan has one row for each and lives in the driver.
MOST_SOURCES = 10_000
#: Bits of the seeded hash in each round of refinement, and the rounds. 2^24 bins leave few documents to the last sort.
BITS, ROUNDS = 12, 2


@dataclass
class Share:
    source: str
    weight: float  # wanted share, of 1
    max_repeat: int
    available: int  # tokens of one pass
    target: float = 0.0
    whole: int = 0
    rest: float = 0.0  # tokens of the fraction


def water_fill(shares: list[Share], total: float) -> list[Share]:
    """Sets target, whole and rest of each share. If all sources are clamped, the total cannot be reached and stays short."""
    weights = sum(s.weight for s in shares)
    for s in shares:
        s.weight = s.weight / weights if weights else 0.0
    open_, left = [s for s in shares if s.weight > 0], float(total)
    while open_:
        w = sum(s.weight for s in open_)
        full = [s for s in open_ if left * s.weight / w >= s.available * s.max_repeat]
        if not full:
            for s in open_:
                s.target = left * s.weight / w
            break
        for s in full:
            s.target = float(s.available * s.max_repeat)
        left -= sum(s.target for s in full)
        open_ = [s for s in open_ if s not in full]
    for s in shares:
        if s.available:
            s.whole = min(s.max_repeat, math.floor(s.target / s.available + 1e-12))
            s.rest = 0.0 if s.whole == s.max_repeat else max(0.0, s.target - s.whole * s.available)
    return shares


def read_targets(targets: DataFrame) -> list[Share]:
    """The usable rows of (source, weight, max_repeat): no null, weight finite and above 0, at least one repetition.
    Of several rows of one source the one with the greatest weight, then max_repeat, counts."""
    ok = targets.filter("source is not null and weight > 0 and not isnan(weight) and weight < double('infinity') and max_repeat >= 1")
    rows = ok.groupBy("source").agg(F.max(F.struct("weight", "max_repeat")).alias("t")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the mix")
    return [Share(r["source"], float(r["t"]["weight"]), int(r["t"]["max_repeat"]), 0) for r in sorted(rows, key=lambda r: r["source"])]


def plan_mix(sized: DataFrame, targets: DataFrame, total: int | None = None) -> list[Share]:
    """Targets of each source for `total` tokens; None: as many as one pass over all named sources has."""
    shares = read_targets(targets)
    names = sized.sparkSession.createDataFrame([(s.source,) for s in shares], "source string")
    sums = sized.join(F.broadcast(names), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    have = {r["source"]: int(r["n"] or 0) for r in sums}
    for s in shares:
        s.available = have.get(s.source, 0)
    return water_fill(shares, sum(have.values()) if total is None else total)


def _plan_table(spark, shares: list[Share]) -> DataFrame:
    rows = [(s.source, s.weight, s.max_repeat, s.available, s.target, s.whole, s.rest) for s in shares]
    return F.broadcast(spark.createDataFrame(rows, "source string, weight double, max_repeat int, available long, target double, whole int, rest double"))


def mix(sized: DataFrame, shares: list[Share], key: str, seed: int = 7) -> DataFrame:
    """(`key`, source, n_tokens, repeats): the documents used, each at least once.

    `sized` has `key`, source and n_tokens. Documents without tokens, of no source or of a source outside the plan are
    not used. A document of the fraction is taken if its middle token lies within the missing tokens, so the fraction
    misses its target by half a document at most. Equal seeds give equal mixes whatever the order of rows; rows of
    one key that are repeated are taken or left one by one.
    """
    docs = sized.select(key, "source", "n_tokens").filter("n_tokens > 0").join(_plan_table(sized.sparkSession, shares), "source")
    docs = docs.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key).cast("string")))
    open_ = docs.filter("rest > 0")
    before = {s.source: 0 for s in shares if s.rest > 0 and s.available}
    low = dict.fromkeys(before, 0)  # the boundary bin's number, of as many bits as there were rounds
    spark = sized.sparkSession
    bin_of = lambda bits: F.shiftrightunsigned(F.col("__h"), 64 - bits)
    for r in range(1, ROUNDS + 1):
        known = F.broadcast(spark.createDataFrame([(s, low[s], before[s]) for s in before], "source string, __low long, __before long"))
        here = open_.join(known, "source")
        if r > 1:
            here = here.filter(bin_of(BITS * (r - 1)) == F.col("__low"))
        bins = here.groupBy("source", bin_of(BITS * r).alias("b")).agg(F.sum("n_tokens").alias("n"), F.first("__before").alias("at"), F.first("rest").alias("rest"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("b")) + F.col("at")
        # at most 2^BITS bins of a source come to one task
        edge = bins.withColumn("upto", upto).filter("upto >= rest").groupBy("source").agg(F.min(F.struct("b", F.expr("upto - n").alias("before"))).alias("e")).collect()
        for e in edge:
            low[e["source"]], before[e["source"]] = e["e"]["b"], e["e"]["before"]
    bits = BITS * ROUNDS
    edge_rows = [(s, low[s], before[s]) for s in before]
    edges = F.broadcast(spark.createDataFrame(edge_rows, "source string, __low long, __before long"))
    marked = docs.join(edges, "source", "left").withColumn("__bin", bin_of(bits))
    inner = marked.filter(F.col("__bin") == F.col("__low"))
    run = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = inner.withColumn("__extra", (F.col("__before") + run - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    outer = marked.filter(F.col("__low").isNull() | (F.col("__bin") != F.col("__low")))
    outer = outer.withColumn("__extra", F.coalesce((F.col("__bin") < F.col("__low")).cast("int"), F.lit(0)))
    both = outer.unionByName(inner)
    return both.withColumn("repeats", F.col("whole") + F.col("__extra")).filter("repeats > 0").select(key, "source", "n_tokens", "repeats")


def mix_report(mixed: DataFrame, shares: list[Share]) -> DataFrame:
    """Per source: wanted share, tokens there are, target, tokens used, share reached, documents and copies used."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.count("*").alias("documents"), F.sum("repeats").alias("copies"), F.max("repeats").alias("most_repeats"))
    plan = _plan_table(mixed.sparkSession, shares).select("source", F.col("weight").alias("wanted_share"), "max_repeat", F.col("available").alias("available_tokens"), F.col("target").alias("target_tokens"))
    rows = plan.join(used, "source", "left").na.fill(0, ["used_tokens", "documents", "copies", "most_repeats"])
    return rows.withColumn("actual_share", F.try_divide(F.col("used_tokens").cast("double"), F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))))


def sized_documents(documents: DataFrame, keep: list[str], text: str, **tokenizer) -> DataFrame:
    """Documents with their number of tokens, counted once and kept in the shared folder."""
    from wayfold.llm.tokens import count_tokens

    return checkpointed(count_tokens(documents, keep, text, "n_tokens", **tokenizer))
