"""Evaluating and choosing designs: sets of projects opened within a budget.

A design is scored on all origin-destination pairs at once; many designs are rows of one job. `Problem.score` is the only
place that knows the objective, so greedy, enumeration and the cut loop serve every variant: coverage, piecewise
penalties, weights of representatives, equity weights, a charge per project.
"""

from __future__ import annotations

import heapq
from copy import copy
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import graph
from wayfold.session import checkpointed, cores


@dataclass
class Problem:
    """Base network (src, dst, time), project edges (proj, src, dst, time), project costs (proj, cost), pairs (od_id, orig,
    des, weight) and the worth of a travel time up to `cutoff` (a column of dist, nothing beyond)."""

    base: DataFrame
    project_edges: DataFrame
    costs: DataFrame
    pairs: DataFrame
    cutoff: float
    worth: object = field(default=lambda dist: F.lit(1.0))
    charge: float = 0.0

    def __post_init__(self):
        """Inputs are computed once: every round of a search reads them again."""
        self.base, self.project_edges, self.costs, self.pairs = (checkpointed(d) for d in (self.base, self.project_edges, self.costs, self.pairs))
        base, extra = graph.usable_edges(self.base, self.cutoff, self.project_edges)
        self.edges = graph.small_edges(base), graph.small_edges(extra, "proj")

    @cached_property
    def origins(self) -> DataFrame:
        return checkpointed(self.pairs.select("orig").distinct())

    @cached_property
    def relevant_origins(self) -> DataFrame:
        """(orig, proj): projects that a way from the origin can use within the cutoff, all projects being open. Opening
        any other project changes nothing for the origin's pairs."""
        whole = graph.augment(self.base, self.project_edges.select("src", "dst", "time"))
        ahead = graph.reach(self.origins, whole, self.cutoff).select("orig", F.col("node").alias("src"), "dist")
        used = ahead.join(self.project_edges, "src").filter(F.col("dist") + F.col("time") <= self.cutoff)
        return checkpointed(used.select("orig", "proj").distinct())

    @cached_property
    def base_values(self) -> DataFrame:
        """(od_id, orig, value) of the pairs that the base network connects."""
        far = graph.reach(self.origins, self.base if None in self.edges_known else self.edges[0], self.cutoff)
        return checkpointed(self._worth(far).select("od_id", "orig", "value"))

    def _worth(self, far: DataFrame) -> DataFrame:
        hit = far.join(self.pairs.withColumnRenamed("des", "node"), ["orig", "node"])
        return hit.withColumn("value", F.col("weight") * self.worth(F.col("dist")))

    def with_open(self, opened: list[int]) -> Problem:
        """The problem left once these projects are part of the base network."""
        if not opened:
            return self
        opened = [int(p) for p in opened]
        chosen = F.col("proj").isin(opened)
        self.relevant_origins  # both are the same for all designs, and computed once
        left = copy(self)
        left.__dict__.pop("base_values", None)
        left.__dict__.pop("base_total", None)
        left.base, left.project_edges = graph.augment(self.base, self.project_edges.filter(chosen)), self.project_edges.filter(~chosen)
        if None in self.edges_known:
            left.base = checkpointed(left.base)
        else:
            left.edges = graph.opened_edges(*self.edges, opened)
        return left

    @property
    def edges_known(self) -> tuple:
        return tuple(None if e is None else True for e in self.edges)

    def touched(self, designs: DataFrame) -> DataFrame:
        """(scen, orig): where a design can change anything."""
        return designs.select("scen", F.explode("open").alias("proj")).join(self.relevant_origins, "proj").select("scen", "orig").distinct()

    def _changed(self, designs: DataFrame, touched: DataFrame) -> DataFrame:
        """(scen, od_id, orig, value) of the reached pairs of touched origins; one search per design and touched origin."""
        runs = touched.join(designs.select("scen", "open"), "scen").repartition(2 * cores(designs.sparkSession), "scen", "orig")
        base, extra = (self.base, self.project_edges) if None in self.edges_known else self.edges
        return self._worth(graph.reach_of_designs(runs, base, extra, self.cutoff)).select("scen", "od_id", "orig", "value")

    def values(self, designs: DataFrame) -> DataFrame:
        """(scen, od_id, value) of reached pairs, for designs (scen, open): as many rows as that has. Origins that a design
        cannot change keep their values on the base network."""
        touched = checkpointed(self.touched(designs))
        new = self._changed(designs, touched).select("scen", "od_id", "value")
        if self.base_values.isEmpty():
            return new
        each = designs.agg(F.collect_list("scen").alias("scens"))  # numbers only
        same = self.base_values.crossJoin(F.broadcast(each)).select(F.explode("scens").alias("scen"), "od_id", "orig", "value")
        return new.unionByName(same.join(touched, ["scen", "orig"], "left_anti").select("scen", "od_id", "value"))

    @cached_property
    def base_total(self) -> float:
        return self.base_values.agg(F.sum("value")).first()[0] or 0.0

    def score(self, designs: DataFrame) -> DataFrame:
        """(scen, open, score): the base network's total and what the touched origins gain or lose, less the charge."""
        touched = checkpointed(self.touched(designs))
        new = self._changed(designs, touched).groupBy("scen").agg(F.sum("value").alias("v"))
        by_origin = self.base_values.groupBy("orig").agg(F.sum("value").alias("b"))
        old = touched.join(by_origin, "orig").groupBy("scen").agg(F.sum("b").alias("b"))
        total = F.lit(float(self.base_total)) + F.coalesce("v", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
        return designs.join(new, "scen", "left").join(old, "scen", "left").select("scen", "open", (total - self.charge * F.size("open")).alias("score"))


def _designs(spark, sets: list[list[int]]) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "scen long, open array<long>")


def _score_sets(problem: Problem, sets: list[list[int]]) -> list[float]:
    rows = problem.score(_designs(problem.base.sparkSession, sets)).select("scen", "score").collect()
    by = {r["scen"]: r["score"] for r in rows}
    return [by[i] for i in range(len(sets))]


def candidate_gains(problem: Problem, opened: list[int]) -> DataFrame:
    """(proj, cost, score, gain) of opening each further project; one job over candidates and the origins each can change."""
    now = problem.with_open(opened)
    rest = problem.costs.filter(~F.col("proj").isin(opened)) if opened else problem.costs
    designs = rest.select(F.col("proj").cast("long").alias("scen"), F.array(F.col("proj").cast("long")).alias("open"))
    spent = problem.charge * len(opened)
    scored = now.score(designs).select(F.col("scen").alias("proj"), (F.col("score") - spent).alias("score"))
    return scored.join(rest.select("proj", "cost"), "proj").withColumn("gain", F.round(F.col("score") - F.lit(now.base_total - spent), 9))


def best_candidate(gains: DataFrame, remaining: float, per_cost: bool) -> DataFrame:
    """The affordable project of greatest positive gain (or gain per cost), ties to the smaller number; one row or none."""
    value = F.try_divide(F.col("gain"), F.col("cost")) if per_cost else F.col("gain")
    ok = gains.filter((F.col("cost") > 0) & (F.col("cost") <= remaining) & (F.col("gain") > 0)).withColumn("value", F.round(value, 9))
    return ok.orderBy(F.desc("value"), "proj").limit(1)


def greedy(problem: Problem, budget: float, per_cost: bool = False) -> DataFrame:
    """(step, proj, allocated, score, selected): one project a step while one is affordable and gains."""
    opened, allocated, rows = [], 0.0, []
    while allocated < budget:
        pick = best_candidate(candidate_gains(problem, opened), budget - allocated, per_cost).collect()
        if not pick:
            break
        opened = [*opened, int(pick[0]["proj"])]
        allocated += float(pick[0]["cost"])
        rows.append((len(rows) + 1, opened[-1], allocated, float(pick[0]["score"]), list(opened)))
    return problem.base.sparkSession.createDataFrame(rows, "step int, proj long, allocated double, score double, selected array<long>")


def bounded_greedy(problem: Problem, budget: float, loss, bound: float, widen: float) -> DataFrame:
    """(step, proj, allocated, score, bound, selected): greedy by absolute gain over designs whose `loss` (a function of a
    list of projects) is at most `bound`; where no affordable project that gains meets it, the bound is widened by `widen` and
    the step is searched again."""
    opened, allocated, rows = [], 0.0, []
    while allocated < budget:
        able = candidate_gains(problem, opened).filter((F.col("cost") > 0) & (F.col("cost") <= budget - allocated) & (F.col("gain") > 0))
        order = able.orderBy(F.desc("gain"), "proj").collect()  # projects
        if not order:
            break
        losses = [loss(sorted([*opened, int(r["proj"])])) for r in order]
        while not (fits := [r for r, x in zip(order, losses) if x <= bound]):
            bound += widen
        opened = [*opened, int(fits[0]["proj"])]
        allocated += float(fits[0]["cost"])
        rows.append((len(rows) + 1, opened[-1], allocated, float(fits[0]["score"]), float(bound), list(opened)))
    return problem.base.sparkSession.createDataFrame(rows, "step int, proj long, allocated double, score double, bound double, selected array<long>")


def all_designs(costs: DataFrame, most_projects: int, budget: float) -> DataFrame:
    """(scen, open, cost) of every affordable set of projects; scen is the set as bits. Meant for up to some 15 projects,
    as there are 2^n sets; more than `most_projects` raise. Sets are made in parallel from their numbers."""
    rows = sorted((r["proj"], float(r["cost"])) for r in costs.select("proj", "cost").limit(most_projects + 1).collect())
    if len(rows) > most_projects:
        raise ValueError(f"more than {most_projects} projects to try all sets of")
    spark = costs.sparkSession
    bits = spark.range(2 ** len(rows)).withColumnRenamed("id", "scen")
    has = [F.shiftright("scen", i).bitwiseAND(F.lit(1)) for i in range(len(rows))]
    cost = sum((h * F.lit(c) for h, (_, c) in zip(has, rows)), F.lit(0.0))
    opened = F.array_compact(F.array(*[F.when(h == 1, F.lit(int(p))) for h, (p, _) in zip(has, rows)]))
    return bits.select("scen", opened.alias("open"), cost.alias("cost")).filter(F.col("cost") <= budget)


def enumerate_best(problem: Problem, most_projects: int, budget: float) -> DataFrame:
    """(scen, open, cost, score) of the best affordable design, ties to fewer bits: exact for few projects."""
    designs = checkpointed(all_designs(problem.costs, most_projects, budget))
    scored = problem.score(designs).join(designs.select("scen", "cost"), "scen").withColumn("score", F.round("score", 9))
    return scored.orderBy(F.desc("score"), "scen").limit(1)


def swap_search(problem: Problem, opened: list[int], budget: float, rounds: int = 10) -> tuple[list[int], float]:
    """Exchanges one open for one closed project while that helps; all exchanges of a round are one job."""
    cost = {r["proj"]: float(r["cost"]) for r in problem.costs.collect()}
    score = _score_sets(problem, [opened])[0]
    for _ in range(rounds):
        spent = sum(cost[p] for p in opened)
        sets = [[x for x in opened if x != o] + [n] for o in opened for n in cost if n not in opened and spent - cost[o] + cost[n] <= budget]
        if not sets:
            break
        scores = _score_sets(problem, sets)
        k = max(range(len(sets)), key=lambda i: (scores[i], [-p for p in sorted(sets[i])]))
        if scores[k] <= score + 1e-9:
            break
        opened, score = sorted(sets[k]), scores[k]
    return opened, score


def relevant_projects(problem: Problem) -> DataFrame:
    """(od_id, proj): projects with an edge on some way of a pair within the cutoff, all projects being open. No other
    project can help the pair."""
    whole = graph.augment(problem.base, problem.project_edges.select("src", "dst", "time"))
    ends = problem.pairs.select(F.col("orig").alias("orig")).distinct()
    ahead = graph.reach(ends, whole, problem.cutoff).select("orig", F.col("node").alias("src"), F.col("dist").alias("ahead"))
    back = graph.reach(problem.pairs.select(F.col("des").alias("orig")).distinct(), graph.reverse(whole), problem.cutoff)
    back = back.select(F.col("orig").alias("des"), F.col("node").alias("dst"), F.col("dist").alias("behind"))
    used = ahead.join(F.broadcast(problem.project_edges), "src").join(back, "dst").filter(F.col("ahead") + F.col("time") + F.col("behind") <= problem.cutoff)
    return used.join(problem.pairs.select("od_id", "orig", "des"), ["orig", "des"]).select("od_id", "proj").distinct()


def cut(problem: Problem, relevant: DataFrame, best: DataFrame, opened: list[int], core: dict[int, float] | None = None) -> tuple[float, dict[int, float]]:
    """An upper bound on the score of any design y: constant + sum of slopes of the projects y opens beyond `opened`.

    A pair's value can rise above its value under `opened` only if y opens a relevant closed project, and then at most to
    its value with all projects open (`best`). Slopes are one grouped sum over pairs and relevant projects.
    With `core`, a point inside the budget, each pair takes the one of its two bounds, its gain for every relevant project
    or its best value outright, that is less at that point: no valid choice of the pair bounds cuts deeper there."""
    now = problem.with_open(opened).base_values.select("od_id", "value")
    gain = best.join(now.withColumnRenamed("value", "now"), "od_id", "left").select("od_id", (F.col("value") - F.coalesce("now", F.lit(0.0))).alias("gain")).filter("gain > 1e-12")
    closed = relevant.filter(~F.col("proj").isin(opened)) if opened else relevant
    constant = now.agg(F.sum("value")).first()[0] or 0.0
    if core is not None:
        weight = problem.base.sparkSession.createDataFrame([(int(p), float(y)) for p, y in core.items()], "proj long, y double")
        heavy = closed.join(weight, "proj").groupBy("od_id").agg(F.sum("y").alias("y")).filter("y >= 1").select("od_id")
        gain = checkpointed(gain)
        constant += gain.join(heavy, "od_id", "left_semi").agg(F.sum("gain")).first()[0] or 0.0
        gain = gain.join(heavy, "od_id", "left_anti")
    slopes = gain.join(closed, "od_id").groupBy("proj").agg(F.sum("gain").alias("slope")).collect()
    return constant, {r["proj"]: r["slope"] for r in slopes}


def relaxed(cuts: list[tuple[float, dict[int, float]]], cost: dict[int, float], budget: float) -> tuple[list[int], list[int]]:
    """Designs near the optimum of the relaxed master, whole projects only, by slope per cost: of the mean slopes and of
    the lowest cut alone."""
    def fill(slope: dict[int, float]) -> list[int]:
        room, out = budget, []
        for p in sorted(cost, key=lambda p: (-slope.get(p, 0.0) / max(cost[p], 1e-9), p)):
            if cost[p] <= room and slope.get(p, 0.0) > 0:
                out.append(p)
                room -= cost[p]
        return sorted(out)

    mean: dict[int, float] = {}
    for _, s in cuts:
        for p, x in s.items():
            mean[p] = mean.get(p, 0.0) + x / len(cuts)
    return fill(mean), fill(cuts[-1][1])


def master(cuts: list[tuple[float, dict[int, float]]], cost: dict[int, float], budget: float, charge: float = 0.0) -> tuple[float, list[int]]:
    """The affordable set of the greatest least cut, less the charge: best-first branch and bound over projects."""
    order = sorted(cost, key=lambda p: -max((s.get(p, 0.0) for _, s in cuts), default=0.0) / max(cost[p], 1e-9))

    def bound(at: int, chosen: tuple[int, ...], left: float) -> float:
        worst = float("inf")
        for constant, slope in cuts:
            v, room = constant + sum(slope.get(p, 0.0) for p in chosen), left
            for p in sorted(order[at:], key=lambda p: -slope.get(p, 0.0) / max(cost[p], 1e-9)):
                if room <= 0:
                    break
                part = min(1.0, room / cost[p]) if cost[p] else 1.0
                v += part * slope.get(p, 0.0)
                room -= part * cost[p]
            worst = min(worst, v)
        return worst - charge * len(chosen)

    heap, tick = [(-bound(0, (), budget), 0, 0, (), budget)], 0
    while heap:
        b, _, at, chosen, left = heapq.heappop(heap)
        if at == len(order):
            return -b, sorted(chosen)
        p = order[at]
        for take in (True, False):
            if take and cost[p] > left:
                continue
            nxt, room = ((*chosen, p), left - cost[p]) if take else (chosen, left)
            tick += 1
            heapq.heappush(heap, (-bound(at + 1, nxt, room), tick, at + 1, nxt, room))
    return 0.0, []


def cut_loop(problem: Problem, budget: float, gap: float = 1e-6, strengthen: bool = False, root: int = 0) -> DataFrame:
    """(open, score, bound, rounds): cuts are made in parallel over pairs, the master over projects is solved in the
    driver. Ends when the bound meets the best score, so the design is optimal: every round bounds one more design
    exactly, and there are finitely many. `strengthen` makes two cuts a design, one of them deepest at a core point;
    `root` adds cuts at that many designs near the relaxed optimum before the search, of which those that bind there are kept."""
    spark = problem.base.sparkSession
    cost = {int(r["proj"]): float(r["cost"]) for r in problem.costs.collect() if r["cost"] is not None}
    relevant = checkpointed(relevant_projects(problem))
    best_of = problem.with_open(sorted(cost)).base_values.select("od_id", "value")
    core = {p: min(1.0, budget / (2 * len(cost) * c)) if c else 1.0 for p, c in cost.items()}
    best, top, n, cuts, tried = (float("-inf"), []), float("inf"), 0, [], set()

    def add(opened: list[int]) -> None:
        nonlocal best
        tried.add(tuple(opened))
        constant, slopes = cut(problem, relevant, best_of, opened)
        cuts.append((constant, slopes))
        score = constant - problem.charge * len(opened)
        if score > best[0]:
            best = score, opened
        if strengthen:
            cuts.append(cut(problem, relevant, best_of, opened, core))
            for p in core:  # the core point moves half way to the design
                core[p] = 0.5 * core[p] + 0.5 * (p in opened)

    opened: list[int] = []
    add(opened)
    for _ in range(root):
        fresh = [d for d in relaxed(cuts, cost, budget) if tuple(d) not in tried]
        if not fresh:
            break
        add(fresh[0])
    if root:
        level = lambda c, d: c[0] + sum(c[1].get(p, 0.0) for p in d)
        designs = [list(d) for d in tried]
        cuts[:] = [c for c in cuts if any(level(c, d) <= min(level(o, d) for o in cuts) + gap for d in designs)]
    while True:
        n += 1
        top, opened = master(cuts, cost, budget, problem.charge)
        if top <= best[0] + gap or tuple(opened) in tried:
            break
        add(opened)
    return spark.createDataFrame([(best[1], float(best[0]), float(top), n)], "open array<long>, score double, bound double, rounds int")
