"""Parameter sweeps: case tables, ranks, Pareto layers and robustness scores."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.operators.ranks import MOST_BROADCAST, checked_broadcast, ordinals
from barlab.operators.tables import written

# Objectives, weights of the score and order of the ranks.
OBJECTIVES = (("total_return", "max"), ("max_drawdown", "max"), ("monthly_worst_return", "max"), ("monthly_return_std", "min"), ("ulcer_index", "min"), ("trade_count", "max"))
WEIGHTS = {"total_return": 0.30, "max_drawdown": 0.22, "monthly_worst_return": 0.15, "monthly_return_std": 0.10, "ulcer_index": 0.08, "return_per_exposure_bar": 0.08, "trade_count": 0.07}
ORDER = (("total_return", False), ("max_drawdown", False), ("monthly_worst_return", False), ("monthly_return_std", True), ("monthly_max_consecutive_losses", True), ("monthly_max_recovery_periods", True), ("trade_count", False), ("case_name", True))


def sweep_cases(spark: SparkSession, grid: Mapping[str, Sequence]) -> DataFrame:
    """The grid's Cartesian product, duplicate values dropped, with a hash of the values as case_id."""
    out = None
    for name, values in grid.items():
        one = spark.createDataFrame([(v,) for v in values], [name]).distinct()
        out = one if out is None else out.crossJoin(one)
    return out.withColumn("case_id", F.sha2(F.to_json(F.struct(*sorted(grid))), 256)).dropDuplicates(["case_id"])


def _scores(table: DataFrame) -> list[Column]:
    sign = {"max": 1, "min": -1}
    return [F.coalesce(F.col(c) * sign[d], F.lit(float("-inf"))) for c, d in OBJECTIVES if c in table.columns]


#: Cases that one task layers; beyond it candidates are thinned and compared over many tasks.
ONE_TASK = 20_000
#: Layers peeled in a round beyond ONE_TASK.
DEPTH = 4


def _layers(scores: np.ndarray, depth: int) -> np.ndarray:
    """The layer of each row (from 1; depth + 1 for all deeper ones) within these rows.

    Values become ranks and rows go by the sum of their ranks, so that what dominates a row comes before it. A layer
    that holds a dominator has one in every layer above, so the row's layer is found by bisection."""
    ranks = np.stack([np.unique(c, return_inverse=True)[1] for c in scores.T], axis=1) if scores.size else np.zeros((len(scores), 0), int)
    fronts: list[np.ndarray] = []
    out = np.full(len(scores), depth + 1)
    for i in np.argsort(-ranks.sum(axis=1), kind="stable"):
        x, low, high = ranks[i], 0, len(fronts)
        while low < high:
            mid = (low + high) // 2
            f = fronts[mid]
            if bool(np.any(np.all(f >= x, axis=1) & np.any(f > x, axis=1))):
                low = mid + 1
            else:
                high = mid
        if low < depth:
            if low == len(fronts):
                fronts.append(np.empty((0, len(x)), ranks.dtype))
            if not (len(fronts[low]) and bool(np.any(np.all(fronts[low] == x, axis=1)))):
                fronts[low] = np.vstack([fronts[low], x])
            out[i] = low + 1
    return out


def _layered(cases: DataFrame, depth: int) -> DataFrame:
    """_key, _s and layer (at most depth) of the cases in the first layers of their own partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if rows:
            all_ = pd.concat(rows, ignore_index=True)
            layer = _layers(np.array(all_["_s"].tolist(), float), depth)
            yield all_.assign(layer=layer)[layer <= depth]

    return cases.select("_key", "_s").mapInPandas(run, f"_key {dict(cases.dtypes)['_key']}, _s array<double>, layer int")


def _front(cases: DataFrame, count: int) -> DataFrame:
    """The first layer of many cases: each chunk of them that can be broadcast takes out what it dominates."""
    dims = range(len(cases.first()["_s"]))
    left = cases
    placed = ordinals(cases, [], ["_key"]) if count > MOST_BROADCAST else cases.withColumn("place", F.lit(0))
    for k in range(-(-count // MOST_BROADCAST)):
        chunk = placed.where(F.floor(F.col("place") / MOST_BROADCAST) == k).select(F.col("_s").alias("_b"))
        beaten = _all([F.col("_b")[i] >= F.col("_s")[i] for i in dims]) & _any([F.col("_b")[i] > F.col("_s")[i] for i in dims])
        left = written(left.join(F.broadcast(chunk), beaten, "left_anti"))
    return left


def pareto_ranks(table: DataFrame, key: str = "case_name", one_task: int = ONE_TASK, depth: int = DEPTH) -> DataFrame:
    """table with pareto_rank: the layer of each case once the layers before it are peeled off.

    A case dominates another if it is at least as good on all objectives and better on one. Few cases are layered in one
    task. Of many, each partition keeps its own first `depth` layers, which hold all cases of the first `depth` layers
    over all, as what dominates these is in them too; only these candidates are compared further, then peeled. So pairs
    grow with the fronts, none is stored, and no task holds more than `one_task` cases or its share of them."""
    cases = written(table.select(F.col(key).alias("_key"), F.array(*_scores(table)).alias("_s")))
    left, done, ranks = cases, 0, None

    def ranked(layers: DataFrame) -> DataFrame:
        more = layers.select("_key", (F.col("layer") + done).alias("pareto_rank"))
        return more if ranks is None else ranks.unionByName(more)

    while (count := left.count()) > 0:
        if count <= one_task:
            ranks, left = ranked(_layered(left.coalesce(1), count)), left.limit(0)
            break
        near = written(_layered(left.repartition(-(-count // one_task)), depth).drop("layer"))
        if (found := near.count()) <= one_task:
            layers = written(_layered(near.coalesce(1), depth))
            ranks, taken, steps = ranked(layers), layers.select("_key"), depth
        else:
            layers = _front(near, found).withColumn("layer", F.lit(1))
            ranks, taken, steps = ranked(layers), layers.select("_key"), 1
        left, done = written(left.join(taken, "_key", "left_anti")), done + steps
    if ranks is None:
        return table.withColumn("pareto_rank", F.lit(1))
    return table.join(ranks, table[key] == ranks["_key"]).drop("_key")


def pareto_layer(table: DataFrame, key: str = "case_name") -> DataFrame:
    """The cases that no other case dominates."""
    return pareto_ranks(table, key).where("pareto_rank = 1").drop("pareto_rank")


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def dominance(table: DataFrame, key: str = "case_name") -> DataFrame:
    """(better, worse) for all pairs of cases of which one dominates the other: as asked, a product of grid points."""
    n = len(_scores(table))
    a = table.select(F.col(key).alias("worse"), F.array(*_scores(table)).alias("_a"))
    b = table.select(F.col(key).alias("better"), F.array(*_scores(table)).alias("_b"))
    at = range(n)
    no_less, more = _all([F.col("_b")[i] >= F.col("_a")[i] for i in at]), _any([F.col("_b")[i] > F.col("_a")[i] for i in at])
    return a.join(b, (F.col("better") != F.col("worse")) & no_less & more).select("better", "worse")


#: Pairs of cases that one task compares.
PAIRS = 50_000_000


def dominated_counts(table: DataFrame, key: str = "case_name", chunk: int = MOST_BROADCAST, pairs: int = PAIRS) -> DataFrame:
    """(better, dominated): how many cases each case dominates; cases that dominate none are left out.

    The work is all pairs, but none is stored: cases are spread so that a task compares at most about `pairs` of them, each
    with a broadcast chunk of the others, and counts where it compares. Seconds grow with the square of the cases, a
    task's memory only up to a chunk."""
    at = range(len(_scores(table)))
    cases = written(table.select(F.col(key).alias("better"), *(s.alias(f"_{i}") for i, s in enumerate(_scores(table)))))
    count = cases.count()
    placed = written(ordinals(cases, [], ["better"])) if count > chunk else cases.withColumn("place", F.lit(0))
    tasks = max(1, -(-count * min(count, chunk) // pairs))
    spread = cases.repartition(tasks) if tasks > 1 else cases
    found = None
    for k in range(max(1, -(-count // chunk))):
        others = placed.where(F.floor(F.col("place") / chunk) == k).select(F.col("better").alias("worse"), *(F.col(f"_{i}").alias(f"_w{i}") for i in at))
        beats = _all([F.col(f"_{i}") >= F.col(f"_w{i}") for i in at]) & _any([F.col(f"_{i}") > F.col(f"_w{i}") for i in at]) & (F.col("better") != F.col("worse"))
        one = spread.join(F.broadcast(others), beats).groupBy("better").agg(F.count("*").alias("dominated"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("better").agg(F.sum("dominated").alias("dominated"))


_FALLING = ("monthly_return_std", "ulcer_index")


def risk_adjusted_scores(table: DataFrame, key: str = "case_name") -> DataFrame:
    """Adds risk_adjusted_score, 0 to 100: weighted percentiles less a penalty for failed diagnostics.

    A percentile is the average rank over the count of known values; 1 if all are equal, a half if unknown. All metrics
    are ranked in one pass by range; the ranks of equal values follow from their first and last place."""
    table = written(table)
    metrics = [c for c in WEIGHTS if c in table.columns and c != "trade_count"]
    weight = F.element_at(F.array(*(F.lit(float(WEIGHTS[c])) for c in metrics)), F.col("_m") + 1) if metrics else F.lit(0.0)
    value = lambda c: F.col(c).cast("double") * (-1.0 if c in _FALLING else 1.0)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("m"), value(c).alias("x")) for i, c in enumerate(metrics)))) if metrics else F.lit(None)
    score = table.select(F.col(key).alias("_key"), F.lit(0.0).alias("_part"), F.lit(0.0).alias("_known"))
    if metrics:
        long = table.select(F.col(key).alias("_key"), each.alias("e")).select("_key", F.col("e.m").alias("_m"), F.col("e.x").alias("_x")).where("_x IS NOT NULL")
        at = written(ordinals(long, ["_m"], ["_x"]))
        equal = written(at.groupBy("_m", "_x", "total").agg(((F.min("place") + F.max("place")) / 2 + 1).alias("_rank"), F.count("*").alias("_same")))
        share = F.when(F.col("_same") == F.col("total"), 1.0).otherwise(F.col("_rank") / F.col("total"))
        parts = at.drop("place", "total").join(checked_broadcast(equal), ["_m", "_x"]).groupBy("_key").agg(F.sum(weight * share).alias("_part"), F.sum(weight).alias("_known"))
        score = table.select(F.col(key).alias("_key")).join(parts, "_key", "left").fillna(0.0)
    rest = sum(w for c, w in WEIGHTS.items() if c != "trade_count") + (0 if "trade_count" in table.columns else WEIGHTS["trade_count"])
    total = F.col("_part") + 0.5 * (F.lit(rest) - F.col("_known"))
    if "trade_count" in table.columns:
        n = F.greatest(F.coalesce(F.col("trade_count").cast("double"), F.lit(0.0)), F.lit(0.0))
        most = table.agg(F.max(n)).first()[0] or 0.0
        total = total + WEIGHTS["trade_count"] * (F.log1p(n) / math.log1p(most) if most > 0 else F.lit(0.0))
    d = [(F.coalesce(F.col(c), F.lit(0)) if c in table.columns else F.lit(0)) * k for c, k in (("diagnostic_failed_count", 15), ("diagnostic_attention_count", 6), ("diagnostic_max_severity", 8))]
    penalty = F.least(d[0] + d[1] + d[2], F.lit(45))
    scored = table.join(score, table[key].eqNullSafe(score["_key"]))
    return scored.withColumn("risk_adjusted_score", F.round(F.least(F.greatest(total * 100 - penalty, F.lit(0.0)), F.lit(100.0)), 6)).drop("_key", "_part", "_known")


def numbered(table: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """table with each row's number from 1 in a global order, in two passes."""
    return ordinals(table, [], order, "_place", "_total").withColumn(name, (F.col("_place") + 1).cast("int")).drop("_place", "_total")


def sweep_order(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in ORDER if c in columns]


def risk_ranks(scored: DataFrame) -> DataFrame:
    return numbered(scored, [F.desc("risk_adjusted_score"), F.col("case_name")], "risk_adjusted_rank")


def rank_sweep(table: DataFrame) -> DataFrame:
    """Adds sweep_rank, pareto_rank, is_pareto_efficient, risk_adjusted_score and risk_adjusted_rank; ties go by case name."""
    t = risk_adjusted_scores(pareto_ranks(written(table))).withColumn("is_pareto_efficient", F.col("pareto_rank") == 1)
    return risk_ranks(numbered(written(t), sweep_order(t.columns), "sweep_rank"))


def parameter_summary(table: DataFrame, parameters: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """For each value of each parameter: cases, share of Pareto-efficient ones (if ranked), mean, median and deviation of
    the metrics, and the best case by the first of them."""
    pairs = F.array(*(F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("value")) for p in parameters))
    rows = table.select("*", F.explode(pairs).alias("p"))
    aggs = [f(m) for m in metrics for f in (lambda m: F.avg(m).alias(f"avg_{m}"), lambda m: F.expr(f"percentile({m}, 0.5)").alias(f"median_{m}"), lambda m: F.stddev_pop(m).alias(f"std_{m}"))]
    hits = [F.avg(F.col("is_pareto_efficient").cast("double")).alias("pareto_hit_rate")] if "is_pareto_efficient" in table.columns else []
    return rows.groupBy("p.parameter", "p.value").agg(F.count("*").alias("cases"), *hits, *aggs, F.max_by("case_name", F.struct(F.col(metrics[0]), F.col("case_name"))).alias("best_case"))
