"""A market table on disk: Parquet partitioned by timeframe and shard, a shard being a hash of the symbol.

Readers of a timeframe and of some symbols list only their partitions; upserts read and rewrite only the partitions
whose bars change, by dynamic partition overwrite, and a repeated one writes nothing. Within a partition, files are
cut by range of symbol and date, so that a symbol with most of the bars has many files rather than one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.operators import bars as B
from barlab.operators.catalog import KEYS, BacktestData, backtest_data, load_bars
from barlab.operators.audit import refill_plan
from barlab.operators.tables import shuffles_freed, written

#: Partitions of one timeframe. It bounds what the driver learns about touched partitions.
SHARDS = 64
#: Held and new bars that one step of an upsert deals out and rewrites. It bounds what it shuffles, and what is on disk twice.
MOST_ROWS = 60_000_000
#: Keys (two short texts) that a refill looks up in each task.
MOST_KEYS = 1_000_000
_LAYOUT = ["timeframe", "shard"]
#: Given to readers: from folder names alone, the timeframe 1d would be read as the number 1.
SCHEMA = "date timestamp_ntz, stock_code string, open double, high double, low double, close double, volume double, amount double, timeframe string, shard int"


def shard(symbol: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(shards)).cast("int")


def _typed(bars: DataFrame, shards: int) -> DataFrame:
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    return bars.select(*(F.col(c).cast(kinds[c]).alias(c) for c in ("timeframe", *B.COLUMNS))).withColumn("shard", shard(F.col("stock_code"), shards))


def _placed(bars: DataFrame, shards: int) -> DataFrame:
    order = ["timeframe", "shard", "stock_code", "date"]
    return _typed(bars, shards).repartitionByRange(*order).sortWithinPartitions(*order)


def write_market(bars: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """Writes bars (timeframe and the canonical columns) as a new market table."""
    with shuffles_freed(bars.sparkSession):
        _placed(bars, shards).write.partitionBy(*_LAYOUT).parquet(folder)


def read_market(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def _these(parts: Sequence[tuple[str, int]]) -> Column:
    """Whether a row is in one of the partitions: one test a timeframe, of partition columns only."""
    by: dict[str, list[int]] = {}
    for timeframe, s in parts:
        by.setdefault(timeframe, []).append(s)
    return reduce(lambda a, b: a | b, ((F.col("timeframe") == t) & F.col("shard").isin(*sorted(s)) for t, s in sorted(by.items())), F.lit(False))


def _partitions(keys: DataFrame, shards: int) -> list[tuple[str, int]]:
    """The partitions of the keys; at most `shards` for each timeframe, so they fit the driver."""
    return [(r.timeframe, r.shard) for r in keys.select("timeframe", shard(F.col("stock_code"), shards).alias("shard")).distinct().collect()]


def pruned(market: DataFrame, symbols: DataFrame, timeframes: Sequence[str], shards: int = SHARDS) -> DataFrame:
    """The market's partitions that can hold the symbols' bars of the timeframes."""
    wanted = [r.shard for r in symbols.select(shard(F.col("stock_code"), shards).alias("shard")).distinct().collect()]
    return market.where(_these([(t, s) for t in timeframes for s in wanted]))


def load(market: DataFrame, timeframe: str, symbols: DataFrame, start: str = "", end: str = "", shards: int = SHARDS) -> DataFrame:
    """The symbols' bars of one timeframe within whole days start to end, from their own partitions."""
    return load_bars(pruned(market, symbols, [timeframe], shards), timeframe, symbols, start, end)


def load_backtest(
    market: DataFrame, timeframes: Sequence[str], symbols: DataFrame, start: str, end: str, *, filter_limit_open: bool = True, daily_lookback_days: int = 10, strict: bool = True, min_coverage: float | None = None, shards: int = SHARDS
) -> BacktestData:
    """Bars of the timeframes without illiquid bars and without sessions that open at the limit.

    Daily bars are read from `daily_lookback_days` before start, which has to hold the last close before it. A strict
    run raises where an audit fails."""
    if daily_lookback_days < 1:
        raise ValueError("the daily lookback is a day at least")
    before = market.sparkSession.sql(f"SELECT cast(date_sub(DATE '{start}', {daily_lookback_days}) AS string) AS day").first()["day"]
    daily = load(market, "1d", symbols, before, end, shards)
    parts = [load(market, t, symbols, start, end, shards).withColumn("timeframe", F.lit(t)) for t in timeframes]
    return backtest_data(reduce(DataFrame.unionByName, parts), daily, symbols, start, end, filter_limit_open, strict, min_coverage)


def _sizes(new: DataFrame, held: DataFrame, shards: int) -> dict[tuple[str, int], tuple[int, bool]]:
    """For each partition of the new bars: its new and held bars together, and whether some symbol has more new bars than
    held ones. Then, as new bars are one a key, one of them is not held."""
    both = new.select(*KEYS, F.lit(1).alias("_new"), F.lit(0).alias("_held")).unionByName(held.select(*KEYS, F.lit(0).alias("_new"), F.lit(1).alias("_held")))
    each = both.groupBy(*KEYS).agg(F.sum("_new").alias("_new"), F.sum("_held").alias("_held")).withColumn("shard", shard(F.col("stock_code"), shards))
    rows = each.groupBy(*_LAYOUT).agg(F.sum(F.col("_new") + F.col("_held")).alias("rows"), F.max(F.col("_new") > F.col("_held")).alias("more")).collect()
    return {(r.timeframe, r.shard): (r.rows, r.more) for r in rows}


def _batches(rows: dict[tuple[str, int], int], most: int) -> list[list[tuple[str, int]]]:
    """The partitions in order, in batches of at most `most` rows or of one partition."""
    out, held = [], 0
    for part, n in sorted(rows.items()):
        if not out or held + n > most:
            out.append([])
            held = 0
        out[-1].append(part)
        held += n
    return out


def _merged(held: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """Held and new bars, of equal keys the new one, dealt and sorted once as the table is written."""
    both = _typed(held, shards).withColumn("_new", F.lit(0)).unionByName(_typed(new, shards).withColumn("_new", F.lit(1)))
    key = ["timeframe", "shard", "stock_code", "date"]
    placed = both.repartitionByRange(*key).sortWithinPartitions(*key, F.desc("_new"))
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new")))
    return placed.withColumn("_rn", last).where("_rn = 1").drop("_rn", "_new")


def upsert(spark: SparkSession, folder: str, new: DataFrame, shards: int = SHARDS, stored: bool = False, most_rows: int = MOST_ROWS) -> list[tuple[str, int]]:
    """Puts new bars (timeframe and the canonical columns; one a symbol, timeframe and date) into the table; they replace
    bars of their keys. Returns the partitions that it rewrote: those with a bar that is new or differs.

    New bars are written first, as they are read several times; not if `stored`, which says that they are on disk or
    little work to make from a table there. Bars are compared one by one only in partitions that the symbols' counts
    leave open. Partitions are rewritten in batches of at most `most_rows` held and new bars, from the table itself:
    Spark deletes the old files of a partition once all new ones are written."""
    new = new.select("timeframe", *B.COLUMNS)
    new = new if stored else written(new)
    near = _partitions(new, shards)
    if not near:
        return []
    own = new.withColumn("shard", shard(F.col("stock_code"), shards))
    sizes = _sizes(new, read_market(spark, folder).where(_these(near)), shards)
    touched = [p for p in near if sizes[p][1]]
    if unsure := [p for p in near if not sizes[p][1]]:
        as_they_are = reduce(lambda a, b: a & b, (F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in ["timeframe", *B.COLUMNS]))
        changed = own.where(_these(unsure)).alias("new").join(read_market(spark, folder).where(_these(unsure)).alias("old"), as_they_are, "left_anti")
        touched += _partitions(changed.select("new.*"), shards)
    for parts in _batches({p: sizes[p][0] for p in touched}, most_rows):
        rows = _merged(read_market(spark, folder).where(_these(parts)), own.where(_these(parts)), shards)
        with shuffles_freed(spark):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_LAYOUT).parquet(folder)
    return touched


def update(spark: SparkSession, folder: str, staging: DataFrame, timeframe: str, start: str = "", end: str = "", shards: int = SHARDS) -> list[tuple[str, int]]:
    """Upserts one timeframe's staged bars of the window."""
    return upsert(spark, folder, load_bars(staging, timeframe, None, start, end).withColumn("timeframe", F.lit(timeframe)), shards)


def refill(spark: SparkSession, folder: str, staging: DataFrame, audit: DataFrame, min_coverage: float | None = None, mode: str = "smart", shards: int = SHARDS) -> DataFrame:
    """Upserts staged bars of the keys that the audit fails (`smart`) or of all (`force`); returns the plan: keys, action, reason.

    staging is read several times: it should be a table on disk or little work to make from one."""
    plan = refill_plan(audit, min_coverage).select(*KEYS, "action", "reason")
    if mode == "force":
        plan = plan.withColumns({"action": F.lit("fetch"), "reason": F.lit("force")})
    plan = written(plan)
    wanted = plan.where("action = 'fetch'").select(*KEYS)
    few = wanted.count() <= MOST_KEYS
    upsert(spark, folder, staging.join(F.broadcast(wanted) if few else wanted, KEYS, "left_semi"), shards, stored=few)
    return plan
