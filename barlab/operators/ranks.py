"""Places, running values and quantiles of the rows of a key, without a window over a whole key.

A key may hold any share of the rows. So its rows are numbered by range (`ordinals`), cut into blocks of a fixed number
of places, each block is folded by itself, and what comes before a block is folded from the ends of the blocks before
it, by the same step where these are many (`running`). Runs of flags follow from running counts (`longest_runs`), and
quantiles from places in the order of values (`quantiles`)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.operators.tables import written

MOST_BROADCAST = 500_000
#: Places in a block: the most rows that one window holds.
BLOCK = 8192


def checked_broadcast(df: DataFrame, most_rows: int = MOST_BROADCAST) -> DataFrame:
    """A stored table of narrow rows, with a broadcast hint only where it is counted to have few rows."""
    return F.broadcast(df) if df.count() <= most_rows else df


def most_rows(df: DataFrame, keys: Sequence[str]) -> int:
    """How many rows the largest key has."""
    return df.groupBy(*keys).agg(F.count("*").alias("_rows")).agg(F.max("_rows")).first()[0] or 0


def ordinals(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], place: str = "place", total: str = "total", block: int = BLOCK) -> DataFrame:
    """df with each row's 0-based place among the rows of its keys (null keys are keys) and their number.

    Where no key has over `block` rows, which one count tells, a window numbers them. Else it takes two passes: rows are dealt by range of (keys, order), sorted where they are and written with their place in the partition;
    the rows of each key and partition are counted, and the running sum of these counts, of which a key has one a
    partition at most, is added. A key of any size so spreads over all partitions. Rows that tie keep one order, as
    the written table fixes it, but which is not defined: give `order` enough columns."""
    if keys and most_rows(df, keys) <= block:
        w = Window.partitionBy(*keys)
        at = (F.row_number().over(w.orderBy(*order)) - 1).cast("long").alias(place)
        return written(df.select(*df.columns, at, F.count("*").over(w).alias(total)))
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    rows = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    each = rows.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    w = Window.partitionBy(*keys)
    before = F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) - F.col("_first")
    runs = written(each.select(*keys, "_part", start.alias("_start"), F.sum("_rows").over(w).alias(total)))
    out = join_keys(rows.withColumn("_part", part), checked_broadcast(runs), [*keys, "_part"])
    return out.select(*df.columns, (F.col("_at") + F.col("_start")).alias(place), total)


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys of which null is a value; left's keys stay."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys), F.lit(True))
    return left.join(named, same, how).drop(*(f"_right_{k}" for k in keys))


_FOLD = {"sum": (F.sum, lambda a, b: a + b), "product": (F.product, lambda a, b: a * b), "max": (F.max, F.greatest)}


def running(df: DataFrame, keys: Sequence[str], values: Mapping[str, tuple[str, Column]], most: int, place: str = "place", block: int = BLOCK) -> DataFrame:
    """df with the running sum, product or max of each value by place, which counts from 0 and reaches at most `most`.

    `values` is name -> (fold, column). Where a key has over `block` places, the ends of its blocks are carried on by
    the same function; the result is then written, so that it isn't folded again by what uses it."""
    w = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    if most <= block:
        return df.withColumns({n: _FOLD[f][0](c).over(w) for n, (f, c) in values.items()})
    own_block = f"_block_of_{place}"
    cut = df.withColumn(own_block, F.floor(F.col(place) / block))
    w = Window.partitionBy(*keys, own_block).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumns({n: _FOLD[f][0](c).over(w) for n, (f, c) in values.items()})
    ends = written(own.groupBy(*keys, own_block).agg(*(F.max_by(n, place).alias(n) for n in values)))
    carried = running(ends, keys, {f"_before_{n}": (f, F.col(n)) for n, (f, _) in values.items()}, -(-most // block), own_block, block)
    before = written(carried.select(*keys, (F.col(own_block) + 1).alias(own_block), *(f"_before_{n}" for n in values)))
    joined = join_keys(own, checked_broadcast(before), [*keys, own_block], "left")
    total = {n: F.when(F.col(own_block) == 0, F.col(n)).otherwise(_FOLD[f][1](F.col(f"_before_{n}"), F.col(n))) for n, (f, _) in values.items()}
    return written(joined.withColumns(total).drop(own_block, *(f"_before_{n}" for n in values)))


def previous(df: DataFrame, keys: Sequence[str], columns: Sequence[str], most: int, place: str = "place", block: int = BLOCK) -> DataFrame:
    """df with previous_<column>, the column's value at the place before (null at the first), for places as in `running`.

    A block's first place has it from the last one of the block before, of which a key has one row a block."""
    names = {c: f"previous_{c}" for c in columns}
    if most <= block:
        return df.withColumns({n: F.lag(c).over(Window.partitionBy(*keys).orderBy(place)) for c, n in names.items()})
    cut = df.withColumn("_block", F.floor(F.col(place) / block))
    own = cut.withColumns({n: F.lag(c).over(Window.partitionBy(*keys, "_block").orderBy(place)) for c, n in names.items()})
    last = cut.where((F.col(place) + 1) % block == 0).select(*keys, (F.col("_block") + 1).alias("_block"), *(F.col(c).alias(f"_last_{c}") for c in columns))
    first = F.col(place) % block == 0
    out = join_keys(own, checked_broadcast(written(last)), [*keys, "_block"], "left")
    return out.withColumns({n: F.when(first, F.col(f"_last_{c}")).otherwise(F.col(n)) for c, n in names.items()}).drop("_block", *(f"_last_{c}" for c in columns))


def longest_runs(df: DataFrame, keys: Sequence[str], flags: Mapping[str, Column], most: int, place: str = "place", block: int = BLOCK) -> DataFrame:
    """keys and, for each flag, the most places in a row that have it (a null flag is none). A run is what lies between
    two growths of the running count of places without the flag, so it is counted by a partial aggregate."""
    marks = df.select(*keys, place, *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()))
    counted = running(marks, keys, {f"_not_{n}": ("sum", (~F.col(n)).cast("long")) for n in flags}, most, place, block)
    out = None
    for n in flags:
        runs = counted.groupBy(*keys, f"_not_{n}").agg(F.count_if(F.col(n)).alias("_run")).groupBy(*keys).agg(F.max("_run").alias(n))
        out = runs if out is None else join_keys(out, runs, keys)
    return out


def quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """keys and exact quantiles by linear interpolation; wanted is name -> (numeric column, share). Nulls don't count.

    All columns are numbered in one pass; only the places next to a quantile are gathered."""
    columns = sorted({c for c, _ in wanted.values()})
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns))))
    long = df.select(*keys, each.alias("x")).select(*keys, F.col("x.i").alias("_i"), F.col("x.v").alias("_v")).where("_v IS NOT NULL")
    at = ordinals(long, [*keys, "_i"], ["_v"], "_place", "_total")
    aggs = []
    for name, (column, q) in wanted.items():
        mine = F.col("_i") == columns.index(column)
        rank = (F.col("_total") - 1) * F.lit(float(q))
        value = lambda p: F.max(F.when(mine & (F.col("_place") == p), F.col("_v")))  # noqa: B023, E731
        low, high, share = value(F.floor(rank)), value(F.ceil(rank)), F.max(F.when(mine, rank - F.floor(rank)))
        aggs.append((low + (high - low) * share).alias(name))
    near = reduce(lambda a, b: a | b, (F.abs(F.col("_place") - (F.col("_total") - 1) * F.lit(float(q))) < 1 for q in sorted({q for _, q in wanted.values()})))
    return at.where(near).groupBy(*keys).agg(*aggs)
