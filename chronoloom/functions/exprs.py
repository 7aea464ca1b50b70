"""Column builders that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACK = "track_id"


def by_time(track: str = TRACK) -> Window:
    return Window.partitionBy(track).orderBy("at_ms", "seq")


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_even(x: Column) -> Column:
    """Round to an integer, halves to even."""
    return F.rint(x).cast("long")


def floor_div(a: Column, b: Column | int) -> Column:
    """Floor of a quotient of integers below 2**53."""
    return F.floor(a / b).cast("long")


def nearest_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a time in microseconds: the nearest, halves away from 0 (``unix_millis`` cuts them off)."""
    us = F.unix_micros(ts.cast("timestamp"))
    up = F.abs(us) + 500
    return (F.signum(us) * ((up - up % 1000) / 1000)).cast("long")


def rank_a(n: Column, q: float) -> Column:
    """Zero-based rank min(n - 1, int(n q))."""
    return F.least(n - 1, F.floor(n * F.lit(float(q))))


def rank_b(n: Column, q: float) -> Column:
    """Zero-based rank round(q (n - 1)), halves to even."""
    return F.least(n - 1, F.rint((n - 1) * F.lit(float(q))))


def upper_median(n: Column, q: float = 0.5) -> Column:
    """Zero-based rank n // 2."""
    return F.floor(n / 2)


def nearest_ranks(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple]) -> DataFrame:
    """One row per key with order statistics; wanted: name -> (rank function, q).

    Ranks come from a sorted window, which spills; no group is collected. Keys without rows give no row.
    """
    inside = Window.partitionBy(*keys)
    ranked = df.select(*keys, value).where(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(inside.orderBy(value)).alias("__r"), F.count("*").over(inside).alias("__n"))
    picks = [F.max(F.when(F.col("__r") == fn(F.col("__n"), q) + 1, F.col(value))).alias(name) for name, (fn, q) in wanted.items()]
    return ranked.groupBy(*keys).agg(*picks)


def with_ranks(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple]) -> DataFrame:
    """``nearest_ranks`` as columns of every row: windows of one partitioning, so neither a join nor another shuffle."""
    inside = Window.partitionBy(*keys)
    ranked = df.select("*", F.row_number().over(inside.orderBy(F.col(value).asc_nulls_last())).alias("__r"), F.count(value).over(inside).alias("__n"))
    return ranked.select(*df.columns, *[F.max(F.when(F.col("__r") == fn(F.col("__n"), q) + 1, F.col(value))).over(inside).alias(name) for name, (fn, q) in wanted.items()])


def ordered_sum(x: Column, order: Column) -> Column:
    """Aggregate: the sum of x, added in the order of ``order``: bounded groups (windows of a profile) only."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), x.cast("double").alias("x"))))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["x"])
