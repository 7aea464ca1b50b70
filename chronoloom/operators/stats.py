"""Position, motion, speed and profile statistics of action timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.exprs import TRACK, by_time, nearest_ranks, ordered_sum, rank_a

SPEED_BINS = ("very_slow", "slow", "medium", "fast", "very_fast", "ultra_fast", "flash")
SPEED_EDGES = (50, 150, 250, 350, 450, 600)
QUARTILES = {f"p{q}": (rank_a, q / 100) for q in (5, 25, 50, 75, 95)}


def _decile() -> F.Column:
    return F.least(F.lit(9), F.floor(F.col("pos") / 10)).cast("int")


def decile_histogram(pairs: DataFrame) -> DataFrame:
    """Counts of positions per tenth, 100 in the last."""
    return pairs.groupBy(TRACK).agg(*[F.count_if(_decile() == d).alias(f"d{d}") for d in range(10)])


def position_stats(pairs: DataFrame) -> DataFrame:
    """Shares at the rails, beside them and in the middle (whole percent, rounded down), order statistics, bimodality."""
    d = _decile()
    base = pairs.groupBy(TRACK).agg(F.count("*").alias("n"), F.count_if(d.isin(0, 9)).alias("rails"), F.count_if(d.isin(1, 8)).alias("limbo"), F.count_if(d.between(2, 7)).alias("mid"))
    pct = lambda c: F.floor(F.col(c) * 100 / F.col("n")).cast("long").alias(f"{c}_pct")
    ranks = nearest_ranks(pairs, [TRACK], "pos", QUARTILES)
    return base.join(ranks, TRACK).select(TRACK, "n", pct("rails"), pct("limbo"), pct("mid"), *QUARTILES, (F.col("p75") - F.col("p25")).alias("iqr"), (pct("rails") > pct("mid")).alias("bimodal"))


def steps(pairs: DataFrame) -> DataFrame:
    """Each action with its stroke and time since the one before."""
    w = by_time()
    return pairs.select("*", F.abs(F.col("pos") - F.lag("pos").over(w)).alias("stroke"), (F.col("at_ms") - F.lag("at_ms").over(w)).alias("dt"))


def velocities(pairs: DataFrame) -> DataFrame:
    """Position units a second between adjacent actions, at the later one; none where no time passes."""
    return steps(pairs).where("dt > 0").select(TRACK, "seq", "at_ms", (F.col("stroke") / F.col("dt") * 1000).alias("velocity"))


def _running_mean(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Mean of value per key, summed in the order of seq by a window, so it doesn't hang on partitions."""
    w = Window.partitionBy(*keys).orderBy("seq")
    run = df.select(*keys, "seq", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    return run.groupBy(*keys).agg((F.max_by("s", "seq") / F.count("*")).alias(name))


def motion_stats(pairs: DataFrame) -> DataFrame:
    """Rate, mean stroke, mean and high velocities; tracks of one action have zeros."""
    base = steps(pairs).groupBy(TRACK).agg(F.count("*").alias("n"), (F.max("at_ms") - F.min("at_ms")).alias("duration_ms"), F.avg("stroke").alias("avg_stroke"))
    span = F.when(F.col("duration_ms") == 0, 1.0).otherwise(F.col("duration_ms") / 1000)
    v = velocities(pairs)
    ranks = nearest_ranks(v, [TRACK], "velocity", {"p50_velocity": (rank_a, 0.5), "p90_velocity": (rank_a, 0.9)})
    out = base.join(_running_mean(v, [TRACK], "velocity", "avg_velocity"), TRACK, "left").join(ranks, TRACK, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(TRACK, "n", F.when(F.col("n") < 2, 0.0).otherwise(F.col("n") / span).alias("rate"), zero(F.col("avg_stroke")).alias("avg_stroke"), zero(F.col("avg_velocity")).alias("avg_velocity"), zero(F.col("p50_velocity")).alias("p50_velocity"), zero(F.col("p90_velocity")).alias("p90_velocity"), "duration_ms")


def speed_distribution(pairs: DataFrame) -> DataFrame:
    """Counts of velocities in seven bands, lower edges inside; tracks without velocities have zeros."""
    v = F.col("velocity")
    low, high = (None, *SPEED_EDGES), (*SPEED_EDGES, None)
    band = lambda a, b: (F.lit(True) if a is None else v >= a) & (F.lit(True) if b is None else v < b)
    counts = velocities(pairs).groupBy(TRACK).agg(F.count("*").alias("n"), *[F.count_if(band(a, b)).alias(name) for name, a, b in zip(SPEED_BINS, low, high)])
    return pairs.select(TRACK).distinct().join(counts, TRACK, "left").na.fill(0)


def windowed_profile(pairs: DataFrame, n_windows: int = 12) -> DataFrame:
    """Equal windows of each track (of two actions or more): rate, rails, middle, stroke, position, velocity.

    The last action lies beyond the last window when the track is long enough; windows of fewer than two actions
    have zeros but keep their count. A step's velocity counts where it ends, its stroke only inside one window.
    """
    track = Window.partitionBy(TRACK)
    s = steps(pairs).withColumns({"t0": F.min("at_ms").over(track), "t1": F.max("at_ms").over(track), "total": F.count("*").over(track)}).where("total >= 2")
    s = s.withColumn("width", F.greatest(F.lit(1), F.floor((F.col("t1") - F.col("t0")) / n_windows)).cast("long"))
    s = s.withColumn("window", F.floor((F.col("at_ms") - F.col("t0")) / F.col("width")).cast("int"))
    inside = s.where(F.col("window") < n_windows).withColumn("same", F.lag("window").over(by_time()) == F.col("window"))
    d = _decile()
    velocity = F.when(F.col("dt") > 0, F.col("stroke") / F.col("dt") * 1000)
    agg = inside.groupBy(TRACK, "t0", "width", "window").agg(
        F.count("*").alias("c"), F.min("at_ms").alias("a"), F.max("at_ms").alias("b"), F.count_if(d.isin(0, 9)).alias("rails"), F.count_if(d.between(2, 7)).alias("mid"),
        F.avg(F.when(F.col("same"), F.col("stroke"))).alias("stroke"), F.avg("pos").alias("mean_pos"), F.count(velocity).alias("nv"), ordered_sum(F.coalesce(velocity, F.lit(0.0)), F.col("seq")).alias("sv"),
    )
    # the track's few windows in a map, so that empty ones need no join; all of it stays partitioned by track
    own = F.map_from_entries(F.collect_list(F.struct("window", F.struct("c", "a", "b", "rails", "mid", "stroke", "mean_pos", "nv", "sv"))))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))).alias("window")
    agg = agg.groupBy(TRACK, "t0", "width").agg(own.alias("own")).select(TRACK, "t0", "width", "own", every)
    agg = agg.select(TRACK, "t0", "width", "window", F.col("own")[F.col("window")].alias("g")).select(TRACK, "t0", "width", "window", "g.*")
    few = F.coalesce(F.col("c"), F.lit(0)) < 2
    span = F.when(F.col("a") == F.col("b"), 1.0).otherwise((F.col("b") - F.col("a")) / 1000)
    num = lambda x, name: F.when(few, 0.0).otherwise(x).alias(name)
    pct = lambda c: F.when(few, 0).otherwise(F.floor(F.col(c) * 100 / F.col("c"))).cast("long").alias(f"{c}_pct")
    return agg.select(
        TRACK, "window", (F.col("t0") + F.col("window") * F.col("width")).alias("at_ms"), F.coalesce("c", F.lit(0)).cast("long").alias("n"), num(F.col("c") / span, "rate"), pct("rails"), pct("mid"),
        num(F.col("stroke"), "avg_stroke"), num(F.col("mean_pos"), "mean_pos"), num(F.when(F.col("nv") > 0, F.col("sv") / F.col("nv")).otherwise(0.0), "avg_velocity"),
    )


def _cov(x: str) -> F.Column:
    """Population spread over mean of a profile's windows, added in their order; 0 for mean 0."""
    n = F.count("*")
    mean = ordered_sum(F.col(x), F.col("window")) / n
    items = F.array_sort(F.collect_list(F.struct("window", F.col(x).alias("x"))))
    var = F.aggregate(items, F.lit(0.0), lambda acc, p: acc + (p["x"] - mean) * (p["x"] - mean)) / n
    return F.when(mean == 0, 0.0).otherwise(F.sqrt(var) / mean)


def dynamics_index(profile: DataFrame) -> DataFrame:
    """How much velocity and rate vary over a track's windows."""
    return profile.groupBy(TRACK).agg(_cov("avg_velocity").alias("velocity_cov"), _cov("rate").alias("rate_cov"))


def summarize(pairs: DataFrame, n_windows: int = 12) -> DataFrame:
    """All statistics of a track in one row."""
    profile = windowed_profile(pairs, n_windows)
    motion = motion_stats(pairs).drop("n")
    speed = speed_distribution(pairs).withColumnRenamed("n", "n_velocities")
    return position_stats(pairs).join(motion, TRACK).join(speed, TRACK).join(dynamics_index(profile), TRACK, "left").na.fill(0.0, ["velocity_cov", "rate_cov"])
