"""Aggregates over ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.operators.temporal import intervals_between


def peak_rms(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A1: largest absolute value, and root of the mean square (0 if empty)."""
    x = F.col(value)
    return df.groupBy(*by).agg(F.coalesce(F.max(F.abs(x)), F.lit(0.0)).alias("peak"), F.coalesce(F.sqrt(F.avg(x * x)), F.lit(0.0)).alias("rms"))


def median_rate(df: DataFrame, by: list[str], at: str, order: list[str]) -> DataFrame:
    """A2: median gap between events."""
    return intervals_between(df, by, at, order).where("gap is not null").groupBy(*by).agg(F.median("gap").alias("median_gap"))


def steady_rate(df: DataFrame, by: list[str], at: str, order: list[str], tolerance: float = 0.2) -> DataFrame:
    """Mean of the gaps within the tolerance of their median, ends included; the median if there is none."""
    gaps = intervals_between(df, by, at, order).where("gap is not null")
    whole = gaps.join(gaps.groupBy(*by).agg(F.median("gap").alias("median_gap")), by)
    near = F.col("gap").between(F.col("median_gap") * (1 - tolerance), F.col("median_gap") * (1 + tolerance))
    return whole.groupBy(*by).agg(F.first("median_gap").alias("median_gap"), F.coalesce(F.avg(F.when(near, F.col("gap"))), F.first("median_gap")).alias("steady_gap"))


def strictly_rising(df: DataFrame, by: list[str], at: str, order: list[str]) -> DataFrame:
    """(pulses, repeats, strict): how many times each key has, how many are no later than the one before, and whether none is."""
    before = F.lag(at).over(Window.partitionBy(*by).orderBy(at, *order))
    each = df.select(*by, (F.col(at) <= before).alias("__late"))
    return each.groupBy(*by).agg(F.count("*").alias("pulses"), F.count_if("__late").alias("repeats"), (F.count_if("__late") == 0).alias("strict"))


def weighted_rate(df: DataFrame, by: list[str], start: str, end: str, rate: str, low, high) -> DataFrame:
    """A4: time-weighted mean rate over [low, high): elapsed time over the sum of elapsed time / rate^-1, exact for a single segment."""
    length = F.least(F.col(end), F.lit(high)) - F.greatest(F.col(start), F.lit(low))
    cut = df.withColumn("__len", length).where("__len > 0")
    return cut.groupBy(*by).agg(F.when(F.count("*") == 1, F.max(rate)).otherwise(F.sum(F.col("__len") * F.col(rate)) / F.sum("__len")).alias("avg_rate"))


def without_leading(df: DataFrame, by: list[str], order: list[str], lead: Column) -> DataFrame:
    """A5: rows from the first on for which ``lead`` does not hold."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__k", F.max((~lead).cast("int")).over(w)).where("__k = 1").drop("__k")


def normalise(df: DataFrame, by: list[str], value: str, out: str = "z", least: float = 1e-12) -> DataFrame:
    """(value - mean) / population deviation; 0 where the deviation is too small."""
    w = Window.partitionBy(*by)
    s = F.stddev_pop(value).over(w)
    return df.withColumn(out, F.when(s < least, 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / F.when(s == 0, None).otherwise(s)))


def peakiness(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """1 - 3 / kurtosis, clamped to [0, 1] (raw population kurtosis; 0 for a constant)."""
    k = F.kurtosis(value) + 3
    ok = F.stddev_pop(value) > 1e-12
    return df.groupBy(*by).agg(F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 3 / k))).otherwise(0.0).alias("peakiness"))


def phase_means(df: DataFrame, by: list[str], index: str, value: str, phases: int, default: float = 0.0) -> DataFrame:
    """For each phase of the index: mean (the default if none), advantage over the overall mean, effective count."""
    x = F.col(value)
    marked = df.withColumn("__p", F.pmod(F.col(index), F.lit(phases)))
    overall = marked.groupBy(*by).agg(F.avg(x).alias("__all"))
    own = marked.groupBy(*by, "__p").agg(F.avg(x).alias("__m"), F.sum(x).alias("__s"), F.sum(x * x).alias("__q"))
    every = overall.withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(phases - 1)).cast("array<bigint>")))
    joined = every.join(own.withColumn("__p", F.col("__p").cast("bigint")), [*by, "__p"], "left")
    mean = F.coalesce("__m", F.lit(default))
    return joined.select(*by, F.col("__p").alias("phase"), mean.alias("mean"), (mean - F.col("__all")).alias("advantage"), F.when(F.coalesce("__q", F.lit(0.0)) > 0, F.col("__s") * F.col("__s") / F.col("__q")).otherwise(0.0).alias("effective"))


def detrend(df: DataFrame, by: list[str], order: list[str], value: str, window: int, out: str = "detrended") -> DataFrame:
    """The value less its centred moving average (clipped at the ends), not under 0."""
    half = max(1, window // 2)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn(out, F.greatest(F.lit(0.0), F.col(value) - F.avg(value).over(w)))


def change_count(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Neighbouring values that differ."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__d", (F.col(value) != F.lag(value).over(w)).cast("int")).groupBy(*by).agg(F.coalesce(F.sum("__d"), F.lit(0)).alias("changes"))


def swing(df: DataFrame, by: list[str], phase: str, edge: float = 0.1) -> DataFrame:
    """Counts on and off the beat, mean and population deviation of the off-beat phases, and whether that swings."""
    on = (F.col(phase) < edge) | (F.col(phase) > 1 - edge)
    off = F.when(~on, F.col(phase))
    s = df.groupBy(*by).agg(F.sum(on.cast("bigint")).alias("on_beats"), F.count(off).alias("off_beats"), F.avg(off).alias("mean_phase"), F.stddev_pop(off).alias("spread"))
    swings = (F.col("off_beats") >= 8) & (F.col("on_beats") >= 4) & (F.col("mean_phase") >= 0.58) & (F.col("spread") <= 0.09)
    return s.withColumn("swings", F.coalesce(swings, F.lit(False)))


def autocorrelation(df: DataFrame, by: list[str], at: str, value: str, most: int) -> DataFrame:
    """Sum over t of x(t) x(t + lag) / n, for lags 0..most; ``at`` counts frames."""
    size = df.groupBy(*by).agg(F.count("*").alias("__n"))
    own = df.select(*by, F.col(at).alias("__t"), F.col(value).alias("__x"))
    moved = df.select(*by, F.explode(F.sequence(F.lit(0), F.lit(most))).alias("lag"), F.col(at).alias("__u"), F.col(value).alias("__y")).withColumn("__t", F.col("__u") - F.col("lag"))
    return own.join(moved, [*by, "__t"]).groupBy(*by, "lag").agg(F.sum(F.col("__x") * F.col("__y")).alias("__s")).join(size, by).select(*by, "lag", (F.col("__s") / F.col("__n")).alias("acf"))


def violations_of_order(df: DataFrame, by: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Rows that start before the row before them ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__e", F.lag(end).over(w)).where(F.col(start) < F.col("__e")).drop("__e")


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def tuning_histogram(df: DataFrame, by: list[str], pitch: str, weight: str, bins: int = 40) -> DataFrame:
    """Weight by deviation from the semitone, in bins over [-0.5, 0.5); the centre of the heaviest bin, the first on a tie."""
    part = F.col(pitch) - F.floor(F.col(pitch) + 0.5)
    sums = df.withColumn("bin", F.floor((part + 0.5) * bins).cast("bigint")).groupBy(*by, "bin").agg(F.sum(weight).alias("mass"))
    w = Window.partitionBy(*by).orderBy(F.desc("mass"), "bin")
    return sums.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*by, "bin", "mass", ((F.col("bin") + 0.5) / bins - 0.5).alias("tuning"))


def changed_lines(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of a baseline that differ now; names that are missing now are skipped, new ones shown."""
    old, new = before.select(key, F.col(value).alias("was")), after.select(key, F.col(value).alias("now"))
    return old.join(new, key, "full_outer").where(F.col("now").isNotNull() & ~F.col("was").eqNullSafe(F.col("now")))


def sweep(features: DataFrame, settings: DataFrame, run) -> DataFrame:
    """``run`` over features for every row of a (small, listed) table of settings; one plan, the features scanned once."""
    return run(features.crossJoin(F.broadcast(settings)))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of those they break (a null counts as broken)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def finite(column: str) -> Column:
    """Neither null, NaN nor infinite."""
    x = F.col(column)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def clock_aggregates(df: DataFrame, by: list[str], at: str, width: int) -> DataFrame:
    """Counts in regular slots, empty ones included between a key's first and last."""
    slot = F.floor(F.col(at) / width)
    sums = df.groupBy(*by, slot.alias("slot")).agg(F.count("*").alias("n"))
    ends = sums.groupBy(*by).agg(F.min("slot").alias("a"), F.max("slot").alias("z"))
    every = ends.select(*by, F.explode(F.sequence("a", "z")).alias("slot"))
    return every.join(sums, [*by, "slot"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
