"""Ordered and interval joins, islands and sweeps over keyed DataFrames.

Every operator takes the key columns ``by`` and a total order; none relies on the
order of its input, collects, or joins without an equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beside(probe: DataFrame, build: DataFrame, by: list[str], at: str, start: str, order: list[str], take: list[str]) -> tuple[DataFrame, Column, Column]:
    """Both sides in one frame, with a probe's last build row up to it and its first build row from it on, as structs of ``take``.

    Probes are the rows of __probe = 1.  Build rows of one start are in the order ``order``.  Every frame of a window
    runs from a key's first row to the current one, in rising order for the row before and in falling order for the
    row after, so a key's rows are passed over once each way.
    """
    tie = [f"__o{i}" for i in range(len(order))]
    left = probe.withColumns({"__t": F.col(at), "__probe": F.lit(1), "__hit": F.lit(None).cast(build.select(F.struct(*take)).schema[0].dataType), **{t: F.lit(None).cast(build.schema[c].dataType) for t, c in zip(tie, order)}})
    right = build.select(*by, F.col(start).alias("__t"), F.lit(0).alias("__probe"), F.struct(*take).alias("__hit"), *(F.col(c).alias(t) for t, c in zip(tie, order)))
    upto = lambda *o: Window.partitionBy(*by).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("__hit", ignorenulls=True).over(upto("__t", "__probe", *tie))
    after = F.last("__hit", ignorenulls=True).over(upto(F.desc("__t"), "__probe", *map(F.desc, tie)))
    return left.unionByName(right, allowMissingColumns=True), before, after


def asof_join(probe: DataFrame, build: DataFrame, by: list[str], at: str, start: str, order: list[str], take: list[str], direction: str = "backward", clamp: bool = False) -> DataFrame:
    """Each probe row with the columns ``take`` of the last build row whose ``start`` is at most its ``at``.

    ``order`` breaks ties among build rows of one start (the last wins; forward: the first).  ``direction``
    "forward" looks for the first build row at or after it.  With ``clamp``, a probe that finds none gets the
    key's nearest on the other side.  Both sides are shuffled once, by the key; a key's rows meet in one task.
    """
    both, before, after = beside(probe, build, by, at, start, order, take)
    hit, other = (before, after) if direction == "backward" else (after, before)
    found = both.withColumn("__found", F.coalesce(hit, other) if clamp else hit).where("__probe = 1")
    return found.select(*probe.columns, *(F.col(f"__found.{c}").alias(c) for c in take))


def piecewise_map(x: Column, start_x: Column, start_y: Column, rate: Column) -> Column:
    """The value of a piecewise-linear map at x, from the segment that holds it."""
    return start_y + (x - start_x) * rate


def nearest_join(probe: DataFrame, build: DataFrame, by: list[str], at: str, start: str, order: list[str], take: list[str]) -> DataFrame:
    """Each probe row with the nearest build row; the earlier one on a tie."""
    both, before, after = beside(probe, build, by, at, start, order, [*dict.fromkeys([start, *take])])
    found = both.withColumns({"__before": before, "__after": after}).where("__probe = 1")
    early, late = F.col(at) - F.col(f"__before.{start}"), F.col(f"__after.{start}") - F.col(at)
    hit = F.when(late.isNull() | (early <= late), F.col("__before")).otherwise(F.col("__after"))
    return found.withColumn("__found", hit).select(*probe.columns, *(F.col(f"__found.{c}").alias(c) for c in take))


def bucketed(df: DataFrame, start: str, end: str, width: int, origin: int = 0) -> DataFrame:
    """Rows repeated for each bucket of ``width`` that the half-open interval touches (empty intervals go)."""
    low, high = F.floor((F.col(start) - origin) / width), F.floor((F.col(end) - 1 - origin) / width)
    return df.where(F.col(end) > F.col(start)).withColumn("__bucket", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], width: int, origin: int = 0) -> DataFrame:
    """Pairs of intervals of one key that overlap.  Both sides are cut into buckets of ``width``, so that the
    join has an equality; a pair is emitted in the bucket where its overlap begins, and so only once."""
    ls, le = left_ends
    rs, re = right_ends
    pair = bucketed(left, ls, le, width, origin).join(bucketed(right, rs, re, width, origin), [*by, "__bucket"])
    first = F.greatest(ls, rs)
    return pair.where((F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & (F.floor((first - origin) / width) == F.col("__bucket"))).drop("__bucket")


def point_in_interval(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, take: list[str]) -> DataFrame:
    """Each point with the interval [start, end) that holds it, among intervals that don't overlap; else nulls."""
    held = [*dict.fromkeys([*take, end])]
    renamed = intervals.select(*by, F.col(start).alias("__s"), *(F.col(c).alias(f"__i_{c}") for c in held))
    found = asof_join(points, renamed, by, at, "__s", ["__s"], [f"__i_{c}" for c in held])
    inside = F.col(at) < F.col(f"__i_{end}")
    return found.select(*points.columns, *(F.when(inside, F.col(f"__i_{c}")).alias(c) for c in take))


def islands(df: DataFrame, by: list[str], order: list[str], label: str, number: str = "run") -> DataFrame:
    """A run number, from 0, that rises where the label differs from the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(1))
    changed = F.when(F.row_number().over(w) == 1, 0).otherwise(changed)
    return df.withColumn("__c", changed).withColumn(number, F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def intervals_between(df: DataFrame, by: list[str], at: str, order: list[str]) -> DataFrame:
    """The time since the row before; null on the first."""
    w = Window.partitionBy(*by).orderBy(at, *order)
    return df.withColumn("gap", F.col(at) - F.lag(at).over(w))


def fifo_pairs(df: DataFrame, by: list[str], order: list[str], on: Column, off: Column, at: str) -> DataFrame:
    """(by, on_at, off_at): the k-th open event with the close event that serves it, first in, first out.

    A close event with nothing open is ignored, so it takes no rank: with S the running sum of +1 and -1, the
    number open is S - min(0, running min of S), and a close counts where one was open before it.
    Open events that nothing closes have a null off_at.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    d = df.where(on | off).withColumn("__d", F.when(on, 1).otherwise(-1)).withColumn("__s", F.sum("__d").over(upto))
    d = d.withColumn("__low", F.least(F.lit(0), F.min("__s").over(before))).withColumn("__open", F.coalesce(F.lag("__s").over(w), F.lit(0)) - F.coalesce("__low", F.lit(0)))
    d = d.where((F.col("__d") == 1) | (F.col("__open") > 0))
    rank = Window.partitionBy(*by, "__d").orderBy(*order)
    d = d.withColumn("__r", F.row_number().over(rank))
    paired = d.groupBy(*by, "__r").agg(F.max(F.when(F.col("__d") == 1, F.col(at))).alias("on_at"), F.max(F.when(F.col("__d") == -1, F.col(at))).alias("off_at"))
    return paired.select(*by, F.col("__r").cast("bigint").alias("rank"), "on_at", "off_at")


def elementary_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """The pieces between neighbouring end points of a key's intervals."""
    points = df.select(*by, F.explode(F.array(start, end)).alias("at")).distinct()
    w = Window.partitionBy(*by).orderBy("at")
    return points.select(*by, F.col("at").alias("from_at"), F.lead("at").over(w).alias("to_at")).where("to_at is not null")


def lowest_line(df: DataFrame, by: list[str], start: str, end: str, value: str, width: int, origin: int = 0) -> DataFrame:
    """The smallest value sounding at each instant, as a step function (null where nothing sounds), equal steps merged."""
    pieces = elementary_intervals(df.where(F.col(end) > F.col(start)), by, start, end)
    own = df.select(*by, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(value).alias("__v"))
    hit = overlap_join(pieces, own, by, ("from_at", "to_at"), ("__s", "__e"), width, origin)
    low = hit.groupBy(*by, "from_at").agg(F.min("__v").alias("low"))
    stepped = islands(pieces.join(low, [*by, "from_at"], "left"), by, ["from_at"], "low")
    return stepped.groupBy(*by, "run").agg(F.min("from_at").alias("from_at"), F.max("to_at").alias("to_at"), F.first("low").alias("low")).drop("run")


def monotone_starts(df: DataFrame, by: list[str], order: list[str], start: str, grid) -> DataFrame:
    """Starts moved so that each is at least one grid step after the one before, in closed form."""
    w = Window.partitionBy(*by).orderBy(*order)
    i = F.row_number().over(w) - 1
    slack = df.withColumn("__i", i).withColumn("__k", F.col(start) - F.col("__i") * grid)
    best = F.max("__k").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return slack.withColumn("fixed", best + F.col("__i") * grid).drop("__i", "__k")


def truncate_overlaps(df: DataFrame, by: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Each end moved back to the next start."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("cut_end", F.least(F.col(end), F.lead(start).over(w)))


def dominant_by_overlap(left: DataFrame, right: DataFrame, by: list[str], slot: list[str], left_ends, right_ends, label: str, width: int, origin: int = 0) -> DataFrame:
    """The label with the longest summed overlap with each slot; the label that starts first wins a tie."""
    pair = overlap_join(left, right, by, left_ends, right_ends, width, origin)
    length = F.least(left_ends[1], right_ends[1]) - F.greatest(left_ends[0], right_ends[0])
    sums = pair.groupBy(*by, *slot, label).agg(F.sum(length).alias("overlap"), F.min(right_ends[0]).alias("__first"))
    w = Window.partitionBy(*by, *slot).orderBy(F.desc("overlap"), "__first", label)
    return sums.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__first")


def sounding_slots(df: DataFrame, by: list[str], start: str, end: str, width: int, origin: int = 0) -> DataFrame:
    """The slots of ``width`` in which anything sounds."""
    return bucketed(df, start, end, width, origin).select(*by, F.col("__bucket").alias("slot")).distinct()


def furthest_end(df: DataFrame, by: list[str], order: list[str], end: str) -> DataFrame:
    """The largest end of all rows before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("furthest", F.max(end).over(w))


def neighbours(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The last value known before and the next one known after each row."""
    so_far = lambda *o: F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*o).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumns({"previous_known": so_far(*order), "next_known": so_far(*map(F.desc, order))})


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old rows whose key is not among the new ones, and the new rows."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def first_of_each(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
