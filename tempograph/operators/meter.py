"""Bars, beats, grids and snapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.functions import theory
from tempograph.functions.vectors import snap
from tempograph.operators.temporal import asof_join


def bar_table(meters: DataFrame, by: list[str], bars: int) -> DataFrame:
    """(bar, start_beat, num, den) of the first ``bars`` bars, from meter changes (start_bar, num, den)."""
    w = Window.partitionBy(*by).orderBy("start_bar")
    blocks = meters.withColumn("__to", F.coalesce(F.lead("start_bar").over(w), F.lit(bars)))
    length = theory.bar_length(F.col("num"), F.col("den"))
    before = F.coalesce(F.sum((F.col("__to") - F.col("start_bar")) * length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    each = blocks.withColumn("__base", before).withColumn("bar", F.explode(F.sequence("start_bar", F.col("__to") - 1)))
    return each.select(*by, "bar", (F.col("__base") + (F.col("bar") - F.col("start_bar")) * length).alias("start_beat"), "num", "den")


def bar_position(df: DataFrame, meters: DataFrame, by: list[str], beat: str) -> DataFrame:
    """Bar and beat in it of a beat, across meter changes; exact at a boundary."""
    w = Window.partitionBy(*by).orderBy("start_bar")
    length = theory.bar_length(F.col("num"), F.col("den"))
    blocks = meters.withColumn("__len", length).withColumn("__n", F.lead("start_bar").over(w) - F.col("start_bar"))
    blocks = blocks.withColumn("__start", F.coalesce(F.sum(F.col("__n") * F.col("__len")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    hit = asof_join(df, blocks, by, beat, "__start", ["start_bar"], ["start_bar", "__start", "__len"], clamp=True)
    into = (F.col(beat) - F.col("__start")) / F.col("__len")
    bar = F.floor(into)
    return hit.select(*df.columns, (F.col("start_bar") + bar).cast("bigint").alias("bar"), (F.col(beat) - F.col("__start") - bar * F.col("__len")).alias("beat_in_bar"))


def to_beat(bar: Column, beat_in_bar: Column, start_bar: Column, start_beat: Column, length: Column) -> Column:
    """L8 back: the beat of a position in a meter block."""
    return start_beat + (bar - start_bar) * length + beat_in_bar


def grid_costs(df: DataFrame, by: list[str], beat: str, depth_cost: float = 0.035, tuplet_cost: float = 0.015) -> DataFrame:
    """For each of the six resolutions, distances from the grid plus the cost of depth and tuplets for each note."""
    grid = F.explode(F.array(*map(F.lit, theory.RESOLUTIONS)))
    each = df.select(*by, beat, grid.alias("divisions"))
    off = F.abs(F.col(beat) - snap(F.col(beat), 1.0 / F.col("divisions")))
    cost = off + depth_cost * theory.grid_depth(F.col("divisions")) + F.when(theory.is_tuplet(F.col("divisions")), tuplet_cost).otherwise(0.0)
    return each.groupBy(*by, "divisions").agg(F.sum(cost).alias("cost"))


def best_grid_path(costs: DataFrame, by: str, bar: str, change: float = 0.25) -> DataFrame:
    """D3: the cheapest resolution of each bar where a change costs; staying wins ties, then the coarser grid.  One recording a group."""
    import numpy as np
    import pyarrow as pa

    from tempograph.operators.harmony import best_path

    kind, bkind = costs.schema[by].dataType.simpleString(), costs.schema[bar].dataType.simpleString()

    def decode(key, table):
        grids, column = np.unique(table.column("divisions").to_numpy(), return_inverse=True)
        bars, row = np.unique(table.column(bar).to_numpy(), return_inverse=True)
        wide = np.full((len(bars), len(grids)), np.inf)
        wide[row, column] = table.column("cost").to_numpy()
        path = best_path(-wide, np.full(len(wide), change))
        return pa.table([pa.array([key[0].as_py()] * len(bars), table.schema.field(by).type), pa.array(bars, table.schema.field(bar).type), pa.array(grids[path], pa.int32())], names=[by, bar, "divisions"])

    return costs.groupBy(by).applyInArrow(decode, f"{by} {kind}, {bar} {bkind}, divisions int")


def snap_note(onset: Column, end: Column, step, legato: float = 0.02, articulation: float = 0.9) -> tuple[Column, Column]:
    """Onset and end on the grid, one step long at least; a note played shorter than written is lengthened first, unless it is legato."""
    start = snap(onset, step)
    length = end - onset
    near = snap(length, step)
    written = F.when(F.abs(near - length) <= legato * length, length).otherwise(length / articulation)
    return start, start + F.greatest(snap(written, step), F.lit(step) if not isinstance(step, Column) else step)


def unswing(phase: Column, ratio: Column) -> Column:
    """The phase of a beat with its off-beat moved from the ratio to a half."""
    return F.when(phase < ratio, phase * 0.5 / ratio).otherwise(0.5 + (phase - ratio) * 0.5 / (1 - ratio))


def cut_at_bars(spans: DataFrame, by: list[str], start: str, end: str, bar: int, origin: int = 0) -> DataFrame:
    """L2: spans cut at bar lines: (bar, offset in it, length)."""
    low, high = F.floor((F.col(start) - origin) / bar), F.floor((F.col(end) - 1 - origin) / bar)
    each = spans.where(F.col(end) > F.col(start)).withColumn("bar", F.explode(F.sequence(low, high)))
    line = F.col("bar") * bar + origin
    return each.withColumns({"offset": F.greatest(F.col(start), line) - line, "length": F.least(F.col(end), line + bar) - F.greatest(F.col(start), line)})


def harmonic_rhythm(cells: DataFrame, by: list[str], label: str, bar: int, divisors: tuple[int, ...], cell_cost: float = 0.3) -> DataFrame:
    """The number of slots of each bar that leaves the least uncovered plus cell_cost for each further slot; fewer slots win ties."""
    each = cells.withColumn("slots", F.explode(F.array(*map(F.lit, divisors))))
    width = F.lit(bar) / F.col("slots")
    slot = F.explode(F.sequence(F.floor(F.col("offset") / width).cast("int"), F.least(F.col("slots") - 1, F.floor((F.col("offset") + F.col("length") - 1) / width).cast("int"))))
    cut = each.withColumn("slot", slot)
    piece = F.least(F.col("offset") + F.col("length"), (F.col("slot") + 1) * width) - F.greatest(F.col("offset"), F.col("slot") * width)
    sums = cut.groupBy(*by, "bar", "slots", "slot", label).agg(F.sum(piece).alias("__o"))
    best = sums.groupBy(*by, "bar", "slots", "slot").agg(F.max("__o").alias("__o")).groupBy(*by, "bar", "slots").agg(F.sum("__o").alias("__covered"))
    cost = best.withColumn("cost", (bar - F.col("__covered")) / bar + cell_cost * (F.col("slots") - 1))
    w = Window.partitionBy(*by, "bar").orderBy(F.round("cost", 9), "slots")
    return cost.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*by, "bar", "slots", "cost")


def chart_origin(beats: DataFrame, by: list[str], first: Column, tolerance, bar) -> DataFrame:
    """L3: the last downbeat up to the first chord (plus a tolerance); else whole bars back from the first downbeat."""
    down = beats.where("downbeat").groupBy(*by).agg(F.max(F.when(F.col("at") <= first + tolerance, F.col("at"))).alias("__last"), F.min("at").alias("__first"), F.max(first).alias("__chord"))
    back = F.col("__first") - F.ceil((F.col("__first") - F.col("__chord")) / bar) * bar
    return down.select(*by, F.coalesce("__last", back).alias("origin"))


def snap_to_bar(df: DataFrame, bars: DataFrame, by: list[str], beat: str, unit: bool = False) -> DataFrame:
    """A beat moved to the nearest bar line of its bar (or, with ``unit``, to a counted beat), halves up."""
    hit = asof_join(df, bars.withColumn("__bar_from", F.col("start_beat")), by, beat, "__bar_from", ["bar"], ["start_beat", "num", "den"], clamp=True)
    step = theory.beat_unit(F.col("num"), F.col("den")) if unit else theory.bar_length(F.col("num"), F.col("den"))
    return hit.withColumn("snapped", F.col("start_beat") + snap(F.col(beat) - F.col("start_beat"), step)).select(*df.columns, "snapped")


def one_a_bar(chords: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The fallback layout: chord i in bar i."""
    return chords.withColumn("bar", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def grid_at(df: DataFrame, grids: DataFrame, by: list[str]) -> DataFrame:
    """The grid of each row's bar; a beat where none is published."""
    return df.join(grids, [*by, "bar"], "left").withColumn("divisions", F.coalesce("divisions", F.lit(1)))


def swing_at(ratio: Column, num: Column, den: Column) -> Column:
    """Straight in compound meters."""
    return F.when(theory.is_compound(num, den), 0.5).otherwise(ratio)


def with_lead_in(segments: DataFrame, by: list[str], first: str, gap: str) -> DataFrame:
    """The pulses that fit before the first beat, one at least."""
    return segments.withColumn("lead_in", F.greatest(F.lit(1), F.floor(F.col(first) / F.col(gap) + 0.5)))
