"""Notes, chords and tuplets on a grid that each bar chooses for itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.functions import theory
from tempograph.functions.vectors import snap


def quantized_notes(notes: DataFrame, grids: DataFrame, by: list[str], start: str, end: str, bar: float, unit: float = 1.0, tolerance: float = 0.02, articulation: float = 0.9) -> DataFrame:
    """Onset, length and step of each note on the grids (key, bar, divisions) of the bars in which it starts and ends.

    Positions are quarters from the first bar line, bars ``bar`` long and counted in ``unit``; a bar without a grid is
    counted in units.  An onset that rounds to the next bar's line is printed there and takes that bar's step.  A
    release is moved later by the share that articulation cuts off, at most to the next place of its grid, unless the
    note is as long as written (within the tolerance).  A note without a length gets one step.
    """
    bar_of = lambda at: F.floor(at / bar).cast("bigint")
    steps = lambda at, k, step: F.floor((at - k * bar) / step + 0.5)
    each = notes.withColumns({"__b": bar_of(F.col(start)), "__z": bar_of(F.col(end))})
    published = lambda key, shift, name: grids.select(*by, (F.col("bar").cast("bigint") - shift).alias(key), F.col("divisions").alias(name))
    own, after, last = published("__b", 0, "__d"), published("__b", 1, "__after"), published("__z", 0, "__e")
    each = each.join(own, [*by, "__b"], "left").join(last, [*by, "__z"], "left").join(after, [*by, "__b"], "left")
    step_of = lambda d: F.lit(unit) / F.coalesce(d, F.lit(1))
    first = step_of(F.col("__d"))
    place = steps(F.col(start), F.col("__b"), first)
    onset = F.col("__b") * bar + place * first
    carried = place * first >= bar - 1e-9
    step = F.when(carried, step_of(F.col("__after"))).otherwise(first)
    played, grid = F.col(end) - F.col(start), step_of(F.col("__e"))
    within = F.col(end) - F.col("__z") * bar
    longer = F.least(within + played * (1 / articulation - 1), F.ceil(within / grid - 1e-12) * grid)
    legato = played / grid <= F.rint(played / grid) * (1 + tolerance)
    offset = F.col("__z") * bar + F.floor(F.when(legato, within).otherwise(longer) / grid + 0.5) * grid
    names = notes.columns
    return each.withColumns({"onset_beat": onset, "step": step, "__off": offset}).withColumn("length_beats", F.when(F.round(F.col("__off") - F.col("onset_beat"), 9) <= 0, F.col("step")).otherwise(F.col("__off") - F.col("onset_beat"))).select(*names, "onset_beat", "length_beats", "step")


def placed_in_order(spans: DataFrame, by: list[str], order: list[str], start: Column, end: Column, all_or_nothing: bool = False) -> DataFrame:
    """Snapped spans, sorted by start, each from where the ones before end at the earliest; one without length gets null
    places, and with ``all_or_nothing`` then all of its key do.

    A span that collapses ends no later than it starts, so it moves nothing behind it: the furthest end so far is a running maximum.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    each = spans.withColumns({"__s": start, "__e": end}).withColumn("__a", F.greatest("__s", F.coalesce(before, "__s")))
    gone = F.col("__e") <= F.col("__a")
    if all_or_nothing:
        gone = F.max(F.col("__e") <= F.col("__a")).over(Window.partitionBy(*by))
    each = each.withColumn("__gone", gone)
    return each.withColumns({"placed_start": F.when(~F.col("__gone"), F.col("__a")), "placed_end": F.when(~F.col("__gone"), F.col("__e"))}).drop("__s", "__e", "__a", "__gone")


def tuplet_of(num: Column, den: Column, divisions: Column) -> Column:
    """(actual, normal) of a grid that divides the beat otherwise than its meter does: threes in simple time, twos in compound; null else."""
    compound = theory.is_compound(num, den)
    duplet = compound & (divisions % 2 == 0) & (divisions % 3 != 0)
    triplet = ~compound & (divisions % 3 == 0)
    pair = lambda a, n: F.struct(F.lit(a).alias("actual"), F.lit(n).alias("normal"))
    return F.when(triplet, pair(3, 2)).when(duplet, pair(2, 3))


def bracket_fragments(notes: DataFrame) -> DataFrame:
    """The parts of notes that a tuplet bar's brackets cut them into.

    Notes have num, den (meter), divisions (of the counted beat), first and last (grid steps from the bar's line, last
    exclusive).  Each part has its bracket, its first step within it, its steps, and the length that is written, an exact
    fraction of a quarter (written_num / written_den, not reduced); ``tied`` if the note goes on behind it.
    """
    tuplet = tuplet_of(F.col("num"), F.col("den"), F.col("divisions"))
    own = notes.withColumn("__t", tuplet).where(F.col("__t").isNotNull() & (F.col("last") > F.col("first")))
    actual, normal = F.col("__t.actual"), F.col("__t.normal")
    own = own.withColumn("bracket", F.explode(F.sequence(F.floor(F.col("first") / actual), F.floor((F.col("last") - 1) / actual))))
    a, z = F.greatest(F.col("first"), F.col("bracket") * actual), F.least(F.col("last"), (F.col("bracket") + 1) * actual)
    # A counted beat is 4 / den quarters, or 12 / den in compound time; it has divisions / actual brackets of ``normal`` written steps each.
    unit = F.when(theory.is_compound(F.col("num"), F.col("den")), 12).otherwise(4)
    out = own.withColumns({"within": (a - F.col("bracket") * actual).cast("int"), "steps": (z - a).cast("int"), "tied": z < F.col("last")})
    out = out.withColumns({"written_num": (F.col("steps") * unit * actual).cast("bigint"), "written_den": (F.col("den") * F.col("divisions") * normal).cast("bigint"), "ratio": F.concat_ws("/", actual.cast("string"), normal.cast("string"))})
    return out.drop("__t")


def superseded_changes(changes: DataFrame, by: list[str], beat: str, default: int = 4, slots: int = 100_000) -> DataFrame:
    """The changes (``beat``, ``length``: the bar length that is asked for) in effect, with the ``line`` at which each begins.

    A change begins at the next bar line of the meter in effect there, and one that comes before that line withdraws it.
    Where lines fall depends on all changes before, so the changes of a key are folded in order, as one array of
    at most ``slots`` changes; a longer list raises.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(beat).alias("beat"), "length")))
    keyed = changes.groupBy(*by).agg(listed.alias("__c"))
    kind = "array<struct<beat:bigint,line:bigint,length:bigint>>"

    def step(kept, c):
        # The last change whose line has passed decides where the next line is; those still to come are withdrawn.
        stay = F.filter(kept, lambda k: k["line"] < c["beat"])
        now = F.element_at(stay, -1)
        line = now["line"] + F.ceil((c["beat"] - now["line"]) / now["length"]).cast("bigint") * now["length"]
        new = F.struct(c["beat"].alias("beat"), line.alias("line"), c["length"].alias("length"))
        at_once = F.array(F.struct(zero.alias("beat"), zero.alias("line"), c["length"].alias("length"))).cast(kind)
        return F.when(c["beat"] <= 0, at_once).when(now["length"] == c["length"], stay).otherwise(F.concat(stay, F.array(new)))

    zero = F.lit(0).cast("bigint")
    opening = F.array(F.struct(zero.alias("beat"), zero.alias("line"), F.lit(default).cast("bigint").alias("length"))).cast(kind)
    fine = F.when(F.size("__c") > slots, F.raise_error(F.lit(f"more than {slots} changes")).cast("boolean")).otherwise(True)
    return keyed.where(fine).select(*by, F.explode(F.aggregate("__c", opening, step)).alias("k")).select(*by, "k.*")
