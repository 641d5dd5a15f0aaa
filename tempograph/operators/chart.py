"""Charts: chords on a grid, cut into the cells of bars, written at the bar's harmonic rhythm.

Positions are numbers of any unit (quarters, ticks, microseconds); integers stay exact.  A
chart's bars come from one count of where chords start and where the harmony ends, so no
chord can lie outside of them; cells of a bar always sum to the bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.functions.vectors import snap

EXTRA_CHORD = 0.3


def grid_of_changes(chords: DataFrame, by: list[str], start: str, beat: int, halvings: int = 4) -> DataFrame:
    """L4: (grid) the beat, halved as long as it is wider than the closest two successive chords are apart."""
    w = Window.partitionBy(*by).orderBy(start)
    gap = chords.select(*by, (F.col(start) - F.lag(start).over(w)).alias("__g")).groupBy(*by).agg(F.min("__g").alias("__g"))
    grids = [beat // 2**k for k in range(halvings + 1)]
    grid = F.lit(grids[-1])
    for g in reversed(grids[:-1]):
        grid = F.when(F.col("__g").isNull() | (F.col("__g") >= g), F.lit(g)).otherwise(grid)
    return gap.select(*by, grid.cast("bigint").alias("grid"))


def on_grid(chords: DataFrame, by: list[str], order: list[str], start: str, end: str, origin: Column, grid: Column) -> DataFrame:
    """L2: chords with ``i``, ``from`` (on the grid from the origin, each a step after the one before, none before 0) and ``last`` (the end of the harmony)."""
    w = Window.partitionBy(*by).orderBy(*order)
    each = chords.withColumns({"i": F.row_number().over(w) - 1, "__g": grid, "__s": snap(F.col(start) - origin, grid).cast("bigint"), "__e": snap(F.col(end) - origin, grid).cast("bigint")})
    first = F.when(F.col("i") == 0, F.greatest(F.lit(0), F.col("__s"))).otherwise(F.col("__s"))
    # Each start is at least a step after the one before: the running maximum of starts less their number of steps.
    each = each.withColumn("from", F.max(first - F.col("i") * F.col("__g")).over(w) + F.col("i") * F.col("__g"))
    every = Window.partitionBy(*by)
    return each.withColumn("last", F.greatest(F.max("__e").over(every), F.max(F.col("from") + F.col("__g")).over(every))).drop("__g", "__s", "__e")


def bars_of(charts: DataFrame, meters: DataFrame, by: list[str]) -> DataFrame:
    """(bar, from, length, beats) of the bars of charts (key, start: where the last chord starts, last) under meter changes (start_bar, length, beats).

    A bar is on the chart if it is the first, if a chord starts in it or later, or if harmony fills more than half of it.
    """
    w = Window.partitionBy(*by).orderBy("start_bar")
    blocks = meters.withColumn("__n", F.lead("start_bar").over(w) - F.col("start_bar"))
    base = F.coalesce(F.sum(F.col("__n") * F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = charts.join(blocks.withColumn("__base", base), by)
    length = F.col("length")
    started = F.floor((F.col("start") - F.col("__base")) / length) + 1
    filled = F.ceil((F.col("last") - F.col("__base")) / length - 0.5)
    n = F.greatest(started, filled, F.when(F.col("start_bar") == 0, 1).otherwise(0))
    n = F.least(n, F.coalesce("__n", n)).cast("bigint")
    each = own.where(n > 0).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return each.select(*by, (F.col("start_bar") + F.col("__k")).alias("bar"), (F.col("__base") + F.col("__k") * length).alias("from"), "length", "beats")


def cells_of(chords: DataFrame, bars: DataFrame, by: list[str], symbol: str) -> DataFrame:
    """L2, T4: (bar, beats, bar_length, offset, length, symbol, i) of every chord in every bar; the gap before the first chord has no symbol.

    Bars and chords meet in one order of places, so a chord is not joined with its bars: each place takes the latest bar and chord.
    """
    w = Window.partitionBy(*by).orderBy("from")
    gap = chords.where((F.col("i") == 0) & (F.col("from") > 0)).select(*by, F.lit(0).cast("bigint").alias("from"), F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("symbol")).alias("chord"))
    spans = chords.select(*by, F.col("from").cast("bigint").alias("from"), F.struct(F.col("i").cast("int").alias("i"), F.col(symbol).cast("string").alias("symbol")).alias("chord")).unionByName(gap)
    lines = bars.select(*by, F.col("from").cast("bigint").alias("from"), F.struct("bar", F.col("from").alias("at"), "length", "beats").alias("line"))
    points = spans.unionByName(lines, allowMissingColumns=True).groupBy(*by, "from").agg(F.max("chord").alias("chord"), F.max("line").alias("line"))
    known = points.withColumns({"chord": F.last("chord", True).over(w), "line": F.last("line", True).over(w), "__to": F.lead("from").over(w)})
    line = F.col("line")
    end = F.coalesce("__to", line["at"] + line["length"])
    return known.select(*by, line["bar"].alias("bar"), line["beats"].alias("beats"), line["length"].alias("bar_length"), (F.col("from") - line["at"]).alias("offset"), (end - F.col("from")).alias("length"), F.col("chord")["symbol"].alias("symbol"), F.col("chord")["i"].alias("i"))


def at_harmonic_rhythm(cells: DataFrame, by: list[str], finest: int, extra: float = EXTRA_CHORD) -> DataFrame:
    """Cells of bars written on the number of equal slots that costs least to read, coarser ones first.

    A slot carries the symbol that fills most of it, the earlier on a tie; runs of one symbol are one cell.  A division
    costs the share of the bar that its cells leave out, and ``extra`` for each cell after the first.  Bars with one cell, and
    the bar that holds the gap before the first chord, stay as they are.
    """
    bar = [*by, "bar"]
    w = Window.partitionBy(*bar)
    marked = cells.withColumns({"__n": F.count("*").over(w), "__gap": F.max(F.col("symbol").isNull()).over(w)})
    kept = (F.col("__n") < 2) | F.col("__gap")
    stay = marked.where(kept).select(*bar, "beats", "bar_length", "offset", "length", "symbol", "i")
    total = F.col("bar_length")
    divisors = F.filter(F.sequence(F.lit(1), F.col("beats")), lambda n: (F.col("beats") % n == 0) & (F.col("bar_length") % (n.cast("bigint") * finest) == 0))
    each = marked.where(~kept).withColumn("slots", F.explode(divisors)).withColumn("step", (total / F.col("slots")).cast("bigint"))
    slot = F.sequence(F.floor(F.col("offset") / F.col("step")).cast("int"), F.floor((F.col("offset") + F.col("length") - 1) / F.col("step")).cast("int"))
    each = each.withColumn("slot", F.explode(slot))
    held = F.least(F.col("offset") + F.col("length"), (F.col("slot") + 1) * F.col("step")) - F.greatest(F.col("offset"), F.col("slot") * F.col("step"))
    key = [*bar, "beats", "bar_length", "slots", "step", "slot"]
    sums = each.groupBy(*key, "symbol").agg(F.sum(held).alias("held"), F.min("i").alias("i"))
    winners = sums.groupBy(*key).agg(F.max(F.struct("held", F.negative("i").alias("first"), "symbol")).alias("m"))
    run = Window.partitionBy(*bar, "slots").orderBy("slot")
    winners = winners.select(*key, "m.held", F.negative("m.first").alias("i"), "m.symbol").withColumn("opens", ~F.col("symbol").eqNullSafe(F.lag("symbol").over(run)) | (F.col("slot") == 0))
    costs = winners.groupBy(*bar, "bar_length", "slots").agg(F.sum("held").alias("covered"), F.count_if("opens").alias("cells"))
    cost = F.round((total - F.col("covered")) / total + extra * (F.col("cells") - 1), 9)
    best = costs.groupBy(*bar).agg(F.min(F.struct(cost.alias("cost"), "slots")).alias("m")).select(*bar, F.col("m.slots").alias("slots"))
    written = winners.join(best, [*bar, "slots"]).where("opens")
    to = F.coalesce(F.lead(F.col("slot") * F.col("step")).over(run), total)
    out = written.withColumns({"offset": F.col("slot") * F.col("step"), "length": (to - F.col("slot") * F.col("step")).cast("bigint")})
    return stay.unionByName(out.select(*bar, "beats", "bar_length", F.col("offset").cast("bigint").alias("offset"), "length", "symbol", "i"))


def one_chord_a_bar(chords: DataFrame, by: list[str], order: list[str], symbol: str, length: Column, beats: Column) -> DataFrame:
    """The chart of chords without a usable tempo: chord i fills bar i, which states no rhythm that isn't known."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    zero = F.lit(0).cast("bigint")
    return chords.select(*by, i.cast("bigint").alias("bar"), beats.cast("int").alias("beats"), length.cast("bigint").alias("bar_length"), zero.alias("offset"), length.cast("bigint").alias("length"), F.col(symbol).cast("string").alias("symbol"), i.cast("int").alias("i"))


def named(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells with ``named``: whether they begin a run of one symbol, over all bars of a chart."""
    w = Window.partitionBy(*by).orderBy("bar", "offset")
    return cells.withColumn("named", (F.row_number().over(w) == 1) | ~F.col("symbol").eqNullSafe(F.lag("symbol").over(w)))


def chart(chords: DataFrame, by: list[str], order: list[str], start: str, end: str, symbol: str, meters: DataFrame, origin: Column, grid: Column, usable: Column, finest: int) -> DataFrame:
    """The chart of each recording: (bar, beats, bar_length, offset, length, symbol, named), reduced to the harmonic rhythm.

    Where ``usable`` (the tempo is known) is false, a bar holds one chord.  meters: (key, start_bar, length, beats), from bar 0 on.
    """
    timed = on_grid(chords.where(usable), by, order, start, end, origin, grid).withColumn("__symbol", F.col(symbol).cast("string"))
    ends = timed.groupBy(*by).agg(F.max("from").alias("start"), F.max("last").alias("last"))
    cells = at_harmonic_rhythm(cells_of(timed, bars_of(ends, meters, by), by, "__symbol"), by, finest)
    opening = meters.where("start_bar = 0").select(*by, F.col("length").alias("__length"), F.col("beats").alias("__beats"))
    plain = one_chord_a_bar(chords.where(~usable).join(opening, by), by, order, symbol, F.col("__length"), F.col("__beats"))
    return named(cells.unionByName(plain), by).drop("i")


def chart_text(cells: DataFrame, by: list[str], bars_a_line: int = 4, width: int = 12) -> DataFrame:
    """K3: (line, text) of a chart: bars between strokes, each with the symbols it newly names, N.C. for the gap before the first chord, % for none."""
    symbol = F.when(F.col("named"), F.struct("offset", F.coalesce("symbol", F.lit("N.C.")).alias("s")))
    bars = cells.groupBy(*by, "bar").agg(F.array_sort(F.collect_list(symbol)).alias("__l"))
    text = F.when(F.size("__l") == 0, "%").otherwise(F.array_join(F.transform("__l", lambda x: x["s"]), " "))
    padded = bars.withColumn("__c", F.rpad(text, F.greatest(F.lit(width), F.length(text)), " "))
    lines = padded.groupBy(*by, F.floor(F.col("bar") / bars_a_line).alias("line")).agg(F.array_sort(F.collect_list(F.struct("bar", "__c"))).alias("__b"))
    return lines.select(*by, "line", F.concat(F.lit("| "), F.array_join(F.transform("__b", lambda x: x["__c"]), "| "), F.lit("|")).alias("text"))
