"""Printed layout: chart lines, repeat tags, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempograph.functions.theory import letters

CELL, BARS_A_LINE = 12, 4


def chart_lines(cells: DataFrame, by: list[str], bar: str, order: list[str], symbol: str) -> DataFrame:
    """K3: lines of four bars, each with the symbols it newly names, or % for none."""
    w = Window.partitionBy(*by).orderBy(bar, *order)
    named = cells.withColumn("__new", ~F.col(symbol).eqNullSafe(F.lag(symbol).over(w)))
    own = F.when(F.col("__new"), F.struct(*order, F.col(symbol).alias("__s")))
    bars = named.groupBy(*by, bar).agg(F.array_sort(F.collect_list(own)).alias("__l"))
    cell = F.when(F.size("__l") == 0, "%").otherwise(F.array_join(F.transform("__l", lambda x: x["__s"]), " "))
    padded = bars.withColumn("__c", F.rpad(cell, F.greatest(F.lit(CELL), F.length(cell)), " "))
    lines = padded.groupBy(*by, F.floor(F.col(bar) / BARS_A_LINE).alias("line")).agg(F.array_sort(F.collect_list(F.struct(bar, "__c"))).alias("__b"))
    return lines.select(*by, "line", F.concat(F.lit("| "), F.array_join(F.transform("__b", lambda x: x["__c"]), "| "), F.lit("|")).alias("text"))


def repeat_tags(lines: DataFrame, by: list[str], order: list[str], text: str) -> DataFrame:
    """Lines that occur at least twice get a letter by their first appearance."""
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = lines.withColumn("__i", F.row_number().over(w))
    same = Window.partitionBy(*by, text)
    marked = numbered.withColumns({"__n": F.count("*").over(same), "__first": F.min("__i").over(same)})
    again = F.when(F.col("__n") >= 2, F.col("__first"))
    rank = F.dense_rank().over(Window.partitionBy(*by, (F.col("__n") >= 2)).orderBy("__first")) - 1
    return marked.withColumn("tag", F.when(again.isNotNull(), letters(rank))).drop("__i", "__n", "__first")


def overlay(layers: list, default):
    """The first layer, from the strongest on, that says anything."""
    return F.coalesce(*layers, F.lit(default))


def free_names(takes: DataFrame, by: list[str], stamp: str, order: list[str], out: str = "name") -> DataFrame:
    """The stamp as a name; the second and later takes of one stamp get -2, -3 and so on."""
    k = F.row_number().over(Window.partitionBy(*by, stamp).orderBy(*order))
    return takes.withColumn(out, F.concat(F.col(stamp), F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise("")))


def newest_first(takes: DataFrame, by: list[str], at: str, name: str) -> DataFrame:
    """Each take's place in a listing, newest first, then by name."""
    return takes.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at), name)))
