"""MusicXML as nested rows: notes in measures in parts in scores, built by aggregation and written by Spark's XML functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.functions import theory
from tempograph.operators.notation import measure_number

DIVISIONS = 768
#: What read_score_xml() reads of a document.
READ = """`_version` string, part array<struct<`_id`:string, measure:array<struct<`_number`:int, `_implicit`:string,
  attributes:struct<divisions:int, key:struct<fifths:int>, time:struct<beats:int,`beat-type`:int>>,
  note:array<struct<chord:string, rest:string, pitch:struct<step:string,alter:int,octave:int>, duration:bigint, tie:array<struct<`_type`:string>>, type:string, dot:string,
    `time-modification`:struct<`actual-notes`:int,`normal-notes`:int>>>>>>>"""
XML = {"rowTag": "score-partwise", "attributePrefix": "_", "arrayElementName": "item"}


def note_rows(pieces: DataFrame, by: list[str], length: float = 4.0) -> DataFrame:
    """(key, bar, at, k, midi, ticks, tie_in, tie_out, quarters): a row for each written value and pitch of pieces (bar, from_beat, pitches, tied, values, start), bars being ``length`` quarters.

    Rests have one row without a pitch.  A value is tied to the one before if it goes on within its piece or from the bar before.
    """
    carried = (F.col("from_beat") == 0) & (F.col("start") < F.col("bar") * length)
    each = pieces.withColumn("__carried", carried).select(*by, "bar", "from_beat", "tied", "pitches", "__carried", F.size("values").alias("__n"), F.posexplode("values").alias("__v", "quarters"))
    sounding = F.size("pitches") > 0
    each = each.withColumns({"tie_in": sounding & ((F.col("__v") > 0) | F.col("__carried")), "tie_out": sounding & ((F.col("__v") < F.col("__n") - 1) | F.col("tied"))})
    pitches = F.when(sounding, F.col("pitches")).otherwise(F.array(F.lit(None).cast("int")))
    return each.select(*by, "bar", F.struct("from_beat", "__v").alias("at"), F.posexplode(pitches).alias("k", "midi"), F.round(F.col("quarters") * DIVISIONS).cast("bigint").alias("ticks"), "quarters", "tie_in", "tie_out")


def note_element(flats: Column, actual: Column, normal: Column) -> Column:
    """A note of the columns of note_rows(): chord members, rests, ties, type and dot, and the tuplet's ratio where one is given."""
    empty = lambda on: F.when(on, F.lit(""))
    name = F.when(flats, theory.flat_name(F.pmod("midi", F.lit(12)).cast("int"))).otherwise(theory.sharp_name(F.pmod("midi", F.lit(12)).cast("int")))
    alter = F.when(F.substring(name, 2, 1) == "#", 1).when(F.substring(name, 2, 1) == "b", -1)
    pitch = F.when(F.col("midi").isNotNull(), F.struct(F.substring(name, 1, 1).alias("step"), alter.alias("alter"), (F.floor(F.col("midi") / 12) - 1).cast("int").alias("octave")))
    ties = F.array_compact(F.array(F.when(F.col("tie_in"), F.struct(F.lit("stop").alias("_type"))), F.when(F.col("tie_out"), F.struct(F.lit("start").alias("_type")))))
    plain, dotted = theory.note_type(F.col("quarters")), theory.note_type(F.col("quarters") / 1.5)
    ratio = F.when(actual.isNotNull(), F.struct(actual.cast("int").alias("actual-notes"), normal.cast("int").alias("normal-notes")))
    return F.struct(
        empty(F.col("k") > 0).alias("chord"),
        empty(F.col("midi").isNull()).alias("rest"),
        pitch.alias("pitch"),
        F.col("ticks").alias("duration"),
        F.when(F.size(ties) > 0, ties).alias("tie"),
        F.coalesce(plain, dotted).alias("type"),
        empty(plain.isNull() & dotted.isNotNull()).alias("dot"),
        ratio.alias("time-modification"),
    )


def score_xml(notes: DataFrame, meters: DataFrame, by: list[str], part: str, pickup: Column | None = None) -> DataFrame:
    """(key, document): one MusicXML document of each key's notes (rows of note_rows() with their part; columns ``actual`` and ``normal`` if there are tuplets).

    meters: (key, bar, num, den, fifths) of every bar; a measure states its meter and key where they change.  Where ``pickup``
    (a column of meters) is true, bar 0 is measure 0 and implicit.  A measure gathers its own notes, a part its measures, a score its parts.
    """
    actual, normal = (F.col(c) if c in notes.columns else F.lit(None) for c in ("actual", "normal"))
    rows = notes.join(meters.select(*by, "bar", "fifths"), [*by, "bar"])
    made = rows.select(*by, part, "bar", F.struct("at", "k", note_element(F.col("fifths") < 0, actual, normal).alias("note")).alias("n"))
    measures = made.groupBy(*by, part, "bar").agg(F.transform(F.array_sort(F.collect_list("n"), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(a["k"] - b["k"])), lambda n: n["note"]).alias("note"))
    w = Window.partitionBy(*by, part).orderBy("bar")
    known = measures.join(meters.withColumn("__up", F.lit(False) if pickup is None else pickup), [*by, "bar"])
    first = F.row_number().over(w) == 1
    moved = lambda c: first | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    known = known.withColumns({"__first": first, "__meter": moved("num") | moved("den"), "__key": moved("fifths")})
    stated = F.struct(
        F.when(F.col("__first"), F.lit(DIVISIONS)).alias("divisions"),
        F.when(F.col("__key"), F.struct(F.col("fifths").cast("int").alias("fifths"))).alias("key"),
        F.when(F.col("__meter"), F.struct(F.col("num").cast("int").alias("beats"), F.col("den").cast("int").alias("beat-type"))).alias("time"),
    )
    measure = F.struct(
        measure_number(F.col("bar"), F.col("__up")).cast("int").alias("_number"),
        F.when(F.col("__up") & (F.col("bar") == 0), F.lit("yes")).alias("_implicit"),
        F.when(F.col("__first") | F.col("__meter") | F.col("__key"), stated).alias("attributes"),
        F.col("note"),
    )
    whole = known.select(*by, part, "bar", measure.alias("m")).groupBy(*by, part).agg(F.collect_list(F.struct("bar", "m")).alias("ms"))
    ordered = F.transform(F.array_sort("ms", lambda a, b: (a["bar"] - b["bar"]).cast("int")), lambda x: x["m"])
    number = F.row_number().over(Window.partitionBy(*by).orderBy(part))
    parts = whole.select(*by, number.alias("__i"), F.col(part).cast("string").alias("__name"), ordered.alias("measure"))
    id_of = F.concat(F.lit("P"), F.col("__i").cast("string"))
    parts = parts.select(*by, F.struct("__i", F.struct(id_of.alias("_id"), F.col("__name").alias("part-name")).alias("listed"), F.struct(id_of.alias("_id"), "measure").alias("part")).alias("p"))
    scores = parts.groupBy(*by).agg(F.collect_list("p").alias("ps"))
    in_order = F.array_sort("ps", lambda a, b: a["__i"] - b["__i"])
    document = F.struct(F.lit("4.0").alias("_version"), F.struct(F.transform(in_order, lambda p: p["listed"]).alias("score-part")).alias("part-list"), F.transform(in_order, lambda p: p["part"]).alias("part"))
    return scores.select(*by, F.to_xml(document, XML).alias("document"))


def read_score_xml(documents: DataFrame, by: list[str]) -> DataFrame:
    """(key, part, number, implicit, beats, beat_type, fifths, note): the measures of documents, read back."""
    read = documents.select(*by, F.from_xml("document", READ, XML).alias("d"))
    parts = read.select(*by, F.explode("d.part").alias("p"))
    each = parts.select(*by, F.col("p._id").alias("part"), F.explode("p.measure").alias("m"))
    return each.select(*by, "part", F.col("m._number").alias("number"), F.col("m._implicit").alias("implicit"), F.col("m.attributes.time.beats").alias("beats"), F.col("m.attributes.time.beat-type").alias("beat_type"), F.col("m.attributes.key.fifths").alias("fifths"), F.col("m.note").alias("note"))
