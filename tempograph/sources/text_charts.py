"""Charts written as text, read back into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograph.functions.theory import parse_pitch


def truth_bars(df: DataFrame, key: str, text: str) -> DataFrame:
    """S11: "A7 A7 F7-D7" as (bar, alt, pitch_class, quality): bars by blanks, alternatives by hyphens."""
    bars = df.select(key, F.posexplode(F.split(F.trim(text), r"\s+")).alias("bar", "__b"))
    alts = bars.select(key, "bar", F.posexplode(F.split("__b", "-")).alias("alt", "__c"))
    root = F.regexp_extract("__c", "^([A-G](?:bb|b|##|#)?)", 1)
    return alts.select(key, "bar", "alt", F.pmod(parse_pitch(F.concat(root, F.lit("4"))), F.lit(12)).alias("pitch_class"), F.regexp_replace("__c", "^[A-G](bb|b|##|#)?", "").alias("quality"))


def chordmode_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """Chordmode tokens as (bar, cell, root, length, quality, bass); r has no root."""
    bars = df.select(key, F.posexplode(F.filter(F.split(text, r"\|"), lambda b: F.trim(b) != "")).alias("bar", "__bar"))
    tokens = bars.select(key, "bar", F.posexplode(F.filter(F.split(F.trim("__bar"), r"\s+"), lambda t: t != "")).alias("cell", "token"))
    part = lambda i: F.regexp_extract("token", r"^([a-g](?:isis|is|eses|es)?|r)(1\*\d+/\d+|\d+\.?)?(:[^/\s]+)?(?:/([a-g](?:is|es)?))?$", i)
    return tokens.select(key, "bar", "cell", F.when(part(1) != "r", part(1)).alias("root"), part(2).alias("length"), part(3).alias("quality"), F.when(part(4) != "", part(4)).alias("bass"))


def renderer_complaints(df: DataFrame, key: str, line_no: str, line: str) -> DataFrame:
    """file, line, column and message of an engraver's warnings; the echo of the source on the two lines after each is skipped."""
    from pyspark.sql import Window

    pattern = r"^(.+?):(\d+):(\d+): (warning|error|programming error): (.*)$"
    w = Window.partitionBy(key).orderBy(line_no)
    hit = F.col(line).rlike(pattern)
    marked = df.withColumns({"__hit": hit, "__echo": F.coalesce(F.lag(hit, 1).over(w), F.lit(False)) | F.coalesce(F.lag(hit, 2).over(w), F.lit(False))})
    found = marked.where(F.col("__hit"))
    part = lambda i: F.regexp_extract(line, pattern, i)
    return found.select(key, line_no, part(1).alias("file"), part(2).cast("int").alias("line"), part(3).cast("int").alias("column"), part(4).alias("level"), part(5).alias("message"))


def lyric_text(words: Column) -> Column:
    """a line's words with blanks, but none after a word that is hyphenated to the next."""
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("glue"))
    step = lambda a, w: F.struct(F.concat(a["text"], F.when(a["glue"], "").otherwise(" "), w["text"]).alias("text"), F.coalesce(w["hyphenatedToNext"], F.lit(False)).alias("glue"))
    return F.aggregate(words, start, step, lambda a: a["text"])


def tempo_text(bpm: Column, unit_quarters: Column) -> Column:
    """The counted tempo, with the quarters where the beat is another value."""
    counted = F.floor(bpm / unit_quarters + 0.5).cast("bigint")
    return F.when(counted < 1, None).when(unit_quarters == 1, F.format_string("%d BPM", counted)).otherwise(F.format_string("%d BPM (%d quarters)", counted, F.floor(bpm + 0.5).cast("bigint")))


def key_text(tonic: Column, mode: Column) -> Column:
    """F12."""
    return F.concat(tonic, F.lit(" "), F.lower(mode))


def meter_text(num: Column, den: Column, groups: Column) -> Column:
    """F16: a meter with its grouping spelled out, e.g. #'(1 1 1 1) 4/4."""
    return F.concat(F.lit("#'("), F.array_join(groups.cast("array<string>"), " "), F.lit(") "), num.cast("string"), F.lit("/"), den.cast("string"))


def first_and_more(items: Column, n: int = 6) -> Column:
    """The first items and how many more there are."""
    more = F.size(items) - n
    return F.concat(F.array_join(F.slice(items, 1, n), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def missing_harmony(chords: Column, beats: Column) -> Column:
    """Why a chart has no chords."""
    return F.when(chords > 0, None).when(beats == 0, "no beats were found, so no chord could be placed").otherwise("beats were found, but nothing that sounds like a chord")
