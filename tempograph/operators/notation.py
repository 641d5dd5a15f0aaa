"""Staff and chord notation: note values, tokens, LilyPond, MusicXML."""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.functions import theory

SHORTEST = Fraction(1, 16)
# Chordmode suffix of each quality.
SUFFIXES = {
    "MAJOR": "",
    "MINOR": ":m",
    "DIMINISHED": ":dim",
    "AUGMENTED": ":aug",
    "SUSPENDED_SECOND": ":sus2",
    "SUSPENDED_FOURTH": ":sus4",
    "DOMINANT_SEVENTH": ":7",
    "MAJOR_SEVENTH": ":maj7",
    "MINOR_SEVENTH": ":m7",
    "MINOR_MAJOR_SEVENTH": ":m7+",
    "HALF_DIMINISHED_SEVENTH": ":m7.5-",
    "DIMINISHED_SEVENTH": ":dim7",
    "SIXTH": ":6",
    "MINOR_SIXTH": ":m6",
    "NONE": "",
}
LILY_SHARPS = ["c", "cis", "d", "dis", "e", "f", "fis", "g", "gis", "a", "ais", "b"]


def single_value(length: Fraction) -> bool:
    """Whether one note, dotted or not, lasts so long."""
    for k in range(7):
        plain = Fraction(4, 1 << k)
        if length in (plain, plain * 3 / 2) and plain >= SHORTEST:
            return True
    return False


@lru_cache(maxsize=None)
def metric_units(num: int, den: int) -> tuple[Fraction, tuple[Fraction, ...]]:
    """The counted beat of a meter, and the grids of its bar from coarse to fine, as lengths of a step.

    Half bars while they hold a power of two of beats, the beats, thirds of a compound beat, and then halves of halves.
    """
    compound = num > 3 and num % 3 == 0 and den >= 8
    beat = Fraction(12 if compound else 4, den)
    beats = int(Fraction(4 * num, den) / beat)
    counts = [beats >> k for k in range(1, beats.bit_length())] if beats & (beats - 1) == 0 else [1]
    steps = [beat * n for n in counts if beats > 1]
    steps.append(beat / 3 if compound else beat / 2)
    while steps[-1] / 2 >= SHORTEST:
        steps.append(steps[-1] / 2)
    return beat, tuple(x for x in steps if x >= SHORTEST)


@lru_cache(maxsize=1 << 16)
def split_span(num: int, den: int, start: Fraction, end: Fraction) -> tuple[Fraction, ...]:
    """A span of a bar as tied note values that follow the meter.

    The strongest lines inside the span are those of the coarsest grid that has any.  If the span measures whole steps
    of that grid, or one and a half, and can be one note, and either begins on a beat or leaves every beat line but the
    next one visible, it is one note.  Else it is cut at the first and the last of these lines; what is between them is
    written in the longest notes of whole steps, from the left, and the two ends are split in the same way.
    """
    beat, grids = metric_units(num, den)
    length = Fraction(end - start)
    if length <= 0:
        return ()
    step = next((g for g in grids if (start // g + 1) * g < end), None)
    if step is None:
        return (length,)
    in_steps = length / step
    natural = in_steps.denominator == 1 or in_steps == Fraction(3, 2)
    hides = end > (start // beat + 2) * beat or (beat.numerator % 3 == 0 and length >= beat)
    if natural and single_value(length) and (start % beat == 0 or not hides):
        return (length,)
    first, last = -(-start // step) * step, end // step * step
    values, at = list(split_span(num, den, start, first)), first
    while at < last:
        whole = [n * step for n in range(int((last - at) / step), 0, -1) if single_value(n * step)]
        values += [whole[0]] if whole else split_span(num, den, at, at + step)
        at += whole[0] if whole else step
    return (*values, *split_span(num, den, last, end))


def split_values(num: Column, den: Column, start, end) -> Column:
    """D22 over columns.  Few spans differ, so each is split once a worker."""

    @F.pandas_udf("array<double>")
    def split(num: pd.Series, den: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in split_span(int(n), int(d), Fraction(s), Fraction(e))] for n, d, s, e in zip(num, den, start, end)])

    return split(num, den, start, end)


def chordmode_token(root: Column, quality: Column, bass: Column, quarters: Column) -> Column:
    """K5: root, length, quality and, for a slash chord, the bass; r for no chord."""
    length = theory.duration_token(quarters)
    suffix = F.element_at(F.create_map(*[F.lit(x) for p in SUFFIXES.items() for x in p]), quality)
    slash = F.when(bass.isNotNull() & (bass != root), F.concat(F.lit("/"), theory.pick(LILY_SHARPS, bass))).otherwise(F.lit(""))
    return F.when(root.isNull() | (quality == "NONE"), F.concat(F.lit("r"), length)).otherwise(F.concat(theory.pick(LILY_SHARPS, root), length, suffix, slash))


def lilypond_chart(cells: DataFrame, by: str, title: str = "Untitled") -> DataFrame:
    """K4: a chord chart of each recording, from cells (bar, offset, token)."""
    bars = cells.groupBy(by, "bar").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "token"))), lambda x: x["token"]), " ").alias("line"))
    body = bars.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bar", "line"))), lambda x: F.concat(F.lit("      "), x["line"], F.lit(" |"))), "\n").alias("body"))
    head = '\\version "2.24.0"\n\n\\header {\n  title = "' + title.replace("\\", "\\\\").replace('"', '\\"') + '"\n  tagline = ##f\n}\n\n\\score {\n  \\new ChordNames {\n    \\chordmode {\n'
    tail = '\n    }\n    \\bar "|."\n  }\n  \\layout { }\n}\n'
    return body.select(by, F.concat(F.lit(head), "body", F.lit(tail)).alias("document"))


def staff_events(notes: DataFrame, by: list[str], beat: str, end_beat: str, midi: str, step: float = 0.25) -> DataFrame:
    """Snapped onsets with their distinct pitches, low to high, each ending where the next begins at the latest."""
    from tempograph.functions.vectors import snap

    start, end = snap(F.col(beat), step), snap(F.col(end_beat), step)
    snapped = notes.withColumns({"start": start, "stop": F.greatest(start + step, end)})
    grouped = snapped.groupBy(*by, "start").agg(F.array_sort(F.collect_set(midi)).alias("pitches"), F.max("stop").alias("stop"))
    w = Window.partitionBy(*by).orderBy("start")
    return grouped.withColumn("stop", F.least("stop", F.lead("start").over(w)))


def filled(events: DataFrame, by: list[str], first: float = 0.0) -> DataFrame:
    """The events and rests (no pitches) in every gap from ``first`` on."""
    w = Window.partitionBy(*by).orderBy("start")
    before = F.coalesce(F.lag("stop").over(w), F.lit(first))
    rests = events.withColumn("__from", before).where(F.col("__from") < F.col("start"))
    rests = rests.select(*by, F.col("__from").alias("start"), F.array().cast("array<int>").alias("pitches"), F.col("start").alias("stop"))
    return events.select(*by, "start", "pitches", "stop").unionByName(rests)


def bar_pieces(events: DataFrame, by: list[str], num: int = 4, den: int = 4) -> DataFrame:
    """Events cut at bar lines, ``tied`` where a sounding piece goes on in the next bar, with note values of each."""
    length = 4.0 * num / den
    low, high = F.floor(F.col("start") / length), F.ceil(F.col("stop") / length) - 1
    each = events.where("stop > start").withColumn("bar", F.explode(F.sequence(low, high)))
    line = F.col("bar") * length
    cut = each.withColumns({"from_beat": F.greatest(F.col("start"), line) - line, "to_beat": F.least(F.col("stop"), line + length) - line})
    cut = cut.withColumn("tied", (F.size("pitches") > 0) & (F.col("stop") > line + length))
    return cut.withColumn("values", split_values(F.lit(num), F.lit(den), "from_beat", "to_beat"))


def staff_token(pitches: Column, quarters: Column, tie: Column) -> Column:
    """R, a pitch or <a chord>, with its length and ~ for a tie."""
    octave = lambda m: F.floor(m / 12) - 4
    mark = lambda m: F.when(octave(m) > 0, F.repeat(F.lit("'"), F.greatest(octave(m), F.lit(0)).cast("int"))).otherwise(F.repeat(F.lit(","), F.greatest(-octave(m), F.lit(0)).cast("int")))
    one = lambda m: F.concat(theory.pick(LILY_SHARPS, F.pmod(m, F.lit(12))), mark(m))
    names = F.transform(pitches, one)
    body = F.when(F.size(pitches) == 0, "r").when(F.size(pitches) == 1, F.get(names, F.lit(0))).otherwise(F.concat(F.lit("<"), F.array_join(names, " "), F.lit(">")))
    return F.concat(body, theory.duration_token(quarters), F.when(tie & (F.size(pitches) > 0), "~").otherwise(""))


def staff_lines(pieces: DataFrame, by: list[str]) -> DataFrame:
    """K6: (bar, line): the tokens of each bar, tied within and across bars."""
    each = pieces.select(*by, "bar", "from_beat", "pitches", "tied", F.posexplode("values").alias("k", "quarters"), F.size("values").alias("n"))
    token = staff_token(F.col("pitches"), F.col("quarters"), (F.col("k") < F.col("n") - 1) | F.col("tied"))
    bars = each.withColumn("token", token).groupBy(*by, "bar").agg(F.array_sort(F.collect_list(F.struct("from_beat", "k", "token"))).alias("t"))
    return bars.select(*by, "bar", F.concat(F.array_join(F.transform("t", lambda x: x["token"]), " "), F.lit(" |")).alias("line"))


def bar_sums(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Quarters written in each bar, to be compared with the meter's."""
    return pieces.groupBy(*by, "bar").agg(F.sum(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)).alias("quarters"))


def dangling_ties(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Parts whose last piece is tied to nothing."""
    w = Window.partitionBy(*by).orderBy(F.desc("bar"), F.desc("from_beat"))
    return pieces.withColumn("__r", F.row_number().over(w)).where("__r = 1 and tied").select(*by)


def measure_number(bar: Column, pickup: Column) -> Column:
    """0 for a pickup and then the bar's own number, else one more."""
    return F.when(pickup, bar).otherwise(bar + 1)


def musicxml(rows: list[tuple], num: int, den: int, title: str) -> str:
    """A partwise document of (part, bar, from_beat, pitches, value, tie in, tie out) rows, 768 divisions a quarter."""
    root = ET.Element("score-partwise", version="4.0")
    ET.SubElement(ET.SubElement(root, "work"), "work-title").text = title
    listed = ET.SubElement(root, "part-list")
    for p, part in enumerate(sorted({r[0] for r in rows})):
        ET.SubElement(ET.SubElement(listed, "score-part", id=f"P{p + 1}"), "part-name").text = str(part)
        body = ET.SubElement(root, "part", id=f"P{p + 1}")
        own = sorted(r for r in rows if r[0] == part)
        for bar in sorted({r[1] for r in own}):
            measure = ET.SubElement(body, "measure", number=str(bar + 1))
            if bar == min(r[1] for r in own):
                attributes = ET.SubElement(measure, "attributes")
                ET.SubElement(attributes, "divisions").text = "768"
                time = ET.SubElement(attributes, "time")
                ET.SubElement(time, "beats").text, ET.SubElement(time, "beat-type").text = str(num), str(den)
            for _, _, _, pitches, value, tie_in, tie_out in (r for r in own if r[1] == bar):
                for k, midi in enumerate(pitches or [None]):
                    note = ET.SubElement(measure, "note")
                    if k:
                        ET.SubElement(note, "chord")
                    if midi is None:
                        ET.SubElement(note, "rest")
                    else:
                        pitch, name = ET.SubElement(note, "pitch"), theory.SHARPS[midi % 12]
                        ET.SubElement(pitch, "step").text = name[0]
                        if len(name) > 1:
                            ET.SubElement(pitch, "alter").text = "1"
                        ET.SubElement(pitch, "octave").text = str(midi // 12 - 1)
                    ET.SubElement(note, "duration").text = str(int(value * 768 + 0.5))
                    for on, kind in ((tie_in, "stop"), (tie_out, "start")):
                        if on and midi is not None:
                            ET.SubElement(note, "tie", type=kind)
                    plain = value if value in theory.NOTE_TYPES else value / 1.5
                    if plain in theory.NOTE_TYPES:
                        ET.SubElement(note, "type").text = theory.NOTE_TYPES[plain]
                        if plain != value:
                            ET.SubElement(note, "dot")
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode")


def musicxml_documents(pieces: DataFrame, rec: str, part: str, num: int = 4, den: int = 4) -> DataFrame:
    """K7: one document for each recording."""
    kind = pieces.schema[rec].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.sort_values([part, "bar", "from_beat"]).itertuples():
            values, pitches = list(r.note_values), [int(x) for x in r.pitches]
            at = r.from_beat
            for k, v in enumerate(values):
                rows.append((getattr(r, part), int(r.bar), at, pitches, v, bool(pitches) and (k > 0 or r.carried), bool(pitches) and (k < len(values) - 1 or r.tied)))
                at += v
        return pd.DataFrame({rec: [pdf[rec].iloc[0]], "document": [musicxml(rows, num, den, str(pdf[rec].iloc[0]))]})

    carried = (F.size("pitches") > 0) & (F.col("start") < F.col("bar") * (4.0 * num / den))
    ready = pieces.select(rec, part, "bar", "from_beat", "pitches", "tied", F.col("values").alias("note_values"), carried.alias("carried"))
    return ready.groupBy(rec).applyInPandas(run, f"{rec} {kind}, document string")


def tuplet_plan(costs: DataFrame, by: list[str]) -> DataFrame:
    """Bars whose grid divides the beat in threes."""
    return costs.select(*by, "bar", (F.col("divisions") % 3 == 0).alias("tuplet"))


def tuplet_brackets(starts: list[float], lengths: list[float], divisions: int) -> list[tuple[int, int]]:
    """First and last note of each bracket: notes that fill whole beats on a grid of threes."""
    out, first, filled_to = [], None, 0.0
    step = 1.0 / divisions
    for i, (s, n) in enumerate(zip(starts, lengths)):
        if first is None:
            if n % 0.5 > 1e-9 or s % 0.5 > 1e-9:
                first, filled_to = i, s
        if first is not None:
            filled_to = s + n
            if abs(filled_to - round(filled_to)) < step / 4:
                out.append((first, i))
                first = None
    return out




def staff_document(lines: DataFrame, by: str, part: str, clef: str = "treble", num: int = 4, den: int = 4) -> DataFrame:
    """A LilyPond document of each recording, a staff for each part."""
    w = "      "
    body = lines.groupBy(by, part).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bar", "line"))), lambda x: F.concat(F.lit(w), x["line"])), "\n").alias("body"))
    head = F.concat(F.lit('  \\new Staff \\with { instrumentName = "'), F.col(part).cast("string"), F.lit(f'" }} {{\n    \\clef "{clef}"\n    \\time {num}/{den}\n'))
    staves = body.select(by, part, F.concat(head, "body", F.lit('\n    \\bar "|."\n  }')).alias("staff"))
    whole = staves.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(part, "staff"))), lambda x: x["staff"]), "\n").alias("staves"))
    return whole.select(by, F.concat(F.lit('\\version "2.24.0"\n\n\\score {\n  <<\n'), "staves", F.lit("\n  >>\n  \\layout { }\n}\n")).alias("document"))


def repeat_brackets(bars: DataFrame, by: str, bars_a_line: int = 4) -> DataFrame:
    """(line, tag, first bar, last bar) of lines that occur again, from (bar, line text)."""
    from tempograph.operators.layout import repeat_tags

    numbered = bars.withColumn("__line", F.floor(F.col("bar") / bars_a_line))
    lines = numbered.groupBy(by, F.col("__line").alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bar", F.col("line").alias("t")))), lambda x: x["t"]), " ").alias("text"), F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"))
    return repeat_tags(lines, [by], ["line"], "text").where("tag is not null").select(by, "line", "tag", "first_bar", "last_bar")


def tempo_mark(bpm: Column, num: Column, den: Column) -> Column:
    """The counted beat and its rounded rate, or null under one a minute."""
    unit = theory.beat_unit(num, den)
    rate = F.floor(bpm / unit + 0.5).cast("bigint")
    name = F.when(unit == 1.5, "4.").when(unit == 0.5, "8").when(unit == 2.0, "2").otherwise("4")
    return F.when(rate >= 1, F.concat(F.lit('\\tempo \\markup { \\italic "ca." } '), name, F.lit(" = "), rate.cast("string")))
