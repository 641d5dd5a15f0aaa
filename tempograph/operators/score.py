"""Operators over score tables: tempo maps, placement on grids, spelling by key and chord, harmony from audio."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.functions import theory
from tempograph.functions import vectors as V
from tempograph.operators.temporal import asof_join, islands, nearest_join, overlap_join, point_in_interval


def beats_to_seconds(df: DataFrame, segments: DataFrame, by: list[str], beat: str, out: str = "seconds") -> DataFrame:
    """Through the tempo segment (start_beat, start_seconds, bpm) that holds the beat; the first for earlier beats."""
    hit = asof_join(df, segments, by, beat, "start_beat", ["start_seconds"], ["start_beat", "start_seconds", "bpm"], clamp=True)
    y = F.col("start_seconds") + (F.col(beat) - F.col("start_beat")) * 60 / F.col("bpm")
    return hit.withColumn(out, y).select(*df.columns, out)


def seconds_to_beats(df: DataFrame, segments: DataFrame, by: list[str], seconds: str, out: str = "beat") -> DataFrame:
    """J1, J2, the other way."""
    hit = asof_join(df, segments, by, seconds, "start_seconds", ["start_beat"], ["start_beat", "start_seconds", "bpm"], clamp=True)
    return hit.withColumn(out, F.col("start_beat") + (F.col(seconds) - F.col("start_seconds")) * F.col("bpm") / 60).select(*df.columns, out)


def constant_tempo(spark, bpm: float, num: int = 4, den: int = 4) -> DataFrame:
    """One segment at a counted tempo, as a quarter tempo."""
    compound = num > 3 and num % 3 == 0 and den >= 8
    return spark.createDataFrame([(0.0, 0.0, bpm * (12 if compound else 4) / den, "SUPPLIED")], "start_beat double, start_seconds double, bpm double, provenance string")


def consistent_tempo(segments: DataFrame, by: list[str]) -> DataFrame:
    """Segments whose start differs from where the one before leads, beyond max(1.5 ms, a millionth)."""
    w = Window.partitionBy(*by).orderBy("start_beat")
    led = F.lag("start_seconds").over(w) + (F.col("start_beat") - F.lag("start_beat").over(w)) * 60 / F.lag("bpm").over(w)
    return segments.withColumn("__led", led).where(F.abs(F.col("__led") - F.col("start_seconds")) > F.greatest(F.lit(0.0015), 1e-6 * F.abs("start_seconds"))).drop("__led")


def estimated_tempo(segments: DataFrame, beats: DataFrame, by: list[str]) -> DataFrame:
    """The stated tempo where all segments are supplied and agree; else the grid's steady rate; else the average of the segments."""
    from tempograph.operators.stats import steady_rate

    w = Window.partitionBy(*by).orderBy("start_beat")
    s = segments.withColumn("__len", F.lead("start_beat").over(w) - F.col("start_beat"))
    stated = s.groupBy(*by).agg(
        F.when(F.every(F.col("provenance") == "SUPPLIED") & (F.max("bpm") - F.min("bpm") < 1e-9), F.max("bpm")).alias("stated"),
        F.when(F.count("*") == 1, F.max("bpm")).otherwise(F.try_divide(F.sum("__len"), F.sum(F.when(F.col("__len").isNotNull(), F.col("__len") / F.col("bpm"))))).alias("average"),
    )
    steady = steady_rate(beats, by, "seconds", ["seconds"]).select(*by, (60 / F.col("steady_gap")).alias("steady"))
    return stated.join(steady, by, "left").select(*by, F.coalesce("stated", "steady", "average").alias("bpm"))


def bass_over(spans: DataFrame, notes: DataFrame, by: list[str], width: int, dominance: float = 0.6) -> DataFrame:
    """For each span the pitch class that is lowest most of the time: of the declared bass part if it sounds there, else of all notes; null under the dominance."""
    pair = overlap_join(spans, notes, by, ("start_us", "end_us"), ("onset", "off"), width)
    length = F.least("end_us", "off") - F.greatest("start_us", "onset")
    sums = pair.groupBy(*by, "span", "bass_part", "pc").agg(F.sum(length).alias("t"), F.min("midi").alias("low"))
    use_bass = F.max("bass_part").over(Window.partitionBy(*by, "span"))
    own = sums.withColumn("__use", use_bass).where(F.col("bass_part") == F.col("__use"))
    total = own.groupBy(*by, "span").agg(F.sum("t").alias("__total"))
    w = Window.partitionBy(*by, "span").orderBy(F.desc("t"), "low", "pc")
    best = own.withColumn("__r", F.row_number().over(w)).where("__r = 1").join(total, [*by, "span"])
    bass = best.select(*by, "span", F.when(F.col("t") >= dominance * F.col("__total"), F.col("pc")).alias("bass"))
    return spans.join(bass, [*by, "span"], "left")


def run_bass(spans: DataFrame, by: list[str], run: str) -> DataFrame:
    """A run's bass, where all its spans agree."""
    return spans.groupBy(*by, run).agg(F.when((F.min("bass") == F.max("bass")) & (F.count("bass") == F.count("*")), F.min("bass")).alias("bass"))


def with_axis(*sides: DataFrame) -> list[DataFrame]:
    """(lo, hi) of every side on the beat axis if all sides have beats on all rows, else in seconds."""
    flags = [s.agg(F.coalesce(F.every(F.col("start_beat").isNotNull() & F.col("end_beat").isNotNull()), F.lit(True)).alias("ok")) for s in sides]
    every = flags[0]
    for f in flags[1:]:
        every = every.union(f)
    ok = every.agg(F.every("ok").alias("__beats"))
    pick = lambda b, s: F.when(F.col("__beats"), F.col(b)).otherwise(F.col(s))
    return [s.join(F.broadcast(ok)).withColumns({"lo": pick("start_beat", "start_seconds"), "hi": pick("end_beat", "end_seconds")}).drop("__beats") for s in sides]  # one row


def forced_downbeat(beats: DataFrame, wanted: DataFrame, by: list[str], per_bar: int, tolerance: float = 0.07) -> DataFrame:
    """Bar positions so that the beat nearest to a wanted time is a downbeat, with the confidence of that snap."""
    w = Window.partitionBy(*by).orderBy("seconds")
    numbered = beats.withColumn("beat_no", F.row_number().over(w) - 1)
    near = nearest_join(wanted, numbered, by, "wanted", "seconds", ["beat_no"], ["seconds", "beat_no"])
    chosen = near.select(*by, F.col("beat_no").alias("__no"), V.clamp01(1 - F.abs(F.col("seconds") - F.col("wanted")) / tolerance).alias("confidence"))
    placed = numbered.join(chosen, by).withColumn("pos", F.pmod(F.col("beat_no") - F.col("__no"), F.lit(per_bar)))
    return placed.withColumn("downbeat", F.col("pos") == 0).drop("__no")


def beat_phases(beats: DataFrame, by: list[str], per_bar: int, phase: int = 0) -> DataFrame:
    """Position in the bar and downbeat flag of each beat."""
    w = Window.partitionBy(*by).orderBy("seconds")
    return beats.withColumn("pos", F.pmod(F.row_number().over(w) - 1 - phase, F.lit(per_bar)).cast("int")).withColumn("downbeat", F.col("pos") == 0)


def place_spans(df: DataFrame, by: str, start: str, end: str, snap: Callable[[float], float], all_or_nothing: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Spans snapped to a grid, each from where the one before ends at the earliest; a span without length is null (with
    ``all_or_nothing``, then all of the key are).  Equal spans go by ``ties``.  The state runs along a recording, which is one group."""
    schema = df.schema.simpleString()[7:-1] + ",placed_start:double,placed_end:double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([start, end, *ties], kind="stable")
        furthest, out = float("-inf"), []
        for s, e in zip(pdf[start], pdf[end]):
            a, b = max(snap(s), furthest), snap(e)
            if b <= a:
                out.append((None, None))
            else:
                out.append((a, b))
                furthest = b
        if all_or_nothing and any(a is None for a, _ in out):
            out = [(None, None)] * len(out)
        return pdf.assign(placed_start=[a for a, _ in out], placed_end=[b for _, b in out])

    return df.groupBy(by).applyInPandas(run, schema)


def spell_notes(notes: DataFrame, chords: DataFrame, keys: DataFrame, by: list[str], at: str) -> DataFrame:
    """Fifths of each note: as the chord sounding there spells it if it is a chord tone, else nearest to the key, else to the region's centre."""
    c = point_in_interval(notes, chords, by, at, "start", "end", ["root", "quality"])
    k = point_in_interval(c, keys, by, at, "start", "end", ["signature"])
    centre = F.coalesce(F.col("signature") + 2, F.lit(2))
    tone = F.coalesce(F.array_contains(theory.chord_classes(F.col("root"), F.col("quality")), F.col("pc")), F.lit(False))
    by_chord = theory.fifths_of(F.col("pc"), theory.fifths_of(F.col("root"), centre) + 1)
    return k.withColumn("fifths", F.when(tone, by_chord).otherwise(theory.fifths_of(F.col("pc"), centre))).drop("root", "quality", "signature")


def fifths_centre(chords: DataFrame, by: list[str]) -> DataFrame:
    """Mean place of the roots on the line of fifths and one more; 2 without any."""
    return chords.groupBy(*by).agg(F.coalesce(F.avg("fifths") + 1, F.lit(2.0)).alias("centre"))


def respell_chords(chords: DataFrame, keys: DataFrame, by: list[str], order: list[str], at: str) -> DataFrame:
    """Roots spelled in the key that holds the chord; a run of chords outside all keys shares one centre, that of the key before it (else after)."""
    from tempograph.operators.temporal import neighbours

    k = point_in_interval(chords, keys, by, at, "start", "end", ["signature"])
    runs = islands(k.withColumn("__out", F.col("signature").isNull()), by, order, "__out")
    near = neighbours(runs, by, order, "signature")
    shared = F.first(F.coalesce("previous_known", "next_known", F.lit(0))).over(Window.partitionBy(*by, "run").orderBy(*order))
    centre = F.coalesce("signature", shared) + 2
    return near.withColumn("fifths", theory.fifths_of(F.col("root"), centre)).drop("__out", "run", "previous_known", "next_known", "signature")


def transpose_track(notes: DataFrame, by: list[str], semitones: int, low: int = 0, high: int = 127) -> tuple[DataFrame, DataFrame]:
    """Notes moved by up to two octaves, and the tracks left out because some note would leave the range."""
    if not -24 <= semitones <= 24:
        raise ValueError("at most two octaves")
    moved = notes.withColumn("midi", F.col("midi") + semitones)
    gone = moved.where(~F.col("midi").between(low, high)).select(*by).distinct()
    spelled = F.when(F.lit(semitones % 12 == 0), F.col("fifths")) if "fifths" in notes.columns else F.lit(None).cast("int")
    return moved.join(gone, by, "left_anti").withColumn("fifths", spelled), gone


AUDIO_QUALITIES = ("MAJOR", "MINOR", "DOMINANT_SEVENTH")


def quality_scores(treble: Column, root: Column) -> list[tuple[int, Column, float]]:
    """(place, score, score of a flat chroma) of each quality on a root: the share of the chroma's length along the chord's
    notes, less, for a minor third, what of the major third the root's overtones don't explain (a quarter of the root)."""
    energy = F.sqrt(V.total(F.transform(treble, lambda x: x * x)))
    at = lambda k: F.get(treble, F.pmod(root + k, F.lit(12)))
    out = []
    for i, name in enumerate(AUDIO_QUALITIES):
        steps = theory.INTERVALS[name]
        mass, flat = sum((at(k) for k in steps[1:]), at(steps[0])), len(steps) / 12
        if 3 in steps:
            mass, flat = mass - F.greatest(F.lit(0.0), at(4) - 0.25 * at(0)), flat - 0.75 / 12
        size = len(steps) ** 0.5
        out.append((i, F.when(energy > 0, mass / (energy * size)).otherwise(0.0), flat / (size * 12**-0.5)))
    return out


def audio_chords(spans: DataFrame, by: list[str], order: list[str], state: str, chroma: str, similarity: str) -> DataFrame:
    """Chords from a decoder's states (quality * 12 + root; 36 is none), with their confidence.

    Neighbouring spans of one root are a run, whatever their quality; over its summed chroma the quality that fits best is
    chosen for all of it, among those that fit better than a flat chroma would (if none does, the decoder's stay).
    """
    root = F.when(F.col(state) < 36, F.col(state) % 12).otherwise(-1)
    runs = islands(spans.withColumn("__root", root), by, order, "__root")
    sums = runs.groupBy(*by, "run", "__root").agg(F.array(*[F.sum(F.get(chroma, F.lit(k))) for k in range(12)]).alias("treble"))
    ranked = [F.when((score > 0) & (score > flat), F.struct((-score).alias("k"), F.lit(i).alias("i"))) for i, score, flat in quality_scores(F.col("treble"), F.col("__root"))]
    best = F.array_min(F.array_compact(F.array(*ranked)))["i"]
    chosen = sums.select(*by, "run", F.when(F.col("__root") >= 0, best * 12 + F.col("__root")).alias("__best"))
    # A heavy recording's frames stay where they are: the choice is one row a run.
    judged = runs.join(chosen, [*by, "run"]).withColumn("__state", F.coalesce("__best", state)).drop("run")
    again = islands(judged, by, order, "__state")
    named = again.groupBy(*by, "run").agg(F.min(F.struct(*order)).alias("__first"), F.first("__state").alias("state"), F.count("*").alias("n"), V.clamp01((F.avg(F.get(similarity, F.col("__state"))) - 0.65) / 0.35).alias("confidence"))
    quality = F.coalesce(theory.pick(list(AUDIO_QUALITIES), F.floor(F.col("state") / 12).cast("int")), F.lit("NONE"))
    return named.select(*by, *(F.col(f"__first.{c}").alias(f"first_{c}") for c in order), "n", "state", quality.alias("quality"), F.when(F.col("state") < 36, F.col("state") % 12).alias("root"), "confidence")


def decided_confidence(winner: Column, runner_up: Column, fit: Column) -> Column:
    """0.9 of the fit times how far the winner leads, up to 0.15."""
    return 0.9 * fit * V.clamp01((winner - runner_up) / 0.15)


def rate_of_class(df: DataFrame, by: list[str], label: str, hit: str) -> DataFrame:
    """Recall of each class."""
    return df.groupBy(*by, label).agg(F.count("*").alias("n"), (F.count_if(hit) / F.count("*")).alias("recall"))


def short_changes(chords: DataFrame, by: list[str], order: list[str], start: str, beat) -> DataFrame:
    """Chords for each bar's worth of time, and the share of changes under a beat apart."""
    w = Window.partitionBy(*by).orderBy(*order)
    gap = F.col(start) - F.lag(start).over(w)
    return chords.withColumn("__g", gap).groupBy(*by).agg(F.count("*").alias("chords"), F.coalesce(F.try_divide(F.count_if(F.col("__g") < beat), F.count("__g")), F.lit(0.0)).alias("short_share"))


def unnamed_share(chords: DataFrame, by: list[str]) -> DataFrame:
    """Share of the time without a chord, and the mean confidence (0 if none)."""
    length = F.col("end") - F.col("start")
    return chords.groupBy(*by).agg((F.coalesce(F.sum(F.when(F.col("quality") == "NONE", length)), F.lit(0.0)) / F.sum(length)).alias("no_chord_share"), F.coalesce(F.avg(F.when(F.col("quality") != "NONE", F.col("confidence"))), F.lit(0.0)).alias("confidence"))


def music_span(notes: DataFrame, by: list[str], bar: float) -> DataFrame:
    """First and last beat of all parts, and the pickup: beats of the first bar before its line that hold anything."""
    s = notes.groupBy(*by).agg(F.min("beat").alias("first_beat"), F.max("end_beat").alias("last_beat"))
    into = F.col("first_beat") - F.floor(F.col("first_beat") / bar) * bar
    return s.withColumn("pickup", F.when(into > 0, bar - into).otherwise(0.0))


def chart_grid(starts: DataFrame, by: list[str], start: str, beat: float, finest: float = 1 / 16) -> DataFrame:
    """L4: the beat halved while the closest two starts are nearer than the grid, down to a 64th note."""
    w = Window.partitionBy(*by).orderBy(start)
    gap = starts.select(*by, start).distinct().withColumn("__g", F.col(start) - F.lag(start).over(w)).groupBy(*by).agg(F.min("__g").alias("__g"))
    halvings = F.greatest(F.lit(0.0), F.ceil(F.log2(beat / F.col("__g")) - 1e-9).cast("double"))
    return gap.select(*by, F.when(F.col("__g").isNull(), F.lit(beat)).otherwise(F.greatest(F.lit(finest), beat / F.pow(F.lit(2.0), halvings))).alias("grid"))


def merge_scores(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Tracks replaced by role, those of role OTHER by role and name."""
    key = F.concat_ws("/", "role", F.when(F.col("role") == "OTHER", F.col("name")).otherwise(F.lit("")))
    o, n = old.withColumn("__k", key), new.withColumn("__k", key)
    return o.join(n.select(*by, "__k").distinct(), [*by, "__k"], "left_anti").unionByName(n).drop("__k")


def guarded(df: DataFrame, by: list[str], most: int, what: str) -> DataFrame:
    """The rows of each key, failing where a key has more than a limit (counted apart, so no key is gathered)."""
    counts = df.groupBy(*by).agg(F.count("*").alias("__n"))
    fine = F.when(F.col("__n") > most, F.raise_error(F.lit(f"more than {most} {what}")).cast("boolean")).otherwise(F.lit(True))
    return df.join(counts, by).where(fine).drop("__n")


def counted(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """O8 as a verdict: the rows with ``n``, the number of their key's rows, and ``within``, whether that is within a limit."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    return df.join(counts, by).withColumn("within", F.col("n") <= most)


def playable(notes: DataFrame) -> DataFrame:
    """Notes with a place on the beat axis that are no drums, by onset."""
    return notes.where((F.col("role") != "DRUMS") & F.col("start_beat").isNotNull() & F.col("end_beat").isNotNull())


def with_ends(notes: DataFrame) -> DataFrame:
    """end = start + length on the beat axis and in seconds."""
    return notes.withColumns({"end_beat": F.col("start_beat") + F.col("beats"), "end_seconds": F.col("start_seconds") + F.col("seconds")})


def producible(parts: DataFrame) -> DataFrame:
    """Whether a part can be written on a staff, and why not."""
    reason = F.when(F.col("role") == "DRUMS", "percussion has no staff here").when(F.col("notes") == 0, "the part has no notes").when(~F.col("quantized"), "its notes have no place in a bar")
    return parts.withColumn("reason", reason).withColumn("producible", F.col("reason").isNull())


def accent_downbeat(beats: DataFrame, by: list[str], per_bar: int) -> DataFrame:
    """The phase with the loudest beats, at a confidence of 0.35 (sure where a bar is one beat)."""
    from tempograph.operators.stats import phase_means
    from tempograph.operators.temporal import first_of_each

    best = first_of_each(phase_means(beats, by, "beat_no", "strength", per_bar), by, [F.desc("mean"), "phase"])
    return best.select(*by, "phase", F.lit(1.0 if per_bar == 1 else 0.35).alias("confidence"))


def summary(chords: DataFrame, beats: DataFrame, by: list[str]) -> DataFrame:
    """What was found in each recording, in words."""
    from tempograph.operators.stats import change_count, steady_rate

    rate = steady_rate(beats, by, "seconds", ["seconds"]).select(*by, (60 / F.col("steady_gap")).alias("bpm"))
    count = beats.groupBy(*by).agg(F.count("*").alias("beats"))
    named = change_count(chords, by, ["start"], "symbol").join(chords.groupBy(*by).agg(F.count_if(F.col("quality") != "NONE").alias("chords")), by)
    all_of = count.join(rate, by, "left").join(named, by, "left")
    text = F.format_string("%d beats at %.1f BPM, %d chords, %d changes", "beats", F.coalesce("bpm", F.lit(0.0)), F.coalesce("chords", F.lit(0).cast("bigint")), F.coalesce("changes", F.lit(0).cast("bigint")))
    return all_of.select(*by, text.alias("summary"))


def wanted_parts(parts: Column) -> Column:
    """Requested parts without repeats, in their first order."""
    return F.array_distinct(parts)


def without_repeats(chords: DataFrame, by: list[str], order: list[str], symbol: str) -> DataFrame:
    """Only the rows whose symbol differs from the one before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return chords.withColumn("__p", F.lag(symbol).over(w)).where(~F.col(symbol).eqNullSafe(F.col("__p"))).drop("__p")
