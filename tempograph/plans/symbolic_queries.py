"""Queries over note streams: histograms, chords, keys, meter, layout."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempograph.functions import theory
from tempograph.operators import harmony, meter, score, stats, temporal
from tempograph.plans.bindings import NOTES, ONSETS, ORIGIN, SIX_HOURS, micros, notes, onsets, table

FOUND: dict = {}
DAY = 4 * SIX_HOURS


def query(sql: str | None = None):
    def add(fn):
        FOUND[fn.__name__] = (fn, sql)
        return fn

    return add


HIST = f"""{NOTES}, cutn as (select rec, pc, onset, end_us, unnest(range((onset - {ORIGIN}) // {SIX_HOURS}, (end_us - 1 - {ORIGIN}) // {SIX_HOURS} + 1)) as span from notes),
  parts as (select rec, span, pc, sum(least(end_us, (span + 1) * {SIX_HOURS} + {ORIGIN}) - greatest(onset, span * {SIX_HOURS} + {ORIGIN}))::double as w from cutn group by 1, 2, 3),
  hist as (select rec, span, list_transform(range(12), lambda c: coalesce(list_extract(map_extract(map_from_entries(list((cast(pc as bigint), w))), c), 1), 0.0)) as weight, sum(w) as total from parts group by 1, 2)"""


def histograms(spark, d):
    return harmony.span_histograms(notes(spark, d), ["rec"], "onset", "end_us", "pc", SIX_HOURS, ORIGIN)


@query(f"with {NOTES}, b as (select rec, (min(onset) - {ORIGIN}) // {SIX_HOURS} as a, (max(end_us) - 1 - {ORIGIN}) // {SIX_HOURS} as z from notes group by rec), s as (select rec, unnest(range(a, z + 1)) as span from b) select rec, span, span * {SIX_HOURS} + {ORIGIN} as start_us, span % 4 = 0 as downbeat from s")
def beat_spans(spark, d):
    """L1."""
    b = notes(spark, d).groupBy("rec").agg(F.floor((F.min("onset") - ORIGIN) / SIX_HOURS).alias("a"), F.floor((F.max("end_us") - 1 - ORIGIN) / SIX_HOURS).alias("z"))
    s = b.select("rec", F.explode(F.sequence("a", "z")).alias("span"))
    return s.select("rec", "span", (F.col("span") * SIX_HOURS + ORIGIN).alias("start_us"), (F.col("span") % 4 == 0).alias("downbeat"))


@query(f"with {HIST}, u as (select rec, span, total, weight, unnest(range(12)) as pc from hist) select rec, span, pc, cast(weight[pc + 1] as bigint) as weight, cast(len(list_filter(weight, lambda x: x >= 0.05 * total)) as integer) as tones from u where weight[pc + 1] > 0")
def pitch_class_histogram(spark, d):
    h = histograms(spark, d).select("rec", "span", "tones", F.posexplode("weight").alias("pc", "w"))
    return h.where("w > 0").select("rec", "span", F.col("pc").cast("bigint").alias("pc"), F.col("w").cast("bigint").alias("weight"), "tones")


def _templates_sql() -> str:
    rows = ", ".join(f"({s}, {root}, {list(cl)}, {prior})" for s, _, root, cl, prior in theory.templates())
    return f"tpl as (select * from (values {rows}) t(state, root, classes, prior))"


COVERED = "list_reduce(list_prepend(0.0::double, list_transform(classes, lambda c: weight[c + 1])), lambda a, x: a + x)"
PRESENT = "len(list_filter(classes, lambda c: weight[c + 1] >= 0.05 * total))"
FIT = f"{HIST}, {_templates_sql()}, fits as (select rec, span, state, ({COVERED} / total + 0.5 * ({PRESENT} / len(classes)::double)) / 1.5 - prior::double as score from hist cross join tpl)"


@query(f"with {FIT}, r as (select *, row_number() over (partition by rec, span order by round(score, 9) desc, state) as k from fits) select rec, span, cast(state as integer) as state, round(score, 6) as score from r where k = 1")
def template_fit_top1(spark, d):
    """The best template of each occupied span."""
    best = harmony.best_templates(histograms(spark, d).select("rec", "span", "weight"))
    return best.select("rec", "span", "state", F.round("score", 6).alias("score"))


CHORDS = f"""{FIT}, bounds as (select rec, min(span) as a, max(span) as z from hist group by rec), grid as (select rec, unnest(range(a, z + 1)) as span from bounds),
  quiet as (select list(-prior::double order by state) as em from tpl),
  em as (select g.rec, g.span, row_number() over (partition by g.rec order by g.span) as i, list_append(coalesce(f.em, q.em), 0.47::double) as em
         from grid g cross join quiet q left join (select rec, span, list(score order by state) as em from fits group by 1, 2) f on g.rec = f.rec and g.span = f.span),
  fwd as (select rec, span, i, em as sc, cast(null as double[]) as prev, cast(null as bigint) as lead, cast(null as double) as moving from em where i = 1
          union all
          select e.rec, e.span, e.i, list_transform(range(133), lambda s: greatest(x.sc[s + 1], x.m) + e.em[s + 1]), x.sc, x.l, x.m
          from em e join (select f.rec, f.i, f.sc, list_position(f.sc, list_max(f.sc)) - 1 as l, list_max(f.sc) - case when (e2.span % 4) = 0 then 0.45::double * 0.5::double else 0.45::double end as m
                          from fwd f join em e2 on e2.rec = f.rec and e2.i = f.i + 1) x on e.rec = x.rec and e.i = x.i + 1),
  back as (select rec, span, i, cast(list_position(sc, list_max(sc)) - 1 as bigint) as state, prev, lead, moving from fwd f where i = (select max(i) from em where em.rec = f.rec)
           union all
           select f.rec, f.span, f.i, cast(case when b.prev[b.state + 1] >= b.moving then b.state else b.lead end as bigint), f.prev, f.lead, f.moving from back b join fwd f on f.rec = b.rec and f.i = b.i - 1),
  runs as (select *, sum(c) over (partition by rec order by span rows unbounded preceding) as run from (select rec, span, state, case when row_number() over w > 1 and lag(state) over w <> state then 1 else 0 end as c from back window w as (partition by rec order by span))),
  mass as (select r.rec, run, min(r.span) as a, max(r.span) + 1 as z, any_value(state) as state, list_transform(range(12), lambda c: list_sum(list_transform(list(h.weight) filter (where h.weight is not null), lambda v: v[c + 1]))) as w, sum(total) as t
           from runs r left join hist h on r.rec = h.rec and r.span = h.span group by 1, 2),
  kept as (select m.rec, a, z, case when m.state = 132 or coalesce(t, 0) <= 0 or len(list_filter(classes, lambda c: w[c + 1] >= 0.05 * t)) < 3 then 132 else m.state end as state from mass m left join tpl on tpl.state = m.state),
  again as (select *, sum(c) over (partition by rec order by a rows unbounded preceding) as run from (select *, case when row_number() over w > 1 and lag(state) over w <> state then 1 else 0 end as c from kept window w as (partition by rec order by a)))"""


@query(f"with recursive {CHORDS} select rec, min(a) as from_span, max(z) as to_span, cast(any_value(state) as integer) as state from again group by rec, run")
def symbolic_chords(spark, d):
    """Chords of each recording: histograms, templates, decoding and runs."""
    return harmony.symbolic_chords(notes(spark, d), "rec", "onset", "end_us", "pc", SIX_HOURS, ORIGIN).select("rec", "from_span", "to_span", "state")


BASSES = f"""tb as (select rec, span, bass, pc, sum(least(end_us, (span + 1) * {SIX_HOURS} + {ORIGIN}) - greatest(onset, span * {SIX_HOURS} + {ORIGIN})) as t, min(midi) as low
    from (select rec, unnest(range((onset - {ORIGIN}) // {SIX_HOURS}, (end_us - 1 - {ORIGIN}) // {SIX_HOURS} + 1)) as span, pc, midi, event_type = 'click' as bass, onset, end_us from notes) group by all),
  ub as (select *, max(bass) over (partition by rec, span) as ub from tb), kb as (select *, sum(t) over (partition by rec, span) as tot, row_number() over (partition by rec, span order by t desc, low, pc) as r from ub where bass = ub),
  low as (select rec, span, case when t >= 0.6 * tot then pc end as bass from kb where r = 1)"""
BASS_CHORDS = CHORDS.replace("fits as (select rec, span, state, (", f"{BASSES}, fits as (select hist.rec, hist.span, state, (").replace(
    "- prior::double as score from hist cross join tpl)", "- prior::double + case when len(list_filter(weight, lambda x: x >= 0.05 * total)) >= 3 and bass = root then 0.10::double else 0 end as score from hist left join low on hist.rec = low.rec and hist.span = low.span cross join tpl)")


@query(f"with recursive {BASS_CHORDS} select rec, min(a) as from_span, max(z) as to_span, cast(any_value(state) as integer) as state from again group by rec, run")
def bass_chords(spark, d):
    """Chords where the lowest class of a span (of the bass part, which clicks stand for, if it sounds) favours its root."""
    n = notes(spark, d)
    spans = temporal.sounding_slots(n, ["rec"], "onset", "end_us", SIX_HOURS, ORIGIN).withColumnRenamed("slot", "span")
    spans = spans.withColumns({"start_us": F.col("span") * SIX_HOURS + ORIGIN, "end_us": (F.col("span") + 1) * SIX_HOURS + ORIGIN})
    low = score.bass_over(spans, n.select("rec", "onset", F.col("end_us").alias("off"), "midi", "pc", (F.col("event_type") == "click").alias("bass_part")), ["rec"], SIX_HOURS)
    return harmony.symbolic_chords(n, "rec", "onset", "end_us", "pc", SIX_HOURS, ORIGIN, bass=low).select("rec", "from_span", "to_span", "state")


def _qualities() -> str:
    return "['MAJOR', 'MINOR', 'DOMINANT_SEVENTH']"


# Chords bound to events: root from the pitch class, quality from the event number.
CHORDLIKE = f"{NOTES}, ch as (select rec, event_id, onset, pc as root, {_qualities()}[event_id % 3 + 1] as quality, end_us - onset as len from notes)"


def chordlike(spark, d):
    return notes(spark, d).select("rec", "event_id", "onset", F.col("pc").alias("root"), theory.pick(["MAJOR", "MINOR", "DOMINANT_SEVENTH"], F.pmod("event_id", F.lit(3)).cast("int")).alias("quality"), (F.col("end_us") - F.col("onset")).alias("len"))


KEYS = f"""{CHORDLIKE}, modes as (select * from (values ('MAJOR', [0, 2, 4, 5, 7, 9, 11]), ('MINOR', [0, 2, 3, 5, 7, 8, 10])) m(mode, scale)), ton as (select unnest(range(12)) as tonic),
  w as (select rec, len, tonic, mode, (root - tonic + 12) % 12 as deg, scale, case when quality = 'MINOR' then [0, 3, 7] else [0, 4, 7] end as triad, quality from ch cross join ton cross join modes),
  f as (select rec, len, tonic, mode, case when mode = 'MINOR' and deg = 7 and quality <> 'MINOR' then 1.0 else len(list_filter(triad, lambda s: list_contains(scale, (deg + s) % 12))) / 3.0::double end
      + case when deg = 0 and ((mode = 'MINOR') = (quality = 'MINOR')) then 0.5 else 0 end as worth from w),
  keyscore as (select rec, tonic, mode, sum(len * worth) / sum(len) as score from f group by 1, 2, 3)"""


@query(f"with {KEYS} select rec, cast(tonic as integer) as tonic, mode, round(score, 6) as score from keyscore")
def key_scores(spark, d):
    """A19."""
    return harmony.key_scores(chordlike(spark, d), ["rec"], "root", "quality", "len").select("rec", "tonic", "mode", F.round("score", 6).alias("score"))


@query(f"""with {KEYS}, s as (select *, case when ((tonic + case when mode = 'MINOR' then 3 else 0 end) * 7) % 12 < 6 then ((tonic + case when mode = 'MINOR' then 3 else 0 end) * 7) % 12 else 12 - ((tonic + case when mode = 'MINOR' then 3 else 0 end) * 7) % 12 end as acc from keyscore),
  r as (select *, row_number() over (partition by rec order by round(score, 9) desc, case when mode = 'MAJOR' then 0 else 1 end, acc, tonic) as k from s),
  b as (select rec, tonic as bt, mode as bm, score as bs, (tonic + case when mode = 'MAJOR' then 9 else 3 end) % 12 as rt from r where k = 1)
  select r.rec, cast(any_value(bt) as integer) as tonic, any_value(bm) as mode, round(any_value(bs), 6) as score, round(any_value(bs) - max(score) filter (where k > 1 and not (tonic = rt and mode <> bm)), 6) as signature_margin,
    round(any_value(bs) - max(score) filter (where tonic = rt and mode <> bm), 6) as tonic_margin from r join b on r.rec = b.rec group by r.rec""")
def key_argmax(spark, d):
    """D19, D20."""
    best = harmony.best_key(harmony.key_scores(chordlike(spark, d), ["rec"], "root", "quality", "len"), ["rec"])
    return best.select("rec", "tonic", "mode", *(F.round(c, 6).alias(c) for c in ("score", "signature_margin", "tonic_margin")))


METERS = [(0, 4, 4), (10, 3, 4), (25, 6, 8), (60, 7, 8)]
METER_SQL = "m as (select * from (values " + ", ".join(map(str, METERS)) + ") m(start_bar, num, den)), mb as (select *, num * 4.0::double / den as len, lead(start_bar) over (order by start_bar) - start_bar as n from m), mt as (select *, coalesce(sum(n * len) over (order by start_bar rows between unbounded preceding and 1 preceding), 0) as start_beat from mb)"
BEATS = f"{NOTES}, beats as (select rec, event_id, (onset - {ORIGIN}) / 10800000000.0::double as beat, (end_us - {ORIGIN}) / 10800000000.0::double as end_beat from notes)"


def beats(spark, d):
    return notes(spark, d).select("rec", "event_id", ((F.col("onset") - ORIGIN) / 10_800_000_000.0).alias("beat"), ((F.col("end_us") - ORIGIN) / 10_800_000_000.0).alias("end_beat"))


@query(f"with {BEATS}, {METER_SQL}, h as (select b.*, mt.*, row_number() over (partition by b.event_id order by start_bar desc) as k from beats b join mt on b.beat >= mt.start_beat) select rec, event_id, cast(start_bar + floor((beat - start_beat) / len) as bigint) as bar, round(beat - start_beat - floor((beat - start_beat) / len) * len, 6) as beat_in_bar from h where k = 1")
def bar_beat_position(spark, d):
    """L8."""
    recs = notes(spark, d).select("rec").distinct()
    meters = recs.crossJoin(F.broadcast(spark.createDataFrame(METERS, "start_bar int, num int, den int")))  # four rows
    return meter.bar_position(beats(spark, d), meters, ["rec"], "beat").select("rec", "event_id", "bar", F.round("beat_in_bar", 6).alias("beat_in_bar"))


GRID = f"""{BEATS}, g as (select unnest([1, 2, 3, 4, 6, 8]) as div), c as (select rec, cast(floor(beat / 4) as bigint) as bar, div, abs(beat - floor(beat / (1.0::double / div) + 0.5) * (1.0::double / div))
    + 0.035 * case when div = 1 then 0 when div in (2, 3) then 1 when div in (4, 6) then 2 else 3 end + case when div % 3 = 0 then 0.015 else 0 end as cost from beats cross join g),
  costs as (select rec, bar, div, sum(cost) as cost from c group by 1, 2, 3)"""


def grid_cost_table(spark, d):
    return meter.grid_costs(beats(spark, d).withColumn("bar", F.floor(F.col("beat") / 4)), ["rec", "bar"], "beat")


@query(f"with {GRID} select rec, bar, cast(div as integer) as divisions, round(cost, 6) as cost from costs")
def grid_cost(spark, d):
    """L13."""
    return grid_cost_table(spark, d).select("rec", "bar", "divisions", F.round("cost", 6).alias("cost"))


@query(f"""with recursive {GRID}, e as (select rec, bar, row_number() over (partition by rec order by bar) as i, list(-round(cost, 9) order by div) as em from costs group by rec, bar),
  fwd as (select rec, bar, i, em as sc, cast(null as double[]) as prev, cast(null as bigint) as lead, cast(null as double) as moving from e where i = 1
    union all select e.rec, e.bar, e.i, list_transform(range(6), lambda s: greatest(f.sc[s + 1], list_max(f.sc) - 0.25) + e.em[s + 1]), f.sc, list_position(f.sc, list_max(f.sc)) - 1, list_max(f.sc) - 0.25 from fwd f join e on e.rec = f.rec and e.i = f.i + 1),
  back as (select rec, bar, i, cast(list_position(sc, list_max(sc)) - 1 as bigint) as state, prev, lead, moving from fwd f where i = (select max(i) from e where e.rec = f.rec)
    union all select f.rec, f.bar, f.i, cast(case when b.prev[b.state + 1] >= b.moving then b.state else b.lead end as bigint), f.prev, f.lead, f.moving from back b join fwd f on f.rec = b.rec and f.i = b.i - 1)
  select rec, bar, cast([1, 2, 3, 4, 6, 8][state + 1] as integer) as divisions from back""")
def grid_decode(spark, d):
    """D3."""
    return meter.best_grid_path(grid_cost_table(spark, d).withColumn("cost", F.round("cost", 9)), "rec", "bar")


@query(f"""with {BEATS}, s as (select *, floor(beat / 0.25 + 0.5) * 0.25 as start_q, floor((end_beat - beat) / 0.25 + 0.5) * 0.25 as near, end_beat - beat as len from beats)
  select rec, event_id, round(start_q, 6) as start_q, round(start_q + greatest(floor((case when abs(near - len) <= 0.02 * len then len else len / 0.9 end) / 0.25 + 0.5) * 0.25, 0.25), 6) as end_q from s""")
def snap_to_grid(spark, d):
    """D25, L9."""
    start, end = meter.snap_note(F.col("beat"), F.col("end_beat"), 0.25)
    return beats(spark, d).select("rec", "event_id", F.round(start, 6).alias("start_q"), F.round(end, 6).alias("end_q"))


@query(f"""with {BEATS}, p as (select rec, beat - floor(beat) as phase from beats), s as (select rec, count(*) filter (where phase < 0.1 or phase > 1 - 0.1) as on_beats, count(*) filter (where not (phase < 0.1 or phase > 1 - 0.1)) as off_beats,
   avg(phase) filter (where not (phase < 0.1 or phase > 1 - 0.1)) as m, stddev_pop(phase) filter (where not (phase < 0.1 or phase > 1 - 0.1)) as sd from p group by rec)
  select rec, on_beats, off_beats, round(m, 6) as mean_phase, round(sd, 6) as spread, coalesce(off_beats >= 8 and on_beats >= 4 and m >= 0.58 and sd <= 0.09, false) as swings from s""")
def swing_stats(spark, d):
    """A22, D23."""
    s = stats.swing(beats(spark, d).withColumn("phase", F.col("beat") - F.floor("beat")), ["rec"], "phase")
    return s.select("rec", "on_beats", "off_beats", F.round("mean_phase", 6).alias("mean_phase"), F.round("spread", 6).alias("spread"), "swings")


@query(f"with {BEATS}, p as (select rec, event_id, beat - floor(beat) as x from beats) select rec, event_id, round(case when x < 0.62 then x * 0.5 / 0.62 else 0.5 + (x - 0.62) * 0.5 / (1 - 0.62) end, 6) as straight from p")
def unswung_phase(spark, d):
    """L12."""
    return beats(spark, d).select("rec", "event_id", F.round(meter.unswing(F.col("beat") - F.floor("beat"), F.lit(0.62)), 6).alias("straight"))


CUT = f"{NOTES}, t as (select rec, event_id, event_type, onset, least(end_us, coalesce(lead(onset) over (partition by rec order by onset, event_id), end_us)) as z from notes), cells as (select rec, event_id, event_type, bar, greatest(onset, bar * {DAY} + {ORIGIN}) - (bar * {DAY} + {ORIGIN}) as off, least(z, (bar + 1) * {DAY} + {ORIGIN}) - greatest(onset, bar * {DAY} + {ORIGIN}) as len from (select *, unnest(range((onset - {ORIGIN}) // {DAY}, (z - 1 - {ORIGIN}) // {DAY} + 1)) as bar from t where z > onset))"


def cell_table(spark, d):
    t = temporal.truncate_overlaps(notes(spark, d), ["rec"], ["onset", "event_id"], "onset", "end_us")
    return meter.cut_at_bars(t.select("rec", "event_id", "event_type", "onset", F.coalesce("cut_end", "end_us").alias("z")), ["rec"], "onset", "z", DAY, ORIGIN)


@query(f'with {CUT} select rec, event_id, bar, off as "offset", len as length from cells')
def cut_at_bars(spark, d):
    """L2."""
    return cell_table(spark, d).select("rec", "event_id", "bar", "offset", "length")


@query(f"""with {CUT}, e as (select *, unnest([1, 2, 4]) as slots from cells), s as (select *, unnest(range(cast(off // ({DAY} // slots) as bigint), least(slots - 1, cast((off + len - 1) // ({DAY} // slots) as bigint)) + 1)) as slot from e),
  o as (select rec, bar, slots, slot, event_type, sum(least(off + len, (slot + 1) * ({DAY} // slots)) - greatest(off, slot * ({DAY} // slots))) as o from s group by all),
  b as (select rec, bar, slots, sum(o) as covered from (select rec, bar, slots, slot, max(o) as o from o group by all) group by all),
  r as (select *, ({DAY} - covered) / {DAY}::double + 0.3 * (slots - 1) as cost from b), k as (select *, row_number() over (partition by rec, bar order by round(cost, 9), slots) as k from r)
  select rec, bar, cast(slots as integer) as slots, round(cost, 6) as cost from k where k = 1""")
def harmonic_rhythm(spark, d):
    """D21."""
    return meter.harmonic_rhythm(cell_table(spark, d), ["rec"], "event_type", DAY, (1, 2, 4)).withColumn("cost", F.round("cost", 6))


@query(f"with {CUT} select rec, bar, event_id, event_type is distinct from lag(event_type) over (partition by rec order by bar, off, event_id) as named from cells")
def named_cells(spark, d):
    """W14."""
    w = Window.partitionBy("rec").orderBy("bar", "offset", "event_id")
    return cell_table(spark, d).select("rec", "bar", "event_id", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).alias("named"))


NAMES = f"['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B']"
CHART = f"""{CUT}, c as (select rec, bar, {NAMES}[event_id % 12 + 1] as symbol, off, event_id from cells), n as (select *, symbol is distinct from lag(symbol) over (partition by rec order by bar, off, event_id) as named from c),
  b as (select rec, bar, coalesce(string_agg(symbol, ' ' order by off, event_id) filter (where named), '%') as cell from n group by 1, 2)"""


@query(f"with {CHART} select rec, bar // 4 as line, '| ' || string_agg(rpad(cell, cast(greatest(12, length(cell)) as integer), ' '), '| ' order by bar) || '|' as text from b group by 1, 2")
def text_chart(spark, d):
    """K3: four bars a line; % for a bar that names nothing new."""
    from tempograph.operators.layout import chart_lines

    cells = cell_table(spark, d).withColumn("symbol", theory.sharp_name(F.pmod("event_id", F.lit(12)).cast("int")))
    return chart_lines(cells, ["rec"], "bar", ["offset", "event_id"], "symbol")


@query(f"with {NOTES}, s as (select distinct midi from notes) select midi, {NAMES}[midi % 12 + 1] || (midi // 12 - 1) as sharp, ['C', 'Db', 'D', 'Eb', 'E', 'F', 'Gb', 'G', 'Ab', 'A', 'Bb', 'B'][midi % 12 + 1] || (midi // 12 - 1) as flat from s")
def spelling_sharp_flat(spark, d):
    """M8, F3."""
    m = notes(spark, d).select("midi").distinct()
    return m.select("midi", theory.pitch_name(F.col("midi")).alias("sharp"), theory.pitch_name(F.col("midi"), True).alias("flat"))


SPELL = "(select f from (select unnest(range(-15, 20)) as f) where ((f * 7) % 12 + 12) % 12 = {pc} order by abs(f - {c}), f limit 1)"


@query(f"""with {NOTES}, gone as (select distinct rec from notes where midi + 7 not between 0 and 127)
  select rec, event_id, midi + 7 as moved, {NAMES}[(midi + 7) % 12 + 1] as name from notes where rec not in (select rec from gone) union all select rec, null, null, null from gone""")
def transpose(spark, d):
    """Up a fifth; a recording with a note that would leave 0..127 is left out whole, and is a row of nulls."""
    moved, gone = score.transpose_track(notes(spark, d), ["rec"], 7)
    named = moved.withColumnRenamed("midi", "moved").select("rec", "event_id", "moved", theory.sharp_name(F.pmod("moved", F.lit(12)).cast("int")).alias("name"))
    return named.unionByName(gone, allowMissingColumns=True)


@query(f"""with {NOTES}, c as (select rec, pc, count(*) as n from notes group by 1, 2),
  r as (select *, row_number() over (partition by rec, pc, region order by abs(f - region), f) as k from (select *, unnest(range(-15, 20)) as f from (select *, unnest(range(-15, 20)) as region from c)) where ((f * 7) % 12 + 12) % 12 = pc),
  s as (select rec, region, cast(sum(n * abs(floor((f + 1) / 7.0))) as bigint) as accidentals, cast(sum(n * abs(f - region)) as bigint) as distance from r where k = 1 group by 1, 2),
  b as (select *, row_number() over (partition by rec order by accidentals, distance, abs(region - 2), abs(region), region) as k from s) select rec, cast(region as integer) as region, accidentals, distance from b where k = 1""")
def cheapest_region(spark, d):
    """A34."""
    return harmony.cheapest_region(notes(spark, d), ["rec"], "pc", F.lit(2))


CYCLE = "A7 A7 A7 A7 D7 D7 A7 A7 E7 D7 A7 E7"


@query(f"""with {ONSETS}, t as (select i, string_split('{CYCLE}', ' ')[i + 1] as name from (select unnest(range(12)) as i)), truth as (select i, {NAMES} as names, regexp_extract(name, '^[A-G][#b]?') as root from t),
  b as (select rec, (row_number() over (partition by rec order by t_us, event_id) - 1) as bar, {NAMES}[event_id % 12 + 1] as root from onsets), rot as (select unnest(range(12)) as rot),
  m as (select rec, rot, count(*) as bars, count(*) filter (where b.root = truth.root) as hits from b cross join rot join truth on truth.i = (bar + rot) % 12 group by 1, 2),
  r as (select *, row_number() over (partition by rec order by hits desc, rot) as k from m) select rec, rot as rotation, bars, hits, round(100.0 * hits / bars, 6) as share from r where k = 1""")
def cyclic_truth_score(spark, d):
    """Bars against a chord cycle at its best rotation."""
    truth = F.array(*[F.lit(name.rstrip("7")) for name in CYCLE.split()])
    w = Window.partitionBy("rec").orderBy("at", "event_id")
    b = onsets(spark, d).select("rec", (F.row_number().over(w) - 1).alias("bar"), theory.sharp_name(F.pmod("event_id", F.lit(12)).cast("int")).alias("root"))
    m = b.withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(11)).cast("array<bigint>"))).withColumn("hit", F.col("root") == F.get(truth, F.pmod(F.col("bar") + F.col("rotation"), F.lit(12)).cast("int")))
    s = m.groupBy("rec", "rotation").agg(F.count("*").alias("bars"), F.count_if("hit").alias("hits"))
    return temporal.first_of_each(s, ["rec"], [F.desc("hits"), "rotation"]).withColumn("share", F.round(100.0 * F.col("hits") / F.col("bars"), 6))
