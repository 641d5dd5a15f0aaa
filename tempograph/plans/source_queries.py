"""Queries over written fixtures: MIDI, audio, charts, documents, configuration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempograph.functions import theory
from tempograph.operators import harmony, meter, notation, score, signal, stats, temporal
from tempograph.plans.bindings import NOTES, ONSETS, ORIGIN, SIX_HOURS, micros, notes, onsets, table
from tempograph.plans.vector_queries import VIT
from tempograph.sources import audio, midi, score_json, text_charts

FOUND: dict = {}


def query(sql: str | None = None):
    def add(fn):
        FOUND[fn.__name__] = (fn, sql)
        return fn

    return add




@query(f"""with {NOTES}, b as (select rec, event_id, onset, (onset - {ORIGIN}) / 3.6e9 as h from notes) select rec, event_id, round(case when h < 240 then h / 2.0 else 120 + (h - 240) end, 6) as seconds from b""")
def beats_to_seconds(spark, d):
    """Beats through a map of two tempi."""
    recs = notes(spark, d).select("rec").distinct()
    seg = recs.withColumn("s", F.explode(F.array(*[F.struct(F.lit(a).alias("start_beat"), F.lit(b).alias("start_seconds"), F.lit(c).alias("bpm")) for a, b, c in ((0.0, 0.0, 120.0), (240.0, 120.0, 60.0))]))).select("rec", "s.*")
    b = notes(spark, d).select("rec", "event_id", ((F.col("onset") - ORIGIN) / 3.6e9).alias("beat"))
    return score.beats_to_seconds(b, seg, ["rec"], "beat").select("rec", "event_id", F.round("seconds", 6).alias("seconds"))


def _placed_sql(step: str) -> str:
    return f"""with recursive {NOTES}, s as (select rec, event_id, cast(floor((onset - {ORIGIN}) / {step} + 0.5) as bigint) as a, cast(floor((end_us - {ORIGIN}) / {step} + 0.5) as bigint) as z, row_number() over (partition by rec order by onset, end_us, event_id) as i from notes),
  p as (select rec, i, event_id, case when z > a then a end as placed_start, case when z > a then z end as placed_end, case when z > a then z end as furthest from s where i = 1
    union all select s.rec, s.i, s.event_id, case when z > greatest(a, furthest) then greatest(a, furthest) end, case when z > greatest(a, furthest) then z end, case when z > greatest(a, furthest) then z else furthest end from p join s on s.rec = p.rec and s.i = p.i + 1)
  select rec, event_id, placed_start, placed_end from p"""


def placed(spark, d, step: float):
    import math

    n = notes(spark, d).select("rec", "event_id", ((F.col("onset") - ORIGIN) / step).alias("a"), ((F.col("end_us") - ORIGIN) / step).alias("z"))
    spans = score.place_spans(n, "rec", "a", "z", lambda x: math.floor(x + 0.5), ties=("event_id",))
    # A null in a batch of doubles may come as NaN.
    return spans.select("rec", "event_id", *(F.nanvl(c, F.lit(None).cast("double")).cast("bigint").alias(c) for c in ("placed_start", "placed_end")))


@query(_placed_sql("2.16e10"))
def placed_spans(spark, d):
    """Every span, placed one after another on a grid of six hours; null if it has no length there."""
    return placed(spark, d, 2.16e10)


@query(_placed_sql("3.6e9"))
def placed_notes(spark, d):
    """The same on an hourly grid."""
    return placed(spark, d, 3.6e9)


@query(f"""with {NOTES}, s as (select rec, (onset - {ORIGIN}) // {SIX_HOURS} as span, event_type, midi, pc, onset, end_us from notes),
  g as (select rec, unnest(range((onset - {ORIGIN}) // {SIX_HOURS}, (end_us - 1 - {ORIGIN}) // {SIX_HOURS} + 1)) as span, pc, midi, event_type = 'click' as bass, onset, end_us from notes),
  t as (select rec, span, bass, pc, sum(least(end_us, (span + 1) * {SIX_HOURS} + {ORIGIN}) - greatest(onset, span * {SIX_HOURS} + {ORIGIN})) as t, min(midi) as low from g group by all),
  u as (select *, max(bass) over (partition by rec, span) as ub from t), k as (select *, sum(t) over (partition by rec, span) as tot, row_number() over (partition by rec, span order by t desc, low, pc) as r from u where bass = ub)
  select rec, span, case when t >= 0.6 * tot then pc end as bass from k where r = 1""")
def bass_reader(spark, d):
    """Clicks stand for the bass part."""
    n = notes(spark, d).select("rec", "onset", F.col("end_us").alias("off"), "midi", "pc", (F.col("event_type") == "click").alias("bass_part"))
    spans = temporal.sounding_slots(notes(spark, d), ["rec"], "onset", "end_us", SIX_HOURS, ORIGIN).withColumnRenamed("slot", "span")
    spans = spans.withColumns({"start_us": F.col("span") * SIX_HOURS + ORIGIN, "end_us": (F.col("span") + 1) * SIX_HOURS + ORIGIN})
    return score.bass_over(spans, n, ["rec"], SIX_HOURS).select("rec", "span", "bass")


@query(f"""with {ONSETS}, c as (select rec, event_id, t_us, event_type, lead(t_us) over (partition by rec order by t_us, event_id) as nxt from onsets),
  s as (select rec, event_type, nxt - t_us as len from c where nxt is not null) select rec, round(coalesce(sum(len) filter (where event_type = 'view'), 0) / sum(len), 6) as no_chord_share, round(coalesce(avg(len / 1e12) filter (where event_type <> 'view'), 0), 6) as confidence from s group by rec""")
def unnamed_share(spark, d):
    """Views stand for no chord."""
    w = Window.partitionBy("rec").orderBy("at", "event_id")
    c = onsets(spark, d).withColumns({"start": F.col("at"), "end": F.lead("at").over(w)}).where("end is not null")
    c = c.withColumns({"quality": F.when(F.col("event_type") == "view", "NONE").otherwise("MAJOR"), "confidence": (F.col("end") - F.col("start")) / 1e12})
    u = score.unnamed_share(c, ["rec"])
    return u.select("rec", F.round("no_chord_share", 6).alias("no_chord_share"), F.round("confidence", 6).alias("confidence"))


@query(f"""with {ONSETS}, g as (select rec, t_us - lag(t_us) over (partition by rec order by t_us, event_id) as gap from onsets) select rec, count(*) as chords, round(coalesce(count(*) filter (where gap < 21600000000) / nullif(count(gap), 0), 0), 6) as short_share from g group by rec""")
def short_changes(spark, d):
    """A29."""
    s = score.short_changes(onsets(spark, d), ["rec"], ["at", "event_id"], "at", SIX_HOURS)
    return s.select("rec", "chords", F.round("short_share", 6).alias("short_share"))


@query(f"with {NOTES} select pc, count(*) as n, round(count(*) filter (where velocity > 100) / count(*), 6) as recall from notes group by pc")
def class_recall(spark, d):
    """A28."""
    r = score.rate_of_class(notes(spark, d).withColumn("hit", F.col("velocity") > 100), [], "pc", "hit")
    return r.select("pc", "n", F.round("recall", 6).alias("recall"))


@query(f"""with {NOTES}, b as (select rec, (onset - {ORIGIN}) / 2.16e10 as beat, (end_us - {ORIGIN}) / 2.16e10 as z from notes), s as (select rec, min(beat) as f, max(z) as l from b group by rec)
  select rec, round(f, 6) as first_beat, round(l, 6) as last_beat, round(case when f - floor(f / 4) * 4 > 0 then 4 - (f - floor(f / 4) * 4) else 0 end, 6) as pickup from s""")
def music_span(spark, d):
    """L15."""
    n = notes(spark, d).select("rec", ((F.col("onset") - ORIGIN) / 2.16e10).alias("beat"), ((F.col("end_us") - ORIGIN) / 2.16e10).alias("end_beat"))
    return score.music_span(n, ["rec"], 4.0).select("rec", *(F.round(c, 6).alias(c) for c in ("first_beat", "last_beat", "pickup")))


def staff(spark, d):
    n = notes(spark, d).select("rec", ((F.col("onset") - ORIGIN) / 2.16e10).alias("beat"), ((F.col("end_us") - ORIGIN) / 2.16e10).alias("end_beat"), "midi")
    return notation.staff_events(n, ["rec"], "beat", "end_beat", "midi")


STAFF = f"""{NOTES}, s as (select rec, midi, floor((onset - {ORIGIN}) / 2.16e10 / 0.25 + 0.5) * 0.25 as a, floor((end_us - {ORIGIN}) / 2.16e10 / 0.25 + 0.5) * 0.25 as z from notes),
  g as (select rec, a as start, list_sort(list_distinct(list(midi))) as pitches, max(greatest(a + 0.25, z)) as stop from s group by 1, 2), ev as (select rec, start, pitches, least(stop, coalesce(lead(start) over (partition by rec order by start), stop)) as stop from g)"""


@query(f"with {STAFF} select rec, start, array_to_string(pitches, ' ') as pitches, stop from ev")
def staff_events(spark, d):
    """L14, T3, O2, W16."""
    s = staff(spark, d)
    return s.select("rec", "start", F.array_join(F.col("pitches").cast("array<string>"), " ").alias("pitches"), "stop")


@query(f"""with {STAFF}, r as (select rec, start, stop, false as rest from ev union all select rec, coalesce(p, 0) as start, start as stop, true from (select rec, start, lag(stop) over (partition by rec order by start) as p from ev) where coalesce(p, 0) < start)
  select rec, rest, count(*) as n, round(sum(stop - start), 4) as beats from r group by 1, 2""")
def filled_rests(spark, d):
    """L16."""
    f = notation.filled(staff(spark, d), ["rec"]).withColumn("rest", F.size("pitches") == 0)
    return f.groupBy("rec", "rest").agg(F.count("*").alias("n"), F.round(F.sum(F.col("stop") - F.col("start")), 4).alias("beats"))


@query(f"""with {STAFF}, b as (select rec, start, stop, unnest(range(cast(floor(start / 4) as bigint), cast(ceil(stop / 4) as bigint))) as bar from ev where stop > start)
  select rec, bar, round(sum(least(stop, bar * 4 + 4) - greatest(start, bar * 4)), 4) as quarters from b group by 1, 2""")
def bar_sums(spark, d):
    """Note values written in each bar sum to what sounds there."""
    pieces = notation.bar_pieces(staff(spark, d), ["rec"])
    return notation.bar_sums(pieces, ["rec"]).select("rec", F.col("bar").cast("bigint").alias("bar"), F.round("quarters", 4).alias("quarters"))


@query()
def staff_notation(spark, d):
    """The bars of each recording as LilyPond tokens."""
    return notation.staff_lines(notation.bar_pieces(notation.filled(staff(spark, d), ["rec"]), ["rec"]), ["rec"])


@query("""with o as (select o_custkey as rec, o_orderkey, o_orderstatus, o_orderpriority from orders), b as (select *, o_orderkey % 3 = 0 as fresh from o)
  select rec, o_orderstatus, o_orderkey from b where fresh or not exists (select 1 from b b2 where b2.fresh and b2.rec = b.rec and b2.o_orderstatus = b.o_orderstatus)""")
def upsert_by_role(spark, d):
    """Rows of a customer and status give way to fresh ones."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("rec"), "o_orderkey", "o_orderstatus")
    return temporal.upsert(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 = 0"), ["rec", "o_orderstatus"])


@query("""with s as (select o_custkey as rec, epoch_us(o_orderdate) as t, o_orderkey from orders), b as (select rec, row_number() over (partition by rec order by t, o_orderkey) - 1 as i, o_orderkey from s) select rec, o_orderkey, cast(((i - 1) % 4 + 4) % 4 as integer) as pos, ((i - 1) % 4 + 4) % 4 = 0 as downbeat from b""")
def beat_positions(spark, d):
    """P10, P11, X1."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("rec"), "o_orderkey", F.struct(micros("o_orderdate"), "o_orderkey").alias("seconds"))
    return score.beat_phases(o, ["rec"], 4, 1).select("rec", "o_orderkey", "pos", "downbeat")


_AT = "t[((root + {k}) % 12)::int + 1]"
_MASS = " + ".join(_AT.format(k=k) for k in (0, "third", 7))
AUDIO = f"""{VIT}, f as (select b.rec, b.frame, b.state, case when b.state < 36 then b.state % 12 else -1 end as root, chroma, sim from back b join sims s on b.rec = s.rec and b.frame = s.frame join chroma k on b.rec = k.rec and b.frame = k.frame),
  f1 as (select *, sum(c) over (partition by rec order by frame rows unbounded preceding) as run from (select *, case when row_number() over w > 1 and lag(root) over w <> root then 1 else 0 end as c from f window w as (partition by rec order by frame))),
  tr as (select rec, run, any_value(root) as root, list_transform(range(12), lambda i: list_sum(list_transform(list(chroma), lambda v: v[i + 1]))) as t from f1 group by rec, run),
  q as (select * from (values (0, 4, 3), (1, 3, 3), (2, 4, 4)) q(i, third, n)),
  sc as (select rec, run, root, i, ({_MASS} + case when n = 4 then {_AT.format(k=10)} else 0 end - case when third = 3 then greatest(0, {_AT.format(k=4)} - 0.25 * {_AT.format(k=0)}) else 0 end) / (sqrt(list_sum(list_transform(t, lambda x: x * x))) * sqrt(n)) as score,
    (n / 12.0::double - case when third = 3 then 0.75 / 12 else 0 end) / (sqrt(n) * sqrt(1 / 12.0::double)) as flat from tr cross join q where root >= 0),
  best as (select rec, run, i * 12 + root as state from (select *, row_number() over (partition by rec, run order by score desc, i) as k from sc where score > flat and score > 0) where k = 1),
  f2 as (select f1.rec, frame, coalesce(best.state, f1.state) as state, sim from f1 left join best on f1.rec = best.rec and f1.run = best.run),
  f3 as (select *, sum(c) over (partition by rec order by frame rows unbounded preceding) as run from (select *, case when row_number() over w > 1 and lag(state) over w <> state then 1 else 0 end as c from f2 window w as (partition by rec order by frame)))"""


@query(f"""with recursive {AUDIO} select rec, min(frame) as first_frame, count(*) as n, cast(any_value(state) as integer) as state, case any_value(state) // 12 when 0 then 'MAJOR' when 1 then 'MINOR' when 2 then 'DOMINANT_SEVENTH' else 'NONE' end as quality,
  case when any_value(state) < 36 then cast(any_value(state) % 12 as integer) end as root, round(greatest(0, least(1, (avg(sim[state::int + 1]) - 0.65) / 0.35)), 6) as confidence from f3 group by rec, run""")
def audio_chord_runs(spark, d):
    """Runs of the decoder with their quality and confidence."""
    from tempograph.plans.bindings import chroma

    sims = harmony.template_similarity(chroma(spark, d), "chroma")
    path = harmony.decode_frames(sims, "rec", "frame", "similarity").join(sims, ["rec", "frame"])
    return score.audio_chords(path, ["rec"], ["frame"], "state", "chroma", "similarity").withColumn("confidence", F.round("confidence", 6))


