"""Queries of charts, quantised notes, tuplets, downbeats and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempograph.operators import chart, downbeat, meter, nested_score, notation, quantize
from tempograph.plans import symbolic_queries
from tempograph.plans.bindings import CHROMA, NOTES, ONSETS, ORIGIN, SIX_HOURS, chroma, micros, notes, onsets, table
from tempograph.plans.source_queries import STAFF, staff
from tempograph.plans.symbolic_queries import BEATS, beats, grid_cost_table

FOUND: dict = {}
DAY, FINEST = 4 * SIX_HOURS, SIX_HOURS // 16


def query(sql: str | None = None):
    def add(fn):
        FOUND[fn.__name__] = (fn, sql)
        return fn

    return add


# Charts of notes: six hours are a quarter; every third recording goes from four to three quarters a bar at bar 3; every fifth has no tempo.
CHART = f"""{NOTES}, gaps as (select rec, min(gap) as gap from (select rec, onset - lag(onset) over (partition by rec order by onset) as gap from notes) group by rec),
  grids as (select rec, cast(case {" ".join(f"when gap is null or gap >= {SIX_HOURS >> k} then {SIX_HOURS >> k}" for k in range(4))} else {FINEST} end as bigint) as grid from gaps),
  axis as (select n.rec, any_value(grid) as grid, cast(floor((min(onset) + any_value(grid) / 2 - {ORIGIN}) / {DAY}) as bigint) * {DAY} + {ORIGIN} as origin from notes n join grids g on g.rec = n.rec group by n.rec),
  snapped as (select n.rec, event_id, onset, cast(pc as varchar) as symbol, grid, row_number() over (partition by n.rec order by onset, event_id) - 1 as i,
    cast(floor((onset - origin) / grid + 0.5) as bigint) * grid as s, cast(floor((end_us - origin) / grid + 0.5) as bigint) * grid as e from notes n join axis a on a.rec = n.rec where n.rec % 5 <> 0),
  starts as (select *, max(case when i = 0 then greatest(0, s) else s end - i * grid) over (partition by rec order by i rows unbounded preceding) + i * grid as pos from snapped),
  ends as (select rec, max(pos) as st, greatest(max(e), max(pos + grid)) as fin from starts group by rec),
  bars as (select rec, 0 as bar, cast(0 as bigint) as pos, cast({DAY} as bigint) as len, 4 as beats from ends
    union all select rec, b.bar + 1, b.pos + b.len, case when b.bar + 1 >= 3 and b.rec % 3 = 0 then {3 * SIX_HOURS} else {DAY} end, case when b.bar + 1 >= 3 and b.rec % 3 = 0 then 3 else 4 end
      from bars b join ends using (rec) where st >= b.pos + b.len or fin > b.pos + b.len + (case when b.bar + 1 >= 3 and b.rec % 3 = 0 then {3 * SIX_HOURS} else {DAY} end) / 2),
  close as (select rec, max(pos + len) as z from bars group by rec),
  spans as (select s.rec, i, symbol, pos as a, coalesce(lead(pos) over (partition by s.rec order by i), z) as z from starts s join close c on c.rec = s.rec
    union all select rec, -1, null, 0, pos from starts where i = 0 and pos > 0),
  cells as (select s.rec, bar, beats, len, i, symbol, greatest(a, b.pos) - b.pos as o, least(s.z, b.pos + b.len) - greatest(a, b.pos) as l from spans s join bars b on b.rec = s.rec and s.a < b.pos + b.len and s.z > b.pos),
  marked as (select *, count(*) over (partition by rec, bar) < 2 or bool_or(symbol is null) over (partition by rec, bar) as stays from cells),
  ways as (select *, unnest(list_filter(range(1, beats + 1), lambda n: beats % n = 0 and len % (n * {FINEST}) = 0)) as slots from marked where not stays),
  slots as (select *, unnest(range(o // (len // slots), (o + l - 1) // (len // slots) + 1)) as slot from ways),
  held as (select rec, bar, beats, len, slots, slot, symbol, min(i) as i, sum(least(o + l, (slot + 1) * (len // slots)) - greatest(o, slot * (len // slots))) as h from slots group by rec, bar, beats, len, slots, slot, symbol),
  won as (select *, case when slot = 0 or symbol <> lag(symbol) over (partition by rec, bar, slots order by slot) then 1 else 0 end as opens from (select *, row_number() over (partition by rec, bar, slots, slot order by h desc, i) as k from held) where k = 1),
  cost as (select rec, bar, slots, round((any_value(len) - sum(h)) / any_value(len) + 0.3 * (sum(opens) - 1), 9) as c from won group by rec, bar, slots),
  best as (select rec, bar, slots from (select *, row_number() over (partition by rec, bar order by c, slots) as k from cost) where k = 1),
  written as (select w.rec, w.bar, beats, len, slot * (len // w.slots) as o, coalesce(lead(slot * (len // w.slots)) over (partition by w.rec, w.bar order by slot), len) - slot * (len // w.slots) as l, symbol from won w join best b on b.rec = w.rec and b.bar = w.bar and b.slots = w.slots where opens = 1),
  plain as (select rec, row_number() over (partition by rec order by onset, event_id) - 1 as bar, 4 as beats, {DAY} as len, 0 as o, {DAY} as l, cast(pc as varchar) as symbol from notes where rec % 5 = 0),
  every as (select rec, bar, beats, len, o, l, symbol from marked where stays union all select * from written union all select * from plain),
  chart as (select *, row_number() over (partition by rec order by bar, o) = 1 or symbol is distinct from lag(symbol) over (partition by rec order by bar, o) as named from every)"""


def charted(spark, d):
    n = notes(spark, d).withColumn("symbol", F.col("pc").cast("string"))
    grids = chart.grid_of_changes(n, ["rec"], "onset", SIX_HOURS)
    first = n.groupBy("rec").agg(F.min("onset").alias("first")).join(grids, "rec")
    axis = first.select("rec", "grid", (F.floor((F.col("first") + F.col("grid") / 2 - ORIGIN) / DAY) * DAY + ORIGIN).alias("origin"))
    opening = F.struct(F.lit(0).cast("bigint").alias("start_bar"), F.lit(DAY).alias("length"), F.lit(4).alias("beats"))
    later = F.struct(F.lit(3).cast("bigint").alias("start_bar"), F.lit(3 * SIX_HOURS).alias("length"), F.lit(3).alias("beats"))
    meters = axis.select("rec", F.explode(F.when(F.col("rec") % 3 == 0, F.array(opening, later)).otherwise(F.array(opening))).alias("m")).select("rec", "m.*")
    return chart.chart(n.join(axis, "rec"), ["rec"], ["onset", "event_id"], "onset", "end_us", "symbol", meters, F.col("origin"), F.col("grid"), F.col("rec") % 5 != 0, FINEST)


@query(f"with recursive {CHART} select rec, cast(bar as bigint) as bar, cast(beats as integer) as beats, cast(len as bigint) as bar_length, cast(o as bigint) as place, cast(l as bigint) as length, symbol, named from chart")
def chart_bars(spark, d):
    """All cells of all bars of each recording's chart; N.C. before the first chord has no symbol."""
    return charted(spark, d).withColumnRenamed("offset", "place")


@query(f"with recursive {CHART} select rec, bar, sum(l) = any_value(len) as whole from chart group by rec, bar")
def chart_bar_sums(spark, d):
    """Whether the cells of each bar sum to its length: all do."""
    return charted(spark, d).groupBy("rec", "bar").agg((F.sum("length") == F.max("bar_length")).alias("whole"))


@query(f"""with recursive {CHART}, words as (select rec, bar, coalesce(string_agg(coalesce(symbol, 'N.C.'), ' ' order by o) filter (where named), '%') as t from chart group by rec, bar),
  padded as (select rec, bar, t || repeat(' ', cast(greatest(0, 12 - length(t)) as integer)) as t from words)
  select rec, cast(bar // 4 as bigint) as line, '| ' || string_agg(t, '| ' order by bar) || '|' as text from padded group by rec, bar // 4""")
def chart_lines_of_bars(spark, d):
    """K3: the printed chart, four bars a line."""
    return chart.chart_text(charted(spark, d), ["rec"])


_decoded, _last = symbolic_queries.FOUND["grid_decode"][1].rsplit("\n  select ", 1)
GRIDS = f"{_decoded}, grids as (select {_last})"
STEP = "1.0::double / coalesce({0}, 1)"
QUANTIZED = f"""{GRIDS}, q as (select n.rec, event_id, beat, end_beat, cast(floor(beat / 4.0) as bigint) as b, cast(floor(end_beat / 4.0) as bigint) as z from beats n),
  j as (select q.*, {STEP.format("g.divisions")} as first, {STEP.format("h.divisions")} as nxt, {STEP.format("e.divisions")} as grid from q
    left join grids g on g.rec = q.rec and g.bar = b left join grids h on h.rec = q.rec and h.bar = b + 1 left join grids e on e.rec = q.rec and e.bar = z),
  k as (select *, floor((beat - b * 4.0) / first + 0.5) as place, end_beat - beat as played, end_beat - z * 4.0 as within from j),
  v as (select *, b * 4.0 + place * first as onset_beat, case when place * first >= 4.0 - 1e-9 then nxt else first end as step,
    z * 4.0 + floor(case when played / grid <= round_even(played / grid, 0) * 1.02 then within else least(within + played * (1 / 0.9::double - 1), ceil(within / grid - 1e-12) * grid) end / grid + 0.5) * grid as off from k),
  quantized as (select rec, event_id, onset_beat, case when round(off - onset_beat, 9) <= 0 then step else off - onset_beat end as length_beats, step from v)"""


def quantized(spark, d):
    grids = meter.best_grid_path(grid_cost_table(spark, d).withColumn("cost", F.round("cost", 9)), "rec", "bar")
    return quantize.quantized_notes(beats(spark, d), grids, ["rec"], "beat", "end_beat", 4.0), grids


@query(f"{QUANTIZED} select rec, event_id, round(onset_beat, 6) as onset_beat, round(length_beats, 6) as length_beats, round(step, 6) as step from quantized")
def quantized_notes(spark, d):
    """Notes on the grid that each bar chose, releases by articulation, across bar lines too."""
    q, _ = quantized(spark, d)
    return q.select("rec", "event_id", *(F.round(c, 6).alias(c) for c in ("onset_beat", "length_beats", "step")))


@query(f"""with recursive {BEATS}, s as (select rec, event_id, row_number() over (partition by rec order by beat, end_beat, event_id) as i, floor(beat + 0.5) as a, floor(end_beat + 0.5) as e from beats),
  walk as (select rec, event_id, i, a, e, case when e > a then e end as furthest, e <= a as gone from s where i = 1
    union all select s.rec, s.event_id, s.i, greatest(s.a, coalesce(w.furthest, s.a)), s.e, case when s.e > greatest(s.a, coalesce(w.furthest, s.a)) then s.e else w.furthest end, s.e <= greatest(s.a, coalesce(w.furthest, s.a)) from walk w join s on s.rec = w.rec and s.i = w.i + 1),
  r as (select *, bool_or(gone) over (partition by rec) as lost from walk)
  select rec, event_id, case when not gone then a end as placed_start, case when not gone then e end as placed_end, case when not lost then a end as chord_start from r""")
def placed_chords(spark, d):
    """Spans on counted beats in order; the ones left without a length unplaced, and (chord_start) all of a recording if one is."""
    b = beats(spark, d)
    order, start, end = ["beat", "end_beat", "event_id"], F.floor(F.col("beat") + 0.5).cast("double"), F.floor(F.col("end_beat") + 0.5).cast("double")
    one = quantize.placed_in_order(b, ["rec"], order, start, end)
    every = quantize.placed_in_order(b, ["rec"], order, start, end, all_or_nothing=True)
    return one.select("rec", "event_id", "placed_start", "placed_end").join(every.select("event_id", F.col("placed_start").alias("chord_start")), "event_id")


@query(f"""{QUANTIZED}, t as (select q.rec, event_id, cast(floor(onset_beat / 4) as bigint) as bar, onset_beat, length_beats, g.divisions from quantized q join grids g on g.rec = q.rec and g.bar = floor(q.onset_beat / 4) where g.divisions % 3 = 0),
  f as (select *, cast(floor((onset_beat - bar * 4) * divisions + 0.5) as bigint) as first, cast(least(4 * divisions, floor((onset_beat + length_beats - bar * 4) * divisions + 0.5)) as bigint) as last from t),
  x as (select *, unnest(range(first // 3, (last - 1) // 3 + 1)) as bracket from f where last > first)
  select rec, event_id, bar, cast(bracket as bigint) as bracket, cast(greatest(first, bracket * 3) - bracket * 3 as integer) as within, cast(least(last, bracket * 3 + 3) - greatest(first, bracket * 3) as integer) as steps, least(last, bracket * 3 + 3) < last as tied,
    cast((least(last, bracket * 3 + 3) - greatest(first, bracket * 3)) * 12 as bigint) as written_num, cast(8 * divisions as bigint) as written_den, '3/2' as ratio from x""")
def tuplet_brackets(spark, d):
    """Notes of the bars that chose a grid of threes, cut at the brackets, as exact fractions of a quarter."""
    q, grids = quantized(spark, d)
    own = q.withColumn("bar", F.floor(F.col("onset_beat") / 4)).join(grids, ["rec", "bar"]).withColumns({"num": F.lit(4), "den": F.lit(4)})
    steps = lambda at: F.floor((at - F.col("bar") * 4) * F.col("divisions") + 0.5)
    own = own.withColumns({"first": steps(F.col("onset_beat")), "last": F.least(4 * F.col("divisions").cast("bigint"), steps(F.col("onset_beat") + F.col("length_beats")))})
    return quantize.bracket_fragments(own).select("rec", "event_id", "bar", "bracket", "within", "steps", "tied", "written_num", "written_den", "ratio")


@query("""with recursive o as (select o_custkey, (epoch_us(o_orderdate) - min(epoch_us(o_orderdate)) over (partition by o_custkey)) // 86400000000 as beat, 2 + o_orderkey % 5 as length from orders),
  c as (select o_custkey, beat, max(length) as length, row_number() over (partition by o_custkey order by beat) as i from o group by o_custkey, beat),
  walk as (select o_custkey, i, [struct_pack(beat := cast(0 as bigint), line := cast(0 as bigint), length := cast(length as bigint))] as kept from c where i = 1
    union all select n.o_custkey, n.i, case when now.length = n.length then stay else list_append(stay, struct_pack(beat := n.beat, line := now.line + cast(ceil((n.beat - now.line) / now.length) as bigint) * now.length, length := cast(n.length as bigint))) end
      from (select c.o_custkey, c.i, c.beat, c.length, list_filter(w.kept, lambda k: k.line < c.beat) as stay, list_filter(w.kept, lambda k: k.line < c.beat)[-1] as now from walk w join c on c.o_custkey = w.o_custkey and c.i = w.i + 1) n),
  last as (select o_custkey, unnest(kept) as k from (select *, row_number() over (partition by o_custkey order by i desc) as r from walk) where r = 1)
  select o_custkey, k.beat as beat, k.line as line, k.length as length from last""")
def meter_changes_in_effect(spark, d):
    """Orders as meter changes of their customers: the ones in effect, each from the next bar line on, without those withdrawn before it."""
    w = Window.partitionBy("o_custkey")
    o = table(spark, d, "orders").select("o_custkey", micros("o_orderdate").alias("at"), (2 + F.col("o_orderkey") % 5).cast("bigint").alias("length"))
    o = o.withColumn("beat", F.floor((F.col("at") - F.min("at").over(w)) / 86_400_000_000))
    return quantize.superseded_changes(o.groupBy("o_custkey", "beat").agg(F.max("length").alias("length")), ["o_custkey"], "beat")


_DOT = "list_sum(list_transform(range(1, 13), lambda i: {0}[i] * {1}[i]))"
DOWNBEATS = f"""{CHROMA}, s as (select rec, chroma, vec, row_number() over (partition by rec order by frame) - 1 as i from chroma join frames using (rec, frame)),
  v as (select rec, i, vec, chroma, lag(chroma) over (partition by rec order by i) as b, max(i) over (partition by rec) + 1 as last from s),
  e as (select rec, i, last, abs(vec[1]) as x, case when b is null or {_DOT.format("b", "b")} = 0 or {_DOT.format("chroma", "chroma")} = 0 then 0 else greatest(0, 1 - {_DOT.format("chroma", "b")} / (sqrt({_DOT.format("chroma", "chroma")}) * sqrt({_DOT.format("b", "b")}))) end as nov from v
    union all select rec, max(i) + 1, max(i) + 1, 0.0, 0 from s group by rec),
  h as (select *, last >= 2 as harmonic from e), u as (select *, i % 4 as p from h where not harmonic or i between 1 and last - 1),
  m as (select rec, avg(x) as m, any_value(harmonic) as harmonic from u group by rec), ph as (select rec, m, harmonic, unnest(range(0, 4)) as p from m),
  a as (select ph.rec, ph.p, any_value(ph.harmonic) as harmonic, coalesce(avg(nov), 0) as harmony, coalesce(avg(x), any_value(m)) - any_value(m) as accent, coalesce(sum(nov), 0) as s, coalesce(sum(nov * nov), 0) as q from ph left join u on u.rec = ph.rec and u.p = ph.p group by ph.rec, ph.p),
  r as (select *, row_number() over (partition by rec order by round(case when harmonic then harmony + 0.05 * tanh(accent) else accent end, 9) desc, case when harmonic then round(harmony, 9) end desc, p) as k, sum(harmony) over (partition by rec) as total from a),
  o as (select rec, max(harmony) as other from r where k > 1 group by rec)
  """


@query(f"""with {DOWNBEATS} select r.rec, cast(p as integer) as phase, harmonic, round(case when harmonic then 0.35 + 0.25 * greatest(0, least(1, (harmony - other) / 0.1)) * greatest(0, least(1, (case when total > 0 then harmony / total else 0.25 end - 0.25) / 0.75))
    * greatest(0, least(1, case when q > 0 then s * s / q else 0 end / 3)) else 0.35 end, 6) as confidence from r join o on o.rec = r.rec where k = 1""")
def downbeats_by_harmony(spark, d):
    """The bar line's phase of each series of frames: chroma novelty at beats and onset advantage, two evidences in one score."""
    w = Window.partitionBy("rec").orderBy("frame")
    spans = chroma(spark, d).withColumn("i", (F.row_number().over(w) - 1).cast("bigint"))
    vec = table(spark, d, "embeddings").select(F.col("label").alias("rec"), F.col("vec_id").alias("frame"), F.abs(F.get("embedding", F.lit(0)).cast("double")).alias("x"))
    own = spans.join(vec, ["rec", "frame"]).select("rec", "i", "x")
    end = spans.groupBy("rec").agg((F.max("i") + 1).alias("i"), F.lit(0.0).alias("x"))
    found = downbeat.downbeat_phase(own.unionByName(end), downbeat.novelty_at_beats(spans, ["rec"], "i", "chroma"), ["rec"], "i", "x")
    return found.select("rec", "phase", "harmonic", F.round("confidence", 6).alias("confidence"))


@query(f"""with {ONSETS}, h as (select rec, (t_us - {ORIGIN}) // 3600000000 as h, sum(value) as v from onsets group by 1, 2), n as (select max(h) + 1 as n from h),
  f as (select rec, period, h % period as phase, sum(v) as s from (select *, unnest(range(18, 31)) as period from h) group by 1, 2, 3),
  r as (select rec, period, phase, round(s / ceil((n - phase) / period), 9) as strength, row_number() over (partition by rec order by round(s / ceil((n - phase) / period), 9) desc, period, phase) as k from f cross join n)
  select rec, cast(period as integer) as period, cast(phase as bigint) as phase, round(strength, 6) as strength from r where k = 1""")
def comb_of_hours(spark, d):
    """The period (18 to 30 hours) and phase at which each user's activity recurs most strongly."""
    h = onsets(spark, d).groupBy("rec", F.floor((F.col("at") - ORIGIN) / 3_600_000_000).alias("h")).agg(F.sum("value").alias("v"))
    n = h.agg((F.max("h") + 1).alias("n"))
    found = downbeat.comb(h.join(F.broadcast(n)), ["rec"], "h", "v", F.col("n"), list(range(18, 31)))  # one row
    return found.select("rec", "period", "phase", F.round("strength", 6).alias("strength"))


@query(f"""with recursive {ONSETS}, x as (select rec, event_id, value, row_number() over (partition by rec order by t_us, event_id) - 1 as i from onsets),
  f as (select rec, i, value as y from x where i = 0 union all select x.rec, x.i, f.y + 0.55 * (x.value - f.y) from f join x on x.rec = f.rec and x.i = f.i + 1),
  n as (select rec, max(i) as n from f group by rec),
  b as (select f.rec, f.i, f.y from f join n on n.rec = f.rec and f.i = n.n union all select f.rec, f.i, b.y + 0.55 * (f.y - b.y) from b join f on f.rec = b.rec and f.i = b.i - 1)
  select x.rec, x.event_id, round(b.y, 6) as smooth from b join x on x.rec = b.rec and x.i = b.i""")
def lowpass_series(spark, d):
    """Each user's values smoothed forward and backward, in blocks of a series (of 16 here, so that they are many)."""
    w = Window.partitionBy("rec").orderBy("at", "event_id")
    x = onsets(spark, d).withColumn("i", (F.row_number().over(w) - 1).cast("bigint"))
    smooth = downbeat.zero_phase(x.select("rec", "i", "value"), ["rec"], "i", "value", 0.45, block=16)
    return x.select("rec", "event_id", "i").join(smooth, ["rec", "i"]).select("rec", "event_id", F.round("smooth", 6).alias("smooth"))


@query("select user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap_us from events")
def streamed_gaps(spark, d):
    """The time since each user's last event, by a stream that takes the events in in four runs and keeps its state between them."""
    from tempograph.streaming.onset_rate import EVENTS, gaps_in_runs

    names = [p.split()[0] for p in EVENTS.split(", ")]
    return gaps_in_runs(table(spark, d, "events").select(names), "ts", 4)


@query(f"""with {STAFF}, b as (select rec, start, stop, len(pitches) as n, unnest(range(cast(floor(start / 4) as bigint), cast(ceil(stop / 4) as bigint))) as bar from ev where stop > start),
  sums as (select rec, bar, cast(round(sum(least(stop, bar * 4 + 4) - greatest(start, bar * 4)) * 768) as bigint) as ticks from b group by rec, bar),
  opening as (select rec, min(bar) as f from sums group by rec)
  select sums.rec, cast(case when rec % 2 = 0 then bar else bar + 1 end as integer) as number, case when rec % 2 = 0 and bar = 0 then 'yes' end as implicit, case when bar = f then 4 end as beats, ticks from sums join opening using (rec)""")
def musicxml_measures(spark, d):
    """Each recording's staff as a MusicXML document of nested rows, read back: measures with their number, meter and the length of their notes."""
    pieces = notation.bar_pieces(staff(spark, d), ["rec"]).withColumn("part", F.lit("melody"))
    rows = nested_score.note_rows(pieces, ["rec", "part"])
    meters = pieces.select("rec", "bar").distinct().select("rec", "bar", F.lit(4).alias("num"), F.lit(4).alias("den"), F.when(F.col("rec") % 3 == 0, -2).otherwise(1).alias("fifths"), (F.col("rec") % 2 == 0).alias("up"))
    back = nested_score.read_score_xml(nested_score.score_xml(rows, meters, ["rec"], "part", F.col("up")), ["rec"])
    ticks = F.aggregate(F.filter("note", lambda n: n["chord"].isNull()), F.lit(0).cast("bigint"), lambda a, n: a + n["duration"])
    return back.select("rec", "number", "implicit", "beats", ticks.alias("ticks"))


@query("""with l as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i, o_orderkey, o_orderpriority from orders)
  select o_custkey, 3 * i as line_no, 'chart' || o_custkey || '.ly' as file, cast(o_orderkey % 90 as integer) as line, cast(i as integer) as column, case when o_orderkey % 2 = 0 then 'warning' else 'error' end as level, o_orderpriority as message from l""")
def engraver_complaints(spark, d):
    """complaints of an engraver's log, one for each order, each followed by two lines of echo that may look like one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").withColumn("i", F.row_number().over(w) - 1)
    said = F.concat(F.lit("chart"), F.col("o_custkey").cast("string"), F.lit(".ly:"), (F.col("o_orderkey") % 90).cast("string"), F.lit(":"), F.col("i").cast("string"), F.lit(": "), F.when(F.col("o_orderkey") % 2 == 0, "warning").otherwise("error"), F.lit(": "), F.col("o_orderpriority"))
    lines = F.array(F.struct((3 * F.col("i")).alias("line_no"), said.alias("line")), F.struct((3 * F.col("i") + 1).alias("line_no"), F.lit("  c'4 d'4").alias("line")), F.struct((3 * F.col("i") + 2).alias("line_no"), F.lit("        e'4").alias("line")))
    log = o.select("o_custkey", F.explode(lines).alias("l")).select("o_custkey", "l.*")
    from tempograph.sources.text_charts import renderer_complaints

    return renderer_complaints(log, "o_custkey", "line_no", "line").select("o_custkey", F.col("line_no").cast("bigint").alias("line_no"), "file", "line", "column", "level", "message")
