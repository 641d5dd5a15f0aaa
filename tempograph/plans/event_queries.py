"""Queries over event streams: rates, joins in time, sweeps, runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempograph.functions import theory
from tempograph.functions import vectors as V
from tempograph.operators import stats, temporal
from tempograph.plans.bindings import NOTES, ONSETS, ORIGIN, SIX_HOURS, micros, notes, onsets, table

FOUND: dict = {}


def query(sql: str | None = None):
    def add(fn):
        FOUND[fn.__name__] = (fn, sql)
        return fn

    return add


@query(f"with {ONSETS} select rec, event_id, t_us - lag(t_us) over (partition by rec order by t_us, event_id) as gap from onsets")
def inter_onset_intervals(spark, d):
    return temporal.intervals_between(onsets(spark, d), ["rec"], "at", ["event_id"]).select("rec", "event_id", "gap")


GAPS = f"{ONSETS}, gaps as (select rec, t_us - lag(t_us) over (partition by rec order by t_us, event_id) as gap from onsets), med as (select rec, median(gap) as m from gaps where gap is not null group by rec)"


@query(f"with {GAPS} select rec, round(m, 3) as median_gap, round(60000000.0 / m, 6) as per_minute from med")
def median_pulse_rate(spark, d):
    m = stats.median_rate(onsets(spark, d), ["rec"], "at", ["event_id"])
    return m.select("rec", F.round("median_gap", 3).alias("median_gap"), F.round(60_000_000.0 / F.col("median_gap"), 6).alias("per_minute"))


@query(f"""with {GAPS} select g.rec, round(any_value(m), 3) as median_gap,
  round(coalesce(avg(gap) filter (where gap between m * 0.8 and m * (1 + 0.2)), any_value(m)), 3) as steady_gap
  from gaps g join med on g.rec = med.rec where gap is not null group by g.rec""")
def steady_pulse_rate(spark, d):
    s = stats.steady_rate(onsets(spark, d), ["rec"], "at", ["event_id"])
    return s.select("rec", F.round("median_gap", 3).alias("median_gap"), F.round("steady_gap", 3).alias("steady_gap"))


@query(f"""with {ONSETS}, n as (select rec, t_us, lead(t_us) over w as nxt, row_number() over w - 1 as i, first_value(t_us) over w as f from onsets window w as (partition by rec order by t_us, event_id)),
  seg as (select rec, i, t_us - f as start_us, nxt - t_us as len from n where nxt is not null)
  select rec, i as start_beat, start_us, round(60000000.0 / len, 6) as bpm, 'MEASURED' as provenance from seg where len > 0
  union all select rec, cast(-1 as bigint), -len, round(60000000.0 / len, 6), 'DERIVED' from seg where i = 0 and len > 0""")
def tempo_segments_from_beats(spark, d):
    """A measured segment for each interval, and a lead-in pulse before the first beat."""
    w = Window.partitionBy("rec").orderBy("at", "event_id")
    n = onsets(spark, d).select("rec", F.col("at"), F.lead("at").over(w).alias("nxt"), (F.row_number().over(w) - 1).cast("bigint").alias("i"), F.first("at").over(w).alias("f"))
    seg = n.where("nxt > at").select("rec", "i", (F.col("at") - F.col("f")).alias("start_us"), (F.col("nxt") - F.col("at")).alias("len"))
    bpm = F.round(60_000_000.0 / F.col("len"), 6).alias("bpm")
    own = seg.select("rec", F.col("i").alias("start_beat"), "start_us", bpm, F.lit("MEASURED").alias("provenance"))
    lead = seg.where("i = 0").select("rec", F.lit(-1).cast("bigint").alias("start_beat"), (-F.col("len")).alias("start_us"), bpm, F.lit("DERIVED").alias("provenance"))
    return own.unionByName(lead)


CLICKS = "v as (select rec, event_id, t_us from onsets where event_type = 'view'), c as (select rec, event_id as hit_id, t_us as hit_at, value as hit_value from onsets where event_type = 'click')"


@query(f"with {ONSETS}, {CLICKS} select v.rec, v.event_id, c.hit_id, v.t_us - c.hit_at as since from v asof left join c on v.rec = c.rec and v.t_us >= c.hit_at")
def asof_segment(spark, d):
    e = onsets(spark, d)
    v = e.where("event_type = 'view'").select("rec", "event_id", "at")
    c = e.where("event_type = 'click'").select("rec", F.col("event_id").alias("hit_id"), F.col("at").alias("hit_at"))
    out = temporal.asof_join(v, c, ["rec"], "at", "hit_at", ["hit_id"], ["hit_id", "hit_at"])
    return out.select("rec", "event_id", "hit_id", (F.col("at") - F.col("hit_at")).alias("since"))


@query("""with o as (select o_custkey as rec, o_orderkey, epoch_us(o_orderdate) as start_us, round(o_totalprice / 1000) as rate from orders),
  s as (select *, lead(start_us) over w as nxt, coalesce(sum(rate * (l)) over (partition by rec order by start_us, o_orderkey rows between unbounded preceding and 1 preceding), 0) as start_y
        from (select *, (lead(start_us) over (partition by rec order by start_us, o_orderkey) - start_us) / 1e6 as l from o) window w as (partition by rec order by start_us, o_orderkey)),
  p as (select row_number() over () as id, o_custkey as rec, l_orderkey, l_linenumber, epoch_us(l_shipdate) as t_us from lineitem join orders on l_orderkey = o_orderkey),
  h as (select p.*, s.o_orderkey as segment, start_us, start_y, rate, row_number() over (partition by p.id order by start_us <= t_us desc, abs(t_us - start_us), case when start_us <= t_us then -s.o_orderkey else s.o_orderkey end) as r from p join s on p.rec = s.rec)
  select l_orderkey, l_linenumber, segment, round(start_y + ((t_us - start_us) / 1e6) * rate, 1) as y from h where r = 1""")
def piecewise_time_map(spark, d):
    """J1, J2 over orders as rate segments of a customer, probed at shipping dates; the first segment holds for earlier ones."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("rec"), "o_orderkey", micros("o_orderdate").alias("start_us"), F.round(F.col("o_totalprice") / 1000).alias("rate"))
    w = Window.partitionBy("rec").orderBy("start_us", "o_orderkey")
    length = (F.lead("start_us").over(w) - F.col("start_us")) / 1e6
    s = o.withColumn("l", length).withColumn("start_y", F.coalesce(F.sum(F.col("rate") * F.col("l")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("l")
    s = s.withColumnRenamed("o_orderkey", "segment")
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    p = p.select(F.col("o_custkey").alias("rec"), "l_orderkey", "l_linenumber", micros("l_shipdate").alias("at"))
    hit = temporal.asof_join(p, s, ["rec"], "at", "start_us", ["segment"], ["segment", "start_us", "start_y", "rate"], clamp=True)
    y = V_piecewise(F.col("at"), F.col("start_us"), F.col("start_y"), F.col("rate"))
    return hit.select("l_orderkey", "l_linenumber", "segment", F.round(y, 1).alias("y"))


def V_piecewise(at, start_us, start_y, rate):
    return temporal.piecewise_map((at - start_us) / 1e6, F.lit(0.0), start_y, rate)


@query(f"""with {ONSETS}, {CLICKS}, j as (select v.rec, v.event_id, hit_id, abs(v.t_us - hit_at) as far, row_number() over (partition by v.event_id order by abs(v.t_us - hit_at), hit_at, hit_id) as r from v join c on v.rec = c.rec)
  select v.rec, v.event_id, j.hit_id, far from v left join j on v.event_id = j.event_id and r = 1""")
def nearest_event(spark, d):
    e = onsets(spark, d)
    v = e.where("event_type = 'view'").select("rec", "event_id", "at")
    c = e.where("event_type = 'click'").select("rec", F.col("event_id").alias("hit_id"), F.col("at").alias("hit_at"))
    out = temporal.nearest_join(v, c, ["rec"], "at", "hit_at", ["hit_id"], ["hit_id", "hit_at"])
    return out.select("rec", "event_id", "hit_id", F.abs(F.col("at") - F.col("hit_at")).alias("far"))


@query(f"""with {NOTES} select a.rec, a.event_id, b.event_id as other, least(a.end_us, b.end_us) - greatest(a.onset, b.onset) as overlap
  from notes a join notes b on a.rec = b.rec and a.onset < b.end_us and b.onset < a.end_us where a.event_type = 'click' and b.event_type = 'view'""")
def interval_overlap(spark, d):
    n = notes(spark, d)
    a = n.where("event_type = 'click'").select("rec", "event_id", "onset", "end_us")
    b = n.where("event_type = 'view'").select("rec", F.col("event_id").alias("other"), F.col("onset").alias("b_on"), F.col("end_us").alias("b_end"))
    pairs = temporal.overlap_join(a, b, ["rec"], ("onset", "end_us"), ("b_on", "b_end"), 4 * SIX_HOURS, ORIGIN)
    return pairs.select("rec", "event_id", "other", (F.least("end_us", "b_end") - F.greatest("onset", "b_on")).alias("overlap"))


@query(f"""with {NOTES}, i as (select rec, event_id as held, onset, least(end_us, coalesce(lead(onset) over (partition by rec order by onset, event_id), end_us)) as cut from notes)
  select v.rec, v.event_id, i.held from (select user_id as rec, event_id, epoch_us(ts) + 3600000000 as t_us from events) v left join i on v.rec = i.rec and v.t_us >= i.onset and v.t_us < i.cut""")
def point_in_interval(spark, d):
    n = temporal.truncate_overlaps(notes(spark, d), ["rec"], ["onset", "event_id"], "onset", "end_us")
    p = onsets(spark, d).select("rec", "event_id", (F.col("at") + 3_600_000_000).alias("at"))
    out = temporal.point_in_interval(p, n.select("rec", F.col("event_id").alias("held"), "onset", "cut_end"), ["rec"], "at", "onset", "cut_end", ["held"])
    return out.select("rec", "event_id", "held")


BARS = "bars as (select rec, unnest(range((min(onset) - 1704067200000000) // 86400000000, (max(end_us) - 1 - 1704067200000000) // 86400000000 + 1)) as bar from notes group by rec)"


@query(f"""with {NOTES}, {BARS}, o as (select b.rec, bar, event_type, sum(least(end_us, 1704067200000000 + (bar + 1) * 86400000000) - greatest(onset, 1704067200000000 + bar * 86400000000)) as overlap, min(onset) as f
    from bars b join notes n on b.rec = n.rec and n.onset < 1704067200000000 + (bar + 1) * 86400000000 and n.end_us > 1704067200000000 + bar * 86400000000 group by 1, 2, 3),
  r as (select *, row_number() over (partition by rec, bar order by overlap desc, f, event_type) as k from o)
  select rec, bar, event_type, cast(overlap as bigint) as overlap from r where k = 1""")
def bar_dominant_label(spark, d):
    n = notes(spark, d)
    day = 4 * SIX_HOURS
    ends = n.groupBy("rec").agg(F.min("onset").alias("a"), F.max("end_us").alias("z"))
    low, high = (F.floor((F.col("a") - ORIGIN) / day), F.floor((F.col("z") - 1 - ORIGIN) / day))
    bars = ends.select("rec", F.explode(F.sequence(low, high)).alias("bar"))
    bars = bars.withColumns({"bar_from": F.col("bar") * day + ORIGIN, "bar_to": (F.col("bar") + 1) * day + ORIGIN})
    return temporal.dominant_by_overlap(bars, n.select("rec", "onset", "end_us", "event_type"), ["rec"], ["bar"], ("bar_from", "bar_to"), ("onset", "end_us"), "event_type", day, ORIGIN)


@query(f"""with recursive {ONSETS}, e as (select rec, t_us, event_type, row_number() over (partition by rec order by t_us, event_id) as i from onsets where event_type in ('click', 'view')),
  w as (select rec, i, t_us, event_type, case when event_type = 'click' then 1 else 0 end as open, false as used from e where i = 1
        union all select e.rec, e.i, e.t_us, e.event_type, case when e.event_type = 'click' then w.open + 1 else greatest(w.open - 1, 0) end, e.event_type = 'view' and w.open > 0 from w join e on e.rec = w.rec and e.i = w.i + 1),
  n as (select rec, t_us, row_number() over (partition by rec order by t_us, i) as rank from w where event_type = 'click'),
  f as (select rec, t_us, row_number() over (partition by rec order by t_us, i) as rank from w where used)
  select n.rec, n.rank, n.t_us as on_at, f.t_us as off_at from n left join f on n.rec = f.rec and n.rank = f.rank""")
def fifo_pairing(spark, d):
    """Click opens, view closes."""
    t = F.col("event_type")
    return temporal.fifo_pairs(onsets(spark, d), ["rec"], ["at", "event_id"], t == "click", t == "view", "at")


@query(f"with {ONSETS} select rec, event_id, round(greatest(0, value - avg(value) over (partition by rec order by t_us, event_id rows between 4 preceding and 4 following)), 6) as detrended from onsets")
def moving_average_detrend(spark, d):
    return stats.detrend(onsets(spark, d), ["rec"], ["at", "event_id"], "value", 8).select("rec", "event_id", F.round("detrended", 6).alias("detrended"))


@query(f"with {ONSETS} select rec, event_id, round(case when stddev_pop(value) over w < 1e-12 then 0 else (value - avg(value) over w) / stddev_pop(value) over w end, 6) as z from onsets window w as (partition by rec)")
def zscore_normalise(spark, d):
    return stats.normalise(onsets(spark, d), ["rec"], "value").select("rec", "event_id", F.round("z", 6).alias("z"))


@query(f"with {ONSETS} select rec, round(case when stddev_pop(value) > 1e-12 then greatest(0, least(1, 1 - 3 / (kurtosis_pop(value) + 3))) else 0 end, 6) as peakiness from onsets group by rec")
def peakiness(spark, d):
    return stats.peakiness(onsets(spark, d), ["rec"], "value").withColumn("peakiness", F.round("peakiness", 6))


HOURS = f"{ONSETS}, counted as (select cast(floor((t_us - {ORIGIN}) / 3.6e9) as bigint) as h, count(*) as n from onsets group by 1), hours as (select h, coalesce(n, 0)::double as n from (select unnest(range(min(h), max(h) + 1)) as h from counted) left join counted using (h))"


def hourly(spark, d):
    """Events in each hour from the first to the last of the table; hours count from ORIGIN."""
    counted = onsets(spark, d).groupBy(F.floor((F.col("at") - ORIGIN) / 3_600_000_000).alias("h")).agg(F.count("*").alias("n"))
    every = counted.agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low is not null").select(F.explode(F.sequence("low", "high")).alias("h"))
    return every.join(counted, "h", "left").select(F.lit(1).alias("rec"), "h", F.coalesce("n", F.lit(0)).cast("double").alias("n"))


@query(f"with {HOURS}, l as (select unnest(range(0, 49)) as lag) select cast(lag as integer) as lag, round(sum(a.n * b.n) / (select count(*) from hours), 6) as acf from l join hours a on true join hours b on b.h = a.h + lag group by lag")
def autocorrelation(spark, d):
    return stats.autocorrelation(hourly(spark, d), ["rec"], "h", "n", 48).select("lag", F.round("acf", 6).alias("acf"))


@query(f"""with {HOURS}, l as (select unnest(range(0, 49)) as lag), a as (select lag, sum(x.n * y.n) / (select count(*) from hours) as acf from l join hours x on true join hours y on y.h = x.h + lag group by lag),
  v as (select list(acf order by lag) as acf from a), g as (select 40 + 0.25 * unnest(range(0, 801)) as bpm),
  s as (select bpm, 60.0 * 4 / bpm * 4 as lag, acf from g, v),
  t as (select bpm, (acf[cast(floor(lag) as int) + 1] + (lag - floor(lag)) * (acf[cast(floor(lag) as int) + 2] - acf[cast(floor(lag) as int) + 1])) * exp(-0.5 * pow(log2(bpm / 120) / 1.4, 2)) as score from s)
  select bpm, round(score, 6) as score from t order by round(score, 6) desc, bpm limit 1""")
def tempo_estimate(spark, d):
    """The tempo whose lag in the autocorrelation, weighted by the prior, scores best."""
    acf = stats.autocorrelation(hourly(spark, d), ["rec"], "h", "n", 48).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("acf"))
    grid = acf.withColumn("bpm", F.explode(F.transform(F.sequence(F.lit(0), F.lit(800)), lambda i: 40 + 0.25 * i)))
    score = V.interpolate(F.col("acf"), 960.0 / F.col("bpm")) * theory.tempo_prior(F.col("bpm"))
    best = grid.select("bpm", F.round(score, 6).alias("score"))
    return best.orderBy(F.desc("score"), "bpm").limit(1)


PHASES = f"{ONSETS}, ph as (select rec, value, (row_number() over (partition by rec order by t_us, event_id) - 1) % 4 as phase from onsets)"
PHASE_STATS = f"""{PHASES}, ov as (select rec, avg(value) as m from ph group by rec), every as (select rec, m, unnest(range(0, 4)) as phase from ov),
  own as (select rec, phase, avg(value) as a, sum(value) as s, sum(value * value) as q from ph group by 1, 2),
  st as (select e.rec, e.phase, coalesce(a, 0) as mean, coalesce(a, 0) - m as advantage, case when coalesce(q, 0) > 0 then s * s / q else 0 end as effective from every e left join own o on e.rec = o.rec and e.phase = o.phase)"""


def phased(spark, d):
    w = Window.partitionBy("rec").orderBy("at", "event_id")
    return stats.phase_means(onsets(spark, d).withColumn("i", F.row_number().over(w) - 1), ["rec"], "i", "value", 4)


@query(f"with {PHASE_STATS} select rec, phase, round(mean, 6) as mean, round(advantage, 6) as advantage, round(effective, 6) as effective from st")
def phase_means(spark, d):
    return phased(spark, d).select("rec", "phase", *(F.round(c, 6).alias(c) for c in ("mean", "advantage", "effective")))


@query(f"""with {PHASE_STATS}, r as (select *, row_number() over (partition by rec order by round(advantage + 0.05 * tanh(effective / 10), 6) desc, round(advantage, 6) desc, phase) as k from st)
  select rec, phase, round(advantage, 6) as advantage, round(0.35 + 0.25 * tanh(effective / 10), 6) as confidence from r where k = 1""")
def downbeat_phase(spark, d):
    """The phase with the best advantage and accent; ties by advantage, then the first."""
    score = F.round(F.col("advantage") + 0.05 * F.tanh(F.col("effective") / 10), 6)
    best = temporal.first_of_each(phased(spark, d), ["rec"], [F.desc(score), F.desc(F.round("advantage", 6)), "phase"])
    return best.select("rec", "phase", F.round("advantage", 6).alias("advantage"), F.round(0.35 + 0.25 * F.tanh(F.col("effective") / 10), 6).alias("confidence"))


@query("""select conv_id, cast(run as bigint) as run, min(turn) as first_turn, max(turn) as last_turn, any_value(role) as role, count(*) as n from
  (select *, sum(c) over (partition by conv_id order by turn rows unbounded preceding) as run from
    (select *, case when lag(role) over (partition by conv_id order by turn) is distinct from role and row_number() over (partition by conv_id order by turn) > 1 then 1 else 0 end as c from conversations)) group by conv_id, run""")
def run_merge_islands(spark, d):
    runs = temporal.islands(table(spark, d, "conversations"), ["conv_id"], ["turn"], "role")
    return runs.groupBy("conv_id", "run").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.first("role").alias("role"), F.count("*").alias("n"))


@query("select conv_id, cast(count(*) filter (where d) as bigint) as changes from (select conv_id, role <> lag(role) over (partition by conv_id order by turn) as d from conversations) group by conv_id")
def change_count(spark, d):
    return stats.change_count(table(spark, d, "conversations"), ["conv_id"], ["turn"], "role")


@query(f"""with {NOTES}, k as (select rec, event_id, onset, row_number() over (partition by rec order by onset, event_id) - 1 as i from notes)
  select rec, event_id, max(onset - i * 3600000000) over (partition by rec order by onset, event_id rows unbounded preceding) + i * 3600000000 as fixed from k""")
def monotone_starts(spark, d):
    return temporal.monotone_starts(notes(spark, d), ["rec"], ["onset", "event_id"], "onset", 3_600_000_000).select("rec", "event_id", "fixed")


@query(f"with {NOTES} select rec, event_id, least(end_us, lead(onset) over (partition by rec order by onset, event_id)) as cut_end from notes")
def truncate_overlaps(spark, d):
    return temporal.truncate_overlaps(notes(spark, d), ["rec"], ["onset", "event_id"], "onset", "end_us").select("rec", "event_id", "cut_end")


@query(f"""with {NOTES}, p as (select rec, onset as t_us from notes union select rec, end_us from notes), e as (select rec, t_us as a, lead(t_us) over (partition by rec order by t_us) as z from p),
  l as (select e.rec, a, z, min(midi) as low from e left join notes n on n.rec = e.rec and n.onset < z and n.end_us > a where z is not null group by e.rec, a, z),
  g as (select *, sum(c) over (partition by rec order by a rows unbounded preceding) as run from (select *, case when row_number() over w > 1 and lag(low) over w is distinct from low then 1 else 0 end as c from l window w as (partition by rec order by a)))
  select rec, min(a) as from_at, max(z) as to_at, any_value(low) as low from g group by rec, run""")
def bass_line_sweep(spark, d):
    """J8."""
    n = notes(spark, d).select("rec", "onset", "end_us", "midi")
    return temporal.lowest_line(n, ["rec"], "onset", "end_us", "midi", 4 * SIX_HOURS, ORIGIN)


@query("""with o as (select o_custkey, o_orderkey, epoch_us(o_orderdate) as s, round(o_totalprice / 1000) as rate, o_orderstatus from orders),
  seg as (select *, lead(s) over w as z, max(case when o_orderstatus <> 'O' then 1 else 0 end) over (partition by o_custkey order by s, o_orderkey rows unbounded preceding) as k from o window w as (partition by o_custkey order by s, o_orderkey)),
  c as (select o_custkey, rate, least(z, 852076800000000) - greatest(s, 725846400000000) as len from seg where k = 1 and z is not null)
  select o_custkey, round(case when count(*) = 1 then max(rate) else sum(len * rate) / sum(len) end, 4) as avg_rate from c where len > 0 group by o_custkey""")
def weighted_avg_rate(spark, d):
    """A4, A5: time-weighted rate of a customer's orders in a window, without the leading open ones."""
    w = Window.partitionBy("o_custkey").orderBy("s", "o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", micros("o_orderdate").alias("s"), F.round(F.col("o_totalprice") / 1000).alias("rate"), "o_orderstatus")
    seg = stats.without_leading(o.withColumn("z", F.lead("s").over(w)), ["o_custkey"], ["s", "o_orderkey"], F.col("o_orderstatus") == "O").where("z is not null")
    return stats.weighted_rate(seg, ["o_custkey"], "s", "z", "rate", 725_846_400_000_000, 852_076_800_000_000).withColumn("avg_rate", F.round("avg_rate", 4))


@query(f"with {NOTES} select rec, event_id, max(end_us) over (partition by rec order by onset, event_id rows between unbounded preceding and 1 preceding) as furthest from notes")
def running_max_constraint(spark, d):
    return temporal.furthest_end(notes(spark, d), ["rec"], ["onset", "event_id"], "end_us").select("rec", "event_id", "furthest")


@query("select o_custkey, o_orderdate, count(*) as n from orders group by 1, 2 having count(*) > 1")
def uniqueness_check(spark, d):
    return stats.repeated_keys(table(spark, d, "orders"), ["o_custkey", "o_orderdate"])


@query(f"with {NOTES} select rec, count(*) filter (where onset < e) = 0 as monophonic from (select rec, onset, lag(end_us) over (partition by rec order by onset, event_id) as e from notes) group by rec")
def monophony(spark, d):
    """P8, P9."""
    w = Window.partitionBy("rec").orderBy("onset", "event_id")
    each = notes(spark, d).withColumn("ok", F.coalesce(F.col("onset") >= F.lag("end_us").over(w), F.lit(True)))
    return each.groupBy("rec").agg(F.every("ok").alias("monophonic"))


@query(f"with {ONSETS} select rec, round(max(abs(value)), 6) as peak, round(sqrt(avg(value * value)), 6) as rms from onsets group by rec")
def rms_peak(spark, d):
    return stats.peak_rms(onsets(spark, d), ["rec"], "value").select("rec", F.round("peak", 6).alias("peak"), F.round("rms", 6).alias("rms"))


@query(f"with {NOTES} select rec, cast(min(midi) as integer) as lowest, cast(max(midi) as integer) as highest, round(avg(midi), 6) as mean, count(*) filter (where midi between 40 and 59) as in_range from notes group by rec")
def pitch_range(spark, d):
    """A7, X5."""
    return notes(spark, d).groupBy("rec").agg(F.min("midi").alias("lowest"), F.max("midi").alias("highest"), F.round(F.avg("midi"), 6).alias("mean"), F.count_if(F.col("midi").between(40, 59)).alias("in_range"))


@query(f"with {NOTES} select rec, event_id, pc from (select *, row_number() over (partition by rec order by end_us - onset desc, onset, event_id) as k from notes) where k = 1")
def longest_interval(spark, d):
    """The longest note; the earliest on a tie."""
    return temporal.first_of_each(notes(spark, d), ["rec"], [F.desc(F.col("end_us") - F.col("onset")), "onset", "event_id"]).select("rec", "event_id", "pc")


@query(f"with {NOTES} select rec, event_id, rank from (select *, row_number() over (partition by rec order by velocity desc, onset, event_id) as rank from notes) where rank <= 8")
def first_eight(spark, d):
    """O6, O7."""
    return temporal.top_k(notes(spark, d), ["rec"], [F.desc("velocity"), "onset", "event_id"], 8).select("rec", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"with {NOTES} select distinct rec, unnest(range((onset - {ORIGIN}) // {SIX_HOURS}, (end_us - 1 - {ORIGIN}) // {SIX_HOURS} + 1)) as slot from notes")
def sounding_slots(spark, d):
    """W21, L19."""
    return temporal.sounding_slots(notes(spark, d), ["rec"], "onset", "end_us", SIX_HOURS, ORIGIN)


@query(f"""with {ONSETS}, k as (select *, case when event_type = 'purchase' then event_id end as p from onsets)
  select rec, event_id, last_value(p ignore nulls) over (partition by rec order by t_us, event_id rows between unbounded preceding and 1 preceding) as previous_known,
  first_value(p ignore nulls) over (partition by rec order by t_us, event_id rows between 1 following and unbounded following) as next_known from k""")
def neighbour_lookup(spark, d):
    """J14."""
    e = onsets(spark, d).withColumn("p", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return temporal.neighbours(e, ["rec"], ["at", "event_id"], "p").select("rec", "event_id", "previous_known", "next_known")


@query(f"""with {ONSETS}, t as (select rec, min(t_us) as t0, any_value(m) as m from onsets join (select rec, median(gap) as m from (select rec, t_us - lag(t_us) over (partition by rec order by t_us, event_id) as gap from onsets) where gap is not null group by rec) using (rec) group by rec),
  b as (select rec, event_id, t_us, cast(floor((t_us - t0) / m + 0.5) as bigint) as idx, abs((t_us - t0) - floor((t_us - t0) / m + 0.5) * m) / m as err from onsets join t using (rec)),
  k as (select *, row_number() over (partition by rec, idx order by t_us, event_id) as r from b where err <= 0.25)
  select b.rec, count(*) as beats, cast(any_value(hits) as bigint) as hits, round(any_value(hits) / count(*), 6) as prec from b join (select rec, count(*) as hits from k where r = 1 group by rec) h on b.rec = h.rec group by b.rec""")
def beat_scores(spark, d):
    """Beats against a regular grid: a beat hits the grid point it rounds to, the first one there, within a quarter period."""
    e = onsets(spark, d)
    t = stats.median_rate(e, ["rec"], "at", ["event_id"]).join(e.groupBy("rec").agg(F.min("at").alias("t0")), "rec")
    x = (F.col("at") - F.col("t0")) / F.col("median_gap")
    b = e.join(t, "rec").withColumn("idx", F.floor(x + 0.5)).withColumn("err", F.abs((F.col("at") - F.col("t0")) - F.col("idx") * F.col("median_gap")) / F.col("median_gap"))
    w = Window.partitionBy("rec", "idx").orderBy(F.when(F.col("err") <= 0.25, 0).otherwise(1), "at", "event_id")
    hit = (F.row_number().over(w) == 1) & (F.col("err") <= 0.25)
    s = b.withColumn("hit", hit).groupBy("rec").agg(F.count("*").alias("beats"), F.count_if("hit").alias("hits"))
    return s.where("hits > 0").withColumn("prec", F.round(F.col("hits") / F.col("beats"), 6))
