"""Queries of single operators: text forms, grids, spelling, placing, checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempograph.functions import theory
from tempograph.functions import vectors as V
from tempograph.operators import harmony, layout, meter, notation, score, signal, stats, temporal
from tempograph.plans.bindings import CHROMA, FRAMES, NOTES, ONSETS, ORIGIN, SIX_HOURS, chroma, frames, micros, notes, onsets, table
from tempograph.plans.event_queries import PHASE_STATS
from tempograph.plans.symbolic_queries import BEATS, FIT, KEYS, METER_SQL, METERS, beats, chordlike, histograms
from tempograph.sources import audio, text_charts

FOUND: dict = {}


def query(sql: str | None = None):
    def add(fn):
        FOUND[fn.__name__] = (fn, sql)
        return fn

    return add


def rounded(df, digits: int, *columns: str):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---------------------------------------------------------------- text


@query(r"""select doc_id, trim(substr(regexp_replace(coalesce(text, ''), '[\x00-\x1f\x7f]', ' ', 'g'), 1, 96), ' ') as plain, replace(replace(coalesce(text, ''), '\', '\\'), '"', '\"') as quoted from documents""")
def plain_texts(spark, d):
    """F7, F8."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", theory.plain_text(t).alias("plain"), theory.quoted(t).alias("quoted"))


@query("""with o as (select o_orderkey, o_totalprice / 1000 as bpm, [1.0, 1.5, 0.5][o_orderkey % 3 + 1]::double as unit from orders), c as (select *, cast(floor(bpm / unit + 0.5) as bigint) as counted from o)
  select o_orderkey, case when counted < 1 then null when unit = 1 then counted || ' BPM' else counted || ' BPM (' || cast(floor(bpm + 0.5) as bigint) || ' quarters)' end as text from c""")
def tempo_texts(spark, d):
    """F11, M21."""
    unit = theory.pick([1.0, 1.5, 0.5], (F.col("o_orderkey") % 3).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", text_charts.tempo_text(F.col("o_totalprice") / 1000, unit).alias("text"))


@query("""with o as (select o_orderkey, o_totalprice / 1000 as bpm, [4, 6, 7, 2][o_orderkey % 4 + 1] as num, [4, 8, 8, 2][o_orderkey % 4 + 1] as den from orders),
  u as (select *, case when num = 6 then 1.5 else 4.0 / den end as unit from o), r as (select *, cast(floor(bpm / unit + 0.5) as bigint) as rate from u)
  select o_orderkey, case when rate >= 1 then '\\tempo \\markup { \\italic "ca." } ' || case when unit = 1.5 then '4.' when unit = 0.5 then '8' when unit = 2 then '2' else '4' end || ' = ' || rate end as mark, round(rate * unit, 6) as quarters from r""")
def tempo_marks(spark, d):
    """The mark of a counted tempo, and the quarter tempo that it means."""
    k = (F.col("o_orderkey") % 4).cast("int")
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("bpm"), theory.pick([4, 6, 7, 2], k).alias("num"), theory.pick([4, 8, 8, 2], k).alias("den"))
    unit = theory.beat_unit(F.col("num"), F.col("den"))
    return o.select("o_orderkey", notation.tempo_mark(F.col("bpm"), F.col("num"), F.col("den")).alias("mark"), F.round(F.floor(F.col("bpm") / unit + 0.5) * unit, 6).alias("quarters"))


@query("""with p as (select p_partkey, p_size || case when p_partkey % 7 = 0 then '-' else '/' end || [2, 4, 8, 16][p_partkey % 4 + 1] as text from part), m as (select *, regexp_matches(text, '^[0-9]+/[0-9]+$') as ok from p)
  select p_partkey, text, case when ok then cast(split_part(text, '/', 1) as integer) end as num, case when ok then cast(split_part(text, '/', 2) as integer) end as den,
    '#''(' || array_to_string(list_transform(range(p_partkey % 4 + 1), lambda i: i + 1), ' ') || ') ' || 7 || '/' || 8 as grouped, case when p_partkey % 3 = 0 then 'bass_8' when p_partkey % 3 = 1 then 'bass' else 'treble' end as clef from m""")
def meter_texts(spark, d):
    """Meters read from texts, meters with their groups, clefs of roles."""
    k = F.col("p_partkey")
    text = F.concat(F.col("p_size").cast("string"), F.when(k % 7 == 0, "-").otherwise("/"), theory.pick(["2", "4", "8", "16"], (k % 4).cast("int")))
    p = table(spark, d, "part").select("p_partkey", text.alias("text"), theory.meter_parts(text).alias("m"), theory.pick(["BASS", "PIANO_LEFT", "LEAD"], (k % 3).cast("int")).alias("role"))
    groups = F.sequence(F.lit(1), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select("p_partkey", "text", "m.num", "m.den", text_charts.meter_text(F.lit(7), F.lit(8), groups).alias("grouped"), theory.clef(F.col("role")).alias("clef"))


@query("""with w as (select conv_id, turn, unnest(string_split(text, ' ')) as word, unnest(range(len(string_split(text, ' ')))) as i from conversations)
  select conv_id, turn, string_agg(case when glue or i = 0 then word else ' ' || word end, '' order by i) as line from (select *, coalesce(length(lag(word) over (partition by conv_id, turn order by i)) % 3 = 0, true) as glue from w) group by 1, 2""")
def lyric_lines(spark, d):
    """Words of a turn as a line, without a blank after those (of a length that 3 divides) that a hyphen joins to the next."""
    words = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("text"), (F.length(w) % 3 == 0).alias("hyphenatedToNext")))
    return table(spark, d, "conversations").select("conv_id", "turn", text_charts.lyric_text(words).alias("line"))


@query(f"""with {KEYS}, b as (select rec, tonic, mode, row_number() over (partition by rec order by round(score, 9) desc, mode, tonic) as k from keyscore)
  select rec, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][tonic + 1] || ' ' || lower(mode) as name from b where k = 1""")
def key_names(spark, d):
    """F12."""
    best = temporal.first_of_each(harmony.key_scores(chordlike(spark, d), ["rec"], "root", "quality", "len"), ["rec"], [F.desc(F.round("score", 9)), "mode", "tonic"])
    return best.select("rec", text_charts.key_text(theory.sharp_name(F.col("tonic")), F.col("mode")).alias("name"))


@query("""with b as (select p_brand, list(p_name order by p_partkey) as names from part group by 1), u as (select p_brand, list_transform(list_filter(list_transform(names, lambda n, i: struct_pack(n := n, first := list_position(names, n) = i)), lambda x: x.first), lambda x: x.n) as names from b)
  select p_brand, array_to_string(names[:6], ', ') || case when len(names) > 6 then ' and ' || (len(names) - 6) || ' more' else '' end as listed from u""")
def first_parts(spark, d):
    """The parts asked for, each once, the first six by name."""
    p = table(spark, d, "part").groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]).alias("names"))
    return p.select("p_brand", text_charts.first_and_more(score.wanted_parts(F.col("names"))).alias("listed"))


@query("""with c as (select c_custkey, count(o_orderkey) as chords, count(o_orderkey) filter (where o_orderstatus = 'O') as beats from customer left join orders on c_custkey = o_custkey group by 1)
  select c_custkey, case when chords > 0 then null when beats = 0 then 'no beats were found, so no chord could be placed' else 'beats were found, but nothing that sounds like a chord' end as reason from c
  union all select -1 - c_custkey, case when beats = 0 then 'no beats were found, so no chord could be placed' else 'beats were found, but nothing that sounds like a chord' end from c""")
def missing_harmony(spark, d):
    """Orders stand for chords, open ones for beats; each customer again with its chords gone."""
    o = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    c = o.groupBy("c_custkey").agg(F.count("o_orderkey").alias("chords"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("beats"))
    both = c.unionByName(c.select((-1 - F.col("c_custkey")).alias("c_custkey"), F.lit(0).cast("bigint").alias("chords"), "beats"))
    return both.select("c_custkey", text_charts.missing_harmony(F.col("chords"), F.col("beats")).alias("reason"))


@query("""with n as (select o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m') as stamp, row_number() over (partition by o_custkey, strftime(o_orderdate, '%Y-%m') order by o_orderkey) as k, o_orderdate from orders),
  m as (select *, stamp || case when k > 1 then '-' || k else '' end as name from n)
  select o_orderkey, name, row_number() over (partition by o_custkey order by o_orderdate desc, name) as place from m""")
def take_listing(spark, d):
    """Takes named by their month, later ones of one month numbered; listed newest first, then by name."""
    o = table(spark, d, "orders").withColumn("stamp", F.date_format("o_orderdate", "yyyy-MM"))
    named = layout.free_names(o, ["o_custkey"], "stamp", ["o_orderkey"])
    return layout.newest_first(named, ["o_custkey"], "o_orderdate", "name").select("o_orderkey", "name", F.col("place").cast("bigint").alias("place"))


# ---------------------------------------------------------------- vectors and signals


@query(f"""with {FRAMES}, s as (select rec, frame, list_transform(vec, lambda x: x * power(10, -1.0 * (frame % 6))) as v from frames)
  select rec, frame, list_max(list_transform(v, lambda x: abs(x))) < 1e-4 as silent, list_max(v) <= 1e-9 as flat from s""")
def silent_frames(spark, d):
    """Frames scaled down by their number, and which are silent or flat."""
    s = frames(spark, d).select("rec", "frame", V.scale(F.col("vec"), F.pow(F.lit(10.0), -1.0 * (F.col("frame") % 6))).alias("v"))
    return s.select("rec", "frame", V.is_silent(F.col("v")).alias("silent"), V.is_flat(F.col("v")).alias("flat"))


@query(f"""with {FRAMES}, p as (select rec, frame, vec, lag(vec) over (partition by rec order by frame) as b from frames), s as (select rec, frame, list_transform(range(1, 65), lambda i: vec[i] + b[i]) as v from p where b is not null),
  n as (select rec, frame, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from s)
  select rec, frame, round(n, 6) as norm, round(list_sum(list_transform(v, lambda x: abs(x / n))), 6) as unit_sum, round(v[(frame % 60)::int + 1] + (frame % 4) / 4.0 * (v[(frame % 60)::int + 2] - v[(frame % 60)::int + 1]), 6) as between_bins, round(greatest(0, least(1, v[1])), 6) as clamped from n""")
def vector_sums(spark, d):
    """Each frame added to the one before; its length, its unit vector, a value between two bins, a clamped one."""
    w = Window.partitionBy("rec").orderBy("frame")
    p = frames(spark, d).withColumn("b", F.lag("vec").over(w)).where("b is not null").select("rec", "frame", V.vector_sum(F.col("vec"), F.col("b")).alias("v"))
    unit = V.total(F.transform(V.l2_normalise(F.col("v")), F.abs))
    between = V.interpolate(F.col("v"), F.col("frame") % 60 + F.col("frame") % 4 / 4.0)
    return p.select("rec", "frame", F.round(V.l2_norm(F.col("v")), 6).alias("norm"), F.round(unit, 6).alias("unit_sum"), F.round(between, 6).alias("between_bins"), F.round(V.clamp01(F.get("v", F.lit(0))), 6).alias("clamped"))


@query(f"with {FRAMES}, u as (select rec, frame, unnest(range(64)) as bin, unnest(vec) as x from frames) select rec, frame, bin, round(x, 6) as x from u where bin * 25.0 between 200 and 900")
def band_projection(spark, d):
    """The bins of a band of frequencies, 25 Hz a bin."""
    kept = signal.band(frames(spark, d), "vec", 25.0, 200.0, 900.0)
    return kept.select("rec", "frame", F.posexplode("vec").alias("k", "x")).select("rec", "frame", (F.col("k") + 8).cast("bigint").alias("bin"), F.round("x", 6).alias("x"))


# ---------------------------------------------------------------- rates and time


@query(f"""with {ONSETS}, n as (select rec, t_us, lead(t_us) over w as nxt, row_number() over w - 1 as i, first_value(t_us) over w as f, event_id from onsets window w as (partition by rec order by t_us, event_id)),
  s as (select rec, i as start_beat, (t_us - f) / 1e6 + case when event_id % 7 = 0 then 0.5 else 0 end as start_seconds, 6e7 / (nxt - t_us) as bpm from n where nxt > t_us),
  l as (select *, lag(start_seconds) over w + (start_beat - lag(start_beat) over w) * 60 / lag(bpm) over w as led from s window w as (partition by rec order by start_beat))
  select rec, start_beat, round(start_seconds, 4) as start_seconds from l where abs(led - start_seconds) > greatest(0.0015, 1e-6 * abs(start_seconds))""")
def inconsistent_tempi(spark, d):
    """Segments of a tempo map that don't begin where the one before leads; every seventh event is moved by half a second."""
    w = Window.partitionBy("rec").orderBy("at", "event_id")
    n = onsets(spark, d).select("rec", "at", "event_id", F.lead("at").over(w).alias("nxt"), (F.row_number().over(w) - 1).cast("bigint").alias("start_beat"), F.first("at").over(w).alias("f")).where("nxt > at")
    s = n.select("rec", "start_beat", ((F.col("at") - F.col("f")) / 1e6 + F.when(F.col("event_id") % 7 == 0, 0.5).otherwise(0.0)).alias("start_seconds"), (6e7 / (F.col("nxt") - F.col("at"))).alias("bpm"))
    return score.consistent_tempo(s, ["rec"]).select("rec", "start_beat", F.round("start_seconds", 4).alias("start_seconds"))


TEMPI = f"""{ONSETS}, seg as (select rec, row_number() over w - 1 as start_beat, case when rec % 3 = 0 then 90.0 else 60 + event_id % 50 end::double as bpm, case when rec % 2 = 0 then 'SUPPLIED' else 'MEASURED' end as provenance, lead(1) over w as more from onsets window w as (partition by rec order by t_us, event_id)),
  gp as (select rec, (t_us - lag(t_us) over (partition by rec order by t_us)) / 1e6 as gap from onsets where rec % 5 <> 0), md as (select rec, median(gap) as m from gp where gap is not null group by rec),
  st as (select g.rec, 60 / coalesce(avg(gap) filter (where gap between m * 0.8 and m * (1 + 0.2)), any_value(m)) as steady from gp g join md using (rec) where gap is not null group by g.rec)"""


@query(f"""with {TEMPI}, a as (select rec, case when bool_and(provenance = 'SUPPLIED') and max(bpm) - min(bpm) < 1e-9 then max(bpm) end as stated, case when count(*) = 1 then max(bpm) else count(more) / sum(case when more is not null then 1 / bpm end) end as average from seg group by rec)
  select a.rec, round(coalesce(stated, steady, average), 6) as bpm from a left join st on a.rec = st.rec""")
def estimated_tempi(spark, d):
    """Stated for recordings 0, 6, 12..., the grid's rate for most, the segments' average for those without a grid."""
    w = Window.partitionBy("rec").orderBy("at", "event_id")
    e = onsets(spark, d)
    bpm = F.when(F.col("rec") % 3 == 0, 90.0).otherwise((60 + F.col("event_id") % 50).cast("double"))
    seg = e.select("rec", (F.row_number().over(w) - 1).cast("double").alias("start_beat"), bpm.alias("bpm"), F.when(F.col("rec") % 2 == 0, "SUPPLIED").otherwise("MEASURED").alias("provenance"))
    grid = e.where("rec % 5 <> 0").select("rec", (F.col("at") / 1e6).alias("seconds"))
    return rounded(score.estimated_tempo(seg, grid, ["rec"]), 6, "bpm")


@query(f"""with {ONSETS}, w as (select rec, event_id, t_us, 90000000000 as len, 45000000000 as step from onsets), k as (select *, (t_us // step - unnest([0, 1])) * step as a from w)
  select rec as user_id, epoch_us(make_timestamp(a)) as from_us, count(*) as onsets from k where t_us < a + len group by 1, 2""")
def sliding_windows(spark, d):
    """Onsets of each half-overlapping window of 25 hours, by the operator that also runs on a stream."""
    from tempograph.streaming.onset_rate import sliding_rates

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sliding_rates(e).select("user_id", F.unix_micros("from_ts").alias("from_us"), "onsets")


@query(f"with {PHASE_STATS}, r as (select *, row_number() over (partition by rec order by mean desc, phase) as k from st) select rec, phase, 0.35::double as confidence from r where k = 1")
def accent_downbeats(spark, d):
    """D7."""
    w = Window.partitionBy("rec").orderBy("at", "event_id")
    b = onsets(spark, d).select("rec", (F.row_number().over(w) - 1).alias("beat_no"), F.col("value").alias("strength"))
    return score.accent_downbeat(b, ["rec"], 4)


@query(f"""with {ONSETS}, b as (select rec, event_id, t_us / 3.6e9 as s, row_number() over (partition by rec order by t_us, event_id) - 1 as i from onsets), wanted as (select rec, max(s) / 2 + min(s) / 2 as w from b group by rec),
  c as (select b.rec, i, abs(s - w) as far, row_number() over (partition by b.rec order by abs(s - w), s, i) as k from b join wanted using (rec))
  select b.rec, event_id, cast(((b.i - c.i) % 4 + 4) % 4 as integer) as pos, ((b.i - c.i) % 4 + 4) % 4 = 0 as downbeat, round(greatest(0, least(1, 1 - far / 5)), 6) as confidence from b join c on b.rec = c.rec and c.k = 1""")
def forced_downbeats(spark, d):
    """The beat nearest to the middle of a recording is made a downbeat."""
    b = onsets(spark, d).select("rec", "event_id", (F.col("at") / 3.6e9).alias("seconds"))
    wanted = b.groupBy("rec").agg((F.max("seconds") / 2 + F.min("seconds") / 2).alias("wanted"))
    out = score.forced_downbeat(b, wanted, ["rec"], 4, 5.0)
    return out.select("rec", "event_id", F.col("pos").cast("int").alias("pos"), "downbeat", F.round("confidence", 6).alias("confidence"))


@query(f"""with {NOTES}, s as (select rec, min(onset) as f, count(*) as n, (max(onset) - min(onset)) / count(*) as gap from notes group by rec) select rec, cast(greatest(1, floor((f - {ORIGIN}) / gap + 0.5)) as bigint) as lead_in from s where gap > 0""")
def lead_ins(spark, d):
    """W18, T4."""
    s = notes(spark, d).groupBy("rec").agg((F.min("onset") - ORIGIN).alias("f"), ((F.max("onset") - F.min("onset")) / F.count("*")).alias("gap")).where("gap > 0")
    return meter.with_lead_in(s, ["rec"], "f", "gap").select("rec", F.col("lead_in").cast("bigint").alias("lead_in"))


# ---------------------------------------------------------------- grids and layout


@query(f"""with {BEATS}, d as (select rec, floor(beat / 4) * 4 as line, beat from beats), f as (select rec, case when rec % 2 = 0 then min(beat) else min(beat) - 9 end + 3.0 as chord from d group by rec),
  c as (select d.rec, max(line) filter (where line <= chord + 0.25) as held, min(line) as opening, any_value(chord) as chord from d join f using (rec) group by d.rec)
  select rec, round(coalesce(held, opening - ceil((opening - chord) / 4) * 4), 6) as origin from c""")
def chart_origins(spark, d):
    """L3: the bar axis of each recording, for a first chord inside it or (odd ones) before its first downbeat."""
    b = beats(spark, d).select("rec", (F.floor(F.col("beat") / 4) * 4).alias("at"), "beat", F.lit(True).alias("downbeat"))
    w = Window.partitionBy("rec")
    b = b.withColumn("chord", F.min("beat").over(w) - F.when(F.col("rec") % 2 == 0, 0.0).otherwise(9.0) + 3.0)
    return rounded(meter.chart_origin(b, ["rec"], F.col("chord"), 0.25, 4.0), 6, "origin")


@query(f"""with {BEATS}, {METER_SQL}, t as (select *, coalesce(lead(start_bar) over (order by start_bar), 200) as z from mt), bars as (select unnest(range(start_bar, z)) as bar, start_beat + (unnest(range(start_bar, z)) - start_bar) * len as s, len, case when num = 6 then 1.5 else 4.0 / den end as unit from t),
  h as (select b.rec, b.event_id, beat, s, len, unit, row_number() over (partition by b.event_id order by s desc) as k from beats b join bars on bars.s <= b.beat)
  select rec, event_id, round(s + floor((beat - s) / len + 0.5) * len, 6) as to_bar, round(s + floor((beat - s) / unit + 0.5) * unit, 6) as to_beat, round(least(len, round_even((beat - s) / 0.25, 0) * 0.25), 6) as in_bar from h where k = 1""")
def snapped_to_bars(spark, d):
    """Beats moved to the nearest bar line, to the nearest counted beat, and within the bar (halves to even)."""
    recs = notes(spark, d).select("rec").distinct()
    meters = recs.crossJoin(F.broadcast(spark.createDataFrame(METERS, "start_bar int, num int, den int")))  # four rows
    bars = meter.bar_table(meters, ["rec"], 200)
    b = beats(spark, d)
    to_bar = meter.snap_to_bar(b, bars, ["rec"], "beat").withColumnRenamed("snapped", "to_bar")
    both = meter.snap_to_bar(to_bar, bars, ["rec"], "beat", unit=True).withColumnRenamed("snapped", "to_beat")
    own = temporal.asof_join(both, bars.withColumn("at", F.col("start_beat")), ["rec"], "beat", "at", ["bar"], ["start_beat", "num", "den"], clamp=True)
    inside = V.snap_even(F.col("beat") - F.col("start_beat"), 0.25, theory.bar_length(F.col("num"), F.col("den")))
    return own.select("rec", "event_id", F.round("to_bar", 6).alias("to_bar"), F.round("to_beat", 6).alias("to_beat"), F.round(inside, 6).alias("in_bar"))


@query(f"with {NOTES} select rec, event_id, cast(row_number() over (partition by rec order by onset, event_id) - 1 as bigint) as bar from notes")
def one_chord_a_bar(spark, d):
    """Notes in a stable order by their start, one a bar."""
    return meter.one_a_bar(notes(spark, d), ["rec"], ["onset", "event_id"]).select("rec", "event_id", F.col("bar").cast("bigint").alias("bar"))


@query(f"""with {BEATS}, b as (select rec, event_id, cast(floor(beat / 4) as bigint) as bar, beat - floor(beat) as x from beats), g as (select rec, bar, [1, 2, 3, 4, 6, 8][(bar % 6)::int + 1] as divisions from b where bar % 5 <> 0 group by rec, bar)
  select b.rec, b.event_id, b.bar, cast(coalesce(g.divisions, 1) as integer) as divisions, case when b.bar % 3 = 0 then 0.5 else 0.62 end::double as ratio from b left join g on b.rec = g.rec and b.bar = g.bar""")
def grids_of_bars(spark, d):
    """The published grid of each note's bar (none for every fifth: a beat), and its swing (none where the meter is compound, every third bar)."""
    b = beats(spark, d).select("rec", "event_id", F.floor(F.col("beat") / 4).alias("bar"))
    g = b.where("bar % 5 <> 0").select("rec", "bar").distinct().withColumn("divisions", theory.pick([1, 2, 3, 4, 6, 8], (F.col("bar") % 6).cast("int")))
    num = F.when(F.col("bar") % 3 == 0, 6).otherwise(4)
    return meter.grid_at(b, g, ["rec"]).select("rec", "event_id", "bar", "divisions", meter.swing_at(F.lit(0.62), num, F.when(F.col("bar") % 3 == 0, 8).otherwise(4)).alias("ratio"))


@query(f"""with recursive {BEATS}, e as (select rec, cast(floor(beat / 4) as bigint) as bar, div, sum(abs(beat - floor(beat / (1.0::double / div) + 0.5) * (1.0::double / div)) + 0.035 * case when div = 1 then 0 when div in (2, 3) then 1 when div in (4, 6) then 2 else 3 end + case when div % 3 = 0 then 0.015 else 0 end) as cost from beats cross join (select unnest([1, 2, 3, 4, 6, 8]) as div) group by 1, 2, 3),
  em as (select rec, bar, row_number() over (partition by rec order by bar) as i, list(-round(cost, 9) order by div) as em from e group by rec, bar),
  fwd as (select rec, bar, i, em as sc, cast(null as double[]) as prev from em where i = 1
    union all select e.rec, e.bar, e.i, list_transform(range(6), lambda s: greatest(f.sc[s + 1], list_max(f.sc) - 0.25) + e.em[s + 1]), f.sc from fwd f join em e on e.rec = f.rec and e.i = f.i + 1),
  back as (select rec, bar, i, cast(list_position(sc, list_max(sc)) - 1 as bigint) as state, prev from fwd f where i = (select max(i) from em where em.rec = f.rec)
    union all select f.rec, f.bar, f.i, cast(case when b.prev[b.state + 1] >= list_max(b.prev) - 0.25 then b.state else list_position(b.prev, list_max(b.prev)) - 1 end as bigint), f.prev from back b join fwd f on f.rec = b.rec and f.i = b.i - 1)
  select rec, bar, state in (2, 4) as tuplet from back""")
def grid_choices(spark, d):
    """Which bars are on a grid of threes."""
    from tempograph.plans.symbolic_queries import grid_cost_table

    costs = grid_cost_table(spark, d).withColumn("cost", F.round("cost", 9))
    return notation.tuplet_plan(meter.best_grid_path(costs, "rec", "bar"), ["rec"])


@query("""with o as (select o_custkey as rec, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as bar from orders) select rec, o_orderkey, case when rec % 2 = 0 then bar else bar + 1 end as number, bar = 0 and rec % 2 = 0 as implicit from o""")
def measure_numbers(spark, d):
    """Customers with an even number begin with a pickup."""
    w = Window.partitionBy("rec").orderBy("o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("rec"), "o_orderkey").withColumn("bar", (F.row_number().over(w) - 1).cast("bigint"))
    pickup = F.col("rec") % 2 == 0
    return o.select("rec", "o_orderkey", notation.measure_number(F.col("bar"), pickup).alias("number"), ((F.col("bar") == 0) & pickup).alias("implicit"))


@query(f"""with {NOTES}, b as (select rec, event_id, pc, (onset - {ORIGIN}) // {4 * SIX_HOURS} as bar, (onset - {ORIGIN}) % {4 * SIX_HOURS} as off from notes), l as (select rec, bar, string_agg(['c', 'cis', 'd', 'dis', 'e', 'f', 'fis', 'g', 'gis', 'a', 'ais', 'b'][pc + 1] || '4', ' ' order by off, event_id) as line from b group by 1, 2)
  select rec, string_agg('      ' || line || ' |', chr(10) order by bar) as body from l group by rec""")
def lilypond_charts(spark, d):
    """K4, K5: the chord lines of a document for each recording."""
    day = 4 * SIX_HOURS
    n = notes(spark, d).select("rec", F.floor((F.col("onset") - ORIGIN) / day).alias("bar"), F.struct(F.pmod(F.col("onset") - ORIGIN, F.lit(day)).alias("off"), "event_id").alias("offset"), notation.chordmode_token(F.col("pc"), F.lit("MAJOR"), F.lit(None).cast("int"), F.lit(1.0)).alias("token"))
    document = notation.lilypond_chart(n, "rec")
    return document.select("rec", F.regexp_extract("document", r"(?s)\\chordmode \{\n(.*)\n    \}\n    \\bar", 1).alias("body"))


@query("""with l as (select conv_id, turn // 4 as line, string_agg(role, ' ' order by turn) as text, min(turn) as a, max(turn) as z from conversations group by 1, 2), n as (select *, count(*) over (partition by conv_id, text) as n, min(line) over (partition by conv_id, text) as f from l),
  r as (select *, dense_rank() over (partition by conv_id order by f) - 1 as r from n where n >= 2) select conv_id, line, chr(cast(65 + r as integer)) as tag, a as first_bar, z as last_bar from r""")
def repeat_brackets(spark, d):
    """Lines of four turns that recur in a conversation."""
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("bar"), F.col("role").alias("line"))
    return notation.repeat_brackets(c, "conv_id")


# ---------------------------------------------------------------- spelling and harmony


@query(f"""with {NOTES}, f as (select rec, pc, f, row_number() over (partition by event_id order by abs(f - 2), f) as k from (select *, unnest(range(-15, 20)) as f from notes) where ((f * 7) % 12 + 12) % 12 = pc) select rec, round(avg(f) + 1, 6) as centre from f where k = 1 group by rec""")
def fifths_centres(spark, d):
    """A33."""
    n = notes(spark, d).select("rec", theory.fifths_of(F.col("pc"), F.lit(2)).alias("fifths"))
    return rounded(score.fifths_centre(n, ["rec"]), 6, "centre")


SPANS = f"""{NOTES}, chords as (select rec, onset as s, least(end_us, coalesce(lead(onset) over (partition by rec order by onset, event_id), end_us)) as e, pc as root, ['MAJOR', 'MINOR', 'DOMINANT_SEVENTH'][event_id % 3 + 1] as quality from notes where event_id % 2 = 0),
  keys as (select rec, unnest(range(0, 5)) as k from (select distinct rec from notes)), ks as (select rec, {ORIGIN} + k * 518400000000 as s, {ORIGIN} + k * 518400000000 + 432000000000 as e, cast((rec + k * 3) % 13 - 6 as integer) as signature from keys)"""
NEAREST = "(select f from (select unnest(range(-15, 20)) as f) where ((f * 7) % 12 + 12) % 12 = {pc} order by abs(f - ({c})), f limit 1)"


def chords_and_keys(spark, d):
    n = notes(spark, d)
    w = Window.partitionBy("rec").orderBy("onset", "event_id")
    chords = n.where("event_id % 2 = 0").select("rec", F.col("onset").alias("start"), F.least("end_us", F.coalesce(F.lead("onset").over(w), "end_us")).alias("end"), F.col("pc").alias("root"), theory.pick(["MAJOR", "MINOR", "DOMINANT_SEVENTH"], (F.col("event_id") % 3).cast("int")).alias("quality"), "event_id")
    keys = n.select("rec").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("start", ORIGIN + F.col("k").cast("bigint") * 518_400_000_000)
    return chords, keys.select("rec", "start", (F.col("start") + 432_000_000_000).alias("end"), ((F.col("rec") + F.col("k") * 3) % 13 - 6).cast("int").alias("signature"))


TABLE = "spell as (select pc, c, f from (select pc, c, f, row_number() over (partition by pc, c order by abs(f - c), f) as k from (select pc, c, unnest(range(-15, 20)) as f from (select unnest(range(12)) as pc) cross join (select unnest(range(-16, 22)) as c)) where ((f * 7) % 12 + 12) % 12 = pc) where k = 1)"


@query(f"""with {SPANS}, {TABLE}, held as (select n.rec, n.event_id, n.pc, n.onset, c.root, c.quality, k.signature from notes n left join chords c on c.rec = n.rec and c.s <= n.onset and n.onset < c.e left join ks k on k.rec = n.rec and k.s <= n.onset and n.onset < k.e),
  a as (select h.*, coalesce(signature, 0) + 2 as centre, list_contains(list_transform(case quality when 'MINOR' then [0, 3, 7] when 'MAJOR' then [0, 4, 7] else [0, 4, 7, 10] end, lambda x: (root + x) % 12), pc) as tone from held h),
  b as (select a.*, r.f as rf from a left join spell r on r.pc = a.root and r.c = a.centre)
  select rec, event_id, case when tone then t.f else o.f end as fifths from b left join spell t on t.pc = b.pc and t.c = b.rf + 1 left join spell o on o.pc = b.pc and o.c = b.centre""")
def spelled_notes(spark, d):
    """Each note spelled by the chord, else by the key that holds it."""
    chords, keys = chords_and_keys(spark, d)
    return score.spell_notes(notes(spark, d), chords, keys, ["rec"], "onset").select("rec", "event_id", F.col("fifths").cast("bigint").alias("fifths"))


@query(f"""with {SPANS}, {TABLE}, c as (select n.rec, n.event_id, n.onset, n.pc as root, k.signature from notes n left join ks k on k.rec = n.rec and k.s <= n.onset and n.onset < k.e where n.event_id % 2 = 0),
  i as (select *, sum(x) over (partition by rec order by onset, event_id rows unbounded preceding) as run, last_value(signature ignore nulls) over (partition by rec order by onset, event_id rows between unbounded preceding and 1 preceding) as p, first_value(signature ignore nulls) over (partition by rec order by onset, event_id rows between 1 following and unbounded following) as q
    from (select *, case when row_number() over w > 1 and (lag(signature) over w is null) <> (signature is null) then 1 else 0 end as x from c window w as (partition by rec order by onset, event_id))),
  s as (select *, first_value(coalesce(p, q, 0)) over (partition by rec, run order by onset, event_id) as shared from i) select rec, event_id, f as fifths from s join spell on spell.pc = s.root and spell.c = coalesce(signature, shared) + 2""")
def respelled_chords(spark, d):
    """Chords outside all keys share the centre of the key before them."""
    chords, keys = chords_and_keys(spark, d)
    out = score.respell_chords(chords.withColumnRenamed("start", "at").drop("end"), keys, ["rec"], ["at", "event_id"], "at")
    return out.select("rec", "event_id", F.col("fifths").cast("bigint").alias("fifths"))


@query(f"""with {FIT}, r as (select rec, span, round(score, 9) as score, row_number() over (partition by rec, span order by round(score, 9) desc, state) as k from fits), t as (select rec, span, max(score) filter (where k = 1) as win, max(score) filter (where k = 2) as nxt from r group by 1, 2)
  select rec, span, round(0.9 * win * greatest(0, least(1, (win - nxt) / 0.15)), 6) as confidence from t""")
def decided_confidences(spark, d):
    """How sure the best template of each span is, by its lead over the runner-up."""
    e = harmony.template_scores(histograms(spark, d))
    ranked = F.sort_array(F.transform(F.slice("emission", 1, harmony.NO_CHORD_STATE), lambda s: F.round(s, 9)), asc=False)
    two = e.select("rec", "span", F.get(ranked, F.lit(0)).alias("win"), F.get(ranked, F.lit(1)).alias("nxt"))
    return two.select("rec", "span", F.round(score.decided_confidence(F.col("win"), F.col("nxt"), F.col("win")), 6).alias("confidence"))


@query(f"""with {KEYS}, r as (select rec, score, row_number() over (partition by rec order by score desc) as k from keyscore), m as (select rec, max(score) filter (where k = 1) - max(score) filter (where k = 2) as margin, max(score) as best from r group by rec)
  select rec, round(greatest(0, least(1, 0.4 + 0.6 * greatest(0, least(1, margin * 3)) * best)) * greatest(0, least(1, 0.5 + 0.5 * greatest(0, least(1, margin * 3)))), 6) as confidence from m""")
def key_confidences(spark, d):
    """A signature's confidence times a tonic's."""
    ranked = harmony.key_scores(chordlike(spark, d), ["rec"], "root", "quality", "len").groupBy("rec").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    margin, best = F.get("s", F.lit(0)) - F.get("s", F.lit(1)), F.get("s", F.lit(0))
    both = harmony.key_confidence(margin, 0.4, best) * harmony.key_confidence(margin, 0.5, F.lit(1.0))
    return ranked.select("rec", F.round(both, 6).alias("confidence"))


@query(f"with {NOTES} select rec, event_id, midi + 12 as midi, case when event_id % 2 = 0 then event_id % 5 - 2 end as fifths from notes where rec not in (select rec from notes where midi + 12 > 110)")
def octave_transposition(spark, d):
    """Up an octave, where spellings stay; recordings with a note over 110 are left out."""
    n = notes(spark, d).withColumn("fifths", F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 5 - 2))
    return score.transpose_track(n, ["rec"], 12, high=110)[0].select("rec", "event_id", "midi", "fifths")


# ---------------------------------------------------------------- joins, merges and checks


@query(f"""with {NOTES}, a as (select rec, event_id, onset, end_us, case when rec % 2 = 0 or event_id % 50 <> 0 then (onset - {ORIGIN}) / 2.16e10 end as sb, (end_us - {ORIGIN}) / 2.16e10 as eb from notes), ok as (select bool_and(sb is not null) as beats from a)
  select rec, event_id, round(case when beats then sb else onset / 1e6 end, 3) as lo, round(case when beats then eb else end_us / 1e6 end, 3) as hi, false as even from a cross join ok
  union all select rec, event_id, round(sb, 3), round(eb, 3), true from a where rec % 2 = 0""")
def common_axes(spark, d):
    """All recordings, of which some notes have no beats, are compared in seconds; the even ones alone on the beat axis."""
    start, end = ((F.col(c) - ORIGIN) / 2.16e10 for c in ("onset", "end_us"))
    n = notes(spark, d).select("rec", "event_id", (F.col("onset") / 1e6).alias("start_seconds"), (F.col("end_us") / 1e6).alias("end_seconds"), F.when((F.col("rec") % 2 == 0) | (F.col("event_id") % 50 != 0), start).alias("start_beat"), end.alias("end_beat"))
    every, _ = score.with_axis(n, n)
    even, _ = score.with_axis(n.where("rec % 2 = 0"), n.where("rec % 2 = 0"))
    one = lambda df, flag: df.select("rec", "event_id", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"), F.lit(flag).alias("even"))
    return one(every, False).unionByName(one(even, True))


@query("""with p as (select p_partkey, p_brand as rec, p_name as name, case when p_partkey % 4 = 0 then 'BASS' when p_partkey % 4 = 1 then 'DRUMS' else 'OTHER' end as role, p_partkey % 3 = 0 as fresh from part)
  select p_partkey from p where fresh or not exists (select 1 from p n where n.fresh and n.rec = p.rec and n.role = p.role and (p.role <> 'OTHER' or n.name = p.name))""")
def merged_scores(spark, d):
    """Tracks of a brand give way to fresh ones of their role, others to those of their name too."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("rec"), F.col("p_name").alias("name"), F.when(k % 4 == 0, "BASS").when(k % 4 == 1, "DRUMS").otherwise("OTHER").alias("role"))
    return score.merge_scores(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 3 = 0"), ["rec"]).select("p_partkey")


@query("""with p as (select p_partkey, case when p_partkey % 6 = 0 then 'DRUMS' else 'OTHER' end as role, p_size % 4 as notes, p_partkey % 5 <> 0 as quantized from part)
  select p_partkey, case when role = 'DRUMS' then 'percussion has no staff here' when notes = 0 then 'the part has no notes' when not quantized then 'its notes have no place in a bar' end as reason, not (role = 'DRUMS' or notes = 0 or not quantized) as producible from p""")
def producible_parts(spark, d):
    """P14, X22."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.when(k % 6 == 0, "DRUMS").otherwise("OTHER").alias("role"), (F.col("p_size") % 4).alias("notes"), (k % 5 != 0).alias("quantized"))
    return score.producible(p).select("p_partkey", "reason", "producible")


@query(f"with {NOTES}, n as (select *, row_number() over (partition by rec order by onset desc, event_id desc) as k from notes) select rec, event_id % 4 = 0 as odd from n where k = 1 and event_id % 3 = 0")
def dangling_ties(spark, d):
    """Recordings whose last note is tied on (those whose number 3 divides)."""
    n = notes(spark, d).select("rec", F.struct("onset", "event_id").alias("bar"), F.lit(0.0).alias("from_beat"), (F.col("event_id") % 3 == 0).alias("tied"), "event_id")
    last = notation.dangling_ties(n, ["rec"])
    w = Window.partitionBy("rec").orderBy(F.desc("bar"))
    ids = n.withColumn("k", F.row_number().over(w)).where("k = 1").select("rec", (F.col("event_id") % 4 == 0).alias("odd"))
    return last.join(ids, "rec")


@query("""with b as (select o_orderkey, o_totalprice as was from orders where o_orderkey % 4 <> 0), n as (select o_orderkey, o_totalprice + case when o_orderkey % 5 = 0 then 1 else 0 end as now from orders where o_orderkey % 3 <> 0)
  select coalesce(b.o_orderkey, n.o_orderkey) as o_orderkey, was, now from b full join n on b.o_orderkey = n.o_orderkey where now is not null and was is distinct from now""")
def baseline_diffs(spark, d):
    """Prices that differ from a baseline; rows that are gone are skipped, new ones shown."""
    o = table(spark, d, "orders")
    new = o.where("o_orderkey % 3 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0))
    return stats.changed_lines(o.where("o_orderkey % 4 <> 0"), new, "o_orderkey", "o_totalprice")


@query(f"""with {ONSETS}, g as (select rec, t_us - lag(t_us) over (partition by rec order by t_us, event_id) as gap from onsets), s as (select * from (values (0.1, 6), (0.1, 12), (0.5, 6), (0.5, 12)) s(tolerance, hours))
  select tolerance::double as tolerance, hours, count(*) filter (where abs(gap / 3.6e9 - hours) <= tolerance * hours) as hits, count(gap) as n from g cross join s group by 1, 2""")
def parameter_sweep(spark, d):
    """Gaps near a period, for each of four settings, in one scan."""
    settings = spark.createDataFrame([(t, h) for t in (0.1, 0.5) for h in (6, 12)], "tolerance double, hours int")
    gaps = temporal.intervals_between(onsets(spark, d), ["rec"], "at", ["event_id"]).select("gap")
    near = F.abs(F.col("gap") / 3.6e9 - F.col("hours")) <= F.col("tolerance") * F.col("hours")
    return stats.sweep(gaps, settings, lambda df: df.groupBy("tolerance", "hours").agg(F.count_if(near).alias("hits"), F.count("gap").alias("n")))


@query(f"""with {NOTES}, v as (select rec, event_id, list_filter([case when not midi between 20 and 90 then 'range' end, case when end_us - onset > 21600000000 then 'length' end, case when velocity > 400 then 'velocity' end], lambda x: x is not null) as broken from notes) select rec, event_id, array_to_string(broken, ',') as broken from v where len(broken) > 0""")
def broken_rules(spark, d):
    """Notes that break a rule, and which."""
    rules = {"range": F.col("midi").between(20, 90), "length": F.col("end_us") - F.col("onset") <= SIX_HOURS, "velocity": F.col("velocity") <= 400}
    return stats.violations(notes(spark, d), rules).select("rec", "event_id", F.array_join("broken", ",").alias("broken"))


@query(f"""with {ONSETS}, g as (select rec, count(*) as beats, count(*) filter (where event_type <> 'view') as chords from onsets group by rec), c as (select rec, count(*) filter (where x) as changes from (select rec, event_type <> lag(event_type) over (partition by rec order by t_us) as x from onsets) group by rec),
  gp as (select rec, (t_us - lag(t_us) over (partition by rec order by t_us)) / 1e9 as gap from onsets), md as (select rec, median(gap) as m from gp where gap is not null group by rec),
  st as (select g.rec, 60 / coalesce(avg(gap) filter (where gap between m * 0.8 and m * (1 + 0.2)), any_value(m)) as bpm from gp g join md using (rec) where gap is not null group by g.rec)
  select g.rec, beats || ' beats at ' || printf('%.1f', coalesce(bpm, 0)) || ' BPM, ' || chords || ' chords, ' || changes || ' changes' as summary from g join c using (rec) left join st using (rec)""")
def summaries(spark, d):
    """K12."""
    e = onsets(spark, d)
    b = e.select("rec", (F.col("at") / 1e9).alias("seconds"))
    c = e.select("rec", F.col("at").alias("start"), F.col("event_type").alias("symbol"), F.when(F.col("event_type") == "view", "NONE").otherwise("MAJOR").alias("quality"))
    return score.summary(c, b, ["rec"])


@query(f"with {NOTES} select rec, event_id, round((onset - {ORIGIN}) / 2.16e10 + (end_us - onset) / 2.16e10, 6) as end_beat, round(onset / 1e6 + (end_us - onset) / 1e6, 3) as end_seconds from notes where event_type <> 'click'")
def note_offsets(spark, d):
    """Ends of the notes that are no drums (clicks), in either clock."""
    n = notes(spark, d).select("rec", "event_id", F.when(F.col("event_type") == "click", "DRUMS").otherwise("OTHER").alias("role"), ((F.col("onset") - ORIGIN) / 2.16e10).alias("start_beat"), (F.col("onset") / 1e6).alias("start_seconds"), ((F.col("end_us") - F.col("onset")) / 2.16e10).alias("beats"), ((F.col("end_us") - F.col("onset")) / 1e6).alias("seconds"))
    ends = score.with_ends(n)
    return score.playable(ends).select("rec", "event_id", F.round("end_beat", 6).alias("end_beat"), F.round("end_seconds", 3).alias("end_seconds"))
