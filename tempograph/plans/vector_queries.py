"""Queries over vector frames and generated signals."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from tempograph.functions import vectors as V
from tempograph.operators import harmony, signal, stats, temporal
from tempograph.plans.bindings import CHROMA, FRAMES, chroma, frames
from tempograph.plans.event_queries import HOURS

FOUND: dict = {}


def query(sql: str | None = None):
    def add(fn):
        FOUND[fn.__name__] = (fn, sql)
        return fn

    return add


SUM = "list_reduce(list_prepend(0.0::double, {v}), lambda a, x: a + x)"


@query(f"with {CHROMA}, u as (select rec, frame, unnest(chroma) as value, unnest(range(12)) as pc from chroma) select rec, frame, pc, round(value, 6) as value from u")
def chroma_fold(spark, d):
    """A10."""
    c = chroma(spark, d).select("rec", "frame", F.posexplode("chroma").alias("pc", "value"))
    return c.select("rec", "frame", F.col("pc").cast("bigint").alias("pc"), F.round("value", 6).alias("value"))


@query(f"with {CHROMA}, u as (select rec, frame, unnest(list_transform(chroma, lambda v: v / {SUM.format(v='chroma')})) as value, unnest(range(12)) as pc from chroma) select rec, frame, pc, round(value, 6) as value from u")
def l1_normalise(spark, d):
    """A12."""
    c = chroma(spark, d).select("rec", "frame", F.posexplode(V.l1_normalise(F.col("chroma"))).alias("pc", "value"))
    return c.select("rec", "frame", F.col("pc").cast("bigint").alias("pc"), F.round("value", 6).alias("value"))


@query(f"with {CHROMA} select rec, frame, cast(list_position(chroma, list_max(chroma)) - 1 as integer) as strongest from chroma")
def strongest_class(spark, d):
    """A13."""
    return chroma(spark, d).select("rec", "frame", V.argmax_first(F.col("chroma")).alias("strongest"))


@query(f"with {FRAMES}, p as (select rec, frame, vec, lag(vec) over (partition by rec order by frame) as b from frames), f as (select rec, frame, case when b is not null then list_sum(list_transform(range(64), lambda i: greatest(0, vec[i + 1] - b[i + 1]))) end as flux from p) select rec, frame, round(coalesce(flux, lead(flux) over (partition by rec order by frame)), 6) as flux from f")
def rectified_flux(spark, d):
    """The first frame takes the second's."""
    w = Window.partitionBy("rec").orderBy("frame")
    f = frames(spark, d).withColumn("b", F.lag("vec").over(w)).withColumn("flux", F.when(F.col("b").isNotNull(), V.flux(F.col("vec"), F.col("b"))))
    return f.select("rec", "frame", F.round(F.coalesce("flux", F.lead("flux").over(w)), 6).alias("flux"))


COS = "list_sum(list_transform(range(1, {n}), lambda i: {a}[i] * {b}[i])) / (sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x))))"


@query(f"with {CHROMA}, p as (select rec, frame, chroma, lag(chroma) over w as b, lead(frame) over w as nxt from chroma window w as (partition by rec order by frame)) select rec, frame, round(case when b is null or nxt is null then 0 else greatest(0, 1 - {COS.format(n=13, a='chroma', b='b')}) end, 6) as novelty from p")
def vector_novelty(spark, d):
    """W11, M4."""
    w = Window.partitionBy("rec").orderBy("frame")
    c = chroma(spark, d).withColumns({"b": F.lag("chroma").over(w), "nxt": F.lead("frame").over(w)})
    inner = F.greatest(F.lit(0.0), F.nanvl(1 - V.cosine(F.col("chroma"), F.col("b")), F.lit(0.0)))
    return c.select("rec", "frame", F.round(F.when(F.col("b").isNull() | F.col("nxt").isNull(), 0.0).otherwise(inner), 6).alias("novelty"))


@query(f"""with {CHROMA}, n as (select rec, chroma, row_number() over (partition by rec order by frame) - 1 as i from chroma), s as (select rec, i // 4 as span, chroma, i from n union all select rec, i // 4 - 1, chroma, i from n where i % 4 = 0 and i > 0),
  f as (select rec, span, unnest(range(12)) as pc, unnest(chroma) as v from s), g as (select rec, span, pc, sum(v) as v from f group by 1, 2, 3), t as (select rec, span, sum(v) as t from g group by 1, 2)
  select g.rec, g.span, g.pc, round(v / t, 6) as value from g join t on g.rec = t.rec and g.span = t.span""")
def window_vector_fold(spark, d):
    """Frames of each span (the frame on its end too) summed and normalised."""
    w = Window.partitionBy("rec").orderBy("frame")
    n = chroma(spark, d).withColumn("i", F.row_number().over(w) - 1)
    spans = F.when((F.col("i") % 4 == 0) & (F.col("i") > 0), F.array(F.floor(F.col("i") / 4), F.floor(F.col("i") / 4) - 1)).otherwise(F.array(F.floor(F.col("i") / 4)))
    each = n.select("rec", F.explode(spans).alias("span"), "chroma")
    sums = each.groupBy("rec", "span").agg(F.array(*[F.sum(F.get("chroma", F.lit(k))) for k in range(12)]).alias("v"))
    out = sums.select("rec", "span", F.posexplode(V.l1_normalise(F.col("v"))).alias("pc", "value"))
    return out.select("rec", "span", F.col("pc").cast("bigint").alias("pc"), F.round("value", 6).alias("value"))


_TRIADS = "triads as (select * from (values " + ", ".join(f"({s}, {t})" for s, t in harmony.triad_templates()) + ") t(state, tpl))"
SIMS = f"{CHROMA}, {_TRIADS}, sims as (select rec, frame, list_append(list(({COS.format(n=13, a='chroma', b='tpl')})::double order by state), 0.6::double) as sim from chroma cross join triads group by rec, frame)"


@query(f"with {SIMS}, u as (select rec, frame, unnest(sim) as similarity, unnest(range(37)) as state from sims) select rec, frame, state, round(similarity, 6) as similarity from u")
def template_similarity(spark, d):
    """D13."""
    s = harmony.template_similarity(chroma(spark, d), "chroma").select("rec", "frame", F.posexplode("similarity").alias("state", "similarity"))
    return s.select("rec", "frame", F.col("state").cast("bigint").alias("state"), F.round("similarity", 6).alias("similarity"))


VIT = f"""{SIMS}, e as (select rec, frame, row_number() over (partition by rec order by frame) as i, list_transform(sim, lambda s: 50 * ln(greatest(1e-9, s))) as em from sims),
  fwd as (select rec, frame, i, em as sc, cast(null as double[]) as prev, cast(null as bigint) as lead, cast(null as double) as moving from e where i = 1
    union all select e.rec, e.frame, e.i, list_transform(range(37), lambda s: greatest(f.sc[s + 1], list_max(f.sc) - (ln(0.6) - ln(0.4 / 36))) + e.em[s + 1]), f.sc, list_position(f.sc, list_max(f.sc)) - 1, list_max(f.sc) - (ln(0.6) - ln(0.4 / 36)) from fwd f join e on e.rec = f.rec and e.i = f.i + 1),
  back as (select rec, frame, i, cast(list_position(sc, list_max(sc)) - 1 as bigint) as state, prev, lead, moving from fwd f where i = (select max(i) from e where e.rec = f.rec)
    union all select f.rec, f.frame, f.i, cast(case when b.prev[b.state + 1] >= b.moving then b.state else b.lead end as bigint), f.prev, f.lead, f.moving from back b join fwd f on f.rec = b.rec and f.i = b.i - 1)"""


@query(f"with recursive {VIT} select rec, frame, cast(state as integer) as state from back")
def viterbi_labels(spark, d):
    """D1."""
    return harmony.decode_frames(harmony.template_similarity(chroma(spark, d), "chroma"), "rec", "frame", "similarity")


@query(f"""with recursive {VIT}, c as (select b.rec, b.frame, state, chroma, case when row_number() over w > 1 and lag(state) over w <> state then 1 else 0 end as c from back b join chroma k on b.rec = k.rec and b.frame = k.frame window w as (partition by b.rec order by b.frame)),
  r as (select *, sum(c) over (partition by rec order by frame rows unbounded preceding) as run from c), u as (select rec, run, frame, state, unnest(range(12)) as pc, unnest(chroma) as v from r)
  select rec, min(frame) as first_frame, count(*) as n, cast(any_value(state) as integer) as state, pc, round(sum(v), 6) as sum_c from u group by rec, run, pc""")
def run_sums(spark, d):
    """Vector sums over runs of one state."""
    path = harmony.decode_frames(harmony.template_similarity(chroma(spark, d), "chroma"), "rec", "frame", "similarity")
    runs = temporal.islands(path.join(chroma(spark, d), ["rec", "frame"]), ["rec"], ["frame"], "state")
    runs = runs.groupBy("rec", "run").agg(F.min("frame").alias("first_frame"), F.count("*").alias("n"), F.first("state").alias("state"), *(F.sum(F.get("chroma", F.lit(k))).alias(f"c{k}") for k in range(12)))
    each = runs.select("rec", "first_frame", "n", "state", F.posexplode(F.array(*(f"c{k}" for k in range(12)))).alias("pc", "v"))
    return each.select("rec", "first_frame", "n", "state", F.col("pc").cast("bigint").alias("pc"), F.round("v", 6).alias("sum_c"))


PEAKS = f"{FRAMES}, peaks as (select rec, frame, i, vec[i] as m, 0.5 * (vec[i - 1] - vec[i + 1]) / nullif(vec[i - 1] - 2 * vec[i] + vec[i + 1], 0) as o from (select *, unnest(range(2, 64)) as i from (select rec, frame, list_transform(vec, lambda x: abs(x)) as vec from frames)) where vec[i] > vec[i - 1] and vec[i] > vec[i + 1])"


def peak_table(spark, d):
    f = frames(spark, d).select("rec", "frame", F.transform("vec", F.abs).alias("v"))
    spots = f.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(62))))
    a, m, b = (F.get("v", F.col("i") + k) for k in (-1, 0, 1))
    peaks = spots.where((m > a) & (m > b))
    off = F.coalesce(F.try_divide(0.5 * (a - b), a - 2 * m + b), F.lit(0.0))
    return peaks.select("rec", "frame", (F.col("i") + 1).alias("i"), m.alias("m"), F.when(F.abs(off) > 1, 0.0).otherwise(off).alias("o"))


@query(f"with {PEAKS} select rec, frame, cast(i as integer) as i, round(m, 6) as m, round(case when abs(o) > 1 or o is null then 0 else o end, 6) as o from peaks")
def local_peaks(spark, d):
    """W8."""
    return peak_table(spark, d).select("rec", "frame", "i", F.round("m", 6).alias("m"), F.round("o", 6).alias("o"))


@query(f"""with {PEAKS}, p as (select rec, m, i + case when abs(o) > 1 or o is null then 0 else o end as pitch from peaks), b as (select rec, cast(floor((round(pitch - floor(pitch + 0.5), 9) + 0.5) * 40) as bigint) as bin, round(sum(m), 6) as mass from p group by 1, 2),
  r as (select *, row_number() over (partition by rec order by mass desc, bin) as k from b) select rec, bin, mass, round((bin + 0.5) / 40 - 0.5, 6) as tuning from r where k = 1""")
def tuning_histogram(spark, d):
    """A9."""
    p = peak_table(spark, d).withColumn("pitch", F.col("i") + F.col("o"))
    p = p.withColumn("pitch", F.floor(F.col("pitch") + 0.5) + F.round(F.col("pitch") - F.floor(F.col("pitch") + 0.5), 9))
    t = stats.tuning_histogram(p, ["rec"], "pitch", "m")
    return t.select("rec", "bin", F.round("mass", 6).alias("mass"), F.round("tuning", 6).alias("tuning"))


@query(f"""with recursive {FRAMES}, f(rec, frame, i, y) as (select rec, frame, 1, vec[1] from frames union all select f.rec, f.frame, i + 1, y + (1 - 0.45) * (vec[i + 1] - y) from f join frames using (rec, frame) where i < 64),
  fl as (select rec, frame, list(y order by i desc) as v from f group by 1, 2), b(rec, frame, i, y) as (select rec, frame, 1, v[1] from fl union all select b.rec, b.frame, i + 1, y + (1 - 0.45) * (v[i + 1] - y) from b join fl using (rec, frame) where i < 64)
  select rec, frame, cast(64 - i as integer) as pos, round(y, 6) as y from b""")
def lowpass_zero_phase(spark, d):
    """W5."""
    out = frames(spark, d).select("rec", "frame", F.posexplode(signal.low_pass(F.col("vec"), 0.45)).alias("pos", "y"))
    return out.select("rec", "frame", "pos", F.round("y", 6).alias("y"))


@query(f"with {FRAMES} select rec, frame, cast(i as integer) as pos, round(vec[cast(floor(i * 0.5) as integer) + 1] + (i * 0.5 - floor(i * 0.5)) * (coalesce(vec[cast(floor(i * 0.5) as integer) + 2], vec[cast(floor(i * 0.5) as integer) + 1]) - vec[cast(floor(i * 0.5) as integer) + 1]), 6) as y from (select *, unnest(range(128)) as i from frames)")
def resample_linear(spark, d):
    """W7, upwards."""
    out = frames(spark, d).select("rec", "frame", F.posexplode(signal.resample(F.col("vec"), 1, 2)).alias("pos", "y"))
    return out.select("rec", "frame", "pos", F.round("y", 6).alias("y"))




@query(f"""with recursive {HOURS}, z as (select list(n / 10 order by h) as z, min(h) as h0, count(*) as n from hours),
  fwd as (select 0 as t, cast([] as double[]) as score, cast([] as bigint[]) as back from z
    union all select t + 1, list_append(score, v + coalesce(best.g, 0)), list_append(back, cast(coalesce(best.b, -1) as bigint)) from (
      select t, score, back, z.z[t + 1] as v, case when t >= 3 then list_sort(list_transform(range(3, least(12, t) + 1), lambda g: struct_pack(g := score[t - g + 1] - 100 * pow(ln(g / 6.0), 2), o := -g, b := t - g)))[-1] end as best from fwd, z where t < z.n)),
  last as (select score, back from fwd, z where t = z.n),
  path as (select cast(list_position(score, list_max(score)) - 1 as bigint) as t, 0 as i from last union all select back[t + 1], i + 1 from path, last where back[t + 1] >= 0)
  select 1 as rec, cast(max(i) over () - i as bigint) as beat, cast(t + h0 as bigint) as frame from path, z""")
def beat_dp(spark, d):
    """D4 over hourly event counts of each day of the month."""
    from tempograph.plans.event_queries import hourly

    h = hourly(spark, d).withColumn("period", F.lit(6.0)).withColumn("z", F.col("n") / 10)
    return signal.track_beats(h, "rec", "h", "z", "period")


def _nnls_dictionary():
    return signal.note_dictionary(64, 1, 36, range(36, 76, 2), partials=6)


def _activations(spark, d):
    f = frames(spark, d).select("rec", "frame", F.transform("vec", F.abs).alias("v"))
    return signal.activations(f, "v", _nnls_dictionary())


@query()
def nnls_activations(spark, d):
    """Every note's activation in every frame; nnls_conditions holds them against the conditions of a minimum."""
    return _activations(spark, d).select("rec", "frame", F.posexplode("activation").alias("note", "activation"))


@query(f"with {FRAMES} select rec, frame, 21 as notes, true as feasible, true as no_better, true as complementary from frames")
def nnls_conditions(spark, d):
    """The conditions that only the minimum meets, in every frame: activations of 0 or more, slopes of 0 or more, and of each pair one 0."""
    a = _activations(spark, d)
    least = lambda c: F.array_min(c)
    product = F.array_max(F.zip_with("activation", "slope", lambda x, y: F.abs(x * y)))
    return a.select("rec", "frame", F.size("activation").alias("notes"), (least("activation") >= 0).alias("feasible"), (least("slope") >= -1e-6).alias("no_better"), (product <= 1e-6).alias("complementary"))
