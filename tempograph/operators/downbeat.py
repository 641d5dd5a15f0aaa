"""The bar line's phase, from where the harmony changes and where the accents lie."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.functions import vectors as V

# Fixed values of the estimate.
ACCENT, FLOOR, CEILING, MARGIN, CHANGES = 0.05, 0.35, 0.6, 0.1, 3.0


def novelty_at_beats(spans: DataFrame, by: list[str], index: str, vector: str) -> DataFrame:
    """(index, novelty) of each beat between two spans, span i lying between the beats i and i + 1; silence is no change."""
    w = Window.partitionBy(*by).orderBy(index)
    before = F.lag(vector).over(w)
    change = F.greatest(F.lit(0.0), F.nanvl(1 - V.cosine(F.col("__v"), F.col("__b")), F.lit(0.0)))
    silent = (V.l2_norm(F.col("__v")) == 0) | (V.l2_norm(F.col("__b")) == 0)
    each = spans.select(*by, index, F.col(vector).alias("__v"), before.alias("__b")).where("__b is not null")
    return each.select(*by, index, F.when(silent, 0.0).otherwise(change).alias("novelty"))


def downbeat_phase(beats: DataFrame, novelty: DataFrame, by: list[str], index: str, strength: str, per_bar: int = 4) -> DataFrame:
    """(phase, confidence, harmonic) of each key's beats, which count from 0.

    Beats with harmony on both sides are scored by the mean novelty of their phase plus a bounded term of how far its
    onsets stand out; harmony breaks a tie.  The confidence grows with the margin over the second best phase, with the
    share of all novelty that the phase has, and with the number of changes seen.  Without harmony, or with fewer than three beats,
    the accent alone decides.  One aggregation a key; the two evidences meet in it, one row a beat.
    """
    sizes = beats.groupBy(*by).agg(F.max(index).alias("__last"))
    heard = novelty.groupBy(*by).agg(F.count("*").alias("__heard"))
    each = beats.join(novelty, [*by, index], "left").join(sizes, by).join(heard, by, "left")
    harmonic = (F.col("__last") >= 2) & (F.coalesce("__heard", F.lit(0)) > 0)
    inner = F.col(index).between(1, F.col("__last") - 1)
    each = each.withColumn("harmonic", harmonic).where(~harmonic | inner).withColumn("__p", F.pmod(F.col(index), F.lit(per_bar)))
    x, n = F.col(strength), F.coalesce("novelty", F.lit(0.0))
    own = lambda agg, value, p: agg(F.when(F.col("__p") == p, value))
    parts = [
        F.struct(
            F.lit(p).alias("phase"),
            F.coalesce(own(F.avg, n, p), F.lit(0.0)).alias("harmony"),
            (F.coalesce(own(F.avg, x, p), F.avg(x)) - F.avg(x)).alias("accent"),
            F.coalesce(own(F.sum, n, p), F.lit(0.0)).alias("s"),
            F.coalesce(own(F.sum, n * n, p), F.lit(0.0)).alias("q"),
        )
        for p in range(per_bar)
    ]
    sums = each.groupBy(*by).agg(F.first("harmonic").alias("harmonic"), F.array(*parts).alias("__p"))
    score = lambda p: F.when(F.col("harmonic"), p["harmony"] + ACCENT * F.tanh(p["accent"])).otherwise(p["accent"])
    ranked = F.transform("__p", lambda p: F.struct(F.round(score(p), 9).alias("score"), F.when(F.col("harmonic"), F.round(p["harmony"], 9)).alias("tie"), F.negative(p["phase"]).alias("first"), p["harmony"].alias("harmony"), p["s"].alias("s"), p["q"].alias("q")))
    best = sums.withColumn("__best", F.array_max(ranked)).withColumn("phase", F.negative(F.col("__best.first")))
    harmony = F.transform("__p", lambda p: p["harmony"])
    other = F.array_max(F.filter("__p", lambda p: p["phase"] != F.col("phase")).getField("harmony"))
    total = V.total(harmony)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    decided = clamp((F.col("__best.harmony") - other) / MARGIN)
    chance = 1.0 / per_bar
    share = F.when(total > 0, F.col("__best.harmony") / F.when(total > 0, total)).otherwise(chance)
    seen = F.when(F.col("__best.q") > 0, F.col("__best.s") * F.col("__best.s") / F.when(F.col("__best.q") > 0, F.col("__best.q"))).otherwise(0.0)
    agreement = decided * clamp((share - chance) / (1 - chance)) * clamp(seen / CHANGES)
    return best.select(*by, "phase", F.when(F.col("harmonic"), FLOOR + (CEILING - FLOOR) * agreement).otherwise(FLOOR).alias("confidence"), "harmonic")


def comb(series: DataFrame, by: list[str], at: str, value: str, frames: Column, periods: list[int]) -> DataFrame:
    """(period, phase, strength): the period and offset whose comb gathers the most value a tooth, the shortest and first on a tie.

    ``at`` counts frames from 0 to frames - 1; frames without a row are 0.  A comb of period p and offset o is the sum over
    at % p = o, so all combs come from one aggregation, pre-aggregated by each task.
    """
    each = series.withColumn("period", F.explode(F.array(*map(F.lit, periods)))).withColumn("phase", F.pmod(F.col(at), F.col("period")))
    sums = each.groupBy(*by, "period", "phase").agg(F.sum(value).alias("__s"), F.max(frames).alias("__n"))
    strength = F.col("__s") / F.ceil((F.col("__n") - F.col("phase")) / F.col("period"))
    best = sums.groupBy(*by).agg(F.max(F.struct(F.round(strength, 9).alias("strength"), F.negative("period").alias("p"), F.negative("phase").alias("o"))).alias("m"))
    return best.select(*by, F.negative("m.p").alias("period"), F.negative("m.o").alias("phase"), "m.strength")


def one_pole(series: DataFrame, by: list[str], at: str, value: str, pole: float, block: int = 4096, backward: bool = False, out: str = "smooth") -> DataFrame:
    """y(t) = y(t-1) + (1 - pole) (x(t) - y(t-1)) along ``at`` (0, 1, 2, ... of each key), from the first value on; or backward from the last.

    The filter is a chain of affine maps, and a block of frames is one such map too: a block's output without a past, and
    the power of the pole by which its past fades.  Blocks are summed up apart; what reaches a block from before is a short window over
    earlier blocks (beyond which the pole's power is 0 in a double); then each block is filtered with it.  So no task holds
    more than a block of a series, however long that is.
    """
    import numpy as np
    import pyarrow as pa

    keys, kinds = [*by, "__block"], {f.name: f.dataType.simpleString() for f in series.schema.fields}

    def values(table):
        table = table.sort_by([(at, "descending" if backward else "ascending")])
        return table, table.column(value).to_numpy().astype(float)

    def filtered(x, past):
        y = (1 - pole) * x
        y[0] += pole * past
        k = 1
        while k < len(y):
            y[k:] += pole**k * y[:-k].copy()
            k *= 2
        return y

    def summary(key, table):
        _, x = values(table)
        opens = key[-1].as_py() == 0 if not backward else False
        return pa.table([*(pa.array([k.as_py()], k.type) for k in key), pa.array([len(x)], pa.int64()), pa.array([float(filtered(x, x[0] if opens else 0.0)[-1])]), pa.array([float(x[0])])], names=[*keys, "n", "s", "opening"])

    def apply(key, table):
        table, x = values(table)
        return table.select([*by, at]).append_column(out, pa.array(filtered(x, table.column("__past")[0].as_py())))

    blocks = series.select(*by, at, F.col(value).cast("double").alias(value), F.floor(F.col(at) / block).cast("bigint").alias("__block"))
    typed = ", ".join(f"{k} {kinds[k]}" for k in by)
    maps = blocks.groupBy(*keys).applyInArrow(summary, f"{typed}, __block bigint, n bigint, s double, opening double")
    reach = max(1, math.ceil(745 / (block * -math.log(pole)))) if pole > 0 else 1
    order = F.desc("__block") if backward else F.asc("__block")
    w = Window.partitionBy(*by).orderBy(order)
    first = F.row_number().over(w) == 1
    # The first block's own past is its first value, which its summary must hold as well.
    maps = maps.withColumn("s", F.when(first, F.col("s") + F.pow(F.lit(pole), F.col("n")) * F.col("opening")).otherwise(F.col("s"))) if backward else maps
    before = F.collect_list(F.struct("n", "s")).over(w.rowsBetween(-reach, -1))
    past = F.aggregate("__before", F.lit(0.0), lambda y, m: F.pow(F.lit(pole), m["n"]) * y + m["s"])
    maps = maps.withColumns({"__before": before, "__first": first})
    pasts = maps.select(*keys, F.when(F.col("__first"), F.col("opening")).otherwise(past).alias("__past"))
    return blocks.join(pasts, keys).groupBy(*keys).applyInArrow(apply, f"{typed}, {at} {kinds[at]}, {out} double")


def zero_phase(series: DataFrame, by: list[str], at: str, value: str, pole: float, block: int = 4096, stages: int = 1, out: str = "smooth") -> DataFrame:
    """one_pole() forward and then backward, so that nothing moves in time, ``stages`` times."""
    now = series.select(*by, at, value)
    for _ in range(stages):
        now = one_pole(now, by, at, value, pole, block, False, value)
        now = one_pole(now, by, at, value, pole, block, True, value)
    return now.withColumnRenamed(value, out) if out != value else now
