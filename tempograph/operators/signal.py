"""Signals: generators, frames, spectra, filters, beats, non-negative least squares."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE, CHUNK = 22_050, 4096


def tone_chunks(spark: SparkSession, rec: str, frequencies: list[float], seconds: float, rate: int = RATE, chunk: int = CHUNK) -> DataFrame:
    """audio(rec_id, chunk_no, sample_rate, samples): a sum of equal sines (one: amplitude 0.5; more: 0.4 over their number)."""
    n = int(math.floor(seconds * rate + 0.5))
    level = 0.5 if len(frequencies) == 1 else 0.4 / max(1, len(frequencies))
    i = lambda k: k / F.lit(float(rate))
    value = lambda k: sum((level * F.sin(2 * math.pi * f * i(k)) for f in frequencies), F.lit(0.0))
    chunks = spark.range(-(-n // chunk)).withColumn("from_i", F.col("id") * chunk)
    spots = F.sequence("from_i", F.least(F.lit(n), F.col("from_i") + chunk) - 1)
    return chunks.select(F.lit(rec).alias("rec_id"), F.col("id").cast("int").alias("chunk_no"), F.lit(rate).alias("sample_rate"), F.transform(spots, value).alias("samples"))


def click_chunks(spark: SparkSession, rec: str, bpm: float, seconds: float, rate: int = RATE, chunk: int = CHUNK) -> DataFrame:
    """A decaying 1 kHz burst of a hundredth of a second on each beat."""
    n, length, period = int(math.floor(seconds * rate + 0.5)), rate // 100, 60.0 / bpm * rate

    def value(k):
        since = k - F.floor(F.floor(k / period) * period + 0.5)
        inside = (since >= 0) & (since < length)
        return F.when(inside, 0.8 * F.exp(-8.0 * since / length) * F.sin(2 * math.pi * 1000 * since / rate)).otherwise(0.0)

    chunks = spark.range(-(-n // chunk)).withColumn("from_i", F.col("id") * chunk)
    spots = F.sequence("from_i", F.least(F.lit(n), F.col("from_i") + chunk) - 1)
    return chunks.select(F.lit(rec).alias("rec_id"), F.col("id").cast("int").alias("chunk_no"), F.lit(rate).alias("sample_rate"), F.transform(spots, value).alias("samples"))


def silence_chunks(spark: SparkSession, rec: str, seconds: float, rate: int = RATE, chunk: int = CHUNK) -> DataFrame:
    return tone_chunks(spark, rec, [], seconds, rate, chunk)


def band(df: DataFrame, spectrum: str, hz_a_bin: float, low: float, high: float) -> DataFrame:
    """Spectra cut to the bins from ``low`` to ``high`` hertz, both included."""
    first, last = math.ceil(low / hz_a_bin), math.floor(high / hz_a_bin)
    return df.withColumn(spectrum, F.slice(spectrum, first + 1, last - first + 1))


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def mel_bands(rate: int, window: int, bands: int = 40, low: float = 30.0, high: float = 8000.0) -> list[tuple[int, int]]:
    """M3: first and end bin of rectangular bands, evenly spaced in mel."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(low) + (mel(high) - mel(low)) * k / bands) / 2595) - 1) for k in range(bands + 1)]
    bins = [min(window // 2, int(round(e * window / rate))) for e in edges]
    return [(a, max(a + 1, b)) for a, b in zip(bins, bins[1:])]


def band_decibels(df: DataFrame, rate: int, window: int, mags: str = "mags", out: str = "bands") -> DataFrame:
    """M3: decibels of the magnitudes summed over each mel band."""
    level = [20.0 * F.log10(F.greatest(F.aggregate(F.slice(mags, a + 1, b - a), F.lit(0.0), lambda s, x: s + x), F.lit(1e-10))) for a, b in mel_bands(rate, window)]
    return df.withColumn(out, F.array(*level))


def low_pass(x, pole: float):
    """One-pole smoothing forward and then backward, as a column expression over an array."""

    def once(v):
        start = F.struct(F.get(v, F.lit(0)).alias("y"), F.array().cast("array<double>").alias("out"))
        return F.aggregate(v, start, lambda a, s: F.struct((a["y"] + (1 - pole) * (s - a["y"])).alias("y"), F.concat(a["out"], F.array(a["y"] + (1 - pole) * (s - a["y"]))).alias("out")), lambda a: a["out"])

    return F.reverse(once(F.reverse(once(x))))


def low_passed(x: np.ndarray, pole: float) -> np.ndarray:
    """low_pass() of rows of one length, with the same operations in the same order."""
    for _ in range(2):
        if len(x) < 16:  # a step along few rows costs more than the steps along each
            x = np.array([list(accumulate(row[1:], lambda y, s: y + (1 - pole) * (s - y), initial=row[0] + (1 - pole) * (row[0] - row[0]))) for row in x.tolist()])
        else:
            columns, y = np.ascontiguousarray(x.T), x[:, 0]
            for k, s in enumerate(columns):
                columns[k] = y = y + (1 - pole) * (s - y)
            x = columns.T
        x = x[:, ::-1]
    return x


def resampled(x: np.ndarray, from_rate: int, to_rate: int) -> np.ndarray:
    """resample() downwards of rows of one length."""
    n = x.shape[1]
    count = math.floor(n * (to_rate / from_rate))
    if not count:
        return np.empty((len(x), 0))
    source = low_passed(x, math.exp(-2 * math.pi * 0.45 * to_rate / from_rate))
    p = np.arange(count) * (from_rate / to_rate)
    low = np.floor(p).astype(np.int64)
    a = source[:, low]
    return a + (p - low) * (source[:, np.minimum(low + 1, n - 1)] - a)


def resample(x, from_rate: int, to_rate: int):
    """Linear interpolation at the new rate, smoothed first when going down."""
    if to_rate < from_rate:
        # An expression would smooth the whole array again for each sample that it takes from it.
        @F.arrow_udf("array<double>")
        def down(batch: pa.Array) -> pa.Array:
            plain = lambda v: v.to_numpy(zero_copy_only=False)
            size = plain(pc.list_value_length(batch).fill_null(0)).astype(np.int64)
            count = np.floor(size * (to_rate / from_rate)).astype(np.int64)
            flat, first, out = batch.flatten(), np.cumsum(size) - size, np.append(0, np.cumsum(count))
            samples, holes = plain(flat).astype(float), plain(flat.is_null())
            values, gone = np.empty(out[-1]), np.zeros(out[-1], bool)
            for n in np.unique(size[count > 0]).tolist():
                rows = np.flatnonzero(size == n)
                at = first[rows, None] + np.arange(n)
                to = out[rows, None] + np.arange(count[rows[0]])
                values[to] = resampled(samples[at], from_rate, to_rate)
                gone[to] = holes[at].any(axis=1)[:, None]  # smoothing forward and backward carries a null to all samples
            return pa.ListArray.from_arrays(pa.array(out, pa.int32()), pa.array(values, mask=gone))

        return down(x)

    count = F.floor(F.size(x) * (to_rate / from_rate)).cast("int")

    def at(i):
        p = i * (from_rate / to_rate)
        low = F.floor(p).cast("int")
        a = F.get(x, low)
        return a + (p - low) * (F.coalesce(F.get(x, low + 1), a) - a)

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.array().cast("array<double>"))


def beat_path(strength: np.ndarray, period: float, tightness: float = 100.0) -> np.ndarray:
    """Frames of the best beat sequence: strength plus the best predecessor's score less the cost of an odd gap."""
    n = len(strength)
    low, high = max(1, int(math.floor(0.5 * period))), max(1, int(math.ceil(2 * period)))
    score, back = np.array(strength, float), np.full(n, -1)
    gaps = np.arange(low, high + 1)
    cost = tightness * np.log(gaps / period) ** 2
    for t in range(low, n):
        reach = gaps[gaps <= t]
        got = score[t - reach] - cost[: len(reach)]
        k = int(got.argmax())
        score[t] = strength[t] + got[k]
        back[t] = t - reach[k]
    t, path = int(score.argmax()) if n else -1, []
    while t >= 0:
        path.append(t)
        t = back[t]
    return np.array(path[::-1], np.int64)


def track_beats(df: DataFrame, by: str, frame: str, strength: str, period: str) -> DataFrame:
    """(by, beat, frame) of each recording, one recording a group."""
    kind = df.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(frame, kind="stable")
        path = beat_path(pdf[strength].to_numpy(), float(pdf[period].iloc[0]))
        return pd.DataFrame({by: pdf[by].iloc[0], "beat": np.arange(len(path)), "frame": pdf[frame].to_numpy()[path]})

    return df.groupBy(by).applyInPandas(run, f"{by} {kind}, beat bigint, frame bigint")


def stitched(beats: list[np.ndarray], starts: list[float], step: float, period: float) -> np.ndarray:
    """Beats of half-overlapping windows as one sequence: those before the next window begins, and over 0.4 periods after the last taken."""
    out: list[float] = []
    for k, (found, start) in enumerate(zip(beats, starts)):
        for b in found:
            if (k == len(beats) - 1 or b < start + step) and (not out or b > out[-1] + 0.4 * period):
                out.append(float(b))
    return np.array(out)


def nnls(gram: np.ndarray, projected: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """The non-negative minimiser of x'Gx/2 - p'x by active sets (Lawson and Hanson), with a small ridge."""
    n = len(projected)
    g = gram + np.eye(n) * (1e-10 * np.trace(gram) / max(1, n))
    x, inside = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * n):
        slope = projected - g @ x
        slope[inside] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= tolerance:
            break
        inside[j] = True
        while True:
            at = np.flatnonzero(inside)
            z = np.linalg.solve(g[np.ix_(at, at)], projected[at])
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            step = np.min(x[at][bad] / (x[at][bad] - z[bad]))
            x[at] += step * (z - x[at])
            inside[at[bad & (x[at] <= tolerance)]] = False
            x[~inside] = 0
            if not inside.any():
                break
    return x


def nnls_batch(gram: np.ndarray, projected: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """The non-negative minimisers of x'Gx/2 - p'x for all columns p of ``projected``, by block principal pivoting.

    Every column keeps the set of its active notes.  Columns of equal sets are solved together, with one factor; then each
    column moves the notes that break a condition (a negative activation, or a slope that would gain) to the other side, all
    of them as long as that leaves fewer broken, else only the last one, which can't go round in circles.
    """
    n, many = projected.shape
    g = gram + np.eye(n) * (1e-10 * np.trace(gram) / max(1, n))
    active, x, slope = np.zeros((n, many), bool), np.zeros((n, many)), -projected
    fewest, tries = np.full(many, n + 1), np.full(many, 3)
    scale = tolerance * np.maximum(1.0, np.abs(projected).max(axis=0)) if many else np.ones(0)
    for _ in range(50 * n):
        broken = (active & (x < -scale)) | (~active & (slope < -scale))
        count = broken.sum(axis=0)
        todo = np.flatnonzero(count)
        if not len(todo):
            break
        better = count[todo] < fewest[todo]
        fewest[todo] = np.minimum(fewest[todo], count[todo])
        tries[todo] = np.where(better, 3, tries[todo] - 1)
        one = todo[tries[todo] < 0]
        last = n - 1 - broken[::-1, one].argmax(axis=0)
        broken[:, one] = False
        broken[last, one] = True
        active[:, todo] ^= broken[:, todo]
        sets, group = np.unique(np.packbits(active[:, todo], axis=0), axis=1, return_inverse=True)
        for k in range(sets.shape[1]):
            own = todo[group.ravel() == k]
            at = active[:, own[0]]
            x[:, own] = 0
            if at.any():
                x[np.ix_(at, own)] = np.linalg.solve(g[np.ix_(at, at)], projected[np.ix_(at, own)])
            slope[:, own] = np.where(at[:, None], 0.0, g[:, at] @ x[np.ix_(at, own)] - projected[:, own])
    return np.maximum(x, 0)


def note_dictionary(bins: int, per_semitone: int, lowest: int, notes: range, partials: int = 12, decay: float = 0.5, width: float = 1.0) -> np.ndarray:
    """Unit columns of harmonic spectra on a log-frequency axis, and a flat one for the background."""
    axis = lowest + np.arange(bins) / per_semitone
    columns = []
    for note in notes:
        column = np.zeros(bins)
        for p in range(1, partials + 1):
            d = np.abs(axis - (note + 12 * math.log2(p))) / width
            column += decay ** (p - 1) * np.where(d < 1, 0.5 * (1 + np.cos(np.pi * d)), 0)
        columns.append(column / max(1e-12, np.linalg.norm(column)))
    return np.stack([*columns, np.full(bins, bins**-0.5)], axis=1)


def activations(df: DataFrame, spectrum: str, dictionary: np.ndarray, out: str = "activation") -> DataFrame:
    """``out``, the non-negative note activations of each spectrum, a batch of rows at once, and ``slope``, the gradient at them (0 or more)."""
    gram = dictionary.T @ dictionary

    @F.pandas_udf(f"{out} array<double>, slope array<double>")
    def solve(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({out: [], "slope": []})
        projected = dictionary.T @ np.stack(x.to_numpy()).astype(float).T
        found = nnls_batch(gram, projected)
        return pd.DataFrame({out: list(found.T), "slope": list((gram @ found - projected).T)})

    return df.withColumn("__a", solve(spectrum)).select("*", F.col(f"__a.{out}").alias(out), "__a.slope").drop("__a")


def tones(df: DataFrame, by: list[str], hertz: str, seconds: float, rate: int = RATE, chunk: int = CHUNK) -> DataFrame:
    """Audio (key, chunk_no, sample_rate, samples) of a sine for each row, at half of full scale."""
    n = int(math.floor(seconds * rate + 0.5))
    each = df.select(*by, F.col(hertz).alias("__f"), F.explode(F.sequence(F.lit(0), F.lit(-(-n // chunk) - 1))).alias("chunk_no"))
    spots = F.sequence(F.col("chunk_no") * chunk, F.least(F.lit(n), (F.col("chunk_no") + 1) * chunk) - 1)
    return each.select(*by, "chunk_no", F.lit(rate).alias("sample_rate"), F.transform(spots, lambda k: 0.5 * F.sin(2 * math.pi * F.col("__f") * (k / F.lit(float(rate))))).alias("samples"))


def clicks(df: DataFrame, by: list[str], bpm: str, seconds: float, rate: int = RATE, chunk: int = CHUNK) -> DataFrame:
    """The same with a decaying 1 kHz burst of a hundredth of a second on each beat of the row's tempo."""
    n, length = int(math.floor(seconds * rate + 0.5)), rate // 100
    each = df.select(*by, (F.lit(60.0) / F.col(bpm) * rate).alias("__p"), F.explode(F.sequence(F.lit(0), F.lit(-(-n // chunk) - 1))).alias("chunk_no"))
    spots = F.sequence(F.col("chunk_no") * chunk, F.least(F.lit(n), (F.col("chunk_no") + 1) * chunk) - 1)

    def value(k):
        since = k - F.floor(F.floor(k / F.col("__p")) * F.col("__p") + 0.5)
        return F.when((since >= 0) & (since < length), 0.8 * F.exp(-8.0 * since / length) * F.sin(2 * math.pi * 1000 * since / rate)).otherwise(0.0)

    return each.select(*by, "chunk_no", F.lit(rate).alias("sample_rate"), F.transform(spots, value).alias("samples"))


def click_chord_chunks(spark: SparkSession, rec: str, bpm: float, seconds: float, chords: list[list[float]], beats_per_chord: int, rate: int = RATE, chunk: int = CHUNK) -> DataFrame:
    """A click track with a decaying chord on each beat, the chords in turn."""
    clicks = click_chunks(spark, rec, bpm, seconds, rate, chunk).select("rec_id", "chunk_no", "sample_rate", F.col("samples").alias("__click"))
    period = 60.0 / bpm * rate
    spots = F.sequence(F.col("chunk_no").cast("bigint") * chunk, F.col("chunk_no").cast("bigint") * chunk + F.size("__click") - 1)

    def value(k):
        beat = F.floor(k / period)
        into = (k - beat * period) / period
        level = 0.7 + 0.3 * F.exp(-3.0 * into)
        out = F.lit(0.0)
        for i, chord in enumerate(chords):
            here = F.pmod(F.floor(beat / beats_per_chord), F.lit(len(chords))) == i
            tones = sum((0.6 / len(chord) * F.sin(2 * math.pi * f * k / F.lit(float(rate))) for f in chord), F.lit(0.0))
            out = F.when(here, tones * level).otherwise(out)
        return out

    return clicks.select("rec_id", "chunk_no", "sample_rate", F.zip_with("__click", F.transform(spots, value), lambda a, b: a + b).alias("samples"))


def anti_alias(x, pole: float = 0.45, stages: int = 2):
    """low_pass() twice over each maximal run of finite values; the others stay as they are."""

    def is_finite(v):
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))

    empty = F.array().cast("array<struct<ok:boolean,vs:array<double>>>")

    def step(acc, v):
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & F.coalesce(last["ok"] & is_finite(v), F.lit(False))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["ok"].alias("ok"), F.concat(last["vs"], F.array(v)).alias("vs"))))
        fresh = F.concat(acc, F.array(F.struct(is_finite(v).alias("ok"), F.array(v).alias("vs"))))
        return F.when(joins, grown).otherwise(fresh)

    def smooth(vs):
        for _ in range(stages):
            vs = low_pass(vs, pole)
        return vs

    runs = F.aggregate(x, empty, step)
    return F.flatten(F.transform(runs, lambda r: F.when(r["ok"], smooth(r["vs"])).otherwise(r["vs"])))


def tempo_in(strength: np.ndarray, frame_rate: float, start: float = 0.0, end: float | None = None, low: float = 40.0, high: float = 240.0) -> float:
    """The tempo of a stretch of an onset envelope; of all of it where the stretch has under 8 frames."""
    part = strength[int(start * frame_rate) : None if end is None else int(math.ceil(end * frame_rate))]
    part = strength if len(part) < 8 else part
    if not len(part):
        return 120.0
    x = part - part.mean()
    n = len(x)
    acf = np.correlate(x, x, "full")[n - 1 :] / n
    bpm = np.arange(low, high + 0.25, 0.25)
    lag = 60.0 * frame_rate / bpm
    got = np.interp(lag, np.arange(n), acf, right=0.0) * np.exp(-0.5 * (np.log2(bpm / 120) / 1.4) ** 2)
    return float(bpm[int(got.argmax())])


def comb_phase(strength: np.ndarray, period: float) -> float:
    """The offset under a period whose comb gathers the most strength; the first on a tie."""
    offsets = np.arange(int(math.ceil(period)))
    sums = [strength[np.round(np.arange(o, len(strength), period)).astype(int).clip(max=len(strength) - 1)].mean() if len(strength) else 0.0 for o in offsets]
    return float(offsets[int(np.argmax(sums))]) if len(offsets) else 0.0


def tempi_of_windows(df: DataFrame, by: str, frame: str, strength: str, frame_rate: float, seconds: float = 25.0) -> DataFrame:
    """Tempo and beats of half-overlapping windows, stitched; one recording a group."""
    kind = df.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(frame, kind="stable")[strength].to_numpy()
        length = len(x) / frame_rate
        step = seconds / 2
        starts = [k * step for k in range(max(1, int(math.ceil((length - seconds) / step)) + 1))]
        found, bpm = [], 120.0
        for s in starts:
            bpm = tempo_in(x, frame_rate, s, s + seconds)
            part = x[int(s * frame_rate) : int((s + seconds) * frame_rate)]
            found.append(s + beat_path(part, 60 * frame_rate / bpm) / frame_rate if len(part) else np.empty(0))
        beats = stitched(found, starts, step, 60 / bpm)
        return pd.DataFrame({by: pdf[by].iloc[0], "beat": np.arange(len(beats)), "seconds": beats})

    return df.groupBy(by).applyInPandas(run, f"{by} {kind}, beat bigint, seconds double")
