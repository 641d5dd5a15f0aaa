"""From audio to chords: register chroma by non-negative least squares, beats, beat-wise chroma, decoded chords."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempograph.functions import theory
from tempograph.functions import vectors as V
from tempograph.operators import downbeat, harmony, score, signal

# Fixed values of the note model: grid and notes as MIDI numbers, bins a semitone, partials and their decay, widths in FFT bins.
LOWEST, HIGHEST_BIN, HIGHEST_NOTE, BINS = 21, 108, 96, 3
PARTIALS, DECAY, PARTIAL_WIDTH, WHITENING, FLOOR = 12, 0.5, 2.5, 6, 1e-3
CROSSFADE, ROLL_OFF = (45, 57), 84
WINDOW_SECONDS, HOPS_A_WINDOW, ONSET_WINDOW, ONSET_HOP = 0.37, 8, 1024, 128


def bumps(centre: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Raised cosines of the given half widths about centres on the log-frequency grid, (bins, centres), each summing to one (or empty)."""
    grid = np.arange((HIGHEST_BIN - LOWEST) * BINS + 1)
    far = np.abs(grid[:, None] - centre) / half
    shape = np.where(far < 1, 0.5 * (1 + np.cos(np.pi * far)), 0.0)
    total = shape.sum(axis=0)
    return shape / np.where(total > 0, total, 1)


def fft_bins_wide(place: np.ndarray, rate: int, window: int, tuning: float) -> np.ndarray:
    """Width of an FFT bin at a place of the grid, in grid bins."""
    hz = 440 * 2 ** ((LOWEST + place / BINS + tuning - 69) / 12)
    return rate / window * BINS * 12 / (hz * np.log(2))


@lru_cache(maxsize=8)
def note_model(rate: int, window: int, tuning: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spectrum to grid, neighbourhood weights, note spectra (and a flat one), and notes to treble and bass classes."""
    hz = np.arange(1, window // 2 + 1) * rate / window
    place = BINS * (69 + 12 * np.log2(hz / 440) - tuning - LOWEST)
    to_grid = np.zeros(((HIGHEST_BIN - LOWEST) * BINS + 1, window // 2 + 1))
    to_grid[:, 1:] = bumps(place, np.maximum(1, fft_bins_wide(place, rate, window, tuning) / 2))
    size = len(to_grid)
    near = np.zeros((size, size))
    half = WHITENING * BINS
    for k, w in zip(range(-half, half + 1), np.hamming(2 * half + 1)):
        near += w * np.eye(size, k=k)
    notes = np.arange(LOWEST, HIGHEST_NOTE + 1)
    spectra = np.zeros((size, len(notes)))
    for p in range(1, PARTIALS + 1):
        at = BINS * (notes - LOWEST + 12 * np.log2(p))
        inside = at <= size - 1
        spectra[:, inside] += DECAY ** (p - 1) * bumps(at[inside], np.maximum(1, PARTIAL_WIDTH * fft_bins_wide(at[inside], rate, window, tuning)))
    spectra /= np.linalg.norm(spectra, axis=0)
    rise = 0.5 - 0.5 * np.cos(np.pi * np.clip((notes - CROSSFADE[0]) / (CROSSFADE[1] - CROSSFADE[0]), 0, 1))
    fall = 0.5 - 0.5 * np.cos(np.pi * np.clip((notes - ROLL_OFF) / (HIGHEST_NOTE - ROLL_OFF), 0, 1))
    classes = (notes[:, None] % 12 == np.arange(12)).astype(float)
    registers = np.hstack((classes * (rise * (1 - fall))[:, None], classes * (1 - rise)[:, None]))
    return to_grid, near, np.hstack((spectra, np.full((size, 1), size**-0.5))), registers


def register_chroma(magnitudes: np.ndarray, rate: int, window: int, tuning: float = 0.0) -> np.ndarray:
    """(frames, 24): treble and bass chroma of magnitude spectra (frames, bins): whitened on the log-frequency grid, then explained by notes."""
    to_grid, near, spectra, registers = note_model(rate, window, tuning)
    grid = magnitudes @ to_grid.T
    weight = near.sum(axis=0)
    mean = grid @ near / weight
    spread = np.sqrt(np.maximum(0, grid**2 @ near / weight - mean**2))
    floor = FLOOR * grid.mean(axis=1, keepdims=True)
    white = np.where(floor > 0, np.maximum(0, grid - mean) / np.maximum(np.maximum(spread, floor), 1e-300), 0)
    gram = spectra.T @ spectra
    found = signal.nnls_batch(gram, spectra.T @ white.T).T
    return found[:, :-1] @ registers


def spectra(audio: DataFrame, window: int, hop: int, longest: int, reduce) -> DataFrame:
    """(rec_id, frame, value): ``reduce`` of the magnitude spectra (frames, bins) of each chunk's frames.

    A chunk gets the chunks after it that its frames reach into (``longest`` is the shortest whole chunk's length), so
    frames are made chunk by chunk and no recording is ever held whole.
    """
    w = Window.partitionBy("rec_id").orderBy("chunk_no")
    before = F.coalesce(F.sum(F.size("samples")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    none = F.array().cast(audio.schema["samples"].dataType)
    ahead = [F.coalesce(F.lead("samples", k).over(w), none) for k in range(1, -(-(window - 1) // longest) + 1)]
    ready = audio.select("rec_id", before.alias("at"), F.size("samples").alias("own"), F.concat("samples", *ahead).alias("samples"))

    def run(batches):
        for pdf in batches:
            for rec, at, own, samples in zip(pdf["rec_id"], pdf["at"], pdf["own"], pdf["samples"]):
                first = -(-at // hop)
                last = (at + min(own - 1, len(samples) - window)) // hop
                for f in range(first, last + 1, 64):
                    many = min(64, last + 1 - f)
                    cut = np.asarray(samples, float)[f * hop - at : (f + many - 1) * hop - at + window]
                    frames = np.lib.stride_tricks.sliding_window_view(cut, window)[::hop]
                    value = reduce(np.abs(np.fft.rfft(frames * signal.hann(window), axis=1)))
                    yield pd.DataFrame({"rec_id": rec, "frame": np.arange(f, f + many), "value": list(value)})

    return ready.mapInPandas(run, "rec_id string, frame bigint, value array<double>")


def window_size(rate: int) -> int:
    """M18."""
    return 1 << int(np.ceil(np.log2(max(1.0, rate * WINDOW_SECONDS))))


def note_chroma(audio: DataFrame, rate: int, chunk: int, tuning: float = 0.0) -> DataFrame:
    """(rec_id, frame, treble, bass) of audio chunks of one rate."""
    window = window_size(rate)
    both = spectra(audio, window, window // HOPS_A_WINDOW, chunk, lambda m: register_chroma(m, rate, window, tuning))
    return both.select("rec_id", "frame", F.slice("value", 1, 12).alias("treble"), F.slice("value", 13, 12).alias("bass"))


def smoothed(x: np.ndarray, pole: float = 0.45, stages: int = 2) -> np.ndarray:
    """Each column smoothed forward and then backward, so that nothing moves in time."""
    for _ in range(2 * stages):
        y = (1 - pole) * x
        y[0] = x[0]
        k = 1
        while k < len(y) and pole**k > 0:  # sums over 1, 2, 4, ... frames back, all bands at once
            y[k:] += pole**k * y[:-k].copy()
            k *= 2
        x = y[::-1]
    return x


def envelope(bands: np.ndarray, frame_rate: float) -> np.ndarray:
    """Onset strength of mel-band decibels (frames, bands): rises summed, less their mean over a second, normalised."""
    if len(bands) < 2:
        return np.zeros(len(bands))
    rise = np.maximum(0, np.diff(smoothed(bands), axis=0)).sum(axis=1)
    rise = np.append(rise[:1], rise)
    half = max(1, int(frame_rate + 0.5) // 2)
    upto, at = np.append(0, np.cumsum(rise)), np.arange(len(rise))
    low, high = np.maximum(0, at - half), np.minimum(len(rise), at + half + 1)
    rise = np.maximum(0, rise - (upto[high] - upto[low]) / (high - low))
    spread = rise.std()
    return (rise - rise.mean()) / spread if spread >= 1e-12 else np.zeros(len(rise))


def onset_strength(audio: DataFrame, rate: int, chunk: int) -> DataFrame:
    """(rec_id, frame, strength).  Bands are made chunk by chunk; their envelope, 40 numbers a frame, runs along a recording."""
    edges = signal.mel_bands(rate, ONSET_WINDOW)
    level = lambda m: 20 * np.log10(np.maximum(np.stack([m[:, a:b].sum(axis=1) for a, b in edges], axis=1), 1e-10))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        return pd.DataFrame({"rec_id": pdf["rec_id"], "frame": pdf["frame"], "strength": envelope(np.stack(pdf["value"].to_numpy()), rate / ONSET_HOP)})

    return spectra(audio, ONSET_WINDOW, ONSET_HOP, chunk, level).groupBy("rec_id").applyInPandas(run, "rec_id string, frame bigint, strength double")


def beat_chroma(frames: DataFrame, beats: DataFrame, vector: str, frame_rate: float) -> DataFrame:
    """(rec_id, beat, vector): frames from each beat to the next (the frame on either end too) summed and normalised.

    The registers are to be added up before this, not after (D12): each would get an equal share of every beat.
    """
    w = Window.partitionBy("rec_id").orderBy("beat")
    spans = beats.select("rec_id", "beat", F.floor(F.col("seconds") * frame_rate).alias("a"), F.ceil(F.lead("seconds").over(w) * frame_rate).alias("z")).where("z > a")
    each = spans.select("rec_id", "beat", F.explode(F.sequence("a", F.col("z") - 1)).alias("frame")).join(frames.select("rec_id", "frame", vector), ["rec_id", "frame"])
    sums = each.groupBy("rec_id", "beat").agg(F.array(*[F.sum(F.get(vector, F.lit(k))) for k in range(12)]).alias(vector))
    return sums.withColumn(vector, V.l1_normalise(F.col(vector)))


def downbeats(beats: DataFrame, chroma: DataFrame, strength: DataFrame, vector: str, rate: int, per_bar: int = 4) -> DataFrame:
    """The beats with ``position`` in the bar, ``downbeat`` and the phase's ``confidence``: chroma novelty at beats and onsets, in one score.

    chroma: (rec_id, beat, vector), a span from each beat to the next; strength: (rec_id, frame, strength).
    """
    at = beats.select("rec_id", "beat", F.floor(F.col("seconds") * rate / ONSET_HOP + 0.5).alias("frame")).join(strength, ["rec_id", "frame"], "left")
    heard = at.select("rec_id", "beat", F.coalesce("strength", F.lit(0.0)).alias("strength"))
    phase = downbeat.downbeat_phase(heard, downbeat.novelty_at_beats(chroma, ["rec_id"], "beat", vector), ["rec_id"], "beat", "strength", per_bar)
    out = beats.join(phase, "rec_id").withColumn("position", F.pmod(F.col("beat") - F.col("phase"), F.lit(per_bar)).cast("int"))
    return out.select("rec_id", "beat", "seconds", "position", (F.col("position") == 0).alias("downbeat"), "confidence")


def audio_downbeats(audio: DataFrame, rate: int, chunk: int = signal.CHUNK) -> DataFrame:
    """The chain up to beats and bar lines: (rec_id, beat, seconds, position, downbeat, confidence)."""
    strength = onset_strength(audio, rate, chunk)
    beats = signal.tempi_of_windows(strength, "rec_id", "frame", "strength", rate / ONSET_HOP)
    registers = note_chroma(audio, rate, chunk).withColumn("combined", V.vector_sum(F.col("treble"), F.col("bass")))
    frame_rate = rate / (window_size(rate) // HOPS_A_WINDOW)
    return downbeats(beats, beat_chroma(registers, beats, "combined", frame_rate), strength, "combined", rate)


def audio_chords(audio: DataFrame, rate: int, chunk: int = signal.CHUNK) -> DataFrame:
    """The chain: (rec_id, first_beat, n, start_seconds, end_seconds, root, quality, symbol, confidence) of audio chunks (rec_id, chunk_no, samples).

    ``chunk`` is the length of a whole chunk.  Spectra and chroma are made chunk by chunk; a recording's onset strengths
    and its beats' chroma, which are small, are sequences, and each is one group.
    """
    beats = signal.tempi_of_windows(onset_strength(audio, rate, chunk), "rec_id", "frame", "strength", rate / ONSET_HOP)
    frame_rate = rate / (window_size(rate) // HOPS_A_WINDOW)
    registers = note_chroma(audio, rate, chunk).withColumn("combined", V.vector_sum(F.col("treble"), F.col("bass")))
    both = beat_chroma(registers, beats, "combined", frame_rate).join(beat_chroma(registers, beats, "treble", frame_rate), ["rec_id", "beat"])
    close = harmony.template_similarity(both, "combined")
    path = harmony.decode_frames(close, "rec_id", "beat", "similarity").join(close, ["rec_id", "beat"])
    chords = score.audio_chords(path, ["rec_id"], ["beat"], "state", "treble", "similarity")
    times = beats.select("rec_id", F.col("beat").alias("first_beat"), F.col("seconds").alias("start_seconds"))
    w = Window.partitionBy("rec_id").orderBy("first_beat")
    last = beats.groupBy("rec_id").agg(F.max("seconds").alias("last"))
    timed = chords.join(times, ["rec_id", "first_beat"]).join(last, "rec_id").withColumn("end_seconds", F.coalesce(F.lead("start_seconds").over(w), "last"))
    symbol = F.when(F.col("quality") == "NONE", "N.C.").otherwise(theory.chord_symbol(F.col("root"), F.col("quality"), F.lit(None).cast("int")))
    return timed.select("rec_id", "first_beat", "n", "start_seconds", "end_seconds", "root", "quality", symbol.alias("symbol"), "confidence")
