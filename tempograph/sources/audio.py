"""WAV files as audio chunks, and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 65_536
AUDIO = "rec_id string, chunk_no int, sample_rate int, samples array<float>"


def sniff(content) -> F.Column:
    """The kind of a file by its first bytes, not its name."""
    head = F.substring(content, 1, 4)
    is_text = lambda t: head == F.lit(t.encode())
    return F.when(is_text("MThd"), "MIDI").when(is_text("RIFF"), "WAV").when(is_text("fLaC"), "FLAC").when(is_text("OggS"), "OGG").when(F.substring(content, 1, 3) == F.lit(b"ID3"), "MP3").otherwise("UNKNOWN")


def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples) of 16-bit PCM with one or two channels.

    Chunks may come in any order, odd ones are padded, unknown ones skipped; a data size of zero or
    beyond the file means whatever is there.  ValueError for anything else.
    """
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, layout = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = at + 8
        if name == b"fmt " and body + 16 <= len(data):
            layout = struct.unpack_from("<HHIIHH", data, body)
        elif name == b"data":
            if layout is None:
                raise ValueError("samples before their format")
            tag, channels, rate, _, _, bits = layout
            if tag != 1 or bits != 16 or channels not in (1, 2) or not rate:
                raise ValueError("only 16-bit PCM of one or two channels can be read")
            end = len(data) if size == 0 or body + size > len(data) else body + size
            end -= (end - body) % (2 * channels)
            frames = np.frombuffer(data, "<i2", (end - body) // 2, body).reshape(-1, channels)
            return rate, frames.mean(axis=1) / 32768
        at = body + size + size % 2
    raise ValueError("no samples")


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A mono 16-bit WAV file."""
    pcm = np.clip(np.floor(np.asarray(samples) * 32767 + 0.5), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm


def wav_files(audio: DataFrame) -> DataFrame:
    """(path, content) of each recording's chunks (rec_id, chunk_no, sample_rate, samples) as one WAV file; a file is written by one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("chunk_no")
        return pd.DataFrame({"path": [own["rec_id"].iloc[0]], "content": [wav_bytes(np.concatenate(own["samples"].to_list()), int(own["sample_rate"].iloc[0]))]})

    return audio.select(F.col("rec_id").cast("string").alias("rec_id"), "chunk_no", "sample_rate", "samples").groupBy("rec_id").applyInPandas(run, "path string, content binary")


def decode_audio(files: DataFrame) -> DataFrame:
    """(path, content) rows to chunked mono audio; files that can't be read are those of unreadable()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rate, samples = parse_wav(bytes(content))
                except ValueError:
                    continue
                for k in range(0, max(1, len(samples)), CHUNK):
                    yield pd.DataFrame({"rec_id": [path], "chunk_no": [k // CHUNK], "sample_rate": [rate], "samples": [samples[k : k + CHUNK].astype("float32")]})

    return files.select("path", "content").mapInPandas(run, AUDIO)


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """Every WAV file under a path; one file is one task's work."""
    return decode_audio(spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path))


def unreadable(files: DataFrame) -> DataFrame:
    """Files (path, content) that no reader takes, each with its kind and the reason (P14): the rows that decode_audio() and decode_midi() leave out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tempograph.sources.midi import parse_midi

        for pdf in batches:
            rows = []
            for path, kind, content in zip(pdf["path"], pdf["kind"], pdf["content"]):
                try:
                    if kind == "WAV":
                        parse_wav(bytes(content))
                    elif kind == "MIDI":
                        list(parse_midi(bytes(content)))
                    else:
                        rows.append((path, kind, f"no decoder for {kind}"))
                except (ValueError, IndexError, struct.error) as error:
                    rows.append((path, kind, str(error)))
            yield pd.DataFrame(rows, columns=["path", "kind", "reason"])

    return files.select("path", sniff(F.col("content")).alias("kind"), "content").mapInPandas(run, "path string, kind string, reason string")


def slice_time(audio: DataFrame, start: float, end: float, chunk: int = CHUNK) -> DataFrame:
    """The samples from start to end in seconds, at least one; chunks outside are pruned before they are read."""
    first = F.floor(F.lit(start) * F.col("sample_rate") + 0.5).cast("bigint")
    last = F.greatest(first + 1, F.floor(F.lit(end) * F.col("sample_rate") + 0.5).cast("bigint"))
    base = F.col("chunk_no").cast("bigint") * chunk
    hit = audio.where((base < last) & (base + chunk > first))
    begin = F.greatest(F.lit(0), first - base)
    count = F.least(last - base, F.lit(chunk)) - begin
    return hit.withColumn("samples", F.slice("samples", (begin + 1).cast("int"), F.greatest(F.lit(0), count).cast("int"))).where(F.size("samples") > 0)


def time_of(index, rate):
    """P2."""
    return index / rate


def index_of(seconds, rate, size):
    """Rounded and clamped."""
    return F.greatest(F.lit(0), F.least(size - 1, F.floor(seconds * rate + 0.5)))


def frame_centre(frame, hop, window, rate):
    """Time of a spectrum's frame, at its window's centre; an envelope's frame is at its start."""
    return (frame * hop + window / 2) / rate
