"""Standard MIDI files as event rows, notes and tempi, and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempograph.operators.temporal import fifo_pairs

LARGEST, QUARTER, EXPORT_QUARTER = 4 << 20, 480, 768
EVENTS_AT_ONCE = 1 << 14
EVENTS = "path string, division int, track int, tick bigint, seq int, kind string, channel int, d1 int, d2 int, meta binary"


def read_number(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for _ in range(4):
        b = data[at]
        at += 1
        value = value << 7 | b & 127
        if b < 128:
            return value, at
    raise ValueError("a number is too long")


def number_bytes(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127 | 128)
    return bytes(out[::-1])


def parse_midi(data: bytes) -> Iterator[tuple]:
    """S3: (division, track, tick, seq, kind, channel, d1, d2, meta) of type 0 and 1 files in ticks a quarter, up to 4 MiB."""
    if len(data) > LARGEST:
        raise ValueError("larger than 4 MiB")
    if data[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    size, kind, tracks, division = struct.unpack_from(">IHHH", data, 4)
    if kind not in (0, 1):
        raise ValueError("only types 0 and 1 can be read")
    if division & 0x8000:
        raise ValueError("SMPTE division can't be read")
    at, track = 8 + size, 0
    while at + 8 <= len(data) and track < tracks:
        name, length = data[at : at + 4], struct.unpack_from(">I", data, at + 4)[0]
        at, end = at + 8, min(len(data), at + 8 + length)
        if name == b"MTrk":
            tick, status, seq = 0, 0, 0
            while at < end:
                delta, at = read_number(data, at)
                tick += delta
                if data[at] >= 0x80:
                    status = data[at]
                    at += 1
                seq += 1
                if status == 0xFF:
                    what = data[at]
                    n, at = read_number(data, at + 1)
                    yield division, track, tick, seq, "META", -1, what, 0, data[at : at + n]
                    at += n
                elif status in (0xF0, 0xF7):
                    n, at = read_number(data, at)
                    at += n
                elif status >= 0x80:
                    high, two = status >> 4, status >> 4 not in (12, 13)
                    d1, d2 = data[at], data[at + 1] if two else 0
                    at += 2 if two else 1
                    kind_name = {8: "OFF", 9: "ON" if d2 else "OFF", 11: "CONTROL", 12: "PROGRAM"}.get(high, "OTHER")
                    yield division, track, tick, seq, kind_name, status & 15, d1, d2, b""
                else:
                    raise ValueError("data without a status")
            track += 1
        at = end


def decode_midi(files: DataFrame) -> DataFrame:
    """S3: event rows of (path, content) rows; files that can't be read are those of audio.unreadable().

    The events of many small files go into one batch, those of a file never into two.
    """
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = [field.split()[0] for field in EVENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    rows += [(path, *e) for e in parse_midi(content.as_py())]
                except (ValueError, IndexError, struct.error):
                    continue
                if len(rows) >= EVENTS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)

    return files.select("path", "content").mapInArrow(run, EVENTS)


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    return decode_midi(spark.read.format("binaryFile").load(path))


def midi_notes(events: DataFrame) -> DataFrame:
    """(path, track, channel, midi, beat, end_beat): ON and OFF paired first in first out; what never ends lasts to the file's end; empty notes are dropped."""
    named = events.withColumn("midi", F.col("d1"))
    pairs = fifo_pairs(named, ["path", "division", "track", "channel", "midi"], ["tick", "seq"], F.col("kind") == "ON", F.col("kind") == "OFF", "tick")
    last = events.groupBy("path").agg(F.max("tick").alias("last"))
    done = pairs.join(last, "path").withColumn("off_at", F.coalesce("off_at", "last")).where("off_at > on_at")
    return done.select("path", "track", "channel", "midi", (F.col("on_at") / F.col("division")).alias("beat"), (F.col("off_at") / F.col("division")).alias("end_beat"))


def unsigned(meta, count: int):
    return F.conv(F.hex(F.substring(meta, 1, count)), 16, 10).cast("bigint")


def later() -> F.Column:
    """The order of events of one tick, as one number: by track, then by place in it."""
    return F.col("track").cast("bigint") * (1 << 32) + F.col("seq")


def midi_tempi(events: DataFrame) -> DataFrame:
    """(path, beat, bpm, seconds): the last tempo at each tick; seconds are the running sum of declared tempi.

    120 holds before the first; a tempo of zero microseconds fails, malformed ones are left out.
    """
    # The events are gone over once: those that are no tempo stand for the 120 at a file's beginning.
    tempo = (F.col("kind") == "META") & (F.col("d1") == 0x51) & (F.octet_length("meta") >= 3)
    declared = unsigned("meta", 3)
    us = F.when(tempo, F.when(declared == 0, F.raise_error(F.lit("a tempo of zero")).cast("bigint")).otherwise(declared))
    t = events.select("path", "division", F.when(tempo, F.col("tick")).otherwise(0).alias("tick"), us.alias("us"), F.when(tempo, later()).alias("later"))
    each = t.repartition("path").groupBy("path", "division", "tick").agg(F.max_by("us", "later").alias("us")).withColumn("us", F.coalesce("us", F.lit(500_000)))
    w = Window.partitionBy("path").orderBy("tick")
    # A file of tempi alone, the first of them later on, lacks the row at its beginning.
    both = each.withColumns({"from_tick": F.lag("tick", 1, 0).over(w), "from_us": F.lag("us", 1, 500_000).over(w), "first": F.row_number().over(w) == 1})
    opening, own = F.struct(F.lit(0).cast("bigint").alias("tick"), F.lit(500_000).cast("bigint").alias("us"), F.lit(0.0).alias("step")), F.struct("tick", "us", ((F.col("tick") - F.col("from_tick")) / F.col("division") * F.col("from_us") / 1e6).alias("step"))
    rows = both.select("path", "division", F.explode(F.when(F.col("first") & (F.col("tick") > 0), F.array(opening, own)).otherwise(F.array(own))).alias("r")).select("path", "division", "r.*")
    return rows.select("path", (F.col("tick") / F.col("division")).alias("beat"), (60e6 / F.col("us")).alias("bpm"), F.sum("step").over(w).alias("seconds"))


def midi_meters(events: DataFrame) -> DataFrame:
    """P13, W20's input: the last meter at each tick; those the model can't say are left out."""
    m = events.where((F.col("kind") == "META") & (F.col("d1") == 0x58) & (F.octet_length("meta") >= 2))
    m = m.withColumns({"num": unsigned("meta", 1).cast("int"), "log": unsigned(F.substring("meta", 2, 1), 1).cast("int")}).where("num between 1 and 64 and log between 0 and 6")
    last = m.groupBy("path", (F.col("tick") / F.col("division")).alias("beat")).agg(F.max_by(F.col("num") * 8 + F.col("log"), later()).alias("m"))
    return last.select("path", "beat", F.floor(F.col("m") / 8).cast("int").alias("num"), F.pow(F.lit(2), F.col("m") % 8).cast("int").alias("den"))


def track_names(events: DataFrame) -> DataFrame:
    """the first name of each track, as plain text."""
    from tempograph.functions.theory import plain_text

    named = events.where((F.col("kind") == "META") & (F.col("d1") == 3))
    return named.groupBy("path", "track").agg(F.min_by("meta", F.struct("tick", "seq")).alias("meta")).select("path", "track", plain_text(F.decode("meta", "UTF-8")).alias("name"))


def effective_meters(changes: list[tuple[float, int, int]]) -> list[tuple[int, int, int]]:
    """(bar, num, den) from (beat, num, den): a change takes effect at the next bar line; a later one before it supersedes it."""
    opening = next(((n, d) for b, n, d in changes if b == 0), (4, 4))
    out, at_beat = [(0, *opening)], [0.0]
    for beat, num, den in sorted(c for c in changes if c[0] > 0):
        while len(out) > 1 and beat <= at_beat[-1] + 1e-9 and beat > at_beat[-1] - out[-2][1] * 4 / out[-2][2] + 1e-9:
            out.pop()
            at_beat.pop()
        bar, n, d = out[-1]
        length = n * 4 / d
        bars = -(-(beat - at_beat[-1] - 1e-9) // length)
        if (num, den) != (n, d):
            out.append((bar + int(bars), num, den))
            at_beat.append(at_beat[-1] + bars * length)
    return out


def midi_bytes(tracks: list[list[tuple[int, bytes]]], division: int = QUARTER) -> bytes:
    """A type 1 file of tracks of (tick, message), each closed."""
    out = b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), division)
    for events in tracks:
        body, at = b"", 0
        for tick, message in sorted(events, key=lambda e: e[0]):
            body += number_bytes(tick - at) + message
            at = tick
        body += b"\x00\xff\x2f\x00"
        out += b"MTrk" + struct.pack(">I", len(body)) + body
    return out


def meta(kind: int, data: bytes) -> bytes:
    return bytes([0xFF, kind]) + number_bytes(len(data)) + data


def export_events(notes: DataFrame) -> DataFrame:
    """ON and OFF rows in 768ths of a quarter; part channels skip 9, drums are on it; a note off the grid fails."""
    parts = notes.select("rec", "part", "role").distinct()
    k = F.row_number().over(Window.partitionBy("rec").orderBy("part")) - 1
    melodic = F.sum(F.when(F.col("role") != "DRUMS", 1).otherwise(0)).over(Window.partitionBy("rec").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    place = F.coalesce(melodic, F.lit(0)) % 15
    channel = F.when(F.col("role") == "DRUMS", 9).otherwise(place + (place >= 9).cast("int"))
    numbered = parts.withColumns({"track": k + 1, "channel": channel.cast("int")})
    exact = lambda c: F.when(F.abs(F.col(c) * EXPORT_QUARTER - F.floor(F.col(c) * EXPORT_QUARTER + 0.5)) > 1e-6, F.raise_error(F.lit("a note is off the export grid")).cast("bigint")).otherwise(F.floor(F.col(c) * EXPORT_QUARTER + 0.5))
    both = notes.join(numbered, ["rec", "part", "role"]).select("rec", "track", "channel", "midi", "velocity", exact("beat").alias("on"), exact("end_beat").alias("off"))
    rows = F.array(F.struct(F.col("on").alias("tick"), F.lit("ON").alias("kind"), F.col("velocity").alias("d2")), F.struct(F.col("off").alias("tick"), F.lit("OFF").alias("kind"), F.lit(0).alias("d2")))
    return both.select("rec", "track", "channel", F.col("midi").alias("d1"), F.explode(rows).alias("e")).select("rec", "track", "channel", "e.tick", "e.kind", "d1", "e.d2")


def export_files(events: DataFrame, bpm: float = 120.0) -> DataFrame:
    """K8: (rec, content): a conductor track and one for each part."""
    kind = events.schema["rec"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        conductor = [(0, meta(0x51, int(60e6 / bpm + 0.5).to_bytes(3, "big"))), (0, meta(0x58, bytes([4, 2, 24, 8])))]
        tracks = [conductor]
        for _, own in pdf.sort_values(["track", "tick", "kind"], kind="stable").groupby("track", sort=True):
            tracks.append([(int(t), bytes([(0x90 if k == "ON" else 0x80) | int(c), int(d1), int(d2)])) for t, k, c, d1, d2 in zip(own["tick"], own["kind"], own["channel"], own["d1"], own["d2"])])
        return pd.DataFrame({"rec": [pdf["rec"].iloc[0]], "content": [midi_bytes(tracks, EXPORT_QUARTER)]})

    return events.groupBy("rec").applyInPandas(run, f"rec {kind}, content binary")


def number_hex(value) -> F.Column:
    """number_bytes() of a number below 2**56, as hexadecimal digits."""
    packed = value.bitwiseAND(127)
    for k in range(1, 8):
        group = F.shiftright(value, 7 * k).bitwiseAND(127).bitwiseOR(128)
        packed = packed.bitwiseOR(F.when(value >= 1 << 7 * k, F.shiftleft(group, 8 * k)).otherwise(0))
    return F.when(value < 128, F.substring(F.hex(value + 256), 2, 2)).when(value < 1 << 56, F.hex(packed))


def meta_files(events: DataFrame) -> DataFrame:
    """(rec, content): files of a conductor track alone, with the meta events (rec, tick, seq, kind, data) in the order of tick and seq."""
    w = Window.partitionBy("rec").orderBy("tick", "seq")
    tick, kind, size = F.col("tick").cast("bigint"), F.col("kind").cast("bigint"), F.octet_length("data").cast("bigint")
    delta = tick - F.lag(tick, 1, 0).over(w)
    text = F.concat(number_hex(F.col("delta")), F.lit("FF"), F.substring(F.hex(kind + 256), 2, 2), number_hex(size), F.hex("data"))
    fits = (F.col("delta") >= 0) & kind.between(0, 255)
    each = events.select("rec", kind.alias("kind"), "data", delta.alias("delta"), F.row_number().over(w).alias("i"))
    each = each.select("rec", "i", F.when(fits & text.isNotNull(), text).otherwise(F.raise_error(F.lit("an event that a file can't hold")).cast("string")).alias("text"))
    body = F.concat(F.array_join(F.array_sort(F.collect_list(F.struct("i", "text")))["text"], ""), F.lit("00FF2F00"))
    head = (b"MThd" + struct.pack(">IHHH", 6, 1, 1, EXPORT_QUARTER) + b"MTrk").hex()
    files = each.groupBy("rec").agg(body.alias("body"))
    return files.select("rec", F.unhex(F.concat(F.lit(head), F.lpad(F.hex((F.length("body") / 2).cast("bigint")), 8, "0"), F.col("body"))).alias("content"))


def tempo_data(us) -> F.Column:
    """The three bytes of a tempo event."""
    return F.unhex(F.lpad(F.hex(us), 6, "0"))


def meter_data(num, log) -> F.Column:
    """The four bytes of a time signature event."""
    return F.unhex(F.concat(F.lpad(F.hex(num), 2, "0"), F.lpad(F.hex(log), 2, "0"), F.lit("1808")))


# Fixtures as (part, channel, beat, length, midi) rows, and their tempi.
def fixture_rows() -> list[tuple]:
    """Named note sequences: a scale after a rest, a lead-in with a tempo change, chords over a bass."""
    rows = [("cMajorScale", "melody", 0, float(i), 1.0, p) for i, p in enumerate((60, 62, 64, 65, 67, 69, 71, 72))]
    rows += [("leadIn", "melody", 0, 4.0 + i, 1.0, 60 + 2 * (i % 5)) for i in range(12)] + [("leadIn", "bass", 1, 4.0 + 2 * i, 2.0, 36 + i % 3) for i in range(6)]
    chords, bass = ((60, 64, 67), (59, 62, 67), (60, 64, 69), (60, 65, 69)), (36, 43, 45, 41)
    for bar in range(8):
        rows += [("fourChordSong", "piano", 0, 4.0 + 4 * bar, 4.0, p) for p in chords[bar % 4]] + [("fourChordSong", "bass", 1, 4.0 + 4 * bar, 4.0, bass[bar % 4])]
    rows += [("drumsAndBass", "drums", 9, 1.0 + 0.5 * i, 0.5, (36, 42, 38, 42)[i % 4]) for i in range(16)] + [("drumsAndBass", "bass", 1, 1.0 + i, 1.0, 33) for i in range(8)]
    rows += [("compoundTime", "melody", 0, 1.5 * i, 1.5, 62 + i) for i in range(6)]
    return rows


def fixture_file(name: str, bpm: float = 120.0, division: int = QUARTER) -> bytes:
    own = [r for r in fixture_rows() if r[0] == name]
    tracks = [[(0, meta(0x51, int(60e6 / bpm + 0.5).to_bytes(3, "big")))]]
    for part in dict.fromkeys(r[1] for r in own):
        notes = [(0, meta(3, part.encode()))]
        for _, _, channel, beat, length, midi in (r for r in own if r[1] == part):
            notes += [(int(beat * division), bytes([0x90 | channel, midi, 80])), (int((beat + length) * division), bytes([0x80 | channel, midi, 0]))]
        tracks.append(sorted(notes, key=lambda e: (e[0], e[1][0] & 0xF0 == 0x90)))
    return midi_bytes(tracks, division)


def fixtures(spark: SparkSession) -> DataFrame:
    """S10."""
    return spark.createDataFrame(fixture_rows(), "fixture string, part string, channel int, beat double, length double, midi int")
