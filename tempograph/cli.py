"""Commands over workspaces: init, analyze, render, info, doctor."""

from __future__ import annotations

import argparse
import importlib.util
import os
import sys

from tempograph.sources import workspace


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tempograph").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def analyze(root: str, source: str) -> int:
    """Chords of every MIDI and WAV file under a path, and beats with bar lines of the audio, written into the workspace as Parquet."""
    from pyspark.sql import functions as F

    from tempograph.operators.audio_chain import audio_chords, audio_downbeats
    from tempograph.operators.harmony import symbolic_chords
    from tempograph.sources import audio
    from tempograph.sources.midi import decode_midi, midi_notes

    spark = session()
    files = spark.read.format("binaryFile").load(source).withColumn("kind", audio.sniff(F.col("content")))
    notes = midi_notes(decode_midi(files.where("kind = 'MIDI'"))).where("channel <> 9")
    scaled = notes.select(F.col("path").alias("rec"), F.floor(F.col("beat") * 960).alias("onset"), F.floor(F.col("end_beat") * 960).alias("end_us"), F.pmod("midi", F.lit(12)).alias("pc"))
    found = symbolic_chords(scaled, "rec", "onset", "end_us", "pc", 960).select("rec", "from_span", "to_span", "quality", "root")
    chunks = audio.decode_audio(files.where("kind = 'WAV'")).persist()
    beats = None
    for row in chunks.select("sample_rate").distinct().collect():  # a handful of rates
        own = audio_chords(chunks.where(F.col("sample_rate") == row.sample_rate), row.sample_rate, audio.CHUNK)
        found = found.unionByName(own.select(F.col("rec_id").alias("rec"), F.col("first_beat").alias("from_span"), (F.col("first_beat") + F.col("n")).alias("to_span"), "quality", "root"))
        lines = audio_downbeats(chunks.where(F.col("sample_rate") == row.sample_rate), row.sample_rate, audio.CHUNK)
        beats = lines if beats is None else beats.unionByName(lines)
    found.write.mode("overwrite").parquet(os.path.join(root, "chords"))
    if beats is not None:
        beats.write.mode("overwrite").parquet(os.path.join(root, "beats"))
    audio.unreadable(files).write.mode("overwrite").parquet(os.path.join(root, "unreadable"))
    chunks.unpersist()
    return 0


def render(root: str) -> int:
    """The workspace's chords as charts on standard output, at the harmonic rhythm, four spans a bar."""
    from pyspark.sql import functions as F

    from tempograph.functions.theory import chord_symbol
    from tempograph.operators.chart import chart, chart_text

    chords = session().read.parquet(os.path.join(root, "chords"))
    symbol = F.when(F.col("quality") == "NONE", "N.C.").otherwise(chord_symbol(F.col("root"), F.col("quality"), F.lit(None).cast("int")))
    # A span is a quarter of 16 steps, four a bar; the chart opens with the bar that the first chord is in.
    placed = chords.select("rec", (F.col("from_span") * 16).cast("bigint").alias("start"), (F.col("to_span") * 16).cast("bigint").alias("end"), symbol.alias("symbol"))
    origin = placed.groupBy("rec").agg((F.floor(F.min("start") / 64) * 64).alias("origin"))
    meters = origin.select("rec", F.lit(0).cast("bigint").alias("start_bar"), F.lit(64).cast("bigint").alias("length"), F.lit(4).alias("beats"))
    bars = chart(placed.join(origin, "rec"), ["rec"], ["start", "end"], "start", "end", "symbol", meters, F.col("origin"), F.lit(16).cast("bigint"), F.lit(True), 1)
    for row in chart_text(bars, ["rec"]).orderBy("rec", "line").toLocalIterator():
        print(row.text)
    return 0


def doctor() -> int:
    """Which optional libraries are here."""
    for name in ("pyspark", "pyarrow", "pandas", "numpy", "tiktoken", "tokenizers"):
        print(f"{name}: {'found' if importlib.util.find_spec(name) else 'missing'}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tempograph")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "analyze", "render", "info"):
        p = sub.add_parser(name)
        p.add_argument("root")
        if name in ("init", "analyze"):
            p.add_argument("source")
    sub.add_parser("doctor")
    args = parser.parse_args(argv)
    if args.command == "doctor":
        return doctor()
    if args.command == "init":
        print(workspace.create_workspace(args.root, args.source))
        return 0
    if args.command == "info":
        print(workspace.open_workspace(args.root))
        return 0
    return analyze(args.root, args.source) if args.command == "analyze" else render(args.root)


if __name__ == "__main__":
    sys.exit(main())
