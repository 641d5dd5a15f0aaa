"""An extension: onset rates over sliding windows of an unbounded event stream."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    """Parquet files arriving in a folder, as a stream of events."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def sliding_rates(events: DataFrame, window: str = "25 hours", slide: str = "12 hours 30 minutes", late: str = "1 day") -> DataFrame:
    """Onsets a key and half-overlapping window; rows later than the watermark are left out."""
    w = F.window("ts", window, slide)
    counted = events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("onsets"), F.sum("value").alias("value"))
    return counted.select("user_id", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "onsets", "value")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of events of a key without a longer gap."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", s.alias("s")).agg(F.count("*").alias("onsets")).select("user_id", F.col("s.start").alias("from_ts"), F.col("s.end").alias("to_ts"), "onsets")


def gaps(events: DataFrame) -> DataFrame:
    """W17 on a stream: the time since the key's last event, kept as state; a row that comes late counts from zero."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "event_id"], kind="stable")
            rows = []
            for event, ts in zip(pdf["event_id"], pdf["ts"].astype("int64") // 1000):
                rows.append((key[0], event, None if last is None else max(0, int(ts) - last)))
                last = int(ts) if last is None else max(last, int(ts))
            yield pd.DataFrame(rows, columns=["user_id", "event_id", "gap_us"])
        if last is not None:
            state.update((last,))

    moments = events.select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return moments.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, event_id bigint, gap_us bigint", "last bigint", "append", "NoTimeout")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh path where the cluster's workers and the driver all see it (``spark.checkpoint.dir``); only a local session may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tempograph-')}"
    return f"{root.rstrip('/')}/tempograph-{what}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """What has arrived since the last run with this checkpoint, appended to a Parquet folder; then the stream stops.

    State and the place in the source are in the checkpoint, so a run goes on where the last one ended, or failed.
    """
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def gaps_in_runs(events: DataFrame, at: str, runs: int) -> DataFrame:
    """gaps() of a table that arrives in ``runs`` parts, one after another in time, each met by a stream that starts, takes it in and stops."""
    spark = events.sparkSession
    source, out, checkpoint = (shared_folder(spark, what) for what in ("arrivals", "gaps", "stream"))
    ends = events.agg(F.min(at).alias("a"), F.max(at).alias("z")).select(F.unix_micros(F.col("a").cast("timestamp")).alias("a"), F.unix_micros(F.col("z").cast("timestamp")).alias("z")).first()
    place = F.unix_micros(F.col(at).cast("timestamp"))
    edges = [ends["a"] + (ends["z"] - ends["a"] + 1) * k // runs for k in range(runs + 1)] if ends["a"] is not None else []
    for low, high in zip(edges, edges[1:]):
        events.where((place >= low) & (place < high)).write.mode("append").parquet(source)
        run_available(gaps(event_stream(spark, source, 1000)), out, checkpoint)
    return spark.read.schema("user_id bigint, event_id bigint, gap_us bigint").parquet(out) if edges else spark.createDataFrame([], "user_id bigint, event_id bigint, gap_us bigint")
