"""The driver's tables as notes, frames, spans and labels, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIX_HOURS, ORIGIN = 21_600_000_000, 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, event_id, onset, end_us, midi, pc, velocity of the events table; empty notes are left out."""
    e = table(spark, sf_dir, "events")
    out = e.select(
        F.col("user_id").alias("rec"),
        "event_id",
        micros("ts").alias("onset"),
        (micros("ts") + F.round(F.col("value") * 100).cast("bigint") * 12_000_000).alias("end_us"),
        F.get_json_object("props", "$.k").cast("int").alias("midi"),
        F.col("value").alias("velocity"),
        "event_type",
    )
    return out.where("end_us > onset").withColumn("pc", F.pmod("midi", F.lit(12)))


NOTES = """notes as (
  select user_id as rec, event_id, epoch_us(ts) as onset, epoch_us(ts) + cast(round(value * 100) as bigint) * 12000000 as end_us,
         cast(json_extract_string(props, '$.k') as integer) as midi, value as velocity, event_type,
         cast(json_extract_string(props, '$.k') as integer) % 12 as pc
  from events where cast(round(value * 100) as bigint) > 0)"""


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, event_id, at (microseconds), value of all events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), "event_id", micros("ts").alias("at"), "value", "event_type")


ONSETS = "onsets as (select user_id as rec, event_id, epoch_us(ts) as t_us, value, event_type from events)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, frame, vec (64 doubles, signed) of the embeddings table."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("rec"), F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("vec"))


FRAMES = "frames as (select label as rec, vec_id as frame, cast(embedding as double[]) as vec from embeddings)"


def chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, frame, chroma: absolute values folded to 12 classes."""
    from tempograph.functions.vectors import fold

    return frames(spark, sf_dir).select("rec", "frame", fold(F.transform("vec", F.abs)).alias("chroma"))


CHROMA = (
    FRAMES
    + """, chroma as (
  select rec, frame, list_transform(range(12), lambda c: list_reduce(list_prepend(0.0::double, list_transform(list_filter(range(64), lambda i: i % 12 = c), lambda i: abs(vec[i + 1]))), lambda a, x: a + x)) as chroma
  from frames)"""
)
