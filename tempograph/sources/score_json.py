"""Score documents as JSON, cache keys, and the layered configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIDENCE = "struct<value:double>"
SPELLING = "struct<letter:string,accidental:string,octave:int>"
SPAN = f"startSeconds:double,endSeconds:double,startBeat:double,endBeat:double,confidence:{CONFIDENCE}"
#: The whole document; unknown fields are ignored on reading.
SCHEMA = f"""title string, artist string,
tempoMap struct<segments:array<struct<startBeat:double,startSeconds:double,beatsPerMinute:double,provenance:string>>,meterChanges:array<struct<startBar:int,timeSignature:struct<numerator:int,denominator:int>>>>,
beatGrid struct<beats:array<struct<seconds:double,downbeat:boolean,positionInBar:int>>,beatConfidence:{CONFIDENCE},downbeatConfidence:{CONFIDENCE}>,
keys array<struct<tonic:{SPELLING},mode:string,{SPAN}>>,
sections array<struct<kind:string,label:string,startSeconds:double,endSeconds:double,startBeat:double,endBeat:double,repetitionGroup:string,confidence:{CONFIDENCE}>>,
tracks array<struct<role:string,name:string,notes:array<struct<onsetSeconds:double,durationSeconds:double,midiPitch:int,velocity:int,spelling:{SPELLING},onsetBeat:double,durationBeats:double,confidence:{CONFIDENCE}>>,confidence:{CONFIDENCE}>>,
chords struct<chords:array<struct<root:{SPELLING},quality:string,bass:{SPELLING},{SPAN}>>,confidence:{CONFIDENCE}>,
durationSeconds double"""
PROVENANCES = ("UNKNOWN", "MEASURED", "DECLARED", "SUPPLIED", "ASSUMED", "DERIVED")


def with_defaults(df: DataFrame) -> DataFrame:
    """A missing or unknown provenance reads as UNKNOWN."""
    known = F.array(*map(F.lit, PROVENANCES))
    fixed = F.transform("tempoMap.segments", lambda s: s.withField("provenance", F.when(F.array_contains(known, s["provenance"]), s["provenance"]).otherwise("UNKNOWN")))
    return df.withColumn("tempoMap", F.col("tempoMap").withField("segments", fixed))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score documents, one a file or line."""
    return with_defaults(spark.read.schema(SCHEMA).option("multiLine", True).json(path))


def parse_scores(df: DataFrame, column: str) -> DataFrame:
    """S5, R6 on a column of texts."""
    return with_defaults(df.select(F.from_json(column, SCHEMA).alias("s")).select("s.*"))


def score_text() -> Column:
    """K1: a document's columns as pretty JSON."""
    names = [p.strip().split()[0] for p in ("title", "artist", "tempoMap", "beatGrid", "keys", "sections", "tracks", "chords", "durationSeconds")]
    return F.to_json(F.struct(*names), {"pretty": "true"})


def flat_notes(scores: DataFrame, key: str) -> DataFrame:
    """Notes of all tracks, by onset."""
    t = scores.select(key, F.posexplode("tracks").alias("track", "t"))
    return t.select(key, "track", "t.role", F.explode("t.notes").alias("n")).select(key, "track", "role", "n.*")


def cache_key_of(stage: str, parts: dict[str, Column]) -> Column:
    """SHA-256 of the stage and its parts sorted by name, each with its length; a null part is a dash."""
    text = [F.lit(stage + ";")]
    for name in sorted(parts):
        own = F.coalesce(F.concat(F.octet_length(parts[name]).cast("string"), F.lit(":"), parts[name]), F.lit("-"))
        text += [F.lit(f"{len(name.encode())}:{name}"), own, F.lit(";")]
    return F.sha2(F.concat(*text), 256)
