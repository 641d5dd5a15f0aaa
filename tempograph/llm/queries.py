"""The registered queries over the driver's tables: thin layers over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm.oracles import ORACLES  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempograph.llm.packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempograph.llm.quality_rules import quality_rules

    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempograph.llm._common import utf8_crc
    from tempograph.llm.quality_classifier import quality_scores

    held_out = utf8_crc("doc_id") % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "quality")
    scored = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempograph.llm.bpe import bpe_decode, bpe_encode

    path = vocabulary("byte_bpe_50k.json")
    decoded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: The contract's rules.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempograph.llm.url_filter import filter_urls

    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempograph.llm.line_dedup import drop_repeated_lines

    cleaned = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempograph.llm.secrets import count_kind, described, scan_secrets

    scanned = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    spans = F.col("spans")
    return scanned.select(
        "doc_id",
        *(count_kind(spans, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(described(F.filter(spans, lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        described(spans).alias("spans"),
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempograph.llm.token_files import read_token_files, token_file_path, write_token_files

    path = token_file_path(spark)
    write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path, end_id=2)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempograph.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempograph.llm.media import read_media, store_media

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = read_media(store_media(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")).drop("text"))
    sums = F.concat_ws(",", F.col("channel_sums").cast("array<string>"))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.col("height").cast("string"), F.lit("x"), F.col("width").cast("string"), F.lit("x3:"), sums, F.lit(":"), F.crc32("tensor").cast("string")).alias("feature"),
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempograph.llm._common import utf8_crc
    from tempograph.llm.merkle import merkle_manifest

    tampered = F.col("n_chars") + F.when(utf8_crc("doc_id") % 7 == 0, 1).otherwise(0)
    return merkle_manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], claims={"n_chars": tampered})


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempograph.llm.prefix_trie import prefix_trie, rebuilt

    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempograph.llm.mixing import mixed_documents

    return mixed_documents(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (op1_packing, op2_near_dup, op3_quality_rules, op4_quality_classifier, op5_bpe, op6_url_filter, op7_line_dedup, op8_secrets, op9_token_files, op10_media, op11_merkle, op12_prefix_trie, op13_mixing)}

