"""Quality rules: counts of a text, and a log-likelihood ratio of hashed n-grams.

Two multinomials over ``BUCKETS`` hashed n-grams are estimated: one from trusted
documents, one from the whole raw corpus.  N-grams are the ``NGRAM`` bytes that
start at each byte of the text, A-Z lower-cased.  A document's score is the sum of
log p_trusted - log p_raw over its n-grams, divided by their number; every
document whose score is under ``threshold`` is rejected, without any sampling.

Base rules: under ``min_words`` words, or more than half of the words in word
windows that recur in the text.  Null and empty texts have no words and fail; a
text under NGRAM bytes scores 0.  With no trusted document every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm._common import append_columns, bitmap, slices, texts

BUCKETS, NGRAM, PRIOR, FILTER, FAN = 1 << 16, 4, 10_000, 1 << 20, 64
SYMBOLS = b"#*$%&|<>"
FACTOR = np.uint32(0x9E3779B1)


def buckets(raw: bytes) -> np.ndarray:
    """Bucket of each n-gram of a text's bytes."""
    if len(raw) < NGRAM:
        return np.empty(0, np.int64)
    b = np.frombuffer(raw.lower(), np.uint8).astype(np.uint32)
    n = len(b) - NGRAM + 1
    gram = b[:n] | b[1 : n + 1] << np.uint32(8) | b[2 : n + 2] << np.uint32(16) | b[3 : n + 3] << np.uint32(24)
    return ((gram * FACTOR) >> np.uint32(16)).astype(np.int64)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """words, their code points, symbols, lines that repeat an earlier one, words in recurring windows of three."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 2:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
        size = len(seen)
        if size < 2_000_000:
            windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        else:
            pairs = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)[1]
            windows = pairs * size + ids[2:]
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        often = np.zeros(n - 2, bool)
        often[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= often
        repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """N-gram counts over all rows' ``text``.  A task sends one packed array; arrays are added up in a tree of FAN arrays a task."""

    def packed(counts):
        return pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])

    def count(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                counts += np.bincount(np.concatenate([buckets(x.encode("utf-8", "surrogatepass")) for x in texts(batch, "text")]), minlength=BUCKETS)
        yield packed(counts)

    def add(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                counts += np.frombuffer(x.as_buffer(), np.int64)
        yield packed(counts)

    parts, sums = max(1, docs.rdd.getNumPartitions()), docs.select("text").mapInArrow(count, "counts binary")
    while parts > FAN:
        parts = -(-parts // FAN)
        sums = sums.repartition(parts).mapInArrow(add, "counts binary")
    return sum((np.frombuffer(r.counts, np.int64) for r in sums.collect()), np.zeros(BUCKETS, np.int64))


def only_listed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, text) whose id is among ``ids`` (id).

    A bitmap of FILTER hashed positions, which is all that the driver gets, first drops most other rows
    where they are; so only about the listed documents' texts enter the join's shuffle, which grows
    with the list.  It is a merge join at any size: few listed rows shuffle little, and many don't fit a broadcast.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER)).cast("int")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(ids, place, FILTER))

    def run(batches):
        there = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            keep = there[batch.column("p").to_numpy()]
            yield batch.filter(pa.array(keep)).select(["id", "text"])

    near = docs.withColumn("p", place).mapInArrow(run, docs.schema)
    return near.join(ids.hint("merge"), "id", "left_semi")


def log_ratio(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_trusted - log p_raw by bucket.  The trusted counts get PRIOR n-grams dealt like the raw corpus, so that few trusted texts decide little."""
    q = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    return np.log((good + PRIOR * q) / (good.sum() + PRIOR)) - np.log(q)


RESULT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, llr double, kept boolean"


def quality_rules(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = -0.6, min_words: int = 50) -> DataFrame:
    """The rows with the counts, base_failed, llr and kept added (columns of such names are replaced).

    ``trusted`` holds the ids of the target documents in ``id_col``.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    good = only_listed(docs, trusted.select(F.col(id_col).alias("id")).where("id is not null").distinct())
    table = df.sparkSession.sparkContext.broadcast(log_ratio(bucket_counts(good), bucket_counts(docs)))

    def make():
        weight = table.value

        def fn(batch):
            made = {f.split()[0]: [] for f in RESULT.split(", ")}
            for x in texts(batch, text):
                counts = base_counts(x)
                own = buckets(x.encode("utf-8", "surrogatepass"))
                llr = float(weight[own].sum() / len(own)) if len(own) else 0.0
                failed = counts[0] < min_words or 100 * counts[4] > 50 * counts[0]
                for name, value in zip(made, (*counts, failed, llr, not failed and llr >= threshold)):
                    made[name].append(value)
            return made

        return fn

    return append_columns(df, text, RESULT, make)
