"""Line deduplication through a sharded minimal perfect hash.

The distinct hashes of lines found in several documents are dealt into shards of
bounded size.  Each shard is indexed by a minimal perfect hash (levels of bit
arrays; a key's rank is its slot) over compact arrays: a fingerprint, a count of
documents and the smallest document id.  A document sends each shard the hashes
of its own lines and probes the arrays there; no line is joined with a line.  A
bitmap of ``FILTER`` bits at most, which every task holds, keeps back hashes that no
shard has; when repeated keys outgrow it, it lets more through and nothing else changes.
Within a task a shard's arrays come first and then its probes, in a stream, so a
task holds one shard at a time.  The number of documents that hold a shard's keys is
known when it is built, and its probes are dealt over as many tasks as keep each
near ``TARGET`` hashes, so a line that a third of all documents share is spread; documents
with very many lines send them in several rows.

A line's key is the line without the ASCII white space at its ends and with A-Z
lower-cased; keys shorter than ``min_chars`` code points are left alone.  Hashes
have 128 bits: one half finds the slot, the other is the fingerprint.

A null or empty text is one empty line.  Rows that repeat an id count as one
document.  Rows with a null id pass unchanged and don't count as documents.  Ids are
compared as bigint; the cast raises for a text that isn't a number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tempograph.llm._common import append_columns, bitmap, cut, drop_cut, texts

SHARD, TARGET, PROBES, FILTER = 1 << 18, 1 << 20, 4096, 1 << 26
WHITE = b" \t\n\x0b\x0c\r"


def line_keys(text: str, min_chars: int) -> tuple[list[bytes], list[bytes]]:
    """The text's lines in UTF-8, and each line's 16-byte key hash (empty for a short key)."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    out = []
    for line in lines:
        key = line.strip(WHITE).lower()
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else b"")
    return lines, out


def mixed(x: np.ndarray, level: int) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level keys alone in their cell stay, the others go on."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        self.rest = np.sort(keys)
        while len(self.rest) and len(self.levels) < 40:
            size = 2 * len(self.rest) + 1
            cell = (mixed(self.rest, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(cell, minlength=size) == 1
            self.levels.append(alone)
            self.rest = self.rest[~alone[cell]]
        self._rank()

    def _rank(self) -> None:
        before, self.ranks = 0, []
        for alone in self.levels:
            ranks = np.cumsum(alone) - alone + before
            before += int(alone.sum())
            self.ranks.append(ranks)
        self.before = before
        self.size = before + len(self.rest)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; keys that weren't indexed get any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (alone, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                return out
            cell = (mixed(keys[left], level) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[cell]
            out[left[hit]] = ranks[cell[hit]]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            same = self.rest[at] == keys[left]
            out[left[same]] = self.before + at[same]
        return out

    def dump(self) -> tuple[list[bytes], list[int], bytes]:
        return [np.packbits(x).tobytes() for x in self.levels], [len(x) for x in self.levels], self.rest.tobytes()

    @classmethod
    def load(cls, levels: list[bytes], sizes: list[int], rest: bytes) -> PerfectHash:
        out = cls.__new__(cls)
        out.levels = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(levels, sizes)]
        out.rest = np.frombuffer(rest, np.uint64)
        out._rank()
        return out


def key_rows(df: DataFrame, min_chars: int) -> DataFrame:
    """(node, h, f) for each distinct key of each row."""

    def run(batches):
        for batch in batches:
            nodes, keys = [], []
            for node, text in zip(batch.column("node").to_pylist(), texts(batch, "text")):
                own = set(filter(None, line_keys(text, min_chars)[1]))
                nodes += [node] * len(own)
                keys += own
            both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["node", "h", "f"])

    return df.mapInArrow(run, "node bigint, h bigint, f bigint")


SHARDS = "shard int, slot_levels array<binary>, level_sizes array<int>, rest binary, fingerprints binary, counts binary, owners binary"


def build_shards(repeated: DataFrame, shards: int) -> DataFrame:
    """A row of arrays for each shard of the repeated keys (h, f, owner, documents)."""

    def build(key, table):
        h, f, owner, n = (table.column(c).to_numpy() for c in ("h", "f", "owner", "documents"))
        index = PerfectHash(np.unique(h.view(np.uint64)))
        slot = index.slots(h.view(np.uint64))
        size = index.size
        fingerprints, counts, owners = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        fingerprints[slot], counts[slot], owners[slot] = f, n, owner
        levels, sizes, rest = index.dump()
        arrays = [fingerprints.tobytes(), np.minimum(counts, 2**31 - 1).astype("<i4").tobytes(), owners.tobytes()]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "slot_levels": pa.array([levels], pa.list_(pa.binary())), "level_sizes": pa.array([sizes], pa.list_(pa.int32())), "rest": pa.array([rest], pa.binary()), "fingerprints": pa.array(arrays[:1], pa.binary()), "counts": pa.array(arrays[1:2], pa.binary()), "owners": pa.array(arrays[2:], pa.binary())})

    return repeated.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, SHARDS)


def salts_of(loads: dict[int, int], shards: int, others: float, least: int) -> np.ndarray:
    """Number of tasks for each shard's probes, from the documents that hold its keys and an even part of the other hashes."""
    own = np.array([loads.get(i, 0) for i in range(shards)]) + others / shards
    return np.maximum(np.ceil(own / TARGET).astype(np.int64), -(-least // shards))


def probe_rows(df: DataFrame, salts: np.ndarray, seen, bits: int, min_chars: int) -> DataFrame:
    """(shard, task, node, hashes): each row's distinct keys that the bitmap ``seen`` lets through, in rows of bounded length."""
    shards, before = len(salts), np.cumsum(salts) - salts

    def run(batches):
        held = np.unpackbits(np.frombuffer(seen.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            rows = {"shard": [], "task": [], "node": [], "hashes": []}
            for node, text in zip(batch.column("node").to_pylist(), texts(batch, "text")):
                own = b"".join(sorted(set(filter(None, line_keys(text, min_chars)[1]))))
                both = np.frombuffer(own, "<i8").reshape(-1, 2)
                both = both[held[both[:, 1] % bits]]
                shard = both[:, 0] % shards
                for s in np.unique(shard).tolist():
                    part = both[shard == s]
                    for at in range(0, len(part), PROBES):
                        rows["shard"].append(s)
                        rows["task"].append(int(before[s] + (node + at // PROBES) % salts[s]))
                        rows["node"].append(node)
                        rows["hashes"].append(part[at : at + PROBES].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in (("shard", pa.int32()), ("task", pa.int32()), ("node", pa.int64()), ("hashes", pa.binary()))], names=list(rows))

    return df.mapInArrow(run, "shard int, task int, node bigint, hashes binary")


def probe(shards: DataFrame, salts: np.ndarray, probes: DataFrame) -> DataFrame:
    """(node, h, f): keys that a document must lose, for the document that holds them first keeps them."""
    names = ["shard", "task", "node", "hashes", "slot_levels", "level_sizes", "rest", "fingerprints", "counts", "owners"]
    ends = np.cumsum(salts)
    tasks = shards.sparkSession.createDataFrame([(i, int(e - n), int(e - 1)) for i, (n, e) in enumerate(zip(salts, ends))], "shard int, a int, b int")
    salted = shards.join(tasks, "shard").withColumn("task", F.explode(F.sequence("a", "b")))
    rows = salted.unionByName(probes, allowMissingColumns=True).select(names)

    def run(batches):
        index = None
        for batch in batches:
            nodes, lost = [], []
            for row in zip(*(batch.column(c) for c in names)):
                if row[3].as_py() is None:  # a shard's arrays
                    index = (row[0].as_py(), PerfectHash.load(*(x.as_py() for x in row[4:7])), *(np.frombuffer(x.as_py(), t) for x, t in zip(row[7:], ("<i8", "<i4", "<i8"))))
                    continue
                if index is None or index[0] != row[0].as_py():
                    continue  # no key of this shard repeats
                keys, node = np.frombuffer(row[3].as_py(), "<i8").reshape(-1, 2), row[2].as_py()
                _, slots, fingerprints, counts, owners = index
                slot = slots.slots(keys[:, 0].view(np.uint64))
                drop = (slot >= 0) & (fingerprints[slot] == keys[:, 1]) & (counts[slot] > 1) & (owners[slot] != node) if len(owners) else np.zeros(len(keys), bool)
                nodes += [node] * int(drop.sum())
                lost.append(keys[drop])
            both = np.concatenate([np.empty((0, 2), np.int64), *lost])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["node", "h", "f"])

    dealt = rows.repartitionById(int(salts.sum()), F.col("task")).sortWithinPartitions("shard", F.col("hashes").isNotNull())
    return dealt.mapInArrow(run, "node bigint, h bigint, f bigint")


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """The rows with their text's repeated lines gone (a null text becomes empty), and n_lines (before) and n_dropped."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("bigint").alias("node"), F.col(text).alias("text")).where("node is not null")
    every = Observation()
    keys = key_rows(docs, min_chars).groupBy("h", "f").agg(F.min("node").alias("owner"), F.max("node").alias("last"), F.count("*").alias("documents"))
    repeated = cut(keys.observe(every, F.coalesce(F.sum("documents"), F.lit(0)).alias("n")).where("owner < last").drop("last"), "line-keys")
    n_keys = repeated.count()
    shards = max(1, -(-n_keys // SHARD))
    built = cut(build_shards(repeated, shards), "line-shards")
    bits = min(FILTER, 1 << max(15, (16 * n_keys).bit_length()))
    seen = bitmap(repeated, F.pmod("f", F.lit(bits)), bits)
    # A row for each SHARD repeated keys.
    loads = {r["shard"]: r["n"] for r in repeated.groupBy(F.pmod("h", F.lit(shards)).cast("int").alias("shard")).agg(F.sum("documents").alias("n")).collect()}
    others = (every.get["n"] - sum(loads.values())) * (1 - np.exp(-n_keys / bits))
    salts = salts_of(loads, shards, others, spark.sparkContext.defaultParallelism)
    lost = probe(built, salts, probe_rows(docs, salts, spark.sparkContext.broadcast(seen), bits, min_chars)).distinct()
    # As many keys for a document as it has lines.
    by_doc = lost.groupBy("node").agg(F.collect_list("h").alias("__h"), F.collect_list("f").alias("__f")).withColumnRenamed("node", "__node")
    joined = df.join(by_doc, F.col(id_col).cast("bigint") == F.col("__node"), "left").drop("__node")

    def make():
        def fn(batch):
            kept_texts, n_lines, n_dropped = [], [], []
            for x, h, f in zip(texts(batch, text), batch.column("__h"), batch.column("__f")):
                if not h.is_valid or not len(h):
                    kept_texts.append(x)
                    n_lines.append(x.count("\n") + 1)
                    n_dropped.append(0)
                    continue
                pairs = np.stack((h.values.to_numpy(), f.values.to_numpy()), axis=1).astype("<i8").tobytes()
                gone = {pairs[i : i + 16] for i in range(0, len(pairs), 16)}
                lines, keys = line_keys(x, min_chars)
                kept = [line for line, key in zip(lines, keys) if key not in gone]
                kept_texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            return {text: kept_texts, "n_lines": n_lines, "n_dropped": n_dropped}

        return fn

    made = append_columns(joined, text, f"{text} string, n_lines bigint, n_dropped bigint", make)
    drop_cut(repeated)
    return made.select(*[c for c in df.columns if c.lower() not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
