"""Token-id files: static range ANS with shared frequency tables.

Format (one row of a Parquet file is one block; files follow in ascending id
order): a block holds whole documents.  Its tokens are laid out in ``segments``
of ``LANES`` interleaved coders, and each segment is a checkpoint: the header
gives the place in the word stream and the lanes' states there, so segments (and
blocks) decode independently and in parallel.  All blocks share one table of
symbol frequencies scaled to 2**BITS, stored beside them.  A block carries
CRC-32 sums of its stream and of its decoded ids; a reader raises on a mismatch.

Header, little-endian: magic ``rANS``, uint32 tokens, lanes, segments, steps a
segment, stream words; then uint32 words for each segment, uint64 states
(segments x lanes), the uint32 stream, uint32 CRC of all that precedes and
uint32 CRC of the ids.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempograph.llm._common import append_columns, cut, drop_cut, scratch, slices, texts
from tempograph.llm.bpe import LETTER, NUMBER, OTHER, SPACE, Memo, Merger, Recent, assembled, byte_chars, endings_apart, load_library

BITS, LANES, STEPS, BLOCK = 22, 128, 256, 1 << 18
#: Words of a generation that a worker remembers.
PLAIN = 400_000
LOW = np.uint64(1 << 31)
MAGIC = b"rANS"


# The characters of Latin-1 that the word pattern of the word-end vocabulary takes as white space; its other
# classes are letters, which make words, numbers, of which each is a word, and the rest, which make words too.
WHITE = "\t\n\x0b\x0c\r \x85\xa0"
CLASSES = np.array([SPACE if chr(b) in WHITE else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(b))[0], OTHER) for b in range(256)], np.uint8)


class WordBpe:
    """Encoder for a lower-casing word-end BPE file: white space is never part of a token, so words are encoded on their own.

    The words of all texts of a batch within Latin-1 are found together, by the classes of neighbouring characters, and
    new ones are merged together; up to twice ``PLAIN`` are remembered.  Other texts go to the tokenizers library, a chunk
    between blanks at a time, and these are remembered too.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added, model = spec.get("added_tokens", []), spec["model"]
        self.special = [x["content"] for x in added]
        self.size = 1 + max([*model["vocab"].values(), *(x["id"] for x in added)])
        end, steps = model.get("end_of_word_suffix"), [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.merger = None
        if end and steps == ["NFC", "Replace", "Lowercase"]:
            ids, chars = model["vocab"], byte_chars()
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            self.merger = Merger([(ids[a], ids[b], ids[a + b]) for a, b in pairs], self.size)
            self.first, self.last = (np.array([ids[chars[b] + tail] for b in range(256)], np.int32) for tail in ("", end))
        self.width = "<u2" if self.size <= 1 << 16 else "<u4"
        self.chunks = Memo(self._by_library)
        self.recall = Recent(lambda words: self.merger.merged([w.decode("latin-1").encode() for w in words], self.first, self.last), PLAIN)

    @cached_property
    def library(self):
        return load_library(self.path)

    def _by_library(self, chunk: str) -> bytes:
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, self.width).tobytes()

    def _latin(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each lower-cased text, in Latin-1."""
        joined = b" ".join(texts) + b" "
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        points = np.frombuffer(joined, np.uint8)
        kind = CLASSES[points]
        starts = np.empty(len(kind), bool)
        starts[0] = True
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        endings_apart(points, starts, np.zeros(len(kind), bool))  # a blank stands between texts
        at = np.flatnonzero(starts)
        size = np.diff(at, append=len(joined))
        words = kind[at] != SPACE
        ids, counts = assembled(joined, at[words], size[words], begins, self.recall, self.width)
        packed, ends = ids.tobytes(), (np.cumsum(counts) * ids.itemsize).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def encode_all(self, whole: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[bytes] = [b""] * len(whole)
        plain = []
        for i, text in enumerate(whole):
            if any(s in text for s in self.special):
                out[i] = self._by_library(text)
            elif self.merger and is_latin(text):
                plain.append((i, text.lower().encode("latin-1")))
            else:
                out[i] = b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))
        if plain:
            for (i, _), made in zip(plain, self._latin([t for _, t in plain])):
                out[i] = made
        return out


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_loaded: dict[str, WordBpe] = {}


def word_encoder(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies summing to 2**bits, at least 1 for each symbol that occurs."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, counts * (size / total)).astype(np.int64), 0)
    order = np.argsort(-freq, kind="stable")
    over = int(freq.sum()) - size
    at = 0
    while over > 0:  # rounding rare symbols up is paid by the frequent ones
        take = min(over, max(1, int(freq[order[at % len(order)]]) // 8), int(freq[order[at % len(order)]]) - 1)
        freq[order[at % len(order)]] -= take
        over -= take
        at += 1
    freq[order[0]] -= over
    return freq


class Table:
    """Coding tables from scaled frequencies."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.low = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, steps: int = STEPS) -> bytes:
    """One block of the file format."""
    n = len(ids)
    lanes = min(lanes, max(1, n))
    steps = min(steps, -(-n // lanes)) if n else 0
    segments = -(-n // (lanes * steps)) if n else 0
    padded = np.full(segments * steps * lanes, ids[-1] if n else 0, np.int64)
    padded[:n] = ids
    grid = padded.reshape(segments, steps, lanes)
    state = np.full((segments, lanes), LOW, np.uint64)
    sent, words = np.zeros(grid.shape, bool), np.zeros(grid.shape, np.uint32)
    shift, out = np.uint64(BITS), np.uint64(32)
    for t in range(steps - 1, -1, -1):
        freq, low = table.freq[grid[:, t]], table.low[grid[:, t]]
        full = state >= (freq << np.uint64(63 - BITS))
        sent[:, t], words[:, t] = full, state.astype(np.uint32)
        state = np.where(full, state >> out, state)
        whole = state // freq
        state = (whole << shift) + (state - whole * freq) + low
    stream = words[sent].astype("<u4")
    body = b"".join((struct.pack("<4s5I", MAGIC, n, lanes, segments, steps, len(stream)), sent.sum(axis=(1, 2)).astype("<u4").tobytes(), state.astype("<u8").tobytes(), stream.tobytes()))
    return body + struct.pack("<2I", zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes()))


def decode_block(block: bytes, table: Table) -> np.ndarray:
    """The block's ids as uint32; raises ValueError where a checksum differs."""
    magic, n, lanes, segments, steps, size = struct.unpack_from("<4s5I", block)
    body_crc, ids_crc = struct.unpack_from("<2I", block, len(block) - 8)
    if magic != MAGIC or zlib.crc32(memoryview(block)[:-8]) != body_crc:
        raise ValueError("the stored block is damaged")
    at = 24
    counts = np.frombuffer(block, "<u4", segments, at).astype(np.int64)
    state = np.frombuffer(block, "<u8", segments * lanes, at + 4 * segments).reshape(segments, lanes).astype(np.uint64)
    stream = np.append(np.frombuffer(block, "<u4", size, at + 4 * segments + 8 * segments * lanes), np.uint32(0)).astype(np.uint64)
    place = (np.cumsum(counts) - counts)[:, None]
    out = np.empty((segments, steps, lanes), np.uint32)
    mask, shift, word = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    for t in range(steps):
        slot = state & mask
        symbol = table.symbol[slot]
        out[:, t] = symbol
        state = table.freq[symbol] * (state >> shift) + slot - table.low[symbol]
        short = state < LOW
        ranks = np.cumsum(short, axis=1)
        fresh = stream[np.minimum(place + ranks - 1, size)]
        state = np.where(short, (state << word) | fresh, state)
        place = place + ranks[:, -1:]
    ids = out.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("the decoded ids don't match their checksum")
    return ids


BLOCKS = "part int, block bigint, tokens bigint, before bigint, doc_ids array<bigint>, doc_tokens array<bigint>, payload binary"


def tokenize(df: DataFrame, tokenizer: str, id_col: str, text: str, end_id: int | None, bounds: np.ndarray) -> DataFrame:
    """(id, number of the id's range, ids as packed little-endian integers) of every row; null ids go to the first range."""

    def make():
        bpe = word_encoder(tokenizer)
        tail = b"" if end_id is None else np.array([end_id], bpe.width).tobytes()

        def fn(batch):
            packed = [x + tail for x in bpe.encode_all(texts(batch, text))]
            ids = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            return {"packed": packed, "part": pa.array(np.searchsorted(bounds, ids, side="left"), pa.int32())}

        return fn

    return append_columns(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "text", "packed binary, part int", make).drop("text")


def count_symbols(tokens: DataFrame, width: str, size: int) -> DataFrame:
    """(symbol, n) over all rows; each task sends a row for each symbol at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("packed"):
                counts += np.bincount(np.frombuffer(x.as_buffer(), width), minlength=size) if len(x.as_buffer()) > size // 4 else 0
            small = b"".join(x.as_py() for x in batch.column("packed") if len(x.as_buffer()) <= size // 4)
            counts += np.bincount(np.frombuffer(small, width), minlength=size)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], names=["symbol", "n"])

    return tokens.select("packed").mapInArrow(run, "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n"))


def range_bounds(df: DataFrame, column: str, parts: int) -> np.ndarray:
    """Upper ends of about equally full ranges of an id, from a sketch over that column alone."""
    if parts <= 1:
        return np.empty(0)
    return np.unique(df.approxQuantile(column, [i / parts for i in range(1, parts)], 1 / (8 * parts)))


def write_token_files(df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text: str = "text", end_id: int | None = None, parts: int | None = None) -> None:
    """Writes every text's ids (and ``end_id``) under ``path``: ``blocks`` in ascending id order, and ``table``.

    The id is cast to bigint, which raises for a text that isn't a number.  A null text is an empty one.
    Rows that share an id (or have none) stand beside each other in the order of their ids' bytes, so the
    files are the same on every run.  Other columns aren't read.  An empty table writes no block.  The files are written by Spark's committer, so a lost executor leaves none in part.
    """
    spark = df.sparkSession
    ids = df.select(F.col(id_col).cast("bigint").alias("doc_id"))
    parts = parts or max(1, ids.rdd.getNumPartitions())
    tokens = cut(tokenize(df, tokenizer, id_col, text, end_id, range_bounds(ids, "doc_id", parts)), "tokens")
    bpe = word_encoder(tokenizer)
    width, size = bpe.width, max(bpe.size, 0 if end_id is None else end_id + 1)
    rows = count_symbols(tokens, width, size).collect()  # a row for each symbol of the vocabulary at most
    counts = np.zeros(size, np.int64)
    for r in rows:
        counts[r.symbol] = r.n
    freq = scaled(counts)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "symbol bigint, freq bigint").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)
    state: dict = {}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = state.setdefault("table", Table(shared.value))
        held, part, size_held, number, before = [], None, 0, 0, 0

        def flush():
            nonlocal held, size_held, number, before
            ids = np.frombuffer(b"".join(x for _, x in held), width).astype(np.int64)
            lengths = [len(x) // np.dtype(width).itemsize for _, x in held]
            row = (part, number, len(ids), before, [k for k, _ in held], lengths, encode_block(ids, table))
            held, size_held, number, before = [], 0, number + 1, before + len(ids)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], names=["part", "block", "tokens", "before", "doc_ids", "doc_tokens", "payload"])

        for whole in batches:
            for batch in slices(whole, "packed"):
                for p, k, x in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "packed"))):
                    if held and (p != part or size_held >= BLOCK * np.dtype(width).itemsize):
                        yield flush()
                    if p != part:
                        part, number, before = p, 0, 0
                    held.append((k, x))
                    size_held += len(x)
        if held:
            yield flush()

    ordered = tokens.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "packed")
    ordered.select("part", "doc_id", "packed").mapInArrow(encode, BLOCKS).write.parquet(f"{path}/blocks")
    drop_cut(tokens)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    table_rows = spark.read.schema("symbol bigint, freq bigint").parquet(f"{path}/table").collect()  # bounded by the vocabulary
    freq = np.zeros(1 + max((r.symbol for r in table_rows), default=0), np.int64)
    for r in table_rows:
        freq[r.symbol] = r.freq
    shared = spark.sparkContext.broadcast(freq)
    state: dict = {}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = state.setdefault("table", Table(shared.value))
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode_block(r["payload"], table)
                ends = np.cumsum(r["doc_tokens"])
                data = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends * 4)).astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())])
                starts = r["base"] + r["before"] + ends - np.array(r["doc_tokens"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(r["doc_tokens"], pa.int64()), data], names=["doc_id", "start", "n_tokens", "ids"])

    # A row for each part: few, however large the corpus.
    sums = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(bases), "part").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_file_path(spark: SparkSession) -> str:
    return scratch(spark, "token-files")
