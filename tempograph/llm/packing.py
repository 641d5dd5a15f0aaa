"""Order-preserving packing of documents into fixed windows by dynamic programming.

Each task packs the documents of its partition in their order, so nothing is
shuffled.  Documents are gathered into runs of about ``RUN`` tokens.  In a run,
candidate cuts are document ends, sentence ends and, at least every ``GRAIN``
tokens, word ends (inside a longer word: any token).  A window costs its padding
plus a truncation penalty for the kind of cut that ends it.  As the padding of a
window (i, j] is ``size - (j - i)``, the recurrence

    best[j] = penalty[j] + size - j + min(best[i] + i  for  j - size <= i < j)

takes its minimum from a monotone queue, in constant amortised time.  A document
longer than a run simply makes that run longer.

A null text counts as empty; an empty document is just its end token.  Repeated
rows and ids are packed as separate documents.  An empty table gives no pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tempograph.llm._common import slices, unused
from tempograph.llm.bpe import ByteBpe, encoder

RUN, GRAIN = 1 << 20, 12
#: Tokens of padding that a cut of each kind is worth: after a document, after a sentence, elsewhere.
PENALTY = (0.0, 16.0, 64.0)

PIECES = "start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def best_cuts(at: list[int], penalty: list[float], size: int) -> list[int]:
    """Indices of the candidate positions ``at`` (rising from 0, gaps of at most ``size``) at which the cheapest windows end."""
    best, back = [0.0], [0]
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # best + position, position, index; rising in the first
    for j in range(1, len(at)):
        here = at[j]
        low = here - size
        while queue[0][1] < low:
            queue.popleft()
        value, _, i = queue[0]
        cost = penalty[j] + size - here + value
        best.append(cost)
        back.append(i)
        key = cost + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    ends, j = [], len(at) - 1
    while j:
        ends.append(j)
        j = back[j]
    return ends[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, opens_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and kinds (0 document, 1 sentence, 2 other) of the cuts that the search considers."""
    kind = np.where(ends_sentence[ids], 1, 3).astype(np.int8)
    kind[:-1][(kind[:-1] == 3) & opens_word[ids[1:]]] = 2
    kind[doc_ends - 1] = 0
    at = np.flatnonzero(kind < 3) + 1
    kind = kind[at - 1]
    keep = (kind < 2) | (at // GRAIN != np.concatenate(([0], at[:-1])) // GRAIN)
    at, kind = at[keep], kind[keep]
    gaps = np.diff(at, prepend=0)
    if gaps.max() > 4 * GRAIN:  # inside a long word
        extra = np.concatenate([np.arange(at[i] - gaps[i] + GRAIN, at[i], GRAIN) for i in np.flatnonzero(gaps > 4 * GRAIN)])
        at, kind = np.concatenate((at, extra)), np.concatenate((kind, np.full(len(extra), 2, kind.dtype)))
        order = np.argsort(at, kind="stable")
        at, kind = at[order], kind[order]
    return at, kind


def pack_run(ids: np.ndarray, doc_ends: np.ndarray, bpe: ByteBpe, size: int) -> tuple[np.ndarray, ...]:
    """Pieces of a run: begin, end, document number, window number, window begin."""
    at, kind = candidates(ids, doc_ends, bpe.ends_sentence, bpe.opens_word)
    positions = [0, *at.tolist()]
    chosen = best_cuts(positions, [0.0, *np.array(PENALTY)[kind].tolist()], size)
    window_ends = np.array([positions[i] for i in chosen], np.int64)
    ends = np.union1d(window_ends, doc_ends)
    begins = np.concatenate(([0], ends[:-1]))
    window = np.searchsorted(window_ends, begins, side="right")
    return begins, ends, np.searchsorted(doc_ends, begins, side="right"), window, np.concatenate(([0], window_ends))[window]


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 0) -> DataFrame:
    """Packs every text (ids by the byte-level BPE file ``tokenizer``, then ``end_id``) into windows of at most ``size`` tokens.

    One row a piece: the id, ``start`` (the document's tokens before it), ``length``, ``doc_tokens``,
    ``sequence_id`` (partition number times 2**32 plus the window's number in it), ``offset`` in the
    sequence and ``ids`` (little-endian 32-bit).  Other columns of the input are not read.
    A column that would have the id's name gets an underscore before it.
    """
    docs = df.select(id_col, text)
    fields = [p.split() for p in PIECES.split(", ")]
    names = [id_col, *(unused(n, [id_col]) for n, _ in fields)]
    kind = docs.schema[id_col].dataType.simpleString()
    key = pa.schema(docs.select(id_col).limit(0).toArrow().schema).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        tail = np.array([end_id], bpe.merger.width)
        base, done = TaskContext.get().partitionId() << 32, 0
        keys, docs, total = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal done, keys, docs, total
            flat = np.concatenate(docs)
            doc_ends = np.cumsum([len(x) for x in docs])
            begins, ends, doc, window, opened = pack_run(flat, doc_ends, bpe, size)
            doc_begins = np.concatenate(([0], doc_ends[:-1]))
            sizes = np.diff(doc_ends, prepend=0)
            pieces = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends * 4)).astype(np.int32)), pa.py_buffer(flat.astype("<u4"))])
            out = [pa.array(keys, key).take(pa.array(doc)), begins - doc_begins[doc], ends - begins, sizes[doc], base + done + window, begins - opened]
            done += int(window[-1]) + 1
            keys, docs, total = [], [], 0
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in out] + [pieces], names=names)

        for whole in batches:
            for batch in slices(whole, text):
                ids, counts = bpe.encode_all(batch.column(text))
                for k, x in zip(batch.column(id_col).to_pylist(), np.split(ids, np.cumsum(counts)[:-1])):
                    keys.append(k)
                    docs.append(np.append(x, tail))
                    total += len(docs[-1])
                    if total >= RUN:
                        yield flush()
        if docs:
            yield flush()

    return docs.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, [kind, *(k for _, k in fields)])))
