"""Byte-level BPE encoding and decoding by forced boundaries.

A pair of bytes that lies inside no vocabulary token can never be merged, so it
marks a certain cut: the fragments on both sides are encoded on their own and
their ids concatenated.  The pairs are read off the vocabulary.  The word pattern
of byte-level BPE forces further cuts, which follow from the classes of
neighbouring characters (letter, number, white space, other).  Both kinds are found
for a whole slice of texts at once, in numpy, whatever their length and whether
they have blanks or not: a text without blanks is cut at its pairs.

Fragments are merged here: those of one length together, as rows of a matrix, in
which each round carries out the lowest-ranked merge of every row; fragments over
``WIDE`` bytes one by one with a heap.  Fragments recur, so a worker remembers up to
twice ``MEMO`` of them.  A text over ``BLOCK`` bytes is encoded in blocks that end at
certain cuts that the pattern cannot look across, so memory follows the block.

The classes of characters are asked of the tokenizers library, a character at a
time as they occur, so its Unicode version is followed.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tempograph.llm._common import append_columns

WIDE, MEMO, MEMO_BYTES, BLOCK = 32, 150_000, 8 << 20, 1 << 20
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
NEVER = np.iinfo(np.int32).max

# The pre-tokenizer that is followed, and the endings that its word pattern keeps together.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class Memo(dict):
    """A dict that computes missing entries and empties itself at ``most`` entries."""

    def __init__(self, make, most: int = 250_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


class Recent:
    """Results of a function of many distinct keys at once, remembered in two generations.

    When the younger one has ``most`` keys (or MEMO_BYTES of them) it becomes the older one, whose keys are forgotten
    unless they recur meanwhile; so what recurs stays, and memory is bounded.
    """

    def __init__(self, make, most: int):
        self.make, self.most = make, most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def __call__(self, keys: list[bytes]) -> list[bytes]:
        found = list(map(self.young.get, keys))
        missing = [k for k, v in zip(keys, found) if v is None] if None in found else []
        if self.young and (len(self.young) + len(missing) > self.most or self.size > MEMO_BYTES):
            self.old, self.young, self.size, missing = self.young, {}, 0, keys
        if missing:
            again = {k: self.old[k] for k in missing if k in self.old}
            fresh = [k for k in missing if k not in again] if again else missing
            self.young.update(again)
            self.young.update(zip(fresh, self.make(fresh)))
            self.size += sum(map(len, missing))
            found = list(map(self.young.__getitem__, keys))
        return found


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_library(path: str):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


class Merger:
    """Carries out listed merges: (left id, right id, merged id), the earliest in the list first, from the left."""

    def __init__(self, merges: list[tuple[int, int, int]], size: int):
        self.size = size
        self.made = np.array([m for _, _, m in merges], np.int32)
        keys = np.array([a * size + b for a, b, _ in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], -1), np.append(order, NEVER).astype(np.int32)
        self.width = "<u2" if size <= 1 << 16 else "<u4"

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, NEVER if it has none."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys[:-1], wanted)
        return np.where(self.keys[at] == wanted, self.ranks[at], NEVER)

    def rows(self, ids: np.ndarray) -> Iterable[tuple[np.ndarray, np.ndarray]]:
        """Fragments of one length (a row each): (row numbers, final ids) as they end."""
        number = np.arange(len(ids))
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1 and len(ids):
            at = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(ids)), at]
            on = lowest < NEVER
            if not on.all():
                yield number[~on], ids[~on]
                number, ids, ranks, at, lowest = number[on], ids[on], ranks[on], at[on], lowest[on]
                if not len(ids):
                    return
            row, length = np.arange(len(ids)), ids.shape[1] - 1
            column = np.arange(length)[None, :]
            ids[row, at] = self.made[lowest]
            ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            if length == 1:
                break
            column = column[:, : length - 1]
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), axis=1)
            left, right = at > 0, at < length - 1
            ranks[row[left], at[left] - 1] = self.rank(ids[row[left], at[left] - 1], ids[row[left], at[left]])
            ranks[row[right], at[right]] = self.rank(ids[row[right], at[right]], ids[row[right], at[right] + 1])
        yield number, ids

    def one(self, ids: np.ndarray) -> np.ndarray:
        """A long fragment, by a heap of its possible merges over a linked list."""
        own, after, before = ids.tolist(), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        ranks = self.rank(ids[:-1], ids[1:])
        there = np.flatnonzero(ranks < NEVER)
        heap = [(r, i, own[i], own[i + 1]) for r, i in zip(ranks[there].tolist(), there.tolist())]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def offer(i: int, j: int) -> None:
            pair = own[i], own[j]
            rank = known.get(pair)
            if rank is None:
                known[pair] = rank = int(self.rank(np.array(pair[:1]), np.array(pair[1:]))[0])
            if rank < NEVER:
                heapq.heappush(heap, (rank, i, *pair))

        end = len(own)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if own[i] != a or j >= end or own[j] != b:
                continue
            own[i], own[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return np.array([x for x in own if x >= 0])

    def merged(self, fragments: list[bytes], first: np.ndarray, last: np.ndarray | None = None) -> list[bytes]:
        """Packed ids of each fragment, whose bytes ``first`` maps to ids (the last byte of each: ``last``, if given)."""
        last = first if last is None else last
        out: list[bytes] = [b""] * len(fragments)
        lengths = defaultdict(list)
        for i, f in enumerate(fragments):
            lengths[len(f)].append(i)
        for length, own in lengths.items():
            if length > WIDE:
                for i in own:
                    symbols = np.frombuffer(fragments[i], np.uint8)
                    out[i] = self.one(np.append(first[symbols[:-1]], last[symbols[-1]])).astype(self.width).tobytes()
            elif length:
                symbols = np.frombuffer(b"".join([fragments[i] for i in own]), np.uint8).reshape(-1, length)
                for number, ids in self.rows(np.hstack((first[symbols[:, :-1]], last[symbols[:, -1:]]))):
                    packed, step = ids.astype(self.width).tobytes(), ids.shape[1] * int(self.width[2])
                    for k, i in enumerate(number.tolist()):
                        out[own[i]] = packed[k * step : (k + 1) * step]
        return out


MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each value's kind, and the place of each kind's first; np.unique() would sort stably, which takes longer."""
    order = np.argsort(x)
    ranked = x[order]
    opens = np.ones(len(x), bool)
    opens[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(opens) - 1
    return number, np.minimum.reduceat(order, np.flatnonzero(opens))


def distinct(joined: bytes, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For fragments that begin at ``at``, of these sizes: the number of each one's kind, and the place in ``at`` of each kind's first.

    Kinds are told apart by a hash of up to 16 bytes and the length; longer fragments, and all if two kinds' hashes
    should be equal, by their bytes.
    """
    words = np.ndarray(len(joined), "<u8", joined + bytes(16), 0, (1,))
    low = words[at] & MASKS[np.minimum(size, 8)]
    high = np.where(size > 8, words[np.minimum(at + 8, len(joined) - 1)], np.uint64(0)) & MASKS[np.clip(size - 8, 0, 8)]
    mixed = (low ^ low >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + (high ^ high >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    long = np.flatnonzero(size > 16)
    kinds: dict[bytes, int] = {}
    mixed[long] = [kinds.setdefault(joined[x : x + n], len(kinds)) for x, n in zip(at[long].tolist(), size[long].tolist())]
    number, first = numbered(mixed)
    own = first[number]
    if ((low == low[own]) & (high == high[own]) & (size == size[own])).all():
        return number, first
    kinds = {}
    number = np.array([kinds.setdefault(joined[x : x + n], len(kinds)) for x, n in zip(at.tolist(), size.tolist())])
    return number, np.unique(number, return_index=True)[1]


def assembled(joined: bytes, at: np.ndarray, size: np.ndarray, begins: np.ndarray, recall, width: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all fragments of texts that begin at ``begins``, and their number by text; ``recall`` gives those of distinct fragments."""
    if not len(at):
        return np.empty(0, width), np.zeros(len(begins), np.int64)
    number, first = distinct(joined, at, size)
    found = recall([joined[x : x + n] for x, n in zip(at[first].tolist(), size[first].tolist())])
    each = np.fromiter(map(len, found), np.int64, len(found)) // int(width[2])
    opens, count = np.cumsum(each) - each, each[number]
    upto = np.concatenate(([0], np.cumsum(count)))
    ids = np.frombuffer(b"".join(found), width)[np.repeat(opens[number] - upto[:-1], count) + np.arange(upto[-1])]
    return ids, np.diff(upto[np.append(np.searchsorted(at, begins), len(at))])


def endings_apart(points: np.ndarray, starts: np.ndarray, first: np.ndarray) -> None:
    """Keeps a quote that opens a piece together with the ending after it, and starts a piece after that.  ``first``: where texts begin."""
    quote = np.flatnonzero((points == 39) & starts)
    for ending in ENDINGS:
        at = quote[quote + len(ending) < len(points)]
        for k, c in enumerate(ending, 1):
            at = at[(points[at + k] == ord(c)) & ~first[at + k]]
        starts[at + 1] = False
        rest = at[at + len(ending) + 1 < len(points)]
        starts[rest + len(ending) + 1] = True


class ByteBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec.get("normalizer") or spec["pre_tokenizer"] != PRE_TOKENIZER or any(model.get(k) for k in ("dropout", "ignore_merges", "end_of_word_suffix", "continuing_subword_prefix")):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        back = {c: b for b, c in byte_chars().items()}
        raw = lambda token: bytes(back[c] for c in token)
        tokens = {raw(t): i for t, i in model["vocab"].items()}
        pairs = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.special = {x["content"].encode(): x["id"] for x in spec.get("added_tokens", [])}
        self.special_split = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.size = max([*tokens.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * (self.size + 1)  # the last for ids that the vocabulary lacks
        for t, i in [*tokens.items(), *self.special.items()]:
            self.bytes_of[i] = t
        self.merger = Merger([(tokens[a], tokens[b], tokens[a + b]) for a, b in pairs], self.size)
        self.first = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        #: Byte pairs inside some token, at 256 * first + second; all others are certain cuts.
        self.inside = np.zeros(1 << 16, bool)
        for t in tokens:
            self.inside[np.frombuffer(t[:-1], np.uint8).astype(np.int64) * 256 + np.frombuffer(t[1:], np.uint8)] = True
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.pattern = load_library(path).pre_tokenizer
        self.recall = Recent(lambda pieces: self.merger.merged(pieces, self.first), MEMO)
        #: Of each id: whether it ends a sentence, and whether it opens a word (white space first).
        self.ends_sentence = np.array([b.rstrip(b"\"')")[-1:] in (b".", b"!", b"?", b"\n") if b else False for b in self.bytes_of])
        self.opens_word = np.array([b[:1].isspace() for b in self.bytes_of])
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.lengths = np.array([len(b) for b in self.bytes_of])
        self.places = np.cumsum(self.lengths) - self.lengths

    def _class(self, char: str) -> int:
        split = lambda x: [p for p, _ in self.pattern.pre_tokenize_str(x)]
        around = split(f"1{char}a")
        if len(around) == 2 and char != " ":
            return NUMBER if len(around[1]) == 1 else LETTER
        return OTHER if len(split("!" + char)) == 1 else SPACE

    def _classes(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        if (found == UNKNOWN).any():
            for c in np.unique(points[found == UNKNOWN]).tolist():
                self.classes[c] = self._class(chr(c))
            found = self.classes[points]
        return found

    def word_starts(self, points: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Whether the word pattern starts a piece at each character; ``opens`` are the places where texts begin."""
        kind = self._classes(points)
        fresh = np.empty(len(points), bool)
        fresh[0] = True
        fresh[1:] = kind[1:] != kind[:-1]
        first = np.zeros(len(points), bool)
        first[opens] = True
        fresh |= first
        blank = kind == SPACE
        starts = fresh.copy()
        # The last of several blanks before a word goes its own way; a space is taken by the word after it.
        starts[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:]
        starts[1:] &= ~((points[:-1] == 32) & ~blank[1:] & ~first[1:])
        endings_apart(points, starts, first)
        return starts

    def cuts(self, joined: bytes, opens: np.ndarray) -> np.ndarray:
        """Whether a forced cut lies before each byte of texts that lie side by side and begin at ``opens``."""
        data = np.frombuffer(joined, np.uint8)
        forced = np.empty(len(data), bool)
        forced[0] = True
        forced[1:] = ~self.inside[data[:-1].astype(np.int32) * 256 + data[1:]]
        if joined.isascii():
            forced |= self.word_starts(data, opens)
        else:
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            points = np.frombuffer(joined.decode().encode("utf-32-le"), "<u4")
            forced[lead[self.word_starts(points, np.searchsorted(lead, opens))]] = True
        return forced

    def _short(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts side by side, and their number by part."""
        sizes = np.array([len(p) for p in parts], np.int64)
        begins = np.cumsum(sizes) - sizes
        joined = b"".join(parts)
        if not joined:
            return np.empty(0, self.merger.width), np.zeros(len(parts), np.int64)
        at = np.flatnonzero(self.cuts(joined, begins[sizes > 0]))
        return assembled(joined, at, np.diff(at, append=len(joined)), begins, self.recall, self.merger.width)

    def _blocks(self, part: bytes) -> Iterable[bytes]:
        """A text in blocks of about BLOCK bytes, cut where neither a merge nor the pattern reaches across."""
        at, size = 0, BLOCK
        while len(part) - at > size:
            block = part[at : at + size]
            last = len(block) - 1
            while block[last] & 0xC0 == 0x80:
                last -= 1
            block = block[:last]  # not inside a character
            data = np.frombuffer(block, np.uint8)
            sure = self.cuts(block, np.zeros(1, np.int64))
            sure[-8:] = False  # the pattern may look ahead
            sure &= (data & 0xC0) != 0x80
            sure[:4] = False
            for back in range(1, 4):
                sure[back:] &= data[:-back] != 39
            sure &= data != 39
            places = np.flatnonzero(sure)[::-1]
            for place in places.tolist():
                before = block[max(0, place - 4) : place].decode("utf-8", "ignore")[-1]
                if self._classes(np.array([ord(before)]))[0] != SPACE:
                    yield block[:place]
                    at, size = at + place, BLOCK
                    break
            else:
                size *= 2
        yield part[at:]

    def _part(self, part: bytes) -> tuple[np.ndarray, np.ndarray]:
        made = [self._short([b])[0] for b in self._blocks(part)]
        ids = np.concatenate(made)
        return ids, np.array([len(ids)])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts side by side (null: empty), and their number by text."""
        whole = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
        parts, owner = whole, np.arange(len(whole))
        if self.special and any(s in x for x in whole for s in self.special):
            split = [self.special_split.split(x) for x in whole]
            parts, owner = [p for x in split for p in x], np.repeat(owner, [len(x) for x in split])
        ids, counts, held, size = [np.empty(0, self.merger.width)], [], [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                for store, made in zip((ids, counts), self._short(held)):
                    store.append(made)
            held, size = [], 0

        for p in parts:
            if p in self.special or len(p) > BLOCK:
                flush()
                made = (np.array([self.special[p]], self.merger.width), np.ones(1, np.int64)) if p in self.special else self._part(p)
                ids.append(made[0])
                counts.append(made[1])
                continue
            held.append(p)
            size += len(p)
            if size > BLOCK:
                flush()
        flush()
        return np.concatenate(ids), np.bincount(owner, np.concatenate([np.zeros(0), *counts]), len(whole)).astype(np.int64)

    def encode(self, text: str) -> np.ndarray:
        """The text's ids."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids side by side; ids that the vocabulary lacks give nothing, broken UTF-8 U+FFFD."""
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        sizes = self.lengths[ids]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        places = np.repeat(self.places[ids] - upto[:-1], sizes) + np.arange(upto[-1])
        raw = self.flat[places].tobytes()
        ends = upto[np.cumsum(counts)].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]


_loaded: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """One encoder for each worker and file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def bpe_encode(df: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of every text as array<int>.  Null and empty texts give an empty array; a column of that name is replaced."""

    def make():
        bpe = encoder(tokenizer)

        def fn(batch):
            ids, counts = bpe.encode_all(batch.column(text))
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            return {out: pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))}

        return fn

    return append_columns(df, text, f"{out} array<int>", make)


def bpe_decode(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of every id array (special tokens included, broken UTF-8 as U+FFFD); null gives the empty text."""

    def make():
        bpe = encoder(tokenizer)

        def fn(batch):
            lists = batch.column(ids)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            return {out: bpe.decode_all(lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False), counts)}

        return fn

    return append_columns(df, ids, f"{out} string", make)
