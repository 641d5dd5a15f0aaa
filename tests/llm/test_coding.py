"""Packing, byte-level BPE and token files against the tokenizers library."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tempograph.llm import bpe, token_files
from tempograph.llm.bpe import Recent, bpe_decode, bpe_encode, distinct, encoder
from tempograph.llm.packing import PENALTY, best_cuts, candidates, pack_documents
from tempograph.llm.token_files import Table, decode_block, encode_block, read_token_files, scaled, token_file_path, word_encoder, write_token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(BYTE)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\x85\xa0\x1c aAbZ'séñß漢0½.!?_-😀\u0301ſ", max_size=30) | st.text(max_size=20))
def test_encoding_is_the_librarys(text):
    bpe = encoder(BYTE)
    for t in (text, text + "<|endoftext|>" + text, (text + " and ") * 400):
        ids = bpe.encode(t).tolist()
        assert ids == ids_of(t)
        assert bpe.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def pieces_of(text):
    bpe, raw = encoder(BYTE), text.encode()
    at = np.flatnonzero(bpe.cuts(raw, np.zeros(1, np.int64)))
    return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]


@pytest.mark.parametrize("text,most", [("ab1-" * 50_000, 2), ("漢字" * 50_000, 6), ("some words. " * 20, 6), ("short", 5), ("ünïcode\u3000ß", 9)])
def test_every_text_is_cut_where_no_token_reaches(text, most):
    bpe = encoder(BYTE)
    inside = {t[i : i + 2] for t in bpe.bytes_of for i in range(len(t) - 1)}
    pieces = pieces_of(text)
    assert b"".join(pieces) == text.encode() and max(map(len, pieces)) <= most
    ends = set(np.cumsum([len(w) for w, _ in bpe.pattern.pre_tokenize_str(text)]).tolist())  # a character of these stands for a byte
    at = 0
    for a, b in zip(pieces, pieces[1:]):
        at += len(a)
        assert at in ends or a[-1:] + b[:1] not in inside
    assert all(p in np.cumsum([0, *map(len, pieces)]) for p in list(ends)[:50])


def test_long_texts_are_encoded_in_blocks(monkeypatch):
    bpe = encoder(BYTE)
    texts = ["it's we'll ''s\n\n  x " * 300, "漢字テスト、" * 400, "é漢" * 900, "x" * 3000, " " * 900 + "a", "'s'll" * 500, "<|endoftext|>a" * 300, "ab1-" * 900]
    want = [ids_of(t) for t in texts]
    for block in (64, 333, 1000):
        monkeypatch.setattr("tempograph.llm.bpe.BLOCK", block)
        assert [bpe.encode(t).tolist() for t in texts] == want
    monkeypatch.undo()
    long = "One sentence of many, it's said. 漢字\n" * 60_000
    assert bpe.encode(long).tolist() == ids_of(long)


def test_memory_of_fragments_is_bounded_and_keeps_what_recurs():
    made = []
    recall = Recent(lambda keys: made.extend(keys) or [k.upper() for k in keys], 5)
    for i in range(40):
        keys = [b"often", b"x%d" % i, b"y%d" % i]
        assert recall(keys) == [k.upper() for k in keys]
        assert len(recall.young) <= 5 and len(recall.old) <= 5
    assert made.count(b"often") == 1 and recall([b"k%d" % i for i in range(9)])[8] == b"K8"


def test_broken_ids_decode_like_the_library():
    ids = [239, 120, 50256, 198, 17312]
    assert encoder(BYTE).decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_encode_and_decode_columns(spark, docs, rows, nothing):
    out = bpe_decode(bpe_encode(docs, BYTE), BYTE).collect()
    assert {(r.doc_id, tuple(r.ids), r.decoded, r.kept) for r in out} == {(k, tuple(ids_of(t)), t or "", "mine") for k, t in rows}
    assert bpe_encode(nothing, BYTE).collect() == []


def brute_force(at, penalty, size):
    best = [0.0] + [1e18] * (len(at) - 1)
    for j in range(1, len(at)):
        best[j] = min(best[i] + size - (at[j] - at[i]) + penalty[j] for i in range(j) if at[j] - at[i] <= size)
    return best[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0.0, 1.0, 3.0])), min_size=1, max_size=60))
def test_packing_is_optimal(steps):
    at, penalty = [0, *np.cumsum([s for s, _ in steps]).tolist()], [0.0, *(p for _, p in steps)]
    ends = best_cuts(at, penalty, 10)
    assert ends[-1] == len(at) - 1
    cost = sum(10 - (at[j] - at[i]) + penalty[j] for i, j in zip([0, *ends], ends))
    assert all(at[j] - at[i] <= 10 for i, j in zip([0, *ends], ends))
    assert cost == pytest.approx(brute_force(at, penalty, 10))


def test_whole_query_packs_at_the_least_cost(spark, rows):
    """The windows of one partition cost what the plain recurrence over all candidate cuts finds."""
    bpe = encoder(BYTE)
    pieces = pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), BYTE).collect()
    docs = [[*ids_of(t), 0] for _, t in rows]
    ends = np.cumsum([len(d) for d in docs])
    at, kind = candidates(np.concatenate(docs), ends, bpe.ends_sentence, bpe.opens_word)
    at, price = [0, *at.tolist()], [0.0, *np.array(PENALTY)[kind].tolist()]
    begins = dict(zip((k for k, _ in rows), [0, *ends.tolist()]))
    stops = {}
    for p in pieces:
        stops[p.sequence_id] = max(stops.get(p.sequence_id, 0), begins[p.doc_id] + p.start + p.length)
    chosen, paid = sorted(stops.values()), dict(zip(at, price))
    assert sum(1024 - (b - a) + paid[b] for a, b in zip([0, *chosen], chosen)) == pytest.approx(brute_force(at, price, 1024))


def test_pieces_cover_each_document_and_sequence(docs, rows, nothing):
    pieces = pack_documents(docs, BYTE).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for k, t in rows:
        own = sorted(by_doc[k], key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == np.array([*ids_of(t), 0], "<u4").tobytes()
        assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        assert {p.doc_tokens for p in own} == {len(ids_of(t)) + 1}
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        assert sum(p.length for p in own) <= 1024
    assert pack_documents(nothing, BYTE).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=700), st.integers(1, 9), st.integers(1, 9))
def test_blocks_round_trip(ids, lanes, steps):
    ids = np.array(ids, np.int64)
    table = Table(scaled(np.bincount(np.append(ids, 5), minlength=301)))
    assert decode_block(encode_block(ids, table, lanes, steps), table).tolist() == ids.tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\x0b\x85\xa0\x1c\x1f aAbZ'stmdrevlÉéßµÿªº²¼09.!?_-<|>", max_size=30) | st.text(max_size=20), max_size=5))
def test_words_are_encoded_as_by_the_library(texts):
    words, library = word_encoder(WORD), Tokenizer.from_file(WORD)
    got = [np.frombuffer(x, words.width).tolist() for x in words.encode_all(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_damage_is_noticed():
    ids = np.arange(1000) % 50
    table = Table(scaled(np.bincount(ids)))
    block = bytearray(encode_block(ids, table))
    block[60] ^= 1
    with pytest.raises(ValueError):
        decode_block(bytes(block), table)


def test_token_files_round_trip(spark, docs, rows, nothing):
    library = Tokenizer.from_file(WORD)
    path = token_file_path(spark)
    write_token_files(docs, WORD, path, end_id=2, parts=3)
    got = {r.doc_id: r for r in read_token_files(spark, path).collect()}
    at = 0
    for k, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].n_tokens, zlib.crc32(got[k].ids)) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert len(got) == len(rows)
    empty = token_file_path(spark)
    write_token_files(nothing, WORD, empty, end_id=2)
    assert read_token_files(spark, empty).collect() == []


def test_megabyte_texts(spark):
    """One very long text with blanks and one without, through packing, coding and token files."""
    long, solid = "One sentence of many, it is said. 漢字\n" * 40_000, "漢字テスト、" * 60_000
    df = spark.createDataFrame([(1, long), (2, "short"), (3, solid)], "doc_id bigint, text string")
    want = {1: ids_of(long), 2: ids_of("short"), 3: ids_of(solid)}
    coded = bpe_decode(bpe_encode(df, BYTE), BYTE).collect()
    assert all(r.ids == want[r.doc_id] and r.decoded == r.text for r in coded)
    sums = {r.doc_id: r.n for r in pack_documents(df, BYTE).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sums == {k: len(x) + 1 for k, x in want.items()}
    path = token_file_path(spark)
    write_token_files(df, WORD, path, end_id=2)
    library = Tokenizer.from_file(WORD)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in read_token_files(spark, path).collect()}
    assert got == {k: [*library.encode(t, add_special_tokens=False).ids, 2] for k, t in ((1, long), (2, "short"), (3, solid))}


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "z"), (1, "c d e"), (None, "c"), (None, None)], "doc_id bigint, text string")
    seen = []
    for order in ("text", F.desc("text")):
        path = token_file_path(spark)
        write_token_files(df.repartition(3).orderBy(order), WORD, path, end_id=2, parts=2)
        seen.append(sorted((r.start, r.n_tokens, bytes(r.ids)) for r in read_token_files(spark, path).collect()))
    assert seen[0] == seen[1] and sorted(n for _, n, _ in seen[0]) == [1, 2, 2, 3, 3, 4]
    assert pack_documents(df, BYTE).count() == 6


def test_distinct_fragments_by_hash_and_by_bytes(monkeypatch):
    raw = b"abc" + b"abc\x00" + b"abcdefgh" * 2 + b"x" * 17 + b"x" * 18 + b"abc" + b"x" * 17 + b"abcdefghi" + b"\x00" * 3
    sizes = [3, 4, 8, 8, 17, 18, 3, 17, 9, 1, 1, 1]
    at = np.cumsum([0, *sizes[:-1]])
    want = [raw[a : a + n] for a, n in zip(at, sizes)]
    for _ in range(2):
        number, first = distinct(raw, at, np.array(sizes))
        assert [want[first[k]] for k in number] == want and len(first) == len(set(want))
        monkeypatch.setattr(np, "unique", lambda x, *a, _u=np.unique, **k: _u(x % np.uint64(2) if x.dtype == np.uint64 else x, *a, **k))  # all hashes collide


def test_pieces_keep_apart_from_an_id_of_their_name(spark):
    df = spark.createDataFrame([(7, "some words here"), (8, None)], "start bigint, text string")
    out = pack_documents(df, BYTE, id_col="start")
    assert out.columns == ["start", "_start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    assert {(r["start"], r["_start"]) for r in out.collect()} == {(7, 0), (8, 0)}


def test_kinds_are_numbered_as_by_unique():
    x = np.random.default_rng(5).integers(0, 300, 4000).astype(np.uint64)
    number, first = bpe.numbered(x)
    _, want, inverse = np.unique(x, return_index=True, return_inverse=True)
    assert number.tolist() == inverse.tolist() and first.tolist() == want.tolist()


def test_colliding_hashes_fall_back_on_bytes(monkeypatch):
    numbered = bpe.numbered
    monkeypatch.setattr(bpe, "numbered", lambda x: numbered(x % np.uint64(2)))
    raw, at, size = b"abcabdabcab", np.array([0, 3, 6, 9]), np.array([3, 3, 3, 2])
    number, first = distinct(raw, at, size)
    assert [raw[at[first[k]] : at[first[k]] + size[first[k]]] for k in number] == [b"abc", b"abd", b"abc", b"ab"]


def test_words_that_recur_after_300000_others_are_merged_once():
    made = []
    recall = bpe.Recent(lambda keys: made.append(len(keys)) or keys, token_files.PLAIN)
    for at in [*range(0, 300_000, 50_000)] * 2:
        keys = [b"%d" % i for i in range(at, at + 50_000)]
        assert recall(keys) == keys
    assert sum(made) == 300_000
