"""Near duplicates and line dedup against brute force."""

import random
import re
import string

import numpy as np
import pytest

from pyspark.sql import functions as F

from tempograph.llm import line_dedup, near_dup
from tempograph.llm._common import bitmap
from tempograph.llm._graph import components
from tempograph.llm.line_dedup import PerfectHash, drop_repeated_lines, salts_of
from tempograph.llm.near_dup import chunks_for, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_components(rows, size, percent):
    sets = {k: shingles(t, size) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k), find(k) == k) for k in keys}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_are_those_of_brute_force(docs, rows, size, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, shingle=size, percent=percent).collect()}
    assert got == brute_components(rows, size, percent)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(300):
        words = list(base)
        for _ in range(rng.choice([1, 2, 4, 5, 6])):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, shingle=3, percent=85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_copies_just_short_of_a_large_group_cost_few_tests(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(240):
        words = list(base)
        for at in rng.sample(range(0, 150, 4), 1 if k < 120 else 5):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    counts = []
    confirm = near_dup.confirm
    monkeypatch.setattr(near_dup, "confirm", lambda pairs, *more: (counts.append(pairs.count()), confirm(pairs, *more))[1])
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, shingle=3, percent=85).collect()}
    assert got == brute_components(rows, 3, 85)
    assert sum(counts) < 4 * len(rows)


def test_parity_sketches_rule_out_no_linked_sets():
    rng = np.random.default_rng(3)
    for n in (1, 3, 150, 3000):
        own = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for drop in (0, 1, n // 20, n // 5):
            other = np.unique(np.concatenate((own[drop:], rng.integers(0, 1 << 64, drop, np.uint64))))
            apart = int(np.bitwise_count((near_dup.parities(own) ^ near_dup.parities(other)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(own, other))


def test_near_duplicates_of_odd_tables(spark, nothing):
    assert near_duplicates(nothing).collect() == []
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(-1, None, True), (7, 7, True), (7, 7, True), (9, 9, True)] or got[1:] == [(7, 7, True), (7, 7, True), (9, 9, True)]


def test_a_repeated_id_is_linked_by_any_of_its_texts(spark):
    rng = random.Random(2)
    one, two, other = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(120)) for _ in range(3))
    near = lambda t: t.replace(t.split()[60], "changed")
    df = spark.createDataFrame([(5, one), (5, two), (8, near(one)), (9, near(two)), (4, other), (5, None)], "doc_id bigint, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_duplicates(df, shingle=3, percent=85).collect()}
    assert got == {(5, 118): 5, (8, 118): 5, (9, 118): 5, (4, 118): 4, (5, 0): 5}


def test_a_bucket_of_classes_that_stay_apart(spark):
    """Forms with one template and own words: most meet in the index, few are near copies."""
    rng = random.Random(6)
    template = [f"t{i}" for i in range(110)]
    made = [(k, " ".join(template + [f"own{rng.randrange(10**6)}" for _ in range(26)])) for k in range(120)]
    made += [(200 + k, made[k][1].replace(made[k][1].split()[-1], "other")) for k in range(0, 120, 7)]
    df = spark.createDataFrame(made, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, shingle=3, percent=85).collect()}
    assert got == brute_components(made, 3, 85)


def test_heavy_nodes_are_looked_up(spark, monkeypatch):
    monkeypatch.setattr("tempograph.llm._graph.HEAVY", 1)
    monkeypatch.setattr("tempograph.llm.near_dup.HEAVY", 1)
    monkeypatch.setattr("tempograph.llm.near_dup.GROUP", 2)
    edges = [(0, i) for i in range(1, 60)] + [(70, i) for i in range(71, 90)] + [(59, 70), (95, 96)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in [*range(60), *range(70, 90)]}, 95: 95, 96: 95}
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    made = [(k, " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(10**6)}" for w in base)) for k in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(made, "doc_id bigint, text string"), shingle=3, percent=85).collect()}
    assert got == brute_components(made, 3, 85)


def test_chunks_grow_with_the_error_share():
    assert chunks_for(0.8) > chunks_for(0.85) >= 2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(9, 9), (3, 2), (2, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 500 for i in range(500, 560)}, 2: 2, 3: 2}


def brute_lines(rows, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for k, t in rows:
        for line in {key(x) for x in (t or "").split("\n")}:
            if len(line) >= least:
                holders.setdefault(line, set()).add(k)
    out = {}
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(holders[key(x)]) > 1 and min(holders[key(x)]) != k)]
        out[k] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_lines_are_those_of_brute_force(docs, rows, nothing):
    out = drop_repeated_lines(docs)
    assert out.columns == ["doc_id", "text", "kept", "extra", "n_lines", "n_dropped"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out.collect()} == brute_lines(rows)
    assert drop_repeated_lines(nothing).collect() == []


def test_lines_of_repeated_and_null_ids(spark):
    line = "a line that is long enough"
    df = spark.createDataFrame([(1, line), (1, line), (2, line + "\nshort"), (None, line)], "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in drop_repeated_lines(df).collect()))
    assert got == [(0, line), (1, line), (1, line), (2, "short")]


@pytest.mark.parametrize("shard,target,probes,bits", [(7, 3, 2, 1 << 15), (1 << 18, 1 << 20, 4096, 1 << 26), (2, 1000, 1, 1 << 15)])
def test_lines_however_they_are_dealt(spark, monkeypatch, shard, target, probes, bits):
    for name, value in (("SHARD", shard), ("TARGET", target), ("PROBES", probes), ("FILTER", bits)):
        monkeypatch.setattr(line_dedup, name, value)
    rng = random.Random(3)
    pool = [f"line number {i} of the pool" for i in range(300)]
    made = [(i, "\n".join(["the line that all share", *(rng.choice(pool) for _ in range(rng.randrange(12)))])) for i in range(60)]
    made.append((60, "\n".join(pool * 40)))
    df = spark.createDataFrame(made, "doc_id bigint, text string").repartition(5)
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in drop_repeated_lines(df).collect()} == brute_lines(made)


def test_bitmap(spark):
    places = [0, 1, 7, 8, 32767, 32768, 40000, 65535, 40000]
    df = spark.createDataFrame([(p,) for p in places], "p int")
    bits = np.unpackbits(np.frombuffer(bitmap(df, F.col("p"), 1 << 16), np.uint8), bitorder="little")
    assert np.flatnonzero(bits).tolist() == sorted(set(places))


def test_salts_follow_the_load():
    assert salts_of({0: 5 << 20, 1: 10}, 2, 0.0, 1).tolist() == [5, 1] and salts_of({}, 1, 0.0, 6).tolist() == [6]


def test_megabyte_texts(spark):
    """Very long texts, one a near copy of the other and sharing all but one line with it."""
    rng = random.Random(11)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(12_000)]
    other = [*lines[:6000], "a line that no other text has", *lines[6001:]]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(other)), (3, "short")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    got = {r.doc_id: (r.text, r.n_dropped) for r in drop_repeated_lines(df).collect()}
    assert got[2] == ("a line that no other text has", 11_999) and got[1][1] == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64))
    index = PerfectHash.load(*PerfectHash(keys).dump())
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash(np.empty(0, np.uint64)).slots(keys[:3]).tolist() == [-1, -1, -1]
