"""Merkle manifest, prefix trie and mixing against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograph.llm.merkle import merkle_manifest
from tempograph.llm.mixing import hypergeometric, mix, mixed_documents
from tempograph.llm.prefix_trie import Louds, prefix_trie, rebuilt

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, pos int, node boolean"


def sha(data):
    return hashlib.sha256(data).hexdigest().encode()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(b"".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def encoded(x):
    return b"-" if x is None else b"%d:%s" % (len(str(x).encode()), str(x).encode())


def brute_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified) of rows of FIELDS."""
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, sha(b"".join(map(encoded, r))), r))
    names = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels_of([x[2] for x in sorted(by[k], key=lambda x: x[:3])]) for k in names}
    top = levels_of([trees[k][-1][0] for k in names])
    out = []
    for spot, k in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(by[k], key=lambda x: x[:3])):
            changed = list(r)
            if r[3] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                changed[3] += 1
            value, proof = sha(b"".join(map(encoded, changed))), b""
            for levels, at in ((trees[k], i), (top, spot)):
                for level in levels[:-1]:
                    pair = [value if j == at else level[j] for j in (at & ~1, at | 1) if j < len(level)]
                    proof += b"".join(level[j] for j in (at ^ 1,) if j < len(level))
                    value, at = sha(b"".join(pair)), at >> 1
            out.append((r[0], leaf.decode(), trees[k][-1][0].decode(), top[-1][0].decode(), sha(proof).decode(), value.decode(), value == top[-1][0]))
    return sorted(out, key=str)


def manifest(df, **kw):
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claims = {"n_chars": F.col("n_chars") + F.when(bad, 1).otherwise(0)}
    return sorted((tuple(r)[:7] for r in merkle_manifest(df, FIELDS, claims=claims, **kw).collect()), key=str)


@pytest.fixture(scope="module")
def odd_docs():
    rows = [(i, f"s{i % 3}", ["en", "é", None, "de"][min(i % 9, 3)], i * 7, f"text {i} ü") for i in range(60)]
    rows += [(None, None, None, None, None), (None, "s", "en", 3, ""), (7, "s", "en", 3, None), (7, "s", "en", 3, None), (7, "s", "en", 3, "other")]
    rows += [(100, "s", "lone", 1, "x" * 200_000), (101, "s", "", 2, ""), (14, None, "en", None, "nulls stay")]
    return rows


@pytest.mark.parametrize("block,top", [(4096, 16384), (4, 8), (2, 3)])
def test_manifests_are_those_of_brute_force(spark, odd_docs, block, top):
    df = spark.createDataFrame([(*r, "mine", 1, True) for r in odd_docs], DOCS).repartition(3)
    got = manifest(df, block=block, top=top)
    assert got == brute_manifest(odd_docs)
    assert {x[6] for x in got} == {True, False}


def test_siblings_prove_a_row(spark, odd_docs):
    df = spark.createDataFrame([(*r, "mine", 1, True) for r in odd_docs], DOCS)
    rows = merkle_manifest(df, FIELDS, proofs=True, block=4).collect()
    assert all(r.verified and hashlib.sha256("".join(r.siblings).encode()).hexdigest() == r.proof_sha256 for r in rows)


def test_manifests_of_no_rows_and_one(spark):
    assert manifest(spark.createDataFrame([], DOCS)) == []
    one = [(5, "a", None, 1, "b")]
    assert manifest(spark.createDataFrame([(*one[0], "mine", 1, True)], DOCS)) == brute_manifest(one)


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))  # SQL's remainder has the sign of c
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute_trie(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, sums = Counter(k[:-1] for k in members if k), defaultdict(lambda: [0, 0])
    for k, m in members.items():
        saved = (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            sums[k[:d]][0] += not children[k]
            sums[k[:d]][1] += saved
    out = []
    for k, m in members.items():
        ids = ",".join(map(str, sorted(ends[k])))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], *sums[k], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks():
    rows = []
    for c in range(0, 90):
        if c % 20 == 0 and c % 40:
            continue  # no first conversation for this group
        for t in range(1 + c % 5):
            rows.append((c, t, "user" if t % 2 == 0 else None, f"turn {t} of {c % 3}" if t < 3 else f"only \t {c}\x0b"))
    rows += [(c, t, "user", f"same {t}") for c in range(200, 230) for t in range(4)]
    rows += [(300, t, "user", "again and again") for t in range(150)]
    rows += [(301, t, "user", "again and again") for t in range(140)] + [(301, 140, "user", "fork")]
    rows += [(400, None, None, None), (400, 1, "", ""), (400, 1, "a", "b"), (400, 1, "a", "b"), (None, 0, "user", "nobody"), (-7, 0, "user", "minus"), (401, 0, "system", "w " * 30_000)]
    return rows


TALKS = "conv_id bigint, turn int, role string, text string, depth string, x1 int, size double"


@pytest.mark.parametrize("shard", [1 << 16, 20, 1])
def test_tries_are_those_of_brute_force(spark, talks, shard):
    df = spark.createDataFrame([(*r, "mine", 1, 0.5) for r in talks], TALKS).repartition(3)
    turns, conversations = rebuilt(df)
    got = sorted((tuple(r) for r in prefix_trie(turns, conversations, shard).collect()), key=str)
    assert got == brute_trie(brute_rebuilt(talks))


def test_tries_of_plain_turns(spark, talks):
    df = spark.createDataFrame([(*r, "mine", 1, 0.5) for r in talks if r[0] is not None and r[1] is not None and r[0] != 400], TALKS)
    plain = defaultdict(list)
    for c, t, r, x in sorted(r for r in ((c, t, r or "", x or "") for c, t, r, x in talks if c is not None and t is not None and c != 400)):
        plain[c].append((r, x))
    listed = spark.createDataFrame([(5000,), (None,), (5000,), (1,)], "conv_id bigint")
    assert sorted((tuple(r) for r in prefix_trie(df, listed).collect()), key=str) == brute_trie({**plain, 5000: []})
    assert sorted((tuple(r) for r in prefix_trie(df).collect()), key=str) == brute_trie(plain)


def test_tries_of_no_turns(spark):
    nothing = spark.createDataFrame([], TALKS)
    assert prefix_trie(*rebuilt(nothing)).collect() == []
    lonely = prefix_trie(nothing, spark.createDataFrame([(3,), (2,)], "conv_id bigint")).collect()
    assert [tuple(r)[:7] for r in lonely] == [(2, 0, None, 2, 0, 1, 0)]
    assert lonely[0].ends_sha256 == hashlib.sha256(b"2,3").hexdigest()


def test_louds_tells_parents_and_degrees():
    rng = np.random.default_rng(2)
    kind = [("d", "i8"), ("a", "i8"), ("b", "i8")]
    up = [-1, -1, *(int(rng.integers(0, i)) for i in range(2, 200))]
    depth = []
    for u in up:
        depth.append(1 if u < 0 else depth[u] + 1)
    key = np.array([(depth[i], i * 31, -i) for i in range(200)], kind)
    parent = np.array([(depth[i] - 1, u * 31, -u) if u >= 0 else (0, 9, 9) for i, u in enumerate(up)], kind)
    trie = Louds(np.array(depth), key, parent)
    assert trie.bits.sum() == 200 and (~trie.bits).sum() == 201
    back = {int(trie.order[i]): int(trie.order[p]) if p >= 0 else -1 for i, p in enumerate(trie.parents())}
    assert back == dict(enumerate(up))
    assert dict(zip(trie.order.tolist(), trie.degrees().tolist())) == {i: up.count(i) for i in range(200)}
    below = Counter()
    for i in range(200):
        while i >= 0:
            below[i] += 1
            i = up[i]
    assert dict(zip(trie.order.tolist(), trie.roll_up(np.ones(200)).tolist())) == dict(below)


def brute_targets(sizes, most=3):
    """Target of each source, by sharing again until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    out, opened = {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(out.values())
        over = [s for s in opened if left * weight[s] > most * sizes[s] * sum(weight[o] for o in opened)]
        if not over:
            return out | {s: left * weight[s] / sum(weight[o] for o in opened) for s in opened}
        out |= {s: most * sizes[s] for s in over}
        opened -= set(over)


MIXED = "doc_id bigint, source string, text string, size string, place int, taken boolean"


@pytest.fixture(scope="module")
def mixture():
    rows = [(i, f"s{i % 4}", " ".join(f"w{j}" for j in range(i % 37))) for i in range(240)]
    rows += [(1000 + i, "big", "a b\tc\x0bd\n" * 40) for i in range(60)]
    rows += [(2000, "tiny", "one two three"), (2001, "none", ""), (2002, "none", None), (2003, None, "no source"), (None, "s1", "no id"), (5, "s1", "w0 w1"), (5, "s1", "w0 w1"), (3000, "long", "long " * 30_000)]
    return rows


@pytest.mark.parametrize("block,shard,group", [(512, 4096, 1024), (16, 50, 3)])
def test_mixes_keep_their_promises(spark, mixture, block, shard, group):
    df = spark.createDataFrame([(*r, "mine", 1, True) for r in mixture], MIXED).repartition(3)
    docs, pieces = mix(df, block=block, shard=shard, group=group)
    docs, pieces = docs.collect(), pieces.collect()
    assert len(docs) == len(mixture)
    count = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in docs) == Counter((k, count(t)) for k, _, t in mixture)
    sizes = Counter()
    for _, s, t in mixture:
        sizes[s] += count(t)
    want = brute_targets(sizes)
    by_target = defaultdict(Counter)
    row = {r.row: r for r in docs}
    taken = Counter()
    for p in pieces:
        assert 0 <= p.start < p.start + p.length <= row[p.row]["size"]
        for w in range(p.start, p.start + p.length) if p.row in row and row[p.row]["size"] < 100 else ():
            by_target[p.row][w] += 1
        taken[p.row] += p.length
    assert all(max(c.values()) - (min(c.values()) if len(c) == row[k]["size"] else 0) <= 1 for k, c in by_target.items())
    assert all(n <= 3 * row[k]["size"] for k, n in taken.items())
    ids = {}
    for k, s, t in mixture:
        ids.setdefault((k, count(t)), s)
    shares = Counter()
    for k, r in row.items():
        s = ids[r.doc_id, r["size"]]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s]
        shares[s] += taken[k]
    assert all(abs(shares[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    places = defaultdict(Counter)
    for p in pieces:
        places[p.shard][p.place] += p.length
    assert all(n <= block for c in places.values() for n in c.values())
    assert max(map(len, places.values())) - min(map(len, places.values())) <= 1 and max(map(len, places.values())) <= shard
    assert len({x for c in places.values() for x in c}) == sum(map(len, places.values()))


def test_mixes_agree_however_rows_are_dealt(spark, mixture):
    df = spark.createDataFrame([(*r, "mine", 1, True) for r in mixture], MIXED)
    one, two = (sorted((tuple(r) for r in mixed_documents(x, block=16, shard=30).collect()), key=str) for x in (df.repartition(5), df.coalesce(1)))
    assert one == two


def test_mixes_of_nothing(spark):
    assert mixed_documents(spark.createDataFrame([], MIXED)).collect() == []
    got = mixed_documents(spark.createDataFrame([(1, None, None, "", 0, False), (2, "a", " ", "", 0, False)], MIXED)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


@pytest.mark.parametrize("n,k,d", [(50, 20, 25), (1000, 3, 500), (300, 290, 100), (10, 10, 4), (7, 0, 3)])
def test_draws_are_hypergeometric(spark, n, k, d):
    rows = 4000
    u = (F.col("id") + 0.5) / rows
    got = Counter(r.x for r in spark.range(rows).select(hypergeometric(F.lit(n).cast("bigint"), F.lit(k).cast("bigint"), F.lit(d).cast("bigint"), u).alias("x")).collect())
    for x in range(0, k + 1):
        p = comb(k, x) * comb(n - k, d - x) / comb(n, d) if 0 <= d - x <= n - k else 0
        assert abs(got[x] / rows - p) <= 2 / rows
    assert sum(got.values()) == rows
