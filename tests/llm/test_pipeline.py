"""The pipeline's stages on a small table."""

import random
import struct
import zlib

import pytest
from test_coding import ids_of
from test_dedup import brute_components, brute_lines
from test_judging import brute_counts, brute_llr, brute_redacted


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["river", "stone", "cloud", "light", "under", "house", "gold", "seven"]
    clean = lambda n: " ".join(rng.choice(words) + rng.choice("abcdefghijkl") + rng.choice("abcdefghijkl") for _ in range(n))
    docs = [(i, clean(300), "en", f"s{i % 3}", 0) for i in range(60)]
    near = docs[5][1].split(" ")
    near[140] = "changed"
    docs += [(60, " ".join(near), "en", "s0", 0), (61, docs[7][1] + "\npassword=abcdef123", "en", "s0", 0)]
    docs += [(62 + i, " ".join(f"{w}***%%%" for w in clean(300).split(" ")), "en", "s1", 0) for i in range(6)]
    docs += [(80, None, "en", "s1", 0), (81, "", "en", "s1", 0)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def brute_pipeline(docs, trusted):
    """{doc_id: text} before packing, by the plain versions of every stage."""
    rows = [(k, t) for k, t, *_ in docs]
    kept = []
    for k, t in rows:
        n, _, _, _, repeated = brute_counts(t or "")
        if n >= 50 and 100 * repeated <= 50 * n and brute_llr(rows, trusted, t) >= -0.6:
            kept.append((k, t))
    kept = [(k, text) for k, (text, _, _) in brute_lines(kept).items()]
    classes = brute_components(kept, 5, 80)
    return {k: brute_redacted(t) for k, t in kept if classes[k][2]}


def test_run_is_that_of_brute_force(spark, tables):
    from corpus_pipeline import run

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{tables}/labels.parquet").collect() if r.quality == 1}
    want = {k: [*ids_of(t), 0] for k, t in brute_pipeline(docs, trusted).items()}
    pieces = run(spark, tables).collect()
    held = {}
    for p in pieces:
        held.setdefault(p.sequence_id, []).append(p)
        own = want[p.doc_id]
        part = own[p.start : p.start + p.length]
        assert (p.doc_tokens, p.ids_crc32) == (len(own), zlib.crc32(struct.pack(f"<{len(part)}I", *part))) and len(part) == p.length
    for k, ids in want.items():
        own = sorted((p.start, p.length) for p in pieces if p.doc_id == k)
        assert [s for s, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) == len(ids)
    assert len(want) == len({p.doc_id for p in pieces})
    for own in held.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))] and sum(p.length for p in own) <= 1024


def test_stages(spark, tables):
    from corpus_pipeline import STAGES, run

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in STAGES:
        made = stage(spark, docs, tables)
        docs = spark.createDataFrame(made.collect(), made.schema)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == names
    ids = lambda name: sorted(r.doc_id for r in seen[name].select("doc_id").distinct().collect())
    assert ids("quality_rules") == list(range(62))
    assert ids("line_dedup") == list(range(62))
    assert {r.doc_id: r.text for r in seen["line_dedup"].collect()}[61] == "password=abcdef123"
    assert ids("near_dup") == [*range(60), 61]
    assert {r.doc_id: (r.text, r.n_chars) for r in seen["secrets"].collect()}[61] == ("[secret]", 8)
    assert ids("packing") == ids("secrets")
    totals = lambda df: {r.doc_id: r.n for r in df.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert totals(run(spark, tables)) == totals(seen["packing"])
