"""Queries against the whole job, on tables where a cut would show."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import rows

from tempograph.functions import theory
from tempograph.operators import signal
from tempograph.plans.bindings import ORIGIN
from tempograph.plans.event_queries import hourly
from tempograph.queries import ORACLES, QUERIES
from tempograph.sources import midi


def saved(folder, name, sql):
    duckdb.sql(f"copy ({sql}) to '{folder}/{name}.parquet' (format parquet)")


def whole_sql(folder, name, tables):
    """The result of the registered SQL over these tables."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet(['{folder}/{t}.parquet', '{folder}/{t}.parquet/*.parquet'][{1 + os.path.isdir(f'{folder}/{t}.parquet')}])")
    return con.sql(ORACLES[name]).df()


def test_syllables_of_whole_texts(spark, tmp_path):
    saved(tmp_path, "documents", "select 1 as doc_id, repeat('banana stone ', 100) || 'ending' as text union all select 2, repeat('x', 398) || 'apple tree'")
    got = QUERIES["syllables"](spark, str(tmp_path)).toPandas()
    assert len(got) == 203 and got[got.doc_id == 1].syllables.tolist() == [3, 1] * 100 + [2]
    assert rows(got) == rows(whole_sql(tmp_path, "syllables", ["documents"]))


def test_nnls_activations_of_all_frames(spark, tmp_path):
    np = pytest.importorskip("numpy")
    from tempograph.plans.vector_queries import _nnls_dictionary

    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(size=64).round(3) for i in (0, 99, 100, 101, 5000)}
    spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in vectors.items()], "vec_id bigint, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.frame, r.note): r.activation for r in QUERIES["nnls_activations"](spark, str(tmp_path)).collect()}
    a = _nnls_dictionary()
    assert len(got) == len(vectors) * a.shape[1]
    for i, v in vectors.items():
        x = np.zeros(a.shape[1])
        for _ in range(3000):  # coordinate descent
            for k in range(len(x)):
                x[k] = max(0, x[k] + a[:, k] @ (abs(v) - a @ x) / (a[:, k] @ a[:, k]))
        assert [got[i, k] for k in range(len(x))] == pytest.approx(x.tolist(), abs=1e-5)


def events(spark, folder, rows):
    """(user, id, midi) as notes of an hour, one after another."""
    e = spark.createDataFrame([(u, i, 1_704_067_200 + 60 * i, 3.0, f'{{"k": {k}}}', "view") for u, i, k in rows], "user_id bigint, event_id bigint, s bigint, value double, props string, event_type string")
    e.selectExpr("user_id", "event_id", "cast(timestamp_seconds(s) as timestamp_ntz) as ts", "event_type", "value", "props").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_cheapest_region_over_all_notes(spark, tmp_path):
    folder = events(spark, tmp_path, [(1, i, (6, 1, 8, 3, 10)[i % 5]) for i in range(1, 40)] + [(2, 41, 0), (2, 42, 7)] + [(3, 5 * i, i) for i in range(20, 30)])
    got = QUERIES["cheapest_region"](spark, folder).toPandas()
    assert sorted(got.rec) == [1, 2, 3]
    assert rows(got) == rows(whole_sql(folder, "cheapest_region", ["events"]))


def test_transpose_keeps_high_notes_and_reports_left_out_tracks(spark, tmp_path):
    folder = events(spark, tmp_path, [(1, 1, 60), (1, 2, 99), (1, 3, 120), (2, 4, 121), (2, 5, 60)])
    frame = QUERIES["transpose"](spark, folder)
    assert rows(frame.toPandas()) == rows(whole_sql(folder, "transpose", ["events"]))
    got = sorted(frame.select("rec", "event_id", "moved", "name").collect())
    assert [tuple(r) for r in got] == [(1, 1, 67, "G"), (1, 2, 106, "A#"), (1, 3, 127, "G"), (2, None, None, None)]


def test_transpose_without_left_out_tracks(spark, tmp_path):
    folder = events(spark, tmp_path, [(i % 3, i, i) for i in range(1, 100)])
    got = QUERIES["transpose"](spark, folder).toPandas()
    assert len(got) == 99 and rows(got) == rows(whole_sql(folder, "transpose", ["events"]))


def tag(n):
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def test_letters_of_any_index(spark):
    at = [0, 25, 26, 701, 702, 703, 5000, 18277, 18278, 475253, 475254, 12356629, 12356630, 2**31 - 1, 2**31, 2**63 - 1]
    got = spark.createDataFrame([(i,) for i in [*at, None]], "i bigint").select("i", theory.letters(F.col("i")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: tag(i) for i in at} | {None: None}


def test_line_repeat_tags_beyond_two_letters(spark, tmp_path):
    lines = [f"line {i}" for i in range(6000)]
    spark.createDataFrame([(1, "\n".join([*lines, "once", *lines]))], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = QUERIES["line_repeat_tags"](spark, str(tmp_path))
    assert rows(frame.toPandas()) == rows(whole_sql(tmp_path, "line_repeat_tags", ["documents"]))
    got = {r.pos: r.tag for r in frame.collect()}
    assert got == {6000: None} | {i: tag(i) for i in range(6000)} | {6001 + i: tag(i) for i in range(6000)}


def test_hours_are_those_of_the_table(spark, tmp_path):
    counts = {-30: 2, -29: 1, 0: 4, 3: 1, 719: 3, 720: 5, 800: 2, 830: 6}
    stamps = [(1_704_067_200 + 3600 * h + i, 1) for h, n in counts.items() for i in range(n)]
    e = spark.createDataFrame(stamps, "s bigint, user_id bigint").selectExpr("user_id", "s as event_id", "cast(timestamp_seconds(s) as timestamp_ntz) as ts", "'view' as event_type", "1.0D as value", "'{}' as props")
    e.write.parquet(f"{tmp_path}/events.parquet")
    for name in ("autocorrelation", "tempo_estimate", "beat_dp"):
        assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(whole_sql(tmp_path, name, ["events"]))
    got = {r.lag: r.acf for r in QUERIES["autocorrelation"](spark, str(tmp_path)).collect()}
    assert got == {k: pytest.approx(sum(n * counts.get(h + k, 0) for h, n in counts.items()) / 861, abs=1e-6) for k in range(49)}
    assert len(QUERIES["tempo_estimate"](spark, str(tmp_path)).collect()) == 1
    assert all(-30 <= r.h <= 830 for r in hourly(spark, str(tmp_path)).collect()) and hourly(spark, str(tmp_path)).count() == 861


def test_placed_notes_are_those_of_brute_force(spark, tmp_path):
    rng = random.Random(7)
    table = [(rng.randrange(3), i, rng.randrange(0, 90_000_000_000, 600_000_000), rng.choice([1, 2, 5, 9])) for i in range(200)]
    table += [(1, 300 + i, 7_200_000_000, 3) for i in (5, 1, 3)]  # equal spans: the lowest id is placed
    e = spark.createDataFrame([(u, i, s, n / 1.0) for u, i, s, n in table], "user_id bigint, event_id bigint, s bigint, value double")
    e.selectExpr("user_id", "event_id", f"cast(timestamp_micros({ORIGIN} + s) as timestamp_ntz) as ts", "'view' as event_type", "value", "'{\"k\": 1}' as props").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.rec, r.placed_start, r.placed_end) for r in QUERIES["placed_notes"](spark, str(tmp_path)).collect()}
    want, furthest = {}, {}
    for u, i, s, n in sorted(table, key=lambda x: (x[2], x[3], x[1])):
        a, z = (math.floor(x / 3.6e9 + 0.5) for x in (s, s + n * 100 * 12_000_000))
        a = max(a, furthest.get(u, a))
        want[i] = (u, a, z) if z > a else (u, None, None)
        if z > a:
            furthest[u] = z
    assert got == want and {None, int} == {type(x[1]) if x[1] is not None else None for x in want.values()}
    for name in ("placed_notes", "placed_spans"):
        assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(whole_sql(tmp_path, name, ["events"]))


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def orders(spark, folder, rows):
    """(customer, order, day) as orders."""
    o = spark.createDataFrame(rows, "o_custkey bigint, o_orderkey bigint, day int")
    o.selectExpr("o_custkey", "o_orderkey", "cast(timestamp_seconds(day * 86400L) as timestamp_ntz) as o_orderdate").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_tempi_of_many_customers_read_each_file_once(spark, tmp_path):
    rng = random.Random(3)
    folder = orders(spark, tmp_path, [(i % 400, i, 10_000 + rng.choice([0, 0, 1, 7, 300, 90_000])) for i in range(2000)])
    frame = QUERIES["midi_tempi"](spark, folder)
    assert rows(frame.toPandas()) == rows(whole_sql(folder, "midi_tempi", ["orders"]))
    plan = plan_of(frame)
    assert plan.count("MapIn") == 1 and "FlatMapGroups" not in plan  # no Python call for a file, none read twice


def test_files_of_meta_events_are_those_of_the_writer(spark):
    rng = random.Random(5)
    table = [(r, rng.choice([0, 5, 127, 128, 16_384, 2_097_152, 1 << 28, 1 << 36]), i, rng.choice([1, 0x51, 0x58, 255]), bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 3, 127, 128, 20_000])))) for r in range(20) for i in range(rng.randrange(1, 12))]
    got = midi.meta_files(spark.createDataFrame(table, "rec int, tick bigint, seq int, kind int, data binary")).collect()
    want = {r: midi.midi_bytes([[(t, midi.meta(k, d)) for _, t, _, k, d in sorted((e for e in table if e[0] == r), key=lambda e: e[1:3])]], midi.EXPORT_QUARTER) for r in range(20)}
    assert {r.rec: bytes(r.content) for r in got} == want
    for bad in ((1, -1, 1, 3, b"x"), (1, 0, 1, 256, b"x"), (1, 0, 1, 3, None)):
        with pytest.raises(Exception, match="a file can't hold"):
            midi.meta_files(spark.createDataFrame([bad], "rec int, tick bigint, seq int, kind int, data binary")).collect()


def test_tempi_hold_120_before_the_first(spark):
    event = "path string, division int, track int, tick bigint, seq int, kind string, channel int, d1 int, d2 int, meta binary"
    tempo = lambda us: (-1, 0x51, 0, us.to_bytes(3, "big"))
    table = [("late", 480, 0, 960, 1, "META", *tempo(250_000)), ("late", 480, 0, 1440, 2, "META", *tempo(1_000_000))]  # nothing else in the file
    table += [("none", 480, 0, 7, 1, "ON", 0, 60, 80, b""), ("short", 480, 0, 5, 1, "META", -1, 0x51, 0, b"ab")]
    table += [("same", 100, 0, 0, 1, "META", *tempo(300_000)), ("same", 100, 1, 0, 1, "META", *tempo(400_000)), ("same", 100, 0, 0, 2, "META", *tempo(500_000)), ("same", 100, 0, 50, 3, "OFF", 0, 1, 0, b""), ("same", 100, 0, 200, 4, "META", *tempo(600_000))]
    got = sorted(map(tuple, midi.midi_tempi(spark.createDataFrame(table, event)).collect()))
    assert got == [("late", 0.0, 120.0, 0.0), ("late", 2.0, 240.0, 1.0), ("late", 3.0, 60.0, 1.25), ("none", 0.0, 120.0, 0.0), ("same", 0.0, 150.0, 0.0), ("same", 2.0, 100.0, 0.8), ("short", 0.0, 120.0, 0.0)]
    with pytest.raises(Exception, match="a tempo of zero"):
        midi.midi_tempi(spark.createDataFrame([("z", 480, 0, 0, 1, "META", *tempo(0))], event)).collect()


def test_meters_of_many_customers_read_each_file_once(spark, tmp_path):
    rng = random.Random(6)
    folder = orders(spark, tmp_path, [(i % 300, i, 10_000 + rng.choice([0, 0, 2, 400])) for i in range(3000)])
    frame = QUERIES["midi_meters"](spark, folder)
    assert rows(frame.toPandas()) == rows(whole_sql(folder, "midi_meters", ["orders"]))
    assert plan_of(frame).count("MapIn") == 1 and "FlatMapGroups" not in plan_of(frame)
    assert "SortAggregate" not in frame._jdf.queryExecution().executedPlan().toString()  # the last meter of a tick is found by hashing


def test_clicks_of_a_tempo_are_made_once(spark, tmp_path):
    saved(tmp_path, "supplier", "select cast(i as bigint) as s_suppkey from range(-40, 700) t(i)")
    frame = QUERIES["click_track"](spark, str(tmp_path))
    assert "Aggregate [bpm" in plan_of(frame)
    assert rows(frame.toPandas()) == rows(whole_sql(tmp_path, "click_track", ["supplier"]))


def test_beats_of_a_tempo_are_tracked_once(spark, tmp_path):
    saved(tmp_path, "supplier", "select cast(i * 7 as bigint) as s_suppkey from range(300) t(i)")
    frame = QUERIES["audio_beats"](spark, str(tmp_path))
    assert "Aggregate [bpm" in plan_of(frame)
    assert rows(frame.toPandas()) == rows(whole_sql(tmp_path, "audio_beats", ["supplier"]))


def test_resampling_down_smooths_once(spark):
    rng = random.Random(8)
    made = [[rng.uniform(-1, 1) for _ in range(n)] for n in [0, 1, 2, 3, 64, 5001, *[63] * 20]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*made, None, [1.0, None, 2.0], [float("nan"), 1.0, 2.0]])], "i int, x array<double>")
    frame = df.select("i", signal.resample(F.col("x"), 3, 2).alias("y"))
    assert "aggregate(" not in plan_of(frame)
    got = {r.i: r.y for r in frame.collect()}
    pole = math.exp(-2 * math.pi * 0.45 * 2 / 3)
    for i, x in enumerate(made):
        for _ in range(2):
            x = list(x)
            for k in range(1, len(x)):
                x[k] = x[k - 1] + (1 - pole) * (x[k] - x[k - 1])
            x = x[::-1]
        p = [k * 1.5 for k in range(int(len(x) * (2 / 3)))]
        at = lambda k: x[min(k, len(x) - 1)]  # noqa: E731, B023
        assert got[i] == pytest.approx([at(int(q)) + (q - int(q)) * (at(int(q) + 1) - at(int(q))) for q in p], abs=1e-12)
    n = len(made)
    assert got[n] == [] and got[n + 1] == [None, None] and all(map(math.isnan, got[n + 2])) and len(got[n + 2]) == 2
