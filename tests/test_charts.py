"""Charts, quantised notes, tuplets, downbeats and filters against plain versions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograph.operators import chart, downbeat, quantize, score


def brute_chart(chords, grid, origin, meters, finest, usable):
    """Cells (bar, offset, length, symbol, named) of chords (start, end, symbol) by walking along them."""
    meter_of = lambda bar: max(m for m in meters if m[0] <= bar)[1:]
    out = []
    if not usable:
        out = [(i, 0, meters[0][1], s) for i, (_, _, s) in enumerate(chords)]
    else:
        snap = lambda x: math.floor(Fraction(x - origin, grid) + Fraction(1, 2)) * grid
        at = []
        for i, (s, _, _) in enumerate(chords):
            at.append(max(0, snap(s)) if i == 0 else max(snap(s), at[-1] + grid))
        end = max(max(snap(e) for _, e, _ in chords), at[-1] + grid)
        bars, edge = [], 0
        while not bars or at[-1] >= edge or end > edge + meter_of(len(bars))[0] / 2:
            bars.append((edge, *meter_of(len(bars))))
            edge += bars[-1][1]
        spans = [(None, 0, at[0])] * (at[0] > 0) + [(c[2], a, z) for c, a, z in zip(chords, at, [*at[1:], edge])]
        for bar, (low, length, beats) in enumerate(bars):
            cells = [(max(a, low) - low, min(z, low + length) - max(a, low), s) for s, a, z in spans if a < low + length and z > low]
            if len(cells) > 1 and all(s is not None for *_, s in cells):
                best = None
                for slots in (n for n in range(1, beats + 1) if beats % n == 0 and length % (n * finest) == 0):
                    step, won, covered = length // slots, [], 0
                    for k in range(slots):
                        held = {}
                        for o, n, s in cells:
                            over = min(o + n, (k + 1) * step) - max(o, k * step)
                            if over > 0:
                                held[s] = held.get(s, 0) + over
                        won.append(max(held, key=held.get))
                        covered += max(held.values())
                    starts = [k for k in range(slots) if k == 0 or won[k] != won[k - 1]]
                    cost = round((length - covered) / length + 0.3 * (len(starts) - 1), 9)
                    if best is None or cost < best[0]:
                        best = cost, [(k * step, ((starts + [slots])[i + 1] - k) * step, won[k]) for i, k in enumerate(starts)]
                cells = best[1]
            out += [(bar, *c) for c in cells]
    return [(*c, i == 0 or c[3] != out[i - 1][3]) for i, c in enumerate(out)]


def test_charts_are_those_of_a_walk(spark):
    rng = random.Random(6)
    rows, facts, meters = [], {}, {}
    for rec in range(40):
        at = rng.randrange(0, 200)
        own = []
        for _ in range(rng.choice([1, 2, 5, 30])):
            length = rng.choice([1, 3, 16, 16, 32, 50, 64, 200])
            own.append((at, at + length, rng.choice("ABC")))
            at += rng.choice([0, 1, length, length])
        facts[rec] = (own, rng.choice([1, 4, 16]), rng.choice([0, 64]) if own[0][0] >= 64 else 0, rec % 7 != 0)
        meters[rec] = [(0, 64, 4)] + [(2, 48, 3)] * (rec % 2) + [(5, 96, 6)] * (rec % 3 == 0)
        rows += [(rec, i, *c, facts[rec][1], facts[rec][2], facts[rec][3]) for i, c in enumerate(own)]
    df = spark.createDataFrame(rows, "rec int, k int, s bigint, e bigint, symbol string, grid bigint, origin bigint, usable boolean")
    ms = spark.createDataFrame([(r, *m) for r, own in meters.items() for m in own], "rec int, start_bar bigint, length bigint, beats int")
    cells = chart.chart(df, ["rec"], ["s", "k"], "s", "e", "symbol", ms, F.col("origin"), F.col("grid"), F.col("usable"), 1)
    got = {}
    for r in cells.orderBy("rec", "bar", "offset").collect():
        got.setdefault(r.rec, []).append((r.bar, r.offset, r.length, r.symbol, r.named))
    assert got == {r: brute_chart(own, grid, origin, meters[r], 1, usable) for r, (own, grid, origin, usable) in facts.items()}
    sums = cells.groupBy("rec", "bar", "bar_length").agg(F.sum("length").alias("n")).collect()
    assert all(r.n == r.bar_length for r in sums)
    lines = chart.chart_text(cells.where("rec = 1"), ["rec"]).orderBy("line").collect()
    assert lines[0].text.startswith("| ") and lines[0].text.endswith("|")


def test_grid_of_the_closest_changes(spark):
    df = spark.createDataFrame([(1, 0), (1, 16), (2, 0), (2, 9), (3, 5), (3, 5), (4, 1)], "rec int, s bigint")
    assert {r.rec: r.grid for r in chart.grid_of_changes(df, ["rec"], "s", 16).collect()} == {1: 16, 2: 8, 3: 1, 4: 16}


@pytest.mark.parametrize("pole,block", [(0.45, 16), (0.9, 7), (0.99, 64), (0.45, 4096)])
def test_filters_by_blocks_are_those_of_a_loop(spark, pole, block):
    rng = np.random.default_rng(1)
    series = {k: rng.normal(size=n) for k, n in (("a", 300), ("b", 1), ("c", block), ("d", block + 1))}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "rec string, i bigint, x double").repartition(3)
    got = {(r.rec, r.i): r.y for r in downbeat.zero_phase(df, ["rec"], "i", "x", pole, block, out="y").collect()}

    def once(x):
        out, y = [], x[0]
        for v in x:
            y += (1 - pole) * (v - y)
            out.append(y)
        return np.array(out)

    for k, x in series.items():
        want = once(once(x)[::-1])[::-1]
        assert [got[k, i] for i in range(len(x))] == pytest.approx(want.tolist(), abs=1e-9)


def test_downbeats_weigh_harmony_over_accents(spark):
    beats = [("a", i, 1.0 if i % 4 == 3 else 0.0) for i in range(17)] + [("b", i, float(i % 4 == 1)) for i in range(12)] + [("c", 0, 1.0), ("c", 1, 3.0)] + [("d", i, 0.0) for i in range(9)]
    vectors = {"x": [1.0, 0.0], "y": [0.0, 1.0], "0": [0.0, 0.0]}
    spans = [("a", i, vectors["xy"[(i + 2) // 4 % 2]]) for i in range(16)] + [("d", i, vectors["0"]) for i in range(8)] + [("c", 0, vectors["x"])]
    b = spark.createDataFrame(beats, "rec string, i bigint, x double")
    s = spark.createDataFrame(spans, "rec string, i bigint, v array<double>")
    got = {r.rec: (r.phase, round(r.confidence, 6), r.harmonic) for r in downbeat.downbeat_phase(b, downbeat.novelty_at_beats(s, ["rec"], "i", "v"), ["rec"], "i", "x").collect()}
    assert got == {"a": (2, 0.6, True), "b": (1, 0.35, False), "c": (1, 0.35, False), "d": (0, 0.35, True)}


def test_combs(spark):
    df = spark.createDataFrame([("a", 7 * k + 3, 2.0) for k in range(10)] + [("a", 20, 0.5)] + [("b", 0, 1.0)], "rec string, t bigint, v double")
    got = {r.rec: (r.period, r.phase) for r in downbeat.comb(df, ["rec"], "t", "v", F.lit(70), [5, 6, 7, 8]).collect()}
    assert got == {"a": (7, 3), "b": (8, 0)}  # of equal sums, the comb with the fewest teeth gathers most a tooth


def test_changes_give_way_to_later_ones(spark):
    from tempograph.sources.midi import effective_meters

    rng = random.Random(3)
    cases = {k: sorted({rng.randrange(0, 40): rng.choice([2, 3, 4, 5]) for _ in range(rng.choice([1, 3, 8]))}.items()) for k in range(60)}
    df = spark.createDataFrame([(k, b, n) for k, own in cases.items() for b, n in own], "rec int, beat bigint, length bigint")
    got = {}
    for r in quantize.superseded_changes(df, ["rec"], "beat").collect():
        got.setdefault(r.rec, []).append((r.line, r.length))
    for k, own in cases.items():
        bars = effective_meters([(b, n, 4) for b, n in own])
        want, at = [(0, bars[0][1])], 0
        for (low, n, _), (high, m, _) in zip(bars, bars[1:]):
            at += (high - low) * n
            want.append((at, m))
        assert sorted(got[k]) == want
    with pytest.raises(Exception, match="more than 2 changes"):
        quantize.superseded_changes(spark.createDataFrame([(1, i, 3) for i in range(3)], "rec int, beat bigint, length bigint"), ["rec"], "beat", slots=2).collect()


@pytest.mark.parametrize("whole", [False, True])
def test_spans_in_order_are_those_of_a_walk(spark, whole):
    rng = random.Random(9)
    rows = []
    for rec in range(20):
        at = 0.0
        for k in range(12 if rec else 1):
            length = rng.choice([0.1, 0.4, 0.6, 1.0, 2.2])
            rows.append((rec, k, at, at + length))
            at += rng.choice([0.0, length, length + 0.3])
    df = spark.createDataFrame(rows, "rec int, k int, s double, e double")
    snap = lambda c: F.floor(F.col(c) + 0.5).cast("double")
    got = {(r.rec, r.k): (r.placed_start, r.placed_end) for r in quantize.placed_in_order(df, ["rec"], ["s", "e", "k"], snap("s"), snap("e"), whole).collect()}
    want = score.place_spans(df, "rec", "s", "e", lambda x: math.floor(x + 0.5), whole, ("k",))
    none = lambda x: None if x is None or x != x else x
    assert got == {(r.rec, r.k): (none(r.placed_start), none(r.placed_end)) for r in want.collect()}


def test_notes_take_the_grid_of_their_bar(spark):
    grids = spark.createDataFrame([("a", 0, 3), ("a", 1, 2), ("a", 2, 1)], "rec string, bar bigint, divisions int")
    notes = [("a", 0, 0.34, 0.66), ("a", 1, 3.95, 4.52), ("a", 2, 4.26, 4.9), ("a", 3, 8.1, 8.2), ("a", 4, 12.3, 14.0), ("a", 5, 3.9, 3.96)]
    df = spark.createDataFrame(notes, "rec string, k int, s double, e double")
    got = {r.k: (round(r.onset_beat, 6), round(r.length_beats, 6), round(r.step, 6)) for r in quantize.quantized_notes(df, grids, ["rec"], "s", "e", 4.0).collect()}
    third = round(1 / 3, 6)
    assert got == {0: (third, third, third), 1: (4.0, 0.5, 0.5), 2: (4.5, 0.5, 0.5), 3: (8.0, 1.0, 1.0), 4: (12.0, 2.0, 1.0), 5: (4.0, 0.5, 0.5)}


def test_brackets_cut_notes_into_exact_parts(spark):
    rows = [("a", 4, 4, 3, 1, 5), ("b", 4, 4, 6, 0, 24), ("c", 6, 8, 2, 1, 4), ("d", 4, 4, 4, 0, 4), ("e", 6, 8, 3, 0, 3), ("f", 4, 4, 3, 2, 2)]
    df = spark.createDataFrame(rows, "k string, num int, den int, divisions int, first bigint, last bigint")
    got = {}
    for r in quantize.bracket_fragments(df).orderBy("k", "bracket").collect():
        got.setdefault(r.k, []).append((r.bracket, r.within, r.steps, Fraction(r.written_num, r.written_den), r.tied, r.ratio))
    assert set(got) == {"a", "b", "c"}
    assert got["a"] == [(0, 1, 2, Fraction(1), True, "3/2"), (1, 0, 2, Fraction(1), False, "3/2")]
    assert len(got["b"]) == 8 and all(p[2:4] == (3, Fraction(3, 4)) for p in got["b"])
    assert got["c"] == [(0, 1, 1, Fraction(1, 2), True, "2/3"), (1, 0, 2, Fraction(1), False, "2/3")]


def test_scores_as_nested_rows(spark):
    """Two parts, a pickup, a change of meter, a chord with a tie, a triplet and a rest, written as MusicXML and read back."""
    from tempograph.operators import nested_score

    rows = [
        ("s", "b", 0, (0.0, 0), 0, 58, 768, False, True, 1.0, None, None),
        ("s", "b", 1, (0.0, 0), 0, 58, 3072, True, False, 4.0, None, None),
        ("s", "b", 1, (0.0, 0), 1, 61, 3072, False, False, 4.0, None, None),
        ("s", "b", 2, (0.0, 0), 0, None, 2304, False, False, 3.0, None, None),
        ("s", "a", 2, (1.0, 0), 0, 66, 256, False, False, 0.5, 3, 2),
        ("s", "a", 2, (0.0, 0), 0, None, 768, False, False, 1.0, None, None),
    ]
    notes = spark.createDataFrame(rows, "rec string, part string, bar bigint, at struct<b:double,v:int>, k int, midi int, ticks bigint, tie_in boolean, tie_out boolean, quarters double, actual int, normal int")
    meters = spark.createDataFrame([("s", 0, 4, 4, -2), ("s", 1, 4, 4, -2), ("s", 2, 3, 4, 1)], "rec string, bar bigint, num int, den int, fifths int")
    made = nested_score.score_xml(notes, meters, ["rec"], "part", F.lit(True))
    document = made.first().document
    assert document.count("<score-part ") == 2 and '_' not in document.split("<part-list>")[0].replace("_version", "")
    got = {(r.part, r.number): r for r in nested_score.read_score_xml(made, ["rec"]).collect()}
    assert set(got) == {("P1", 2), ("P2", 0), ("P2", 1), ("P2", 2)}
    assert [(got["P2", n].implicit, got["P2", n].beats, got["P2", n].fifths) for n in (0, 1, 2)] == [("yes", 4, -2), (None, None, None), (None, 3, 1)]
    low, high = got["P2", 1].note
    assert (low.pitch.step, low.pitch.alter, low.pitch.octave, low.chord, [t["_type"] for t in low.tie]) == ("B", -1, 3, None, ["stop"])
    assert (high.pitch.step, high.pitch.alter, high.tie) == ("D", -1, None) and high.chord is not None and high.type == "whole"
    rest, triplet = got["P1", 2].note
    assert rest.rest is not None and rest.pitch is None and rest.type == "quarter"
    assert (triplet.pitch.step, triplet.pitch.alter, triplet.duration, triplet.type) == ("F", 1, 256, "eighth")
    assert tuple(triplet["time-modification"]) == (3, 2)
    assert got["P2", 2].note[0].dot is not None and got["P2", 2].note[0].type == "half"
