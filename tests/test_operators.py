"""Operators against slow versions on seeded random input, and round trips."""

import io
import math
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograph.functions import theory
from tempograph.functions import vectors as V
from tempograph.operators import audio_chain, harmony, meter, notation, score, signal, temporal
from tempograph.sources import audio, midi, score_json, text_charts, workspace


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("seed", [1, 2])
def test_asof_nearest_and_intervals(spark, seed):
    rng = random.Random(seed)
    probes = [(rng.randrange(3), i, rng.randrange(5, 60)) for i in range(80)]
    build = [(rng.randrange(3), 100 + i, rng.randrange(5, 60)) for i in range(40)]
    p, b = frame(spark, probes, "k int, id int, t int"), frame(spark, build, "k int, hit int, s int")
    back = {r.id: r.hit for r in temporal.asof_join(p, b, ["k"], "t", "s", ["hit"], ["hit"]).collect()}
    clamp = {r.id: r.hit for r in temporal.asof_join(p, b, ["k"], "t", "s", ["hit"], ["hit"], clamp=True).collect()}
    ahead = {r.id: r.hit for r in temporal.asof_join(p, b, ["k"], "t", "s", ["hit"], ["hit"], "forward").collect()}
    near = {r.id: r.s for r in temporal.nearest_join(p, b, ["k"], "t", "s", ["hit"], ["s"]).collect()}
    for k, i, t in probes:
        own = [(s, h) for kk, h, s in build if kk == k]
        before, after = [x for x in own if x[0] <= t], [x for x in own if x[0] >= t]
        assert back[i] == (max(before)[1] if before else None)
        assert clamp[i] == (max(before)[1] if before else min(own)[1] if own else None)
        assert ahead[i] == (min(after)[1] if after else None)
        assert near[i] == (min(own, key=lambda x: (abs(x[0] - t), x[0]))[0] if own else None)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlap_and_bass_line(spark, seed):
    rng = random.Random(seed)
    notes = [(rng.randrange(2), i, a := rng.randrange(7, 90), a + rng.randrange(0, 30), rng.randrange(30, 50)) for i in range(40)]
    n = frame(spark, notes, "k int, id int, a int, z int, v int")
    other = n.select("k", F.col("id").alias("jd"), F.col("a").alias("b"), F.col("z").alias("y"))
    got = {(r.id, r.jd) for r in temporal.overlap_join(n, other, ["k"], ("a", "z"), ("b", "y"), 10, 3).collect()}
    assert got == {(i, j) for k, i, a, z, _ in notes for kk, j, b, y, _ in notes if k == kk and a < z and b < y and a < y and b < z}
    line = temporal.lowest_line(n, ["k"], "a", "z", "v", 10).collect()
    for k in (0, 1):
        for t in range(7, 121):
            sounding = [v for kk, _, a, z, v in notes if kk == k and a <= t < z]
            steps = [r for r in line if r.k == k and r.from_at <= t < r.to_at]
            assert (steps[0].low if steps else None) == (min(sounding) if sounding else None)


@pytest.mark.parametrize("seed", range(4))
def test_fifo_pairs(spark, seed):
    rng = random.Random(seed)
    events = [(i, rng.choice(["on", "off"])) for i in range(60)]
    got = {r.on_at: r.off_at for r in temporal.fifo_pairs(frame(spark, [(1, *e) for e in events], "k int, t int, e string"), ["k"], ["t"], F.col("e") == "on", F.col("e") == "off", "t").collect()}
    queue, want = [], {}
    for t, e in events:
        if e == "on":
            queue.append(t)
            want[t] = None
        elif queue:
            want[queue.pop(0)] = t
    assert got == want


def brute_path(scores, cost):
    n, s = scores.shape
    best = scores[0]
    for t in range(1, n):
        best = np.maximum(best, best.max() - cost[t]) + scores[t]
    return best.max()


@pytest.mark.parametrize("seed", range(5))
def test_leader_path_is_optimal(seed):
    rng = np.random.default_rng(seed)
    scores, cost = rng.random((30, 6)), np.where(np.arange(30) % 4 == 0, 0.2, 0.4)
    path = harmony.best_path(scores, cost)
    total = scores[np.arange(30), path].sum() - cost[1:][np.diff(path) != 0].sum()
    assert total == pytest.approx(brute_path(scores, cost))


def test_ties_stay():
    assert harmony.best_path(np.array([[1.0, 1.0], [1.0, 1.0], [0.0, 0.0]]), np.zeros(3)).tolist() == [0, 0, 0]


@pytest.mark.parametrize("seed", range(5))
def test_nnls(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random((12, 6)), rng.random(12)
    x = signal.nnls(a.T @ a, a.T @ b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope * x).max() < 1e-6


def test_beat_path_finds_a_pulse():
    strength = np.zeros(200)
    strength[7::20] = 1
    assert np.diff(signal.beat_path(strength, 20)).tolist()[1:-1] == [20] * (len(strength[7::20]) - 3)
    assert signal.stitched([np.array([0.0, 1, 2]), np.array([1.1, 2, 3])], [0.0, 1.5], 1.5, 1.0).tolist() == [0, 1, 2, 3]


def test_signals_and_spectra(spark):
    tone = signal.tone_chunks(spark, "a", [441.0], 0.5, 4410, 500)
    frames = audio_chain.spectra(tone, 256, 128, 500, lambda m: m).collect()
    assert sorted(r.frame for r in frames) == list(range(1 + (2205 - 256) // 128))
    assert int(np.argmax(frames[0].value)) == round(441 * 256 / 4410)
    assert audio_chain.spectra(tone, 4096, 128, 500, lambda m: m).count() == 0
    clicks = [x for r in signal.click_chunks(spark, "c", 120, 2, 1000).orderBy("chunk_no").collect() for x in r.samples]
    assert max(abs(x) for x in clicks[:10]) > 0 and clicks[200] == 0
    assert spark.range(1).select(V.is_silent(F.array(F.lit(0.0)))).first()[0]


def test_batched_least_squares_are_those_of_single_ones():
    rng = np.random.default_rng(5)
    for shape in ((30, 12, 40), (10, 25, 20), (64, 21, 1), (5, 5, 0)):
        a, y = np.abs(rng.normal(size=shape[:2])), rng.normal(size=(shape[0], shape[2]))
        gram, projected = a.T @ a, a.T @ y
        x = signal.nnls_batch(gram, projected)
        slope = gram @ x - projected
        assert (x >= 0).all() and (slope > -1e-6).all() and (np.abs(x * slope) < 1e-6).all()
        for k in range(shape[2]):
            own = signal.nnls(gram, projected[:, k])
            assert 0.5 * x[:, k] @ gram @ x[:, k] - projected[:, k] @ x[:, k] == pytest.approx(0.5 * own @ gram @ own - projected[:, k] @ own, abs=1e-6)


def test_wav_round_trip(spark, tmp_path):
    x = np.sin(np.arange(3000) / 20) * 0.5
    rate, y = audio.parse_wav(audio.wav_bytes(x, 8000))
    assert rate == 8000 and np.abs(x - y).max() < 1e-4
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[100, 300], [-100, -300]], "<i2").tobytes())
    assert audio.parse_wav(buffer.getvalue())[1].tolist() == [200 / 32768, -200 / 32768]
    odd = buffer.getvalue()[:12] + b"junk\x03\x00\x00\x00abc\x00" + buffer.getvalue()[12:]
    assert len(audio.parse_wav(odd)[1]) == 2
    with pytest.raises(ValueError):
        audio.parse_wav(b"RIFFxxxxWAVE")
    (tmp_path / "a.wav").write_bytes(audio.wav_bytes(x, 8000))
    (tmp_path / "b.wav").write_bytes(b"no")
    read = audio.read_audio(spark, str(tmp_path))
    assert [r.sample_rate for r in read.collect()] == [8000]
    assert len(audio.slice_time(read, 0.1, 0.2).first().samples) == 800
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted(r[0] for r in files.select(audio.sniff(F.col("content"))).collect()) == ["UNKNOWN", "WAV"]


def test_midi_round_trip(spark, tmp_path):
    for name in ("cMajorScale", "fourChordSong", "drumsAndBass"):
        (tmp_path / f"{name}.mid").write_bytes(midi.fixture_file(name))
    (tmp_path / "broken.mid").write_bytes(b"MThd\x00\x00\x00\x06\x00\x02\x00\x00\x01\xe0")
    events = midi.read_midi(spark, str(tmp_path)).cache()
    notes = midi.midi_notes(events)
    got = sorted((r.path.rsplit("/", 1)[1][:-4], r.channel, r.beat, r.end_beat, r.midi) for r in notes.collect())
    assert got == sorted((f, c, b, b + n, m) for f, _, c, b, n, m in midi.fixture_rows() if f in ("cMajorScale", "fourChordSong", "drumsAndBass"))
    assert {(r.beat, r.bpm, r.seconds) for r in midi.midi_tempi(events).collect()} == {(0.0, 120.0, 0.0)}
    assert {r.name for r in midi.track_names(events).collect()} == {"melody", "piano", "bass", "drums"}
    out = midi.export_files(midi.export_events(notes.select(F.col("path").alias("rec"), F.col("track").alias("part"), F.when(F.col("channel") == 9, "DRUMS").otherwise("OTHER").alias("role"), "midi", F.lit(80).alias("velocity"), "beat", "end_beat")))
    again = midi.midi_notes(midi.decode_midi(out.select(F.col("rec").alias("path"), "content")))
    assert sorted((r.path, r.beat, r.end_beat, r.midi) for r in again.collect()) == sorted((r.path, r.beat, r.end_beat, r.midi) for r in notes.collect())


def test_meters_take_effect_at_bar_lines():
    assert midi.effective_meters([(0, 4, 4), (8, 6, 8)]) == [(0, 4, 4), (2, 6, 8)]
    assert midi.effective_meters([(5, 3, 4)]) == [(0, 4, 4), (2, 3, 4)]
    assert midi.effective_meters([(5, 3, 4), (6, 5, 4)]) == [(0, 4, 4), (2, 5, 4)]


def test_metric_split():
    assert list(notation.split_span(4, 4, 0, 4)) == [4.0]
    assert list(notation.split_span(4, 4, 0, 3)) == [3.0]
    assert list(notation.split_span(4, 4, notation.Fraction(1, 2), notation.Fraction(5, 2))) == [1.5, 0.5]
    assert list(notation.split_span(4, 4, 1, 3)) == [2.0]
    assert list(notation.split_span(6, 8, 0, 3)) == [3.0]
    assert list(notation.split_span(6, 8, 0, notation.Fraction(3, 2))) == [1.5]
    rng = random.Random(4)
    for _ in range(300):
        num, den = rng.choice([(4, 4), (3, 4), (6, 8), (12, 8), (5, 4), (7, 8), (2, 2)])
        ticks = num * 64 // den
        a, b = sorted(rng.sample(range(ticks + 1), 2))
        values = notation.split_span(num, den, notation.Fraction(a, 16), notation.Fraction(b, 16))
        assert sum(values) == (b - a) / 16 and all(notation.single_value(notation.Fraction(v)) for v in values)


def test_staff_and_documents(spark):
    notes = frame(spark, [("r", "p", 0.0, 1.5, 60), ("r", "p", 0.0, 1.0, 64), ("r", "p", 3.0, 5.0, 67), ("r", "p", 6.0, 7.0, 72)], "rec string, part string, beat double, end_beat double, midi int")
    pieces = notation.bar_pieces(notation.filled(notation.staff_events(notes, ["rec", "part"], "beat", "end_beat", "midi"), ["rec", "part"]), ["rec", "part"])
    lines = {r.bar: r.line for r in notation.staff_lines(pieces, ["rec", "part"]).collect()}
    assert lines == {0: "<c' e'>4. r8 r4 g'4~ |", 1: "g'4 r4 c''4 |"}
    assert notation.dangling_ties(pieces, ["rec", "part"]).count() == 0
    assert notation.bar_sums(pieces, ["rec", "part"]).where("bar = 0").first().quarters == 4
    document = notation.musicxml_documents(pieces, "rec", "part").first().document
    assert document.count("<note>") >= 6 and 'type="start"' in document and 'type="stop"' in document
    tokens = spark.range(1).select(notation.chordmode_token(F.lit(9), F.lit("MINOR_SEVENTH"), F.lit(4), F.lit(2.0)), notation.chordmode_token(F.lit(None).cast("int"), F.lit("NONE"), F.lit(None).cast("int"), F.lit(2.5))).first()
    assert tuple(tokens) == ("a2:m7/e", "r1*5/8")
    cells = frame(spark, [("r", 0, 0, "a1:7"), ("r", 1, 0, "d2"), ("r", 1, 2, "r2")], "rec string, bar int, offset int, token string")
    assert "      d2 r2 |" in notation.lilypond_chart(cells, "rec").first().document
    back = text_charts.chordmode_cells(frame(spark, [("r", "a1:7 | d2 r2 | c4:m/g")], "rec string, t string"), "rec", "t").collect()
    assert [(r.bar, r.root, r.length, r.bass) for r in back] == [(0, "a", "1", None), (1, "d", "2", None), (1, None, "2", None), (2, "c", "4", "g")]


def test_tempo_and_scores(spark):
    seg = frame(spark, [("r", 0.0, 0.0, 120.0, "SUPPLIED"), ("r", 8.0, 4.0, 60.0, "SUPPLIED")], "rec string, start_beat double, start_seconds double, bpm double, provenance string")
    at = frame(spark, [("r", b) for b in (-1.0, 4.0, 8.0, 10.0)], "rec string, beat double")
    there = score.beats_to_seconds(at, seg, ["rec"], "beat")
    assert sorted((r.beat, r.seconds) for r in there.collect()) == [(-1.0, -0.5), (4.0, 2.0), (8.0, 4.0), (10.0, 6.0)]
    back = score.seconds_to_beats(there.withColumnRenamed("beat", "was"), seg, ["rec"], "seconds")
    assert all(r.was == pytest.approx(r.beat) for r in back.collect())
    assert score.consistent_tempo(seg, ["rec"]).count() == 0
    placed = score.place_spans(frame(spark, [("r", 0.1, 1.1), ("r", 1.05, 1.2), ("r", 1.2, 2.9)], "rec string, s double, e double"), "rec", "s", "e", lambda x: math.floor(x + 0.5))
    got = [(r.placed_start, r.placed_end) for r in placed.orderBy("s").collect()]
    assert got[0] == (0, 1) and got[2] == (1, 3) and got[1][0] is None or math.isnan(got[1][0])
    moved, gone = score.transpose_track(frame(spark, [("a", 60), ("b", 120)], "part string, midi int"), ["part"], 12)
    assert [r.midi for r in moved.collect()] == [72] and [r.part for r in gone.collect()] == ["b"]
    beats = frame(spark, [("r", i * 0.5 + 0.1) for i in range(8)], "rec string, seconds double")
    forced = score.forced_downbeat(beats, frame(spark, [("r", 1.12)], "rec string, wanted double"), ["rec"], 4)
    assert [r.beat_no for r in forced.where("downbeat").orderBy("beat_no").collect()] == [2, 6]
    with pytest.raises(Exception):
        score.guarded(beats, ["rec"], 3, "beats").collect()
    text = '{"title":"t","tempoMap":{"segments":[{"startBeat":0.0,"startSeconds":0.0,"beatsPerMinute":90.0}],"meterChanges":[]},"other":1}'
    parsed = score_json.parse_scores(frame(spark, [(text,)], "j string"), "j")
    assert parsed.select("tempoMap.segments").first()[0][0].provenance == "UNKNOWN"
    assert '"title" : "t"' in parsed.select(score_json.score_text()).first()[0]


def test_theory(spark):
    row = spark.range(1).select(
        theory.parse_pitch(F.lit("Bb-1")), theory.name_at_fifths(F.lit(-2)), theory.name_at_fifths(F.lit(6)), theory.signature_of(F.lit(9), F.lit(True)), theory.next_power_of_two(F.lit(8158)), theory.next_power_of_two(F.lit(8192)),
        theory.take_name(F.lit("..a/b.WAV ")), theory.stage_name(F.lit("..")), theory.duration_text(F.lit(61.9)), theory.letters(F.lit(27)), theory.meter_parts(F.lit("6/8")), text_charts.tempo_text(F.lit(90.0), F.lit(1.5)),
        text_charts.first_and_more(F.array(*map(F.lit, "abcdefgh"))), V.snap_even(F.lit(2.5), 1.0), V.snap(F.lit(2.5), 1.0), V.clamp01(F.lit(float("nan"))),
    ).first()
    assert tuple(row)[:10] == (10, "Bb", "F#", 0, 8192, 8192, "a_b", "_", "1:01", "AB")
    assert tuple(row[10]) == (6, 8) and row[11] == "60 BPM (90 quarters)" and row[12] == "a, b, c, d, e, f and 2 more" and tuple(row)[13:] == (2.0, 3.0, 0.0)
    truth = text_charts.truth_bars(frame(spark, [("x", "A7 F7-D7")], "rec string, t string"), "rec", "t").collect()
    assert [(r.bar, r.alt, r.pitch_class, r.quality) for r in truth] == [(0, 0, 9, "7"), (1, 0, 5, "7"), (1, 1, 2, "7")]


def test_bars(spark):
    meters = frame(spark, [(1, 0, 4, 4), (1, 2, 3, 4)], "k int, start_bar int, num int, den int")
    assert [r.start_beat for r in meter.bar_table(meters, ["k"], 4).orderBy("bar").collect()] == [0, 4, 8, 11]
    got = meter.bar_position(frame(spark, [(1, b) for b in (0.0, 7.5, 8.0, 11.5)], "k int, beat double"), meters, ["k"], "beat").orderBy("beat").collect()
    assert [(r.bar, r.beat_in_bar) for r in got] == [(0, 0), (1, 3.5), (2, 0), (3, 0.5)]


def test_workspace(tmp_path):
    source = tmp_path / "song.mid"
    source.write_bytes(b"x")
    made = workspace.create_workspace(str(tmp_path / "w"), str(source), "t")
    assert workspace.open_workspace(str(tmp_path / "w")) == made
    cache = workspace.StageCache(str(tmp_path / "c"))
    cache.put("a b", "k", b"1")
    assert cache.find("a b", "k") == b"1" and cache.find("a", "k") is None and cache.invalidate("a b") == 1
    (tmp_path / "conf").write_text("tempo:\n  bpm: 90\n  low: 1.5\nname: x\n")
    assert workspace.overlay({"tempo": {"bpm": 1, "high": 2}}, workspace.read_config(str(tmp_path / "conf")), workspace.read_config(str(tmp_path / "none"))) == {"tempo": {"bpm": 90, "high": 2, "low": 1.5}, "name": "x"}
    assert workspace.free_name("s", {"s", "s-2"}) == "s-3" and workspace.newest_first([("a", 1), ("b", 2)]) == ["b", "a"]


def test_streams(spark, tmp_path):
    from tempograph.streaming.onset_rate import event_stream, gaps, sliding_rates

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(200)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, make, mode in (("rates", sliding_rates, "complete"), ("gaps", gaps, "append")):
        q = make(event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("rates").agg(F.sum("onsets")).first()[0] == 400
    assert spark.table("gaps").count() == 200


def test_smaller_operators(spark, tmp_path):
    from tempograph.operators import stats

    both = stats.changed_lines(frame(spark, [("a", 1), ("b", 2), ("c", 3)], "k string, v int"), frame(spark, [("a", 1), ("b", 5), ("d", 4)], "k string, v int"), "k", "v")
    assert sorted((r.k, r.was, r.now) for r in both.collect()) == [("b", 2, 5), ("d", None, 4)]
    bad = stats.violations(frame(spark, [(1.0, 200), (float("nan"), 5)], "x double, midi int"), {"finite": stats.finite("x"), "range": F.col("midi").between(0, 127)})
    assert sorted(r.broken for r in bad.collect()) == [["finite"], ["range"]]
    x = frame(spark, [([1.0, 2.0, float("nan"), 4.0, 4.0],)], "v array<double>").select(signal.anti_alias(F.col("v")).alias("v")).first().v
    assert math.isnan(x[2]) and x[3] == x[4] == pytest.approx(4.0) and 1 <= x[0] <= x[1] <= 2
    pulse = np.zeros(800)
    pulse[3::50] = 1
    assert signal.tempo_in(pulse, 100.0) == pytest.approx(120, abs=1) and signal.comb_phase(pulse, 50) == 3
    beats = signal.tempi_of_windows(frame(spark, [(1, i, float(v)) for i, v in enumerate(np.tile(pulse, 6))], "k int, i int, s double"), "k", "i", "s", 100.0, 10.0)
    assert beats.count() > 80
    bars = meter.bar_table(frame(spark, [(1, 0, 4, 4), (1, 1, 6, 8)], "k int, start_bar int, num int, den int"), ["k"], 4)
    snapped = meter.snap_to_bar(frame(spark, [(1, 2.0), (1, 5.4)], "k int, beat double"), bars, ["k"], "beat").orderBy("beat").collect()
    assert [r.snapped for r in snapped] == [4.0, 4.0]
    loud = score.accent_downbeat(frame(spark, [("r", i, 1.0 if i % 4 == 2 else 0.1) for i in range(16)], "rec string, beat_no int, strength double"), ["rec"], 4).first()
    assert (loud.phase, loud.confidence) == (2, 0.35)
    chords = frame(spark, [("r", 0.0, "C", "MAJOR"), ("r", 2.0, "G", "MAJOR")], "rec string, start double, symbol string, quality string")
    said = score.summary(chords, frame(spark, [("r", i * 0.5) for i in range(9)], "rec string, seconds double"), ["rec"]).first().summary
    assert said == "9 beats at 120.0 BPM, 2 chords, 1 changes"
    lines = frame(spark, [("r", i, f"{'ab'[i % 2]}1 |") for i in range(8)], "rec string, bar int, line string")
    assert [(r.tag, r.first_bar) for r in notation.repeat_brackets(lines, "rec").orderBy("line").collect()] == [("A", 0), ("A", 4)]
    assert "\\new Staff" in notation.staff_document(lines.withColumn("part", F.lit("p")), "rec", "part").first().document
    chunks = signal.click_chord_chunks(spark, "x", 120, 1.0, [[220.0, 330.0], [440.0]], 1, 1000)
    assert chunks.select(F.size("samples")).first()[0] == 1000


def test_commands(spark, tmp_path, capsys):
    from tempograph import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "song.mid").write_bytes(midi.fixture_file("fourChordSong"))
    root = str(tmp_path / "w")
    assert cli.main(["init", root, str(tmp_path / "in" / "song.mid")]) == 0
    assert cli.main(["analyze", root, str(tmp_path / "in")]) == 0
    assert cli.main(["render", root]) == 0 and cli.main(["info", root]) == 0 and cli.main(["doctor"]) == 0
    out = capsys.readouterr().out
    assert "| C" in out and "pyspark: found" in out


def test_register_chroma_hears_notes():
    """A harmonic tone is heard as its own class: low ones in the bass register, high ones in the treble, silence as nothing."""
    from tempograph.operators import audio_chain

    rate, window = 22_050, 8192
    t = np.arange(window) / rate
    tones = [sum(0.5**p * np.sin(2 * np.pi * 440 * 2 ** ((midi - 69) / 12) * (p + 1) * t) for p in range(6)) for midi in (40, 64, 79)]
    frames = np.abs(np.fft.rfft(np.stack([*tones, tones[1] + tones[2], 0 * t]) * signal.hann(window), axis=1))
    got = audio_chain.register_chroma(frames, rate, window)
    treble, bass = got[:, :12], got[:, 12:]
    assert bass[0].argmax() == 4 and bass[0].max() > treble[0].max()
    assert treble[1].argmax() == 4 and treble[2].argmax() == 7 and treble[1].max() > bass[1].max()
    assert set(np.argsort(treble[3])[-2:]) == {4, 7} and not got[4].any()


@pytest.mark.parametrize("chunk", [1500, 4096])
def test_spectra_by_chunk_are_those_of_the_whole(spark, chunk):
    from tempograph.operators import audio_chain

    x = np.random.default_rng(2).normal(size=10_000)
    rows = [("r", k, x[a : a + chunk].tolist()) for k, a in enumerate(range(0, len(x), chunk))] + [("short", 0, [0.0] * 100)]
    df = spark.createDataFrame(rows, "rec_id string, chunk_no int, samples array<double>").repartition(3)
    got = {(r.rec_id, r.frame): r.value for r in audio_chain.spectra(df, 2048, 256, chunk, lambda m: m[:, :5]).collect()}
    want = {("r", f): np.abs(np.fft.rfft(x[f * 256 : f * 256 + 2048] * signal.hann(2048)))[:5] for f in range(1 + (10_000 - 2048) // 256)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_unreadable_files(spark):
    from tempograph.sources import audio

    files = [("a.wav", audio.wav_bytes([0.1, 0.2], 8000)), ("b.wav", audio.wav_bytes([0.1], 8000)[:20]), ("c.mid", midi.fixture_file("leadIn")), ("d.mid", b"MThd\x00\x00"), ("e.ogg", b"OggS123"), ("f", b"")]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in files], "path string, content binary")
    gone = {r.path: r.kind for r in audio.unreadable(df).collect()}
    assert gone == {"b.wav": "WAV", "d.mid": "MIDI", "e.ogg": "OGG", "f": "UNKNOWN"}
    assert {r.rec_id for r in audio.decode_audio(df).collect()} == {"a.wav"} and {r.path for r in midi.decode_midi(df).select("path").distinct().collect()} == {"c.mid"}


def test_the_command_line_reads_audio(spark, tmp_path, monkeypatch, capsys):
    from tempograph import cli
    from tempograph.plans.bound_queries import SONG
    from tempograph.sources import audio

    monkeypatch.setattr(cli, "session", lambda: spark)
    chunks = signal.click_chord_chunks(spark, "song", 120.0, 8.0, [list(c) for c in SONG], 4).orderBy("chunk_no").collect()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "song.wav").write_bytes(audio.wav_bytes([x for r in chunks for x in r.samples], signal.RATE))
    (tmp_path / "in" / "tune.mid").write_bytes(midi.fixture_file("fourChordSong"))
    assert cli.main(["analyze", str(tmp_path), str(tmp_path / "in")]) == 0 and cli.main(["render", str(tmp_path)]) == 0
    printed = capsys.readouterr().out
    assert [x for x in printed.replace("|", " ").split() if x in ("C", "G", "Am", "F")][:4] == ["C", "G", "Am", "F"]
