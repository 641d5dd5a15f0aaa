"""Quality rules, classifier, URL filter and secret scans."""

import hashlib
import math
import random
import re
import string
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tempograph.llm import url_filter
from tempograph.llm import quality_rules as quality_rules_module
from tempograph.llm.quality_classifier import BASE, BITS, features, quality_scores, train
from tempograph.llm.quality_rules import base_counts, bucket_counts, quality_rules
from tempograph.llm.secrets import ALLOWED, CLASSES, KINDS, WINDOW, described, redact, scan_secrets
from tempograph.llm.url_filter import Rules, Segmenter, filter_urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_counts(rows):
    for t in [*(t or "" for _, t in rows), "a b c a b c", "x y\nx y\n\n \nx y", "#*$%&|<> a|b"]:
        assert base_counts(t) == brute_counts(t)


def junk(rng):
    return " ".join(f"{rng.choice('abcdef')}{rng.randrange(99)}***%%%" for _ in range(300))


def good(rng):
    return " ".join(rng.choice(["river", "stone", "cloud", "light", "under", "house", "gold"]) + rng.choice("abcdefghij") + rng.choice("abcdefghij") for _ in range(300))


def test_rules_reject_junk_and_keep_clean_texts(spark, nothing):
    rng = random.Random(5)
    rows = [(i, junk(rng) if i % 8 == 0 else good(rng)) for i in range(160)] + [(900, None), (901, ""), (902, "too few")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("missing", "x")
    trusted = spark.createDataFrame([(i,) for i in range(160) if i % 8 and i % 3 == 0] + [(None,)], "doc_id bigint")
    out = {r.doc_id: r for r in quality_rules(df, trusted).collect()}
    assert [k for k, r in out.items() if r.kept] == [i for i in out if i < 160 and i % 8]
    assert all(out[k].base_failed and not out[k].kept for k in (900, 901, 902))
    assert quality_rules(nothing, trusted).collect() == []
    assert all(r.llr == 0 for r in quality_rules(df, trusted.limit(0)).collect())


def test_classifier_learns(spark, nothing):
    rng = random.Random(6)
    rows = [(i, junk(rng) if i % 4 == 0 else good(rng)) for i in range(240)] + [(900, None), (901, ""), (902, "é")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(160)] + [(900, 1), (5, None), (None, 1)], "doc_id bigint, quality int")
    out = {r.doc_id: r for r in quality_scores(df, labels).collect()}
    assert all(out[i].predicted == int(i % 4 != 0) for i in range(160, 240))
    assert all(0 <= r.score <= 1 for r in out.values())
    assert quality_scores(nothing, labels).collect() == []
    assert all(r.score == 0.5 for r in quality_scores(df, labels.limit(0)).collect())


def test_features_and_one_class():
    assert len(features("")) == 0
    text = "some words and some more"
    n = len(text)
    assert len(features(text)) == (n - 2) + (n - 4) + 5
    assert features("some")[-1] == features("x some")[-1]
    weights, bias = train([("a text", 1)]).weights()
    assert bias > 10


def test_rules_of_urls():
    rules = Rules([("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8")])
    assert rules.match("a.example.com", "/en/71") == ("example.com/en/7", "allow")
    assert rules.match("a.example.com", "/en/8") == ("com/en/", "block")
    assert rules.match("xcom", "/en/8") is None
    assert rules.match("example.net", "/de/8") == ("example.net/de/8", "block")
    assert rules.match("", "") is None


def test_segmentation():
    words = Segmenter({"free": 50, "casino": 40, "bonus": 30, "a": 5})
    assert words.words("freecasinobonus-42") == ["free", "casino", "bonus"]
    assert words.words("qqq") == ["qqq"]


def test_urls(spark):
    hosts = ["casinofree", "freebonus", "bonuscasino", "riverstone", "stonecloud", "cloudriver"]
    urls = [f"https://{h}.example.org/{'es' if i < 3 else 'de'}/page{k}" for i, h in enumerate(hosts) for k in range(10)]
    urls += [f"https://{w}.example.com/x" for w in ("casino", "free", "bonus", "river", "stone", "cloud") for _ in range(2)]
    urls += [f"https://www.{w}.example.com/x" for w in ("casino", "free", "bonus", "river", "stone", "cloud")]
    fresh = ["http://freecasinobonus.example.net/", "http://cloudstone.example.net/"]
    odd = [None, "", "no scheme", "x://", "HTTP://UP.Example.com?q#f", "http://a.com/p#x"]
    df = spark.createDataFrame(list(enumerate([*urls, *fresh, *odd])), "page_id bigint, path string").withColumn("Verdict", F.lit(1))
    rules = [("block", "org/es/"), ("allow", "org/de/")]
    out = {r.page_id: r for r in filter_urls(df, rules, url="path").collect()}
    n = len(urls)
    assert [out[i].verdict for i in range(60)] == ["block"] * 30 + ["allow"] * 30
    assert out[n].verdict == "block" and out[n + 1].verdict == "allow" and out[n].rule is None
    assert [(out[n + 2 + i].host, out[n + 2 + i].path) for i in range(6)] == [("", ""), ("", ""), ("", ""), ("", ""), ("up.example.com", ""), ("a.com", "/p")]
    assert all(out[n + 2 + i].verdict == "allow" for i in range(4))
    assert filter_urls(df, rules, url="path").columns == ["page_id", "host", "path", "rule", "log_odds", "verdict"]
    assert filter_urls(df.limit(0), [], url="path").collect() == []
    assert {r.verdict for r in filter_urls(df, [("block", "org/es/")], url="path").where("rule is null").collect()} == {"allow"}


def brute_verdicts(urls, rules, longest=24):
    """Rules, unigram Viterbi over every cut of a run, and Bayes over all words, in dicts."""
    hosts, paths = [], []
    for u in urls:
        rest = (u or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        hosts.append("".join(c.lower() if c in string.ascii_uppercase else c for c in host))
        paths.append(re.match("[^?#]*", rest[len(host) :])[0])
    runs = [re.findall("[a-z]+", (h + " " + p).translate(url_filter.DOWN)) for h, p in zip(hosts, paths)]
    holders = {}
    for h, x in zip(hosts, runs):
        for r in x:
            holders.setdefault(r, set()).add(h)
    counts = {r: len(h) for r, h in holders.items() if len(h) > 1 and len(r) <= longest}
    total, most = sum(counts.values()) + 1, max(map(len, counts), default=1)
    known = {}

    def split(run):
        if not run:
            return 0.0, 0, ()
        if run not in known:
            price = lambda w: math.log(total / counts[w]) if w in counts else math.log(total) + 3 + 2.5 * len(w)
            known[run] = min((round(split(run[:i])[0] + price(run[i:]), 9), i, (*split(run[:i])[2], run[i:])) for i in range(len(run)) if i == 0 or len(run) - i <= most)
        return known[run]

    pages = [[w for r in x for w in split(r)[2]] for x in runs]
    ruling = []
    for h, p in zip(hosts, paths):
        fits = [(len(t), t, v) for v, t in rules if ("." + h).endswith("." + t.partition("/")[0]) and p.startswith("/" + t.partition("/")[2])]
        ruling.append(max(fits)[1:] if fits else (None, None))
    sums = {k: Counter(w for x, (_, v) in zip(pages, ruling) if v == k for w in x) for k in ("block", "allow")}
    n = Counter(v for _, v in ruling)
    words = set(sums["block"]) | set(sums["allow"]) if n["block"] and n["allow"] else set()
    size = {k: sum(c.values()) + len(words) for k, c in sums.items()}
    prior = math.log(n["block"] / n["allow"]) if n["block"] and n["allow"] else -1.0
    odds = {w: math.log((sums["block"][w] + 1) / size["block"]) - math.log((sums["allow"][w] + 1) / size["allow"]) for w in words}
    return [(*r, prior + sum(odds.get(w, 0.0) for w in x) if x else min(prior, -1.0)) for x, r in zip(pages, ruling)]


@pytest.mark.parametrize("held", [3, 100_000])
@pytest.mark.parametrize("rules", [[("block", "com/en/"), ("allow", "net/de/"), ("allow", "example.com/en/7"), ("block", "org/es/")], [("block", "org/es/")], []])
def test_all_words_of_urls_count(spark, monkeypatch, held, rules):
    monkeypatch.setattr(url_filter, "VOCABULARY", held)
    monkeypatch.setattr(url_filter, "TEXTS", 2)
    rng = random.Random(9)
    stems = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    urls = [f"http://{rng.choice(stems)}{rng.choice(stems)}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.choice([7, 'x'])}{rng.choice(stems)}" for _ in range(400)]
    urls += [None, "", "x://", f"http://{'qz' * 40}.org/{stems[0]}", f"http://{'ab' * 3000}.com/en/"] + [f"http://{stems[1]}{stems[2]}.org/same"] * 60
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(3)
    out = {r.page_id: r for r in filter_urls(df, rules).collect()}
    want = brute_verdicts(urls, rules)
    assert len(out) == len(urls)
    assert [out[i].rule for i in range(len(urls))] == [w[0] for w in want]
    assert [out[i].log_odds for i in range(len(urls))] == pytest.approx([w[2] for w in want], abs=1e-6)
    assert [out[i].verdict for i in range(len(urls))] == [w[1] or ("block" if w[2] > 0 else "allow") for w in want]
    if len(rules) > 1:
        assert len({w[1] or w[2] > 0 for w in want}) > 2


ASSIGN = re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def brute_spans(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base = list(spans)
    for m in RUN.finditer(text):
        run = m[0]
        if not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)) or any(re.search(p, run) for p in ALLOWED) or any(a <= m.start() and b >= m.end() for a, _, b in base):
            continue
        windows = [Counter(run[i : i + WINDOW]) for i in range(len(run) - WINDOW + 1)]
        entropy = max(-sum(c / WINDOW * math.log2(c / WINDOW) for c in w.values()) for w in windows)
        if round(entropy, 9) >= next(bits for p, bits in CLASSES if re.search(p, run)):
            spans.append((m.start(), 3, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_spans_are_those_of_brute_force(spark, docs, rows, nothing):
    rng = random.Random(8)
    kinds = ["abcdef0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP0123456789", "abc/+=-_0123456789XYZ"]
    more = [(10_000 + i, "é " + " ".join("".join(rng.choice(kinds[(i + j) % 3]) for _ in range(rng.choice([5, 19, 20, 21, 24, 40, 70]))) for j in range(6)) + rng.choice([" password: a1b2c3", ' API_KEY="=zzzzzz', " token= x", ""])) for i in range(60)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = {r.doc_id: r.d for r in scan_secrets(df).select("doc_id", described("spans").alias("d")).collect()}
    want = {k: brute_spans(t or "") for k, t in [*rows, *more]}
    assert got == want
    assert any("entropy" in d for d in got.values())
    assert scan_secrets(nothing).collect() == []


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é password=abcdef12 and 0123456789abcdef01234567 end"), (2, "clean"), (3, None), (4, "token=deadbeefdeadbeefdeadbeef")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in redact(df).collect()}
    assert got == {1: "é [secret] and [secret] end", 2: "clean", 3: None, 4: "[secret]"}


def test_many_spans_and_clashing_columns(spark):
    """Over a block of spans in one text, and columns named like those used on the way."""
    texts = [" ".join(f"é token=abc{i:04d} {i:024x}" for i in range(n)) for n in (1, 63, 64, 65, 700)]
    df = spark.createDataFrame([(i, t, i, i) for i, t in enumerate(texts)], "doc_id bigint, text string, _assign bigint, __base bigint")
    out = scan_secrets(df)
    assert out.columns == [*df.columns, "spans"]
    got = {r.doc_id: (r.d, r._assign) for r in out.select("doc_id", "_assign", described("spans").alias("d")).collect()}
    assert got == {i: (brute_spans(t), i) for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in redact(df).collect()} == {i: brute_redacted(t) for i, t in enumerate(texts)}


def brute_redacted(text, marker="[secret]"):
    out, at = "", 0
    for span in filter(None, brute_spans(text).split(",")):
        a, z = map(int, span.split(":")[1:])
        if a >= at:
            out += text[at:a] + marker
        at = max(at, z)
    return out + text[at:]


def brute_llr(rows, trusted, text):
    """The likelihood ratio of a text from plain counts of hashed 4-byte n-grams."""

    def bag(t):
        raw = (t or "").encode().lower()
        return Counter((int.from_bytes(raw[i : i + 4], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for i in range(len(raw) - 3))

    raw, good = Counter(), Counter()
    for k, t in rows:
        raw += bag(t)
        if k in trusted:
            good += bag(t)
    n_raw, n_good, own = sum(raw.values()) + 0.5 * 65536, sum(good.values()) + 10_000, bag(text)
    q = {g: (raw[g] + 0.5) / n_raw for g in own}
    return sum(n * (math.log((good[g] + 10_000 * q[g]) / n_good) - math.log(q[g])) for g, n in own.items()) / max(1, sum(own.values()))


def test_quality_is_that_of_brute_force(spark, rows):
    trusted = {k for k, _ in rows if k % 4 == 0}
    out = quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark.createDataFrame([(k,) for k in trusted], "doc_id bigint"))
    got = {r.doc_id: r for r in out.collect()}
    for k, t in rows:
        n, chars, symbols, lines, repeated = brute_counts(t or "")
        failed, llr = n < 50 or 100 * repeated > 50 * n, brute_llr(rows, trusted, t)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, repeated, failed)
        assert r.llr == pytest.approx(llr, abs=1e-9) and r.kept == (not failed and llr >= -0.6)


def test_counts_are_added_in_a_tree(spark, rows, monkeypatch):
    monkeypatch.setattr(quality_rules_module, "FAN", 2)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert (bucket_counts(df.repartition(9)) == bucket_counts(df.coalesce(1))).all()


def brute_score(model, text):
    """Mean vector of the words' and n-grams' features, then the softmax layer."""
    raw = text.encode().lower()
    found = []
    for size, factor in zip((3, 5), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        found += [((int.from_bytes(raw[i : i + size], "little") + 1) * factor % 2**64) >> (64 - BITS) for i in range(len(raw) - size + 1)]
    for word in raw.split():
        value = sum((b + 1) * pow(BASE, i, 2**64) for i, b in enumerate(word)) % 2**64
        found.append(((value ^ value >> 29) * 0x165667B19E3779F9 % 2**64) >> (64 - BITS))
    mean = model.vectors[found].astype(float).mean(axis=0) if found else 0 * model.vectors[0]
    z = mean @ model.layer + model.bias
    return 1 / (1 + math.exp(z[0] - z[1]))


def test_scores_are_those_of_brute_force(spark, rows):
    marks = [(k, int(k % 2)) for k, t in rows if k % 5]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in quality_scores(df, spark.createDataFrame(marks, "doc_id bigint, quality int")).collect()}
    labelled = dict(marks)
    model = train([(t or "", labelled[k]) for k, t in sorted(rows, key=lambda r: r[0]) if k in labelled])
    for k, t in rows:
        want = brute_score(model, t or "")
        assert got[k].score == pytest.approx(want, abs=1e-5) and got[k].predicted == int(got[k].score >= 0.3)


def test_training_rows_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("tempograph.llm.quality_classifier.train", lambda rows: seen.append(rows) or train(rows))
    df = spark.createDataFrame([(1, "a" * 10)] * 50 + [(2, "b" * 30), (3, "c" * 1000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, quality int")
    for bounds, most in (((7, 1 << 20), (7, 1 << 20)), ((4000, 60), (6, 60))):
        quality_scores(df, labels, max_rows=bounds[0], max_bytes=bounds[1])
        assert 0 < len(seen[-1]) <= most[0] and sum(len(t) for t, _ in seen[-1]) <= most[1]


def test_megabyte_texts(spark):
    """One very long text among short ones, through every judging operator."""
    line = "one river of words flows under the stone, and a token=abcdef12 is in it.\n"
    long = line * 40_000
    df = spark.createDataFrame([(1, long), (2, "short"), (3, "river " * 400_000)], "doc_id bigint, text string")
    judged = {r.doc_id: r for r in quality_rules(df, spark.createDataFrame([(1,)], "doc_id bigint")).collect()}
    assert (judged[1].n_words, judged[3].n_repeat_words) == (14 * 40_000, 400_000)
    assert all(0 <= r.score <= 1 for r in quality_scores(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")).collect())
    few = spark.createDataFrame([(1, line * 3000)], "doc_id bigint, text string")
    assert scan_secrets(few).select(F.size("spans").alias("n")).first().n == 3000
    assert redact(few).first().text == (line * 3000).replace("token=abcdef12", "[secret]")


SHAPES = {
    "slug": "ab-12-",
    "words": "ab-12-cd/",
    "path": "/usr/lib12",
    "base64": "q9Zx7Kp2Lm4Vt8Rw1Ys6Bd3FhT5+jC0n",
    "hex": "0f1e2d3c",
    "upper": "0F1E2D3CA9",
    "equals": "=",
    "mixed": "=a1",
    "access": "AKIA1234",
    "assign": "token=a1b2.",
    "secrets": "token=abc12345 Zx81hQ0pLm3Vt7Rw2Ys6Bd ",
    "blanks": "password ",
}


@pytest.mark.parametrize("size", [3_000, 1_000_000])
def test_long_runs_neither_crash_nor_slow_down(spark, size):
    """A run of each shape, as long as a document; the short ones against brute force."""
    made = {k: (x * (size // len(x) + 1))[:size] for k, x in SHAPES.items()}
    df = spark.createDataFrame(list(made.items()), "doc_id string, text string").repartition(4)
    began = time.perf_counter()
    got = {r.doc_id: r.d for r in scan_secrets(df).select("doc_id", described("spans").alias("d")).collect()}
    assert time.perf_counter() - began < 90
    assert set(got) == set(made)
    if size < 10_000:
        assert got == {k: brute_spans(t) for k, t in made.items()}
        assert {r.doc_id: r.text for r in redact(df).collect()} == {k: brute_redacted(t) for k, t in made.items()}
    else:
        assert got["secrets"].count("entropy") == pytest.approx(size / len(SHAPES["secrets"]), abs=1)
        assert {r.doc_id: r.n for r in redact(df).select("doc_id", F.length("text").alias("n")).collect()}["equals"] == size


def test_scan_is_native(docs):
    plan = scan_secrets(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
