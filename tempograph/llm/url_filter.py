"""URL filter: rules first, then naive Bayes over segmented words.

Rules are (verdict, text) pairs such as ``("block", "com/en/")``: the part before
the first ``/`` is a host that fits itself and its subdomains, the rest a prefix of
the path; the longest fitting rule decides.

Where no rule fits, host and path are cut into words: runs of the letters A-Z, each
split by Viterbi search under a unigram model.  A word of the model is a run of at
most ``longest`` letters that stands in two or more distinct hosts' URLs, and its
weight is the number of those hosts: a name that only one host has tells nothing of
words, so it falls apart into words that others use, where it consists of such.

A multinomial naive Bayes model over the words is counted on the URLs for which a
rule decides, with the rule's verdict as their class; it carries the rules on to
URLs that look like those they name.  Words of no such URL decide nothing.  If the
rules give no example of one of the classes, there is nothing to tell apart, and
other URLs are allowed.

Both models hold every word.  Up to ``VOCABULARY`` distinct runs, a worker has the
models whole; beyond, they are tables, and runs, words and pages are joined to what
they need of them.  Both ways give the same results.

A null URL, or one without ``://``, has an empty host and path and is allowed.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograph.llm._common import append_columns, cut, looked_up
from tempograph.llm.bpe import Memo

#: Distinct runs of a model that workers hold whole, and the most frequent rows of a larger one that are broadcast.
VOCABULARY, TEXTS = 50_000, 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOWN = str.maketrans(UPPER, LOWER)
RUNS = re.compile("[a-z]+")


def host_of(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def runs_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), "[^a-z]+"), lambda x: x != "")


def all_runs() -> Column:
    return F.concat(runs_of(F.col("host")), runs_of(F.col("path")))


class Rules:
    """Rules by host; their number is that of the given list."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, text in rules:
            host, slash, path = text.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, verdict, text))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, at = None, 0
        while True:
            for prefix, verdict, text in self.by_host.get(host[at:], ()):
                if path.startswith(prefix) and (best is None or (len(text), text) > (len(best[0]), best[0])):
                    best = text, verdict
            at = host.find(".", at) + 1
            if not at:
                return best


def word_cost(total: int, length: int, n: int | None) -> float:
    """Cost of a word that n of ``total`` weights stand for, or of an unknown stretch of letters."""
    return math.log(total) - math.log(n) if n else math.log(total) + 3.0 + 2.5 * length


class Segmenter:
    """Viterbi splitting of letter runs under a unigram model."""

    def __init__(self, counts: dict[str, int], total: int | None = None, longest: int | None = None):
        self.counts = counts
        self.total = total or sum(counts.values()) + 1
        self.longest = longest or max(map(len, counts), default=1)
        self.memo = Memo(self.split)

    def split(self, run: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for j in range(1, len(run) + 1):
            # An unknown stretch may be of any length, but only those as long as words are tried, and the whole run.
            tried = ((best[i] + word_cost(self.total, j - i, self.counts.get(run[i:j])), i) for i in {0, *range(max(0, j - self.longest), j)})
            cost, i = min(tried)
            best.append(cost)
            back.append(i)
        words, j = [], len(run)
        while j:
            words.append(run[back[j] : j])
            j = back[j]
        return tuple(words[::-1])

    def words(self, text: str) -> list[str]:
        return [w for run in RUNS.findall(text.translate(DOWN)) for w in self.memo[run]]


def log_odds_of(block: int, allow: int, t_block: int, t_allow: int) -> float:
    return math.log((block + 1) / t_block) - math.log((allow + 1) / t_allow)


def prior_of(n_block: int, n_allow: int) -> float:
    """Log-odds of the classes; -1 where one has no example."""
    return math.log(n_block / n_allow) if n_block and n_allow else -1.0


def train(ruled: DataFrame, top: list, longest: int) -> tuple[Segmenter, dict[str, float], float]:
    """Segmenter, log-odds of block for each word, and of the classes, from (host, path, ruling) and all runs, counted."""
    segmenter = Segmenter({r["run"]: r["n"] for r in top if r["n"] > 1 and len(r["run"]) <= longest})

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for host, path, ruling in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "ruling"))):
                found["", ruling] += 1
                found.update((w, ruling) for w in (*segmenter.words(host), *segmenter.words(path)))
            keys = list(found)
            sums = [pa.array([found[k] if k[1] == kind else 0 for k in keys], pa.int64()) for kind in ("block", "allow")]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *sums], names=["word", "block", "allow"])

    examples = ruled.where("ruling is not null").select("host", "path", "ruling")
    sums = examples.mapInArrow(count, "word string, block bigint, allow bigint").groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    both = {r["word"]: (r["block"], r["allow"]) for r in sums.collect()}  # pieces of the given runs
    n_block, n_allow = both.pop("", (0, 0))
    if not (n_block and n_allow):
        both = {}
    t_block, t_allow = (sum(x[k] for x in both.values()) + len(both) for k in (0, 1))
    return segmenter, {w: log_odds_of(b, a, t_block, t_allow) for w, (b, a) in both.items()}, prior_of(n_block, n_allow)


def segmented(counted: DataFrame, longest: int) -> DataFrame:
    """(run, n) with the words of each run, under the model of all of them."""
    vocabulary = counted.where((F.col("n") > 1) & (F.length("run") <= longest))
    weight, most = vocabulary.agg(F.sum("n"), F.max(F.length("run"))).first()
    total, most = (weight or 0) + 1, most or 1
    words = vocabulary.toDF("piece", "known")
    length = F.length("run")
    pieces = F.transform(F.sequence(F.lit(1), length), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), length - i + 1)), lambda k: F.substring(F.col("run"), i, k)))
    cuts = counted.select("run", F.explode(F.array_distinct(F.flatten(pieces))).alias("piece"))
    # Short pieces lie in many runs; there are no more of them than triples of letters.
    short = cuts.where(F.length("piece") <= 3).join(F.broadcast(words.where(F.length("piece") <= 3)), "piece")
    found = short.unionByName(cuts.where(F.length("piece") > 3).join(words.where(F.length("piece") > 3), "piece"))
    found = found.groupBy("run").agg(F.collect_list("piece").alias("pieces"), F.collect_list("known").alias("known"))

    def split(batches):
        for batch in batches:
            made = [Segmenter(dict(zip(texts or (), known or ())), total, most).split(run) for run, texts, known in zip(*(batch.column(c).to_pylist() for c in ("run", "pieces", "known")))]
            yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("n"), pa.array(made, pa.list_(pa.string()))], names=["run", "n", "words"])

    return cut(counted.join(found, "run", "left").mapInArrow(split, "run string, n bigint, words array<string>"), "url-runs")


def scored_texts(ruled: DataFrame, counted: DataFrame, longest: int) -> tuple[DataFrame, float]:
    """Scores of the runs of each distinct (host, path), with n, its rows, and the log-odds of the classes; all of it joined."""
    rows_of = lambda kind: F.count(F.when(F.col("ruling") == kind, 1))
    texts = cut(ruled.groupBy("host", "path").agg(F.count("*").alias("n"), rows_of("block").alias("block"), rows_of("allow").alias("allow")), "url-texts")
    runs = segmented(cut(counted, "url-counts"), longest)
    n_block, n_allow = (x or 0 for x in texts.agg(F.sum("block"), F.sum("allow")).first())
    each = texts.where("block + allow > 0").select("block", "allow", F.explode(all_runs()).alias("run"))
    by_run = each.groupBy("run").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    words = by_run.join(runs, "run").select(F.explode("words").alias("word"), "block", "allow").groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    words = cut(words.where(F.lit(bool(n_block and n_allow))).withColumn("n", F.col("block") + F.col("allow")), "url-bayes")
    size, block, allow = words.agg(F.count("*"), F.sum("block"), F.sum("allow")).first()
    t_block, t_allow = (block or 0) + size, (allow or 0) + size
    placed = looked_up(runs.select("run", F.posexplode("words").alias("pos", "word")), ["word"], words, VOCABULARY)
    placed = placed.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("pos", "block", "allow"))).alias("c"))

    def score(batches):
        for batch in batches:
            made = [sum(log_odds_of(w["block"], w["allow"], t_block, t_allow) for w in c or ()) for c in batch.column("c").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("n"), pa.array(made, pa.float64())], names=["run", "n", "score"])

    scores = cut(runs.select("run", "n").join(placed, "run", "left").mapInArrow(score, "run string, n bigint, score double"), "url-scores")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "score")))["score"]
    spread = texts.select("host", "path", F.posexplode(all_runs()).alias("pos", "run"))
    per_text = looked_up(spread, ["run"], scores, VOCABULARY).groupBy("host", "path").agg(ordered.alias("scores"))
    return cut(texts.select("host", "path", "n").join(per_text, ["host", "path"], "left"), "url-scored"), prior_of(n_block, n_allow)


def judge(prior: float, scores_of):
    """A function of a batch to log_odds and verdict; ``scores_of`` gives the scores of each row's runs."""

    def fn(batch):
        log_odds = [prior + sum(scores) if scores else min(prior, -1.0) for scores in scores_of(batch)]
        verdict = [ruling or ("block" if x > 0 else "allow") for ruling, x in zip(batch.column("ruling").to_pylist(), log_odds)]
        return {"log_odds": log_odds, "verdict": verdict}

    return fn


def filter_urls(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", longest: int = 24) -> DataFrame:
    """The rows with host, path, rule, log_odds (of block) and verdict added.

    Input columns of such names are replaced (``url`` may be one of them); columns "ruling" and
    "run_scores" are used on the way and replaced too.  ``longest`` is the most letters of a model's word.
    """
    host, path = host_of(F.col(url))
    made = ("host", "path", "rule", "log_odds", "verdict", "ruling", "run_scores")
    kept = [c for c in df.columns if c.lower() not in made]
    book = Rules(rules)

    def apply():
        def fn(batch):
            hits = [book.match(h, p) or (None, None) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            return {"rule": [r for r, _ in hits], "ruling": [v for _, v in hits]}

        return fn

    ruled = append_columns(df.select(*kept, host.alias("host"), path.alias("path")), "path", "rule string, ruling string", apply)
    parts = df.select(host.alias("host"), path.alias("path"))
    counted = parts.select("host", F.explode(all_runs()).alias("run")).distinct().groupBy("run").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "run").limit(VOCABULARY + 1).collect()
    if len(top) > VOCABULARY or sum(len(r["run"]) for r in top) > VOCABULARY * 24:
        texts, prior = scored_texts(ruled.select("host", "path", "ruling"), counted, longest)
        named = ruled.select(*ruled.columns)
        joined = looked_up(named, ["host", "path"], texts.withColumnRenamed("scores", "run_scores"), TEXTS).select(*named.columns, "run_scores")
        judged = append_columns(joined, "path", "log_odds double, verdict string", lambda: judge(prior, lambda batch: batch.column("run_scores").to_pylist()))
    else:
        segmenter, odds, prior = train(ruled, top, longest)
        shared = df.sparkSession.sparkContext.broadcast((segmenter.counts, segmenter.total, segmenter.longest, odds))  # of VOCABULARY runs at most

        def make():
            *model, known = shared.value
            own = Segmenter(*model)
            score = Memo(lambda run: sum(known.get(w, 0.0) for w in own.memo[run]))
            runs = lambda x: RUNS.findall(x.translate(DOWN))
            return judge(prior, lambda batch: ([score[r] for r in runs(h) + runs(p)] for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())))

        judged = append_columns(ruled, "path", "log_odds double, verdict string", make)
    return judged.select(*kept, "host", "path", "rule", "log_odds", "verdict")
