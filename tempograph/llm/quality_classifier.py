"""Quality classifier: supervised subword embeddings.

Features of a text are hashed words and hashed character n-grams (``GRAMS`` bytes,
A-Z lower-cased), each with a learned vector of ``DIM`` values; a document is the
mean of its features' vectors, and a softmax layer gives the class probabilities.
Vectors and layer are trained together by stochastic gradient descent in numpy,
on at most ``max_rows`` labelled documents (those with the smallest hashes of
their ids, so the sample is the same on every run) and ``max_bytes`` of their texts
(in that order, whole texts only); these bounds keep the training on the driver small
and are documented parameters.  For scoring, the layer is multiplied into the vectors
once, which leaves one number for each feature.

Null and empty texts have no feature: their score is that of the bias alone.
With no labelled row, or only one class, the score is the share of label 1 (0.5
without any).  Rows of an id with several labels are all learned from, as far as the
bounds go.  Input columns named score or predicted are replaced, others are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempograph.llm._common import append_columns, texts

BITS, GRAMS, DIM = 17, (3, 5), 12
FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True


def features(text: str) -> np.ndarray:
    """Feature number of every word and every character n-gram of a text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    n, out = len(raw), []
    if not n:
        return np.empty(0, np.int64)
    wide, shift = raw.astype(np.uint64), np.uint64(64 - BITS)
    for g, size in enumerate(GRAMS):
        if n >= size:
            gram = np.zeros(n - size + 1, np.uint64)
            for i in range(size):
                gram |= wide[i : n - size + 1 + i] << np.uint64(8 * i)
            out.append((gram + np.uint64(1)) * FACTORS[g] >> shift)
    inside = ~BLANKS[raw]
    first = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if len(first):
        last = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False])))
        powers = np.cumsum(np.concatenate((np.zeros(1, np.uint64), (wide + np.uint64(1)) * position(n))), dtype=np.uint64)
        # A word's polynomial, freed of its place by the inverse power.
        value = (powers[last + 1] - powers[first]) * inverse(n)[first]
        out.append((value ^ value >> np.uint64(29)) * FACTORS[2] >> shift)
    return np.concatenate([np.empty(0, np.uint64), *out]).astype(np.int64)


BASE = 0x5851F42D4C957F2D
_powers: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        held = np.full(max(n, 4096), base, np.uint64)
        held[0] = 1
        held = np.cumprod(held, dtype=np.uint64)
        if n <= 1 << 20:
            _powers[name] = held
    return held[:n]


def position(n: int) -> np.ndarray:
    return _table("power", BASE, n)


def inverse(n: int) -> np.ndarray:
    return _table("inverse", pow(BASE, -1, 1 << 64), n)


@dataclass
class Model:
    vectors: np.ndarray  # features x DIM
    layer: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def weights(self) -> tuple[np.ndarray, float]:
        """One number for each feature, and the bias, of the log-odds of class 1."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[str, int]], epochs: int = 6, rate: float = 20.0, seed: int = 7) -> Model:
    """Stochastic gradient descent over (text, class) rows, in a shuffled order that the seed fixes."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32))
    share = sum(y for _, y in rows) / len(rows) if rows else 0.5
    if not 0 < share < 1:
        model.bias[:] = np.log([max(1e-9, 1 - share), max(1e-9, share)])
        return model
    bags = [(*(x.astype(t) for x, t in zip(np.unique(features(text), return_counts=True), (np.int64, np.float32))), y) for text, y in rows]
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            found, counts, y = bags[i]
            speed = rate * (1 - done / steps)
            done += 1
            w = counts / max(1.0, float(counts.sum()))
            own = model.vectors[found]
            mean = w @ own
            z = mean @ model.layer + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = model.layer @ p
            model.layer -= (0.02 * speed) * np.outer(mean, p)
            model.bias -= (0.002 * speed) * p
            model.vectors[found] = own - speed * np.minimum(w, 0.02)[:, None] * back
    return model


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 4000, max_bytes: int = 64 << 20, threshold: float = 0.3) -> DataFrame:
    """The rows with score (probability of label 1) and predicted (1 where the score reaches the threshold) added.

    ``labels`` has the ids to learn from in ``id_col`` and 0 or 1 in ``label``; other values and nulls are not used.
    Only texts enter the features.
    """
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and __id is not null")
    # The sample's size is bounded by max_rows, and so is this join's smaller side.
    chosen = marked.orderBy(F.xxhash64("__id"), "__id", "y").limit(max_rows)
    docs = df.select(F.col(id_col).alias("__own"), F.col(text).alias("text"))
    found = docs.join(F.broadcast(chosen), F.col("__own") == F.col("__id")).select("__own", F.coalesce("text", F.lit("")).alias("text"), "y")
    order = [F.xxhash64("__own"), F.col("__own"), F.col("y"), F.xxhash64("text")]
    first = found.withColumn("size", F.octet_length("text")).orderBy(*order).limit(max_rows)
    # max_rows rows at most, so this sum's single task is small.
    within = first.withColumn("upto", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= max_bytes)
    rows = sorted(((r["__own"], r["text"], r["y"]) for r in within.collect()), key=lambda r: (r[0], r[2], r[1]))
    model = train([(t, y) for _, t, y in rows])
    shared = df.sparkSession.sparkContext.broadcast(model.weights())

    def make():
        weight, bias = shared.value

        def fn(batch):
            score = []
            for x in texts(batch, text):
                found = features(x)
                z = bias + (float(weight[found].sum()) / len(found) if len(found) else 0.0)
                score.append(1 / (1 + np.exp(-min(max(z, -60.0), 60.0))))
            return {"score": score, "predicted": [int(s >= threshold) for s in score]}

        return fn

    return append_columns(df, text, "score double, predicted int", make)
