"""Secret scans in DataFrame expressions only.

Base kinds are patterns: ``assign`` (a name such as ``password``, a separator and a
value), ``access`` (access key ids) and ``hex``.  Spark finds matches but not their
places; those follow from the gaps between matches, which ``split`` gives, by
summing lengths in code points.

The method adds ``entropy`` spans: candidates are runs of 20 or more token
characters with a digit and a letter; over each, a window of ``WINDOW`` characters
slides (one character leaves, one enters: the counts of these two change by one, and
the sum of c * log2(c) by two table values).  A candidate is a span if the entropy
of some window reaches the threshold of its character class and neither a base
span covers it nor an allow-list pattern matches.

Null and empty texts have no span.  Rows that repeat are scanned one by one.  A column
named as the result is replaced; other columns are kept, whatever their names.  Work
is in proportion to a text's length, but for the lists of results, which are gathered
in blocks: n spans copy n ** (4 / 3) references.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograph.llm._common import unused

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

RUN = "A-Za-z0-9+/_=-"
CANDIDATE = f"(?<![{RUN}])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[{RUN}]{{20,}}"
WINDOW, BLOCK, CHUNK = 20, 64, 1024
#: Least entropy in bits of a window, by character class: (pattern of the class, bits), the first that fits.
CLASSES = (("^[0-9a-fA-F]+$", 2.9), ("^[A-Za-z0-9]+$", 3.6), (".", 3.7))
#: Candidates that are no secrets: UUIDs, placeholders, paths and slugs of plain words.
SLUG = "^/?([A-Za-z]+|[0-9]{1,8})([-_/=+]+([A-Za-z]+|[0-9]{1,8}))+/?$"
ALLOWED = (
    "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    "(?i)example|sample|dummy|placeholder|xxxx|0000000",
    SLUG,
    "(?i)^(md5|sha1|sha256|sha512)[-_=]",
)

SPAN = "array<struct<start:int,end:int,rank:int>>"


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once, though it be used within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scanned(items: Column, zero: Column, step, kind: str) -> Column:
    """The results of step(state, item) -> (state, result) along an array, as an array of ``kind``; results are gathered in blocks."""
    none = F.array().cast(f"array<{kind}>")
    start = lambda state: F.struct(state.alias("state"), none.alias("out"))

    def one(acc, x):
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def blocks(v):
        own, size = v["items"], v["block"]
        many = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / size).cast("int"))
        block = lambda acc, k: F.concat(acc, F.array(F.aggregate(F.slice(own, k * size + 1, size), start(F.element_at(acc, -1)["state"]), one)))
        grown = F.aggregate(many, F.array(start(zero)), block)
        return F.flatten(F.transform(grown, lambda x: x["out"]))

    sized = bound(items, lambda own: F.struct(own.alias("items"), F.greatest(F.lit(BLOCK), F.cbrt(2 * F.size(own)).cast("int")).alias("block")))
    return bound(sized, lambda v: F.when(F.size(v["items"]) > 0, blocks(v)).otherwise(none))


def places(text: Column, pattern: str, hits: Column) -> Column:
    """(start, end) of each hit, as structs."""
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))

    def step(at, x):
        begin = at + x["gap"]
        return begin + x["hit"], F.struct(begin.alias("start"), (begin + x["hit"]).alias("end"))

    return scanned(lengths, F.lit(0), step, "struct<start:int,end:int>")


def ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["end"], F.lit(rank).alias("rank")))


def lowest_sum(candidate: Column) -> Column:
    """Least sum of c * log2(c) over the windows of a candidate, by incremental counts.

    The window is a string of WINDOW characters at most; a character's count in it is what its removal shortens.
    """
    term = lambda c: c * math.log2(c) if c else 0.0
    rises = F.array(*[F.lit(term(c + 1) - term(c)) for c in range(WINDOW + 1)])  # by one more of c
    count = lambda x, window: F.length(window) - F.length(F.replace(window, x, F.lit("")))
    empty = F.struct(F.lit("").alias("window"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("best"))
    # The sum of a full window is noted when the next character enters, so that no step has to compute anything twice.
    best = lambda acc: F.when(F.length(acc["window"]) == WINDOW, F.least(acc["best"], acc["sum"])).otherwise(acc["best"])

    def step(acc, x):
        window = acc["window"]
        full, first = F.length(window) == WINDOW, F.substring(window, 1, 1)
        grown = F.get(rises, count(x, window))
        # The first character leaves: one less of it, which x itself may be.
        moved = F.when(x == first, 0.0).otherwise(grown - F.get(rises, count(first, window) - 1))
        return F.struct(
            F.concat(F.when(full, F.substring(window, 2, WINDOW)).otherwise(window), x).alias("window"),
            (acc["sum"] + F.when(full, moved).otherwise(grown)).alias("sum"),
            best(acc).alias("best"),
        )

    return F.aggregate(F.split(candidate, ""), empty, step, best)


def is_slug(candidate: Column) -> Column:
    """Whether SLUG fits, without a repeated group, which Java's patterns match by recursion."""
    parts = F.filter(F.split(candidate, "[-_/=+]+"), lambda p: p != "")
    ends = candidate.rlike("^/?[A-Za-z0-9]") & candidate.rlike("[A-Za-z0-9]/?$")
    return ends & (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike("^([A-Za-z]+|[0-9]{1,8})$"))


def is_random(candidate: Column) -> Column:
    entropy = F.lit(math.log2(WINDOW)) - lowest_sum(candidate) / WINDOW
    bits = F.lit(CLASSES[-1][1])
    for pattern, least in reversed(CLASSES[:-1]):
        bits = F.when(candidate.rlike(pattern), F.lit(least)).otherwise(bits)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | (is_slug(candidate) if pattern == SLUG else candidate.rlike(pattern))
    return ~allowed & (F.round(entropy, 9) >= bits)


def scan_secrets(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds ``out``: the spans (start, end in code points, end exclusive, rank of the kind in KINDS), by start and then rank."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int>>")
    df = df.drop(out)
    names = df.columns
    made = {n: unused(f"_{n}", names) for n in ("assign", "access", "hex", "runs", "base")}
    found = df.withColumns(
        {
            made["assign"]: F.regexp_extract_all(body, F.lit(ASSIGN), 0),
            made["access"]: F.when(F.contains(body, F.lit("AKIA")), F.regexp_extract_all(body, F.lit(ACCESS), 0)),
            made["hex"]: F.regexp_extract_all(body, F.lit(HEX), 0),
            made["runs"]: F.regexp_extract_all(body, F.lit(CANDIDATE), 0),
        }
    )
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    values = F.regexp_extract_all(body, F.lit(ASSIGN), 2)
    kept = F.filter(F.arrays_zip(places(body, ASSIGN, F.col(made["assign"])).alias("place"), values.alias("value")), lambda x: F.length(x["value"]) >= 6)
    base = found.withColumn(
        made["base"],
        F.concat(
            F.when(some(F.col(made["assign"])), ranked(F.transform(kept, lambda x: x["place"]), 0)).otherwise(ranked(none, 0)),
            F.when(some(F.col(made["access"])), ranked(places(body, ACCESS, F.col(made["access"])), 1)).otherwise(ranked(none, 1)),
            F.when(some(F.col(made["hex"])), ranked(places(body, HEX, F.col(made["hex"])), 2)).otherwise(ranked(none, 2)),
        ),
    )
    # Base spans and candidates in one order: a candidate is covered if a base span so far reaches its end.
    spot = lambda s, kind, run: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), run.alias("run"))
    runs = F.zip_with(places(body, CANDIDATE, F.col(made["runs"])), F.col(made["runs"]), lambda s, run: spot(s, 1, run))
    both = F.array_sort(F.concat(F.transform(made["base"], lambda s: spot(s, 0, F.lit(None).cast("string"))), runs))

    def reach(furthest, s):
        free = (s["kind"] == 1) & (furthest < s["end"])
        return F.when(s["kind"] == 0, F.greatest(furthest, s["end"])).otherwise(furthest), F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(free, s["run"]).alias("run"))

    free = scanned(both, F.lit(0), reach, "struct<start:int,end:int,run:string>")
    flagged = F.filter(free, lambda s: s["run"].isNotNull() & is_random(s["run"]))
    added = F.when(some(F.col(made["runs"])), F.transform(flagged, lambda s: F.struct(s["start"], s["end"], F.lit(3).alias("rank")))).otherwise(ranked(none, 3))
    spans = F.transform(F.array_sort(F.transform(F.concat(made["base"], added), lambda s: F.struct(s["start"], s["rank"], s["end"]))), lambda s: F.struct(s["start"], s["end"], s["rank"]))
    return base.withColumn(out, spans).select(*names, out)


def described(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("bigint")


def redact(df: DataFrame, text: str = "text", marker: str = "[secret]") -> DataFrame:
    """The rows with every span of the text (spans that overlap as one) replaced by the marker; texts without a span stay as they are."""
    names = df.columns
    spans = unused("_spans", names)
    found = scan_secrets(df, text, spans)

    def clean(v):
        chunks = v["chunks"]

        def piece(a, b):  # code points a to b, read from the chunks that hold them
            first = F.floor(a / CHUNK).cast("int")
            held = F.array_join(F.slice(chunks, first + 1, F.floor(b / CHUNK).cast("int") - first + 1), "")
            return F.substring(held, a - first * CHUNK + 1, b - a)

        def step(at, s):
            gap = F.when(s["start"] >= at, F.concat(piece(at, s["start"]), F.lit(marker))).otherwise("")
            return F.greatest(at, s["end"]), gap

        last = F.aggregate(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
        gaps = F.array_join(scanned(F.col(spans), F.lit(0), step, "string"), "")
        return F.concat(gaps, bound(last, lambda at: piece(at, v["size"])))

    cut = F.struct(F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"), F.length(text).alias("size"))
    return found.withColumn(text, F.when(F.size(spans) > 0, bound(cut, clean)).otherwise(F.col(text))).select(names)
