"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A document's size is its number of words.  Sources in the order of their code points,
null last, have the weights given, repeated; targets share the words of all documents
by weight, but none is above ``most`` times its source, and what is over is shared again.
The sources that reach their limit are those of least limit by weight, so sums along
that order give all targets at once.

A source's documents stand one after another in an order by hash, and its words are
cut into blocks of BLOCK.  Its quota is what the rounded target takes: all blocks as
often as it holds the source whole, then blocks in a permuted order and the first words
of one more, so the mix takes exactly the rounded target.  The quotas of all sources
are dealt to output shards by a splitting tree: a node divides its shards into halves and
draws how many blocks of each source go left, a multivariate-hypergeometric draw as a
chain of hypergeometric ones, each by inversion from the mode outward with ratios of
neighbouring probabilities (mass beyond 10 deviations, under 1e-22, is left out).  A shard
then takes its numbers of blocks from each source's permuted ones, so shards are disjoint
and as random as a shuffle of all blocks, and shuffles its blocks by itself.

All of it is DataFrame expressions.  Permutations and places are ranks of sorted ranges,
so a source of most rows is many tasks.  More than SOURCES sources are dealt in
groups: first groups to shards, then each group's sources.  Every draw is a hash of
its place in the tree, so reruns agree.

A null text has no words and is not taken; an empty one neither.  A null source is a
source of its own.  Rows that repeat an id are documents of their own, in the order of
id, size and place.  If no document has words, all targets are 0.  No rows give no rows.
Columns that are not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograph.llm._common import cut, drop_cut
from tempograph.llm._scan import PART, ranged, scan

#: Words of a block, blocks of an output shard, sources of one node of the tree, and levels between written tables.
BLOCK, SHARD, SOURCES, LEVELS = 512, 4096, 1024, 3
WHITE = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A number from 0 up to 1, by hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), *parts), 11).cast("double") / float(1 << 53)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` draws from ``total`` hit one of ``good``, by inversion of u: the mode first, then upwards, then downwards."""
    n, k, d = (c.cast("double") for c in (total, good, drawn))
    low, high = F.greatest(F.lit(0).cast("bigint"), drawn + good - total), F.least(good, drawn)
    mode = F.least(high, F.greatest(low, F.floor((d + 1) * (k + 1) / (n + 2)).cast("bigint")))
    spread = (10 * F.sqrt(d * (k / n) * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0))) + 10).cast("bigint")
    begin, end = F.greatest(low, mode - spread), F.least(high, mode + spread)
    state = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"))
    up = lambda x: (k - x + 1) * (d - x + 1) / (x * (n - k - d + x))  # noqa: E731  of x to x - 1
    grow = lambda acc, ratio: F.struct((acc["p"] * ratio).alias("p"), (acc["sum"] + acc["p"] * ratio).alias("sum"))
    above = F.when(end > mode, F.sequence(mode + 1, end)).otherwise(F.array().cast("array<bigint>"))
    below = F.when(mode > begin, F.sequence(mode - 1, begin)).otherwise(F.array().cast("array<bigint>"))
    top = F.aggregate(above, state, lambda acc, x: grow(acc, up(x)), lambda acc: acc["sum"])
    whole = F.aggregate(below, F.struct(F.lit(1.0).alias("p"), top.alias("sum")), lambda acc, x: grow(acc, 1 / up(x + 1)), lambda acc: acc["sum"])

    def walk(ratio):
        def step(acc, x):
            p = acc["p"] * ratio(x)
            hit = F.when(acc["hit"].isNull() & (acc["left"] < p), x).otherwise(acc["hit"])
            return F.struct(p.alias("p"), (acc["left"] - p).alias("left"), hit.alias("hit"))

        return step

    first = F.struct(F.lit(1.0).alias("p"), (u * whole - 1).alias("left"), F.when(u * whole < 1, mode).alias("hit"))
    risen = F.aggregate(above, first, walk(up))
    fallen = F.aggregate(below, F.struct(F.lit(1.0).alias("p"), risen["left"].alias("left"), risen["hit"].alias("hit")), walk(lambda x: 1 / up(x + 1)))
    return F.when((drawn <= 0) | (good <= 0), F.lit(0).cast("bigint")).when(good >= total, drawn).when(drawn >= total, good).otherwise(F.coalesce(fallen["hit"], mode))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)


def drawn_left(quotas: Column, left: Column, *place: Column) -> Column:
    """For each quota how many of its blocks are among the ``left`` that go to the left half."""
    start = F.struct(total(quotas).alias("rest"), left.alias("left"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, quota):
        x = hypergeometric(acc["rest"], quota, acc["left"], uniform(*place, F.size(acc["out"])))
        return F.struct((acc["rest"] - quota).alias("rest"), (acc["left"] - x).alias("left"), F.concat(acc["out"], F.array(x)).alias("out"))

    return F.aggregate(quotas, start, step, lambda acc: acc["out"])


def dealt(nodes: DataFrame, most: int) -> DataFrame:
    """(group, shard, quotas) of every shard, from a root (group, shard, caps, quotas) for each group: caps are the shards' numbers of blocks, at most ``most`` shards."""
    halves, done = 1, 0
    while halves < most:
        half = F.ceil(F.size("caps") / 2).cast("int")
        left = nodes.withColumns({"_half": half, "_few": F.slice("caps", F.lit(1), half)})
        left = left.withColumn("_left", F.when(F.size("caps") > 1, drawn_left(F.col("quotas"), total(F.col("_few")), F.col("group"), F.col("shard"), F.size("caps"))))
        one = F.struct(F.col("shard").alias("shard"), F.col("caps").alias("caps"), F.col("quotas").alias("quotas"))
        first = F.struct(F.col("shard").alias("shard"), F.col("_few").alias("caps"), F.col("_left").alias("quotas"))
        rest = F.struct((F.col("shard") + F.col("_half")).alias("shard"), F.slice("caps", F.col("_half") + 1, F.size("caps")).alias("caps"), F.zip_with("quotas", "_left", lambda q, x: q - x).alias("quotas"))
        nodes = left.select("group", F.explode(F.when(F.size("caps") > 1, F.array(first, rest)).otherwise(F.array(one))).alias("n")).select("group", "n.*")
        halves, done = 2 * halves, done + 1
        if done % LEVELS == 0:
            nodes = cut(nodes.repartition("group", "shard"), "tree")
    return nodes.select("group", "shard", "quotas")


def targets(sizes: DataFrame, weights: list[int], most: int) -> DataFrame:
    """Adds place (from 0, in the order of ``key``), weight and target to the sources (key, source_size), written."""
    order = [F.asc("key")]
    apart = ranged(sizes, [], order)
    placed = scan(apart, [], order, {"place": F.lit(1)}, {"every": F.col("source_size")}).drop(PART)
    weighed = placed.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights))).cast("int")).cast("bigint"))
    weighed = weighed.withColumn("limit", most * F.col("source_size"))
    order = [(F.col("limit") / F.col("weight")).asc(), F.asc("place")]
    again = ranged(weighed, [], order)
    summed = cut(scan(again, [], order, {"full": F.col("limit"), "passed": F.col("weight")}, {"all_weights": F.col("weight")}).drop(PART), "targets")
    # A source is open if what the ones before it leave gives it no more than its limit; the first open one sets the level.
    share = (F.col("every") - F.col("full")) / (F.col("all_weights") - F.col("passed"))
    first = summed.where(F.col("limit") >= F.col("weight") * share).agg(F.min(F.struct("passed", "full")).alias("s")).select("s.passed", "s.full").first()
    gone, spent = (F.lit(x).cast("bigint") for x in (first or (None, None)))  # one row
    level = F.col("weight") * (F.col("every") - spent) / (F.col("all_weights") - gone)
    target = F.when(F.col("passed") >= gone, level).otherwise(F.col("limit")).cast("double")
    return cut(summed.select("key", "place", "source_size", target.alias("target")), "targets")


def quotas_of(sources: DataFrame, block: int) -> DataFrame:
    """Adds to the sources what they give: words in all, epochs held whole, blocks of one, full blocks of the last, words of its last block, and draws in all."""
    words = F.round("target").cast("bigint")
    out = sources.withColumns({"words": words, "blocks": F.ceil(F.col("source_size") / block).cast("bigint")}).where("words > 0")
    epochs = F.floor(F.col("words") / F.col("source_size")).cast("bigint")
    out = out.withColumn("epochs", epochs).withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size"))
    out = out.withColumns({"full": F.floor(F.col("rest") / block).cast("bigint"), "tip": F.col("rest") % block})
    return out.withColumn("quota", F.col("epochs") * F.col("blocks") + F.col("full") + (F.col("tip") > 0).cast("bigint"))


def shards_of(sources: DataFrame, shard: int, group: int) -> DataFrame:
    """(place, shard, first, count) of every source and shard that takes blocks of it: the draws from ``first`` on."""
    n = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n"), F.coalesce(F.max("place"), F.lit(0)).alias("last")).first()
    most = max(1, -(-n["n"] // shard))
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor((i + 1) * F.lit(n["n"]) / most).cast("bigint") - F.floor(i * F.lit(n["n"]) / most).cast("bigint"))
    own = sources.withColumn("group", F.floor(F.col("place") / group).cast("int"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "quota"))), lambda x: x["quota"])
    groups = own.groupBy("group").agg(listed.alias("quotas"), F.array_sort(F.collect_list("place")).alias("places"), F.sum("quota").alias("sum"))
    if n["last"] < group:
        roots = groups.withColumn("caps", even)
    else:  # groups first: a row for each ``group`` sources
        every = groups.groupBy().agg(F.array_sort(F.collect_list(F.struct("group", "sum"))).alias("g"))
        root = every.select(F.col("g.group").alias("group"), F.lit(0).alias("shard"), even.alias("caps"), F.col("g.sum").alias("quotas"))
        leaves = dealt(cut(root, "roots"), most).select("shard", F.explode(F.arrays_zip("group", F.col("quotas").alias("sum"))).alias("x")).select("shard", "x.*")
        caps = leaves.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "sum"))), lambda x: x["sum"]).alias("caps"))
        roots = groups.join(caps, "group")
    # A group is named by the places of its sources.
    roots = cut(roots.select(F.col("places").alias("group"), F.lit(0).alias("shard"), "caps", "quotas"), "roots")
    leaves = dealt(roots, most).select("shard", F.explode(F.arrays_zip(F.col("group").alias("place"), F.col("quotas").alias("count"))).alias("x")).select("shard", "x.*").where("count > 0")
    apart = ranged(leaves, ["place"], [F.asc("shard")])
    return scan(apart, ["place"], [F.asc("shard")], {"first": F.col("count")}).drop(PART)


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: list[int] | None = None,
    most: int = 3,
    block: int = BLOCK,
    shard: int = SHARD,
    group: int = SOURCES,
) -> tuple[DataFrame, DataFrame]:
    """The documents (id, row, size, source_size, target) and the pieces of the mix (shard, place, id, row, start, length), place by place within a shard.

    ``row`` tells rows apart; start and length are words of the document.  Pieces of one block have one place.
    """
    key = F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))
    docs = df.select(F.col(id_col).alias("id"), key.alias("key"), n_words(F.col(text)).alias("size"), F.monotonically_increasing_id().alias("row"))
    docs = cut(docs.withColumn("h", F.xxhash64("id", "size")), "sizes")
    sources = targets(docs.groupBy("key").agg(F.sum("size").alias("source_size")), weights or [1, 2, 3], most)
    order = [F.asc("h"), F.asc_nulls_first("id"), F.asc("size"), F.asc("row")]
    apart = ranged(docs, ["key"], order)
    drop_cut(docs)
    known = scan(apart, ["key"], order, {"at": F.col("size")}).drop(PART, "h").join(sources, "key").drop("key")
    known = cut(known, "known")
    drop_cut(apart)

    quotas = cut(quotas_of(sources, block), "quotas")
    # The blocks that begin in a document, from 1 word on.
    begins = F.sequence(F.ceil(F.col("at") / block).cast("bigint"), F.floor((F.col("at") + F.col("size") - 1) / block).cast("bigint"))
    starts = known.where((F.col("size") > 0) & (F.ceil(F.col("at") / block) <= F.floor((F.col("at") + F.col("size") - 1) / block))).select("place", F.explode(begins).alias("block"))
    drawn = starts.join(quotas.select("place", "source_size", "blocks", "epochs", "full", "tip"), "place")
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs"))))
    tail = (F.col("block") + 1) * block > F.col("source_size")
    drawn = drawn.withColumns({"last": tail.cast("int"), "h": F.xxhash64(F.lit("block"), "place", "epoch", "block")})
    order = [F.asc("last"), F.asc("h"), F.asc("block")]
    apart = ranged(drawn, ["place", "epoch"], order)
    ranks = scan(apart, ["place", "epoch"], order, {"rank": F.lit(1)}).drop(PART)
    upto = F.when((F.col("epoch") < F.col("epochs")) | (F.col("rank") < F.col("full")), F.lit(block)).when(F.col("rank") == F.col("full"), F.col("tip")).otherwise(0)
    ranks = ranks.select("place", "block", (F.col("epoch") * F.col("blocks") + F.col("rank")).alias("draw"), upto.cast("bigint").alias("upto")).where("upto > 0")

    allotted = shards_of(quotas, shard, group).select("place", "shard", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)).alias("draw"))
    taken = ranks.join(allotted.hint("merge"), ["place", "draw"])  # a row a block: never to be broadcast, however short the ranges it comes from
    begin, end = F.greatest(F.col("at"), F.col("b") * block), F.least(F.col("at") + F.col("size"), (F.col("b") + 1) * block)
    pieces = known.where("size > 0").withColumn("b", F.explode(F.sequence(F.floor(F.col("at") / block).cast("bigint"), F.floor((F.col("at") + F.col("size") - 1) / block).cast("bigint"))))
    pieces = pieces.select("place", F.col("b").alias("block"), "id", "row", (begin - F.col("at")).alias("start"), (begin - F.col("b") * block).alias("in_block"), (end - begin).alias("length"))
    pieces = pieces.join(taken, ["place", "block"]).withColumn("length", F.least("length", F.col("upto") - F.col("in_block"))).where("length > 0")
    shuffled = F.xxhash64(F.lit("place"), "place", "draw")
    pieces = pieces.select("shard", F.struct(shuffled.alias("h"), F.col("place").alias("source"), "draw").alias("place"), "id", "row", "start", "length")
    return known.select(F.col("id").alias(id_col), "row", "size", "source_size", "target"), pieces.withColumnRenamed("id", id_col)


def mixed_documents(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, size, source_size, target, taken) of every row: the words that the mix takes of it, repeats counted."""
    documents, pieces = mix(df, id_col, **options)
    sums = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    out = documents.join(sums, "row", "left")
    return out.select(id_col, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
