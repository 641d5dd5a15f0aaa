"""Near-duplicate documents by a multi-index Hamming join over MinHash signatures.

A document's set is its distinct word shingles.  Its signature has ``chunks`` x
``WIDTH`` MinHash values of 32 bits; the distance of two signatures is the number
of positions that differ, and pairs at a distance under ``2 * chunks`` are wanted.
The signature is split into chunks.  By the pigeonhole principle, two signatures
under that distance agree on some chunk in all positions but one at most; so for
each chunk and each position left out, the others form an index key, and every
wanted pair shares a key.  ``chunks`` is the least number for which a pair at the
similarity threshold is at a greater distance with a probability below ``MISS`` (two
sets have signatures that differ in a share of 1 - similarity of the positions);
more similar pairs are missed less.

Documents with equal sets are first joined to one class.  Each bucket then elects a
leader, the class that meets the most others, and each class is compared with the one
leader that it meets in most buckets; what is linked is one component.  A class of a large
bucket (over LARGE classes) that isn't linked is compared with the NEAREST, by their parity sketches, of HUBS
members of its largest bucket and of the smallest one that is large, so a dense group comes together though its leader be
an outsider, and no class is compared with all of it.
What then still meets in a bucket without being in one
component is compared once, the classes outside of a bucket's largest component
with all of the bucket, and is kept if sizes, parity sketches, the signatures' distance and that of ``BITS``
one-bit MinHash values allow it (a pair at the similarity fails the last with a probability
under 1e-9, six deviations).  Every pair so found is confirmed on full sets, which
travel as sorted hashes: a leader's set goes once to each group of GROUP partners, and
theirs stream past it.  Classes that meet and stay apart, though as near as the
bounds can tell, cost a test a pair; such tests are dealt over tasks by adaptive execution.

A parity sketch has ODD bits, each the parity of the number of shingles that fall on it.  Two sketches
differ in no more bits than the sets in shingles, so one that differs in more than linked sets can is
ruled out for certain; sets of some hundred shingles are ruled out nearly as by a count of all.

Sets are compared as 64-bit hashes of their shingles and equal sets by 128-bit
digests: two of n shingles collide with a probability under n**2 / 2**65, two of m
sets with one under m**2 / 2**129.

Null and empty texts have no set: they are linked with nothing and kept.  Rows
that repeat an id and text count once.  Rows that repeat an id with several texts
have each text's component; they share links where that id is the smallest of the
classes of these texts.  A null id is never linked.  Ids are compared as bigint; the
cast raises for a text that isn't a number.  Other columns of the input are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.llm._common import append_columns, bitmap, cut, drop_cut, looked_up, slices, texts
from tempograph.llm._graph import components
from tempograph.llm.bpe import Memo

WIDTH, MISS, BITS = 4, 4e-6, 2048
#: Keys of most rows whose values are sent to all tasks in a join, pairs of one class that a task confirms at once, and bits of the filter of ids.
HEAVY, GROUP, FILTER = 1000, 500, 1 << 26
#: Members of a bucket whose sketches a class is held against, those of them that it is compared with, classes of a bucket that is large, and bits of a parity sketch.
HUBS, NEAREST, LARGE, ODD = 40, 4, 96, 1024
MIX = np.uint64(0x9E3779B97F4A7C15)


def chunks_for(similarity: float) -> int:
    """Least number of chunks for which a pair at the similarity is under the distance 2 * chunks but for a chance of MISS."""
    for chunks in range(2, 200):
        n, p = chunks * WIDTH, 1 - similarity
        beyond = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(2 * chunks, n + 1))
        if beyond <= MISS:
            return chunks
    raise ValueError(f"similarity {similarity} is too low for this index")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes."""

    def __init__(self, size: int):
        self.size = size
        self.words = Memo(xxhash.xxh64_intdigest, 50_000)
        self.factor = mixed(np.arange(1, size + 1, dtype=np.uint64) * MIX) | np.uint64(1)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(h))
        total = np.zeros(len(h) - size + 1, np.uint64)
        for i in range(size):
            total = mixed(total + h[i : len(h) - size + 1 + i] * self.factor[i])
        return np.unique(total + np.uint64(0 if size == self.size else size))


def digest(shingles: np.ndarray) -> int:
    """Half of the 128-bit digest of a set."""
    return int(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8")[0])


class Signer:
    """MinHash signature and index keys of a shingle set."""

    def __init__(self, chunks: int):
        n = chunks * WIDTH
        seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * MIX)
        self.a, self.b = (seeds[:n] | np.uint64(1))[:, None], seeds[n:][:, None]
        self.chunks = chunks
        tags = mixed(np.arange(chunks * WIDTH, dtype=np.uint64) + np.uint64(77))
        self.tags = tags.reshape(chunks, WIDTH)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 4096):
            out = np.minimum(out, (shingles[at : at + 4096] * self.a + self.b).min(axis=1))
        return (mixed(out) >> np.uint64(32)).astype(np.uint32)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """(documents, chunks * WIDTH) keys: of each chunk, with one position left out."""
        parts = signatures.reshape(-1, self.chunks, WIDTH).astype(np.uint64)
        out = np.empty(parts.shape, np.uint64)
        for skip in range(WIDTH):
            key = np.broadcast_to(self.tags[:, skip], parts.shape[:2]).copy()
            for i in range(WIDTH):
                if i != skip:
                    key = mixed(key * np.uint64(31) + parts[:, :, i])
            out[:, :, skip] = key
        return out.reshape(len(parts), -1).view(np.int64)


def furthest(similarity: float) -> int:
    """Differing one-bit MinHash values that a pair at the similarity may have: the mean and six deviations."""
    p = (1 - similarity) / 2
    return int(np.ceil(BITS * p + 6 * np.sqrt(BITS * p * (1 - p))))


class BitSigner:
    """BITS one-bit MinHash values of a set, packed into 64-bit words."""

    def __init__(self):
        seeds = mixed(np.arange(1, 2 * BITS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.a, self.b = (seeds[:BITS] | np.uint64(1))[:, None], seeds[BITS:][:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(BITS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 512):
            out = np.minimum(out, (shingles[at : at + 512] * self.a + self.b).min(axis=1))
        return np.packbits((mixed(out) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """The parity sketch of a set, packed into 64-bit words."""
    counts = np.bincount((shingles >> np.uint64(64 - ODD.bit_length() + 1)).astype(np.int64), minlength=ODD)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def word_lists(rows: list[np.ndarray], n: int) -> pa.ListArray:
    """Rows of n words each as a column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * n), pa.array(np.array(rows, np.int64).reshape(-1)))


def set_rows(df: DataFrame, id_col: str, text: str, shingle: int, nodes: DataFrame) -> DataFrame:
    """(node, d, n, odd, shingles) of the texts of the given nodes: the digest of each set, its size, parity sketch and sorted hashes, written.

    Nodes' bits in a bitmap keep back most other texts, so sets and not texts are joined.
    """
    bits = min(FILTER, 1 << max(15, (16 * nodes.count()).bit_length()))
    held = df.sparkSession.sparkContext.broadcast(bitmap(nodes, F.pmod(F.xxhash64("node"), F.lit(bits)), bits))

    def run(batches):
        shingler, seen = Shingler(shingle), np.unpackbits(np.frombuffer(held.value, np.uint8), bitorder="little").view(bool)
        for whole in batches:
            whole = whole.filter(pa.array(seen[whole.column("place").to_numpy()], pa.bool_()))
            for batch in slices(whole, "text"):
                sets = [shingler(x) for x in texts(batch, "text")]
                own = [pa.array([digest(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), word_lists([parities(x) for x in sets], ODD // 64), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("node"), *own], names=["node", "d", "n", "odd", "shingles"])

    docs = df.select(F.col(id_col).cast("bigint").alias("node"), F.col(text).alias("text")).where("text is not null and node is not null")
    rows = docs.withColumn("place", F.pmod(F.xxhash64("node"), F.lit(bits))).mapInArrow(run, "node bigint, d bigint, n bigint, odd array<bigint>, shingles binary")
    return cut(rows.join(nodes, "node", "left_semi").dropDuplicates(["node", "d"]), "sets")


def bit_rows(sets: DataFrame) -> DataFrame:
    """(node, d, odd, words): the words of each set's parity sketch and of its one-bit signature."""

    def make():
        signer = BitSigner()

        def fn(batch):
            return {"words": word_lists([signer(np.frombuffer(x, np.uint64)) for x in batch.column("shingles").to_pylist()], BITS // 64)}

        return fn

    return append_columns(sets, "shingles", "words array<bigint>", make).select("node", "d", "odd", "words")


def sketch(df: DataFrame, id_col: str, text: str, shingle: int, chunks: int) -> DataFrame:
    """node, n_shingles, h1, h2 (128-bit digest of the set), signature and keys of every row."""

    def make():
        shingler, signer = Shingler(shingle), Signer(chunks)

        def fn(batch):
            sets = [shingler(x) for x in texts(batch, text)]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            signatures = np.array([signer.signature(s) for s in sets], np.uint32).reshape(len(sets), -1)
            keys = signer.keys(signatures)
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1])
            return {
                "n_shingles": [len(s) for s in sets],
                "h1": pa.array(digests[:, 0].copy()),
                "h2": pa.array(digests[:, 1].copy()),
                "signature": pa.ListArray.from_arrays(offsets, pa.array(signatures.ravel().view(np.int32))),
                "keys": pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
            }

        return fn

    docs = df.select(F.col(id_col).cast("bigint").alias("node"), F.col(text).alias("text"))
    return append_columns(docs, "text", "n_shingles bigint, h1 bigint, h2 bigint, signature array<int>, keys array<bigint>", make).drop("text")


def distance(x: Column, y: Column) -> Column:
    """Positions in which two signatures differ."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a != b).cast("int")), F.lit(0), lambda n, d: n + d)


def bits_apart(x: Column, y: Column) -> Column:
    """Differing bits of two one-bit signatures."""
    parts = [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64)]
    return sum(parts[1:], parts[0])


def excess(n_a: Column, odd_a: Column, n_b: Column, odd_b: Column, percent: int) -> Column:
    """Over 0 if two sets differ, by their sizes and parity sketches, in too many shingles for the similarity; the less, the nearer."""
    apart = F.aggregate(F.zip_with(odd_a, odd_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)
    return (100 + percent) * apart - (100 - percent) * (n_a + n_b)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, own: list[str] | None = None) -> DataFrame:
    """Those of the distinct pairs (a, b), with the columns ``own``, whose full sets reach the similarity, written.  sets: (node, shingles).

    ``pairs`` is a written table; its column ``n`` is the number of a's pairs, or more (rows of one a may differ, where each row's
    own pairs are meant).  A class ``a`` of many pairs is dealt over as many groups as keep each under GROUP pairs.  A group's rows are its own set and then the sets of its partners, so a task holds
    one set at a time.
    """
    own = own or []
    names = ["a", "b", *own]

    def run(batches):
        group, held = None, []
        for whole in batches:
            for batch in slices(whole, "shingles"):
                keep = []
                for a, g, b, shingles in zip(*(batch.column(c).to_pylist() for c in ("a", "g", "b", "shingles"))):
                    other = np.frombuffer(shingles, np.uint64)
                    if group != (a, g):
                        group, held = (a, g), []
                    if b is None:  # an id may have several texts
                        held.append(other)
                        keep.append(False)
                    else:
                        keep.append(any(similar(x, other, percent) for x in held))
                yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    groups = F.ceil(F.col("n") / GROUP).cast("int")
    dealt = pairs.withColumn("g", F.pmod(F.xxhash64("b"), groups).cast("int"))
    partners = dealt.join(sets.select(F.col("node").alias("b"), "shingles"), "b").select(*names, "g", "shingles")
    leads = pairs.groupBy("a").agg(F.max(groups).alias("groups"))
    owners = leads.join(sets.select(F.col("node").alias("a"), "shingles"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), "shingles")
    rows = partners.unionByName(owners, allowMissingColumns=True).repartition("a", "g").sortWithinPartitions("a", "g", F.asc_nulls_first("b"))
    return cut(rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names)), "links")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def led(tagged: DataFrame) -> DataFrame:
    """(key, leader, lead, lead_size, members, n) of the buckets of several components, written: a member of their first component in the order of size and a hash, and that component.

    tagged: (key, node, component, size).
    """
    rank = F.struct("size", F.xxhash64("component").alias("h"), F.xxhash64("node").alias("turn"), "node", "component")
    found = tagged.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"), F.max(rank).alias("m"))
    return cut(found.where("x <> y").select("key", F.col("m.node").alias("leader"), F.col("m.component").alias("lead"), F.col("m.size").alias("lead_size"), F.col("n").alias("members"), "n"), "leaders")


def hubs_of(shared: DataFrame, wanted: DataFrame, odds: DataFrame) -> DataFrame:
    """(key, hubs, pairs, n) of the buckets wanted (key, n): up to HUBS of their members, one for each value of a hash, so they come from a pre-aggregated sum, with their sketches."""
    own = looked_up(shared.select("key", "node"), ["key"], wanted.withColumn("pairs", F.col("n")), HEAVY)
    slot = F.pmod(F.xxhash64("node", F.lit("slot")), F.lit(HUBS))
    best = own.groupBy("key", slot.alias("slot")).agg(F.max(F.struct(F.xxhash64("node").alias("h"), "node")).alias("m"), F.max("pairs").alias("pairs"))
    known = best.select("key", F.col("m.node").alias("node"), "pairs").join(odds, "node")
    return cut(known.groupBy("key").agg(F.collect_list(F.struct("node", "n", "odd")).alias("hubs"), F.max("pairs").alias("pairs")).withColumn("n", F.col("pairs")), "hubs")


def nearest(alone: DataFrame, percent: int) -> DataFrame:
    """(a, b, n): the NEAREST hubs a of each class b and bucket, of those that its sketch allows.  alone: (b, own, odd, hubs, pairs), own being its size."""
    # A hub or class of several texts has no sketch, and nothing rules it out.
    over = lambda h: F.when(h["node"] == F.col("b"), 1).otherwise(F.coalesce(excess(F.col("own"), F.col("odd"), h["n"], h["odd"], percent), F.lit(0)))
    ranked = F.array_sort(F.transform("hubs", lambda h: F.struct(over(h).cast("bigint").alias("over"), h["node"].alias("node"))))
    able = F.slice(F.filter(ranked, lambda h: h["over"] <= 0), 1, NEAREST)
    found = alone.select(F.explode(F.transform(able, lambda h: h["node"])).alias("a"), "b", "pairs")
    return found.groupBy("a", "b").agg(F.max("pairs").alias("n"))


def joined(members: DataFrame, hooks: DataFrame) -> DataFrame:
    """The members (node, component), written, where a class (b) that was linked has its leader's component (lead) for its own.

    Only what is linked comes under one name, though not all of it: that is left to components().
    """
    up = hooks.groupBy("b").agg(F.min("lead").alias("lead"))
    return cut(members.join(up.withColumnRenamed("b", "component"), "component", "left").select("node", F.coalesce("lead", "component").alias("component")), "members")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; component_id is the smallest id reachable by links."""
    chunks = chunks_for(percent / 100)
    sketches = cut(sketch(df, id_col, text, shingle, chunks), "sketches")
    some = sketches.where("n_shingles > 0 and node is not null")
    classes = cut(some.groupBy("h1", "h2").agg(F.min("node").alias("node"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("keys").alias("keys")), "classes")
    keyed = classes.select("node", F.explode("keys").alias("key"))
    buckets = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key", "n", F.col("n").alias("members")), "buckets")
    shared = cut(looked_up(keyed, ["key"], buckets, HEAVY).distinct(), "shared")
    place = F.when(F.col("members") > LARGE, F.struct("members", "key"))
    met = cut(shared.groupBy("node").agg(F.sum("members").alias("size"), F.min(place).alias("least"), F.max(place).alias("most")), "met")
    sets = set_rows(df, id_col, text, shingle, met.select("node"))
    signatures = classes.select("node", "n", "signature")
    one, two = (signatures.toDF(*(f"{c}_{s}" for c in signatures.columns)) for s in "ab")
    able = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (distance(F.col("signature_a"), F.col("signature_b")) < 2 * chunks)

    # At first each class is a component, and those come first that meet the most others.
    members = met.select("node", F.col("node").alias("component"), "size")
    tagged = shared.select("key", "node").join(members, "node")
    leaders = led(tagged)
    votes = looked_up(tagged, ["key"], leaders, HEAVY).where("component <> lead").groupBy("node", "lead").agg(F.count("*").alias("votes"), F.max("members").alias("members"), F.max("lead_size").alias("n"))
    best = votes.groupBy("node").agg(F.max(F.struct("votes", F.xxhash64("lead").alias("h"), "lead", "members", "n")).alias("m"))
    # A leader has no more pairs than it meets classes in its buckets.
    star = cut(best.select(F.col("m.lead").alias("a"), F.col("node").alias("b"), F.col("m.lead").alias("lead"), "m.members", "m.n"), "star")
    links = [confirm(star, sets, percent, ["lead"])]
    tested = [star.select("a", "b")]
    members = joined(members.select("node", "component"), links[0])
    alone = met.where("most is not null").join(links[0].select(F.col("b").alias("node")), "node", "left_anti")
    alone = cut(alone.select(F.col("node").alias("b"), F.explode(F.array_distinct(F.array("least.key", "most.key"))).alias("key")), "alone")
    wanted = cut(alone.groupBy("key").agg(F.count("*").alias("n")), "wanted")
    if wanted.limit(1).count():
        one_text = F.count("*") == 1
        odds = sets.groupBy("node").agg(F.when(one_text, F.first("n")).alias("n"), F.when(one_text, F.first("odd")).alias("odd"))
        alone = alone.join(odds.select(F.col("node").alias("b"), F.col("n").alias("own"), "odd"), "b")
        star = cut(nearest(looked_up(alone, ["key"], hubs_of(shared, wanted, odds), HEAVY), percent), "star")
        links.append(confirm(star, sets, percent))
        tested.append(star.select("a", "b"))
        named = components(links[0].select("a", "b").union(links[1].select("a", "b"))).withColumnRenamed("component", "name")
        members = cut(members.join(named, "node", "left").select("node", F.coalesce("name", "node").alias("component")), "members")
    known = tested[0]
    for more in tested[1:]:
        known = known.union(more)
    tested = known

    # What still meets in a bucket without being in one component: those outside of its largest one against all.
    sizes = cut(members.groupBy("component").agg(F.count("*").alias("n")).withColumn("size", F.col("n")), "sizes")
    members = cut(looked_up(members, ["component"], sizes, HEAVY), "members")
    tagged = shared.select("key", "node").join(members, "node")
    leaders = led(tagged)
    apart = cut(looked_up(tagged, ["key"], leaders, HEAVY).select("key", "node", "component", "members", (F.col("component") != F.col("lead")).alias("minor")), "apart")
    if apart.limit(1).count():
        own = classes.select("node", F.col("h1").alias("d"), "n", "signature", "keys")
        words = cut(bit_rows(sets.join(apart.select("node").distinct(), "node", "left_semi")).join(own, ["node", "d"]).drop("d"), "words")
        rows = apart.join(words, "node").where(F.array_contains("keys", F.col("key")))
        a, b = (rows.toDF(*(c if c == "key" else f"{c}_{t}" for c in rows.columns)) for t in "ab")
        close = bits_apart(F.col("words_a"), F.col("words_b")) <= furthest(percent / 100)
        once = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")  # though they meet in several buckets
        other = (F.col("component_a") != F.col("component_b")) & (~F.col("minor_b") | (F.col("node_a") < F.col("node_b")))
        near = excess(F.col("n_a"), F.col("odd_a"), F.col("n_b"), F.col("odd_b"), percent) <= 0
        rest = a.where("minor_a").join(b, "key").where(other & close & near & able & once).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("members_a").alias("n"))
        known = tested.union(tested.select("b", "a"))
        pairs = cut(rest.groupBy("a", "b").agg(F.max("n").alias("n")).join(known, ["a", "b"], "left_anti"), "pairs")
        links.append(confirm(pairs, sets, percent))
        drop_cut(words)
        drop_cut(pairs)
    every = links[0].select("a", "b")
    for more in links[1:]:
        every = every.union(more.select("a", "b"))
    final = components(every)
    for done in (buckets, shared, sets, apart, leaders, *links):
        drop_cut(done)

    by_class = classes.select("h1", "h2", F.col("node").alias("rep"))
    labels = by_class.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("node", "n_shingles", "h1", "h2").join(labels, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.col("node"))
    return out.select(F.col("node").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("node").isNull() | (F.col("node") == component)).alias("kept"))
