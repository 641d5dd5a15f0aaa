"""A trie of conversation prefixes with rollups.

A node is a distinct sequence of first turns (role and text); its members are the
conversations that start so.  A prefix is known by its depth and the exclusive or of
128-bit hashes of its turns with their places, which adds up along a conversation
cut into ranges; two of n prefixes collide with a probability under n**2 / 2**129.

The trie is dealt into prefix shards: subtrees of at most SHARD nodes, each below
the shallowest of a conversation's prefixes of 1, 2, 4, 8, ... turns that is so light.
Shards are put together to bins of about SHARD nodes by a hash.  In a bin, numpy
brings the nodes into level order, writes the shape as a LOUDS bitvector (a 1 for
each child and a 0 at the end of each node) beside the array of labels, reads the
parents off it, and adds the rollups up in reverse level order with ``add.at``.  The
heavy upper levels (the root, and what no light prefix covers) are merged apart:
their children's sums are aggregated before any shuffle, and pointers to ancestors
double, so that a chain of n heavy nodes takes log2(n) rounds.

Turns of a conversation are in the order of ``turn``, null first, then of role, then of
the text's hash.  A null role or text is the empty one.  Rows that repeat are turns of
their own.  Rows with a null conversation belong to none and are left out;
conversations without turns are members of the root if ``conversations`` lists them.
No conversations give no nodes.  Columns of the input that are not named may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.llm._common import cut, drop_cut, looked_up
from tempograph.llm._scan import PART, ranged, scan, scan_xor

#: Most nodes of a prefix shard, nodes whose children are looked up apart, and ids of one run of ends.
SHARD, HEAVY, ENDS = 1 << 16, 1000, 1 << 16
WORDS = " \t\n\x0b\x0c\r"
NONE = hashlib.sha256().hexdigest()


def n_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WORDS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("bigint")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, size, words, x1, x2, p1, p2) of every turn, written: the prefix up to it and the one before it."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    labels = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit("turn"), text, role).alias("t2"),
        n_words(text).alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    labels = cut(labels, "labels")
    order = [F.asc_nulls_first("turn"), *map(F.asc, ("role", "t1", "t2", "row"))]
    apart = ranged(labels, ["conv_id"], order)
    drop_cut(labels)
    placed = scan(apart, ["conv_id"], order, {"pos": F.lit(1)}, {"size": F.lit(1)}).select(PART, "conv_id", (F.col("pos") + 1).alias("depth"), "size", "words", "t1", "t2")
    placed = cut(placed.withColumns({"m1": F.xxhash64("depth", "t1", "t2"), "m2": F.xxhash64("t2", "depth", "t1")}).drop("t1", "t2"), "turns")
    drop_cut(apart)
    through = scan_xor(placed, ["conv_id"], [F.asc("depth")], {"x1": F.col("m1"), "x2": F.col("m2")})
    rows = cut(through.select("conv_id", "depth", "size", "words", "x1", "x2", F.col("x1").bitwiseXOR(F.col("m1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("m2")).alias("p2")), "prefixes")
    drop_cut(placed)
    return rows


class Louds:
    """Level-order unary degree sequence of a forest: ``bits`` has a 1 for each child of a node and then a 0, nodes in level order, the roots as children of one more node at the front."""

    def __init__(self, depth: np.ndarray, key: np.ndarray, parent: np.ndarray):
        """Nodes by depth, key and parent's key (structured arrays); a parent that isn't among the keys makes a root."""
        n = len(key)
        by_key = np.argsort(key, kind="stable")
        at = np.minimum(np.searchsorted(key[by_key], parent), max(n - 1, 0))
        found = by_key[at] if n else at
        above = np.where(key[found] == parent, found, -1) if n else np.empty(0, np.int64)
        level = np.zeros(n, np.int64)  # of the forest: roots may stand at any depth
        rank = np.full(n, -1, np.int64)
        by_depth = np.argsort(depth, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(depth[by_depth]) > 0]) if n else np.empty(0, np.int64)
        for own in np.split(by_depth, starts[1:]) if n else []:
            inner = own[above[own] >= 0]
            level[inner] = level[above[inner]] + 1
        order = []
        by_level = np.argsort(level, kind="stable")
        ends = np.searchsorted(level[by_level], np.arange(level.max() + 2)) if n else [0]
        done = 0
        for a, b in zip(ends[:-1], ends[1:]):
            own = by_level[a:b]
            own = own[np.lexsort((own, np.where(above[own] >= 0, rank[above[own]], 0)))]
            rank[own] = done + np.arange(len(own))
            done += len(own)
            order.append(own)
        self.order = np.concatenate([*order, np.empty(0, np.int64)]).astype(np.int64)
        self.levels = np.asarray(ends, np.int64)
        above = above[self.order]
        slot = np.where(above >= 0, rank[above] + 1, 0)
        degrees = np.bincount(slot, minlength=n + 1)
        self.bits = np.zeros(2 * n + 1, bool)
        zeros = np.cumsum(degrees) + np.arange(n + 1)
        self.bits[:] = True
        self.bits[zeros] = False
        self.labels = key[self.order]

    def parents(self) -> np.ndarray:
        """Each node's parent in level order, -1 for a root: the zeros before its own 1."""
        return np.cumsum(~self.bits)[self.bits] - 1

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(~self.bits)
        return (np.diff(zeros) - 1).astype(np.int64)

    def roll_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, by adding levels to the ones above from the lowest on."""
        out, parents = values.astype(np.int64), self.parents()
        for a, b in zip(self.levels[-2:0:-1], self.levels[:0:-1]):
            np.add.at(out, parents[a:b], out[a:b])
        return out


def pairs(table: pa.Table, *names: str) -> np.ndarray:
    out = np.empty(table.num_rows, [(n, "i8") for n in "dab"])
    for field, name in zip("dab", names):
        out[field] = table.column(name).to_numpy()
    return out


def bin_sums(key, table):
    depth = table.column("depth").to_numpy()
    trie = Louds(depth, own := pairs(table, "depth", "x1", "x2"), _above(table))
    assert len(trie.labels) == len(own)
    table = table.take(pa.array(trie.order))
    members, words = table.column("n_convs").to_numpy(), table.column("words").to_numpy()
    children, parents = trie.degrees(), trie.parents()
    inner = parents >= 0
    conv = table.column("conv_id").to_numpy()
    above = pa.array(np.where(inner, conv[np.maximum(parents, 0)], 0), pa.int64(), mask=~inner)
    made = [children, trie.roll_up((children == 0).astype(np.int64)), trie.roll_up((members - 1) * words)]
    kept = [table.column(n) for n in ("conv_id", "depth", "x1", "x2", "p1", "p2", "n_convs")]
    return pa.table([*kept, above, *map(pa.array, made)], names=BINNED.replace(" bigint", "").split(", "))


def _above(table: pa.Table) -> np.ndarray:
    out = pairs(table, "depth", "p1", "p2")
    out["d"] -= 1
    return out


BINNED = "conv_id bigint, depth bigint, x1 bigint, x2 bigint, p1 bigint, p2 bigint, n_convs bigint, parent_conv_id bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def shard_of(nodes: DataFrame, rows: DataFrame, shard: int) -> DataFrame:
    """(conv_id, light, s1, s2): the depth and key of the first light prefix among those of 1, 2, 4, ... turns, for conversations that own nodes and have one.

    A node belongs to its smallest member; a conversation's own nodes are those from some depth to its end.
    """
    owned = nodes.where("depth > 0").groupBy("conv_id").agg(F.min("depth").alias("first"))
    ladder = rows.where(F.bit_count("depth") == 1).select("conv_id", "depth", "size", "x1", "x2")
    ladder = cut(ladder.join(owned, "conv_id").withColumn("weight", F.col("size") - F.greatest("first", "depth") + 1), "ladder")
    key = ["depth", "x1", "x2"]
    weights = ladder.groupBy(*key).agg(F.sum("weight").alias("weight"))
    # The heaviest prefixes go to all tasks: a prefix that most conversations share is then not shuffled by.
    heavy = cut(weights.where(F.col("weight") > shard), "heavy")
    first = F.broadcast(heavy.orderBy(F.desc("weight"), *key).limit(HEAVY).select(key))
    light = ladder.drop("weight").join(first, key, "left_anti")
    if heavy.count() > HEAVY:
        light = light.join(heavy.select(key).join(first, key, "left_anti"), key, "left_anti")
    return light.groupBy("conv_id").agg(F.min("depth").alias("light"), F.min_by(F.struct("x1", "x2"), "depth").alias("k")).select("conv_id", "light", F.col("k.x1").alias("s1"), F.col("k.x2").alias("s2"))


def merged(upper: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes of the upper levels with their rollups; roots: the shards' topmost nodes with theirs."""
    key, parent = ["depth", "x1", "x2"], [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    below = roots.select(*parent, "n_leaves", "saved_tokens").unionByName(upper.where("depth > 0").select(*parent, F.lit(0).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens")))
    sums = below.groupBy(*key).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    own = upper.join(sums, key, "left").withColumns(
        {
            "n_children": F.coalesce("n_children", F.lit(0)),
            "leaves": F.when(F.col("n_children").isNull(), 1).otherwise(F.col("l")).cast("bigint"),
            "saved": ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("s", F.lit(0))).cast("bigint"),
            "up": F.when(F.col("depth") > 0, F.struct(*parent)),
        }
    )
    now = cut(own.drop("l", "s", "words"), "upper")
    while now.where("up is not null").limit(1).count():
        sent = now.where("up is not null").groupBy("up").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count("*").alias("n"))
        told = now.select(F.struct(*key).alias("up"), F.col("up").alias("next")).join(sent.select("up", "n"), "up")
        jumped = looked_up(now.where("up is not null"), ["up"], told, HEAVY).withColumn("up", F.col("next")).drop("next")
        gained = sent.select("up.*", "l", "s")
        after = jumped.unionByName(now.where("up is null")).join(gained, key, "left")
        after = after.withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}).drop("l", "s")
        after = cut(after, "upper")
        drop_cut(now)
        now = after
    return now.drop("up").withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of the prefixes at which conversations end.

    Ids are brought into order by ranges and joined to runs of at most ENDS there; a hash then takes a run
    a row, for SHA-256 goes through all ids of a prefix one after another.
    """
    key = ["depth", "x1", "x2"]
    kind = "depth bigint, x1 bigint, x2 bigint, low bigint, ids string"
    names = [*key, "low", "ids"]

    def runs(batches):
        last, ids, out = None, [], []
        for batch in batches:
            for at, conv in zip(zip(*(batch.column(c).to_pylist() for c in key)), batch.column("conv_id").to_pylist()):
                if ids and (at != last or len(ids) == ENDS):
                    out.append((*last, ids[0], ",".join(map(str, ids))))
                    ids = []
                last = at
                ids.append(conv)
            yield rows_of(out, names)
            out = []
        if ids:
            yield rows_of([(*last, ids[0], ",".join(map(str, ids)))], names)

    def hashes(batches):
        last, sha = None, None
        for batch in batches:
            out = []
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if at != last:
                    if last is not None:
                        out.append((*last, sha.hexdigest()))
                    last, sha = at, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield rows_of(out, [*key, "ends_sha256"])
        if last is not None:
            yield rows_of([(*last, sha.hexdigest())], [*key, "ends_sha256"])

    def rows_of(out, names):
        columns = list(zip(*out)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], names=names)

    apart = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(runs, kind)
    return apart.repartition(*key).sortWithinPartitions(*key, "low").mapInArrow(hashes, "depth bigint, x1 bigint, x2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, shard: int = SHARD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the turns (conv_id, turn, role, text).

    ``conversations`` (conv_id) lists conversations that may have no turns.  A node is named by its smallest
    member and its depth; ends_sha256 hashes the ids, comma-joined, of the members that end there.
    """
    rows = prefixes(turns)
    key = ["depth", "x1", "x2"]
    nodes = rows.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("words").alias("words"))
    ids = rows.where("depth = 1").select("conv_id")
    empty = None
    if conversations is not None:
        listed = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint")).distinct()
        empty = cut(listed.join(ids, "conv_id", "left_anti"), "empty")
        ids = ids.union(empty)
    zero = F.lit(0).cast("bigint")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*(zero.alias(k) for k in key), "conv_id", "n_convs", *(zero.alias(k) for k in ("p1", "p2", "words")))
    nodes = cut(nodes.unionByName(root), "nodes")
    n_nodes = nodes.count()

    light = cut(shard_of(nodes, rows, shard), "light")
    bins = max(1, -(-n_nodes // shard))
    dealt = nodes.join(light, "conv_id", "left").withColumn("bin", F.when(F.col("depth") >= F.col("light"), F.pmod(F.xxhash64("light", "s1", "s2"), F.lit(bins))))
    dealt = cut(dealt.drop("light", "s1", "s2"), "dealt")
    binned = cut(dealt.where("bin is not null").groupBy("bin").applyInArrow(bin_sums, BINNED), "binned")
    roots = binned.where("parent_conv_id is null")
    upper = merged(dealt.where("bin is null").drop("bin"), roots)

    parent = [(F.col("depth") - 1).alias("up"), "p1", "p2"]
    orphans = roots.drop("parent_conv_id").unionByName(upper).select("*", *parent[:1])
    named = upper.where("n_children > 0").select(F.col("depth").alias("up"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    found = looked_up(cut(orphans.where("depth > 0"), "orphans"), ["up", "p1", "p2"], cut(named, "named"), HEAVY).drop("up")
    top = upper.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    every = binned.where("parent_conv_id is not null").unionByName(found).unionByName(top)

    ends = rows.where("depth = size").select(*key, "conv_id")
    if empty is not None:
        ends = ends.unionByName(empty.select(*(zero.alias(k) for k in key), "conv_id"))
    out = every.join(end_hashes(ends), key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, turn, role, text) with the first turns of each conversation replaced by those of its group's first one, and all conversations (conv_id).

    Conversation c gets the first h turns of c - c % group and its own after its first h; h is crc32(c) % most.
    """
    some = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text", F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("turn"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.asc("row")]
    apart = ranged(cut(some, "turns"), ["conv_id"], order)
    placed = cut(scan(apart, ["conv_id"], order, {"pos": F.lit(1)}).select("conv_id", F.col("pos").alias("turn"), "role", "text"), "turns")
    conversations = placed.select("conv_id").distinct()
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = placed.where(F.col("turn") >= taken)
    based = conversations.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), taken.alias("taken")).where("taken > 0")
    first = placed.where(F.col("turn") < most - 1).withColumnRenamed("conv_id", "base")
    lent = based.join(first, "base").where("turn < taken").select("conv_id", "turn", "role", "text")
    return own.unionByName(lent), conversations
