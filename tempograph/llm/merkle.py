"""A Merkle manifest of a dataset, with a proof for every row.

A row's leaf is the SHA-256 of its fields.  Leaves of one tree value (say, a language)
stand in the order of their ids; every two neighbours become the SHA-256 of their
digests until one is left, the subroot, and the subroots become the root likewise.

Large blocks of BLOCK neighbouring leaves are reduced where they lie; their nodes
are reduced in blocks again as long as more than TOP are left.  The driver builds
the tree over those, at most TOP digests whatever the number of rows, and broadcasts
for each block the path from its node to the root.  The executors then go through
their blocks once more: they add the path inside the block, hash the siblings of
every row, and fold the row's claimed leaf up the whole path to a root.  Places of
leaves come from ranks of sorted ranges, so a tree value of most rows is many tasks.
With more than TOP tree values the subroots are reduced in blocks as well.

A null field is hashed as such and differs from the empty text.  Null ids come first,
equal ids in the order of their leaves; equal rows have equal leaves at places of
their own, hence proofs of their own.  No rows give no rows.  Only the named columns
are read; others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempograph.llm._common import cut, drop_cut
from tempograph.llm._scan import PART, ranged, scan

#: Leaves of a block, a power of two, and the most digests that the driver gets.
BLOCK, TOP = 4096, 16384
ALONE, RIGHT, LEFT = b"0", b"1", b"2"
STEP = 65  # bytes of a step of a path: the side of the sibling and its digest


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def climb(nodes: list[bytes], n: int, block: int) -> list[list[bytes]]:
    """A block's nodes level by level, up to its own node; n is the number of nodes in the whole tree."""
    levels, width = [nodes], 1
    while width < block and n > 1:
        low = levels[-1]
        levels.append([digest(b"".join(low[i : i + 2])) for i in range(0, len(low), 2)])
        n, width = -(-n // 2), 2 * width
    return levels


def path(levels: list[list[bytes]], i: int) -> bytes:
    """The steps from node i of the lowest level to the highest: side and sibling."""
    out = []
    for level in levels[:-1]:
        other = i ^ 1
        out.append((RIGHT if other > i else LEFT) + level[other] if other < len(level) else ALONE + b"-" * 64)
        i >>= 1
    return b"".join(out)


def steps(way: bytes) -> Iterator[tuple[bytes, bytes]]:
    for at in range(0, len(way), STEP):
        yield way[at : at + 1], way[at + 1 : at + STEP]


def fold(node: bytes, way: bytes) -> bytes:
    for side, other in steps(way):
        node = digest(node if side == ALONE else node + other if side == RIGHT else other + node)
    return node


def siblings(way: bytes) -> bytes:
    return b"".join(other for side, other in steps(way) if side != ALONE)


def column(table: pa.Table, name: str) -> list[bytes]:
    return [x and x.encode() for x in table.column(name).to_pylist()]


def placed(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """Nodes with their place in their tree and the number n of its nodes, written."""
    apart = ranged(nodes, ["tree"], order)
    ranks = scan(apart, ["tree"], order, {"pos": F.lit(1)}, {"n": F.lit(1)}).drop(PART)
    out = cut(ranks.withColumns({"pos": F.col("pos").cast("bigint"), "n": F.col("n").cast("bigint")}), "places")
    drop_cut(apart)
    return out


def reduced(nodes: DataFrame, block: int) -> DataFrame:
    """(tree, pos, n, node) of the blocks of a table of places, written."""

    def run(key, table):
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        own = climb(column(table, "node"), n, block)[-1][0]
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int64()), pa.array([-(-n // block)], pa.int64()), pa.array([own.decode()])], names=["tree", "pos", "n", "node"])

    shift = block.bit_length() - 1
    rows = nodes.select("tree", F.shiftright("pos", shift).alias("block"), "pos", "n", "node")
    return cut(rows.groupBy("tree", "block").applyInArrow(run, "tree string, pos bigint, n bigint, node string"), "blocks")


def top_tree(rows: list, joint: bool) -> tuple[dict[tuple[str, int], tuple[str | None, bytes]], str]:
    """For each (tree, pos) of the top nodes its subroot and its path to the root, and the root.  joint: they are subroots of one tree."""
    trees: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["tree"].encode(), r["pos"])):
        trees.setdefault(r["tree"], []).append(r["node"].encode())
    levels = {t: climb(nodes, len(nodes), 1 << 62) for t, nodes in trees.items()}
    upper = climb([x[-1][0] for x in levels.values()], len(levels), 1 << 62)
    out = {}
    for k, (t, own) in enumerate(levels.items()):
        rest = path(upper, k)
        for i in range(len(own[0])):
            out[t, i] = (None if joint else own[-1][0].decode(), path(own, i) + rest)
    return out, upper[-1][0].decode()


def descended(nodes: DataFrame, ways, block: int, schema: T.StructType, make) -> DataFrame:
    """make(table sorted by place, levels, subroot, path of the block) for every block; ways: a broadcast dict or a frame (tree, block, subroot, way)."""

    def run(table, subroot, way):
        table = table.sort_by("pos")
        levels = climb(column(table, "node"), table.column("n")[0].as_py(), block)
        return make(table, levels, subroot, way)

    rows = nodes.withColumn("block", F.shiftright("pos", block.bit_length() - 1))
    if not isinstance(ways, DataFrame):
        return rows.groupBy("tree", "block").applyInArrow(lambda key, table: run(table, *ways.value[key[0].as_py(), key[1].as_py()]), schema)

    def both(left, right):
        return run(left, right.column("subroot")[0].as_py(), right.column("way")[0].as_py())

    return rows.groupBy("tree", "block").cogroup(ways.groupBy("tree", "block")).applyInArrow(both, schema)


WAYS = "tree string, block bigint, subroot string, way binary"


def ways_down(nodes: DataFrame, ways, block: int, joint: bool) -> DataFrame:
    """(tree, block, subroot, way) of the blocks whose nodes a table of places holds; in a joint tree they are the subroots of trees of one block."""

    def make(table, levels, subroot, way):
        n = len(levels[0])
        trees = table.column("id" if joint else "tree")
        places = pa.array([0] * n if joint else table.column("pos").to_pylist(), pa.int64())
        subroots = [x.decode() for x in levels[0]] if joint else [subroot] * n
        return pa.table([trees, places, pa.array(subroots), pa.array([path(levels, i) + way for i in range(n)], pa.binary())], names=["tree", "block", "subroot", "way"])

    return cut(descended(nodes, ways, block, T.StructType.fromDDL(WAYS), make), "ways")


def merkle_manifest(
    df: DataFrame,
    fields: list[str],
    id_col: str = "doc_id",
    tree: str = "lang",
    claims: dict[str, Column] | None = None,
    proofs: bool = False,
    block: int = BLOCK,
    top: int = TOP,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; with ``proofs`` also the siblings, lowest first.

    ``claims`` replaces fields by what is claimed of them: the root is folded from the claimed leaf and the
    manifest's siblings, and ``verified`` tells whether it is the manifest's.
    """
    spark = df.sparkSession
    said = {**{f: F.col(f) for f in fields}, **(claims or {})}
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    own, claimed = leaf_of([F.col(f) for f in fields]), leaf_of([said[f] for f in fields])
    leaves = df.select(key.alias("tree"), F.col(id_col).alias("id"), own.alias("node"), claimed.alias("claim"), F.monotonically_increasing_id().alias("row"))
    leaves = cut(leaves, "leaves")
    low = placed(leaves, [F.asc_nulls_first("id"), F.asc("node"), F.asc("row")]).drop("row")
    drop_cut(leaves)
    tables, kinds, nodes = [low], [False], reduced(low, block)
    joint = False
    while nodes.count() > top:
        if not joint and not nodes.where("n > 1").limit(1).count():
            joint = True
            nodes = placed(nodes.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "node"), [F.asc("id")])
        tables.append(nodes)
        kinds.append(joint and "id" in nodes.columns)
        nodes = reduced(nodes, block)
    ways, root = top_tree(nodes.collect(), joint) if nodes.limit(1).count() else ({}, "")
    ways = spark.sparkContext.broadcast(ways)
    for table, kind in zip(reversed(tables[1:]), reversed(kinds[1:])):
        ways = ways_down(table, ways, block, kind)

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", siblings array<string>" * proofs)])

    def make(table, levels, subroot, way):
        n, rest = len(levels[0]), siblings(way)
        paths = [path(levels, i) for i in range(n)]
        folded = [fold(fold(c, p), way).decode() for c, p in zip(column(table, "claim"), paths)]
        proof = [siblings(p) + rest for p in paths]
        columns = [table.column("id"), table.column("node"), pa.array([subroot] * n), pa.array([root] * n), pa.array([digest(p).decode() for p in proof]), pa.array(folded), pa.array([f == root for f in folded])]
        if proofs:
            columns.append(pa.array([[p[i : i + 64].decode() for i in range(0, len(p), 64)] for p in proof], pa.list_(pa.string())))
        return pa.table(columns, names=schema.names)

    return descended(low, ways, block, schema, make)
