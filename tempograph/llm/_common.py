"""Helpers shared by the operators: Arrow column appending and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handed to a batch function at once; bounds a worker's memory.
SLICE_BYTES = 2 << 20

ARROW = {
    T.LongType(): pa.int64(),
    T.IntegerType(): pa.int32(),
    T.DoubleType(): pa.float64(),
    T.BooleanType(): pa.bool_(),
    T.StringType(): pa.string(),
    T.BinaryType(): pa.binary(),
}


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(ARROW[kind.elementType])
    return ARROW[kind]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about SLICE_BYTES of the column (a single row may be longer)."""
    if not batch.num_rows:
        return
    share = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.column(column).nbytes)))
    for at in range(0, batch.num_rows, share):
        yield batch.slice(at, share)


def append_columns(df: DataFrame, text: str, fields: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """The frame with the columns of the DDL string ``fields`` added; an input column of such a name is replaced.

    ``make()`` runs once in a task and returns a function from a batch to a dict of the new columns.
    The column ``text`` may itself be among the fields; it then keeps its place.
    """
    new = T.StructType.fromDDL(fields)
    names = [f.name for f in new]
    lower = {n.lower() for n in names}
    source = df
    kept = [f for f in df.schema.fields if f.name.lower() not in lower]
    schema = T.StructType([*kept, *new])
    types = [arrow_type(f.dataType) for f in new]

    def run(batches):
        fn = make()
        for whole in batches:
            for batch in slices(whole, text):
                made = fn(batch)
                old = [batch.column(f.name) for f in kept]
                arrays = [x if isinstance(x := made[n], pa.Array) else pa.array(x, t) for n, t in zip(names, types)]
                yield pa.RecordBatch.from_arrays([*old, *arrays], names=[*(f.name for f in kept), *names])

    return source.mapInArrow(run, schema)


def unused(name: str, names: list[str]) -> str:
    """The name, with as many underscores before it as keep it apart from the given ones."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's strings, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def scratch(spark: SparkSession, what: str = "table") -> str:
    """A fresh path in the folder that the cluster shares (``spark.checkpoint.dir``); only a local session may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tempograph-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/tempograph-{what}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clean_scratch)
    _made.append((spark, path))
    return path


#: Scratch paths of this process that are still there.
_made: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean_scratch() -> None:
    """Removes all scratch tables of this process: when their results have been written, and at its end."""
    while _made:
        try:
            delete(*_made.pop())
        except Exception:  # noqa: BLE001 - the session may have ended already
            return


def cut(df: DataFrame, what: str = "table") -> DataFrame:
    """Write the frame into the shared folder and read it back: lineage ends, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tempograph_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a table made by cut() that nothing reads any more."""
    path = getattr(df, "_tempograph_path", None)
    if path:
        delete(df.sparkSession, path)
        _made[:] = [m for m in _made if m[1] != path]


def looked_up(df: DataFrame, keys: list[str], values: DataFrame, most: int) -> DataFrame:
    """Inner join with a table of unique keys and their number of rows n; the ``most`` keys of highest n are broadcast, so no key of many rows is shuffled."""
    head = F.broadcast(values.orderBy(F.desc("n"), *keys).limit(most))
    rest = df.join(F.broadcast(head.select(keys)), keys, "left_anti").join(values, keys)
    return df.join(head, keys).unionByName(rest).drop("n")


def bitmap(df: DataFrame, place: Column, bits: int) -> bytes:
    """A bitmap (bit i is bit i % 8 of byte i // 8) of the places of all rows, below ``bits``, a multiple of 32,768.

    Tasks send bitmaps of 4 KB, so the driver gets ``bits / 8`` bytes at most, whatever the number of rows.
    """
    at = (place + 1).cast("bigint")  # Spark counts its buckets and places from 1 on
    rows = df.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = bytearray(bits // 8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    return bytes(out)


def utf8_crc(column: str):
    """crc32 of an id as decimal text, as the label folds use it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
