"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space (space, tab, LF, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes a core under which a table's own splits are too few.
SPLIT_BYTES = 4 << 20


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() cuts at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. A small one, which may be a single split, is dealt out to all cores."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if plan_bytes(df) < cores * SPLIT_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share (``spark.checkpoint.dir``).

    In local mode a temporary folder takes its place if the session names none; on a cluster that is an error, since
    executors would write to their own disks. Results are read from it lazily; ``clear`` removes it after they were used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="civicfeed-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/civicfeed-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove what this application wrote to the shared folder; frames returned before can no longer be read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later jobs neither repeat nor lose it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame; for file scans that is the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """A partition count that follows the input, never under the session's shuffle setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1_000_000, plan_bytes(df) // bytes_each + 1))


#: Rows of keys up to which a side of a join goes to all tasks by broadcast (some tens of MB).
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(keys: DataFrame) -> DataFrame:
    """``keys``, to be broadcast if it has at most BROADCAST_ROWS rows of a few short columns; else joined by shuffle.

    It is counted, so it should be materialised.
    """
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def train_bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def map_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow for a function from one record batch to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_scores(df: DataFrame, text: str, fn: Callable[[list[str | None]], dict[str, list]], schema: dict[str, str]) -> DataFrame:
    """All columns of ``df`` and those that ``fn`` derives from the texts of a batch.

    A result replaces an input column of the same name (whatever the case), as withColumn does.
    Only Arrow batches are held (Spark bounds them in rows and, at 64 MB, in bytes), so memory does not depend on
    the number of rows.
    """
    gone = {c.lower() for c in schema}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone or c == text])
    passed = [c for c in kept.columns if c.lower() not in gone]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in passed]
    types = dict(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            # texts go through in slices: one batch may hold 10,000 long texts
            for at in range(0, n, 256):
                part = batch.slice(at, 256)
                got = fn(part.column(kept_index).to_pylist())
                arrays = [part.column(i) for i in pass_index] + [pa.array(got[c], ARROW[types[c]]) for c in types]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kept_index = kept.columns.index(text)
    pass_index = [kept.columns.index(c) for c in passed]
    names = passed + list(types)
    return kept.mapInArrow(run, ", ".join(fields + [f"`{c}` {t}" for c, t in types.items()]))


#: Arrow types of the result columns.
ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
}


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))
