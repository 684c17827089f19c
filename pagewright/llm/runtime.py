"""Shared storage, staged tables and Arrow plumbing for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to a kernel at once, in characters; one longer text is a slice of its own.
SLICE_CHARS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir, or a local one if that is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        found = current.rsplit("/", 1)[0] if current else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagewright-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths that scratch() deletes when it ends.
_made: list[str] = []


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path under the shared folder, grouped by application so that clean_up() can find it."""
    path = f"{shared_dir(spark)}/pagewright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _made.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Delete at the end all tables and files staged within, but those asked to keep."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            delete_path(spark, path)
        del _made[before:]


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Delete the tables behind frames of staged() that nothing needs any more."""
    for df in frames:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/pagewright/" in file:
                delete_path(df.sparkSession, file)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean_up(spark: SparkSession) -> None:
    """Delete every staged table and file set of this application; results not yet written are lost."""
    delete_path(spark, f"{shared_dir(spark)}/pagewright/{spark.sparkContext.applicationId}")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow filesystem and path for a URI of the shared folder; works in executors as well."""
    if "://" not in path:
        path = "file://" + path if path.startswith("/") else path
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def slices(values: list, budget: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts whose lengths sum to about the budget."""
    start, held = 0, 0
    for i, v in enumerate(values):
        held += len(v) if v else 1
        if held >= budget:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(values):
        yield start, len(values)


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a kernel from one batch to batches; empty batches are skipped."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from kernel(batch)
                pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


#: Rows of a few short columns up to which a table may be broadcast: some ten MB.
FEW = 200_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast only if its rows have been counted and are few; else Spark joins by shuffling."""
    return F.broadcast(df) if df.count() <= FEW else df


def numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """The rows of a table of distinct `by` with `rank`: their place, from 1, in the order of `by`.

    Sorted ranges number their rows; the ranges' sizes, a number for each, give every range its base.
    """

    def place(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at + 1, at + n + 1))], [*batch.schema.names, "part", "at"])
            at += n

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    rows = staged(distinct.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(place, f"{schema}, part int, at long"), "ranks")
    base, bases = 0, []
    for part, n in sorted(map(tuple, rows.groupBy("part").count().collect())):  # a row per range
        bases.append((part, base))
        base += n
    bases = distinct.sparkSession.createDataFrame(bases or [(0, 0)], "part int, base long")
    return rows.join(F.broadcast(bases), "part").select(*distinct.columns, (F.col("base") + F.col("at")).alias("rank"))


def grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns, of batches sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        start = 0
        for i, row in enumerate(rows):
            if row != last and last is not None and (held or i > start):
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, start = [], i
            last = row
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
