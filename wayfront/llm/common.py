"""Helpers shared by the operators: shared folders, lineage cuts, worker state."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship

#: Words of every contract: maximal runs without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A vocabulary file is broadcast to the executors; beyond this size it is refused.
MAX_VOCABULARY_BYTES = 64 << 20

#: Rows in an Arrow batch that holds whole texts.
TEXT_BATCH_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only if it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="wayfront-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: The codec of tables whose disk counts.
SMALL = "zstd"


def cut(df: DataFrame, tasks: int | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there; ``drop`` deletes it.

    ``tasks`` bounds the tasks that write it, for tables known to be small: see ``tasks_for``.
    """
    path = shared_path(df.sparkSession, "cut")
    (df if tasks is None else df.coalesce(tasks)).write.parquet(path, compression=compression)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.cut_path = path
    return found


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """Like ``cut``, in buckets by the column ``by``, so that joins by it move the other side alone."""
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.format("parquet").option("path", path).option("compression", SMALL).bucketBy(partitions(spark), by).sortBy(by).saveAsTable(name)
    found = spark.table(name)
    found.cut_path, found.cut_name = path, name
    return found


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` or ``bucketed`` wrote and that nothing still to be run reads."""
    for table in tables:
        spark = table.sparkSession
        if "cut_name" in vars(table):
            spark.sql(f"DROP TABLE {table.cut_name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(table.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Have Spark delete the files of shuffles that nothing refers to any more, which it does when the driver's memory is cleared."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """Partitions for what Python workers do after a shuffle: rows are few and small there, so their bytes tell nothing."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Ready the Python workers, and bound what one holds at once when rows are whole texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def by_batch(schema: pa.Schema, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """A mapInArrow function that turns each batch into one of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)
        trim()

    return run


def trim() -> None:
    """Give memory that is free back to the system: Python workers stay for tasks of other kinds, and wait while Spark works alone."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


_resident: dict = {}


def resident(make: Callable, *given):
    """``make(*given)``, the one large thing that a Python worker holds from task to task; what an operator before it held is dropped first."""
    key = (make, *given)
    if key not in _resident:
        _resident.clear()
        gc.collect()  # an encoder and its memory refer to each other
        trim()
        _resident[key] = make(*given)
    return _resident[key]


def vocabulary(spark: SparkSession, path: str):
    """Broadcast the bytes of a vocabulary file, after a check of their number."""
    data = Path(path).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes, more than {MAX_VOCABULARY_BYTES}")
    return spark.sparkContext.broadcast(data)


def groups(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[pa.Table]:
    """Runs of rows with equal integers in ``names``, of batches that are sorted by them; the largest run bounds the memory."""
    open_run: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in names])
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(keys[:, a].tolist())
            if open_run and key != last:
                yield pa.Table.from_batches(open_run)
                open_run = []
            last = key
            open_run.append(batch.slice(a, b - a))
    if open_run:
        yield pa.Table.from_batches(open_run)


#: Small rows that one task writes without effort.
TASK_ROWS = 20_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for a table of small rows, as many as it needs and no more than Spark's number of partitions."""
    return min(partitions(spark), rows // TASK_ROWS + 1)


class Memo:
    """What ``make`` gives for the keys seen lately.

    ``get(keys)`` returns a dict that has every key.  Two generations of at most
    ``limit`` keys each (beyond what one call brings) bound the memory: a key of
    the older one moves to the newer one when it is asked for again.
    """

    def __init__(self, make: Callable[[list], Iterable], limit: int) -> None:
        self.make, self.limit = make, limit
        self.new: dict = {}
        self.old: dict = {}

    def get(self, keys: set) -> dict:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = []
        for k in keys.difference(new):
            if k in old:
                new[k] = old[k]
            else:
                missing.append(k)
        if missing:
            new.update(zip(missing, self.make(missing), strict=True))
        return new


class Recent(dict):
    """What ``make`` gives for the keys asked for lately, made one at a time; two generations of at most ``limit`` keys bound the memory."""

    def __init__(self, make: Callable, limit: int) -> None:
        super().__init__()
        self.make, self.limit = make, limit
        self.old: dict = {}

    def __missing__(self, key):
        found = self.old[key] if key in self.old else self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found
