"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; only where that is unset (tests) make our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomline-checkpoint-"))


#: Bytes of an Arrow batch, and the session's setting for them.
BATCH_BYTES, BATCH_SETTING = 4_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have this session hand rows to Python in batches of a few megabytes, so that memory holds with texts of any length."""
    if int(spark.conf.get(BATCH_SETTING).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def cut(frame: DataFrame) -> DataFrame:
    """Compute ``frame`` once, keep it in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(frame.sparkSession)
    small_batches(frame.sparkSession)
    out = frame.checkpoint(eager=True)
    if (made := _made.get()) is not None:
        made.append(out)
    return out


_made: ContextVar[list[DataFrame] | None] = ContextVar("frames made by cut", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """Remove the files of all frames that ``cut`` makes inside; what is made of them must be written inside, too."""
    made: list[DataFrame] = []
    before = _made.set(made)
    try:
        yield
    finally:
        _made.reset(before)
        for frame in made:
            discard(frame)


def discard(frame: DataFrame) -> None:
    """Remove the files of a frame made by ``cut`` that nothing reads any more.

    Its rows must not be needed to recompute anything: whatever was made of it has been cut itself.
    """
    file = frame._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        remove(frame.sparkSession, file.get())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of a table that is sent to all tasks, at most.
SENT = 100_000


def sent(frame: DataFrame, most: int = SENT) -> DataFrame:
    """A frame to be joined with many rows a key: broadcast if it has ``most`` rows or fewer, which is counted."""
    return F.broadcast(frame) if frame.count() <= most else frame


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan with fewer splits than there are cores, dealt out evenly; a larger scan as it is.

    For maps whose work on a row is many times the cost of moving it; rows go in turn, not by a key.
    """
    small_batches(scan.sparkSession)
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(4 * cores)


def per_batch(frame: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``make`` to every Arrow batch; batches are bounded in rows by Spark's Arrow settings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return frame.mapInArrow(run, schema)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id written as text falls in this fold; false where the id is null."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % folds == fold, F.lit(False))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) for every run of equal keys in a sorted partition; one run is held at a time.

    A run of more than ``most`` rows comes in several parts.
    """
    now, held, n = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.zeros(batch.num_rows, bool)
        starts[0] = True
        for k in keys:
            column = batch.column(k)
            starts[1:] |= np.asarray(pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)), True))
        edges = [*np.flatnonzero(starts).tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:]):
            key = tuple(batch.column(k)[start].as_py() for k in keys)
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held, n = [], 0
            now = key
            while start < stop:
                take = stop - start if most is None else min(stop - start, most - n)
                held.append(batch.slice(start, take))
                start, n = start + take, n + take
                if n == most:
                    yield now, pa.Table.from_batches(held)
                    held, n = [], 0
    if held:
        yield now, pa.Table.from_batches(held)
