"""What the operators of this subpackage share: reading, Arrow batches, materialisation."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python worker at once. Long texts make larger batches costly in memory.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that a worker's memory does not follow the row count."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def pick(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Only the named inputs, under the operator's own names: further columns can't clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


_caches: dict[str, Callable[[], None]] = {}


def cache_of(name: str, clear: Callable[[], None]) -> None:
    """Register how a worker empties an operator's cache."""
    _caches[name] = clear


def claim(name: str) -> None:
    """Called where a task starts: a reused worker keeps the cache of this operator only."""
    for other, clear in _caches.items():
        if other != name:
            clear()


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about the limit; a larger item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session. Only where it is unset, and Spark runs in this one
    process, a temporary folder takes its place; elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="cinderloom-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cinderloom-{uuid.uuid4().hex}"


#: Whether an action's shuffle files go when it ends. Else they stay until the driver's JVM collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there and each row is computed once.

    Unlike checkpoint() this does not run the plan twice, and the rows stay columnar. The table
    outlives lost executors. ``drop`` removes it. What was shuffled for it leaves the disks at once.
    """
    path, conf = shared_folder(df.sparkSession), df.sparkSession.conf
    old = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, old)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that is needed no more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/cinderloom-" in f}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups, with the groups' starts and the end, of batches sorted by their first ``keys`` columns."""
    import numpy as np

    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, last: bool):
        columns = [table.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new).tolist()
        if last:
            return table, [*starts, table.num_rows], None
        return table.slice(0, starts[-1]), starts, table.slice(starts[-1])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        # A group that fills several batches is joined once, when another key follows.
        if all(batch.column(i)[-1] == held[0].column(i)[0] for i in range(keys)):
            continue
        done, starts, rest = cut(pa.Table.from_batches(held), False)
        held = rest.to_batches()
        if done.num_rows:
            yield done, starts
    if held:
        yield cut(pa.Table.from_batches(held), True)[:2]
