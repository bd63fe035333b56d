"""Helpers shared by the training-data operators: durable tables, session limits and Arrow plumbing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper limit of one Arrow batch handed to Python, so that long texts do not pile up in a worker.
BATCH_BYTES = 4 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new local one where it is unset and Spark runs in one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='cuelattice-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path under the shared folder that is not there yet; what is written there goes with :func:`release`."""
    path = f"{shared_folder(spark)}/cuelattice-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(since: int = 0, keep: Sequence[str] = ()) -> None:
    """Delete the tables that :func:`durable` wrote after the first ``since``; results that still read them must be stored before."""
    kept = [entry for entry in _written[since:] if entry[1] in keep]
    while len(_written) > since:
        spark, path = _written.pop()
        jvm = spark.sparkContext._jvm
        if path in keep or jvm is None or spark.sparkContext._jsc is None:
            continue
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    _written.extend(kept)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Yields a ``durable`` whose tables stay; all others written inside the block are deleted at its end."""
    since, kept = len(_written), []

    def keep(df: DataFrame) -> DataFrame:
        out = durable(df)
        kept.append(_written[-1][1])
        return out

    try:
        yield keep
    finally:
        release(since, kept)


def _release_at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        release()


atexit.register(_release_at_exit)


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, unless the session sets a lower limit itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def utf8(column: Column | str) -> Column:
    """A text column as its UTF-8 bytes."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def join_classes(rows: DataFrame, labels: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Rows joined to their class's one row in ``labels(key, size, ...)``, where ``size`` counts the class's rows of ``total``.

    Classes of more than a 10,000th of all rows, of which there are at most 10,000, are broadcast, so no large class meets in one task.
    """
    often = F.col(size) > max(1000, total // 10_000)
    hot = F.broadcast(labels.where(often).drop(size))
    rest = rows.join(F.broadcast(labels.where(often).select(key)), key, "left_anti").join(labels.where(~often).drop(size), key)
    return rows.join(hot, key).unionByName(rest)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def to_batch(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def flushed(schema: pa.Schema, rows: Iterable[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``size``."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield to_batch(schema, list(zip(*part, strict=True)))
            part = []
    if part:
        yield to_batch(schema, list(zip(*part, strict=True)))


def sorted_groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Groups of a stream that is sorted by its first ``n_keys`` columns: the key and the other columns as lists."""
    key, held = None, None
    for row in rows_of(batches):
        if row[:n_keys] != key:
            if held is not None:
                yield key, held
            key, held = row[:n_keys], [[] for _ in row[n_keys:]]
        for column, value in zip(held, row[n_keys:], strict=True):
            column.append(value)
    if held is not None:
        yield key, held
