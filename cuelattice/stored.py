"""Tables that cut a long lineage: written once under the folder that driver and executors share, deleted when the process ends."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_paths: list[tuple[SparkSession, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a new local folder, which only a session of one process may use."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='cuelattice-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back, so that later stages neither repeat its work nor depend on executors that held it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # else shuffle files stay until the driver happens to collect its garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _paths.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as shuffles have, ahead of work that takes long for the bytes it reads: adaptive plans would put it into few."""
    # a hash of the keys, since a repartition by keys that the rows are dealt by already is left out
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def once(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with columns that are worked out one time for each row: what a generator gives is not folded into the expressions that use it."""
    held = F.explode(F.array(F.struct(*[v.alias(name) for name, v in values.items()]))).alias("_once")
    return df.select(*[c for c in df.columns if c not in values], held).select(*[c for c in df.columns if c not in values], *[F.col(f"_once.{name}").alias(name) for name in values])


def forget() -> None:
    """Delete every stored table; results that still read them must be written before."""
    while _paths:
        spark, path = _paths.pop()
        if spark.sparkContext._jsc is None:
            continue
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        forget()


atexit.register(_at_exit)
