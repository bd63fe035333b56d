"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each partition sends to each bucket is drawn from the multivariate hypergeometric law, so that buckets have
exactly their sizes. Rows are permuted within their partition, dealt out by these counts, exchanged, and permuted again
within their bucket. A shard is a run of buckets, each small enough for a task. The matrix is never held: it is drawn down
a binary tree over partitions, and each task draws only the nodes on its own path, from seeds that belong to the nodes.

Defined cases: every row is dealt, repeated, tied, null and empty ones too; shard counts differ by one at most; an empty
table gives an empty result; all columns given are carried, and the added ones replace any of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, durable

#: Rows in a bucket at most (but for one), which one task permutes.
BUCKET_ROWS = 200_000
_NUMPY_TOTAL = 1_000_000_000


def bucket_sizes(rows: int, shards: int, bucket_rows: int = BUCKET_ROWS) -> list[tuple[int, int, int]]:
    """Shard, first slot and size of each bucket."""
    out = []
    for shard in range(shards):
        size = rows // shards + (shard < rows % shards)
        parts = max(1, -(-size // bucket_rows))
        at = 0
        for k in range(parts):
            own = size // parts + (k < size % parts)
            out.append((shard, at, own))
            at += own
    return out


def draw_good(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """How many of ``taken`` rows drawn from ``good + bad`` are good: the hypergeometric law, for totals of any size.

    Beyond numpy's limit of a billion: few rows one by one, many by ratio of uniforms (Stadlober, 1990) on log factorials.
    """
    total = good + bad
    if total < _NUMPY_TOTAL:
        return int(rng.hypergeometric(good, bad, taken))
    few, less = min(good, bad), min(taken, total - taken)
    if less < 10:
        hits, left = 0, few
        for k in range(less):
            if rng.random() * (total - k) < left:
                hits, left = hits + 1, left - 1
    else:
        share = few / total
        centre = less * share + 0.5
        spread = math.sqrt((total - less) * less * share * (1 - share) / (total - 1) + 0.5)
        width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
        log_weight = lambda x: -(math.lgamma(x + 1) + math.lgamma(few - x + 1) + math.lgamma(less - x + 1) + math.lgamma(total - few - less + x + 1))
        top = log_weight((less + 1) * (few + 1) // (total + 2))
        last = min(min(few, less) + 1, math.floor(centre + 16 * spread))
        while True:
            u, v = 1 - rng.random(), rng.random()
            at = centre + width * (v - 0.5) / u
            if 0 <= at < last and 2 * math.log(u) <= log_weight(math.floor(at)) - top:
                hits = math.floor(at)
                break
    of_good = hits if good <= bad else less - hits
    return of_good if less == taken else good - of_good


def draw_counts(rng: np.random.Generator, room: np.ndarray, taken: int) -> np.ndarray:
    """How many of ``taken`` rows go to each bucket that has ``room``."""
    total = int(room.sum())
    if total < _NUMPY_TOTAL:
        return rng.multivariate_hypergeometric(room, taken, method="marginals")
    out = np.zeros_like(room)
    for k, own in enumerate(room.tolist()):
        if not taken:
            break
        total -= own
        out[k] = draw_good(rng, own, total, taken)
        taken -= int(out[k])
    return out


def matrix_row(seed: int, sent: np.ndarray, sizes: np.ndarray, partition: int) -> np.ndarray:
    """Row ``partition`` of the communication matrix: counts for each bucket, given all partitions' row counts."""
    before = np.concatenate(([0], np.cumsum(sent)))
    lo, hi, room = 0, len(sent), sizes.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = draw_counts(rng, room, int(before[mid] - before[lo]))
        lo, hi, room = (lo, mid, left) if partition < mid else (mid, hi, room - left)
    return room


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df``'s columns with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard), a uniform random order.

    ``df`` is written to the shared folder first, so that every later job sees the same partitions.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    names = [c for c in df.columns if c not in ("shard", "slot")]
    fixed = durable(df.select(F.struct(*[F.col(f"`{c}`").alias(f"f{k}") for k, c in enumerate(names)]).alias("row")))
    counts = {r[0]: r[1] for r in fixed.groupBy(F.spark_partition_id()).count().collect()}
    sent = np.array([counts.get(k, 0) for k in range(max(counts, default=-1) + 1)], np.int64)
    buckets = bucket_sizes(int(sent.sum()), shards, bucket_rows)
    shared = spark.sparkContext.broadcast((sent, np.array([b[2] for b in buckets], np.int64)))
    schema = T.StructType([*fixed.schema.fields, T.StructField("_bucket", T.IntegerType()), T.StructField("_draw", T.LongType()), T.StructField("_tie", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        rows, sizes = shared.value
        rng = np.random.default_rng([seed, own, len(rows), 1])
        to, at = None, 0
        for batch in batches:
            if to is None:
                to = np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(seed, rows, sizes, own))
                rng.shuffle(to)
            n = batch.num_rows
            columns = [*batch.columns, pa.array(to[at : at + n], pa.int32()), pa.array(rng.integers(-(2**63), 2**63, n, np.int64)), pa.array(np.arange(at, at + n) + (own << 40))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_bucket", "_draw", "_tie"])
            at += n
        if at != (0 if to is None else len(to)):
            raise RuntimeError(f"partition {own} has {at} rows now and was counted with {rows[own]}")

    dealt = fixed.mapInArrow(deal, schema)
    order = Window.partitionBy("_bucket").orderBy("_draw", "_tie")
    where = F.element_at(F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(a).cast("long").alias("at")) for s, a, _ in buckets]), F.col("_bucket") + 1) if len(buckets) <= 64 else None
    numbered = dealt.withColumn("_place", F.row_number().over(order).cast("long") - 1)
    if where is not None:
        numbered = numbered.withColumn("_where", where)
    else:
        table = spark.createDataFrame([(k, (s, a)) for k, (s, a, _) in enumerate(buckets)], "_bucket int, _where struct<shard:int,at:long>")
        numbered = numbered.join(table, "_bucket")
    return numbered.select(*[F.col(f"row.f{k}").alias(c) for k, c in enumerate(names)], F.col("_where.shard").alias("shard"), (F.col("_where.at") + F.col("_place")).alias("slot"))
