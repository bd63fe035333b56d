"""State kept as plain tables: read, join, overwrite. No row is changed in place; each change is a new version of its table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys (null keys are equal); columns in ``keep_old`` keep the old value where the new is null."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*[F.col(k).alias(f"_ok_{k}") for k in keys], *[F.col(c).alias(f"_o_{c}") for c in rest], F.lit(True).alias("_in_old"))
    n = new.select(*[F.col(k).alias(f"_nk_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in rest], F.lit(True).alias("_in_new"))
    on = [F.col(f"_ok_{k}").eqNullSafe(F.col(f"_nk_{k}")) for k in keys]
    joined = o.join(n, on, "full")
    value = lambda c: F.when(F.col("_in_new"), F.coalesce(f"_n_{c}", f"_o_{c}") if c in keep_old else F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))
    key = lambda k: F.when(F.col("_in_new"), F.col(f"_nk_{k}")).otherwise(F.col(f"_ok_{k}"))
    return joined.select(*[key(k).alias(k) for k in keys], *[value(c).alias(c) for c in rest]).select(*old.columns)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def update(old: DataFrame, where: Column, **values: Column) -> DataFrame:
    return old.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def keep_newest_ids(rows: DataFrame, key: str, keep: int) -> DataFrame:
    """A ring buffer: ids within ``keep`` of the greatest."""
    top = rows.agg(F.max(key)).first()[0]
    return rows if top is None else rows.where(F.col(key) > top - keep)


def keep_recent(rows: DataFrame, when: str, now: Column, days: int) -> DataFrame:
    return rows.where(F.col(when) >= now - F.make_dt_interval(F.lit(days)))


def unchanged(current: DataFrame, state: DataFrame, keys: list[str], versions: list[str], checks: str | None = None) -> DataFrame:
    """Rows whose versions all equal the recorded ones (null-safe), and whose checks all ran then: what a sweep may skip."""
    s = state.select(*keys, *[F.col(v).alias(f"_s_{v}") for v in versions], *([F.col(checks).alias("_done")] if checks else []))
    same = F.lit(True)
    for v in versions:
        same &= F.col(v).eqNullSafe(F.col(f"_s_{v}"))
    if checks:
        same &= F.size(F.array_except(checks, "_done")) == 0
    return current.join(s, keys).where(same).select(*current.columns)


def to_process(current: DataFrame, state: DataFrame, keys: list[str], versions: list[str], checks: str | None = None) -> DataFrame:
    return current.join(unchanged(current, state, keys, versions, checks).select(*keys), keys, "left_anti")


def replace_scope(old: DataFrame, new: DataFrame, path: str, roots: list[str], carry: tuple[str, ...], key: str) -> DataFrame:
    """Rows under the roots are replaced by ``new``; ids in ``carry`` that the new rows lack are taken from the old."""
    under = F.lit(False)
    for r in roots:
        under |= F.col(path).startswith(r.rstrip("/") + "/")
    before = old.select(F.col(key), *[F.col(c).alias(f"_o_{c}") for c in carry])
    filled = new.join(before, key, "left").withColumns({c: F.coalesce(c, f"_o_{c}") for c in carry}).select(*old.columns)
    return old.where(~under).unionByName(filled)


def cached(rows: DataFrame, group: str, slot: str, current: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Cache rows of files whose recorded time and size still hold for every row; a keyed row shadows an unkeyed one of its slot."""
    from pyspark.sql import Window

    now = current.select(group, F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    stale = F.coalesce((F.abs(F.col("mtime") - F.col("_m")) > tolerance) | (F.col("size") != F.col("_s")), F.lit(False))
    checked = rows.join(now, group).withColumn("_stale", F.max(stale).over(Window.partitionBy(group))).where(~F.col("_stale"))
    order = Window.partitionBy(group, slot).orderBy(F.col("model").isNull(), "model")
    return checked.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*rows.columns)


class Table:
    """A table in a folder of versions; a new version is written whole and then named in one rename, so readers see old or new."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_of(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        root = self.path_of(self.folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(root) if s.getPath().getName().startswith("v")) if self.fs.exists(root) else []

    def read(self) -> DataFrame:
        known = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{known[-1]}") if known else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, keep: int = 2) -> None:
        known = self.versions()
        number = int(known[-1][1:]) + 1 if known else 0
        draft = f"{self.folder}/_{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.parquet(draft)
        target = self.path_of(f"{self.folder}/v{number:08d}")
        # a rename onto a folder that is there would move into it
        if self.fs.exists(target) or not self.fs.rename(self.path_of(draft), target):
            raise OSError(f"version {number} of {self.folder} could not be named")
        for old in known[: max(0, len(known) + 1 - keep)]:
            self.fs.delete(self.path_of(f"{self.folder}/{old}"), True)

    def upsert(self, rows: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> None:
        self.write(upsert(self.read(), rows, keys, keep_old))


def create_run(runs: DataFrame, row: DataFrame) -> DataFrame:
    """Append a running job, unless one is running already."""
    if runs.where("status = 'running'").limit(1).count():
        raise RuntimeError("a run is in progress")
    return runs.unionByName(row)


def fail_orphans(runs: DataFrame, message: str) -> DataFrame:
    """Jobs that were running when the process ended have failed."""
    return update(runs, F.col("status") == "running", status=F.lit("failed"), error_message=F.lit(message))


def run_counts(files: DataFrame) -> DataFrame:
    """Counters of each run from the shape of its rows' statuses."""
    status = F.coalesce("sync_status", F.lit(""))
    return files.groupBy("run_id").agg(F.count("*").alias("files_done"), F.count_if(status.startswith("fixed")).alias("files_fixed"), F.count_if(F.coalesce(F.col("correctness_flag") == "SUSPECT", F.lit(False))).alias("files_suspect"), F.count_if(status.contains("error")).alias("files_error"))


def generation_plan(missing: DataFrame, attempts: DataFrame, now: Column, budget: int, cooldown_hours: int) -> DataFrame:
    """Missing ``(video_path, lang)`` to generate now: none that failed within the cooldown, in path order, by video, up to the budget."""
    from pyspark.sql import Window

    failed = attempts.where(~F.col("ok") & (F.col("at") >= now - F.make_dt_interval(hours=F.lit(cooldown_hours)))).select("video_path", "lang")
    left = missing.join(failed, ["video_path", "lang"], "left_anti")
    videos = left.select("video_path").distinct().orderBy("video_path").limit(budget)
    return left.join(videos, "video_path", "left_semi").withColumn("turn", F.row_number().over(Window.partitionBy("video_path").orderBy("lang")))


def write_report(rows: DataFrame, folder: str) -> DataFrame:
    """One JSON object a line for each row, and the counts of suspect, changed and failed rows."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(folder)
    status = F.coalesce("sync_status", F.lit(""))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("correctness_flag") == "SUSPECT", F.lit(False))).alias("suspect"), F.count_if(status.startswith("fixed")).alias("changed"), F.count_if(status.contains("error")).alias("errors"))
