"""Streaming forms of the incremental operators; each takes a streaming or a batch frame with event time ``ts``."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.library import missing
from ..operators.state import Table
from ..schemas import EVENTS


def events(spark: SparkSession, path: str, per_trigger: int = 8) -> DataFrame:
    """A file-source stream of the events table with ``ts`` as an instant."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def rates(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts and mean value by day; a day is final once the watermark has passed it."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "purchase").alias("ok"), F.avg("value").alias("avg_score")).select(F.col("window.start").alias("day"), "total", "ok", "avg_score")


def sliding(stream: DataFrame, length: str = "60 seconds", step: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("user_id", F.window("ts", length, step)).agg(F.count("*").alias("n"), F.sum("value").alias("v")).select("user_id", F.col("window.start").alias("lo"), "n", "v")


def bursts(stream: DataFrame, pause: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Sessions of each user: a pause ends one."""
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", pause)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("lo"), F.col("session_window.end").alias("hi"), "n")


def loops(stream: DataFrame, least: int) -> DataFrame:
    """Runs of ``least`` equal event types of a user in order of time within a batch of arrivals; state keeps each user's open run."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        found: list[tuple[Any, ...]] = []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        for event_id, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            n = n + 1 if kind == last else 1
            last = kind
            if n == least:
                found.append((key[0], int(event_id), kind))
        state.update((last, n))
        yield pd.DataFrame(found, columns=["user_id", "event_id", "event_type"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, event_type string", "last string, n long", "append", GroupStateTimeout.NoTimeout)


class WantedDiff:
    """A ``foreachBatch`` sink: what was wanted before and no longer is. The first batch is the baseline and resolves nothing."""

    def __init__(self, snapshot: Table, resolved: Table) -> None:
        self.snapshot, self.resolved = snapshot, resolved

    def __call__(self, batch: DataFrame, number: int) -> None:
        now = batch.select(*[f.name for f in self.snapshot.schema]).distinct()
        if self.snapshot.versions():
            gone = missing(self.snapshot.read(), now).withColumn("batch", F.lit(number).cast("long"))
            self.resolved.write(self.resolved.read().where(F.col("batch") != number).unionByName(gone))
        self.snapshot.write(now)


def upsert_into(table: Table, keys: list[str], keep_old: tuple[str, ...] = ()):  # noqa: ANN201
    """A ``foreachBatch`` sink that merges each batch into a table; writing the same batch again changes nothing."""
    return lambda batch, _number: table.upsert(batch, keys, keep_old)


class _Kept(StatefulProcessor):
    """State of one video: time stamp, size and moment of its last look, dropped by a timer when it is older than ``limit`` milliseconds of event time."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "mtime long, size long, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        listed = pd.concat(list(rows)).sort_values(["ts", "mtime", "size"], kind="stable")
        moments = listed["ts"].astype("datetime64[ms]").astype("int64")
        last, out = self.last.get() if self.last.exists() else None, []
        before = last
        for at, mtime, size in zip(moments.tolist(), listed["mtime"].tolist(), listed["size"].tolist(), strict=True):
            if last is not None and last[:2] == (mtime, size) and at - last[2] < self.limit:
                out.append((key[0], at, "reused"))
            else:
                last = (mtime, size, at)
                out.append((key[0], at, "looked"))
        if last != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last[2] + self.limit)
            self.last.update(last)
        yield pd.DataFrame(out, columns=["video_path", "at", "what"])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.last.clear()
        yield pd.DataFrame([(key[0], at, "dropped")], columns=["video_path", "at", "what"])

    def close(self) -> None:
        pass


def relisted(listings: DataFrame, limit_ms: int, late: str = "0 seconds") -> DataFrame:
    """``(video_path, at, what)`` of a stream of listings ``(video_path, ts, mtime, size)``: ``looked`` at afresh, ``reused`` since time stamp and size have not changed within
    ``limit_ms`` of the last look, or ``dropped`` when the watermark passes that age, after which nothing of the video is kept.

    A row that is later than the watermark is left out. Needs the RocksDB state store.
    """
    timed = listings.withWatermark("ts", late)
    return timed.groupBy("video_path").transformWithStateInPandas(_Kept(limit_ms), "video_path string, at long, what string", "Append", "EventTime")


def counted(df: DataFrame, name: str, **metrics: Any) -> tuple[DataFrame, Observation]:
    """``df`` and an observation that has ``metrics`` (aggregates by name) once one pass over it has run: rows and counters from the same scan."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen


def cost_metrics() -> dict[str, Any]:
    """What a check of clips ``(origin, at, until)`` costs: seconds heard afresh and seconds taken from earlier runs, and clips by origin."""
    seconds = (F.col("until") - F.col("at")) / 1000
    spent = lambda origin: F.coalesce(F.sum(F.when(F.col("origin") == origin, seconds)), F.lit(0.0))
    return {"fresh_s": spent("fresh"), "cached_s": spent("cached"), "clips": F.count("*"), "silent": F.count_if(F.col("origin") == "silent")}
