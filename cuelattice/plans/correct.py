"""Queries for corrections and their verdicts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import correct
from .analogues import POINTS, points, table

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(f"""WITH {POINTS}, e AS (SELECT f, min(a) AS lo, max(a) AS hi, count(*) AS n FROM pts GROUP BY 1),
q AS (SELECT pts.f, least(3, floor((a - lo)::DOUBLE / (hi - lo) * 4)) AS part, count(*) AS k, abs(median(c - pts.f % 7 * 100)) AS m FROM pts JOIN e ON e.f = pts.f WHERE n >= 4 AND hi > lo GROUP BY 1, 2)
SELECT e.f AS file_id, coalesce(max(m) FILTER (WHERE k >= 5), 0)::DOUBLE AS left FROM e LEFT JOIN q ON q.f = e.f GROUP BY 1""".replace("AS left", 'AS "left"'))
def quarter_left(spark: SparkSession, d: str) -> DataFrame:
    """What an offset leaves in each quarter of a file."""
    p = points(spark, d)
    return correct.quarter_left(p, p.select("file_id", F.lit(1.0).alias("ratio"), (F.col("file_id") % 7 * 100).cast("double").alias("offset")).distinct())


# A user's day as a file, so that files have few anchors.
_DAYS = f"WITH {POINTS}, y AS (SELECT f * 100000 + a // 1440 AS f, idx, (c % 1300 - 200) / 100.0::DOUBLE AS shift, (idx % 10) / 10.0::DOUBLE AS score FROM pts)"


@query(f"""{_DAYS}, j AS (SELECT *, f % 2 = 0 AS whole, CASE f % 3 WHEN 1 THEN 'new' WHEN 2 THEN 'blocks' END AS winner, CASE WHEN f % 4 < 2 THEN 20 ELSE 5 END AS spread FROM y),
m AS (SELECT *, count(*) FILTER (WHERE abs(shift) > 2.5) OVER (PARTITION BY f) >= CASE WHEN whole AND coalesce(winner = 'new', true) THEN 3 ELSE 2 END AS many FROM j)
SELECT f AS file_id, idx, shift, score FROM m WHERE CASE WHEN many THEN abs(shift) > 2.5 ELSE spread >= 20 AND coalesce(winner = 'blocks', true) AND abs(shift) >= 10 AND score >= 0.25 END""")
def condemning_anchors(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("file_id") * 100_000 + F.floor(F.col("a") / 1440)
    samples = points(spark, d).select(day.alias("file_id"), "idx", ((F.col("c") % 1300 - 200) / 100.0).alias("shift"), ((F.col("idx") % 10) / 10.0).alias("score"))
    f = F.col("file_id")
    files = samples.select("file_id").distinct().select("file_id", (f % 2 == 0).alias("full"), F.when(f % 3 == 1, "new").when(f % 3 == 2, "blocks").alias("winner"), F.when(f % 4 < 2, 20.0).otherwise(5.0).alias("spread"))
    return correct.condemning(samples, files)


@query(f"""WITH {POINTS}, k AS (SELECT f * 10000 + a // 10080 AS f, (a % 10080)::DOUBLE AS a, c / 100.0::DOUBLE AS c FROM pts), s AS (SELECT f, max(a) - min(a) AS span FROM k GROUP BY 1 HAVING count(*) >= 3 AND max(a) - min(a) >= 6048),
l AS (SELECT p.f, median((q.c - p.c) / (q.a - p.a)) AS slope FROM k p JOIN k q ON p.f = q.f AND p.a < q.a GROUP BY 1) SELECT s.f AS file_id, round(slope * 10080, 6) AS walk FROM s JOIN l ON l.f = s.f""")
def clip_walks(spark: SparkSession, d: str) -> DataFrame:
    """How far a user's values walk over a week, where they span most of it."""
    week = F.col("file_id") * 10_000 + F.floor(F.col("a") / 10_080)
    clips = points(spark, d).select(week.alias("file_id"), (F.col("a") % 10_080).cast("double").alias("start"), (F.col("c") / 100.0).alias("shift"))
    return correct.clip_tilt(clips, clips.select("file_id", F.lit(10_080.0).alias("duration")).distinct()).withColumn("walk", F.round("walk", 6))


@query(f"""WITH {POINTS}, b AS (SELECT f, a, (c % 400) / 100.0::DOUBLE AS c FROM pts), x AS (SELECT f, min(a) AS lo, max(a) AS hi FROM b GROUP BY 1), s AS (SELECT f, avg(CASE WHEN abs(c) > 2.5 THEN 1.0 ELSE 0 END) AS o FROM b GROUP BY 1 HAVING count(*) >= 40),
n AS (SELECT b.f, avg(CASE WHEN abs(c + CASE WHEN b.f % 2 = 0 THEN 0.8 ELSE 0.1 END) > 2.5 THEN 1.0 ELSE 0 END) AS o FROM b JOIN x ON x.f = b.f WHERE a BETWEEN lo AND hi GROUP BY 1 HAVING count(*) >= 40)
SELECT x.f AS file_id, round(s.o, 9) AS off_before, round(n.o, 9) AS off_after, CASE WHEN x.f % 3 = 0 THEN NULL WHEN x.f % 10 = 0 THEN 'wrong_file' WHEN n.o > s.o + 0.15 THEN 'worse' END AS why FROM x LEFT JOIN s ON s.f = x.f LEFT JOIN n ON n.f = x.f""")
def rewrites_undone(spark: SparkSession, d: str) -> DataFrame:
    before = points(spark, d).select("file_id", "a", ((F.col("c") % 400) / 100.0).alias("c"))
    f = F.col("file_id")
    after = before.withColumn("c", F.col("c") + F.when(f % 2 == 0, 0.8).otherwise(0.1))
    files = before.select("file_id").distinct().select("file_id", F.when(f % 3 == 0, "already in sync").otherwise("fixed").alias("status"), F.when(f % 5 == 0, 1.001).alias("rate"), F.when(f % 10 == 0, "wrong_subtitle").alias("reason"))
    out = correct.undone(before, after, files)
    return out.select("file_id", F.round("off_before", 9).alias("off_before"), F.round("off_after", 9).alias("off_after"), "why")


@query("""WITH e AS (SELECT event_id AS i, [NULL, 'SUSPECT', 'unknown', 'ok'][event_id % 4 + 1] AS flag, event_id % 3 = 0 AS fixed, CASE WHEN event_id % 6 > 0 THEN event_id % 50 / 2 END AS shift, CASE WHEN event_id % 7 > 0 THEN CAST(event_id % 100 AS VARCHAR) END AS score, ['-', 'quarantined', 'none (action=off)', ''][event_id % 5 + 1] AS act FROM events)
SELECT i AS event_id, CASE WHEN flag IN ('SUSPECT', 'unknown') THEN 'suspect' WHEN fixed THEN 'sync' ELSE 'ok' END AS outcome, CASE WHEN flag = 'SUSPECT' THEN 'SUSPECT — needs redownload' || CASE WHEN act = 'quarantined' THEN ' (quarantined)' ELSE '' END WHEN flag = 'unknown' THEN 'Not verified — no usable Whisper sample'
WHEN fixed THEN CASE WHEN shift IS NULL THEN 'Synced' ELSE printf('Synced (Δ%.1fs)', shift) END || coalesce(', score ' || score, '') ELSE 'OK' || coalesce(' (score ' || score || ')', '') END AS text FROM e""")
def outcome_texts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    action = pick(("-", "quarantined -> /q; more", labels.NO_ACTION, ""), i % 5)
    shift, score = F.when(i % 6 > 0, i % 50 / 2), F.when(i % 7 > 0, (i % 100).cast("string"))
    told = labels.outcome(pick((None, "SUSPECT", "unknown", "ok"), i % 4), F.when(i % 3 == 0, "fixed (x)").otherwise("already in sync"), shift, score, action)
    return table(spark, d, "events").select("event_id", told.alias("o")).select("event_id", "o.outcome", "o.text")
