"""Evidence and decision queries: sampling, order of lines, cached pieces, screens, candidates, escalation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, transcript
from ..operators import state, verdict
from .analogues import CUES, POINTS, cues, points, table
from .words import _CONV, _conversation

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


HOUR = 3_600_000


@query("""SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN 4 ELSE greatest(3, ceil(value * 60 / 600 * 2)) END AS INTEGER) AS n, CAST(100000 + round_even(value, 0) AS INTEGER) AS slot, 'u' || user_id || '|' || CAST(CAST(round(value * 100) AS BIGINT) * 10 AS VARCHAR) || '|30000||m' AS key,
CASE WHEN event_id % 3 = 0 THEN 'full' ELSE CASE WHEN event_id % 2 = 0 THEN 'full' ELSE 'sampled' END END AS mode FROM events""")
def sampling_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    fixed = F.when(F.col("event_id") % 5 == 0, F.lit(4))
    model = F.when(F.col("event_id") % 2 == 0, F.lit("tiny.en")).otherwise("medium.en")
    mode = F.when(F.col("event_id") % 3 == 0, F.lit("full")).otherwise("auto")
    key = transcript.probe_key(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("value"), F.lit(30.0), F.lit(None).cast("string"), F.lit("m"))
    return rows.select("event_id", transcript.sample_count(F.col("value") * 60, F.lit(2), fixed).alias("n"), transcript.extra_slot(F.col("value")).alias("slot"), key.alias("key"), transcript.full_or_sampled(mode, model).alias("mode"))


@query(f"""WITH {CUES}, p AS (SELECT f, s // {24 * HOUR} AS day, min(s) AS t0, max(s) AS t1 FROM cues WHERE t = 'view' GROUP BY 1, 2), m AS (SELECT c.f, c.idx, c.s, c.e, t0, t1, greatest(t0 - (c.s + c.e) / 2, (c.s + c.e) / 2 - t1, 0) AS away FROM cues c JOIN p ON p.f = c.f WHERE c.t = 'click')
SELECT f AS file_id, idx, least(greatest(s, t0), t1) - t0 + t0 // 2 AS start, least(greatest(e, t0), t1) - t0 + t0 // 2 AS "end" FROM m QUALIFY row_number() OVER (PARTITION BY f, idx ORDER BY away, t0) = 1""")
def remapped_segments(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d)
    day = F.floor(F.col("start") / (24 * HOUR))
    pieces = c.where("text = 'view'").groupBy("file_id", day.alias("day")).agg(F.min("start").alias("t0"), F.max("start").alias("t1")).withColumn("at", F.floor(F.col("t0") / 2))
    return transcript.remapped(c.where("text = 'click'"), pieces)


@query(f"""WITH {_CONV}, p AS (SELECT f, idx, w AS one, lead(w) OVER z AS two, lead(w, 2) OVER z AS early, lead(w, 3) OVER z AS late FROM cv WINDOW z AS (PARTITION BY f ORDER BY idx)), q AS (SELECT f, idx, list_intersect(early, late) || list_intersect(one, two) AS no, early, late, one, two FROM p WHERE late IS NOT NULL),
c AS (SELECT f, idx, list_filter(one, lambda x: NOT list_contains(no, x)) AS one, list_filter(two, lambda x: NOT list_contains(no, x)) AS two, early, late FROM q), s AS (SELECT f, idx, len(one) AS a, len(two) AS b, len(list_intersect(one, early)) / nullif(len(one), 0) + len(list_intersect(two, late)) / nullif(len(two), 0) AS kept, len(list_intersect(one, late)) / nullif(len(one), 0) + len(list_intersect(two, early)) / nullif(len(two), 0) AS swapped FROM c)
SELECT f AS file_id, idx, CASE WHEN a = 0 OR b = 0 THEN NULL WHEN swapped - kept >= 0.02 THEN 'true' WHEN kept - swapped >= 0.02 THEN 'false' END AS swapped FROM s""")
def line_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("idx")
    rows = _conversation(spark, d).select("file_id", "idx", F.col("toks").alias("one"), *[F.lead("toks", k).over(w).alias(n) for k, n in ((1, "two"), (2, "early"), (3, "late"))]).where("late is not null")
    return rows.select("file_id", "idx", transcript.order_by_words(F.col("early"), F.col("late"), F.col("one"), F.col("two"), 0.02).cast("string").alias("swapped"))


@query(f"""WITH {CUES}, m AS (SELECT f, s, e, max(e) OVER (PARTITION BY f ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM cues WHERE t = 'error'), i AS (SELECT f, s, e, sum(CASE WHEN b IS NULL OR s - b > {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY f ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT f AS file_id, min(s) - 8000 AS start, max(e) + 45000 AS "end" FROM i GROUP BY f, k""")
def music_clusters(spark: SparkSession, d: str) -> DataFrame:
    return transcript.music_clusters(cues(spark, d).where("text = 'error'"), 6 * HOUR, 8_000, 45_000)


@query(f"""WITH {CUES}, w AS (SELECT DISTINCT f, s // {48 * HOUR} * {48 * HOUR} AS base FROM cues), n AS (SELECT f, base, k, ([0, 6, -6, 12, -12])[k + 1] * {HOUR} AS nudge FROM w, (SELECT unnest(range(0, 5)) AS k)),
x AS (SELECT n.f, base, k, nudge, coalesce(sum(CASE WHEN c.s IS NOT NULL THEN least(c.e, base + nudge + {6 * HOUR}) - greatest(c.s, base + nudge) END), 0) AS sp FROM n LEFT JOIN (SELECT * FROM cues WHERE t = 'view') c ON c.f = n.f AND c.e > base + nudge AND c.s < base + nudge + {6 * HOUR} GROUP BY 1, 2, 3, 4)
SELECT f AS file_id, base, CAST(nudge AS INTEGER) AS nudge, CAST(sp AS BIGINT) AS speech FROM x QUALIFY row_number() OVER (PARTITION BY f, base ORDER BY sp DESC, k) = 1""")
def sample_nudges(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d)
    base = (F.floor(F.col("start") / (48 * HOUR)) * 48 * HOUR).cast("long").alias("base")
    return transcript.best_nudge(c.select("file_id", base).distinct(), c.where("text = 'view'"), tuple(k * HOUR for k in (0, 6, -6, 12, -12)), 6 * HOUR)


@query(f"""WITH {POINTS}, k AS (SELECT f, a // 1440 AS clip, median(c) AS shift FROM pts GROUP BY 1, 2), m AS (SELECT f, median(shift) AS med, count(*) AS n FROM k GROUP BY 1), x AS (SELECT k.f, median(abs(shift - med)) AS mad FROM k JOIN m ON m.f = k.f GROUP BY 1)
SELECT m.f AS file_id, CASE WHEN n < 3 THEN 'unknown' WHEN abs(med) >= 900 OR mad >= 900 THEN 'needs_sync' ELSE 'ok' END AS state FROM m JOIN x ON x.f = m.f""")
def screen(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    from ..params import DEFAULTS

    clips = points(spark, d).groupBy("file_id", F.floor(F.col("a") / 1440).alias("clip")).agg(F.median("c").alias("shift"))
    none = clips.select("file_id", F.lit(None).cast("double").alias("tilt")).limit(0)
    return verdict.screen(clips, none, replace(DEFAULTS, flat=900.0)).select("file_id", "state")


@query("""WITH p AS (SELECT l_partkey % 500 AS f, CASE WHEN l_linenumber % 2 = 0 THEN 'new' ELSE 'old' END AS cand, l_suppkey % 4 AS region, avg(l_discount) * 50 AS resid, avg(l_tax) AS score FROM lineitem GROUP BY 1, 2, 3), c AS (SELECT p.*, count(*) OVER (PARTITION BY f, region) AS k FROM p), a AS (SELECT f, count(DISTINCT cand) AS n FROM p GROUP BY 1),
s AS (SELECT c.f, avg(resid) FILTER (cand = 'old') AS ro, avg(resid) FILTER (cand = 'new') AS rn, avg(score) FILTER (cand = 'old') AS so, avg(score) FILTER (cand = 'new') AS sn FROM c JOIN a ON a.f = c.f WHERE k = n GROUP BY 1)
SELECT f AS file_id, round(ro, 6) AS r_old, round(rn, 6) AS r_new, CASE WHEN rn + 1 <= ro THEN 'new' WHEN ro + 1 <= rn THEN 'old' WHEN sn >= so + 0.1 THEN 'new' ELSE 'old' END AS winner FROM s""")
def choose_candidate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 500).alias("file_id"), F.when(F.col("l_linenumber") % 2 == 0, "new").otherwise("old").alias("candidate"), (F.col("l_suppkey") % 4).alias("region")).agg((F.avg("l_discount") * 50).alias("resid"), F.avg("l_tax").alias("score"))
    return verdict.choose_candidate(rows).select("file_id", F.round("r_old", 6).alias("r_old"), F.round("r_new", 6).alias("r_new"), "winner")


_HITS = {"parse_error": 37, "unavailable": 31, "skipped": 29, "swaps": 23, "wrong": 19, "split_failing": 17, "anchors_bad": 13, "resynced": 2, "runs": 11, "jitter": 7, "gap": 5, "overrun": 3}


@query("""SELECT doc_id, flag, reason FROM (SELECT doc_id, CASE WHEN doc_id % 37 = 0 THEN 1 WHEN doc_id % 31 = 0 THEN 2 WHEN doc_id % 29 = 0 THEN 3 WHEN doc_id % 23 = 0 THEN 4 WHEN doc_id % 19 = 0 THEN 5 WHEN doc_id % 17 = 0 THEN 6 WHEN doc_id % 13 = 0 AND doc_id % 2 <> 0 THEN CASE WHEN doc_id % 7 = 0 THEN 8 ELSE 6 END
  WHEN doc_id % 41 = 0 THEN 7 WHEN doc_id % 11 = 0 THEN 6 WHEN doc_id % 7 = 0 THEN 8 WHEN doc_id % 5 = 0 THEN 9 WHEN doc_id % 3 = 0 THEN 10 ELSE 11 END AS k FROM documents)
JOIN (VALUES (1, 'unknown', 'check_failed'), (2, 'no local Whisper binary', NULL), (3, 'skipped', NULL), (4, 'SUSPECT', 'lines_out_of_order'), (5, 'SUSPECT', 'wrong_subtitle'), (6, 'SUSPECT', 'partly_out_of_sync'), (7, 'unknown', 'no_speech_heard'), (8, 'SUSPECT', 'unreliable_timing'), (9, 'SUSPECT', 'missing_lines'), (10, 'SUSPECT', 'past_audio_end'), (11, 'ok', NULL)) t(k, flag, reason) USING (k)""")
def final_verdicts(spark: SparkSession, d: str) -> DataFrame:
    hits = {k: F.col("doc_id") % n == 0 for k, n in _HITS.items()} | {"content_ok": F.col("doc_id") % 41 != 0}
    return table(spark, d, "documents").select("doc_id", verdict.final_verdict(hits).alias("v")).select("doc_id", "v.flag", "v.reason")


@query("""WITH r AS (SELECT user_id AS video, event_id % 6 AS slot, event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'm' || event_id % 2 END AS model, CASE WHEN value > 250 THEN 5 ELSE 0 END AS mtime FROM events), s AS (SELECT video FROM r GROUP BY 1 HAVING max(mtime) <= 1)
SELECT video, slot, model FROM r WHERE video IN (SELECT video FROM s) QUALIFY row_number() OVER (PARTITION BY video, slot ORDER BY model IS NULL, model) = 1""")
def cached_pieces(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("video"), (F.col("event_id") % 6).alias("slot"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string"))).alias("model"), F.when(F.col("value") > 250, 5.0).otherwise(0.0).alias("mtime"), F.lit(1).alias("size"))
    now = rows.select("video").distinct().select("video", F.lit(0.0).alias("mtime"), F.lit(1).alias("size"))
    return state.cached(rows, "video", "slot", now).select("video", "slot", "model")


@query("""SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'clips_disagree' WHEN doc_id % 11 = 0 THEN 'drift' WHEN n_chars % 100 >= 40 THEN 'jitter' WHEN n_chars % 10 >= 6 THEN 'swaps' WHEN doc_id % 5 = 0 THEN 'block' WHEN doc_id % 3 = 0 THEN 'overrun' END AS rung FROM documents""")
def escalation(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rung = verdict.needs_full((F.col("n_chars") % 100) / 100, i % 11 == 0, F.col("n_chars") % 10, i % 5 == 0, i % 3 == 0, i % 13 == 0)
    return table(spark, d, "documents").select("doc_id", rung.alias("rung"))


@query("""SELECT conv_id AS file_id, turn AS idx, NOT (coalesce(turn % 3 = 0 AND length(text) % 2 = 0, false) OR coalesce(length(text) > 900, false)) AS kept FROM conversations""")
def confident_segments(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    no_speech = F.when(F.col("turn") % 3 == 0, 0.9)
    logprob = F.when(n % 2 == 0, -1.5).otherwise(-0.5)
    compression = F.when(n > 900, 3.0)
    return table(spark, d, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("idx"), (~text.low_confidence(no_speech, logprob, compression)).alias("kept"))


@query("""SELECT conv_id, 'one/two three' AS lines FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 2 = 0""")
def numbered_replies(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    reply = F.when(F.col("conv_id") % 2 == 0, F.lit("1. one\n2) two\n three")).otherwise("1. one\n1. two")
    return ids.select("conv_id", F.array_join(transcript.numbered_reply(reply, F.lit(2)), "/").alias("lines")).where("lines is not null")


@query("""WITH c AS (SELECT l_orderkey % 300 AS video_path, l_partkey AS subs_id, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2), t AS (SELECT DISTINCT l_orderkey % 300 AS video_path, l_partkey AS subs_id FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 40 = 3), u AS (SELECT video_path, count(*) AS used FROM t GROUP BY 1),
r AS (SELECT c.*, row_number() OVER (PARTITION BY c.video_path ORDER BY score DESC, subs_id) + coalesce(used, 0) AS turn FROM c LEFT JOIN u ON u.video_path = c.video_path WHERE score >= 45 AND NOT EXISTS (SELECT 1 FROM t WHERE t.video_path = c.video_path AND t.subs_id = c.subs_id)) SELECT video_path, subs_id, score, CAST(turn AS BIGINT) AS turn FROM r WHERE turn <= 5""")
def replacement_candidates(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.archive import due

    rows = table(spark, d, "lineitem").withColumn("video_path", F.col("l_orderkey") % 300).withColumnRenamed("l_partkey", "subs_id")
    found = rows.groupBy("video_path", "subs_id").agg(F.max("l_quantity").alias("score"))
    tried = rows.where("l_linenumber = 1 and l_orderkey % 40 = 3").select("video_path", "subs_id").distinct()
    return due(found, tried, 45.0, 5)


@query("""WITH f AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS dir, lpad(CAST(page_id AS VARCHAR), 8, '0') AS name, page_id FROM pages) SELECT page_id FROM f QUALIFY row_number() OVER (PARTITION BY dir ORDER BY name DESC) > 2""")
def old_reports(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.archive import outdated

    rows = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("dir"), F.lpad(F.col("page_id").cast("string"), 8, "0").alias("name"), "page_id")
    return outdated(rows, 2).select("page_id")
