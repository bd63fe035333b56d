"""Report queries over the provided tables with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, paths
from ..operators import library, state
from .analogues import table

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels as a file's flag, reason and status."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    flag = F.when(F.col("quality").isNull(), "skipped").when(F.col("toxic") == 1, "SUSPECT").when(F.col("quality") == 0, "unknown").otherwise("ok")
    reason = F.when(F.col("toxic") == 1, F.get(F.array(*map(F.lit, labels.SUSPECT_LABELS)), (F.col("doc_id") % 7).cast("int"))).when(F.col("quality") == 0, F.when(F.col("doc_id") % 2 == 0, "no_speech_heard").otherwise("check_failed"))
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("doc_id") % len(STATUSES) + 1).cast("int"))
    action = F.when(F.col("doc_id") % 11 == 0, "remediated: swapped").when(F.col("doc_id") % 13 == 0, labels.REPLACEMENT_FAILED)
    return docs.select("*", flag.alias("correctness_flag"), reason.alias("reason"), status.alias("sync_status"), action.alias("auto_action"))


STATUSES = ("missing", "already in sync", "fixed (Δ1.25s)", "fixed (framerate 25 → 23.976)", "fixed (Δ-2.50s, 3 sync blocks)", "left unchanged (small)", "would fix (Δ0.75s)", "error: timeout", "parse-error")
_REASONS = ", ".join(f"'{r}'" for r in labels.SUSPECT_LABELS)
_FLAGS = f"""fl AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic,
  CASE WHEN l.quality IS NULL THEN 'skipped' WHEN l.toxic = 1 THEN 'SUSPECT' WHEN l.quality = 0 THEN 'unknown' ELSE 'ok' END AS correctness_flag,
  CASE WHEN l.toxic = 1 THEN ([{_REASONS}])[d.doc_id % 7 + 1] WHEN l.quality = 0 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'no_speech_heard' ELSE 'check_failed' END END AS reason,
  ([{", ".join(f"'{s}'" for s in STATUSES)}])[d.doc_id % {len(STATUSES)} + 1] AS sync_status,
  CASE WHEN d.doc_id % 11 = 0 THEN 'remediated: swapped' WHEN d.doc_id % 13 = 0 THEN 'original kept, marked wrong' END AS auto_action
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query(f"""WITH {_FLAGS}, p AS (SELECT lang, count(*) AS total, count(*) FILTER (sync_status = 'missing') AS missing, count(*) FILTER (sync_status <> 'missing' AND correctness_flag = 'skipped') AS skipped,
  count(*) FILTER (sync_status <> 'missing' AND correctness_flag = 'ok' AND (sync_status LIKE 'fixed%' OR sync_status LIKE 'would fix%')) AS fixed,
  count(*) FILTER (sync_status <> 'missing' AND correctness_flag = 'ok' AND NOT (sync_status LIKE 'fixed%' OR sync_status LIKE 'would fix%')) AS insync,
  count(*) FILTER (sync_status <> 'missing' AND correctness_flag IN ('SUSPECT', 'unknown')) AS attention FROM fl GROUP BY lang)
SELECT *, CASE WHEN total - missing - skipped > 0 THEN floor(1000 * (fixed + insync) / (total - missing - skipped) + 0.5) / 10 END AS pct FROM p""")
def library_health(spark: SparkSession, d: str) -> DataFrame:
    status, flag = F.col("sync_status"), F.col("correctness_flag")
    fixed = status.startswith("fixed") | status.startswith("would fix")
    there = status != "missing"
    out = _flags(spark, d).groupBy("lang").agg(F.count("*").alias("total"), F.count_if(~there).alias("missing"), F.count_if(there & (flag == "skipped")).alias("skipped"), F.count_if(there & (flag == "ok") & fixed).alias("fixed"), F.count_if(there & (flag == "ok") & ~fixed).alias("insync"), F.count_if(there & flag.isin(*labels.ATTENTION_FLAGS)).alias("attention"))
    return out.withColumn("pct", labels.percent(F.col("fixed") + F.col("insync"), F.col("total") - F.col("missing") - F.col("skipped")))


@query("""SELECT CASE WHEN value IS NULL THEN 'none' WHEN value < 5 THEN '<5' WHEN value < 10 THEN '5-10' WHEN value < 20 THEN '10-20' WHEN value < 40 THEN '20-40' ELSE '>=40' END AS bucket, count(*) AS n FROM events GROUP BY 1""")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(library.score_bucket(F.col("value"), (5, 10, 20, 40)).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, avg(quality) AS avg_score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def lang_avg_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.avg("quality").alias("avg_score"))


@query("SELECT coalesce(n.n_name, 'unknown') AS kind, count(*) AS files, CAST(sum(CASE WHEN c.c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS ok FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c.c_nationkey = n.n_nationkey GROUP BY 1")
def kind_left_join_counts(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(kinds, "c_nationkey", "left").groupBy(F.coalesce("n_name", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("files"), F.sum(F.when(F.col("c_acctbal") > 0, 1).otherwise(0)).alias("ok"))


@query(f"WITH {_FLAGS} SELECT coalesce(reason, 'other') AS reason, count(*) AS n FROM fl WHERE correctness_flag IN ('SUSPECT', 'unknown') GROUP BY 1 ORDER BY n DESC, reason")
def attention_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _flags(spark, d).where(library.file_filter(flag="attention"))
    return rows.groupBy(F.coalesce("reason", F.lit("other")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


@query("SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'error') AS suspect, round(avg(value), 6) AS avg_score FROM events GROUP BY 1")
def match_rate_day(spark: SparkSession, d: str) -> DataFrame:
    out = library.match_rate(table(spark, d, "events"), "ts", F.col("event_type") == "purchase", F.col("event_type") == "error", "value", "day")
    return out.withColumn("avg_score", F.round("avg_score", 6))


@query("SELECT strftime(ts, '%Y-W%W') AS bucket, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'error') AS suspect, round(avg(value), 6) AS avg_score FROM events GROUP BY 1")
def match_rate_week(spark: SparkSession, d: str) -> DataFrame:
    out = library.match_rate(table(spark, d, "events"), "ts", F.col("event_type") == "purchase", F.col("event_type") == "error", "value", "week")
    return out.withColumn("avg_score", F.round("avg_score", 6))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source ILIKE '%rc1%' ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 25 OFFSET 25")
def files_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").where((F.col("lang") == "en") & F.col("source").ilike("%rc1%"))
    return library.page(rows, "-n_chars", "doc_id", ("n_chars", "lang", "source"), 2, 25)


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) IN ('france', 'germany', 'nation_1', 'nation_2')")
def title_nocase(spark: SparkSession, d: str) -> DataFrame:
    name = F.collate("n_name", "UTF8_LCASE")
    return table(spark, d, "nation").where((name == "FRANCE") | (name == "gErmany") | (name == "NATION_1") | (name == "nation_2")).select("n_nationkey", F.col("n_name").cast("string").alias("n_name"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("""WITH w AS (SELECT DISTINCT user_id FROM events), wanted AS (SELECT user_id, event_type FROM w, (VALUES ('click'), ('view'), ('purchase')) t(event_type)),
have AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0) SELECT * FROM wanted EXCEPT SELECT * FROM have""")
def missing_languages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    wanted = rows.select("user_id").distinct().withColumn("event_type", F.explode(F.array(*map(F.lit, ("click", "view", "purchase")))))
    return library.missing(wanted, rows.where("event_id % 3 = 0").select("user_id", "event_type"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_id) AS r FROM events WHERE event_type <> 'error') WHERE r = 1")
def newest_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("event_type <> 'error'").withColumn("day", F.date_trunc("day", "ts"))
    return library.newest(rows, ["user_id"], "day", "event_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 20")
def top_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    return library.newest(table(spark, d, "events").select("user_id", "event_id", "value", "ts"), ["user_id"], "ts", "event_id", 20).drop("ts")


@query("SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_id % 2 = 0 EXCEPT SELECT user_id, event_type, CAST(floor(value) AS BIGINT) FROM events WHERE event_id % 2 = 1")
def wanted_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    keys = ["user_id", "event_type", F.floor("value").cast("long").alias("v")]
    return rows.where("event_id % 2 = 0").select(*keys).subtract(rows.where("event_id % 2 = 1").select(*keys))


@query("SELECT event_type, count(DISTINCT user_id) AS videos FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND value > 1 GROUP BY 1")
def distinct_since(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("ts >= timestamp_ntz'2024-01-10' and value > 1").groupBy("event_type").agg(F.countDistinct("user_id").alias("videos"))


@query("""WITH o AS (SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1),
n AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 2 = 0 THEN value END AS value FROM events WHERE user_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_id, o.event_id) AS event_id, coalesce(n.event_type, o.event_type) AS event_type, coalesce(n.value, o.value) AS value FROM o FULL JOIN n ON o.user_id = n.user_id""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    first = Window.partitionBy("user_id")
    old = rows.withColumn("r", F.row_number().over(first.orderBy("event_id"))).where("r = 1").drop("r")
    new = rows.where("user_id % 3 = 0").withColumn("r", F.row_number().over(first.orderBy(F.desc("event_id")))).where("r = 1").drop("r").withColumn("value", F.when(F.col("event_id") % 2 == 0, F.col("value")))
    return state.upsert(old, new, ["user_id"], ("value",))


@query("SELECT event_id, user_id FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 500")
def ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    return state.keep_newest_ids(table(spark, d, "events").select("event_id", "user_id"), "event_id", 500)


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def retention(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "ts")
    return state.keep_recent(rows, "ts", F.lit(rows.agg(F.max("ts")).first()[0]).cast("timestamp_ntz"), 10)


@query("SELECT r_name AS title, n_name AS season, count(*) AS videos, round(sum(c_acctbal), 2) AS size FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def title_season_rollup(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.rollup(F.col("r_name").alias("title"), F.col("n_name").alias("season")).agg(F.count("*").alias("videos"), F.round(F.sum("c_acctbal"), 2).alias("size"))


@query("""SELECT r_name AS title, string_agg(n_name || ':' || k, ',' ORDER BY n_name) AS seasons FROM (SELECT r_name, n_name, count(c_custkey) AS k FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1""")
def series_nested(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    seasons = nations.join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("r_name", "n_name").agg(F.count("c_custkey").alias("k"))
    held = F.sort_array(F.collect_list(F.struct("n_name", "k")))
    return seasons.groupBy(F.col("r_name").alias("title")).agg(F.array_join(F.transform(held, lambda s: F.concat(s["n_name"], F.lit(":"), s["k"].cast("string"))), ",").alias("seasons"))


@query("""SELECT o_orderpriority AS model, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def eval_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("model", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("F", "O", "P")])


@query(f"""WITH {_FLAGS} SELECT doc_id, CASE WHEN sync_status = 'missing' THEN 'nosub' WHEN correctness_flag = 'skipped' THEN 'skipped'
  WHEN correctness_flag = 'unknown' THEN CASE reason WHEN 'no_speech_heard' THEN 'no_speech' WHEN 'check_failed' THEN 'check_failed' ELSE 'unknown' END
  WHEN correctness_flag = 'SUSPECT' THEN CASE WHEN coalesce(auto_action, '') = 'original kept, marked wrong' THEN 'repl_failed' ELSE CASE reason {" ".join(f"WHEN '{r}' THEN '{x}'" for r, x in labels.SUSPECT_LABELS.items())} ELSE 'needs_attention' END END
  WHEN correctness_flag = 'ok' THEN CASE WHEN auto_action LIKE 'remediated: %' THEN 'insync' WHEN sync_status LIKE 'fixed (framerate%' THEN 'fixed_rate' WHEN sync_status LIKE 'fixed%' OR sync_status LIKE 'would fix%' THEN 'fixed_shift' ELSE 'insync' END
  ELSE 'not_checked' END AS label FROM fl""")
def verdict_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select("doc_id", labels.verdict(*map(F.col, ("sync_status", "correctness_flag", "reason", "auto_action"))).alias("label"))


@query(f"""WITH {_FLAGS} SELECT count(*) FILTER (sync_status LIKE 'fixed (Δ%' OR sync_status LIKE 'would fix (Δ%' OR sync_status = 'fixed') AS moved, count(*) FILTER (sync_status LIKE 'fixed (framerate%' OR sync_status LIKE 'fixed (rate%') AS rescaled,
  count(*) FILTER (sync_status LIKE 'fixed%' OR sync_status LIKE 'would fix%') AS fixed, count(*) FILTER (auto_action LIKE 'remediated: %' OR auto_action LIKE '%; remediated: %') AS replaced, count(*) FILTER (sync_status = 'already in sync') AS nochange, count(*) FILTER (sync_status LIKE 'left unchanged%') AS unchanged FROM fl""")
def sync_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).agg(*[F.count_if(F.expr(p)).alias(k) for k, p in labels.SYNC_KINDS.items()])


@query(f"""WITH {_FLAGS} SELECT doc_id, TRY_CAST(nullif(regexp_extract(sync_status, 'Δ\\s*([+-]?\\d+(?:\\.\\d+)?)\\s*s', 1), '') AS DOUBLE) AS delta, TRY_CAST(nullif(regexp_extract(sync_status, '(\\d+) sync blocks?', 1), '') AS INTEGER) AS sections,
  CASE WHEN sync_status LIKE '%→%' THEN 25.0::DOUBLE END AS made_for FROM fl""")
def status_parts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sync_status")
    return _flags(spark, d).select("doc_id", labels.parse_delta(s).alias("delta"), labels.parse_sections(s).alias("sections"), labels.parse_rates(s)["made_for"].alias("made_for"))


@query(f"""WITH {_FLAGS} SELECT doc_id % 50 AS run_id, count(*) AS files_done, count(*) FILTER (sync_status LIKE 'fixed%') AS files_fixed, count(*) FILTER (correctness_flag = 'SUSPECT') AS files_suspect, count(*) FILTER (contains(sync_status, 'error')) AS files_error FROM fl GROUP BY 1""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    return state.run_counts(_flags(spark, d).withColumn("run_id", F.col("doc_id") % 50))


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS size, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END AS version FROM documents WHERE doc_id % 5 <> 0)
SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = d.doc_id AND s.size IS NOT DISTINCT FROM d.n_chars AND s.version IS NOT DISTINCT FROM d.lang)""")
def incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size"), F.col("lang").alias("version"))
    before = now.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("doc_id") % 6 != 0, F.col("version")).alias("version"))
    return state.to_process(now, before, ["doc_id"], ["size", "version"]).select("doc_id")


@query("""SELECT url, page_id, id FROM (SELECT url, page_id, CASE WHEN page_id % 2 = 0 THEN page_id END AS id FROM pages WHERE NOT (url LIKE 'https://m.%'))
UNION ALL SELECT n.url, n.page_id, coalesce(n.id, o.id) FROM (SELECT url, page_id + 1000000 AS page_id, CASE WHEN page_id % 5 = 0 THEN page_id END AS id FROM pages WHERE url LIKE 'https://m.%' AND page_id % 3 = 0) n LEFT JOIN (SELECT url, CASE WHEN page_id % 2 = 0 THEN page_id END AS id FROM pages) o USING (url)""")
def scoped_replace(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("url", "page_id", F.when(F.col("page_id") % 2 == 0, F.col("page_id")).alias("id"))
    fresh = rows.where(F.col("url").startswith("https://m.") & (F.col("page_id") % 3 == 0)).select("url", (F.col("page_id") + 1_000_000).alias("page_id"), F.when(F.col("page_id") % 5 == 0, F.col("page_id")).alias("id"))
    marked = lambda x: x.withColumn("url", F.regexp_replace("url", r"^https://m\.", "https://m./"))
    out = state.replace_scope(marked(rows), marked(fresh), "url", ["https://m."], ("id",), "url")
    return out.withColumn("url", F.regexp_replace("url", r"^https://m\./", "https://m."))


@query("""SELECT user_id AS key, round(avg(CASE WHEN event_id % 4 <> 0 THEN value END), 6) AS avg_score, count(*) FILTER (event_id % 4 <> 0 AND value >= 10) AS good, count(*) FILTER (event_id % 4 <> 0) AS valid,
  CASE WHEN count(*) FILTER (event_id % 4 <> 0) = 0 THEN 'unknown' WHEN 2 * count(*) FILTER (event_id % 4 <> 0 AND value >= 10) >= count(*) FILTER (event_id % 4 <> 0) THEN 'ok' ELSE 'SUSPECT' END AS flag FROM events GROUP BY 1""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("score"))
    return library.vote(samples, "key", "score", 10.0).withColumn("avg_score", F.round("avg_score", 6))


@query("""WITH s AS (SELECT user_id, 'a' || user_id AS v, 0 AS p FROM events WHERE event_type = 'purchase' AND event_id % 5 = 0 UNION SELECT user_id, 'b' || user_id, 1 FROM events WHERE event_type = 'click' UNION SELECT user_id, 'c' || user_id, 2 FROM events)
SELECT user_id, v FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p) = 1""")
def priority_union(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    source = lambda where, mark: rows.where(where).select("user_id", F.concat(F.lit(mark), F.col("user_id").cast("string")).alias("v")).distinct()
    return library.first_of([source("event_type = 'purchase' and event_id % 5 = 0", "a"), source("event_type = 'click'", "b"), source("true", "c")], ["user_id"])


@query("""WITH e AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 15), k AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1) SELECT count(*) FILTER (n = (SELECT count(DISTINCT event_type) FROM events)) AS common, count(*) AS "union", count(*) FILTER (n = 1) AS alone,
  count(*) FILTER (n = (SELECT count(DISTINCT event_type) FROM events)) / count(*) AS jaccard FROM k""")
def set_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    kinds = rows.select("event_type").distinct().count()
    return library.agreement(rows.where("value > 15").select(F.col("user_id").alias("item"), F.col("event_type").alias("set")), kinds)


@query("""WITH m AS (SELECT DISTINCT user_id AS video_path, event_type AS lang FROM events WHERE event_type IN ('click', 'view')), f AS (SELECT DISTINCT user_id AS video_path, event_type AS lang FROM events WHERE value < 2 AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR),
x AS (SELECT * FROM m EXCEPT SELECT * FROM f), v AS (SELECT DISTINCT video_path FROM x ORDER BY 1 LIMIT 40) SELECT video_path, lang, CAST(row_number() OVER (PARTITION BY video_path ORDER BY lang) AS INTEGER) AS turn FROM x WHERE video_path IN (SELECT video_path FROM v)""")
def generation_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumnRenamed("user_id", "video_path").withColumnRenamed("event_type", "lang")
    wanted = rows.where("lang in ('click', 'view')").select("video_path", "lang").distinct()
    tries = rows.select("video_path", "lang", (F.col("value") >= 2).alias("ok"), F.col("ts").alias("at"))
    return state.generation_plan(wanted, tries, F.lit("2024-01-31").cast("timestamp_ntz"), 40, 24)


@query("SELECT event_id, event_type FROM events WHERE event_id > 777 ORDER BY event_id LIMIT 100")
def log_after(spark: SparkSession, d: str) -> DataFrame:
    return library.after(table(spark, d, "events").select("event_id", "event_type"), "event_id", 777, 100)


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 100) ORDER BY event_id")
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    return library.last_rows(table(spark, d, "events").select("event_id", "event_type"), "event_id", 100)


@query("SELECT c_custkey AS user_id, o_orderkey AS token FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > TIMESTAMP '1998-01-01' AND c_acctbal > 0")
def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "orders").where("o_orderdate > timestamp_ntz'1998-01-01'").select("o_custkey", F.col("o_orderkey").alias("token"))
    return sessions.join(table(spark, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("user_id"), "token")


@query("SELECT o_orderkey, CASE WHEN n > 0 THEN least(99, floor(100 * o_orderkey % 97 / n)) END AS pct FROM (SELECT o_orderkey, o_custkey % 9 * 20 AS n FROM orders)".replace("floor(100 * o_orderkey % 97 / n)", "CAST(floor(100 * (o_orderkey % 97) / n) AS INTEGER)"))
def run_progress(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 97).alias("done"), (F.col("o_custkey") % 9 * 20).alias("n"))
    return rows.select("o_orderkey", labels.run_percent(F.col("done"), F.col("n"), F.lit(True)).alias("pct"))


@query("""SELECT page_id, nullif(regexp_extract(url, '^(https?)://', 1), '') AS scheme, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host, CASE WHEN regexp_matches(url, '/[a-z]{2}/') THEN regexp_extract(url, '/([a-z]{2})/', 1) END AS lang,
  'S' || lpad(CAST(page_id % 30 AS VARCHAR), 2, '0') || 'E' || lpad(CAST(page_id % 120 AS VARCHAR), CASE WHEN page_id % 120 > 99 THEN 3 ELSE 2 END, '0') AS code, 'S' || lpad(CAST(page_id % 30 AS VARCHAR), 2, '0') AS season,
  'en' AS file_lang, 'Show ' || page_id % 7 AS title FROM pages""")
def season_episode_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", "url")
    name = F.concat(F.lit("/media/Show "), (F.col("page_id") % 7).cast("string"), F.lit("/Season 1/Show.s"), (F.col("page_id") % 30).cast("string"), F.lit("e"), (F.col("page_id") % 120).cast("string"), F.lit(".EN.srt"))
    code = paths.episode_code(paths.base_name(name))
    lang = F.regexp_extract("url", "/([a-z]{2})/", 1)
    return rows.select("page_id", F.nullif(F.regexp_extract("url", "^(https?)://", 1), F.lit("")).alias("scheme"), F.lower(F.regexp_extract("url", "^https?://([^/]+)", 1)).alias("host"), F.nullif(lang, F.lit("")).alias("lang"), code.alias("code"), paths.season_of(code).alias("season"), paths.language_of_file(name).alias("file_lang"), paths.title_of(name).alias("title"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).where("k >= 50")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_discount), 8) AS disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def detail_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.round(F.avg("l_discount"), 8).alias("disc"))
