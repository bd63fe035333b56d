"""Text queries over conversations, documents and pages with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, paths, text
from ..operators import align, retime
from ..sources import feeds, subtitle
from .analogues import CUES, cues, millis, table

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOPWORDS) + "]"
_CLASS = "[a-zA-ZæøåÆØÅéèêëüöäßñçÉÈÊËÜÖÄ'']{4,}"


def _toks(column: str) -> str:
    return f"list_filter(list_distinct(list_transform(regexp_extract_all({column}, '{_CLASS}'), lambda x: lower(x))), lambda x: NOT list_contains({_STOP}, x))"


_CONV = f"cv AS (SELECT conv_id AS f, turn AS idx, role, text, {_toks('text')} AS w FROM conversations)"


def _conversation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("idx"), "role", "text", text.tokens(F.col("text")).alias("toks"))


@query(f"WITH {_CONV}, p AS (SELECT f, idx, w, lead(w) OVER (PARTITION BY f ORDER BY idx) AS x FROM cv) SELECT f AS file_id, idx, len(w) AS n, CASE WHEN len(w) > 0 THEN len(list_intersect(w, x)) / len(w) END AS share FROM p WHERE x IS NOT NULL".replace("len(w) AS n", "CAST(len(w) AS INTEGER) AS n"))
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    nxt = F.lead("toks").over(Window.partitionBy("file_id").orderBy("idx"))
    rows = _conversation(spark, d).withColumn("other", nxt).where("other is not null")
    return rows.select("file_id", "idx", F.size("toks").alias("n"), text.overlap(F.col("toks"), F.col("other")).alias("share"))


@query(f"""WITH {_CONV}, n AS (SELECT s.f, s.idx AS si, c.idx AS ci, len(list_intersect(s.w, c.w)) AS shared, len(list_intersect(s.w, c.w)) / len(c.w) AS share FROM cv s JOIN cv c ON s.f = c.f AND c.idx BETWEEN s.idx - 3 AND s.idx + 3 AND s.role = 'assistant' AND c.role = 'user' WHERE len(c.w) > 0),
g AS (SELECT * FROM n WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY f, si ORDER BY share DESC, ci) = 1), b AS (SELECT * FROM g WHERE share >= 0.1 AND shared >= 2)
SELECT f AS file_id, si AS s_idx, ci AS c_idx, CAST(shared AS INTEGER) AS shared, share FROM b QUALIFY row_number() OVER (PARTITION BY f, ci ORDER BY si) = 1""")
def anchor_match(spark: SparkSession, d: str) -> DataFrame:
    from ..params import Params

    rows = _conversation(spark, d).withColumn("t", F.col("idx"))
    out = align.match(rows.where("role = 'assistant'"), rows.where("role = 'user'"), 3, 3, Params(anchor_overlap=0.1))
    return out.select("file_id", "s_idx", "c_idx", "shared", "share")


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, p[1] AS l1, p[2] AS l2, regexp_matches(p[1], '^[^\p{L}]*\p{Ll}') AND regexp_matches(p[2], '^[^\p{L}]*\p{Lu}') AND NOT regexp_matches(p[1], '[.!?][^A-Za-z0-9_]*$') AS swapped FROM l WHERE len(p) = 2""")
def two_line_swaps(spark: SparkSession, d: str) -> DataFrame:
    pair = text.two_lines(F.col("text"), marked=False)
    rows = table(spark, d, "documents").select("doc_id", pair.alias("p")).where("p is not null")
    first, second = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return rows.select("doc_id", first.alias("l1"), second.alias("l2"), text.cap_signal(first, second).alias("swapped"))


_MARK = "CASE doc_id % 5 WHEN 0 THEN '[music playing]' WHEN 1 THEN '(sighs) *door*' WHEN 2 THEN 'well (coughs) see' WHEN 3 THEN '♪ la la ♪' ELSE text END"


def _marked(spark: SparkSession, d: str) -> DataFrame:
    said = F.try_element_at(F.array(*map(F.lit, ("[music playing]", "(sighs) *door*", "well (coughs) see", "♪ la la ♪"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(said, F.col("text")).alias("said"))


@query(rf"SELECT doc_id FROM documents WHERE NOT regexp_matches(trim({_MARK}), '^-?\s*(?:(?:[\[(][^\[\]()]*[\])]|\*[^*]+\*)\s*)+$')")
def nonspeech_filter(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).where(~text.is_nonspeech(F.col("said"))).select("doc_id")


@query(rf"SELECT doc_id FROM documents WHERE regexp_matches({_MARK}, '[♪♫]') OR (regexp_matches(trim({_MARK}), '^-?\s*(?:(?:[\[(][^\[\]()]*[\])]|\*[^*]+\*)\s*)+$') AND regexp_matches({_MARK}, '(?i)\b(?:music|song|singing|sings)\b'))")
def music_spans(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).where(text.is_music(F.col("said"))).select("doc_id")


@query("SELECT conv_id AS file_id, sha256(string_agg(turn || '|' || role || '|' || text, chr(10) ORDER BY turn)) AS fingerprint FROM conversations GROUP BY 1")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct("turn", F.concat_ws("|", F.col("turn").cast("string"), "role", "text").alias("r"))
    held = F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"])
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("file_id")).agg(F.sha2(F.array_join(held, "\n"), 256).alias("fingerprint"))


@query("""SELECT event_id, (floor(value)::BIGINT // 60) || ':' || lpad(CAST(floor(value)::BIGINT % 60 AS VARCHAR), 2, '0') AS clock, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS took,
CASE WHEN s % 4 = 0 THEN NULL ELSE ((s % 4) * 60 + 30.5)::DOUBLE END AS shift, CASE event_id % 3 WHEN 0 THEN '0,1,2,6' WHEN 1 THEN '3' END AS cpus, CASE event_id % 3 WHEN 0 THEN 'da' WHEN 1 THEN 'en' END AS lang, event_id % 2 = 0 AS same
FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) AS s FROM events)""")
def formatted_values(spark: SparkSession, d: str) -> DataFrame:
    s = F.floor(F.col("value") * 100).cast("long")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (F.col("event_id") % len(v) + 1).cast("int"))
    rows = table(spark, d, "events").withColumn("s", s)
    stamp = F.when(F.col("s") % 4 != 0, F.concat(F.lit("0:"), (F.col("s") % 4).cast("string"), F.lit(":30.5")))
    return rows.select("event_id", labels.clock(F.col("value")).alias("clock"), labels.duration_text(F.col("s")).alias("took"), labels.shift_seconds(stamp).alias("shift"), F.array_join(paths.cpu_list(pick("0-2, 6", "3", "x-1")).cast("array<string>"), ",").alias("cpus"), paths.language_code(pick("Danish", "en", "klingon")).alias("lang"), paths.same_language(F.lit("en-US"), F.when(F.col("event_id") % 2 == 0, F.lit("en")).otherwise("de")).alias("same"))


@query("""SELECT page_id, '/films/' || page_id || '/a.mkv' AS ours, '/data' AS theirs_prefix, '/mnt/x' AS ours_prefix, 'http://host' || page_id || ':80' AS url, 'film.srt' AS original FROM pages""")
def mapped_paths(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("page_id").cast("string")
    pairs = paths.path_pairs(F.lit("/tv=/shows,/mnt/movies=/films,/mnt=/other"))
    theirs, ours = F.concat(F.lit("/data/m/"), number, F.lit("/a.mkv")), F.concat(F.lit("/mnt/x/m/"), number, F.lit("/a.mkv"))
    pair = paths.suggested_pair(ours, theirs)
    return table(spark, d, "pages").select("page_id", paths.mapped_path(F.concat(F.lit("/mnt/movies/"), number, F.lit("/a.mkv")), pairs, back=True).alias("ours"), pair["theirs"].alias("theirs_prefix"), pair["ours"].alias("ours_prefix"), paths.normalized_url(F.concat(F.lit(" host"), number, F.lit(":80/"))).alias("url"), paths.original_name(F.lit("film.20240102-030405.srt")).alias("original"))


@query("""SELECT conv_id AS file_id, turn AS idx, i AS part, p AS said FROM (SELECT conv_id, turn, unnest(range(0, 3)) AS i, unnest([array_to_string(w[1:k1], ' '), array_to_string(w[k1 + 1:k1 + k2], ' '), array_to_string(w[k1 + k2 + 1:], ' ')]) AS p FROM
(SELECT conv_id, turn, w, (len(w) + 2) // 3 AS k1, (len(w) + 1) // 3 AS k2 FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations WHERE role = 'user'))) WHERE p <> ''""".replace("i AS part", "CAST(i AS INTEGER) AS part"))
def wrapped_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("idx"), text.wrapped(F.col("text"), F.lit(3)).alias("p"))
    return rows.select("file_id", "idx", F.posexplode("p").alias("part", "said"))


@query(f"""WITH {CUES} SELECT f AS file_id, string_agg(n || chr(10) || a || ' --> ' || b || chr(10) || t || chr(10), chr(10) ORDER BY n) AS srt FROM (SELECT f, t, row_number() OVER (PARTITION BY f ORDER BY s, e, idx) AS n,
  lpad(CAST(s // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60000 // 1000 AS VARCHAR), 2, '0') || ',' || lpad(CAST(s % 1000 AS VARCHAR), 3, '0') AS a,
  lpad(CAST(e // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(e % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(e % 60000 // 1000 AS VARCHAR), 2, '0') || ',' || lpad(CAST(e % 1000 AS VARCHAR), 3, '0') AS b FROM (SELECT f, idx, t, s - 1704000000000 AS s, e - 1704000000000 AS e FROM cues)) GROUP BY 1""".replace("lpad(CAST(s // 3600000 AS VARCHAR), 2, '0')", "CASE WHEN s // 3600000 < 10 THEN '0' ELSE '' END || (s // 3600000)").replace("lpad(CAST(e // 3600000 AS VARCHAR), 2, '0')", "CASE WHEN e // 3600000 < 10 THEN '0' ELSE '' END || (e // 3600000)"))
def srt_text(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d)
    return subtitle.as_srt(c.select("file_id", "idx", (F.col("start") - 1_704_000_000_000).alias("start_ms"), (F.col("end") - 1_704_000_000_000).alias("end_ms"), "text"))


@query("""SELECT event_id, value AS a, round(value + 1.5, 6) AS b FROM events""")
def transcript_json(spark: SparkSession, d: str) -> DataFrame:
    ms = F.round(F.col("value") * 1000).cast("long")
    part = F.struct(F.struct(ms.alias("from"), (ms + 1500).alias("to")).alias("offsets"), F.col("event_type").alias("text"))
    body = F.to_json(F.struct(F.array(part).alias("transcription"), F.struct(F.lit("en").alias("language")).alias("result")))
    rows = table(spark, d, "events").select("event_id", F.inline(feeds.transcript_segments(body)))
    return rows.select("event_id", F.col("start").alias("a"), F.round("end", 6).alias("b"))


@query("""SELECT DISTINCT user_id AS id, event_type AS lang FROM events WHERE value > 20""")
def wanted_keys(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("user_id").alias("episode"), F.array(F.struct(F.col("event_type").alias("code2"))).alias("missing_subtitles"))
    answers = table(spark, d, "events").where("value > 20").select(F.to_json(F.struct(F.array(item).alias("data"))).alias("body"))
    return feeds.wanted_keys(answers, "episode")


@query("""SELECT event_id, 2 AS n, '3/12' AS counts, '1.25/-61.5' AS shifts, '0.5/7.0' AS starts, '1.5/60.0' AS ends FROM events""")
def log_blocks(spark: SparkSession, d: str) -> DataFrame:
    log = F.concat(F.lit("line\nshifted block of 3 subtitles with length 0:00:10.1 by 0:00:01.25\nshifted block of 12 subtitles with length 1:00:10.0 by -0:01:01.5 # "), F.col("event_id").cast("string"))
    quiet = F.lit("silence_start: 0.5\nsilence_end: 1.5 | d: 1\nsilence_start: 7")
    rows = table(spark, d, "events").select("event_id", feeds.aligner_blocks(log).alias("b"), feeds.silences(quiet, F.lit(60.0)).alias("s"))
    return rows.select("event_id", F.size("b").alias("n"), *[F.array_join(F.col(c).cast("array<string>"), "/").alias(n) for c, n in (("b.n", "counts"), ("b.shift", "shifts"), ("s.start", "starts"), ("s.end", "ends"))])


@query(f"WITH {CUES}, r AS (SELECT f, idx, s, greatest(e, s + 500) AS e, t FROM cues WHERE v > 1), n AS (SELECT *, lead(s) OVER (PARTITION BY f ORDER BY s, idx) AS x FROM r) SELECT f AS file_id, idx, s AS start, CASE WHEN x > s AND e > x THEN x ELSE e END AS \"end\", t AS text FROM n")
def segments_to_cues(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d).where("value > 1").select("file_id", "idx", (F.col("start") / 1000.0).alias("start"), (F.col("end") / 1000.0).alias("end"), F.concat(F.lit("  "), "text").alias("text"))
    return retime.cues_of(c)


@query(None)
def sequence_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("l1")).withColumn("l2", F.lead("l1").over(w)).where("l2 is not null")
    told = F.when(F.col("turn") % 2 == 0, F.concat_ws(" ", "l1", "l2")).otherwise(F.concat_ws(" ", "l2", "l1"))
    return rows.select("conv_id", "turn", text.order_verdict(told, F.col("l1"), F.col("l2")).alias("swapped"))


@query(None)
def split_cues(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return rows.lateralJoin(text.SplitCue(F.col("text").outer(), F.lit(0.0), F.lit(20.0), F.lit(84), F.lit(7.0))).select("conv_id", "turn", "part", "part_start", "part_end", "part_text")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS ok FROM events GROUP BY 1")
def stream_match_rate(spark: SparkSession, d: str) -> DataFrame:
    """The daily rate as a stream that reads what there is and ends; the complete result is kept in memory, one row for each day."""
    import uuid

    from ..schemas import EVENTS

    name = f"rate_{uuid.uuid4().hex}"
    rows = spark.readStream.schema(EVENTS).parquet(f"{d}/events.parquet*")
    day = (F.floor(millis("ts") / 86_400_000)).cast("int")
    rate = rows.groupBy(F.date_from_unix_date(day).cast("string").alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "purchase").alias("ok"))
    q = rate.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
