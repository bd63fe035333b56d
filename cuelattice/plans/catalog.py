"""Queries of the library's catalogue: pages are videos that a connector knows under other folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, library
from ..sources import probe
from ..stored import stored
from .analogues import cues, lengths, table

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _videos(spark: SparkSession, d: str) -> DataFrame:
    """``(page_id, path, theirs, told)``: a page's file as the library and as the connector names it; mobile pages lie in a folder of their own there, hosts with a dash are not told."""
    host, rest = F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.regexp_extract("url", "^https?://[^/?#]+/([^?#]*)", 1)
    file = F.concat(host, F.lit("/"), F.regexp_replace(rest, r"\.html$", ""), F.lit(".mkv"))
    secure = F.col("url").startswith("https")
    ours = F.concat(F.when(secure, "/media/tv/").otherwise("/media/movies/"), file)
    theirs = F.concat(F.when(host.startswith("m."), "/old/").when(secure, "/tv/").otherwise("/data/films/"), file)
    return table(spark, d, "pages").select("page_id", ours.alias("path"), theirs.alias("theirs"), (~host.contains("-")).alias("told"))


_VIDEOS = r"""vi AS (SELECT page_id, CASE WHEN starts_with(url, 'https') THEN '/media/tv/' ELSE '/media/movies/' END || f AS path, CASE WHEN starts_with(h, 'm.') THEN '/old/' WHEN starts_with(url, 'https') THEN '/tv/' ELSE '/data/films/' END || f AS theirs, NOT contains(h, '-') AS told
FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h, regexp_extract(url, '^https?://([^/?#]+)', 1) || '/' || regexp_replace(regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1), '\.html$', '') || '.mkv' AS f FROM pages)),
ow AS (SELECT DISTINCT path FROM vi), th AS (SELECT DISTINCT theirs AS path FROM vi WHERE told),
ot AS (SELECT n, tail, min(path) AS path FROM (SELECT path, n, array_to_string(list_slice(p, len(p) - n + 1, len(p)), '/') AS tail FROM (SELECT path, p, unnest(range(3, len(p) + 1)) AS n FROM (SELECT path, string_split(path, '/') AS p FROM ow))) GROUP BY n, tail HAVING count(*) = 1),
tt AS (SELECT n, tail, min(path) AS path FROM (SELECT path, n, array_to_string(list_slice(p, len(p) - n + 1, len(p)), '/') AS tail FROM (SELECT path, p, unnest(range(3, len(p) + 1)) AS n FROM (SELECT path, string_split(path, '/') AS p FROM th))) GROUP BY n, tail HAVING count(*) = 1),
ma AS (SELECT tt.path AS theirs, arg_max(ot.path, ot.n) AS ours FROM tt JOIN ot USING (n, tail) GROUP BY 1),
pk AS (SELECT theirs, ours, (SELECT max(k) FROM (SELECT unnest(range(0, 30)) AS k) WHERE k <= least(len(a), len(b)) AND list_slice(a, len(a) - k + 1, len(a)) = list_slice(b, len(b) - k + 1, len(b))) AS k, a, b FROM (SELECT *, string_split(theirs, '/') AS a, string_split(ours, '/') AS b FROM ma WHERE theirs <> ours)),
pj AS (SELECT a, b, CASE WHEN k = len(a) - 1 THEN k - 1 ELSE k END AS k FROM pk), pr AS (SELECT array_to_string(list_slice(a, 1, len(a) - k), '/') AS theirs, array_to_string(list_slice(b, 1, len(b) - k), '/') AS ours, count(*) AS votes FROM pj GROUP BY 1, 2),
hd AS (SELECT path, array_to_string(list_slice(p, 1, n), '/') AS head FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS n FROM (SELECT path, string_split(path, '/') AS p FROM th))),
ca AS (SELECT hd.path AS theirs, pr.ours || substr(hd.path, length(hd.head) + 1) AS ours, 1 AS r, -votes AS v, 'learned' AS how FROM hd JOIN pr ON pr.theirs = hd.head WHERE pr.ours || substr(hd.path, length(hd.head) + 1) IN (SELECT path FROM ow)
  UNION ALL SELECT path, path, 0, 0, 'exact' FROM th WHERE path IN (SELECT path FROM ow) UNION ALL SELECT theirs, ours, 2, 0, 'ending' FROM ma),
re AS (SELECT th.path AS theirs, b.ours, coalesce(b.how, 'unmatched') AS how FROM th LEFT JOIN (SELECT theirs, g.ours AS ours, g.how AS how FROM (SELECT theirs, arg_min({'ours': ours, 'how': how}, {'r': r, 'v': v, 'o': ours}) AS g FROM ca GROUP BY theirs)) b ON b.theirs = th.path)"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(_videos(spark, d))
    ours, theirs = rows.select("path"), rows.where("told").select(F.col("theirs").alias("path"))
    matches = stored(catalog.same_files(ours, theirs))
    return catalog.resolved(ours, theirs, catalog.learned_pairs(matches), matches)


@query(f"WITH {_VIDEOS} SELECT theirs, ours, how FROM re")
def resolved_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every path of the connector with the library's name for it, by prefixes learned from shared endings."""
    return _resolved(spark, d)


@query(f"WITH {_VIDEOS} SELECT theirs, ours, votes FROM pr")
def learned_prefixes(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(_videos(spark, d))
    return catalog.learned_pairs(catalog.same_files(rows.select("path"), rows.where("told").select(F.col("theirs").alias("path"))))


@query(f"""WITH {_VIDEOS}, sc AS (SELECT path, min(page_id) AS id, bool_or(length(html) > 3000) AS ext, max(length(html)) AS size FROM vi JOIN pages USING (page_id) GROUP BY path),
cn AS (SELECT re.ours AS path, min(substr(d.text, 1, 12)) AS title, min('S01E' || lpad(CAST(vi.page_id % 40 AS VARCHAR), 2, '0')) AS se, min(vi.page_id // 100) AS sid, min(vi.page_id) AS eid FROM re JOIN vi ON vi.theirs = re.theirs AND vi.told JOIN documents d ON d.doc_id = vi.page_id WHERE re.ours IS NOT NULL GROUP BY re.ours),
bf AS (SELECT sc.path, sc.id // 50 AS sid, sc.id + 7 AS eid, CASE WHEN size % 2 = 0 AND NOT ext THEN [lang] END AS langs FROM sc JOIN documents d ON d.doc_id = sc.id WHERE d.source < 'src5'),
pb AS (SELECT sc.path, CASE WHEN length(d.text) % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['x' || lang] END AS langs FROM sc JOIN documents d ON d.doc_id = sc.id WHERE NOT ext)
SELECT sc.path AS video_path, coalesce(cn.title, regexp_extract(sc.path, '([^/]*)/[^/]*$', 1)) AS title, CASE WHEN cn.title IS NULL THEN 'guess' ELSE 'connector' END AS title_from, cn.se AS season_episode, coalesce(cn.sid, bf.sid) AS series_id,
  CASE WHEN cn.sid IS NOT NULL THEN 'connector' WHEN bf.sid IS NOT NULL THEN 'before' END AS series_id_from, coalesce(cn.eid, bf.eid) AS episode_id, array_to_string(coalesce(bf.langs, pb.langs), ',') AS langs, CASE WHEN bf.langs IS NOT NULL THEN 'before' WHEN pb.langs IS NOT NULL THEN 'probe' END AS langs_from,
  ext OR coalesce(len(coalesce(bf.langs, pb.langs)) > 0, false) AS has_subtitle, cn.title IS NOT NULL AS matched
FROM sc LEFT JOIN cn ON cn.path = sc.path LEFT JOIN bf ON bf.path = sc.path LEFT JOIN pb ON pb.path = sc.path""")
def video_dimension(spark: SparkSession, d: str) -> DataFrame:
    """One row a video: the connector's titles and ids over guesses and earlier rows, embedded languages only where no subtitle lies beside it, each with its source."""
    rows = stored(_videos(spark, d))
    docs = table(spark, d, "documents")
    scanned = rows.join(table(spark, d, "pages").select("page_id", F.length("html").alias("n")), "page_id").groupBy(F.col("path").alias("video_path")).agg(F.min("page_id").alias("id"), F.max(F.col("n") > 3000).alias("has_external"), F.max("n").alias("size"))
    scanned = stored(scanned.withColumn("title", F.regexp_extract("video_path", "([^/]*)/[^/]*$", 1)).withColumn("season_episode", F.lit(None).cast("string")).withColumn("mtime", F.lit(0).cast("long")))
    known = rows.where("told").select("page_id", "theirs").join(_resolved(spark, d).where("ours is not null").select("theirs", "ours"), "theirs").join(docs.select(F.col("doc_id").alias("page_id"), "text"), "page_id")
    number = F.concat(F.lit("S01E"), F.lpad((F.col("page_id") % 40).cast("string"), 2, "0"))
    connector = known.groupBy(F.col("ours").alias("video_path")).agg(F.min(F.substring("text", 1, 12)).alias("title"), F.min(number).alias("season_episode"), F.min(F.floor(F.col("page_id") / 100)).alias("series_id"), F.min("page_id").alias("episode_id"))
    told = scanned.join(docs.select(F.col("doc_id").alias("id"), "text", "lang", "source"), "id")
    before = told.where("source < 'src5'").select("video_path", F.floor(F.col("id") / 50).alias("series_id"), (F.col("id") + 7).alias("episode_id"), "mtime", F.when(F.col("size") % 2 == 0, F.col("size")).otherwise(-1).alias("size"), F.array("lang").alias("langs"))
    probes = told.select("video_path", F.when(F.length("text") % 3 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.concat(F.lit("x"), "lang"))).alias("langs"))
    out = catalog.video_rows(scanned, connector, probes, before)
    return out.select("video_path", "title", "title_from", "season_episode", "series_id", "series_id_from", "episode_id", F.array_join("langs", ",").alias("langs"), "langs_from", "has_subtitle", "matched")


@query(None)
def random_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Two to three seeded blocks a file with half an hour between them; draws are Spark's hashes, a test holds their spacing."""
    c = cues(spark, d)
    first = c.groupBy("file_id").agg(F.min("start").alias("t0"))
    files = lengths(c).join(first, "file_id").select("file_id", (F.col("duration") - F.col("t0")).alias("duration"))
    return catalog.spaced_blocks(files, 2, 3, 5_400_000, 18_000_000, 1_800_000, 7)


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+/([a-z]{2})/', 1) AS l, length(html) AS n FROM pages), t AS (SELECT *, CASE l WHEN 'en' THEN 'eng' WHEN 'de' THEN 'ger' WHEN 'fr' THEN 'fre' WHEN 'es' THEN 'spa' ELSE 'und' END AS tag, CASE WHEN n % 3 = 0 THEN 'English commentary' WHEN n % 3 = 1 THEN 'English stereo' ELSE 'Original' END AS title FROM p)
SELECT page_id, CASE WHEN tag = 'eng' THEN 0 WHEN n % 3 = 1 THEN 1 END AS english, CASE WHEN tag = 'eng' OR n % 3 = 1 THEN 'en' WHEN tag <> 'und' THEN l END AS audio, CASE WHEN tag = 'und' THEN 'xx' WHEN l < 'xx' THEN l || ',xx' ELSE 'xx,' || l END AS embedded, round(n / 10, 1) AS seconds FROM t""")
def media_probes(spark: SparkSession, d: str) -> DataFrame:
    """Streams of a video for every page: its language's track, a second without a tag, subtitles in its language and another; read back from the prober's JSON."""
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/?#]+/([a-z]{2})/", 1).alias("l"), F.length("html").alias("n"))
    tag = F.when(F.col("l") == "en", "eng").when(F.col("l") == "de", "ger").when(F.col("l") == "fr", "fre").when(F.col("l") == "es", "spa").otherwise("und")
    title = F.when(F.col("n") % 3 == 0, "English commentary").when(F.col("n") % 3 == 1, "English stereo").otherwise("Original")
    stream = lambda k, kind, language, name=None: F.struct(F.lit(k).alias("index"), F.lit(kind).alias("codec_type"), F.struct(language.alias("language"), (F.lit(None).cast("string") if name is None else name).alias("title")).alias("tags"))
    none = F.lit(None).cast("string")
    every = F.array(stream(0, "video", none), stream(1, "audio", tag), stream(2, "audio", none, title), stream(3, "subtitle", F.upper(tag)), stream(4, "subtitle", F.lit("xx")), stream(5, "subtitle", F.lit("xx")))
    body = rows.select("page_id", F.to_json(F.struct(every.alias("streams"), F.struct((F.col("n") / 10).cast("string").alias("duration")).alias("format"))).alias("body"))
    audio, subtitles = probe.streams(F.col("body"), "audio"), probe.streams(F.col("body"), "subtitle")
    return body.select("page_id", probe.english_index(audio).cast("int").alias("english"), probe.audio_language(audio).alias("audio"), F.array_join(probe.embedded_languages(subtitles), ",").alias("embedded"), F.round(probe.duration(F.col("body")), 1).alias("seconds"))


@query("""WITH r AS (SELECT o_custkey AS model, o_orderpriority AS scenario, o_orderkey AS n, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'error' ELSE 'skipped' END AS status FROM orders)
SELECT model, scenario, n, status FROM r QUALIFY row_number() OVER (PARTITION BY model, scenario ORDER BY status <> 'skipped' DESC, CASE WHEN status = 'skipped' THEN n ELSE -n END) = 1""")
def resumed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs by customer and priority: the last completed one counts, a skipped one only while there is no other."""
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "P", "error").otherwise("skipped")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("model"), F.col("o_orderpriority").alias("scenario"), F.col("o_orderkey").alias("n"), status.alias("status"))
    return library.resumed(rows, ["model", "scenario"], "n", "status")
