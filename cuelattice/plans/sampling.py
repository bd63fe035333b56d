"""Queries from what is known of a file to its verdict: timelines, clips, evidence, summaries. Conversations are files, as :mod:`transcripts` reads them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, transcript
from ..operators import intervals, runs, sampling, verdict
from ..params import DEFAULTS
from ..stored import stored
from .analogues import table
from .transcripts import MODELS, heard, verified
from .words import _toks

QUERIES: dict = {}

CLIP, REACH, WIDTH, LEAST = 10_000, 30_000, 20_000, 2_000
NUDGES = (0, 5_000, -5_000, 10_000, -10_000)
#: Clips taken for ten minutes, and how far apart the clips lie that an earlier run left.
PER_TEN_MINUTES, KEPT_EVERY = 30, 30_000


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _spans(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv").alias("file_id"), F.col("k").alias("idx"), "start", "end", "text")


def _files(lines: DataFrame) -> DataFrame:
    """``(file_id, duration, n)``: five seconds more than the last line, and the number of regular clips."""
    length = lines.groupBy(F.col("conv").alias("file_id")).agg((F.max("end") + 5_000).alias("duration"))
    return length.select("file_id", "duration", transcript.sample_count(F.col("duration") / 1000, F.lit(PER_TEN_MINUTES), F.lit(None)).alias("n"))


def _kept_clips(files: DataFrame) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration") - 1, F.lit(KEPT_EVERY).cast("long")))
    return files.select("file_id", at.alias("start")).select("file_id", "start", (F.col("start") + CLIP).alias("end"))


def _states(spark: SparkSession, d: str, lines: DataFrame, files: DataFrame) -> DataFrame:
    """Files with a system turn have a full transcript, others of six turns or more a speech map, the rest clips only."""
    kinds = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("file_id")).agg(F.max(F.col("role") == "system").alias("system"), F.count("*").alias("turns"))
    spoken = {m: _spans(heard(lines, {m: MODELS[m]})).select("file_id", "start", "end") for m in ("base", "tiny")}
    full = spoken["base"].join(kinds.where("system"), "file_id", "left_semi").withColumn("rank", F.lit(1))
    mapped = spoken["tiny"].join(kinds.where("turns >= 6"), "file_id", "left_semi").withColumn("rank", F.lit(2))
    clips = _kept_clips(files)
    cut = sampling._overlap(clips.select("file_id", F.col("start").alias("lo"), F.col("end").alias("hi")), spoken["base"], WIDTH)
    said = cut.select("file_id", F.greatest("lo", "start").alias("start"), F.least("hi", "end").alias("end"))
    return sampling.timeline(files, full.unionByName(mapped), clips, said)


def _model(name: str) -> str:
    return f"""(SELECT conv AS f, k, s0 + s0 // 500 + 120 AS s, e0 + e0 // 500 + 120 AS e, array_to_string(w, ' ') AS text FROM (SELECT conv, k, s0, s0 + len AS e0, list_filter(string_split(text, ' '), lambda w, i: w <> '' AND CAST(concat('0x', substr(md5(concat_ws('|', '{name}', conv, k, i - 1)), 1, 2)) AS INTEGER) >= {MODELS[name]}) AS w FROM v) WHERE len(w) > 0)"""


_FILES = rf"""sp AS (SELECT conv_id AS conv, turn, generate_subscripts(p, 1) AS j, trim(unnest(p)) AS text FROM (SELECT conv_id, turn, string_split_regex(text, '[.!?\n]+') AS p FROM conversations)),
v AS (SELECT conv, turn, row_number() OVER w AS k, CAST(coalesce(sum(length(text) * 60 + 500) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s0, length(text) * 60 AS len, text FROM sp WHERE text <> '' WINDOW w AS (PARTITION BY conv ORDER BY turn, j)),
fl AS (SELECT conv AS f, max(s0 + len) + 5000 AS duration, CAST(greatest(3, ceil((max(s0 + len) + 5000) / 1000 / 600 * {PER_TEN_MINUTES})) AS BIGINT) AS n FROM v GROUP BY conv),
hb AS {_model("base")}, ht AS {_model("tiny")}"""
_TL = f"""kd AS (SELECT conv_id AS f, bool_or(role = 'system') AS sys, count(*) AS n FROM conversations GROUP BY conv_id),
wh AS (SELECT f, 1 AS r, s, e FROM hb WHERE f IN (SELECT f FROM kd WHERE sys) UNION ALL SELECT f, 2, s, e FROM ht WHERE f IN (SELECT f FROM kd WHERE n >= 6)), mr AS (SELECT f, min(r) AS r FROM wh GROUP BY f),
kc AS (SELECT f, unnest(range(0, duration, {KEPT_EVERY})) AS s FROM fl),
xs AS (SELECT wh.f, s, e, 1 AS h, 0 AS m FROM wh JOIN mr ON mr.f = wh.f AND mr.r = wh.r UNION ALL SELECT fl.f, 0, duration, 0, 1 FROM fl JOIN mr ON mr.f = fl.f
  UNION ALL SELECT f, s, s + {CLIP}, 0, 1 FROM kc WHERE f NOT IN (SELECT f FROM mr) UNION ALL SELECT kc.f, greatest(kc.s, hb.s), least(kc.s + {CLIP}, hb.e), 1, 1 FROM kc JOIN hb ON hb.f = kc.f AND hb.s < kc.s + {CLIP} AND hb.e > kc.s WHERE kc.f NOT IN (SELECT f FROM mr)),
xc AS (SELECT xs.f, greatest(s, 0) AS s, least(e, duration) AS e, h, m FROM xs JOIN fl ON fl.f = xs.f), xp AS (SELECT f, unnest([s, e]) AS t FROM xc WHERE e > s UNION SELECT f, unnest([0, duration]) FROM fl),
xi AS (SELECT f, t AS s, lead(t) OVER (PARTITION BY f ORDER BY t) AS e FROM xp),
xt AS (SELECT i.f, i.s, i.e, CASE WHEN max(c.h) = 1 THEN 'heard' WHEN max(c.m) = 1 THEN 'silent' ELSE 'unmeasured' END AS state FROM xi i LEFT JOIN xc c ON c.f = i.f AND c.s < i.e AND c.e > i.s WHERE i.e IS NOT NULL GROUP BY i.f, i.s, i.e),
xn AS (SELECT *, sum(CASE WHEN state = pr THEN 0 ELSE 1 END) OVER (PARTITION BY f ORDER BY s) AS g FROM (SELECT *, lag(state) OVER (PARTITION BY f ORDER BY s) AS pr FROM xt)),
tl AS (SELECT f, min(s) AS s, max(e) AS e, state FROM xn GROUP BY f, g, state)"""


@query(f"""WITH {_FILES}, {_TL} SELECT f AS file_id, s AS start, e AS "end", state FROM tl""")
def timeline_states(spark: SparkSession, d: str) -> DataFrame:
    lines = verified(spark, d)
    return _states(spark, d, lines, _files(lines))


@query(f"""WITH {_FILES}, {_TL}, w AS (SELECT f, s, e FROM (SELECT f, unnest(range(0, duration, 400)) AS s FROM fl), LATERAL (SELECT s + 400 AS e)),
x AS (SELECT w.f, w.s, w.e, sum(CASE WHEN state = 'silent' THEN least(w.e, tl.e) - greatest(w.s, tl.s) ELSE 0 END) AS sl FROM w JOIN tl ON tl.f = w.f AND tl.s < w.e AND tl.e > w.s GROUP BY 1, 2, 3)
SELECT f AS file_id, s AS lo, e AS hi FROM x WHERE sl = e - s""")
def silent_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of 0.4 seconds that were listened to and are silent; in files known by clips none lies outside a clip."""
    lines = verified(spark, d)
    files = _files(lines)
    pieces = files.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration") - 1, F.lit(400).cast("long")))).select("file_id", "lo", (F.col("lo") + 400).alias("hi"))
    return sampling.silent_gaps(pieces, stored(_states(spark, d, lines, files)), WIDTH)


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """``(file_id, lo, hi)``: from a turn's first line to the end of its last."""
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("conv"), "turn", F.posexplode(F.split("text", "[.!?\n]+")).alias("j", "part")).where("trim(part) != ''")
    order = said.select("conv", "turn", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "j")).cast("long").alias("k"))
    return order.join(verified(spark, d), ["conv", "k"]).groupBy(F.col("conv").alias("file_id"), "turn").agg(F.min("start").alias("lo"), F.max("end").alias("hi")).select("file_id", "lo", "hi")


@query(f"""WITH {_FILES}, t AS (SELECT conv AS f, min(s0) AS lo, max(s0 + len) AS hi FROM v GROUP BY conv, turn), kc AS (SELECT f, unnest(range(0, duration, {KEPT_EVERY})) AS pt FROM fl)
SELECT t.f AS file_id, lo, hi, min(pt) // {KEPT_EVERY} AS slot, min(pt) AS "at" FROM t LEFT JOIN kc ON kc.f = t.f AND pt >= lo AND pt < hi GROUP BY 1, 2, 3""")
def cached_between(spark: SparkSession, d: str) -> DataFrame:
    """For each turn the first clip of an earlier run that starts in it."""
    return sampling.first_within(_turns(spark, d), _cached(_files(verified(spark, d))), WIDTH)


def _cached(files: DataFrame) -> DataFrame:
    return _kept_clips(files).select("file_id", F.floor(F.col("start") / KEPT_EVERY).cast("long").alias("slot"), F.col("start").alias("at"))


def _shown(lines: DataFrame) -> DataFrame:
    """``(file_id, idx, start, end, text, planted)``: two verified lines a cue; in one of eight cues they are shown in the other order."""
    pair = lines.withColumn("i", F.floor((F.col("k") - 1) / 2).cast("long")).groupBy("conv", "i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("l"))
    other = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("swap"), "conv", "i")), 1, 2), 16, 10).cast("int") < 32
    return pair.select(F.col("conv").alias("file_id"), F.col("i").alias("idx"), "start", "end", F.array_join(F.when(other, F.reverse("l")).otherwise(F.col("l")), "\n").alias("text"), other.alias("planted"))


def _said(lines: DataFrame) -> DataFrame:
    """What the ``base`` model hears, cut in the middle of lines: a segment is the later half of one line and the earlier half of the next."""
    words = F.split("text", " ")
    half = F.ceil(F.size(words) / 2).cast("int")
    middle = F.floor((F.col("start") + F.col("end")) / 2).cast("long")
    parts = F.array(F.struct(F.col("k").alias("g"), "start", middle.alias("end"), F.slice(words, F.lit(1), half).alias("w")), F.struct((F.col("k") + 1).alias("g"), middle.alias("start"), "end", F.filter(words, lambda w, i: i >= half).alias("w")))
    pieces = heard(lines, {"base": MODELS["base"]}).select("conv", F.explode(parts).alias("p")).select("conv", "p.*")
    whole = pieces.groupBy("conv", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "w"))), lambda x: x["w"])).alias("w"))
    return whole.select(F.col("conv").alias("file_id"), F.col("g").alias("idx"), "start", "end", F.array_join("w", " ").alias("text"))


_SHOWN = """sh AS (SELECT conv AS f, (k - 1) // 2 AS i, min(s0) AS s, max(s0 + len) AS e, list(text ORDER BY k) AS l FROM v GROUP BY conv, (k - 1) // 2),
c AS (SELECT f, i, s, e, array_to_string(CASE WHEN CAST(concat('0x', substr(md5(concat_ws('|', 'swap', f, i)), 1, 2)) AS INTEGER) < 32 THEN list_reverse(l) ELSE l END, chr(10)) AS text, len(l) AS nl FROM sh)"""


def _clusters(cues: DataFrame) -> DataFrame:
    """Neighbouring cues whose lines look swapped, with two seconds around them."""
    pair = text.two_lines(F.col("text"))
    seen = cues.withColumn("_p", pair).where("_p is not null").where(text.cap_signal(F.get("_p", F.lit(0)), F.get("_p", F.lit(1))))
    windows = seen.select("file_id", F.greatest(F.col("start") - 2_000, F.lit(0)).alias("lo"), (F.col("end") + 2_000).alias("hi"))
    return runs.cluster_windows(windows, 20_000.0, float("inf")).select("file_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


def _slots(spark: SparkSession, d: str, lines: DataFrame, files: DataFrame, cues: DataFrame) -> DataFrame:
    states = stored(_states(spark, d, lines, files))
    return sampling.sample_slots(files, cues, stored(_clusters(cues)), states, stored(_turns(spark, d)), CLIP, NUDGES, LEAST, WIDTH)


_DENSEST = """(SELECT min_by(w.s, {{'h': -w.held, 'i': w.i}}) FROM w WHERE w.f = {r}.f AND w.s BETWEEN {r}.lo AND {r}.hi)"""


def _placed(regions: str, extra: str = "") -> str:
    """SQL of ``regions`` (f, lo, hi, ...) with base and at."""
    nudged = ", ".join(map(str, NUDGES))
    return f"""(SELECT r.*, CASE WHEN b.h >= {LEAST} THEN b.pt WHEN op.f IS NULL THEN NULL ELSE r.base END AS pt FROM (SELECT *, coalesce({_DENSEST.format(r="q")}, (lo + hi) // 2) AS base FROM {regions} q) r LEFT JOIN (SELECT DISTINCT f FROM tl WHERE state = 'unmeasured') op ON op.f = r.f
LEFT JOIN (SELECT f, lo, hi, base, arg_min(pt, {{'h': -h, 'k': k}}) AS pt, max(h) AS h FROM (SELECT x.f, lo, hi, base, k, pt, (SELECT coalesce(sum(least(tl.e, x.pt + {CLIP}) - greatest(tl.s, x.pt)), 0) FROM tl WHERE tl.f = x.f AND state = 'heard' AND tl.s < x.pt + {CLIP} AND tl.e > x.pt) AS h
  FROM (SELECT DISTINCT f, lo, hi, base, k, greatest(lo, least(base + [{nudged}][k], hi)) AS pt FROM (SELECT f, lo, hi, coalesce({_DENSEST.format(r="z")}, (lo + hi) // 2) AS base, unnest(range(1, {len(NUDGES) + 1})) AS k FROM {regions} z)) x
  WHERE EXISTS (SELECT 1 FROM c WHERE c.f = x.f AND c.s < x.pt + {CLIP} AND c.e > x.pt)) GROUP BY 1, 2, 3, 4) b ON b.f = r.f AND b.lo = r.lo AND b.hi = r.hi AND b.base = r.base)"""


_SLOTS = f"""w AS (SELECT f, i, s, sum(length(text)) OVER (PARTITION BY f ORDER BY s RANGE BETWEEN CURRENT ROW AND {CLIP - 1} FOLLOWING) AS held FROM c),
rg AS (SELECT f, k AS slot, duration * k // n AS lo, duration * (k + 1) // n AS hi FROM (SELECT f, duration, n, unnest(range(n)) AS k FROM fl)), fi AS {_placed("rg")},
cw AS (SELECT f, greatest(s - 2000, 0) AS lo, e + 2000 AS hi FROM (SELECT f, s, e, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM c) WHERE len(p) = 2 AND regexp_matches(p[1], '^[^\\p{{L}}]*\\p{{Ll}}') AND regexp_matches(p[2], '^[^\\p{{L}}]*\\p{{Lu}}') AND NOT regexp_matches(p[1], '[.!?][^A-Za-z0-9_]*$')),
cg AS (SELECT *, sum(CASE WHEN b IS NULL OR lo - b > 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY f ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(hi) OVER (PARTITION BY f ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM cw)),
cl AS (SELECT f, min(lo) AS lo, max(hi) AS hi FROM cg GROUP BY f, g),
ch AS (SELECT f, 'filler' AS kind, slot, lo, hi, pt, pt + {CLIP} AS until FROM fi UNION ALL SELECT rg.f, 'heuristic', slot, rg.lo, rg.hi, cl.lo, cl.hi FROM rg JOIN cl ON cl.f = rg.f AND cl.lo >= rg.lo AND cl.lo < rg.hi QUALIFY row_number() OVER (PARTITION BY rg.f, slot ORDER BY cl.lo, cl.hi) = 1),
tn AS (SELECT DISTINCT conv AS f, min(s0) AS lo, max(s0 + len) AS hi FROM v GROUP BY conv, turn), tb AS (SELECT * FROM tn WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.f = tn.f AND ch.pt >= tn.lo AND ch.pt < tn.hi)),
th AS (SELECT f, lo AS t0, hi AS t1, 0 AS half, lo, (lo + hi) // 2 AS hi FROM tb UNION ALL SELECT f, lo, hi, 1, (lo + hi) // 2, hi FROM tb), te AS {_placed("th")},
tk AS (SELECT *, max(CASE WHEN half = 0 THEN pt END) OVER (PARTITION BY f, t0, t1) AS a1 FROM te),
sl AS (SELECT * FROM ch UNION ALL SELECT f, 'extra', 100000 + CAST(round_even(pt / 1000, 0) AS BIGINT), t0, t1, pt, pt + {CLIP} FROM tk WHERE pt IS NOT NULL AND (half = 0 OR a1 IS NULL OR abs(pt - a1) >= {CLIP}))"""


@query(f"""WITH {_FILES}, {_TL}, {_SHOWN}, {_SLOTS} SELECT f AS file_id, kind, slot, lo, hi, pt AS "at", until FROM sl""")
def sample_slots(spark: SparkSession, d: str) -> DataFrame:
    lines = stored(verified(spark, d))
    return _slots(spark, d, lines, stored(_files(lines)), stored(_shown(lines)))


_SHARE = """list_filter(list_distinct(flatten(list(w))), lambda x: x IS NOT NULL)"""


@query(f"""WITH {_FILES}, {_TL}, {_SHOWN}, g AS (SELECT f, unnest(range(0, duration, greatest({CLIP}, CAST(ceil(duration / 12) AS BIGINT)))) AS pt FROM fl),
s AS (SELECT f, s AS t, {_toks("text")} AS w FROM hb), u AS (SELECT f, s AS t, {_toks("text")} AS w FROM c),
a AS (SELECT g.f, g.pt, {_SHARE} AS w FROM g JOIN s ON s.f = g.f AND t >= pt AND t < pt + {CLIP} GROUP BY g.f, g.pt), b AS (SELECT g.f, g.pt, {_SHARE} AS w FROM g JOIN u ON u.f = g.f AND t BETWEEN pt - {REACH} AND pt + {CLIP + REACH} GROUP BY g.f, g.pt),
r AS (SELECT a.f, round(len(list_intersect(a.w, coalesce(b.w, CAST([] AS VARCHAR[])))) / len(a.w), 3) AS score FROM a LEFT JOIN b ON b.f = a.f AND b.pt = a.pt WHERE len(a.w) > 0)
SELECT fl.f AS file_id, count(score) AS samples, round(avg(score), 6) AS avg_score, CASE WHEN count(score) = 0 THEN 'unknown' WHEN 2 * count(*) FILTER (score >= 0.6) >= count(score) THEN 'ok' ELSE 'SUSPECT' END AS flag FROM fl LEFT JOIN r ON r.f = fl.f GROUP BY fl.f""")
def grid_votes(spark: SparkSession, d: str) -> DataFrame:
    """Every file against its whole transcript on a grid of at most twelve windows, thinned evenly where the file is longer."""
    lines = stored(verified(spark, d))
    files = _files(lines)
    windows = sampling.grid(files, CLIP, sampling.thinned(F.col("duration"), CLIP, 12))
    told = sampling.clip_evidence(windows, _spans(heard(lines, {"base": MODELS["base"]})), _shown(lines), REACH, WIDTH)
    none = told.select("file_id", F.lit(0).cast("long").alias("idx"), F.lit(False).alias("tested"), F.lit(False).alias("suspicious"), F.lit(False).alias("swapped")).limit(0)
    return sampling.summary(files, told, none, 0.6, 3, 0.3).select("file_id", "samples", "avg_score", "flag")


@query(None)
def sampled_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Sampled check from slots to verdict: clips of earlier runs reused, lines judged where a heuristic clip holds them. Ratios of matching blocks are beyond SQL, a test does it by hand."""
    lines = stored(verified(spark, d))
    files, cues, said = stored(_files(lines)), stored(_shown(lines)), stored(_said(lines))
    clips = stored(sampling.with_cache(_slots(spark, d, lines, files, cues), _cached(files), CLIP, WIDTH))
    samples = clips.join(sampling.clip_evidence(clips, said, cues, REACH, WIDTH), ["file_id", "at", "until"], "left")
    orders = sampling.judged_order(cues, said, WIDTH)
    inside = sampling._meet(clips.where("kind = 'heuristic'").select("file_id", F.col("at").alias("lo"), F.col("until").alias("hi")), cues.select("file_id", "idx", F.col("start").alias("at")), WIDTH)
    tested = orders.where("suspicious").join(inside.select("file_id", "idx", F.lit(True).alias("t")).distinct(), ["file_id", "idx"], "left")
    tested = tested.select("file_id", "idx", F.coalesce("t", F.lit(False)).alias("tested"), "suspicious", F.when(F.col("t"), F.col("swapped")).alias("swapped"))
    origin = clips.groupBy("file_id").agg(*[F.count_if(F.col("origin") == o).alias(o) for o in ("cached", "fresh", "silent")])
    return sampling.summary(files, samples, tested, 0.6, 2, 0.3).join(origin, "file_id")


@query(None)
def full_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Full check: every two-line cue judged, five times the regions scored, anchors each minute elsewhere. Ratios of matching blocks are beyond SQL, a test does it by hand."""
    lines = stored(verified(spark, d))
    files, cues, said = stored(_files(lines)), stored(_shown(lines)), stored(_said(lines))
    windows = sampling.full_windows(files, cues, CLIP, WIDTH)
    samples = stored(sampling.clip_evidence(windows, said, cues, REACH, WIDTH).where("said > 0"))
    more = sampling.uncovered(sampling.grid(files, CLIP, 60_000), samples, 30_000, WIDTH)
    anchored = sampling.clip_evidence(more, said, cues, REACH, WIDTH, score=False).where("shift is not null")
    orders = sampling.judged_order(cues, said, WIDTH).withColumn("tested", F.lit(True))
    shifts = samples.unionByName(anchored).groupBy("file_id").agg(F.count("shift").alias("shifts"), F.round(F.median("shift"), 3).alias("shift"))
    return sampling.summary(files, samples, orders, 0.6, 3, 0.3).join(shifts, "file_id", "left")


@query(f"""WITH {_FILES}, q AS (SELECT conv AS f, k AS i, s0 AS s, s0 + len AS e FROM v WHERE turn % 2 = 1), m AS (SELECT f, s, max(e) OVER (PARTITION BY f ORDER BY s, e, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g0 FROM q),
g AS (SELECT f, g0, s AS g1 FROM m WHERE s - g0 >= 8000), t AS (SELECT f, g0, g1, lo, least(lo + {CLIP}, g1) AS hi FROM (SELECT f, g0, g1, unnest(range(g0, g1, {CLIP})) AS lo FROM g)),
p AS (SELECT t.f, g0, lo, hi - lo AS cost, coalesce(sum(CASE WHEN hb.s IS NOT NULL THEN least(hb.e, hi) - greatest(hb.s, lo) END), 0) AS speech, coalesce(sum(CASE WHEN hb.s >= lo AND hb.s < hi THEN len(string_split(hb.text, ' ')) END), 0) AS words FROM t LEFT JOIN hb ON hb.f = t.f AND hb.s < hi AND hb.e > lo GROUP BY 1, 2, 3, 4),
c AS (SELECT f, g0, lo, cost, sum(speech) OVER w AS speech, sum(words) OVER w AS words FROM p WINDOW w AS (PARTITION BY f, g0 ORDER BY lo)), h AS (SELECT *, min(CASE WHEN speech >= 9000 AND words >= 20 THEN lo END) OVER (PARTITION BY f, g0) AS stop FROM c)
SELECT f AS file_id, g0 AS gap, CAST(sum(cost) AS BIGINT) AS cost, count(*) AS probes, max(stop) IS NOT NULL AS hit, CAST(max(speech) AS BIGINT) AS speech, CAST(max(words) AS BIGINT) AS words FROM h WHERE stop IS NULL OR lo <= stop GROUP BY f, g0""")
def missing_middle(spark: SparkSession, d: str) -> DataFrame:
    """Subtitles of every second turn only: what was said in the gaps, probed in clips up to the one that decides."""
    lines = stored(verified(spark, d))
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("conv"), "turn", F.posexplode(F.split("text", "[.!?\n]+")).alias("j", "part")).where("trim(part) != ''")
    odd = turns.select("conv", "turn", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "j")).cast("long").alias("k")).where("turn % 2 = 1")
    cues = _spans(lines.join(odd.select("conv", "k"), ["conv", "k"]))
    tiles = intervals.tiles(intervals.gaps(cues, 8_000), CLIP)
    gaps = intervals.gaps(cues, 8_000).select("file_id", F.col("g0").alias("gap"), F.col("g1").alias("gap_end"))
    asked = sampling._meet(gaps.select("file_id", F.col("gap").alias("lo"), F.col("gap_end").alias("hi"), "gap"), tiles.select("file_id", F.col("lo").alias("at"), F.col("hi").alias("until")), WIDTH).select("file_id", "gap", F.col("at").alias("lo"), F.col("until").alias("hi"))
    said = _spans(heard(lines, {"base": MODELS["base"]})).withColumn("n", F.size(F.split("text", " ")))
    part = F.least("end", "hi") - F.greatest("start", "lo")
    sums = sampling._overlap(asked, said, WIDTH).groupBy("file_id", "gap", "lo").agg(F.sum(part).alias("speech"), F.sum(F.when((F.col("start") >= F.col("lo")) & (F.col("start") < F.col("hi")), F.col("n"))).alias("words"))
    probes = asked.join(sums, ["file_id", "gap", "lo"], "left").select("file_id", "gap", F.col("lo").alias("k"), (F.col("hi") - F.col("lo")).alias("cost"), F.coalesce("speech", F.lit(0)).alias("speech"), F.coalesce("words", F.lit(0)).alias("words"))
    return sampling.stopped_probes(probes, 9_000, 20)


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """``(file_id, screen, disagree, drift, jitter, swapped, checked, late, gap, flag, samples)`` of every file: what its clips say of timing, its lines of order, its gaps of missing lines."""
    lines = stored(verified(spark, d))
    files, cues, said = stored(_files(lines)), stored(_shown(lines)), stored(_said(lines))
    windows = sampling.full_windows(files, cues, CLIP, WIDTH)
    samples = stored(sampling.clip_evidence(windows, said, cues, REACH, WIDTH, _LOOSE).where("said > 0"))
    shifts = samples.where("shift is not null").select("file_id", "at", "shift", "mad")
    orders = sampling.judged_order(cues, said, WIDTH).withColumn("tested", F.lit(True))
    told = sampling.summary(files, samples, orders, 0.6, 3, 0.3).select("file_id", "samples", "flag", F.col("confirmed").alias("swapped"), "checked")
    tilt = shifts.groupBy("file_id").agg((F.regr_slope("shift", "at") * F.max("at")).alias("tilt"), F.count("*").alias("k"), F.median("mad").alias("jitter"), (F.max("shift") - F.min("shift")).alias("spread")).where("k >= 3")
    screened = verdict.screen(shifts, tilt, replace(DEFAULTS, flat=0.4)).select("file_id", F.col("state").alias("screen"))
    length = said.groupBy("file_id").agg(F.max("end").alias("duration"))
    late = verdict.overrun(cues, length, 1_000).select("file_id", F.lit(True).alias("late"))
    gap = missing_middle(spark, d).groupBy("file_id").agg(F.max("hit").alias("gap"))
    every = files.select("file_id").join(told, "file_id", "left").join(screened, "file_id", "left").join(tilt, "file_id", "left").join(late, "file_id", "left").join(gap, "file_id", "left")
    drift = F.abs("tilt") >= 0.4
    return every.select("file_id", "screen", (F.col("spread") >= 1.0).alias("disagree"), drift.alias("drift"), "jitter", "swapped", "checked", F.coalesce("late", F.lit(False)).alias("late"), F.coalesce("gap", F.lit(False)).alias("gap"), "flag", "samples")


#: Anchors of one clip: two are enough where a clip holds a few lines only.
_LOOSE = replace(DEFAULTS, anchor_min=2)


@query(None)
def file_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """From clips to the verdict in one query: evidence of every file, the rung that asks for more of it, and flag and reason. Its parts have SQL or plain versions; a test puts them together."""
    e = stored(_evidence(spark, d))
    c = F.col
    rung = verdict.needs_full(c("jitter"), c("drift"), c("swapped"), F.lit(False), c("late"), c("disagree"))
    gate = (c("checked") >= DEFAULTS.swap_checked) & (c("swapped") >= DEFAULTS.swap_min) & (c("swapped") / F.greatest(c("checked"), F.lit(1)) >= DEFAULTS.swap_rate)
    hits = {"swaps": gate, "wrong": c("flag") == "SUSPECT", "anchors_bad": (c("screen") == "needs_sync") & c("disagree"), "content_ok": c("flag") == "ok", "runs": c("drift"), "jitter": c("jitter") >= 0.4, "gap": c("gap"), "overrun": c("late")}
    out = verdict.final_verdict(hits)
    return e.select("*", rung.alias("rung"), out.alias("v")).select("file_id", "screen", "rung", "v.flag", "v.reason", "samples", "swapped", "checked", "late", "gap")
