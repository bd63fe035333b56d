"""Queries for evidence from full transcripts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dense, intervals
from ..params import Params
from ..stored import once
from .analogues import CUES, cues, table
from .intervals import _GAPS, _WINDOWS, HOUR, _windows
from .words import _CONV, _conversation

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(f"""WITH {_CONV}, n AS (SELECT s.f, s.idx // 4 AS clip, s.idx AS si, c.idx AS ci, len(list_intersect(s.w, c.w)) AS shared, len(list_intersect(s.w, c.w)) / len(c.w) AS share
FROM cv s JOIN cv c ON s.f = c.f AND c.idx BETWEEN s.idx // 4 * 4 - 2 AND s.idx // 4 * 4 + 6 AND s.role = 'assistant' AND c.role = 'user' WHERE len(c.w) > 0),
g AS (SELECT * FROM n WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY f, clip, si ORDER BY share DESC, ci) = 1), b AS (SELECT * FROM g WHERE share >= 0.1 AND shared >= 2)
SELECT f AS file_id, CAST(clip AS BIGINT) AS clip, si AS s_idx, ci AS c_idx, CAST(shared AS INTEGER) AS shared, share FROM b QUALIFY row_number() OVER (PARTITION BY f, clip, ci ORDER BY si) = 1""")
def dense_anchors(spark: SparkSession, d: str) -> DataFrame:
    rows = _conversation(spark, d).withColumn("t", F.col("idx"))
    out = dense.dense_anchors(rows.where("role = 'assistant'"), rows.where("role = 'user'"), 4, 2, 2, Params(anchor_overlap=0.1))
    return out.select("file_id", "clip", "s_idx", "c_idx", "shared", "share")


@query(None)
def swap_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every turn shown as two lines, in odd conversations the later half first, and heard as it stands; ratios of matching blocks are beyond SQL."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("idx"), (F.col("turn") * 30).alias("t"), "text")
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    half = F.ceil(F.size("words") / 2).cast("int")
    early, late = F.array_join(F.slice("words", F.lit(1), half), " "), F.array_join(F.slice("words", half + 1, F.size("words") - half), " ")
    shown = F.when(F.col("file_id") % 2 == 1, F.concat_ws("\n", late, early)).otherwise(F.concat_ws("\n", early, late))
    return dense.swap_evidence(dense.swap_verdicts(once(once(turns, words=words), text=shown).drop("words"), turns))


@query(f"""WITH {_CONV}, l AS (SELECT f, idx, w, lead(w) OVER (PARTITION BY f ORDER BY idx) AS x FROM cv)
SELECT f AS file_id, idx, EXISTS (SELECT 1 FROM cv s WHERE s.f = l.f AND s.role = 'assistant' AND s.idx < l.idx + 3 AND s.idx + 3 > l.idx AND len(list_intersect(s.w, l.w)) > 0 AND len(list_intersect(s.w, l.x)) > 0) AS bridge FROM l WHERE x IS NOT NULL""")
def bridged_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _conversation(spark, d).select("file_id", "idx", "role", F.col("idx").alias("start"), (F.col("idx") + 3).alias("end"), "toks")
    pairs = rows.withColumn("second", F.lead("toks").over(Window.partitionBy("file_id").orderBy("idx"))).where("second is not null").withColumnRenamed("toks", "first")
    return dense.bridged(pairs, rows.where("role = 'assistant'"), 4)


@query(f"""WITH {CUES}, {_WINDOWS} SELECT w.f AS file_id, lo, hi, coalesce(string_agg(coalesce(c.t, ''), chr(10) ORDER BY c.s, c.idx) FILTER (WHERE c.idx IS NOT NULL), '') AS text
FROM w LEFT JOIN (SELECT * FROM cues WHERE t IN ('view', 'click')) c ON c.f = w.f AND c.s BETWEEN lo AND hi GROUP BY 1, 2, 3""")
def window_texts(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d)
    return dense.window_texts(_windows(c), c.where("text in ('view', 'click')"), 24 * HOUR)


@query(f"""WITH {CUES}, {_WINDOWS}, a AS (SELECT DISTINCT f, lo, hi, unnest(range(lo, hi + 1, {HOUR})) AS clip_at FROM w),
u AS (SELECT * FROM a WHERE EXISTS (SELECT 1 FROM cues c WHERE c.f = a.f AND c.t <> 'view' AND c.s < clip_at + {2 * HOUR} AND c.e > clip_at)),
k AS (SELECT u.f, lo, hi, clip_at, CAST(sum(least(e, clip_at + {2 * HOUR}) - greatest(s, clip_at)) AS BIGINT) AS covered FROM u JOIN cues c ON c.f = u.f AND c.t = 'view' AND c.e > clip_at AND c.s < clip_at + {2 * HOUR} GROUP BY 1, 2, 3, 4)
SELECT f AS file_id, lo, hi, clip_at, covered FROM k WHERE covered >= {HOUR // 5} QUALIFY row_number() OVER (PARTITION BY f, lo, hi ORDER BY covered DESC, clip_at) = 1""")
def scan_regions(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d)
    return dense.scan_regions(_windows(c), c.where("text <> 'view'"), c.where("text = 'view'"), 2 * HOUR, HOUR, HOUR // 5, 6 * HOUR)


@query(f"""WITH {_GAPS} SELECT f AS file_id, g0, s AS g1, s - g0 <= {24 * HOUR} AND EXISTS (SELECT 1 FROM cues c WHERE c.f = m.f AND c.e = m.g0 AND c.t = 'view') AS declared FROM m WHERE s - g0 >= {HOUR}""")
def declared_music(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d)
    told = F.when(F.col("text") == "view", "[song plays]").otherwise(F.col("text"))
    return dense.declared_music(intervals.gaps(c, HOUR), c.withColumn("told", told), text.declares_music(F.col("told")), 24 * HOUR)
