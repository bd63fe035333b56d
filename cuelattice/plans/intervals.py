"""Interval and sequence queries over the events table, in whole milliseconds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, retime, runs, verdict
from .analogues import CUES, cues, lengths

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


HOUR = 3_600_000
_GAPS = f"{CUES}, m AS (SELECT *, max(e) OVER (PARTITION BY f ORDER BY s, e, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g0 FROM cues)"
_UNION = f"""{CUES}, m AS (SELECT f, s, e, max(e) OVER (PARTITION BY f ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM cues),
i AS (SELECT f, s, e, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY f ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m), u AS (SELECT f, min(s) AS s, max(e) AS e FROM i GROUP BY f, k)"""
_LEN = "len AS (SELECT f, max(e) + 600000 AS d FROM cues GROUP BY f)"


@query(f'WITH {_GAPS} SELECT f AS file_id, g0, s AS g1 FROM m WHERE s - g0 >= {HOUR}')
def cue_gaps(spark: SparkSession, d: str) -> DataFrame:
    return intervals.gaps(cues(spark, d), HOUR)


@query(f"""WITH {_GAPS}, {_LEN}, x AS (SELECT f, g0, s AS g1 FROM m WHERE s - g0 >= {HOUR} UNION ALL SELECT f, 0, min(s) FROM cues GROUP BY f UNION ALL SELECT f, max(e), max(e) + 600000 FROM cues GROUP BY f),
c AS (SELECT x.f, greatest(g0, least(120000.0, d * 0.1)) AS g0, least(g1, d - least(120000.0, d * 0.1)) AS g1 FROM x JOIN len ON x.f = len.f) SELECT f AS file_id, CAST(g0 AS DOUBLE) AS g0, CAST(g1 AS DOUBLE) AS g1 FROM c WHERE g1 - g0 >= {HOUR}""")
def all_gaps(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d)
    return intervals.all_gaps(c, lengths(c), HOUR, 120_000.0, 0.1).select("file_id", F.col("g0").cast("double"), F.col("g1").cast("double"))


@query(f'WITH {_UNION} SELECT f AS file_id, s AS start, e AS "end" FROM u')
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return intervals.union(cues(spark, d))


@query(f"""WITH {_UNION}, {_LEN}, r AS (SELECT u.f, e AS a, coalesce(lead(s) OVER (PARTITION BY u.f ORDER BY s), d) AS b FROM u JOIN len ON u.f = len.f UNION ALL SELECT f, 0, min(s) FROM u GROUP BY f)
SELECT f AS file_id, a + 200 AS start, b - 200 AS "end" FROM r WHERE b - a - 400 >= 300""")
def speech_complement(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d)
    return intervals.complement(c, lengths(c), 200, 300)


_WINDOWS = f"w AS (SELECT DISTINCT f, s // {24 * HOUR} * {24 * HOUR} AS lo, s // {24 * HOUR} * {24 * HOUR} + {24 * HOUR} AS hi FROM cues WHERE t <> 'view')"


def _windows(c: DataFrame) -> DataFrame:
    lo = (F.floor(F.col("start") / (24 * HOUR)) * (24 * HOUR)).cast("long")
    return c.where("text <> 'view'").select("file_id", lo.alias("lo"), (lo + 24 * HOUR).alias("hi")).distinct()


_COVER = f"""WITH {CUES}, {_WINDOWS} SELECT w.f AS file_id, lo, hi, CAST(coalesce(sum(CASE WHEN s IS NOT NULL THEN least(e, hi) - greatest(s, lo) END), 0) AS BIGINT) AS covered FROM w LEFT JOIN (SELECT * FROM cues WHERE t = 'view') c ON c.f = w.f AND c.e > lo AND c.s < hi GROUP BY 1, 2, 3"""


@query(_COVER)
def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d)
    return intervals.coverage(_windows(c), c.where("text = 'view'"))


@query(_COVER)
def banded_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d)
    return intervals.banded_coverage(_windows(c), c.where("text = 'view'").select("file_id", "start", "end"), 6 * HOUR)


@query(f"""WITH {_GAPS.replace("FROM cues)", "FROM cues WHERE t IN ('click', 'purchase'))")}, g AS (SELECT f, g0, s AS g1 FROM m WHERE s - g0 >= {HOUR}),
sp AS (SELECT * FROM cues c WHERE t = 'view' AND NOT EXISTS (SELECT 1 FROM cues x WHERE x.t = 'error' AND x.f = c.f AND c.s < x.e + 45000 AND c.e > x.s - 8000))
SELECT g.f AS file_id, g0, g1, CAST(coalesce(sum(CASE WHEN sp.s IS NOT NULL THEN least(sp.e, g1) - greatest(sp.s, g0) END), 0) AS BIGINT) AS speech, CAST(coalesce(sum(CASE WHEN sp.s >= g0 AND sp.s < g1 THEN CAST(floor(v) AS BIGINT) END), 0) AS BIGINT) AS words FROM g LEFT JOIN sp ON sp.f = g.f AND sp.e > g0 AND sp.s < g1 GROUP BY 1, 2, 3""")
def gap_speech(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d)
    gap_rows = intervals.gaps(c.where("text in ('click', 'purchase')"), HOUR)
    spoken = c.where("text = 'view'").withColumn("words", F.floor("value").cast("long"))
    return intervals.gap_speech(gap_rows, spoken, c.where("text = 'error'"), 8_000, 45_000)


@query(f"""WITH {CUES}, h AS (SELECT f, s, idx, sum(CAST(round(v * 100) AS BIGINT)) OVER (PARTITION BY f ORDER BY s RANGE BETWEEN CURRENT ROW AND {24 * HOUR - 1} FOLLOWING) AS held FROM cues)
SELECT f AS file_id, s AS start, CAST(held AS BIGINT) AS held FROM h QUALIFY row_number() OVER (PARTITION BY f ORDER BY held DESC, s, idx) = 1""")
def dense_window(spark: SparkSession, d: str) -> DataFrame:
    return intervals.densest(cues(spark, d), 24 * HOUR, F.round(F.col("value") * 100).cast("long"))


@query(f"""WITH {CUES}, n AS (SELECT *, CASE WHEN lag(t) OVER w IS DISTINCT FROM t THEN 1 ELSE 0 END AS x FROM cues WINDOW w AS (PARTITION BY f ORDER BY s, idx)),
i AS (SELECT *, sum(x) OVER (PARTITION BY f ORDER BY s, idx ROWS UNBOUNDED PRECEDING) AS k FROM n), c AS (SELECT *, count(*) OVER (PARTITION BY f, k) AS z, row_number() OVER (PARTITION BY f, k ORDER BY s, idx) AS q FROM i)
SELECT f AS file_id, idx, t AS text FROM c WHERE z < 3 OR q = 1""")
def repetition_loops(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_loops(cues(spark, d), 3).select("file_id", "idx", "text")


@query(f"""WITH {CUES}, p AS (SELECT *, lead(s) OVER (PARTITION BY f ORDER BY s, idx) AS n FROM cues) SELECT f AS file_id, (e + n) / 2 AS cut, n - e AS pause FROM p WHERE n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY f ORDER BY n - e DESC, s, idx) = 1""")
def cut_point(spark: SparkSession, d: str) -> DataFrame:
    return intervals.cut_point(cues(spark, d))


@query(f"""WITH {_GAPS}, g AS (SELECT f, g0, s AS g1 FROM m WHERE s - g0 >= {24 * HOUR}), x AS (SELECT f, g1, unnest(range(g0, g1, {12 * HOUR})) AS lo FROM g) SELECT f AS file_id, lo, least(lo + {12 * HOUR}, g1) AS hi FROM x""")
def gap_probe_windows(spark: SparkSession, d: str) -> DataFrame:
    return intervals.tiles(intervals.gaps(cues(spark, d), 24 * HOUR), 12 * HOUR)


@query(f"""WITH {CUES}, n AS (SELECT *, lead(s) OVER (PARTITION BY f ORDER BY s, idx) AS x FROM cues) SELECT f AS file_id, idx, s AS start, CASE WHEN x > s AND e > x THEN x ELSE e END AS "end" FROM n""")
def deoverlap(spark: SparkSession, d: str) -> DataFrame:
    return retime.deoverlap(cues(spark, d)).select("file_id", "idx", "start", "end")


@query(f"""WITH {CUES}, r AS (SELECT f, idx, greatest(0, CAST(round_even((s - 1000) * CAST(1.001 AS DOUBLE), 0) AS BIGINT)) AS a, CAST(round_even((e - 1000) * CAST(1.001 AS DOUBLE), 0) AS BIGINT) AS b FROM cues) SELECT f AS file_id, idx, a AS start, greatest(a, b) AS "end" FROM r""")
def rescale(spark: SparkSession, d: str) -> DataFrame:
    return retime.rescale(cues(spark, d), 1.001, -1000).select("file_id", "idx", "start", "end")


_FROM = 1_704_500_000_000


@query(f"""WITH {CUES}, r AS (SELECT f, idx, CASE WHEN s >= {_FROM} AND s < {_FROM + 48 * HOUR} THEN s - 90000 ELSE s END AS a, s >= {_FROM} AND s < {_FROM + 48 * HOUR} AS i, e FROM cues)
SELECT f AS file_id, idx, a AS start, CASE WHEN i THEN greatest(a + 200, e - 90000) ELSE e END AS "end" FROM r""")
def shifted_block(spark: SparkSession, d: str) -> DataFrame:
    return retime.shift_block(cues(spark, d), _FROM, _FROM + 48 * HOUR, -90_000).select("file_id", "idx", "start", "end")


@query(f"""WITH {CUES} SELECT f AS file_id, idx, CASE WHEN s >= {_FROM + 48 * HOUR} THEN s - {48 * HOUR} ELSE s END AS start, CASE WHEN s >= {_FROM + 48 * HOUR} THEN e - {48 * HOUR} ELSE e END AS "end" FROM cues WHERE NOT (s >= {_FROM} AND e <= {_FROM + 48 * HOUR})""")
def cut_version(spark: SparkSession, d: str) -> DataFrame:
    return retime.cut_version(cues(spark, d), _FROM, _FROM + 48 * HOUR).select("file_id", "idx", "start", "end")


@query(f"""WITH {CUES} SELECT f AS file_id, idx, s + CASE WHEN s >= {_FROM} THEN 5000 ELSE 0 END + CASE WHEN s >= {_FROM + 99 * HOUR} THEN -12000 ELSE 0 END AS start FROM cues""")
def staircase(spark: SparkSession, d: str) -> DataFrame:
    return retime.staircase(cues(spark, d), [(_FROM, 5_000), (_FROM + 99 * HOUR, -12_000)]).select("file_id", "idx", F.col("start").cast("long"))


@query(f"""WITH {CUES}, n AS (SELECT *, ntile(6) OVER (PARTITION BY f ORDER BY s, idx) AS k FROM cues) SELECT f AS file_id, idx, greatest(0, s + ([5000, -7000, 9000, -11000, 13000, -15000])[k]) AS start FROM n""")
def piecewise_shift(spark: SparkSession, d: str) -> DataFrame:
    return retime.piecewise(cues(spark, d), 6, [5_000, -7_000, 9_000, -11_000, 13_000, -15_000]).select("file_id", "idx", "start")


@query(f"WITH {CUES} SELECT DISTINCT f AS file_id, unnest(range(s // {6 * HOUR}, (e - 1) // {6 * HOUR} + 1)) AS slot FROM cues WHERE e > s")
def speech_slots(spark: SparkSession, d: str) -> DataFrame:
    return intervals.slots(cues(spark, d), 6 * HOUR)


_WITNESS = f"""WITH {CUES}, sp AS (SELECT DISTINCT f, unnest(range(s // {HOUR}, (e - 1) // {HOUR} + 1)) AS slot FROM cues WHERE t = 'view' AND e > s), cu AS (SELECT DISTINCT f, unnest(range(s // {HOUR}, (e - 1) // {HOUR} + 1)) AS slot FROM cues WHERE t = 'click' AND e > s),
x AS (SELECT cu.f, h AS shift, sum(CASE WHEN sp.slot IS NOT NULL THEN 1 ELSE -1 END) AS score FROM (SELECT f, slot, unnest(range(-12, 13)) AS h FROM cu) cu LEFT JOIN sp ON sp.f = cu.f AND sp.slot = cu.slot + cu.h GROUP BY 1, 2)
SELECT f AS file_id, CAST(shift AS INTEGER) AS shift, CAST(score AS BIGINT) AS score FROM x QUALIFY row_number() OVER (PARTITION BY f ORDER BY score DESC, abs(shift), shift) = 1"""


@query(_WITNESS)
def sliding_block_witness(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d)
    return intervals.best_shift(intervals.slot_score(c.where("text = 'click'"), c.where("text = 'view'"), HOUR, list(range(-12, 13))))


_SLIDING = f"""WITH {CUES}, t0 AS (SELECT min(s) AS z FROM cues), q AS (SELECT f, (s - z) // {HOUR} AS a, (e - z) // {HOUR} + 1 AS b, t FROM cues, t0), cu AS (SELECT f, w, a, b FROM (SELECT *, unnest([a // 30 - 1, a // 30]) AS w FROM q WHERE t = 'click') WHERE w >= 0), big AS (SELECT f, w, sum(b - a) AS total FROM cu GROUP BY 1, 2 HAVING count(*) >= 2),
sl AS (SELECT DISTINCT f, unnest(range(a, b)) AS m FROM q WHERE t = 'view'), h AS (SELECT unnest(range(-60, 61)) AS k), moved AS (SELECT DISTINCT cu.f, cu.w, k, unnest(range(CAST(greatest(floor(a + k * 0.5), cu.w * 30 - 35) AS BIGINT), CAST(least(floor(b + k * 0.5), cu.w * 30 + 95) AS BIGINT))) AS m FROM cu JOIN big ON big.f = cu.f AND big.w = cu.w, h),
sc AS (SELECT moved.f, moved.w, k, sum(CASE WHEN sl.m IS NULL THEN -1 ELSE 1 END) AS score FROM moved LEFT JOIN sl ON sl.f = moved.f AND sl.m = moved.m GROUP BY 1, 2, 3)
SELECT b.f AS file_id, b.w AS w, sc.k * 0.5 AS best, round((sc.score - coalesce(z.score, 0)) / greatest(total, 1), 9)::DOUBLE AS gain FROM big b JOIN sc ON sc.f = b.f AND sc.w = b.w LEFT JOIN sc z ON z.f = b.f AND z.w = b.w AND z.k = 0 QUALIFY row_number() OVER (PARTITION BY b.f, b.w ORDER BY sc.score DESC, sc.k DESC) = 1"""


def _hours(spark: SparkSession, d: str) -> DataFrame:
    """Cues in whole hours from the first of all, as if they were seconds."""
    c = cues(spark, d)
    first = c.select(F.min("start").alias("z"))
    return c.join(F.broadcast(first)).select("file_id", F.floor((F.col("start") - F.col("z")) / HOUR).cast("double").alias("start"), (F.floor((F.col("end") - F.col("z")) / HOUR) + 1).cast("double").alias("end"), "text")


@query(_SLIDING.replace("sc.k * 0.5 AS best", "CAST(sc.k * 0.5 AS DOUBLE) AS best"))
def window_shifts(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    from ..params import DEFAULTS

    c = _hours(spark, d)
    found = intervals.window_shifts(c.where("text = 'click'"), c.where("text = 'view'"), replace(DEFAULTS, witness_step=1.0, witness_cues=2))
    return found.withColumn("gain", F.round("gain", 9))


@query(None)
def block_witness(spark: SparkSession, d: str) -> DataFrame:
    """Whether neighbouring windows agree on a shift; tests hold it against planted blocks."""
    c = _hours(spark, d)
    return intervals.block_witness(c.where("text = 'click'"), c.where("text = 'view'"))


@query(f"""WITH {CUES}, a AS (SELECT f, s, row_number() OVER (PARTITION BY f ORDER BY s, idx) AS n FROM cues), b AS (SELECT f, s + 2500 AS s, row_number() OVER (PARTITION BY f ORDER BY s, idx) AS n FROM cues WHERE idx % 7 <> 0)
SELECT coalesce(a.f, b.f) AS file_id, max(abs(b.s - a.s)) AS max_shift, avg(abs(b.s - a.s)) AS mean_shift, count(a.s) AS n_old, count(b.s) AS n_new FROM a FULL JOIN b ON a.f = b.f AND a.n = b.n GROUP BY 1""")
def max_shift(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d)
    return intervals.position_shift(c, retime.shift_all(c.where("idx % 7 <> 0"), 2_500))


@query(f"""WITH {CUES}, p AS (SELECT f, idx, s // 60000 AS m FROM cues WHERE t <> 'view'), o AS (SELECT DISTINCT f, s // 60000 AS m FROM cues WHERE t = 'view'),
x AS (SELECT p.f, p.idx, p.m, (SELECT max(o.m) FROM o WHERE o.f = p.f AND o.m <= p.m) AS b, (SELECT min(o.m) FROM o WHERE o.f = p.f AND o.m >= p.m) AS a FROM p), y AS (SELECT *, CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b WHEN m - b <= a - m THEN b ELSE a END AS o FROM x)
SELECT f AS file_id, idx, m AS t, o AS onset FROM y WHERE abs(o - m) <= 600""")
def nearest_onset(spark: SparkSession, d: str) -> DataFrame:
    minute = F.floor(F.col("start") / 60_000).cast("long").alias("t")
    c = cues(spark, d)
    return intervals.nearest(c.where("text <> 'view'").select("file_id", "idx", minute), c.where("text = 'view'").select("file_id", minute).distinct(), 600)


@query(f"WITH {CUES}, l AS (SELECT f, max(s) AS d FROM cues GROUP BY f) SELECT c.f AS file_id, count(*) AS late, max(e - d) AS overrun FROM cues c JOIN l ON l.f = c.f WHERE e > d + 1000 GROUP BY 1")
def overrun(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d)
    return verdict.overrun(c, c.groupBy("file_id").agg(F.max("start").alias("duration")), 1_000)


@query(f"""WITH {CUES}, n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY s, idx) - 1 AS n FROM cues), b AS (SELECT f, 0 AS block, 0 AS lo, count(*) // 2 AS hi, 1500 AS sh FROM cues GROUP BY f UNION ALL SELECT f, 1, count(*) // 2, count(*) // 2 + count(*) // 3, -2500 FROM cues GROUP BY f)
SELECT n.f AS file_id, block, min(s) + min(sh) AS from_t, max(e) + min(sh) AS to_t, count(*) AS n FROM n JOIN b ON b.f = n.f AND n.n >= lo AND n.n < hi GROUP BY 1, 2""")
def block_ranges(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.align import block_ranges as ranges

    c = cues(spark, d)
    sizes = c.groupBy("file_id").agg(F.count("*").alias("k"))
    rows = F.inline(F.array(F.struct(F.lit(0).alias("block"), F.floor(F.col("k") / 2).alias("n"), F.lit(1500).alias("shift")), F.struct(F.lit(1).alias("block"), F.floor(F.col("k") / 3).alias("n"), F.lit(-2500).alias("shift"))))
    return ranges(c, sizes.select("file_id", rows))


@query(f"""WITH {CUES}, p AS (SELECT f, idx, s, e, {_FROM} AS lo, {_FROM + 48 * HOUR} AS hi FROM cues), a AS (SELECT f, idx, CASE WHEN s >= lo AND s < hi THEN s + 700000 WHEN s >= hi THEN s - 300000 ELSE s END AS s, CASE WHEN s >= lo AND s < hi THEN e + 700000 WHEN s >= hi THEN e - 300000 ELSE e END AS e FROM p),
n AS (SELECT *, lead(s) OVER (PARTITION BY f ORDER BY s, idx) AS x FROM a) SELECT f AS file_id, idx, s AS start, CASE WHEN x > s AND e > x THEN x ELSE e END AS "end" FROM n""")
def anchor_resync(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d)
    stretches = F.inline(F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(by).alias("by")) for lo, hi, by in ((_FROM, _FROM + 48 * HOUR, 700_000), (_FROM + 48 * HOUR, 1 << 60, -300_000))]))
    return retime.apply_plan(c, c.select("file_id").distinct().select("file_id", stretches)).select("file_id", "idx", "start", "end")


@query(f"""WITH {CUES}, r AS (SELECT f, s // {24 * HOUR} AS day, min(s) AS a, max(s) AS b FROM cues WHERE t = 'purchase' GROUP BY 1, 2), x AS (SELECT *, lag(b) OVER w AS p, lead(a) OVER w AS n FROM r WINDOW w AS (PARTITION BY f ORDER BY a, b)),
y AS (SELECT *, max(CASE WHEN p > a THEN 1 ELSE 0 END) OVER (PARTITION BY f) AS bad FROM x) SELECT f AS file_id, CASE WHEN p IS NULL THEN a ELSE (p + a) / 2 END AS lo, CASE WHEN n IS NULL THEN b ELSE (b + n) / 2 END AS hi, 250 AS by FROM y WHERE bad = 0""")
def run_repair_plan(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.col("start") / (24 * HOUR))
    stretches = cues(spark, d).where("text = 'purchase'").groupBy("file_id", day.alias("day")).agg(F.min("start").alias("from_a"), F.max("start").alias("to_a")).withColumn("by", F.lit(250))
    return retime.run_repair_plan(stretches)


@query(f"""WITH RECURSIVE {CUES}, r AS (SELECT f, s AS lo, e AS hi, row_number() OVER (PARTITION BY f ORDER BY s, e) AS i FROM cues),
k AS (SELECT f, i, lo AS a, hi AS b, 1 AS g FROM r WHERE i = 1
  UNION ALL SELECT f, ri, CASE WHEN one THEN a ELSE lo END, CASE WHEN one THEN greatest(hi, b) ELSE hi END, CASE WHEN one THEN g ELSE g + 1 END FROM (SELECT k.f, a, b, g, r.i AS ri, lo, hi, lo - b <= {2 * HOUR} AND greatest(hi, b) - a <= {48 * HOUR} AS one FROM k JOIN r ON r.f = k.f AND r.i = k.i + 1))
SELECT f AS file_id, CAST(max(a) AS DOUBLE) AS lo, CAST(max(b) AS DOUBLE) AS hi, count(*) AS n FROM k GROUP BY f, g""")
def cluster_windows(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d).select("file_id", F.col("start").alias("lo"), F.col("end").alias("hi"))
    return runs.cluster_windows(c, 2 * HOUR, 48 * HOUR)


@query(f"""WITH RECURSIVE {CUES}, z AS (SELECT f, min(s) AS z, max(e) - min(s) + 600000 AS d FROM cues GROUP BY f), q AS (SELECT c.f, (s - z + e - z) / 2 AS m FROM cues c JOIN z ON z.f = c.f),
k AS (SELECT f, CAST(0 AS DOUBLE) AS lo, CAST(0 AS DOUBLE) AS hi, 0 AS i FROM z
  UNION ALL SELECT k.f, k.hi, CASE WHEN k.hi + {72 * HOUR} >= z.d THEN CAST(z.d AS DOUBLE) ELSE coalesce(max(q.m), k.hi + {72 * HOUR}) END, k.i + 1 FROM k JOIN z ON z.f = k.f LEFT JOIN q ON q.f = k.f AND q.m >= k.hi + {60 * HOUR} AND q.m <= k.hi + {72 * HOUR} AND q.m - k.hi >= {HOUR} WHERE k.hi < z.d GROUP BY k.f, k.hi, k.i, z.d)
SELECT f AS file_id, lo, hi FROM k WHERE i > 0""")
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    c = cues(spark, d)
    zero = c.groupBy("file_id").agg(F.min("start").alias("z"))
    moved = c.join(zero, "file_id").select("file_id", (F.col("start") - F.col("z")).alias("start"), (F.col("end") - F.col("z")).alias("end"))
    return runs.chunk_plan(moved, lengths(moved), 72.0 * HOUR, 12.0 * HOUR, 1.0 * HOUR)


@query(f"""WITH RECURSIVE {CUES}, r AS (SELECT f, idx, length(coalesce(t, '')) AS n, row_number() OVER (PARTITION BY f ORDER BY s, idx) AS i FROM cues),
k AS (SELECT f, idx, i, 0 AS batch, 1 AS held, n AS chars FROM r WHERE i = 1
  UNION ALL SELECT f, idx, i, CASE WHEN over THEN batch + 1 ELSE batch END, CASE WHEN over THEN 1 ELSE held + 1 END, CASE WHEN over THEN n ELSE chars + n END FROM (SELECT r.f, r.idx, r.i, r.n, batch, held, chars, held >= 7 OR chars + r.n > 40 AS over FROM k JOIN r ON r.f = k.f AND r.i = k.i + 1))
SELECT f AS file_id, idx, CAST(batch AS BIGINT) AS batch FROM k""")
def segment_batches(spark: SparkSession, d: str) -> DataFrame:
    return runs.batches(cues(spark, d), 7, 40)
