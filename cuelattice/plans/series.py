"""Robust statistics of the events as point series: whole minutes against hundredths of the value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import robust, runs
from ..params import RATE_NAMES, RATE_RATIOS
from .analogues import POINTS, cues, points

QUERIES: dict = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_MED = f"WITH {POINTS}, m AS (SELECT f, median(c) AS med, count(*) AS n FROM pts GROUP BY f)"


@query(f"{_MED} SELECT m.f AS file_id, n, med, median(abs(c - med)) AS mad FROM pts JOIN m USING (f) WHERE n >= 3 GROUP BY 1, 2, 3")
def median_mad(spark: SparkSession, d: str) -> DataFrame:
    return robust.median_mad(points(spark, d), "c", 3)


@query(f"""WITH {POINTS}, k AS (SELECT f, a // 1440 AS day, c FROM pts), m AS (SELECT f, day, median(c) AS med, count(*) AS n FROM k GROUP BY 1, 2 HAVING count(*) >= 2), x AS (SELECT k.f, k.day, median(abs(c - med)) AS mad FROM k JOIN m ON m.f = k.f AND m.day = k.day GROUP BY 1, 2)
SELECT f AS file_id, median(mad) AS jitter, count(*) AS clips FROM x GROUP BY 1 HAVING count(*) >= 5""")
def anchor_jitter(spark: SparkSession, d: str) -> DataFrame:
    keyed = points(spark, d).select(F.struct("file_id", F.floor(F.col("a") / 1440).alias("day")).alias("file_id"), "c")
    spread = robust.median_mad(keyed, "c", 2)
    return spread.groupBy(F.col("file_id.file_id").alias("file_id")).agg(F.median("mad").alias("jitter"), F.count("*").alias("clips")).where("clips >= 5")


_THEIL = f"WITH {POINTS}, sl AS (SELECT p.f, median((q.c - p.c) / (q.a - p.a)) AS slope FROM pts p JOIN pts q ON p.f = q.f AND p.a < q.a GROUP BY 1), sp AS (SELECT f, count(*) AS n, max(a) - min(a) AS span FROM pts GROUP BY 1)"


@query(f"{_THEIL} SELECT f AS file_id, n, slope, slope * span AS tilt FROM sl JOIN sp USING (f) WHERE n >= 3")
def theil_sen(spark: SparkSession, d: str) -> DataFrame:
    return robust.theil_sen(points(spark, d))


@query(f"""{_MED}, nr AS (SELECT f, a, c FROM pts JOIN m USING (f) WHERE n >= 12 AND abs(c - med) <= 1500), st AS (SELECT f, a, c FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY a, c) - 1 AS k FROM nr) WHERE k % 3 = 0),
sl AS (SELECT p.f, median((q.c - p.c) / (q.a - p.a)) AS slope FROM st p JOIN st q ON p.f = q.f AND p.a < q.a GROUP BY 1), sp AS (SELECT f, count(*) AS n, max(a) - min(a) AS span FROM st GROUP BY 1) SELECT f AS file_id, n, slope, slope * span AS tilt FROM sl JOIN sp USING (f) WHERE n >= 3""")
def trimmed_tilt(spark: SparkSession, d: str) -> DataFrame:
    return robust.trimmed_tilt(points(spark, d), 1500, 12, 3)


_SPEARMAN = """rk AS (SELECT f, rank() OVER (PARTITION BY f ORDER BY a) + (count(*) OVER (PARTITION BY f, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY f ORDER BY c) + (count(*) OVER (PARTITION BY f, c) - 1) / 2 AS rc FROM pts),
sm AS (SELECT f, count(*) AS n, sum(ra) AS x, sum(rc) AS y, sum(ra * rc) AS xy, sum(ra * ra) AS xx, sum(rc * rc) AS yy FROM rk GROUP BY 1)"""


@query(f"WITH {POINTS}, {_SPEARMAN} SELECT f AS file_id, n, CASE WHEN n * xx - x * x > 0 AND n * yy - y * y > 0 THEN round((n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)), 9) END AS rho FROM sm WHERE n >= 4")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return robust.spearman(points(spark, d)).withColumn("rho", F.round("rho", 9))


def _fit_rounds(n: int) -> str:
    parts, pool = [], "pts"
    for k in range(n):
        parts.append(f"""s{k} AS (SELECT p.f, median((q.c - p.c) / (q.a - p.a)) AS slope FROM {pool} p JOIN {pool} q ON p.f = q.f AND p.a < q.a GROUP BY 1), e{k} AS (SELECT f FROM {pool} GROUP BY f HAVING count(*) >= 8),
i{k} AS (SELECT x.f, slope, median(c - slope * a) AS icpt FROM {pool} x JOIN s{k} ON s{k}.f = x.f WHERE x.f IN (SELECT f FROM e{k}) GROUP BY 1, 2), n{k} AS (SELECT x.f, a, c, slope, icpt FROM pts x JOIN i{k} ON i{k}.f = x.f WHERE abs(c - slope * a - icpt) <= 600),
c{k} AS (SELECT f, count(*) AS n FROM n{k} GROUP BY 1 HAVING count(*) >= 8), k{k} AS (SELECT f, a, c FROM n{k} WHERE f IN (SELECT f FROM c{k}))""")
        pool = f"k{k}"
    return ", ".join(parts)


@query(f"WITH {POINTS}, {_fit_rounds(2)} SELECT i1.f AS file_id, round(slope, 12) AS slope, round(icpt, 4) AS intercept, c1.n AS n_kept FROM i1 JOIN c1 ON c1.f = i1.f")
def rate_fit(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    from ..params import DEFAULTS

    fit = robust.rate_fit(points(spark, d), replace(DEFAULTS, fit_resid=600.0, fit_rounds=2))
    return fit.select("file_id", F.round("slope", 12).alias("slope"), F.round("intercept", 4).alias("intercept"), "n_kept")


@query(f"""WITH {POINTS}, en AS (SELECT f, min(a) AS a0, max(a) AS a1 FROM pts GROUP BY 1), b AS (SELECT f, least(3, floor(4 * (a - a0) / greatest(a1 - a0, 1))) AS b, count(*) AS n, median(abs(c - CAST(0.01 AS DOUBLE) * a - CAST(5 AS DOUBLE))) AS m FROM pts JOIN en USING (f) GROUP BY 1, 2)
SELECT f AS file_id, round(max(m), 4) AS worst, count(*) AS bins FROM b WHERE n >= 5 GROUP BY 1""")
def quartile_residual(spark: SparkSession, d: str) -> DataFrame:
    return robust.quartile_residual(points(spark, d), 0.01, 5.0).withColumn("worst", F.round("worst", 4))


_NEAR = f"""{_MED}, nr AS (SELECT f, a, c FROM pts JOIN m USING (f) WHERE abs(c - med) <= 1500), en AS (SELECT f, min(a) AS a0, max(a) AS a1 FROM nr GROUP BY 1 HAVING count(*) >= 20)"""


def _signature(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    from ..params import DEFAULTS

    return robust.drift_signature(points(spark, d), replace(DEFAULTS, signature_trim=1500.0))


@query(f"""{_NEAR}, o AS (SELECT nr.f, a, c, h FROM nr JOIN en ON en.f = nr.f, (SELECT unnest(range(0, 8)) AS h) WHERE least(7, floor((a - a0)::DOUBLE / (a1 - a0) * 8)) <> h AND a1 > a0), sp AS (SELECT f, h, count(*) AS n, max(a) - min(a) AS span FROM o GROUP BY 1, 2),
sl AS (SELECT p.f, p.h, median((q.c - p.c) / (q.a - p.a)) AS slope FROM o p JOIN o q ON p.f = q.f AND p.h = q.h AND p.a < q.a GROUP BY 1, 2)
SELECT sp.f AS file_id, CAST(sp.h AS INTEGER) AS part, CASE WHEN n >= 20 THEN slope * span END AS tilt FROM sp LEFT JOIN sl ON sl.f = sp.f AND sl.h = sp.h""")
def left_out_tilts(spark: SparkSession, d: str) -> DataFrame:
    return _signature(spark, d).select("file_id", F.posexplode("left_out").alias("part", "tilt"))


@query(f"""{_NEAR}, t AS (SELECT nr.f, a, c, a0, a1 FROM nr JOIN en ON en.f = nr.f), sl AS (SELECT p.f, median((q.c - p.c) / (q.a - p.a)) AS slope FROM t p JOIN t q ON p.f = q.f AND p.a < q.a GROUP BY 1),
b AS (SELECT f, k, a0 + (k + 0.5) / 16 * (a1 - a0) AS x, median(c) AS y FROM (SELECT *, least(15, floor((a - a0)::DOUBLE / (a1 - a0) * 16)) AS k FROM t WHERE a1 > a0) GROUP BY 1, 2, 3), v AS (SELECT f, max(x) - min(x) AS span FROM b GROUP BY 1 HAVING count(*) >= 8), bs AS (SELECT p.f, median((q.y - p.y) / (q.x - p.x)) AS slope FROM b p JOIN b q ON p.f = q.f AND p.x < q.x GROUP BY 1),
{_SPEARMAN.replace("FROM pts", "FROM t")} SELECT en.f AS file_id, round(sl.slope * (a1 - a0), 6) AS tilt, round(bs.slope * v.span, 6) AS binned, CASE WHEN sm.n * xx - x * x > 0 AND sm.n * yy - y * y > 0 THEN round((sm.n * xy - x * y) / sqrt((sm.n * xx - x * x) * (sm.n * yy - y * y)), 6) END AS rho, sm.n AS n
FROM en JOIN sm ON sm.f = en.f LEFT JOIN sl ON sl.f = en.f LEFT JOIN v ON v.f = en.f LEFT JOIN bs ON bs.f = v.f""")
def drift_signature(spark: SparkSession, d: str) -> DataFrame:
    return _signature(spark, d).select("file_id", *[F.round(c, 6).alias(c) for c in ("tilt", "binned", "rho")], "n")


@query(f"""WITH {POINTS}, l AS (SELECT f, regr_slope(c, a - 28000000) AS m, regr_intercept(c, a - 28000000) AS b, count(*) AS n FROM pts GROUP BY 1) SELECT pts.f AS file_id, round(m, 6) AS slope, round(max(abs(c - m * (a - 28000000) - b)), 3) AS worst FROM pts JOIN l ON l.f = pts.f WHERE n >= 10 GROUP BY 1, 2""")
def ols_unclamp(spark: SparkSession, d: str) -> DataFrame:
    line = robust.line_through(points(spark, d).withColumn("a", F.col("a") - 28_000_000))
    return line.select("file_id", F.round("slope", 6).alias("slope"), F.round("worst", 3).alias("worst"))


@query(f"""WITH {POINTS}, x AS (SELECT f, list_sort(list(abs(c - 800))) AS v, count(*) AS n, median(abs(c - 800)) AS p50, avg(CASE WHEN abs(c - 800) <= 0.5 THEN 1.0 ELSE 0 END) AS within_half, avg(CASE WHEN abs(c - 800) <= 1 THEN 1.0 ELSE 0 END) AS within_one, avg(CASE WHEN abs(c - 800) <= 2 THEN 1.0 ELSE 0 END) AS within_two FROM pts GROUP BY 1)
SELECT f AS file_id, n, p50, within_half, within_one, within_two, v[least(n - 1, CAST(floor(n * 0.9) AS BIGINT)) + 1] AS p90 FROM x""")
def error_summary(spark: SparkSession, d: str) -> DataFrame:
    return robust.error_summary(points(spark, d).withColumn("c", F.col("c") - 800), "c")


@query(f"WITH {POINTS} SELECT f AS file_id, avg(CASE WHEN abs(c) > 250 THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n FROM pts GROUP BY 1 HAVING count(*) >= 40")
def share_off(spark: SparkSession, d: str) -> DataFrame:
    return robust.share_off(points(spark, d), 250, 40)


@query(f"WITH {POINTS} SELECT f AS file_id, idx, c FROM pts WHERE abs(c) > 2500 QUALIFY count(*) OVER (PARTITION BY f) >= 3")
def residual_gate(spark: SparkSession, d: str) -> DataFrame:
    return robust.all_or_nothing(points(spark, d).select("file_id", "idx", "c"), "c", 2500, 3)


@query(f"WITH {POINTS} SELECT f AS file_id, max(c) - min(c) AS spread, count(*) AS n FROM pts GROUP BY 1 HAVING count(*) >= 2")
def anchor_spread(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy("file_id").agg((F.max("c") - F.min("c")).alias("spread"), F.count("*").alias("n")).where("n >= 2")


@query(f"""WITH {POINTS}, l AS (SELECT *, lag(a) OVER w AS a0, lag(c) OVER w AS c0 FROM pts WINDOW w AS (PARTITION BY f ORDER BY a, idx)) SELECT f AS file_id, idx, a0, a, c - c0 AS step FROM l WHERE a > a0 AND abs(c - c0) > 500 AND abs(c - c0) / (a - a0) > 3.0""")
def slope_breaks(spark: SparkSession, d: str) -> DataFrame:
    return runs.slope_breaks(points(spark, d), 500, 3.0)


@query(f"""WITH {POINTS}, w AS (SELECT f, idx, a, row_number() OVER z AS n, median(c) OVER (PARTITION BY f ORDER BY a, idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS med, max(a) OVER (PARTITION BY f ORDER BY a, idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS a1, list(c) OVER (PARTITION BY f ORDER BY a, idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS v FROM pts WINDOW z AS (PARTITION BY f ORDER BY a, idx)),
k AS (SELECT f, idx, n, a, a1, med, list_median(list_transform(v, lambda x: abs(x - med))) AS mad FROM w WHERE len(v) = 6) SELECT f AS file_id, idx, n, a, a1, med, mad FROM k""".replace("row_number() OVER z AS n", "CAST(row_number() OVER z AS INTEGER) AS n"))
def k_row_medians(spark: SparkSession, d: str) -> DataFrame:
    return runs.sliding_medians(points(spark, d), 6).drop("cue_lo", "cue_hi")


@query(f"""WITH {POINTS}, rf AS (SELECT f, median(c) AS ref FROM pts GROUP BY 1), w AS (SELECT f, a, row_number() OVER (PARTITION BY f ORDER BY a, idx) AS n, median(c) OVER x AS med, max(a) OVER x AS a1, min(a - c) OVER x AS q0, max(a - c) OVER x AS q1, list(c) OVER x AS v FROM pts WINDOW x AS (PARTITION BY f ORDER BY a, idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
k AS (SELECT w.f, n, a, a1, q0, q1, med - ref AS dev, sign(med - ref) AS side, list_median(list_transform(v, lambda x: abs(x - med))) AS mad FROM w JOIN rf ON rf.f = w.f WHERE len(v) = 6), o AS (SELECT * FROM k WHERE abs(dev) >= 150 AND mad <= 500),
q AS (SELECT *, CASE WHEN lag(n) OVER z IS NULL OR n - lag(n) OVER z >= 6 OR side <> lag(side) OVER z THEN 1 ELSE 0 END AS nw FROM o WINDOW z AS (PARTITION BY f ORDER BY n)), r AS (SELECT *, sum(nw) OVER (PARTITION BY f ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM q)
SELECT f AS file_id, CAST(run AS BIGINT) AS run, min(a) AS from_a, max(a1) AS to_a, first(dev ORDER BY abs(dev) DESC, n) AS dev, count(*) AS windows, count(*) + 5 AS n, min(q0) AS cue_from, max(q1) AS cue_to FROM r GROUP BY 1, 2""")
def k_row_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.deviant_runs(points(spark, d), 6, 150, 500)


# Times in seconds with offsets that walk by one of four rates, and noise.
_RATES = f"""WITH {POINTS}, rp AS (SELECT f, idx, (a - 28400000) / 10.0::DOUBLE AS a, (CASE f % 4 WHEN 0 THEN 0.001 WHEN 1 THEN -0.0427 WHEN 2 THEN 0.0005 ELSE 0.0 END)::DOUBLE * ((a - 28400000) / 10.0::DOUBLE) + (c % 100) / 400.0::DOUBLE AS c FROM pts)"""


def _rate_points(spark: SparkSession, d: str) -> DataFrame:
    a = (F.col("a") - 28_400_000) / 10.0
    slope = F.element_at(F.array(*map(F.lit, (0.001, -0.0427, 0.0005, 0.0))), (F.col("file_id") % 4 + 1).cast("int"))
    return points(spark, d).select("file_id", "idx", a.alias("a"), (slope * a + (F.col("c") % 100) / 400.0).alias("c"))


@query(f"""{_RATES}, m AS (SELECT f, 1 / (1 - slope) AS r0, 0.1::DOUBLE AS o0 FROM (SELECT DISTINCT f, (CASE f % 4 WHEN 0 THEN 0.001 WHEN 1 THEN -0.0427 WHEN 2 THEN 0.0005 ELSE 0.0 END)::DOUBLE AS slope FROM pts)),
n AS (SELECT rp.f, a, a - c AS s, r0, o0, abs(a - r0 * (a - c + o0)) <= 2.5 AS near, bool_or(abs(a - r0 * (a - c + o0)) <= 2.5) OVER (PARTITION BY rp.f) AS hits FROM rp JOIN m ON m.f = rp.f), k AS (SELECT unnest([{", ".join(map(repr, RATE_RATIOS))}]) AS r, unnest(range(0, {len(RATE_RATIOS)})) AS k),
t AS (SELECT f, -1 AS k, r0 AS r, a, s, o0 FROM n WHERE near OR NOT hits UNION ALL SELECT f, k, r, a, s, o0 FROM n, k WHERE (near OR NOT hits) AND abs(r / r0 - 1) <= 0.0008),
o AS (SELECT f, k, CASE WHEN k < 0 THEN first(o0) ELSE median(a / r - s) END AS o FROM t GROUP BY f, k), d AS (SELECT t.f, t.k, first(r) AS r, first(o) AS o, median(abs(a - r * (s + o))) AS mad FROM t JOIN o ON o.f = t.f AND o.k = t.k GROUP BY t.f, t.k),
w AS (SELECT *, max(CASE WHEN k < 0 THEN mad END) OVER (PARTITION BY f) AS own FROM d) SELECT f AS file_id, r AS ratio, o AS offset, CASE WHEN k < 0 THEN 'stretch ' || printf('%+.2f', (r - 1) * 100) || '%' ELSE ([{", ".join(map(repr, RATE_NAMES))}])[k + 1] END AS name
FROM w WHERE k < 0 OR mad <= own + 0.02 QUALIFY row_number() OVER (PARTITION BY f ORDER BY CASE WHEN k < 0 THEN 1 ELSE 0 END, mad, r) = 1""")
def snap_rate(spark: SparkSession, d: str) -> DataFrame:
    p = _rate_points(spark, d)
    slope = F.element_at(F.array(*map(F.lit, (0.001, -0.0427, 0.0005, 0.0))), (F.col("file_id") % 4 + 1).cast("int"))
    return robust.snap_rate(p, p.select("file_id", slope.alias("slope"), F.lit(0.1).alias("intercept")).distinct())


@query(f"""WITH {POINTS}, {_fit_rounds(2)}, g AS (SELECT k1.f, a, c, slope, icpt FROM k1 JOIN i1 ON i1.f = k1.f), m AS (SELECT f, median(c) AS mc, median(c - slope * a) AS mr, max(a) - min(a) AS span, count(*) AS n FROM g GROUP BY 1),
v AS (SELECT g.f, median(abs(c - mc)) AS before, median(abs(c - slope * a - mr)) AS after FROM g JOIN m ON m.f = g.f GROUP BY 1), ol AS (SELECT x.f, avg(CASE WHEN abs(c - slope * a - icpt) <= 900 THEN 1.0 ELSE 0 END) AS share, count(*) AS n_raw FROM pts x JOIN i1 ON i1.f = x.f GROUP BY 1), {_SPEARMAN.replace("FROM pts", "FROM g")}
SELECT m.f AS file_id, round(slope, 9) AS slope, round(slope * span, 4) AS tilt, round((sm.n * xy - x * y) / sqrt((sm.n * xx - x * x) * (sm.n * yy - y * y)), 6) AS rho, round(before - after, 4) AS gain, round(after, 4) AS resid, share AS keep_frac, m.n AS n_kept, n_raw, span::DOUBLE AS span
FROM m JOIN v ON v.f = m.f JOIN ol ON ol.f = m.f JOIN sm ON sm.f = m.f JOIN i1 ON i1.f = m.f""")
def stretch_probe(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    from ..params import DEFAULTS

    probe = robust.stretch_probe(points(spark, d), replace(DEFAULTS, fit_resid=600.0, fit_keep=900.0, fit_rounds=2))
    places = {"slope": 9, "tilt": 4, "rho": 6, "gain": 4, "resid": 4}
    return probe.drop("intercept").withColumns({c: F.round(c, n) for c, n in places.items()})


@query(None)
def rate_levels(spark: SparkSession, d: str) -> DataFrame:
    """The gate's level and the flat tests of each file's probe; tests hold them against stated cases."""
    return robust.stretch_probe(_rate_points(spark, d)).select("file_id", robust.gate_level().alias("level"), robust.is_flat().alias("flat"), robust.is_flat(True).alias("tight"))


@query(None)
def greedy_regions(spark: SparkSession, d: str) -> DataFrame:
    """Two levels of which one holds to a time: stretches of each file that can be verified; tests hold the rule against stated cases."""
    level = F.when(F.col("a") > 28_420_000, F.lit(4000)).otherwise(F.lit(300))
    return runs.regions(points(spark, d).withColumn("c", level + F.col("c") % 200), 800.0, 3)


@query(f"""WITH RECURSIVE {POINTS}, m AS (SELECT f, median(c) AS m FROM pts GROUP BY f), o AS (SELECT pts.f, a, c - m AS d, max(abs(c - m)) OVER (PARTITION BY pts.f) > 4000 AS far, row_number() OVER (PARTITION BY pts.f ORDER BY a, c) AS i FROM pts JOIN m ON m.f = pts.f WHERE abs(c - m) > 700),
k AS (SELECT f, i, a, d, a AS a0, 1 AS g FROM o WHERE i = 1 AND NOT far UNION ALL SELECT o.f, o.i, o.a, o.d, CASE WHEN o.a - a0 <= 2880 THEN a0 ELSE o.a END, CASE WHEN o.a - a0 <= 2880 THEN g ELSE g + 1 END FROM k JOIN o ON o.f = k.f AND o.i = k.i + 1)
SELECT f AS file_id, CAST(a AS DOUBLE) AS from_a, CAST(a AS DOUBLE) AS to_a, CAST(1 AS BIGINT) AS n, CAST(d AS DOUBLE) AS dev FROM o WHERE far AND abs(d) > 4000
UNION ALL SELECT f, CAST(min(a) AS DOUBLE), CAST(max(a) AS DOUBLE), count(*), CAST(median(d) AS DOUBLE) FROM k GROUP BY f, g HAVING count(*) > 1""")
def block_clusters(spark: SparkSession, d: str) -> DataFrame:
    return runs.block_clusters(points(spark, d), 700.0, 4000.0, 2880.0)


@query("""WITH e AS (SELECT user_id AS f, epoch_us(ts) // 1000 AS s FROM events), n AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY f ORDER BY s) < 7200000 THEN 0 ELSE 1 END AS x FROM e), i AS (SELECT *, sum(x) OVER (PARTITION BY f ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT f AS file_id, min(s) AS start, max(s) AS last, count(*) AS n FROM i GROUP BY f, k""")
def speech_bursts(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.intervals import islands

    c = cues(spark, d).select("file_id", "start", (F.col("start") + 7_200_000).alias("end"))
    grouped = islands(c.withColumn("start", F.col("start") + 1)).groupBy("file_id", "island").agg((F.min("start") - 1).alias("start"), (F.max("start") - 1).alias("last"), F.count("*").alias("n"))
    return grouped.drop("island")


@query(None)
def onset_tilt(spark: SparkSession, d: str) -> DataFrame:
    """Tilt of cue starts against the onsets nearest to them; tests hold it against shifted and drifting cues."""
    from dataclasses import replace

    from ..params import DEFAULTS

    c = cues(spark, d).select("file_id", (F.col("start") / 60_000.0).alias("t"), "text")
    return robust.onset_tilt(c.where("text <> 'view'"), c.where("text = 'view'"), replace(DEFAULTS, onset_reach=600.0, onset_trim=400.0, onset_points=10))


@query(None)
def resync_plan(spark: SparkSession, d: str) -> DataFrame:
    """Borders and shifts of each file's stretches; tests hold it against stated plans."""
    c = cues(spark, d).select("file_id", "idx", (F.col("start") / 60).alias("start"), (F.col("end") / 60).alias("end"))
    from dataclasses import replace

    from ..params import DEFAULTS

    p = points(spark, d).withColumn("c", F.when(F.col("a") > 28_420_000, F.lit(40)).otherwise(F.lit(3)) + F.col("c") % 2)
    return runs.resync_plan(c, p, replace(DEFAULTS, region_tolerance=4.0))
