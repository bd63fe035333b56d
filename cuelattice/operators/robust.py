"""Robust statistics of point series ``(file_id, a, c)``: exact medians, trimmed fits, rank correlation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.transcript import slope_snaps
from ..params import DEFAULTS, RATE_NAMES, RATE_RATIOS, Params

KEY = "file_id"


def median_mad(values: DataFrame, value: str, least: int = 1) -> DataFrame:
    """Median and median absolute deviation of each file with ``least`` values."""
    middle = values.groupBy(KEY).agg(F.median(value).alias("med"), F.count(value).alias("n")).where(F.col("n") >= least)
    apart = values.join(middle, KEY).groupBy(KEY).agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    return middle.join(apart, KEY).select(KEY, "n", "med", "mad")


def _median_slope(a: np.ndarray, c: np.ndarray) -> float | None:
    """Median slope over pairs with different ``a``; None without one."""
    i, j = np.triu_indices(len(a), 1)
    apart = a[j] - a[i]
    slopes = np.sort((c[j] - c[i])[apart != 0] / apart[apart != 0])
    low, high = (len(slopes) - 1) // 2, len(slopes) // 2
    return float(0.5 * slopes[low] + 0.5 * slopes[high]) if len(slopes) else None


@F.pandas_udf(T.DoubleType())
def _slopes(a: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([_median_slope(np.asarray(x, dtype=float), np.asarray(y, dtype=float)) for x, y in zip(a, c, strict=True)], dtype="float64")


def theil_sen(points: DataFrame, least: int = 3) -> DataFrame:
    """Median slope over pairs with different ``a``, and the tilt: slope times span.

    Files are bounded: a file's points are one row, and its pairs are there only while that row is read. Points without ``a`` or ``c`` have no slope.
    """
    files = points.groupBy(KEY).agg(F.count("*").alias("n"), (F.max("a") - F.min("a")).alias("span"), F.collect_list(F.when(F.col("a").isNotNull() & F.col("c").isNotNull(), F.struct("a", "c"))).alias("_p")).where((F.col("n") >= least) & F.col(KEY).isNotNull())
    told = files.select(KEY, "n", "span", _slopes.asNondeterministic()("_p.a", "_p.c").alias("slope")).where("slope is not null")
    return told.select(KEY, "n", "slope", (F.col("slope") * F.col("span")).alias("tilt"))


def strided(points: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th point in order: thinning for the pairwise fit."""
    w = Window.partitionBy(KEY).orderBy("a", "c")
    return points.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") % stride == 0).drop("_n")


def trimmed_tilt(points: DataFrame, trim: float, min_points: int, stride: int = 1) -> DataFrame:
    """Points within ``trim`` of the median, thinned, then the tilt; the number of points is asked for before the trim."""
    middle = points.groupBy(KEY).agg(F.median("c").alias("m"), F.count("*").alias("n0")).where(F.col("n0") >= min_points)
    near = points.join(middle, KEY).where(F.abs(F.col("c") - F.col("m")) <= trim).select(KEY, "a", "c")
    return theil_sen(strided(near, stride))


def spearman(points: DataFrame, least: int = 4) -> DataFrame:
    """Rank correlation with mean ranks of ties; null where either side does not vary."""

    def mean_rank(c: str) -> Column:
        w = Window.partitionBy(KEY).orderBy(c)
        return F.rank().over(w) + (F.count("*").over(Window.partitionBy(KEY, c)) - 1) / 2.0

    ranks = points.withColumn("ra", mean_rank("a")).withColumn("rc", mean_rank("c"))
    n, x, y = F.count("*"), F.col("ra"), F.col("rc")
    sums = ranks.groupBy(KEY).agg(n.alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy")).where(F.col("n") >= least)
    vx, vy = F.col("n") * F.col("xx") - F.col("x") * F.col("x"), F.col("n") * F.col("yy") - F.col("y") * F.col("y")
    return sums.select(KEY, "n", F.when((vx > 0) & (vy > 0), (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(vx * vy)).alias("rho"))


def _slope(a: np.ndarray, c: np.ndarray) -> float:
    i, j = np.triu_indices(len(a), 1)
    apart = a[j] - a[i]
    return float(np.median((c[j] - c[i])[apart != 0] / apart[apart != 0]))


def _ranks(x: np.ndarray) -> np.ndarray:
    _, place, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[place]


def trimmed_line(a: np.ndarray, c: np.ndarray, p: Params = DEFAULTS) -> tuple[float, float, np.ndarray] | None:
    """Line by median pairwise slope and median intercept, and the points within ``fit_resid`` of it; each round trims the whole series anew.

    None where a round keeps fewer than ``fit_floor`` points or all its points share a time.
    """
    kept = np.ones(len(a), bool)
    slope = intercept = 0.0
    for _ in range(p.fit_rounds):
        if kept.sum() < p.fit_floor or np.ptp(a[kept]) == 0:
            return None
        slope = _slope(a[kept], c[kept])
        intercept = float(np.median(c[kept] - slope * a[kept]))
        kept = np.abs(c - slope * a - intercept) <= p.fit_resid
    return (slope, intercept, kept) if kept.sum() >= p.fit_floor else None


def fit(a: np.ndarray, c: np.ndarray, p: Params = DEFAULTS) -> tuple[float, float, int] | None:
    """:func:`trimmed_line` with the number of points that it keeps."""
    line = trimmed_line(a, c, p)
    return line and (line[0], line[1], int(line[2].sum()))


def _mad(x: np.ndarray) -> float:
    return float(np.median(np.abs(x - np.median(x))))


def _rho(a: np.ndarray, c: np.ndarray) -> float | None:
    ra, rc = _ranks(a), _ranks(c)
    return float(np.corrcoef(ra, rc)[0, 1]) if len(a) > 3 and np.ptp(ra) and np.ptp(rc) else None


def probe(a: np.ndarray, c: np.ndarray, p: Params = DEFAULTS) -> tuple | None:
    """One series' line and what it gains. Tilt, rank correlation, gain and residual are those of the points it keeps, the share kept is of all."""
    if (line := trimmed_line(a, c, p)) is None:
        return None
    slope, intercept, kept = line
    x, y = a[kept], c[kept]
    span = float(np.ptp(x))
    if len(x) < 4 or span <= 0:
        return None
    after = _mad(y - slope * x)
    share = float((np.abs(c - slope * a - intercept) <= p.fit_keep).mean())
    return slope, intercept, slope * span, _rho(x, y), _mad(y) - after, after, share, len(x), len(a), span


def _fitted(points: DataFrame, f: Callable[[np.ndarray, np.ndarray], tuple | None], schema: str) -> DataFrame:
    """One row of ``f`` for each file. A fit's rounds need all of a file's points, and as joins would nest; files are bounded."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "c"], kind="stable")
        found = f(pdf["a"].to_numpy(float), pdf["c"].to_numpy(float))
        return pd.DataFrame([(pdf[KEY].iloc[0], *found)] if found else [], columns=[KEY, *names])

    return points.select(KEY, "a", "c").groupBy(KEY).applyInPandas(run, f"{KEY} {points.schema[KEY].dataType.simpleString()}, {schema}")


def rate_fit(points: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``(file_id, slope, intercept, n_kept)``: the trimmed line of each file that has one."""
    return _fitted(points, lambda a, c: fit(a, c, p), "slope double, intercept double, n_kept long")


def stretch_probe(points: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """A fit with what it gains: deviation before and after, share of the pool it keeps, tilt over the span, and rank correlation."""
    return _fitted(points, lambda a, c: probe(a, c, p), "slope double, intercept double, tilt double, rho double, gain double, resid double, keep_frac double, n_kept long, n_raw long, span double")


def stretch_ratio(slope: Column) -> Column:
    return 1 / (1 - slope)


# Tiers of the gate that a rate must pass: level, points kept, tilt, rank correlation, share kept, gain, residual, and whether
# its ratio must be a known one.
RATE_TIERS = (
    (2, 40, 1.5, 0.70, 0.85, 0.15, 0.40, False),
    (2, 40, 3.0, 0.85, 0.85, 0.50, 0.65, False),
    (2, 40, 0.8, 0.45, 0.85, 0.05, 0.40, True),
    (1, 40, 0.85, 0.40, 0.85, 0.07, 0.32, False),
)
# Tilt, offset and residual under which nothing is left to correct, loosely and tightly.
FLAT, TIGHT = (1.0, 0.25, None), (0.5, 0.15, 0.30)


def gates_pass(points: int, tilt: float, rho: float, keep: float, gain: float, resid: float, most_slope: float = DEFAULTS.rate_most) -> Column:
    """Whether a probe looks like one rate over the whole file; without a rank correlation it does not."""
    return F.coalesce((F.col("n_kept") >= points) & (F.abs("tilt") >= tilt) & (F.abs("rho") >= rho) & (F.col("keep_frac") >= keep) & (F.col("gain") >= gain) & (F.col("resid") <= resid) & (F.abs("slope") <= most_slope), F.lit(False))


def gate_level(tiers: tuple = RATE_TIERS, ratios: tuple[float, ...] = RATE_RATIOS) -> Column:
    """2: a rate by the probe alone; 1: weak evidence, to be verified by the corrected file; 0: no rate."""
    known = slope_snaps(F.col("slope"), ratios, DEFAULTS.rate_snap_gate)
    passed = [F.when(gates_pass(*bars) & (known if snaps else F.lit(True)), level) for level, *bars, snaps in tiers]
    return F.coalesce(F.greatest(*passed), F.lit(0))


def is_flat(tight: bool = False, least: float = DEFAULTS.rate_keep) -> Column:
    """Whether a probe leaves nothing to correct; where it is tight the residual must be small as well."""
    tilt, offset, resid = TIGHT if tight else FLAT
    quiet = (F.col("keep_frac") >= least) & (F.abs("tilt") < tilt) & (F.abs("intercept") < offset)
    return F.coalesce(quiet & (F.col("resid") <= resid) if tight else quiet, F.lit(False))


def snap_rate(points: DataFrame, fitted: DataFrame, p: Params = DEFAULTS, ratios: tuple[float, ...] = RATE_RATIOS, names: tuple[str, ...] = RATE_NAMES) -> DataFrame:
    """``(file_id, ratio, offset, name)`` of the correction ``ratio * (t + offset)`` for each fitted file.

    A known ratio near the measured one wins where it leaves no more than ``rate_snap_slack`` more deviation. Points off the line do not count,
    unless all are. ``points(a, c)`` are times with their offsets, so ``a - c`` is the time to be corrected.
    """
    measured = fitted.select(KEY, stretch_ratio(F.col("slope")).alias("r0"), F.col("intercept").alias("o0"))
    placed = points.join(measured, KEY).select(KEY, "a", (F.col("a") - F.col("c")).alias("s"), "r0", "o0")
    near = placed.withColumn("on", F.abs(F.col("a") - F.col("r0") * (F.col("s") + F.col("o0"))) <= p.fit_keep).withColumn("any", F.bool_or("on").over(Window.partitionBy(KEY)))
    known = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("r")) for k, r in enumerate(ratios)]), lambda x: F.abs(x["r"] / F.col("r0") - 1) <= p.rate_snap)
    tried = near.where("on or not any").withColumn("x", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("k"), F.col("r0").alias("r"))), known))).select(KEY, "a", "s", "o0", "x.k", "x.r")
    middle = tried.groupBy(KEY, "k").agg(F.median(F.col("a") / F.col("r") - F.col("s")).alias("o"), F.first("o0").alias("o0")).select(KEY, "k", F.when(F.col("k") < 0, F.col("o0")).otherwise(F.col("o")).alias("o"))
    left = tried.join(middle, [KEY, "k"]).groupBy(KEY, "k").agg(F.median(F.abs(F.col("a") - F.col("r") * (F.col("s") + F.col("o")))).alias("mad"), F.first("r").alias("r"), F.first("o").alias("o"))
    own = F.max(F.when(F.col("k") < 0, F.col("mad"))).over(Window.partitionBy(KEY))
    ranked = left.withColumn("own", own).where((F.col("k") < 0) | (F.col("mad") <= F.col("own") + p.rate_snap_slack))
    best = Window.partitionBy(KEY).orderBy((F.col("k") < 0).cast("int"), "mad", "r")
    percent = F.format_string("%+.2f", (F.col("r") - 1) * 100)
    name = F.coalesce(F.get(F.array(*map(F.lit, names)), F.when(F.col("k") >= 0, F.col("k"))), F.concat(F.lit("stretch "), percent, F.lit("%")))
    return ranked.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(KEY, F.col("r").alias("ratio"), F.col("o").alias("offset"), name.alias("name"))


def quartile_residual(points: DataFrame, slope: float, intercept: float, bins: int = 4, least: int = 5) -> DataFrame:
    """Greatest of the bins' median distances from a line; bins split the span evenly and need ``least`` points."""
    ends = points.groupBy(KEY).agg(F.min("a").alias("a0"), F.max("a").alias("a1"))
    own = F.least(F.lit(bins - 1), F.floor(bins * (F.col("a") - F.col("a0")) / F.greatest(F.col("a1") - F.col("a0"), F.lit(1))))
    binned = points.join(ends, KEY).groupBy(KEY, own.alias("bin")).agg(F.count("*").alias("n"), F.median(F.abs(F.col("c") - slope * F.col("a") - intercept)).alias("m"))
    return binned.where(F.col("n") >= least).groupBy(KEY).agg(F.max("m").alias("worst"), F.count("*").alias("bins"))


def _tilt(a: np.ndarray, c: np.ndarray) -> float | None:
    """Median pairwise slope times the span; None for fewer than three points or a single time."""
    return _slope(a, c) * float(np.ptp(a)) if len(a) > 2 and np.ptp(a) else None


def signature(a: np.ndarray, c: np.ndarray, p: Params = DEFAULTS) -> tuple | None:
    """Tilt of the points near the median, tilt of the medians of equal stretches of time, tilts without each of some longer stretches, rank correlation.

    None where too few points are near; a tilt over too few votes or points is none.
    """
    near = np.abs(c - np.median(c)) <= p.signature_trim
    if len(a) < p.signature_points or near.sum() < p.signature_points:
        return None
    a, c = a[near], c[near]
    span = float(np.ptp(a))
    binned, left_out = None, [None] * p.signature_parts
    if span > 0:
        place = (a - a[0]) / span
        own = np.minimum(p.signature_bins - 1, (place * p.signature_bins).astype(int))
        held = np.unique(own)
        if len(held) >= p.signature_votes:
            binned = _tilt(a[0] + (held + 0.5) / p.signature_bins * span, np.array([np.median(c[own == k]) for k in held]))
        part = np.minimum(p.signature_parts - 1, (place * p.signature_parts).astype(int))
        left_out = [_tilt(a[part != k], c[part != k]) if (part != k).sum() >= p.signature_points else None for k in range(p.signature_parts)]
    return _tilt(a, c), binned, left_out, _rho(a, c), len(a)


def drift_signature(points: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``(file_id, tilt, binned, left_out array, rho, n)``: three readings of a steady drift, which noise and single bad stretches do not share."""
    return _fitted(points, lambda a, c: signature(a, c, p), "tilt double, binned double, left_out array<double>, rho double, n long")


def signature_passes(p: Params = DEFAULTS) -> Column:
    """The tilt, where it, the binned one and every one with a stretch left out are large and of one sign; else null."""
    side = F.signum("tilt")
    every = F.forall("left_out", lambda d: F.coalesce(d * side >= p.signature_left_out, F.lit(False)))
    return F.when((F.abs("tilt") >= p.signature_tilt) & (F.col("binned") * side >= p.signature_binned) & every, F.col("tilt"))


def onset_tilt(starts: DataFrame, onsets: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``(file_id, tilt, n)`` from ``starts(file_id, t)`` against ``onsets(file_id, t)``, both in seconds.

    Each start goes to the onset nearest to it plus the running offset, which is the median of the round before, for up to three rounds;
    what is within ``onset_trim`` of the last median gives the tilt. Too few points give none, and ``n`` tells how many there were.
    """

    def run(cues: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        key = cues[KEY].iloc[0] if len(cues) else heard["_f"].iloc[0]
        return pd.DataFrame([(key, *_onset_tilt(np.sort(cues["t"].to_numpy(float)), np.sort(heard["o"].to_numpy(float)), p))], columns=[KEY, "tilt", "n"])

    kind = starts.schema[KEY].dataType.simpleString()
    return starts.select(KEY, "t").groupBy(KEY).cogroup(onsets.select(F.col(KEY).alias("_f"), F.col("t").alias("o")).groupBy("_f")).applyInPandas(run, f"{KEY} {kind}, tilt double, n long")


def _onset_tilt(starts: np.ndarray, onsets: np.ndarray, p: Params) -> tuple[float | None, int]:
    if not len(onsets) or not len(starts):
        return None, 0

    def met(offset: float) -> tuple[np.ndarray, np.ndarray]:
        after = np.searchsorted(onsets, starts + offset)
        both = np.stack([onsets[np.maximum(after - 1, 0)], onsets[np.minimum(after, len(onsets) - 1)]]) - starts
        gap = np.abs(both - offset)
        best = np.where(gap[1] < gap[0], both[1], both[0])
        near = gap.min(0) <= p.onset_reach
        return starts[near], best[near]

    offset, (x, y) = 0.0, met(0.0)
    for _ in range(3):
        if len(x) < p.onset_points or abs(np.median(y) - offset) < 0.05:
            break
        offset = float(np.median(y))
        x, y = met(offset)
    if len(x) < p.onset_points:
        return None, len(x)
    near = np.abs(y - np.median(y)) <= p.onset_trim
    x, y = x[near], y[near]
    if len(x) < p.onset_points:
        return None, len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    near = np.abs(y - np.median(y)) <= p.onset_trim
    return _tilt(x[near][:: p.onset_stride], y[near][:: p.onset_stride]), len(x)


def line_through(points: DataFrame, least: int = 10) -> DataFrame:
    """Least squares and the greatest distance from it."""
    line = points.groupBy(KEY).agg(F.regr_slope("c", "a").alias("slope"), F.regr_intercept("c", "a").alias("intercept"), F.count("*").alias("n")).where(F.col("n") >= least)
    return points.join(line, KEY).groupBy(KEY).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.max(F.abs(F.col("c") - F.col("slope") * F.col("a") - F.col("intercept"))).alias("worst"))


def error_summary(errors: DataFrame, value: str) -> DataFrame:
    """Count, median, nearest-rank 0.9 quantile, and shares within half, one and two seconds of distances."""
    ordered = F.sort_array(F.collect_list(F.abs(F.col(value))))
    out = errors.groupBy(KEY).agg(F.count(value).alias("n"), F.median(F.abs(F.col(value))).alias("p50"), ordered.alias("_v"), *[F.avg((F.abs(F.col(value)) <= lim).cast("double")).alias(name) for lim, name in ((0.5, "within_half"), (1.0, "within_one"), (2.0, "within_two"))])
    return out.withColumn("p90", F.get("_v", F.least(F.col("n") - 1, F.floor(F.col("n") * 0.9)).cast("int"))).drop("_v")


def share_off(points: DataFrame, limit: float, least: int) -> DataFrame:
    """Share of values further off than ``limit``, for files with ``least`` of them."""
    return points.groupBy(KEY).agg(F.avg((F.abs("c") > limit).cast("double")).alias("share"), F.count("*").alias("n")).where(F.col("n") >= least)


def all_or_nothing(values: DataFrame, value: str, limit: float, least: int) -> DataFrame:
    """Rows beyond ``limit``, if a file has ``least`` of them."""
    beyond = values.where(F.abs(F.col(value)) > limit)
    return beyond.withColumn("_n", F.count("*").over(Window.partitionBy(KEY))).where(F.col("_n") >= least).drop("_n")
