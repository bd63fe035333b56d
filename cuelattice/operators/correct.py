"""Corrections of whole files: rates, offsets and stretches read from anchors, each kept only where the corrected times measure well.

Cues are ``(file_id, idx, start, end, text)`` in whole milliseconds, segments the same in seconds. Points are ``(file_id, a, c)``: when a line
is heard and how much later that is than its cue, both in seconds. Fits are ``(file_id, ratio, offset)``: new time = ratio * (time + offset).
A stage returns rows for the files that it corrects and nothing for others, so stages can be tried one after the other by anti-join.
Points and fits that several steps of a stage read are persisted: the joins behind them would otherwise be run, and planned, once for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..params import DEFAULTS, Params
from . import dense, robust, runs
from .intervals import banded_coverage, union
from .retime import apply_plan

KEY = "file_id"
# Bars of a stretch and of an overwhelming one, as `gates_pass` takes them, and the ratios by which a slight drift is undone.
STRETCH = (20, 8.0, 0.90, 0.90, 1.50, 0.40)
OVERWHELMING = (20, 8.0, 0.99, 0.85, 10.0, 0.40)
DRIFT_RATIOS = ((1000 / 1001, "24 -> 23.976"), (1001 / 1000, "23.976 -> 24"))


def spoken(rows: DataFrame, unit: float = 1.0) -> DataFrame:
    """``(file_id, idx, t, toks)`` of cues or segments whose ``start`` counts ``unit`` to the second."""
    return rows.select(KEY, "idx", (F.col("start") / unit).alias("t"), text.tokens(F.col("text")).alias("toks"))


def pool(segments: DataFrame, cues: DataFrame, p: Params = DEFAULTS, before: float = 30.0, after: float = 60.0) -> DataFrame:
    """The points of every line of the transcript that matches a cue, over clips of ``probe_clip`` seconds back to back."""
    met = dense.dense_anchors(spoken(segments), spoken(cues, 1000.0), p.probe_clip, before, after, p)
    return met.select(KEY, F.col("s_t").alias("a"), (F.col("s_t") - F.col("c_t")).alias("c"))


def retimed(cues: DataFrame, fits: DataFrame) -> DataFrame:
    """Cues under their file's fit, never below zero, no end before its start; files without a fit are not there."""
    to = lambda c: F.bround((F.col(c) + F.col("offset") * 1000) * F.col("ratio")).cast("long")
    start = F.greatest(F.lit(0).cast("long"), to("start"))
    moved = cues.join(fits.select(KEY, "ratio", "offset"), KEY)
    return moved.withColumns({"start": start, "end": F.greatest(start, to("end"))}).select(*cues.columns)


def farthest_move(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(file_id, worst)``: the most that a start or end moved, in seconds."""
    n = new.select(KEY, "idx", F.col("start").alias("s1"), F.col("end").alias("e1"))
    apart = F.greatest(F.abs(F.col("s1") - F.col("start")), F.abs(F.col("e1") - F.col("end")))
    return old.join(n, [KEY, "idx"]).groupBy(KEY).agg((F.max(apart) / 1000).alias("worst"))


def quarter_left(points: DataFrame, fits: DataFrame, parts: int = 4, least: int = 5) -> DataFrame:
    """``(file_id, left)``: the largest median that a fit leaves in an equal part of the span with ``least`` points.

    A rate that is right leaves every part quiet; one that fits most of a stepped file leaves its tail. Zero where it cannot be judged.
    """
    placed = points.join(fits.select(KEY, "ratio", "offset"), KEY).select(KEY, "a", (F.col("a") - F.col("ratio") * (F.col("a") - F.col("c") + F.col("offset"))).alias("r"))
    own = Window.partitionBy(KEY)
    spread = placed.withColumns({"lo": F.min("a").over(own), "hi": F.max("a").over(own), "n": F.count("*").over(own)})
    part = F.least(F.lit(parts - 1), F.floor((F.col("a") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts))
    judged = spread.where("n >= 4 and hi > lo").groupBy(KEY, part.alias("part")).agg(F.count("*").alias("k"), F.abs(F.median("r")).alias("m"))
    worst = judged.where(F.col("k") >= least).groupBy(KEY).agg(F.max("m").alias("left"))
    return fits.select(KEY).join(worst, KEY, "left").select(KEY, F.coalesce("left", F.lit(0.0)).alias("left"))


def unclamped(current: DataFrame, baseline: DataFrame, least: int = 10, most: float = 1500.0) -> DataFrame:
    """``current`` with cues that an aligner cut to 0 put where its line through ``baseline`` sends them.

    Cues are compared by their place in ``idx``. Files that have such cues but other numbers of cues, under ``least`` others, or others that are
    not on one line within ``most`` milliseconds, are not there.
    """
    own = Window.partitionBy(KEY)
    n_old = F.count("*").over(own)
    now = current.withColumns({"_k": F.row_number().over(Window.partitionBy(KEY).orderBy("idx")), "_n": n_old})
    was = baseline.select(KEY, F.row_number().over(Window.partitionBy(KEY).orderBy("idx")).alias("_k"), n_old.alias("_m"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    sizes = was.groupBy(KEY).agg(F.first("_m").alias("_m"))
    both = now.join(sizes, KEY, "left").join(was.drop("_m"), [KEY, "_k"], "left").withColumn("same", F.coalesce(F.col("_n") == F.col("_m"), F.lit(False)))
    cut = F.col("same") & (F.col("start") == 0) & (F.col("_s") > 0)
    free = F.col("same") & (F.col("start") > 0) & (F.col("_s") > 0)
    at = lambda c: F.when(free, F.col(c))
    line = both.groupBy(KEY).agg(F.count_if(cut).alias("cut"), F.count_if(free).alias("free"), F.count_if(F.col("start") == 0).alias("zeros"), F.bool_and("same").alias("whole"), F.regr_slope(at("start"), at("_s")).alias("m"), F.regr_intercept(at("start"), at("_s")).alias("b"))
    bent = both.join(line.select(KEY, "m", "b"), KEY).groupBy(KEY).agg(F.max(F.when(free, F.abs(F.col("m") * F.col("_s") + F.col("b") - F.col("start")))).alias("bend"))
    straight = (F.col("free") >= least) & F.col("m").isNotNull() & (F.col("bend") <= most)
    usable = line.join(bent, KEY).where(F.when(~F.col("whole"), F.col("zeros") < 3).otherwise((F.col("cut") == 0) | straight)).select(KEY, "m", "b")
    put = lambda c: F.bround(F.col("m") * F.col(c) + F.col("b")).cast("long")
    out = both.join(usable, KEY)
    return out.withColumns({"start": F.when(cut, put("_s")).otherwise(F.col("start")), "end": F.when(cut, put("_e")).otherwise(F.col("end"))}).select(*current.columns)


def fits_of(probes: DataFrame) -> DataFrame:
    return probes.select(KEY, robust.stretch_ratio(F.col("slope")).alias("ratio"), F.col("intercept").alias("offset"))


def worthwhile(points: DataFrame, cues: DataFrame, fits: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``(file_id, ratio, offset, left, worst)`` of fits that leave every quarter quiet and move some cue by ``min_change`` or more."""
    measured = fits.join(quarter_left(points, fits), KEY).join(farthest_move(cues, retimed(cues, fits)), KEY)
    return measured.where((F.col("left") <= p.quarter_most) & (F.col("worst") >= p.min_change)).select(KEY, "ratio", "offset", "left", "worst")


def stretch_fixes(points: DataFrame, cues: DataFrame, baseline: DataFrame | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Files off by one large rate, by the rate and offset measured; with ``baseline`` cut cues are put back first or the file is left."""
    fits = fits_of(robust.stretch_probe(points, p).where(robust.gates_pass(*STRETCH))).persist()
    return worthwhile(points, cues if baseline is None else unclamped(cues, baseline), fits, p)


def rescued_ramps(points: DataFrame, cues: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """As :func:`stretch_fixes`, but an overwhelming line needs less of the pool; ``points`` are those of full coverage."""
    probes = robust.stretch_probe(points, p).where(robust.gates_pass(*STRETCH) | robust.gates_pass(*OVERWHELMING)).persist()
    return worthwhile(points, cues, fits_of(probes), p).join(probes.select(KEY, "slope"), KEY)


def shows_ramp(files: DataFrame, probes: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """``files(file_id, ramp)`` with ``shown``: false only where some probe is flat or has another rate, and none has this one.

    ``probes`` are those of the file's untouched versions; a null ``ramp`` takes any rate. A rate that only an aligner's output has is its own.
    """
    ramp = (robust.gate_level() > 0) | robust.gates_pass(*STRETCH) | robust.gates_pass(*OVERWHELMING)
    near = F.col("ramp").isNull() | (F.abs(F.col("slope") - F.col("ramp")) <= tolerance)
    flat = (F.col("keep_frac") >= DEFAULTS.rate_keep) & (F.abs("tilt") < robust.FLAT[0])
    seen = files.join(probes, KEY).groupBy(KEY).agg(F.bool_or(ramp & near).alias("yes"), F.bool_or((ramp & ~near) | (~ramp & flat)).alias("no"))
    return files.join(seen, KEY, "left").select(KEY, F.coalesce(F.col("yes") | ~F.col("no"), F.lit(True)).alias("shown"))


def condemning(samples: DataFrame, files: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``samples(file_id, idx, shift, score)`` that condemn a file: enough far shifts, else lone huge ones in a file of blocks.

    ``files(file_id, full, winner, spread)``: dense evidence needs ``condemn_dense`` far shifts, unless blocks are proven (a resolved
    ``winner`` other than ``new``), else ``condemn_sparse``. A lone one must be in a clip whose text agrees.
    """
    dense_here = F.col("full") & F.coalesce(F.col("winner") == "new", F.lit(True))
    bar = F.when(dense_here, p.condemn_dense).otherwise(p.condemn_sparse)
    far = F.coalesce(F.abs("shift") > p.condemn_shift, F.lit(False))
    many = F.count_if(far).over(Window.partitionBy(KEY)) >= bar
    blocks = F.coalesce((F.col("spread") >= p.condemn_spread) & F.coalesce(F.col("winner") == "blocks", F.lit(True)), F.lit(False))
    lone = blocks & (F.abs("shift") >= p.condemn_lone) & (F.col("score") >= p.overlap_least)
    judged = samples.join(files, KEY).withColumn("_many", many)
    return judged.where(F.when(F.col("_many"), far).otherwise(F.coalesce(lone, F.lit(False)))).select(*samples.columns)


def resync_residuals(cuts: DataFrame, after: DataFrame, clip: float, p: Params = DEFAULTS) -> DataFrame:
    """``(file_id, candidate, residual)`` of plans that hold: their mean remaining shift.

    ``cuts(file_id, candidate, cut)`` are the plan's borders in audio time, ``after(file_id, candidate, t, shift)`` the anchors of the
    corrected cues. Anchors within ``clip`` of a border say nothing. A plan falls where ``condemn_dense`` of the others are still far
    off, where none is left, or where a region of more than two clips has none, since nothing measured it.
    """
    both = [KEY, "candidate"]
    c = cuts.select(F.col(KEY).alias("_f"), F.col("candidate").alias("_c"), "cut")
    astride = (F.col(KEY) == F.col("_f")) & (F.col("candidate") == F.col("_c")) & F.col("cut").between(F.col("t") - clip, F.col("t") + clip)
    clean = after.where("shift is not null").join(c, astride, "left_anti")
    sums = clean.groupBy(both).agg(F.avg(F.abs("shift")).alias("residual"), F.count_if(F.abs("shift") > p.condemn_shift).alias("far")).where(F.col("far") < p.condemn_dense)
    w = Window.partitionBy(both).orderBy("cut")
    ends = cuts.select(*both, F.lag("cut").over(w).alias("lo"), F.col("cut").alias("hi"))
    last = cuts.groupBy(both).agg(F.max("cut").alias("lo")).select(*both, "lo", F.lit(None).cast("double").alias("hi"))
    # an open side is as wide as can be
    wide = ends.unionByName(last).where("lo is null or hi is null or hi - lo > " + repr(2.0 * clip)).select(F.col(KEY).alias("_f"), F.col("candidate").alias("_c"), "lo", "hi")
    inside = (F.col(KEY) == F.col("_f")) & (F.col("candidate") == F.col("_c")) & F.coalesce(F.col("t") >= F.col("lo"), F.lit(True)) & F.coalesce(F.col("t") < F.col("hi"), F.lit(True))
    bare = wide.join(clean, inside, "left_anti").select(F.col("_f").alias(KEY), F.col("_c").alias("candidate")).distinct()
    return sums.join(bare, both, "left_anti").select(*both, "residual")


def best_candidate(residuals: DataFrame) -> DataFrame:
    """The candidate of the least residual; of equals the first by name."""
    return residuals.groupBy(KEY).agg(F.min_by(F.struct("candidate", "residual"), F.struct("residual", "candidate")).alias("b")).select(KEY, "b.candidate", "b.residual")


def drift_fixes(points: DataFrame, cues: DataFrame, onset: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Files off by one part in a thousand, where two measurements agree on the side: anchors and ``onset(file_id, tilt)``.

    ``points`` are those of files whose content was found right by full evidence. ``name`` tells which conversion is undone.
    """
    calm = robust.median_mad(points, "c", p.signature_points).where(F.col("mad") <= p.drift_spread).select(KEY)
    leaning = robust.drift_signature(points.join(calm, KEY, "left_semi"), p).select(KEY, robust.signature_passes(p).alias("lean")).where("lean is not null")
    agreed = leaning.join(onset.select(KEY, "tilt"), KEY).where((F.abs("tilt") >= p.drift_onset) & (F.signum("tilt") == F.signum("lean")))
    (down, down_name), (up, up_name) = DRIFT_RATIOS
    late = F.col("lean") > 0
    fits = agreed.select(KEY, F.when(late, up).otherwise(down).alias("ratio"), F.lit(0.0).alias("offset"), F.when(late, up_name).otherwise(down_name).alias("name")).persist()
    return worthwhile(points, cues, fits.drop("name"), p).join(fits.select(KEY, "name"), KEY)


def _flat_now(segments: DataFrame, current: DataFrame, files: DataFrame, p: Params) -> DataFrame:
    """Files whose current times differ from the baseline's, are no fit in blocks, and are tightly flat already."""
    asked = current.join(files.where("changed and not over_blocks"), KEY, "left_semi")
    return robust.stretch_probe(pool(segments, asked, p), p).where(robust.is_flat(True)).select(KEY)


def rate_fixes(segments: DataFrame, baseline: DataFrame, current: DataFrame, files: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``(file_id, ratio, offset, name, worst, weak)``: rates read from the untouched file over the full transcript.

    ``files(file_id, changed, over_blocks)``. The first fit only matches while its offset is inside the window, so the file is measured
    again from there, and the second fit is taken where it keeps about as much of the pool. What comes out must be flat, tightly where
    the evidence was weak. Files that are flat as they are now are left.
    """
    points = pool(segments, baseline, p).persist()
    rated = robust.stretch_probe(points, p).withColumn("level", robust.gate_level()).where("level > 0")
    probes = rated.join(_flat_now(segments, current, files, p), KEY, "left_anti").persist()
    first = robust.snap_rate(points, probes, p).persist()
    again = pool(segments, retimed(baseline, first), p).join(first.select(KEY, "ratio", "offset"), KEY)
    mapped = again.select(KEY, "a", (F.col("a") - ((F.col("a") - F.col("c")) / F.col("ratio") - F.col("offset"))).alias("c")).persist()
    second = robust.stretch_probe(mapped, p).where(robust.gate_level() > 0).join(probes.select(KEY, F.col("keep_frac").alias("_k")), KEY).where(F.col("keep_frac") >= F.col("_k") - 0.05).drop("_k")
    better = robust.snap_rate(mapped, second, p).persist()
    fits = better.unionByName(first.join(better.select(KEY), KEY, "left_anti")).persist()
    fixed = retimed(baseline, fits)
    after = robust.stretch_probe(pool(segments, fixed, p), p).select(KEY, robust.is_flat().alias("flat"), robust.is_flat(True).alias("tight"))
    judged = fits.join(after, KEY).join(probes.select(KEY, (F.col("level") == 1).alias("weak")), KEY).join(farthest_move(baseline, fixed), KEY)
    return judged.where(F.when(F.col("weak"), F.col("tight")).otherwise(F.col("flat")) & (F.col("worst") >= p.min_change)).select(KEY, "ratio", "offset", "name", "worst", "weak")


def offset_fixes(segments: DataFrame, baseline: DataFrame, current: DataFrame, files: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``(file_id, ratio, offset, worst)``: one steady offset of the untouched file, which covers most of the audio and is centred afterwards."""
    level = (F.col("keep_frac") >= p.rate_keep) & (F.abs("tilt") < robust.FLAT[0])
    points = pool(segments, baseline, p).persist()
    probes = robust.stretch_probe(points, p).where(level & (robust.gate_level() == 0) & (F.col("n_raw") >= p.offset_points) & (F.col("resid") <= p.offset_resid))
    length = segments.groupBy(KEY).agg(F.max("end").alias("length"))
    middle = robust.median_mad(points, "c").where(F.abs("med") >= p.offset_least).select(KEY, F.col("med").alias("offset"))
    wide = probes.join(length, KEY).where((F.col("length") > 0) & (F.col("span") >= p.offset_cover * F.col("length")))
    fits = wide.join(middle, KEY).join(_flat_now(segments, current, files, p), KEY, "left_anti").select(KEY, F.lit(1.0).alias("ratio"), "offset").persist()
    fixed = retimed(baseline, fits)
    left = pool(segments, fixed, p).persist()
    centred = robust.median_mad(left, "c", p.offset_points).where(F.abs("med") <= p.offset_after).select(KEY)
    after = robust.stretch_probe(left, p).where(level).join(centred, KEY, "left_semi").select(KEY)
    return fits.join(after, KEY, "left_semi").join(farthest_move(baseline, fixed), KEY).where(F.col("worst") >= p.min_change)


def heard_runs(found: DataFrame, cues: DataFrame, speech: DataFrame, width: int = 60_000, around: int = 5_000) -> DataFrame:
    """Runs of :func:`runs.deviant_runs` whose cues meet more speech when moved by ``dev``; files without speech keep all of theirs.

    ``speech(file_id, start, end)`` is in milliseconds. A transcriber's own times drift for a minute at a time; the speech pattern decides.
    """
    r = found.select(F.col(KEY).alias("_f"), "run", "cue_from", "cue_to", F.bround(F.col("dev") * 1000).cast("long").alias("by"))
    own = (F.col(KEY) == F.col("_f")) & F.col("start").between(F.col("cue_from") * 1000 - around, F.col("cue_to") * 1000 + around)
    shown = cues.join(r, own).select(KEY, "run", "start", "end", F.explode(F.array(F.struct(F.lit(False).alias("moved"), F.lit(0).cast("long").alias("d")), F.struct(F.lit(True).alias("moved"), F.col("by").alias("d")))).alias("x"))
    windows = shown.select(KEY, "run", "x.moved", (F.col("start") + F.col("x.d")).alias("lo"), (F.col("end") + F.col("x.d")).alias("hi"))
    met = windows.join(banded_coverage(windows.select(KEY, "lo", "hi").distinct(), union(speech), width), [KEY, "lo", "hi"])
    sums = met.groupBy(KEY, "run").agg(F.sum(F.when(F.col("moved"), F.col("covered"))).alias("there"), F.sum(F.when(~F.col("moved"), F.col("covered"))).alias("here"))
    sure = sums.where("there > here").select(KEY, "run")
    deaf = found.join(speech.select(KEY).distinct(), KEY, "left_anti")
    return found.join(sure, [KEY, "run"], "left_semi").unionByName(deaf)


def block_runs(segments: DataFrame, cues: DataFrame, speech: DataFrame, proven: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Runs of lines at another offset than their file's, confirmed by speech; files in ``proven(file_id)`` had a block, so short runs count where no long one is."""
    points = pool(segments, cues, p, p.run_reach, p.run_reach).groupBy(KEY, "a").agg(F.max("c").alias("c")).withColumn("idx", F.lit(0)).persist()
    long_runs = runs.deviant_runs(points, p.run_k, p.run_dev, p.run_mad).persist()
    rest = points.join(proven.select(KEY), KEY, "left_semi").join(long_runs.select(KEY).distinct(), KEY, "left_anti")
    found = long_runs.unionByName(runs.deviant_runs(rest, p.short_run_k, p.short_run_dev, p.short_run_mad)).withColumn("dev", F.round("dev", 2)).persist()
    return heard_runs(found, cues, speech)


def run_plan(found: DataFrame, cues: DataFrame, segments: DataFrame) -> DataFrame:
    """``(file_id, lo, hi, by)`` in milliseconds: each run's cues by its deviation, with edges halfway to the neighbouring cues.

    A run that lasts to the end of the audio takes all cues after it; files whose runs overlap have no plan.
    """
    r = found.select(KEY, "run", "cue_from", "cue_to", "to_a", F.bround(F.col("dev") * 1000).cast("long").alias("by"))
    met = r.join(cues.select(KEY, "start", "end"), KEY)
    lo, hi = F.col("cue_from") * 1000 - 1, F.col("cue_to") * 1000 + 1
    last_before = lambda c: F.max_by("end", F.when(c, F.col("start")))
    sides = met.groupBy(KEY, "run", "cue_from", "to_a", "by").agg(last_before(F.col("start") < lo).alias("e0"), F.min(F.when(F.col("start") >= lo, F.col("start"))).alias("s0"), last_before(F.col("start") <= hi).alias("e1"), F.min(F.when(F.col("start") > hi, F.col("start"))).alias("s1"))
    audio = segments.groupBy(KEY).agg(F.max("end").alias("length"))
    edged = sides.join(audio, KEY, "left").select(KEY, "cue_from", "by", F.coalesce((F.col("e0") + F.col("s0")) / 2, F.col("s0").cast("double")).alias("lo"), F.when(F.col("to_a") >= F.coalesce("length", F.lit(0.0)) - 5, float("inf")).otherwise(F.coalesce((F.col("e1") + F.col("s1")) / 2, F.lit(float("inf")))).alias("hi"))
    w = Window.partitionBy(KEY).orderBy("cue_from")
    clash = edged.withColumn("_x", F.coalesce(F.col("lo") < F.lag("hi").over(w), F.lit(False))).withColumn("_bad", F.bool_or("_x").over(Window.partitionBy(KEY)))
    return clash.where("not _bad").select(KEY, "lo", "hi", "by")


def repaired_runs(segments: DataFrame, cues: DataFrame, speech: DataFrame, proven: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Cues of files whose runs were moved into place: no run is left and the lines are no farther off than before; other files are not there."""
    found = block_runs(segments, cues, speech, proven, p).persist()
    near = found.groupBy(KEY).agg(F.max(F.abs("dev")).alias("far")).where(F.col("far") <= p.run_repair_most).select(KEY)
    plan = run_plan(found.join(near, KEY, "left_semi"), cues, segments).persist()
    files = plan.select(KEY).distinct()
    fixed = apply_plan(cues.join(files, KEY, "left_semi"), plan).persist()
    still = block_runs(segments, fixed, speech, files, p).select(KEY).distinct()
    off = lambda c, name: pool(segments, c, p).groupBy(KEY).agg(F.median(F.abs("c")).alias(name))
    level = files.join(off(cues, "before"), KEY, "left").join(off(fixed, "after"), KEY, "left")
    no_worse = level.where("before is null or after <= before").select(KEY)
    return fixed.join(still, KEY, "left_anti").join(no_worse, KEY, "left_semi")


def clip_tilt(clips: DataFrame, lengths: DataFrame, least: int = 3, cover: float = 0.6) -> DataFrame:
    """``clips(file_id, start, shift)`` that span most of the file: how far shifts walk from its start to its end."""
    points = clips.where("shift is not null").select(KEY, F.col("start").alias("a"), F.col("shift").alias("c"))
    span = points.groupBy(KEY).agg((F.max("a") - F.min("a")).alias("span")).join(lengths.select(KEY, "duration"), KEY).where((F.col("duration") > 0) & (F.col("span") > 0) & (F.col("span") >= cover * F.col("duration")))
    return robust.theil_sen(points.join(span, KEY, "left_semi"), least).join(span, KEY).select(KEY, (F.col("tilt") / F.col("span") * F.col("duration")).alias("walk"))


def leans_like_a_rate(tilt: float = 1.5, rho: float = 0.6, keep: float = 0.8) -> Column:
    """Whether a sampled pool's probe leans enough for full evidence."""
    return F.coalesce((F.abs("tilt") >= tilt) & (F.abs("rho") >= rho) & (F.col("keep_frac") >= keep), F.lit(False))


def undone(before: DataFrame, after: DataFrame, files: DataFrame, p: Params = DEFAULTS, margin: float = 0.15) -> DataFrame:
    """``files(file_id, status, rate, reason)`` with ``off_before``, ``off_after`` and ``why`` a rewrite is taken back: wrong_file, worse or null.

    ``before`` and ``after`` are points; shares of far lines are compared on the span that the untouched file's points have, since a
    drifted file only matches early on. A rate on a file that is judged the wrong one explained nothing.
    """
    span = before.groupBy(KEY).agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    share = lambda pts, name: robust.share_off(pts, p.condemn_shift, p.share_off_points).select(KEY, F.col("share").alias(name))
    same = after.join(span, KEY).where("a between lo and hi").select(KEY, "a", "c")
    rated = files.join(share(before, "off_before"), KEY, "left").join(share(same, "off_after"), KEY, "left")
    wrong = F.col("rate").isNotNull() & (F.col("reason") == "wrong_subtitle")
    why = F.when(wrong, "wrong_file").when(F.col("off_after") > F.col("off_before") + margin, "worse")
    return rated.select(*files.columns, "off_before", "off_after", F.when(F.col("status").startswith("fixed"), why).alias("why"))
