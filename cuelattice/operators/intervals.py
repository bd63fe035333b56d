"""Interval algebra over ordered sequences. Frames are keyed by ``file_id``; times are any ordered number named ``start`` and ``end``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params

KEY = "file_id"


def _ordered(*order: str):  # noqa: ANN202
    return Window.partitionBy(KEY).orderBy(*order)


def gaps(cues: DataFrame, min_gap: float) -> DataFrame:
    """Stretches of ``min_gap`` or more between the furthest end so far and the next start; nested cues do not shorten them."""
    before = _ordered("start", "end", "idx").rowsBetween(Window.unboundedPreceding, -1)
    seen = cues.withColumn("g0", F.max("end").over(before))
    return seen.where(F.col("start") - F.col("g0") >= min_gap).select(KEY, "g0", F.col("start").alias("g1"))


def all_gaps(cues: DataFrame, lengths: DataFrame, min_gap: float, edge: float, edge_share: float) -> DataFrame:
    """Inner gaps with the stretch before the first cue and after the last, clipped to what lies inside the edges."""
    ends = cues.groupBy(KEY).agg(F.min("start").alias("first"), F.max("end").alias("last")).join(lengths, KEY)
    head = ends.select(KEY, F.lit(0).cast("long").alias("g0"), F.col("first").alias("g1"))
    tail = ends.select(KEY, F.col("last").alias("g0"), F.col("duration").alias("g1"))
    every = gaps(cues, min_gap).unionByName(head).unionByName(tail).join(lengths, KEY)
    margin = F.least(F.lit(edge), F.col("duration") * edge_share)
    clipped = every.select(KEY, F.greatest("g0", margin).alias("g0"), F.least("g1", F.col("duration") - margin).alias("g1"))
    return clipped.where(F.col("g1") - F.col("g0") >= min_gap)


def islands(spans: DataFrame, touch: float = 0) -> DataFrame:
    """``spans`` with ``island``: a number that grows where a span starts more than ``touch`` after all before it ended."""
    w = _ordered("start", "end")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.col("start") - F.max("end").over(before) > touch).cast("int"), F.lit(1))
    return spans.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def union(spans: DataFrame, touch: float = 0) -> DataFrame:
    """Disjoint spans that cover the same; those that touch are one."""
    return islands(spans, touch).groupBy(KEY, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def complement(spans: DataFrame, lengths: DataFrame, pad: float = 0, least: float = 0) -> DataFrame:
    """What the spans leave of ``[0, duration]``, moved inward by ``pad``, without pieces shorter than ``least``."""
    zero = F.lit(0).cast("long")
    joined = lengths.join(union(spans), KEY, "left")
    w = Window.partitionBy(KEY).orderBy("start")
    inner = joined.where("start is not null").select(KEY, F.col("end").alias("r0"), F.coalesce(F.lead("start").over(w), F.col("duration")).alias("r1"))
    head = joined.groupBy(KEY).agg(F.coalesce(F.min("start"), F.first("duration")).alias("r1")).select(KEY, zero.alias("r0"), "r1")
    every = inner.unionByName(head).select(KEY, (F.col("r0") + pad).alias("start"), (F.col("r1") - pad).alias("end"))
    return every.where(F.col("end") - F.col("start") >= F.lit(least)).where("end > start")


def coverage(windows: DataFrame, spans: DataFrame) -> DataFrame:
    """``windows(file_id, lo, hi)`` with ``covered``: the summed overlap with the file's spans."""
    meet = (F.col("s.end") > F.col("w.lo")) & (F.col("s.start") < F.col("w.hi")) & (F.col("s.file_id") == F.col("w.file_id"))
    part = F.when(F.col("s.start").isNotNull(), F.least("s.end", "w.hi") - F.greatest("s.start", "w.lo"))
    return windows.alias("w").join(spans.alias("s"), meet, "left").groupBy("w.file_id", "w.lo", "w.hi").agg(F.coalesce(F.sum(part), F.lit(0)).alias("covered"))


def banded_coverage(windows: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """:func:`coverage` for files so long that one key is too much: both sides are dealt by time band as well, and each pair is met once."""
    band = lambda c: F.floor(F.col(c) / width).cast("long")
    w = windows.select(F.col(KEY).alias("_f"), "lo", "hi", F.explode(F.sequence(band("lo"), band("hi"))).alias("_b"))
    s = spans.select(KEY, "start", "end", F.explode(F.sequence(band("start"), band("end"))).alias("band"))
    met = w.join(s, (F.col(KEY) == F.col("_f")) & (F.col("_b") == F.col("band")) & (F.col("end") > F.col("lo")) & (F.col("start") < F.col("hi")))
    once = F.greatest(band("start"), band("lo")) == F.col("band")
    sums = met.where(once).groupBy(KEY, "lo", "hi").agg(F.sum(F.least("end", "hi") - F.greatest("start", "lo")).alias("covered"))
    return windows.join(sums, [KEY, "lo", "hi"], "left").select(KEY, "lo", "hi", F.coalesce("covered", F.lit(0)).alias("covered"))


def gap_speech(gap_rows: DataFrame, segments: DataFrame, music: DataFrame, margin: float, trail: float) -> DataFrame:
    """Seconds of speech that overlap each gap and words of speech that start in it, without what padded music covers."""
    m = music.select(F.col(KEY).alias("_f"), (F.col("start") - margin).alias("m0"), (F.col("end") + trail).alias("m1"))
    spoken = segments.join(m, (F.col(KEY) == F.col("_f")) & (F.col("start") < F.col("m1")) & (F.col("end") > F.col("m0")), "left_anti")
    s, g = spoken.alias("s"), gap_rows.alias("g")
    near = (F.col("s.file_id") == F.col("g.file_id")) & (F.col("s.end") > F.col("g.g0")) & (F.col("s.start") < F.col("g.g1"))
    inside = (F.col("s.start") >= F.col("g.g0")) & (F.col("s.start") < F.col("g.g1"))
    return g.join(s, near, "left").groupBy("g.file_id", "g.g0", "g.g1").agg(F.coalesce(F.sum(F.when(F.col("s.start").isNotNull(), F.least("s.end", "g.g1") - F.greatest("s.start", "g.g0"))), F.lit(0)).alias("speech"), F.coalesce(F.sum(F.when(inside, F.col("s.words"))), F.lit(0)).alias("words"))


def densest(cues: DataFrame, window: int, weight: Column) -> DataFrame:
    """The start whose following ``window`` holds most weight, the first of equals, for each file."""
    ahead = Window.partitionBy(KEY).orderBy("start").rangeBetween(0, window - 1)
    best = Window.partitionBy(KEY).orderBy(F.desc("held"), "start", "idx")
    return cues.withColumn("held", F.sum(weight).over(ahead)).withColumn("_r", F.row_number().over(best)).where("_r = 1").select(KEY, "start", "held")


def cut_point(cues: DataFrame) -> DataFrame:
    """The middle of the widest pause between neighbours, the first of equals."""
    w = _ordered("start", "idx")
    pause = cues.withColumn("next", F.lead("start").over(w)).where("next is not null").withColumn("pause", F.col("next") - F.col("end"))
    best = Window.partitionBy(KEY).orderBy(F.desc("pause"), "start", "idx")
    return pause.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(KEY, ((F.col("end") + F.col("next")) / 2).alias("cut"), "pause")


def tiles(spans: DataFrame, size: int) -> DataFrame:
    """Windows back to back over each span ``g0..g1``; the last may be shorter."""
    starts = F.explode(F.sequence(F.col("g0"), F.col("g1") - 1, F.lit(size).cast("long")))
    return spans.where("g1 > g0").withColumn("lo", starts).select(KEY, "lo", F.least(F.col("lo") + size, F.col("g1")).alias("hi"))


def slots(spans: DataFrame, step: int) -> DataFrame:
    """Fixed slots that the spans touch, each once."""
    own = F.explode(F.sequence(F.floor(F.col("start") / step).cast("long"), F.floor((F.col("end") - 1) / step).cast("long")))
    return spans.where("end > start").select(KEY, own.alias("slot")).distinct()


def slot_runs(spans: DataFrame, step: int, width: int) -> DataFrame:
    """``(file_id, band, a, b)``: the fixed slots that the spans touch, each once, as runs ``[a, b)`` that end at the borders of bands of ``width`` slots."""
    a, b = F.floor(F.col("start") / step).cast("long"), F.floor((F.col("end") - 1) / step).cast("long") + 1
    band = F.explode(F.sequence(F.floor(F.col("a") / width).cast("long"), F.floor((F.col("b") - 1) / width).cast("long")))
    cut = spans.where("end > start").select(KEY, a.alias("a"), b.alias("b")).select(KEY, "a", "b", band.alias("band")).select(KEY, "band", F.greatest("a", F.col("band") * width).alias("a"), F.least("b", (F.col("band") + 1) * width).alias("b"))
    w = Window.partitionBy(KEY, "band").orderBy("a", "b")
    new = F.coalesce((F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    runs = cut.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(KEY, "band", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_run")


def slot_score(cues: DataFrame, speech: DataFrame, step: int, shifts: list[int]) -> DataFrame:
    """For each shift (in slots): slots of shifted cues on speech less those on silence.

    Slots are counted as runs, and only sums of a file leave a task: neither slots nor shifts become rows before.
    """
    width = max(240, *map(abs, shifts))
    shown = slot_runs(cues, step, width)
    heard = slot_runs(speech, step, width).select(F.col(KEY).alias("_f"), F.col("a").alias("s0"), F.col("b").alias("s1"), F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("_b"))
    least, most = min(shifts), max(shifts)
    near = (F.col(KEY) == F.col("_f")) & (F.col("band") == F.col("_b")) & (F.col("s0") < F.col("b") + most) & (F.col("s1") > F.col("a") + least)
    met = shown.join(heard, near)
    on = [F.sum(F.greatest(F.least(F.col("b") + h, F.col("s1")) - F.greatest(F.col("a") + h, F.col("s0")), F.lit(0))) for h in shifts]
    names = [f"_h{k}" for k in range(len(shifts))]
    sums = met.groupBy(KEY).agg(*[c.alias(n) for c, n in zip(on, names, strict=True)])
    every = shown.groupBy(KEY).agg(F.sum(F.col("b") - F.col("a")).alias("_all")).join(sums.withColumnRenamed(KEY, "_f"), F.col(KEY).eqNullSafe(F.col("_f")), "left")
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("shift"), (2 * F.coalesce(F.col(n), F.lit(0)) - F.col("_all")).cast("long").alias("score")) for h, n in zip(shifts, names, strict=True)]))
    return every.select(KEY, each.alias("_s")).select(KEY, "_s.shift", "_s.score")


def best_shift(scores: DataFrame) -> DataFrame:
    """The shift of the best score; of equals the one nearest to none, then the lower."""
    best = Window.partitionBy(KEY).orderBy(F.desc("score"), F.abs("shift"), "shift")
    return scores.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(KEY, "shift", "score")


def valid_spans(spans: DataFrame) -> DataFrame:
    return spans.where((F.col("end") > F.col("start")) & (F.col("start") >= 0))


def position_shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Greatest and mean shift of starts by position, over what both have, and both lengths."""
    w = _ordered("start", "idx")
    a = old.select(KEY, F.row_number().over(w).alias("n"), F.col("start").alias("s0"))
    b = new.select(KEY, F.row_number().over(w).alias("n"), F.col("start").alias("s1"))
    both = a.join(b, [KEY, "n"], "full")
    apart = F.abs(F.col("s1") - F.col("s0"))
    return both.groupBy(KEY).agg(F.max(apart).alias("max_shift"), F.avg(apart).alias("mean_shift"), F.count("s0").alias("n_old"), F.count("s1").alias("n_new"))


def nearest(points: DataFrame, onsets: DataFrame, reach: float) -> DataFrame:
    """``points(file_id, idx, t)`` with the nearest onset within ``reach``; of two as near, the earlier."""
    both = points.select(KEY, "idx", "t", F.lit(None).cast("long").alias("o")).unionByName(onsets.select(KEY, F.lit(None).cast("long").alias("idx"), F.col("t"), F.col("t").alias("o")))
    w = Window.partitionBy(KEY).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    v = Window.partitionBy(KEY).orderBy("t").rangeBetween(0, Window.unboundedFollowing)
    seen = both.withColumn("before", F.max("o").over(w)).withColumn("after", F.min("o").over(v)).where("idx is not null")
    pick = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull(), F.col("before")).when(F.col("t") - F.col("before") <= F.col("after") - F.col("t"), F.col("before")).otherwise(F.col("after"))
    return seen.withColumn("onset", pick).where(F.abs(F.col("onset") - F.col("t")) <= reach).select(KEY, "idx", "t", "onset")


#: Windows whose shifts are scored together.
SCORED_WINDOWS = 512


def window_shifts(cues: DataFrame, speech: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``(file_id, w, best, gain)`` of each window of cues: the shift at which they meet most speech and least silence, and what it gains.

    Windows of ``witness_window`` seconds start every half of that; those with fewer than ``witness_cues`` cues are left out. Speech is dealt
    to the windows whose search it may meet, so a long file is many rows; a window is one row with its cues and speech, and a task scores many
    windows at once. ``gain`` is a share of the cues' time; of equal scores the later shift wins.
    """
    half, pad = p.witness_window / 2, p.witness_reach + 5.0
    place = lambda t: F.floor(t / half).cast("long")
    times = lambda a, b, name: F.collect_list(F.struct(F.coalesce(F.col(a).cast("double"), F.lit(float("nan"))).alias("a"), F.coalesce(F.col(b).cast("double"), F.lit(float("nan"))).alias("b"))).alias(name)
    lines = cues.select(KEY, "start", "end", F.explode(F.array(place(F.col("start")) - 1, place(F.col("start")))).alias("w")).where("w >= 0")
    heard = speech.select(F.col(KEY).alias("_f"), F.col("start").alias("s0"), F.col("end").alias("s1"), F.explode(F.sequence(place(F.col("start") - p.witness_window - pad) - 1, place(F.col("end") + pad) + 1)).alias("_w")).where("_w >= 0")
    own = lines.groupBy(KEY, "w").agg(times("start", "end", "own")).where(F.size("own") >= p.witness_cues)
    said = heard.groupBy("_f", "_w").agg(times("s0", "s1", "said"))
    rows = own.join(said, F.col(KEY).eqNullSafe(F.col("_f")) & (F.col("w") == F.col("_w")), "left").select(KEY, "w", "own", F.coalesce("said", F.expr("cast(array() as array<struct<a: double, b: double>>)")).alias("said"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SCORED_WINDOWS):
                part = batch.slice(k, SCORED_WINDOWS)
                best, gain = _best_shifts(*_spans_of(part["own"]), *_spans_of(part["said"]), part["w"].to_numpy() * half - pad, p)
                yield pa.RecordBatch.from_arrays([part[KEY], part["w"], pa.array(best), pa.array(gain)], names=[KEY, "w", "best", "gain"])

    kind = cues.schema[KEY].dataType.simpleString()
    return rows.mapInArrow(run, f"{KEY} {kind}, w long, best double, gain double")


def _spans_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of all rows below each other, and the row of each."""
    flat = lists.flatten()
    return np.column_stack([flat.field(k).to_numpy(zero_copy_only=False) for k in range(2)]), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _best_shifts(cues: np.ndarray, owner: np.ndarray, speech: np.ndarray, heard_by: np.ndarray, t0: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The best shift and its gain for each window: ``owner`` and ``heard_by`` tell whose a span is, ``t0`` where each window's search starts."""
    n = int((p.witness_window + 2 * p.witness_reach + 10.0) / p.witness_step)
    # a window's slots lie after those of the windows before it, so that one running count serves all
    slot = lambda t, w: np.clip(((t - t0[w]) / p.witness_step).astype(int), 0, n) + w * (n + 1)
    edges = np.zeros(len(t0) * (n + 1) + 1, int)
    first = slot(speech[:, 0], heard_by)
    np.add.at(edges, first, 1)
    np.add.at(edges, np.maximum(slot(speech[:, 1], heard_by), first), -1)
    # whatever starts in a window ends in it, at its last slot at most, so the running count is none where the next begins
    said = np.concatenate(([0], np.cumsum(np.where(np.cumsum(edges[:-1]) > 0, 1, -1))))
    order = np.lexsort((cues[:, 0], owner))
    cues, owner = cues[order], owner[order]
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))

    def score(shift: float) -> np.ndarray:
        lo, hi = slot(cues[:, 0] + shift, owner), slot(cues[:, 1] + shift, owner)
        ended = np.concatenate(([0], np.maximum.accumulate(hi)[:-1]))
        lo = np.maximum(lo, ended)
        return np.add.reduceat(said[np.maximum(hi, lo)] - said[lo], starts)

    shifts = np.arange(-int(2 * p.witness_reach), int(2 * p.witness_reach) + 1) * 0.5
    most, best, unmoved = np.full(len(t0), np.iinfo(int).min), np.zeros(len(t0)), score(0.0)
    for shift in shifts.tolist():
        now = score(shift)
        best, most = np.where(now >= most, shift, best), np.maximum(now, most)
    return best, (most - unmoved) / np.maximum(np.add.reduceat(cues[:, 1] - cues[:, 0], starts) / p.witness_step, 1.0)


def block_witness(cues: DataFrame, speech: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``(file_id, witness)``: whether speech alone hints at a moved block.

    Two windows in a row agree on a shift of two seconds or more that gains a quarter and is not at the edge of the search, or one window gains
    0.3 at ten seconds or less.
    """
    w = Window.partitionBy(KEY).orderBy("w")
    hits = window_shifts(cues, speech, p).withColumn("s", F.when((F.abs("best") >= 2.0) & (F.col("gain") >= 0.25), F.col("best")))
    pair = (F.abs(F.col("s") - F.lead("s").over(w)) <= 1.0) & (F.abs("s") <= p.witness_reach - 5.0) & (F.lead("w").over(w) - F.col("w") == 1)
    lone = (F.abs("s") <= 10.0) & (F.col("gain") >= 0.3)
    found = hits.select(KEY, F.coalesce(pair | lone, pair, lone, F.lit(False)).alias("hit")).groupBy(KEY).agg(F.bool_or("hit").alias("witness"))
    return cues.select(KEY).distinct().join(found, KEY, "left").select(KEY, F.coalesce("witness", F.lit(False)).alias("witness"))


def same_timing(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(file_id, same)``: whether two versions of a file have as many cues, each starting where the other's does. A file of one version only is not the same."""
    w = _ordered("start", "idx")
    number = lambda d, name: d.select(KEY, F.row_number().over(w).alias("_n"), F.col("start").alias(name))
    both = number(old, "a").join(number(new, "b"), [KEY, "_n"], "full")
    return both.groupBy(KEY).agg(F.coalesce(F.min(F.coalesce(F.col("a") == F.col("b"), F.lit(False))), F.lit(True)).alias("same"))
