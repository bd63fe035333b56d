"""Decisions over a file's evidence, each a column of per-file aggregates; a cascade's order is its meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import cascade
from ..params import DEFAULTS, Params

KEY = "file_id"


def screen(clips: DataFrame, tilts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``clips(file_id, shift)`` and ``tilts(file_id, tilt)`` to ok, needs_sync or unknown; fewer than three clips say nothing."""
    from .robust import median_mad

    sums = median_mad(clips.where("shift is not null"), "shift")
    every = clips.select(KEY).distinct().join(sums, KEY, "left").join(tilts.select(KEY, "tilt"), KEY, "left")
    off = (F.abs("med") >= p.flat) | (F.col("mad") >= p.flat) | F.coalesce(F.abs("tilt") >= p.flat, F.lit(False))
    return every.select(KEY, "n", "med", "mad", "tilt", F.when(F.coalesce("n", F.lit(0)) < 3, "unknown").when(off, "needs_sync").otherwise("ok").alias("state"))


def presync(screened: DataFrame, spread: Column, rate_ok: Column) -> Column:
    """What may be corrected before alignment: a proven rate, else a proven constant offset, else nothing."""
    constant = (F.col("n") >= 3) & (spread < DEFAULTS.flat) & (F.coalesce(F.abs("tilt"), F.lit(0.0)) < DEFAULTS.flat) & (F.abs("med") >= DEFAULTS.flat)
    return F.when(rate_ok, "rate").when(constant, "offset")


def swap_gate(p: Params = DEFAULTS) -> Column:
    return (F.col("checked") >= p.swap_checked) & (F.col("swapped") >= p.swap_min) & (F.col("swapped") / F.col("checked") >= p.swap_rate)


def clears_missing(seconds: Column, words: Column, small_model: Column, p: Params = DEFAULTS) -> Column:
    return (seconds >= p.missing_seconds) & (words >= F.when(small_model, p.missing_words_small).otherwise(p.missing_words))


def overrun(cues: DataFrame, lengths: DataFrame, slack: float) -> DataFrame:
    """Cues that end past the duration and by how much at most; files without any are not there."""
    late = cues.join(lengths, KEY).where(F.col("end") > F.col("duration") + slack)
    return late.groupBy(KEY).agg(F.count("*").alias("late"), F.max(F.col("end") - F.col("duration")).alias("overrun"))


def needs_full(jitter: Column, drift: Column, swaps: Column, block: Column, overran: Column, disagree: Column) -> Column:
    """The first rung that calls for full evidence."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return cascade([(yes(disagree), "clips_disagree"), (yes(drift), "drift"), (yes(jitter >= 0.4), "jitter"), (yes(swaps >= 6), "swaps"), (yes(block), "block"), (yes(overran), "overrun")])


def choose_candidate(pairs: DataFrame, margin: float = 1.0, tie: float = 0.1) -> DataFrame:
    """``pairs(file_id, candidate, region, resid, score)``: timing on regions that all candidates cover decides by ``margin``, then score by ``tie``, else the old stays."""
    cover = pairs.groupBy(KEY, "region").agg(F.count("*").alias("k"))
    most = pairs.groupBy(KEY).agg(F.countDistinct("candidate").alias("all"))
    common = pairs.join(cover, [KEY, "region"]).join(most, KEY).where("k = all")
    mean = lambda c, v: F.avg(F.when(F.col("candidate") == c, F.col(v)))
    sums = common.groupBy(KEY).agg(mean("old", "resid").alias("r_old"), mean("new", "resid").alias("r_new"), mean("old", "score").alias("s_old"), mean("new", "score").alias("s_new"))
    pick = F.when(F.col("r_new") + margin <= F.col("r_old"), "new").when(F.col("r_old") + margin <= F.col("r_new"), "old").when(F.col("s_new") >= F.col("s_old") + tie, "new").otherwise("old")
    return sums.select(KEY, "r_old", "r_new", pick.alias("winner"))


def final_verdict(e: dict[str, Column]) -> Column:
    """Flag and reason by the order of the checks; evidence that is missing never fires a rule.

    Keys: parse_error, unavailable, skipped, swaps, wrong, split_failing, anchors_bad, resynced, content_ok, runs, jitter, gap, overrun.
    """
    yes = lambda k: F.coalesce(e.get(k, F.lit(False)), F.lit(False))
    out = lambda flag, reason=None: F.struct(F.lit(flag).alias("flag"), F.lit(reason).cast("string").alias("reason"))
    return cascade(
        [
            (yes("parse_error"), out("unknown", "check_failed")),
            (yes("unavailable"), out("no local Whisper binary")),
            (yes("skipped"), out("skipped")),
            (yes("swaps"), out("SUSPECT", "lines_out_of_order")),
            (yes("wrong"), out("SUSPECT", "wrong_subtitle")),
            (yes("split_failing"), out("SUSPECT", "partly_out_of_sync")),
            (yes("anchors_bad") & ~yes("resynced") & yes("jitter"), out("SUSPECT", "unreliable_timing")),
            (yes("anchors_bad") & ~yes("resynced"), out("SUSPECT", "partly_out_of_sync")),
            (~yes("content_ok"), out("unknown", "no_speech_heard")),
            (yes("runs"), out("SUSPECT", "partly_out_of_sync")),
            (yes("jitter"), out("SUSPECT", "unreliable_timing")),
            (yes("gap"), out("SUSPECT", "missing_lines")),
            (yes("overrun"), out("SUSPECT", "past_audio_end")),
        ],
        out("ok"),
    )
