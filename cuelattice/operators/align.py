"""Text alignment: segments to cues by time and shared words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params

KEY = "file_id"


def match(segments: DataFrame, cues: DataFrame, before: float, after: float, p: Params = DEFAULTS) -> DataFrame:
    """``segments(file_id, idx, t, toks)`` to the cue that shares most of its own words within the time window.

    Of cues with an equal share the earliest wins; a cue goes to the earliest of the segments that chose it; a segment whose
    cue is taken has none. Frames are joined on the file, with the window as further condition.
    """
    s = segments.select(F.col(KEY), F.col("idx").alias("s_idx"), F.col("t").alias("s_t"), F.col("toks").alias("s_toks"))
    c = cues.select(F.col(KEY).alias("_f"), F.col("idx").alias("c_idx"), F.col("t").alias("c_t"), F.col("toks").alias("c_toks"))
    near = s.join(c, (F.col(KEY) == F.col("_f")) & (F.col("c_t") >= F.col("s_t") - before) & (F.col("c_t") <= F.col("s_t") + after))
    scored = near.withColumn("shared", F.size(F.array_intersect("s_toks", "c_toks"))).withColumn("share", F.when(F.size("c_toks") > 0, F.col("shared") / F.size("c_toks")))
    by_segment = Window.partitionBy(KEY, "s_idx").orderBy(F.desc("share"), "c_t", "c_idx")
    by_cue = Window.partitionBy(KEY, "c_idx").orderBy("s_t", "s_idx")
    # the best cue is found first and judged after: a segment whose best cue is too weak does not fall to its second
    chosen = scored.where("shared > 0").withColumn("_r", F.row_number().over(by_segment)).where("_r = 1").where((F.col("share") >= p.anchor_overlap) & (F.col("shared") >= p.anchor_shared))
    return chosen.withColumn("_q", F.row_number().over(by_cue)).where("_q = 1").select(KEY, "s_idx", "c_idx", "s_t", "c_t", "shared", "share")


def clip_shifts(anchors: DataFrame, clip: float, p: Params = DEFAULTS) -> DataFrame:
    """Median shift of each clip's anchors and its deviation; clips with too few anchors or too much spread have none."""
    keyed = anchors.withColumn("clip", F.floor(F.col("s_t") / clip)).withColumn("shift", F.col("s_t") - F.col("c_t"))
    mid = keyed.groupBy(KEY, "clip").agg(F.median("shift").alias("shift_med"), F.count("*").alias("anchors"))
    spread = keyed.join(mid, [KEY, "clip"]).groupBy(KEY, "clip").agg(F.median(F.abs(F.col("shift") - F.col("shift_med"))).alias("mad"))
    good = (F.col("anchors") >= p.anchor_min) & (F.col("mad") <= p.anchor_mad)
    return mid.join(spread, [KEY, "clip"]).select(KEY, "clip", "anchors", F.when(good, F.col("shift_med")).alias("shift"), F.when(good, F.col("mad")).alias("mad"))


def block_ranges(cues: DataFrame, blocks: DataFrame) -> DataFrame:
    """``blocks(file_id, block, n, shift)`` count cues in order: each block's time range, moved by its shift."""
    w = Window.partitionBy(KEY).orderBy("block")
    ends = blocks.withColumn("hi", F.sum("n").over(w)).withColumn("lo", F.col("hi") - F.col("n"))
    placed = cues.withColumn("_n", F.row_number().over(Window.partitionBy(KEY).orderBy("start", "idx")) - 1)
    met = placed.join(ends.withColumnRenamed(KEY, "_f"), (F.col(KEY) == F.col("_f")) & (F.col("_n") >= F.col("lo")) & (F.col("_n") < F.col("hi")))
    return met.groupBy(KEY, "block").agg((F.min("start") + F.first("shift")).alias("from_t"), (F.max("end") + F.first("shift")).alias("to_t"), F.count("*").alias("n"))
