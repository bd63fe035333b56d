"""Changes to cue times, and the damages that tests put in; cues are ``(file_id, idx, start, end, text)`` in whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "file_id"


def _round(x: Column) -> Column:
    """To the nearest whole number, halves to the even one."""
    return F.bround(x).cast("long")


def rescale(cues: DataFrame, ratio: float, offset: int = 0) -> DataFrame:
    """Times moved by ``offset`` and stretched by ``ratio``, never below zero; an end is never before its start."""
    start = F.greatest(F.lit(0).cast("long"), _round((F.col("start") + offset) * ratio))
    end = F.greatest(start, _round((F.col("end") + offset) * ratio))
    return cues.withColumns({"start": start, "end": end})


def shift_all(cues: DataFrame, by: int) -> DataFrame:
    """All times moved; cues that would start below zero go."""
    return cues.withColumns({"start": F.col("start") + by, "end": F.col("end") + by}).where("start >= 0")


def shift_block(cues: DataFrame, lo: int, hi: int, by: int, least: int = 200) -> DataFrame:
    """Cues that start in ``[lo, hi)`` moved, never below zero, and at least ``least`` long."""
    inside = (F.col("start") >= lo) & (F.col("start") < hi)
    start = F.when(inside, F.greatest(F.lit(0).cast("long"), F.col("start") + by)).otherwise(F.col("start"))
    end = F.when(inside, F.greatest(start + least, F.col("end") + by)).otherwise(F.col("end"))
    return cues.withColumns({"start": start, "end": end})


def drop_span(cues: DataFrame, lo: int, hi: int) -> DataFrame:
    return cues.where(~((F.col("start") >= lo) & (F.col("end") <= hi)))


def cut_version(cues: DataFrame, lo: int, hi: int) -> DataFrame:
    """A stretch removed and all after it moved up."""
    left = drop_span(cues, lo, hi)
    late = F.col("start") >= hi
    return left.withColumns({"start": F.when(late, F.col("start") - (hi - lo)).otherwise(F.col("start")), "end": F.when(late, F.col("end") - (hi - lo)).otherwise(F.col("end"))})


def staircase(cues: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Each step ``(from, by)`` moves all cues from there on, on top of those before."""
    by = sum((F.when(F.col("start") >= at, F.lit(d)).otherwise(0) for at, d in steps), F.lit(0))
    return cues.withColumns({"start": F.greatest(F.lit(0).cast("long"), F.col("start") + by), "end": F.greatest(F.lit(0).cast("long"), F.col("end") + by)})


def piecewise(cues: DataFrame, blocks: int, shifts: list[int]) -> DataFrame:
    """The file's cues in equal runs by position, each run moved by its own shift."""
    part = F.ntile(blocks).over(Window.partitionBy(KEY).orderBy("start", "idx"))
    by = F.get(F.array(*map(F.lit, shifts)), part - 1)
    return cues.withColumn("_by", by).withColumns({"start": F.greatest(F.lit(0).cast("long"), F.col("start") + F.col("_by")), "end": F.greatest(F.lit(0).cast("long"), F.col("end") + F.col("_by"))}).drop("_by")


def swap_lines(cues: DataFrame, every: int) -> DataFrame:
    """The two lines of every ``every``-th two-line cue change places."""
    parts = F.split("text", "\n")
    two = F.size(parts) == 2
    nth = F.when(two, F.row_number().over(Window.partitionBy(KEY, two).orderBy("start", "idx")))
    return cues.withColumn("_n", nth).withColumn("text", F.when(F.col("_n") % every == 0, F.concat_ws("\n", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).otherwise(F.col("text"))).drop("_n")


def _chance(seed: int, salt: int, *keys: str) -> Column:
    """A number in [0, 1) that a row's keys decide, however rows are dealt out."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys), F.lit(1 << 30)) / float(1 << 30)


def drop_and_double(cues: DataFrame, share: float, seed: int) -> DataFrame:
    """A share of cues goes, another is doubled."""
    draw = _chance(seed, 1, KEY, "idx")
    left = cues.withColumn("_d", draw).where(F.col("_d") >= share)
    return left.withColumn("_c", F.explode(F.sequence(F.lit(1), F.when(F.col("_d") >= 1 - share, 2).otherwise(1)))).drop("_d", "_c")


def jitter(cues: DataFrame, lo: int, hi: int, seed: int) -> DataFrame:
    """Each cue moved by ``lo`` to ``hi`` either way."""
    size = lo + (hi - lo) * _chance(seed, 2, KEY, "idx")
    by = _round(F.when(_chance(seed, 3, KEY, "idx") < 0.5, -size).otherwise(size))
    return cues.withColumn("_by", by).withColumns({"start": F.greatest(F.lit(0).cast("long"), F.col("start") + F.col("_by")), "end": F.greatest(F.lit(0).cast("long"), F.col("end") + F.col("_by"))}).drop("_by")


def wrong_file(cues: DataFrame, other: DataFrame) -> DataFrame:
    """The texts and times of ``other(file_id, other_id)`` under each file's name."""
    return cues.withColumnRenamed(KEY, "other_id").join(other, "other_id").drop("other_id")


def deoverlap(cues: DataFrame) -> DataFrame:
    """An end is cut to the next start if that is strictly later than the own start."""
    nxt = F.lead("start").over(Window.partitionBy(KEY).orderBy("start", "idx"))
    return cues.withColumn("_n", nxt).withColumn("end", F.when((F.col("_n") > F.col("start")) & (F.col("end") > F.col("_n")), F.col("_n")).otherwise(F.col("end"))).drop("_n")


def cues_of(segments: DataFrame, least: int = 500) -> DataFrame:
    """Segments in seconds to cues: trimmed texts, none empty, ``least`` milliseconds at least, ends cut to the next start."""
    ms = lambda c: _round(F.col(c) * 1000)
    kept = segments.withColumn("text", F.trim("text")).where("text <> ''").withColumns({"start": ms("start"), "end": ms("end")})
    return deoverlap(kept.withColumn("end", F.greatest("end", F.col("start") + least)))


def apply_plan(cues: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan(file_id, lo, hi, by)``: each cue moves with the first stretch that holds its start, then overlaps are cut."""
    p = plan.select(F.col(KEY).alias("_f"), "lo", "hi", "by")
    met = cues.join(p, (F.col(KEY) == F.col("_f")) & (F.col("start") >= F.col("lo")) & (F.col("start") < F.col("hi")), "left")
    first = met.withColumn("_r", F.row_number().over(Window.partitionBy(KEY, "idx").orderBy("lo"))).where("_r = 1").withColumn("by", F.coalesce("by", F.lit(0)))
    moved = first.withColumns({"start": F.greatest(F.lit(0).cast("long"), F.col("start") + F.col("by")), "end": F.greatest(F.lit(0).cast("long"), F.col("end") + F.col("by"))})
    return deoverlap(moved.select(*cues.columns))


def run_repair_plan(runs: DataFrame) -> DataFrame:
    """``runs(file_id, from_a, to_a, by)`` with edges halfway to the neighbours; a file whose runs overlap has no plan."""
    w = Window.partitionBy(KEY).orderBy("from_a", "to_a")
    near = runs.withColumn("_p", F.lag("to_a").over(w)).withColumn("_n", F.lead("from_a").over(w))
    clash = near.withColumn("_bad", F.max(F.coalesce(F.col("_p") > F.col("from_a"), F.lit(False))).over(Window.partitionBy(KEY)))
    return clash.where(~F.col("_bad")).select(KEY, F.coalesce((F.col("_p") + F.col("from_a")) / 2, F.col("from_a")).alias("lo"), F.coalesce((F.col("to_a") + F.col("_n")) / 2, F.col("to_a")).alias("hi"), "by")
