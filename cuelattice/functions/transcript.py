"""Transcript rules: keys of cached pieces, sampling, remapping of trimmed time, replies, and the order of two lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "file_id"


def sample_count(duration: Column, per_ten_minutes: Column, fixed: Column) -> Column:
    """Clips to take: the fixed number if set, else by length, three at least."""
    return F.coalesce(fixed, F.greatest(F.lit(3), F.ceil(duration / 600 * per_ten_minutes))).cast("int")


def extra_slot(start: Column) -> Column:
    """Slot of a clip outside the regular grid; halves go to the even second."""
    return (F.lit(100_000) + F.bround(start)).cast("int")


def probe_key(video: Column, start: Column, length: Column, *rest: Column) -> Column:
    """Times in whole milliseconds with whatever else decides a transcript; null-safe."""
    ms = lambda x: F.bround(x * 1000).cast("long").cast("string")
    return F.concat_ws("|", video, ms(start), ms(length), *[F.coalesce(r.cast("string"), F.lit("")) for r in rest])


def full_or_sampled(mode: Column, model: Column) -> Column:
    return F.when(mode != "auto", mode).when(F.lower(model).contains("tiny"), "full").otherwise("sampled")


def slope_snaps(slope: Column, ratios: tuple[float, ...], within: float = 3e-4) -> Column:
    """Whether the ratio that undoes a slope lies within a share of a known ratio."""
    return F.exists(F.array(*map(F.lit, ratios)), lambda r: F.abs(r * (1 - slope) - 1) <= within)


def region_starts(duration: Column, clip: Column, count: Column) -> Column:
    """Evenly spaced clip starts; a single one lies in the middle."""
    room = F.greatest(F.lit(0.0), duration - clip)
    return F.when(count <= 1, F.array(room / 2)).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda k: room * k / (count - 1)))


def remapped(segments: DataFrame, pieces: DataFrame) -> DataFrame:
    """Segments in trimmed time moved back by ``pieces(file_id, t0, t1, at)``: the piece that holds the middle, else the nearest one."""
    p = pieces.select(F.col(KEY).alias("_f"), "t0", "t1", "at")
    middle = (F.col("start") + F.col("end")) / 2
    away = F.greatest(F.col("t0") - middle, middle - F.col("t1"), F.lit(0))
    met = segments.join(p, F.col(KEY) == F.col("_f")).withColumn("_away", away)
    first = Window.partitionBy(KEY, "idx").orderBy("_away", "t0")
    kept = met.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    held = lambda c: F.least(F.greatest(F.col(c), F.col("t0")), F.col("t1")) - F.col("t0") + F.col("at")
    return kept.select(KEY, "idx", held("start").alias("start"), held("end").alias("end"))


_NUMBERED = re.compile(r"^\s*(\d+)\s*[.):-]\s*(.*)$")


def numbered_lines(reply: str | None, expected: int) -> list[str] | None:
    """Lines 1 to ``expected`` of a reply, wrapped ones put together again; none if any is missing, out of order or one too many."""
    out: list[str] = []
    for line in (reply or "").splitlines():
        m = _NUMBERED.match(line)
        if m and int(m[1]) == len(out) + 1:
            out.append(m[2].strip())
        elif m and int(m[1]) <= len(out):
            return None
        elif line.strip() and out:
            out[-1] = f"{out[-1]} {line.strip()}"
    return out if len(out) == expected and all(out) else None


@F.pandas_udf(T.ArrayType(T.StringType()))
def numbered_reply(reply: pd.Series, expected: pd.Series) -> pd.Series:
    return pd.Series([numbered_lines(r, int(n)) for r, n in zip(reply, expected, strict=True)], dtype=object)


def order_by_words(early: Column, late: Column, first: Column, second: Column, margin: float = 0.15) -> Column:
    """Whether two lines were said in the other order, from token sets of what was heard early and late.

    Words heard on both sides or shown in both lines say nothing. Null when a line has no such words or the shares are within the margin.
    """
    heard_both, shown_both = F.array_intersect(early, late), F.array_intersect(first, second)
    clear = lambda x: F.array_except(F.array_except(x, heard_both), shown_both)
    share = lambda line, side: F.size(F.array_intersect(line, side)) / F.size(line)

    def told(x: Column) -> Column:
        kept, swapped = share(x["one"], x["a"]) + share(x["two"], x["b"]), share(x["one"], x["b"]) + share(x["two"], x["a"])
        return F.when((F.size(x["one"]) == 0) | (F.size(x["two"]) == 0), F.lit(None).cast("boolean")).when(swapped - kept >= margin, True).when(kept - swapped >= margin, False)

    # the four sets are worked out once, and not again wherever a bar reads them
    sets = F.struct(clear(early).alias("a"), clear(late).alias("b"), clear(first).alias("one"), clear(second).alias("two"))
    return F.get(F.transform(F.array(sets), told), F.lit(0))


def music_clusters(music: DataFrame, gap: float, margin: float, trail: float) -> DataFrame:
    """Music spans joined across gaps of at most ``gap``, then padded."""
    from ..operators.intervals import islands

    grouped = islands(music, gap).groupBy(KEY, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return grouped.select(KEY, (F.col("start") - margin).alias("start"), (F.col("end") + trail).alias("end"))


def best_nudge(windows: DataFrame, speech: DataFrame, nudges: tuple[int, ...], clip: int) -> DataFrame:
    """For each region start the nudge whose clip holds most speech; of equals the first in the list."""
    tried = windows.select(KEY, "base", F.posexplode(F.array(*map(F.lit, nudges))).alias("k", "nudge")).withColumn("lo", F.col("base") + F.col("nudge"))
    s = speech.select(F.col(KEY).alias("_f"), "start", "end")
    met = tried.join(s, (F.col(KEY) == F.col("_f")) & (F.col("end") > F.col("lo")) & (F.col("start") < F.col("lo") + clip), "left")
    part = F.when(F.col("start").isNotNull(), F.least(F.col("end"), F.col("lo") + clip) - F.greatest("start", "lo"))
    sums = met.groupBy(KEY, "base", "k", "nudge").agg(F.coalesce(F.sum(part), F.lit(0)).alias("speech"))
    best = Window.partitionBy(KEY, "base").orderBy(F.desc("speech"), "k")
    return sums.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(KEY, "base", "nudge", "speech")
