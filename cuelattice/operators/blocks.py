"""Alignment of two token sequences of a file by matching blocks: the longest common run first, then what lies left and right of it.

Of equally long runs the one that starts first in ``a`` is taken, then the first in ``b``. Runs of many tokens are found by joining grams of as many, inside
the windows that the blocks found so far leave; only then do shorter grams follow, so that common words never meet over a whole file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stored import spread, stored

KEY = "file_id"


def _windows(tokens: DataFrame, blocks: DataFrame, side: str, parts: int) -> DataFrame:
    """Tokens outside all blocks with ``w``, the number of blocks before them."""
    marks = tokens.select(KEY, "pos", "token", F.lit(None).cast("long").alias("reach")).unionByName(blocks.select(KEY, F.col(side).alias("pos"), F.lit(None).cast("string").alias("token"), (F.col(side) + F.col("size")).alias("reach")))
    so_far = Window.partitionBy(KEY).orderBy("pos", F.col("reach").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    told = marks.repartition(parts, KEY).withColumn("w", F.count("reach").over(so_far)).withColumn("held", F.last("reach", True).over(so_far))
    return told.where("token is not null and (held is null or pos >= held)").select(KEY, "w", "pos", "token")


def _grams(tokens: DataFrame, size: int) -> DataFrame:
    w = Window.partitionBy(KEY, "w").orderBy("pos")
    parts = [F.lead("token", k).over(w) for k in range(size)]
    return tokens.select(KEY, "w", "pos", parts[-1].isNotNull().alias("_whole"), F.concat_ws("\x01", *parts).alias("gram")).where("_whole").drop("_whole")


def _runs(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """``(file_id, w, i, j, n)``: longest stretches of pairs of equal grams on one diagonal."""
    pairs = _grams(a, size).withColumnRenamed("pos", "i").join(_grams(b, size).withColumnRenamed("pos", "j"), [KEY, "w", "gram"]).select(KEY, "w", "i", (F.col("j") - F.col("i")).alias("d"))
    along = Window.partitionBy(KEY, "w", "d").orderBy("i")
    runs = pairs.withColumn("run", F.col("i") - F.row_number().over(along)).groupBy(KEY, "w", "d", "run").agg(F.min("i").alias("i"), (F.count("*") + size - 1).alias("n"))
    return runs.select(KEY, "w", "i", (F.col("i") + F.col("d")).alias("j"), "n")


def _longest_first(i: np.ndarray, j: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Blocks of at least ``least`` out of runs: each cuts its rectangle into two, to whose edges the runs are clipped."""
    far = int(max(i.max(), j.max()) + n.max() + 1)
    rectangles = [(np.arange(len(i)), 0, far, 0, far)]
    while rectangles:
        own, a0, a1, b0, b1 = rectangles.pop()
        skip = np.maximum(np.maximum(a0 - i[own], b0 - j[own]), 0)
        left = np.minimum(np.minimum(n[own], a1 - i[own]), b1 - j[own]) - skip
        fits = left >= least
        if not fits.any():
            continue
        own, skip, left = own[fits], skip[fits], left[fits]
        longest = np.flatnonzero(left == left.max())
        starts = i[own[longest]] + skip[longest], j[own[longest]] + skip[longest]
        pick = longest[np.lexsort(starts[::-1])[0]]
        x, y, size = int(i[own[pick]] + skip[pick]), int(j[own[pick]] + skip[pick]), int(left[pick])
        yield x, y, size
        rectangles += [(own, a0, x, b0, y), (own, x + size, a1, y + size, b1)]


def _chosen(least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Blocks of one file's runs, window by window."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in group.groupby("w", sort=False):
            out += _longest_first(*(own[c].to_numpy() for c in ("i", "j", "n")), least)
        table = pd.DataFrame(out, columns=["a", "b", "size"])
        table.insert(0, KEY, group[KEY].iloc[0])
        return table

    return choose


def matching_blocks(a: DataFrame, b: DataFrame, grams: tuple[int, ...] = (8, 3, 1)) -> DataFrame:
    """``(file_id, a, b, size)``: blocks of equal tokens of ``a`` and ``b``, both ``(file_id, pos, token)`` with positions 0, 1, ... in each file.

    The result does not depend on ``grams``, falling lengths that end with 1. Windows of a file are joined on their own; choosing among a window's runs is a
    fold over one file. Files without a common token have no rows; null tokens match nothing.
    """
    found: DataFrame | None = None
    # dealt by file to all tasks of a shuffle: choosing takes long for the few bytes it reads, which an adaptive plan would put into few; what follows keeps to it
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for size in grams:
        sides = [t.repartition(parts, KEY).withColumn("w", F.lit(0).cast("long")) if found is None else _windows(t, found, side, parts) for t, side in ((a, "a"), (b, "b"))]

        kind = a.schema[KEY].dataType.simpleString()
        fresh = _runs(*sides, size).groupBy(KEY).applyInPandas(_chosen(size), f"{KEY} {kind}, a long, b long, size long")
        found = stored(fresh if found is None else found.unionByName(fresh))
    return found


def aligned(blocks: DataFrame) -> DataFrame:
    """``(file_id, a, b)``: one row for each pair of equal tokens."""
    steps = blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    return steps.select(KEY, (F.col("a") + F.col("k")).alias("a"), (F.col("b") + F.col("k")).alias("b"))


def positions(rows: DataFrame, *order: str) -> DataFrame:
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy(KEY).orderBy(*order)) - 1).cast("long"))


def nearest_rank(values: Column, p: float) -> Column:
    """The value at share ``p`` of a sorted array; null of an empty one."""
    return F.get(values, F.least(F.size(values) - 1, F.floor(F.size(values) * F.lit(p))).cast("int"))


def drift(a: DataFrame, b: DataFrame, grams: tuple[int, ...] = (4, 1)) -> DataFrame:
    """How two transcripts ``(file_id, start, end, token)`` of one recording differ: lines of equal text, and how far apart they start and end.

    Times are seconds. Shares are of the longer transcript, ``similarity`` is twice the matched lines over all lines; quantiles are nearest ranks of distances.
    A file that only one side has is there with nothing matched.
    """
    sides = [stored(positions(t.select(KEY, "start", "end", "token"), "start", "end", "token")) for t in (a, b)]
    pairs = aligned(matching_blocks(*(s.select(KEY, "pos", "token") for s in sides), grams))
    for side, s in zip("ab", sides, strict=True):
        pairs = pairs.join(s.select(KEY, F.col("pos").alias(side), F.col("start").alias(f"s_{side}"), F.col("end").alias(f"e_{side}")), [KEY, side])
    moved = pairs.select(KEY, F.round(F.col("s_b") - F.col("s_a"), 6).alias("start"), F.round(F.col("e_b") - F.col("e_a"), 6).alias("end"))
    starts, ends = (F.array_sort(F.collect_list(F.abs(c))) for c in ("start", "end"))
    told = moved.groupBy(KEY).agg(F.count("*").alias("matched"), F.median("start").alias("start_median"), starts.alias("s"), ends.alias("e"))
    counts = [s.groupBy(KEY).agg(F.count("*").alias(f"lines_{side}")) for side, s in zip("ab", sides, strict=True)]
    every = counts[0].join(counts[1], KEY, "full").fillna(0, ["lines_a", "lines_b"]).join(told, KEY, "left").fillna(0, ["matched"])
    share = 100 * F.col("matched") / F.greatest("lines_a", "lines_b")
    quantile = lambda values, p: F.round(nearest_rank(F.col(values), p), 3)
    return every.select(
        KEY, "lines_a", "lines_b", "matched", F.round(share, 1).alias("matched_pct"), F.round(2 * F.col("matched") / (F.col("lines_a") + F.col("lines_b")), 3).alias("similarity"),
        F.round(F.round("start_median", 6), 3).alias("start_median"), quantile("s", 0.5).alias("start_p50"), quantile("s", 0.95).alias("start_p95"), quantile("s", 1.0).alias("start_max"), quantile("e", 0.95).alias("end_p95"),
    )


def _names(ids: np.ndarray, times: int) -> np.ndarray:
    """Names of the runs of ``2 ** times`` ids at each place: equal names are equal runs."""
    for k in range(times):
        whole = max(0, len(ids) - (1 << k))
        ids = np.unique(ids[:whole].astype(np.int64) << 32 | ids[len(ids) - whole :], return_inverse=True)[1]
    return ids


def matched_tokens(a: np.ndarray, b: np.ndarray, doublings: tuple[int, ...] = (3, 1, 0)) -> int:
    """Tokens in the matching blocks of two sequences of one file, found as :func:`matching_blocks` finds them: grams of 8, 2 and 1 tokens, by exact names, in the windows that are left."""
    ids = np.unique(np.concatenate((a, b)), return_inverse=True)[1] if len(a) and len(b) else np.zeros(0, np.int64)
    windows, hits = [(0, len(a), 0, len(b))] if len(ids) else [], 0
    # one number that occurs in neither parts the two sides, so that no name spans them
    joined = np.concatenate((ids[: len(a)], [len(ids)], ids[len(a) :])) if len(ids) else ids
    for times in doublings:
        size, names, left = 1 << times, _names(joined, times), []
        for a0, a1, b0, b1 in windows:
            if min(a1 - a0, b1 - b0) < size:
                left.append((a0, a1, b0, b1))
                continue
            x, y = names[a0 : a1 - size + 1], names[len(a) + 1 + b0 : len(a) + 1 + b1 - size + 1]
            order = np.argsort(y, kind="stable")
            first, last = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
            n = last - first
            i = np.repeat(np.arange(len(x)), n)
            j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
            if not len(i):
                left.append((a0, a1, b0, b1))
                continue
            along = np.lexsort((i, j - i))
            i, j = i[along], j[along]
            new = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(j) != 1)))
            length = np.diff(np.append(new, len(i))) + size - 1
            found = sorted(_longest_first(i[new], j[new], length, size))
            at = (0, 0)
            for p, q, own in [*found, (a1 - a0, b1 - b0, 0)]:
                left.append((a0 + at[0], a0 + p, b0 + at[1], b0 + q))
                at, hits = (p + own, q + own), hits + own
        windows = [w for w in left if w[1] > w[0] and w[3] > w[2]]
    return hits


@F.pandas_udf(T.LongType())
def _hits(truth: pd.Series, heard: pd.Series) -> pd.Series:
    return pd.Series([matched_tokens(np.asarray(a, dtype=str), np.asarray(b, dtype=str)) for a, b in zip(truth, heard, strict=True)], dtype="int64")


def word_quality(truth: DataFrame, heard: DataFrame, by: str) -> DataFrame:
    """``(by, words, heard, hits, recall, precision, f1)``: words of transcripts against the verified text, added up over the files of each ``by``.

    ``truth(file_id, words)`` and ``heard(file_id, by, words)`` hold a file's words in order, which one film bounds; every transcript is one row and meets its truth by the file. Files that only one side
    has count with nothing heard or shown. Groups in which either side has no word are left out.
    """
    groups = heard.select(by).distinct()
    every = truth.join(groups).join(heard.withColumnRenamed("words", "told"), [KEY, by], "left")
    none = F.expr("cast(array() as array<string>)")
    lone = heard.join(truth.select(KEY), KEY, "left_anti").select(KEY, by, none.alias("words"), F.col("words").alias("told"))
    rows = every.select(KEY, by, F.coalesce("words", none).alias("words"), F.coalesce("told", none).alias("told")).unionByName(lone)
    counted = spread(rows, KEY, by).select(by, F.size("words").alias("words"), F.size("told").alias("heard"), _hits("words", "told").alias("hits"))
    sums = counted.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("words", "heard", "hits")]).where("words > 0 and heard > 0")
    recall, precision = F.col("hits") / F.col("words"), F.col("hits") / F.col("heard")
    f1 = F.when(F.col("hits") > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    return sums.select(by, "words", "heard", "hits", F.round(recall, 3).alias("recall"), F.round(precision, 3).alias("precision"), F.round(f1, 3).alias("f1"))


def anchor_quality(anchors: DataFrame, lengths: DataFrame, by: str, clip: float = 30.0, least: int = 3, near: float = 0.5) -> DataFrame:
    """``(by, files, anchors_per_10min, share_near, clips_with_anchors)`` from :func:`dense.dense_anchors` and ``lengths(file_id, by, duration)``.

    ``share_near`` are anchors within ``near`` of their file's median offset; the denominator of clips is every clip of the files, also those without an anchor.
    """
    offset = F.col("c_t") - F.col("s_t")
    middle = anchors.groupBy(KEY).agg(F.median(offset).alias("m"), F.count("*").alias("n"))
    near_by = anchors.join(middle, KEY).groupBy(KEY).agg(F.count_if(F.abs(offset - F.col("m")) <= near).alias("near"))
    full = anchors.groupBy(KEY, "clip").agg(F.count("*").alias("k")).groupBy(KEY).agg(F.count_if(F.col("k") >= least).alias("full"))
    files = lengths.join(middle, KEY, "left").join(near_by, KEY, "left").join(full, KEY, "left").fillna(0, ["n", "near", "full"])
    sums = files.groupBy(by).agg(F.count("*").alias("files"), F.sum("n").alias("n"), F.sum("near").alias("near"), F.sum("full").alias("full"), F.sum(F.floor(F.col("duration") / clip) + 1).alias("clips"), (F.sum("duration") / 60).alias("minutes"))
    ratio = lambda a, b, d: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), d))
    return sums.select(by, "files", F.when(F.col("minutes") > 0, F.round(F.col("n") / F.col("minutes") * 10, 1)).alias("anchors_per_10min"), ratio("near", "n", 3).alias("share_near"), ratio("full", "clips", 3).alias("clips_with_anchors"))
