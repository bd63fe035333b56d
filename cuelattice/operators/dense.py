"""Evidence from full transcripts: anchors over clips back to back, line order by words alone, texts and speech of windows.

Frames are keyed by ``file_id``. What joins by time is dealt by time band as well, so no task holds all pairs of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..params import DEFAULTS, Params
from ..stored import once, spread

KEY = "file_id"


def _band(c: str, width: float) -> Column:
    return F.floor(F.col(c) / width).cast("long")


def dense_anchors(segments: DataFrame, cues: DataFrame, clip: float, before: float, after: float, p: Params = DEFAULTS) -> DataFrame:
    """``(file_id, clip, s_idx, c_idx, s_t, c_t, shared, share)``: the anchors of every clip of ``clip`` seconds of a transcript.

    ``segments`` and ``cues`` have ``(file_id, idx, t, toks)``. A clip's segments see the cues from ``before`` ahead of it to ``after`` behind
    it; each takes the cue of which it has the greatest share of words, the earliest of equals, and is judged after. In a clip a cue goes to
    the earliest of its segments; other clips may use it again.
    """
    s = segments.where(F.size("toks") > 0).select(KEY, F.col("idx").alias("s_idx"), F.col("t").alias("s_t"), F.col("toks").alias("s_toks"), _band("t", clip).alias("clip"))
    first, last = F.ceil((F.col("t") - clip - after) / clip).cast("long"), F.floor((F.col("t") + before) / clip).cast("long")
    seen = cues.where(F.size("toks") > 0).select(KEY, F.col("idx").alias("c_idx"), F.col("t").alias("c_t"), F.col("toks").alias("c_toks"), first.alias("_a"), last.alias("_b"))
    seen = seen.where("_a <= _b").withColumn("clip", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    scored = s.join(seen, [KEY, "clip"]).withColumn("shared", F.size(F.array_intersect("s_toks", "c_toks"))).withColumn("share", F.col("shared") / F.size("c_toks")).drop("s_toks", "c_toks")
    by_segment = Window.partitionBy(KEY, "clip", "s_idx").orderBy(F.desc("share"), "c_t", "c_idx")
    by_cue = Window.partitionBy(KEY, "clip", "c_idx").orderBy("s_t", "s_idx")
    best = scored.where("shared > 0").withColumn("_r", F.row_number().over(by_segment)).where("_r = 1")
    strong = best.where((F.col("share") >= p.anchor_overlap) & (F.col("shared") >= p.anchor_shared))
    return strong.withColumn("_q", F.row_number().over(by_cue)).where("_q = 1").select(KEY, "clip", "s_idx", "c_idx", "s_t", "c_t", "shared", "share")


def swap_verdicts(cues: DataFrame, segments: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``(file_id, idx, swapped)`` of cues with two lines: whether speech has them in the other order, null where it is too close to tell.

    ``cues`` and ``segments`` have ``(file_id, idx, t, text)``. A cue is told by the segment within ``swap_window`` that has most of both lines'
    words (the earliest of equals, at least ``swap_overlap`` of them) with its two neighbours, so a file out of time is still measured.
    Lines of under two words, or that start with a dash, which are two speakers, are not judged.
    """
    pair = once(cues.select(KEY, "idx", "t", "text"), _p=text.two_lines(F.col("text"))).drop("text").where("_p is not null")
    lines = pair.select(KEY, "idx", "t", F.get("_p", F.lit(0)).alias("l1"), F.get("_p", F.lit(1)).alias("l2"))
    lines = lines.where(~text.dash_prefixed(F.col("l1")) & ~text.dash_prefixed(F.col("l2")))
    lines = once(lines, t1=text.tokens(F.col("l1")), t2=text.tokens(F.col("l2"))).where("size(t1) >= 2 and size(t2) >= 2")
    own = Window.partitionBy(KEY).orderBy("t", "idx")
    heard = F.concat_ws(" ", F.lag("text").over(own), F.col("text"), F.lead("text").over(own))
    said = segments.select(KEY, F.col("idx").alias("s_idx"), F.col("t").alias("s_t"), text.tokens(F.col("text")).alias("toks"), heard.alias("heard"))
    near = _band("t", p.swap_window)
    asked = lines.select(KEY, "idx", "t", F.array_union("t1", "t2").alias("bag"), F.explode(F.array(near - 1, near, near + 1)).alias("band"))
    met = asked.join(said.select(KEY, "s_idx", "s_t", "toks", _band("s_t", p.swap_window).alias("band")), [KEY, "band"]).where(F.abs(F.col("s_t") - F.col("t")) <= p.swap_window)
    share = F.size(F.array_intersect("bag", "toks")) / F.size("bag")
    best = met.groupBy(KEY, "idx").agg(F.min_by(F.struct(share.alias("share"), "s_idx"), F.struct(-share, "s_t", "s_idx")).alias("b")).where(F.col("b.share") >= p.swap_overlap)
    told = best.select(KEY, "idx", F.col("b.s_idx").alias("s_idx")).join(said.select(KEY, "s_idx", "heard"), [KEY, "s_idx"]).join(lines.select(KEY, "idx", "l1", "l2"), [KEY, "idx"])
    return spread(told, KEY, "idx").select(KEY, "idx", text.order_verdict(F.col("heard"), F.col("l1"), F.col("l2")).alias("swapped"))


def swap_evidence(verdicts: DataFrame) -> DataFrame:
    """Counts of cues in the other order and of decided ones for each file, as :func:`verdict.swap_gate` reads them."""
    decided = verdicts.where("swapped is not null")
    return decided.groupBy(KEY).agg(F.count_if("swapped").alias("swapped"), F.count("*").alias("checked"), F.round(F.avg(F.col("swapped").cast("int")), 3).alias("rate"))


def bridged(cues: DataFrame, segments: DataFrame, width: float) -> DataFrame:
    """``cues(file_id, idx, start, end, first, second)`` with ``bridge``: one segment they overlap has words of both lines.

    Only then did speech run on over the line break; ``segments`` have ``(file_id, start, end, toks)``.
    """
    c = cues.where("end > start").withColumn("band", F.explode(F.sequence(_band("start", width), _band("end", width))))
    s = segments.where("end > start").select(F.col(KEY).alias("_f"), F.col("start").alias("s0"), F.col("end").alias("s1"), "toks", F.explode(F.sequence(_band("start", width), _band("end", width))).alias("_b"))
    meet = (F.col(KEY) == F.col("_f")) & (F.col("band") == F.col("_b")) & (F.col("s0") < F.col("end")) & (F.col("s1") > F.col("start"))
    both = F.arrays_overlap("toks", "first") & F.arrays_overlap("toks", "second")
    hits = c.join(s, meet & both, "left_semi").select(KEY, "idx").distinct().withColumn("bridge", F.lit(True))
    return cues.select(KEY, "idx").join(hits, [KEY, "idx"], "left").select(KEY, "idx", F.coalesce("bridge", F.lit(False)).alias("bridge"))


def window_texts(windows: DataFrame, cues: DataFrame, width: float) -> DataFrame:
    """``windows(file_id, lo, hi)`` with ``text``: the texts of the cues that start in them, both ends included, in order, a line each."""
    w = windows.where("lo <= hi").select(KEY, "lo", "hi", F.explode(F.sequence(_band("lo", width), _band("hi", width))).alias("band"))
    c = cues.select(KEY, "idx", "start", "text", _band("start", width).alias("band"))
    met = w.join(c, [KEY, "band"]).where("start between lo and hi")
    ordered = F.sort_array(F.collect_list(F.struct("start", "idx", "text")))
    texts = met.groupBy(KEY, "lo", "hi").agg(F.array_join(F.transform(ordered, lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))
    return windows.join(texts, [KEY, "lo", "hi"], "left").select(KEY, "lo", "hi", F.coalesce("text", F.lit("")).alias("text"))


def _clip_edges(cues: DataFrame, speech: DataFrame, clip: int) -> DataFrame:
    """``(file_id, pos, kind, slope, jump, seen)``: where, as a clip's start moves on, its speech (by steps or at a new slope) and the number of cues it overlaps change.

    Edges of ``kind`` 0 count from ``pos`` on, those of 2 past it only.
    """
    c0, c1, zero = F.col("start"), F.col("end"), F.lit(0)
    edge = lambda pos, kind, slope=zero, jump=zero, seen=zero: F.struct(pos.cast("long").alias("pos"), F.lit(kind).alias("kind"), slope.cast("long").alias("slope"), jump.cast("long").alias("jump"), seen.cast("long").alias("seen"))
    met = F.array(edge(c0 - clip, 2, seen=F.lit(1)), edge(c1, 0, seen=F.lit(-1)))
    shown = cues.where((c1 > c0 - clip) & F.col(KEY).isNotNull()).select(KEY, F.inline(met))
    ramps = F.array(*[edge(at, 0, slope=F.lit(by)) for at, by in ((c0 - clip, 1), (c1 - clip, -1), (c0, -1), (c1, 1))])
    # a span that ends before it starts takes its length from every clip that holds both
    steps = F.array(edge(c0 - clip, 2, jump=c1 - c0), edge(c1, 0, jump=c0 - c1))
    heard = speech.where((c1 > c0 - clip) & (c1 != c0) & F.col(KEY).isNotNull()).select(KEY, F.inline(F.when(c1 > c0, ramps).otherwise(steps)))
    return shown.unionByName(heard)


def scan_regions(regions: DataFrame, cues: DataFrame, speech: DataFrame, clip: int, step: int, least: int, width: int) -> DataFrame:
    """``regions(file_id, lo, hi)`` to ``clip_at``, the start of a clip with most speech, and ``covered``; clips start every ``step`` from ``lo`` to ``hi``.

    A clip needs a cue that it overlaps and ``least`` of speech; of equals the earliest is taken, and regions without such a clip are not there.
    Times are whole numbers. Neither cues nor speech are dealt to the clips they meet: a band of a file is gone through once, in order of time, from sums that the bands
    before it leave; clips become rows after the exchange only.
    """
    edges = _clip_edges(cues, speech, clip).withColumn("band", _band("pos", width))
    until = (F.col("band") + 1) * width - F.col("pos")
    lo, hi, border = F.col("lo").cast("long"), F.col("hi").cast("long"), F.col("band") * width
    cut = regions.where(F.col(KEY).isNotNull() & (lo <= hi)).select(KEY, "lo", "hi", F.explode(F.sequence(_band("lo", width), _band("hi", width))).alias("band"))
    tries = lambda t: lo + F.ceil((t - lo) / step).cast("long") * step
    pieces = cut.select("*", F.when(border > lo, tries(border)).otherwise(lo).alias("pos"), F.least(hi, border + width - 1).alias("last")).where("pos <= last")

    # what slope, speech and cues each band with clips begins with
    sums = edges.groupBy(KEY, "band").agg(F.sum("slope").alias("slope"), F.sum(F.col("slope") * until + F.col("jump")).alias("gained"), F.sum("seen").alias("seen"), F.lit(False).alias("asked"))
    asked = pieces.select(KEY, "band", *[F.lit(0).cast("long").alias(c) for c in ("slope", "gained", "seen")], F.lit(True).alias("asked")).distinct()
    totals = sums.unionByName(asked).groupBy(KEY, "band").agg(*[F.sum(c).alias(c) for c in ("slope", "gained", "seen")], F.max("asked").alias("asked"))
    by_band = Window.partitionBy(KEY).orderBy("band")
    ahead = by_band.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("*", F.coalesce(F.sum("slope").over(ahead), F.lit(0)).alias("_s"), F.coalesce(F.sum("seen").over(ahead), F.lit(0)).alias("_n"), (F.lead("band").over(by_band) - F.col("band")).alias("_to"))
    # a band's own edges run on at its end's slope to where the next band begins
    gained = F.col("gained") + F.col("_s") * F.col("_to") * width + F.col("slope") * (F.col("_to") - 1) * width
    begun = carried.withColumn("_v", F.coalesce(F.sum(gained).over(ahead), F.lit(0))).where("asked")

    none = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    zeros = [F.lit(0).cast("long").alias(c) for c in ("slope", "jump", "seen")]
    kept = edges.select(KEY, "band", "pos", "kind", "slope", "jump", "seen", *none("last", "lo", "hi"))
    starts = begun.select(KEY, "band", border.alias("pos"), F.lit(-1).alias("kind"), F.col("_s").alias("slope"), F.col("_v").alias("jump"), F.col("_n").alias("seen"), *none("last", "lo", "hi"))
    wanted = pieces.select(KEY, "band", "pos", F.lit(1).alias("kind"), *zeros, "last", lo.alias("lo"), hi.alias("hi"))
    dealt = kept.unionByName(starts).unionByName(wanted).repartition(KEY, "band")
    rows = dealt.withColumn("pos", F.explode(F.sequence("pos", F.coalesce("last", "pos"), F.lit(step).cast("long"))))
    w = Window.partitionBy(KEY, "band").orderBy("pos", "kind")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    moved = rows.select("*", (F.sum("slope").over(so_far) - F.col("slope")).alias("_s"), (F.col("pos") - F.lag("pos").over(w)).alias("_d"), F.sum("seen").over(so_far).alias("_n"))
    rated = moved.withColumn("covered", F.sum(F.coalesce(F.col("_s") * F.col("_d"), F.lit(0)) + F.col("jump")).over(so_far)).where((F.col("kind") == 1) & (F.col("_n") > 0) & (F.col("covered") >= least))
    best = rated.groupBy(KEY, "lo", "hi").agg(F.min_by(F.struct(F.col("pos").alias("clip_at"), "covered"), F.struct(-F.col("covered"), "pos")).alias("b"))
    return best.select(KEY, "lo", "hi", "b.clip_at", "b.covered")


def declared_music(gap_rows: DataFrame, cues: DataFrame, music: Column, most: int) -> DataFrame:
    """``gap_rows(file_id, g0, g1)`` with ``declared``: no longer than ``most``, and opened by the end of a cue that ``music`` says is one of music."""
    opened = cues.where(F.coalesce(music, F.lit(False))).select(KEY, F.col("end").alias("g0")).distinct().withColumn("_m", F.lit(True))
    return gap_rows.join(opened, [KEY, "g0"], "left").select(KEY, "g0", "g1", (F.coalesce("_m", F.lit(False)) & (F.col("g1") - F.col("g0") <= most)).alias("declared"))
