"""What to listen to, what is known already, and what was heard: timelines of three states, clips chosen by region, evidence and its summary.

Times are whole numbers of one unit, milliseconds in the queries. Ranges meet what lies in them by file and time band, so a long file is many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, transcript
from ..params import DEFAULTS, Params
from ..stored import once, spread, stored

KEY = "file_id"
HEARD, SILENT, UNMEASURED = "heard", "silent", "unmeasured"


def _band(c: str | Column, width: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / width).cast("long")


def _never_sent(many: DataFrame) -> DataFrame:
    """``many``, which a join sorts and never broadcasts: the planner takes rows that came from ranges and sequences for as few as those they were made of, and would build all of them in the driver."""
    return many.hint("merge")


def _meet(ranges: DataFrame, points: DataFrame, width: int, closed: bool = False, how: str = "inner") -> DataFrame:
    """``ranges(file_id, lo, hi, ...)`` with the ``points(file_id, at, ...)`` in ``[lo, hi)``, or ``[lo, hi]`` if ``closed``."""
    last = F.col("hi") if closed else F.col("hi") - 1
    r = ranges.where(F.col("lo") <= last).withColumn("_b", F.explode(F.sequence(_band("lo", width), _band(last, width))))
    p = points.withColumn("_b", _band("at", width))
    inside = (F.col("at") >= F.col("lo")) & (F.col("at") <= last)
    met = _never_sent(r).join(p.withColumnRenamed(KEY, "_f").withColumnRenamed("_b", "_pb"), (F.col(KEY) == F.col("_f")) & (F.col("_b") == F.col("_pb")) & inside, how)
    return met.drop("_f", "_b", "_pb")


def _overlap(ranges: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """``ranges(file_id, lo, hi, ...)`` with every span ``(file_id, start, end, ...)`` that has more than a point in common with them, each pair once."""
    r = ranges.where("hi > lo").withColumn("_b", F.explode(F.sequence(_band("lo", width), _band(F.col("hi") - 1, width))))
    s = spans.where("end > start").withColumn("_sb", F.explode(F.sequence(_band("start", width), _band(F.col("end") - 1, width)))).withColumnRenamed(KEY, "_f")
    once = _band(F.greatest("lo", "start"), width) == F.col("_b")
    return _never_sent(r).join(s, (F.col(KEY) == F.col("_f")) & (F.col("_b") == F.col("_sb")) & (F.col("start") < F.col("hi")) & (F.col("end") > F.col("lo")) & once).drop("_f", "_b", "_sb")


def timeline(files: DataFrame, whole: DataFrame, clips: DataFrame, clip_speech: DataFrame) -> DataFrame:
    """``(file_id, start, end, state)``: every file's ``[0, duration)`` in stretches that are heard, silent or not measured.

    ``whole(file_id, rank, start, end)`` are speech spans of sources that mapped a whole file; the source of the least rank counts, and what it leaves is silent. A file that
    has none is known by its ``clips(file_id, start, end)`` and their ``clip_speech``: what lies in no clip is not measured, and never silent. A file without any source is
    not measured at all. Spans of no length are left out; neighbouring stretches of one state are one.
    """
    first = whole.groupBy(KEY).agg(F.min("rank").alias("rank"))
    mapped = whole.join(first, [KEY, "rank"]).select(KEY, "start", "end", F.lit(1).alias("h"), F.lit(0).alias("m"))
    everywhere = files.join(first, KEY).select(KEY, F.lit(0).cast("long").alias("start"), F.col("duration").alias("end"), F.lit(0).alias("h"), F.lit(1).alias("m"))
    spoken = clip_speech.join(first, KEY, "left_anti").select(KEY, "start", "end", F.lit(1).alias("h"), F.lit(1).alias("m"))
    listened = clips.join(first, KEY, "left_anti").select(KEY, "start", "end", F.lit(0).alias("h"), F.lit(1).alias("m"))
    spans = mapped.unionByName(everywhere).unionByName(spoken).unionByName(listened).join(files.select(KEY, "duration"), KEY)
    spans = spans.select(KEY, F.greatest("start", F.lit(0)).alias("start"), F.least("end", "duration").alias("end"), "h", "m").where("end > start")
    edges = spans.select(KEY, F.explode(F.array(F.struct(F.col("start").alias("at"), "h", "m"), F.struct(F.col("end").alias("at"), (-F.col("h")).alias("h"), (-F.col("m")).alias("m")))).alias("e")).select(KEY, "e.*")
    ends = files.where("duration > 0").select(KEY, F.explode(F.array(F.lit(0).cast("long"), F.col("duration"))).alias("at"), F.lit(0).alias("h"), F.lit(0).alias("m"))
    steps = edges.unionByName(ends).groupBy(KEY, "at").agg(F.sum("h").alias("h"), F.sum("m").alias("m"))
    w = Window.partitionBy(KEY).orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.sum("h").over(so_far) > 0, HEARD).when(F.sum("m").over(so_far) > 0, SILENT).otherwise(UNMEASURED)
    told = steps.select(KEY, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), state.alias("state")).where("end is not null")
    new = F.coalesce((F.col("state") != F.lag("state").over(Window.partitionBy(KEY).orderBy("start"))).cast("int"), F.lit(1))
    runs = told.withColumn("_new", new).withColumn("_run", F.sum("_new").over(Window.partitionBy(KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(KEY, "_run", "state").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(KEY, "start", "end", "state")


def states_of(windows: DataFrame, states: DataFrame, width: int) -> DataFrame:
    """``windows(file_id, lo, hi)``, each once, with the time that is ``heard``, ``silent`` and ``unmeasured``; what lies beyond the file is none of them."""
    asked = windows.select(KEY, "lo", "hi").distinct()
    part = F.least("hi", "end") - F.greatest("lo", "start")
    sums = _overlap(asked, states, width).groupBy(KEY, "lo", "hi").agg(*[F.sum(F.when(F.col("state") == s, part).otherwise(0)).alias(s) for s in (HEARD, SILENT, UNMEASURED)])
    return asked.join(sums, [KEY, "lo", "hi"], "left").fillna(0, [HEARD, SILENT, UNMEASURED])


def silent_gaps(gap_rows: DataFrame, states: DataFrame, width: int) -> DataFrame:
    """Gaps ``(file_id, lo, hi)`` that were measured from end to end and hold no speech; one that was not listened to is never among them."""
    return states_of(gap_rows, states, width).where("heard = 0 and unmeasured = 0 and silent = hi - lo").select(KEY, "lo", "hi")


def first_within(ranges: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """``ranges(file_id, lo, hi)`` with ``slot`` and ``at`` of the cached row of the smallest slot that starts in ``[lo, hi)``; nulls where there is none."""
    found = _meet(ranges.select(KEY, "lo", "hi").distinct(), rows.select(KEY, "slot", "at"), width).groupBy(KEY, "lo", "hi").agg(F.min(F.struct("slot", "at")).alias("c"))
    return ranges.join(found, [KEY, "lo", "hi"], "left").withColumn("slot", F.col("c.slot")).withColumn("at", F.col("c.at")).drop("c")


def densest_starts(regions: DataFrame, cues: DataFrame, clip: int, width: int) -> DataFrame:
    """``regions(file_id, lo, hi, ...)`` with ``base``: the start of the cue in ``[lo, hi]`` from which ``clip`` holds most characters, the first of equals; the middle of a region without cues."""
    ahead = Window.partitionBy(KEY).orderBy("start").rangeBetween(0, clip - 1)
    weighed = cues.select(KEY, "idx", F.col("start").alias("at"), F.sum(F.length("text")).over(ahead).alias("held"))
    best = _meet(regions.select(KEY, "lo", "hi").distinct(), weighed, width, closed=True).groupBy(KEY, "lo", "hi").agg(F.min_by("at", F.struct(-F.col("held"), "idx")).alias("base"))
    return regions.join(best, [KEY, "lo", "hi"], "left").withColumn("base", F.coalesce("base", F.floor((F.col("lo") + F.col("hi")) / 2)).cast("long"))


def pick_times(regions: DataFrame, states: DataFrame, cues: DataFrame, clip: int, nudges: tuple[int, ...], least: int, width: int) -> DataFrame:
    """``regions(file_id, lo, hi, base, ...)`` with ``at``: the nudge of ``base``, held inside the region, whose clip hears most speech and meets a cue; of equals the first in the list.

    Where no such clip hears ``least``, a file that is measured throughout gives null, which is silence; any other gives ``base``, since it was not listened to.
    """
    open_files = states.where(F.col("state") == UNMEASURED).select(KEY).distinct().withColumn("_open", F.lit(True))
    asked = regions.select(KEY, "lo", "hi", "base").distinct()
    tried = asked.select(KEY, "lo", "hi", "base", F.posexplode(F.array(*[F.lit(n).cast("long") for n in nudges])).alias("k", "n")).withColumn("at", F.greatest("lo", F.least(F.col("base") + F.col("n"), "hi")))
    clips = tried.select(KEY, F.col("at").alias("lo"), (F.col("at") + clip).alias("hi")).distinct()
    shown = _overlap(clips, cues.select(KEY, "start", "end"), width).select(KEY, "lo", "hi").distinct()
    heard = states_of(shown, states, width).select(KEY, F.col("lo").alias("at"), F.col(HEARD))
    best = tried.join(heard, [KEY, "at"]).groupBy(KEY, "lo", "hi", "base").agg(F.min(F.struct((-F.col(HEARD)).alias("less"), "k", "at")).alias("b"))
    enough = F.coalesce(-F.col("b.less") >= least, F.lit(False))
    told = asked.join(best, [KEY, "lo", "hi", "base"], "left").join(open_files, KEY, "left").join(states.select(KEY).distinct().withColumn("_known", F.lit(True)), KEY, "left")
    told = told.select(KEY, "lo", "hi", "base", F.when(enough, F.col("b.at")).when(F.col("_open").isNull() & F.col("_known").isNotNull(), F.lit(None)).otherwise(F.col("base")).cast("long").alias("at"))
    return regions.join(told, [KEY, "lo", "hi", "base"])


def equal_regions(files: DataFrame) -> DataFrame:
    """``(file_id, slot, lo, hi)``: ``files(file_id, duration, n)`` in n regions whose edges are whole numbers."""
    each = files.where("duration > 0").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    edge = lambda k: F.floor(F.col("duration") * k / F.col("n")).cast("long")
    return each.select(KEY, F.col("slot").cast("long").alias("slot"), edge(F.col("slot")).alias("lo"), edge(F.col("slot") + 1).alias("hi"))


def sample_slots(files: DataFrame, cues: DataFrame, clusters: DataFrame, states: DataFrame, targets: DataFrame, clip: int, nudges: tuple[int, ...], least: int, width: int) -> DataFrame:
    """``(file_id, kind, slot, lo, hi, at, until)``: the clips that a sampled check listens to, with where each comes from.

    ``filler``: one for each of the file's equal regions, at its densest start, moved onto speech; ``at`` is null where the region is silent. ``heuristic``: the first of
    ``clusters(file_id, lo, hi)`` that starts in a region, as it is. ``extra``: each of ``targets(file_id, lo, hi)`` that no clip above starts in has one clip in either half, the
    second only if it is a clip's length away from the first. Slots of extras follow their start, so that a later run finds them by place.
    """
    regions = equal_regions(files)
    fillers = pick_times(densest_starts(regions, cues, clip, width), states, cues, clip, nudges, least, width).select(KEY, F.lit("filler").alias("kind"), "slot", "lo", "hi", "at", (F.col("at") + clip).alias("until"))
    starting = _meet(regions, clusters.select(KEY, F.col("lo").alias("at"), F.col("hi").alias("until")), width).groupBy(KEY, "slot", "lo", "hi").agg(F.min(F.struct("at", "until")).alias("c"))
    heuristic = starting.select(KEY, F.lit("heuristic").alias("kind"), "slot", "lo", "hi", F.col("c.at").alias("at"), F.col("c.until").alias("until"))
    chosen = stored(fillers.unionByName(heuristic))
    wanted = targets.select(KEY, "lo", "hi").distinct()
    covered = _meet(wanted, chosen.where("at is not null").select(KEY, "at"), width).select(KEY, "lo", "hi").distinct()
    bare = wanted.join(covered, [KEY, "lo", "hi"], "left_anti").where("hi > lo").withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("long"))
    halves = bare.select(KEY, F.col("lo").alias("t0"), F.col("hi").alias("t1"), F.explode(F.array(F.struct(F.lit(0).alias("half"), "lo", F.col("mid").alias("hi")), F.struct(F.lit(1).alias("half"), F.col("mid").alias("lo"), "hi"))).alias("h")).select(KEY, "t0", "t1", "h.*")
    placed = pick_times(densest_starts(halves, cues, clip, width), states, cues, clip, nudges, least, width)
    earlier = F.max(F.when(F.col("half") == 0, F.col("at"))).over(Window.partitionBy(KEY, "t0", "t1"))
    kept = placed.withColumn("_e", earlier).where(F.col("at").isNotNull() & ((F.col("half") == 0) | F.col("_e").isNull() | (F.abs(F.col("at") - F.col("_e")) >= clip)))
    extra = kept.select(KEY, F.lit("extra").alias("kind"), transcript.extra_slot(F.col("at") / 1000).cast("long").alias("slot"), F.col("t0").alias("lo"), F.col("t1").alias("hi"), "at", (F.col("at") + clip).alias("until"))
    return chosen.unionByName(extra)


def with_cache(slots: DataFrame, cached: DataFrame, clip: int, width: int) -> DataFrame:
    """Slots with ``origin``: ``cached``, ``fresh`` or ``silent``, and times of the clip that is used.

    A filler takes the ``cached(file_id, slot, at)`` clip of its own slot if it lies in its region; extras, and fillers in silence, any that starts in their range; a heuristic
    clip is always heard afresh.
    """
    own = slots.where("kind = 'filler' and at is not null").join(cached.select(KEY, "slot", F.col("at").alias("c")), [KEY, "slot"], "left")
    own = own.withColumn("c", F.when((F.col("c") >= F.col("lo")) & (F.col("c") < F.col("hi")), F.col("c")))
    loose = slots.where("kind = 'extra' or (kind = 'filler' and at is null)")
    near = first_within(loose.select(KEY, "lo", "hi").distinct(), cached, width).select(KEY, "lo", "hi", F.col("at").alias("c"))
    every = own.unionByName(loose.join(near, [KEY, "lo", "hi"])).unionByName(slots.where("kind = 'heuristic'").withColumn("c", F.lit(None).cast("long")))
    origin = F.when(F.col("c").isNotNull(), "cached").when(F.col("at").isNull(), "silent").otherwise("fresh")
    return every.select(KEY, "kind", "slot", "lo", "hi", F.coalesce("c", "at").alias("at"), F.when(F.col("c").isNotNull(), F.col("c") + clip).otherwise(F.col("until")).alias("until"), origin.alias("origin"))


def clip_evidence(clips: DataFrame, segments: DataFrame, cues: DataFrame, reach: int, width: int, p: Params = DEFAULTS, score: bool = True) -> DataFrame:
    """``clips(file_id, at, until)``, each once, with ``said`` (segments that start in it), ``score``, ``shift``, ``mad`` and ``anchors``.

    ``score`` is the share of the clip's words that cues within ``reach`` of it show; null without words. ``shift`` is the median of heard less shown time over its anchors and
    ``mad`` the median distance from it, both null where the anchors are too few or too far apart. ``segments`` and ``cues`` have ``(file_id, idx, start, text)``.
    """
    asked = clips.where("at is not null").select(KEY, F.col("at").alias("lo"), F.col("until").alias("hi")).distinct()
    spoken = segments.where(~text.is_nonspeech(F.col("text"))).select(KEY, "idx", F.col("start").alias("at"), text.tokens(F.col("text")).alias("toks"))
    # segments meet cues once, as far as any clip in their band sees, and not again in each clip; clips get what was shared, and no words of cues
    bands = asked.where("lo < hi").select(KEY, "lo", "hi", F.explode(F.sequence(_band("lo", width), _band(F.col("hi") - 1, width))).alias("band"))
    seen = bands.groupBy(KEY, "band").agg((F.min("lo") - reach).alias("lo"), (F.max("hi") + reach).alias("hi"))
    asking = spoken.where("size(toks) > 0").withColumn("band", _band("at", width)).join(_never_sent(seen), [KEY, "band"]).select(KEY, "lo", "hi", F.col("idx").alias("s_idx"), F.col("at").alias("s_t"), F.col("toks").alias("s_toks"))
    shown = cues.select(KEY, "idx", F.col("start").alias("at"), text.tokens(F.col("text")).alias("toks")).where("size(toks) > 0")
    met = _meet(asking, shown, 2 * (width + reach), closed=True).where(F.arrays_overlap("s_toks", "toks")).withColumn("words", F.array_intersect("s_toks", "toks"))
    hit = F.struct(F.col("idx").alias("c_idx"), F.col("at").alias("c_t"), "s_idx", "s_t", F.size("words").alias("shared"), (F.size("words") / F.size("toks")).alias("share"))
    pairs = met.select(KEY, F.col("s_t").alias("at"), F.lit(0).alias("n"), hit.alias("hit"), *(["words"] if score else []))
    inside = _meet(asked, spoken.select(KEY, "at", F.lit(1).alias("n"), *(["toks"] if score else [])).unionByName(pairs, allowMissingColumns=True), width)
    inside = inside.where(F.col("hit").isNull() | F.col("hit.c_t").between(F.col("lo") - reach, F.col("hi") + reach))
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    words = [distinct("toks").alias("t"), distinct("words").alias("w")] if score else [F.lit(0).alias("t"), F.lit(0).alias("w")]
    held = inside.groupBy(KEY, "lo", "hi").agg(F.sum("n").alias("said"), *words, F.collect_list("hit").alias("hits"))
    each = held.select(KEY, "lo", "hi", "said", F.when(F.col("t") > 0, F.round(F.col("w") / F.col("t"), 3)).alias("score"), F.explode_outer("hits").alias("h")).select(KEY, "lo", "hi", "said", "score", "h.*")
    # as align.match does: the best cue is found first and judged after, and goes to the earliest segment that chose it
    by_segment = Window.partitionBy(KEY, "lo", "hi", "s_idx").orderBy(F.desc("share"), "c_t", "c_idx")
    chosen = (F.row_number().over(by_segment) == 1) & (F.col("share") >= p.anchor_overlap) & (F.col("shared") >= p.anchor_shared)
    each = each.withColumn("chosen", F.coalesce(chosen, F.lit(False)))
    by_cue = Window.partitionBy(KEY, "lo", "hi", "chosen", "c_idx").orderBy("s_t", "s_idx")
    apart = F.when(F.col("chosen") & (F.row_number().over(by_cue) == 1), (F.col("s_t") - F.col("c_t")) / 1000)
    ends = each.withColumn("d", apart).groupBy(KEY, "lo", "hi").agg(F.first("said").alias("said"), F.first("score").alias("score"), F.count("d").alias("anchors"), F.array_sort(F.collect_list("d")).alias("d"))
    middle = lambda d: F.when(F.size(d) > 0, (F.get(d, F.floor((F.size(d) - 1) / 2).cast("int")) * 0.5 + F.get(d, F.floor(F.size(d) / 2).cast("int")) * 0.5))
    ends = ends.withColumn("m", middle(F.col("d"))).withColumn("a", F.array_sort(F.transform("d", lambda x: F.abs(x - F.col("m"))))).withColumn("a", middle(F.col("a")))
    good = (F.col("anchors") >= p.anchor_min) & (F.col("a") <= p.anchor_mad)
    every = asked.join(ends, [KEY, "lo", "hi"], "left")
    return every.select(KEY, F.col("lo").alias("at"), F.col("hi").alias("until"), F.coalesce("said", F.lit(0)).alias("said"), "score", F.when(good, F.col("m")).alias("shift"), F.when(good, F.col("a")).alias("mad"), F.coalesce("anchors", F.lit(0)).alias("anchors"))


def full_windows(files: DataFrame, cues: DataFrame, clip: int, width: int, times: int = 5) -> DataFrame:
    """``(file_id, at, until)``: the densest start of each of ``times`` as many regions as a sampled check has."""
    regions = equal_regions(files.withColumn("n", F.col("n") * times))
    return densest_starts(regions, cues, clip, width).select(KEY, F.col("base").alias("at"), (F.col("base") + clip).alias("until")).distinct()


def grid(files: DataFrame, clip: int, step: Column | int) -> DataFrame:
    """``(file_id, at, until)``: a window every ``step`` from 0 to the end of the file."""
    size = F.lit(step).cast("long") if isinstance(step, int) else step.cast("long")
    return files.where("duration > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration") - 1, size))).select(KEY, "at", (F.col("at") + clip).alias("until"))


def thinned(duration: Column, clip: int, most: int) -> Column:
    """Step of a grid that has at most ``most`` windows of ``clip``: back to back if those are few enough, else evenly spread."""
    return F.greatest(F.lit(clip).cast("long"), F.ceil(duration / most).cast("long"))


def uncovered(windows: DataFrame, chosen: DataFrame, near: int, width: int) -> DataFrame:
    """Grid windows with no chosen window that starts less than ``near`` away."""
    around = windows.select(KEY, "at", "until", (F.col("at") - near + 1).alias("lo"), (F.col("at") + near).alias("hi"))
    taken = _meet(around.withColumnRenamed("at", "a"), chosen.select(KEY, "at"), width).select(KEY, F.col("a").alias("at")).distinct()
    return windows.join(taken, [KEY, "at"], "left_anti")


def judged_order(cues: DataFrame, segments: DataFrame, width: int, margin: float = 0.15) -> DataFrame:
    """``(file_id, idx, l1, l2, suspicious, swapped)`` of every cue with two lines, judged by the segments whose middle it shows.

    With two or more of them, words heard in the earlier and the later half of the cue say which line came first, if each line has a word of its own that was heard and one
    segment bridges both; with fewer, the order of the letters does. Null: a line that starts with a dash, nothing heard in one half, or too close to tell.
    ``suspicious`` lines look swapped by their capitals.
    """
    pair = once(cues.select(KEY, "idx", F.col("start").alias("lo"), F.col("end").alias("hi"), "text"), _p=text.two_lines(F.col("text"))).drop("text").where("_p is not null")
    lines = pair.select(KEY, "idx", "lo", "hi", F.get("_p", F.lit(0)).alias("l1"), F.get("_p", F.lit(1)).alias("l2"))
    heard = segments.select(KEY, ((F.col("start") + F.col("end")) / 2).alias("at"), F.col("start").alias("s"), F.col("text").alias("said"))
    met = _meet(lines.select(KEY, "idx", "lo", "hi"), heard, width, closed=True)
    late = F.col("at") >= (F.col("lo") + F.col("hi")) / 2
    parts = met.groupBy(KEY, "idx").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("s", late.alias("late"), F.coalesce("said", F.lit("")).alias("said")))).alias("p"))
    joined = lambda f: F.array_join(F.transform(F.filter("p", f), lambda x: x["said"]), " ")
    told = lines.join(parts, [KEY, "idx"], "left").select(KEY, "idx", "l1", "l2", "p", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(joined(f), F.lit("")).alias(c) for c, f in (("all", lambda x: F.lit(True)), ("early", lambda x: ~x["late"]), ("late", lambda x: x["late"]))])
    e, l_, a, b = (text.tokens(F.col(c)) for c in ("early", "late", "l1", "l2"))
    told = once(told, e=e, t=l_, a=a, b=b, heard=F.transform("p", lambda x: text.tokens(x["said"])))
    told = once(told, own_a=F.array_except("a", "b"), own_b=F.array_except("b", "a"), both=F.array_except(F.array_union("e", "t"), F.array_intersect("e", "t")))
    bridge = F.exists("heard", lambda x: F.arrays_overlap(x, F.col("own_a")) & F.arrays_overlap(x, F.col("own_b")))
    firm = (F.trim("early") != "") & (F.trim("late") != "") & F.arrays_overlap("own_a", "both") & F.arrays_overlap("own_b", "both") & bridge
    by_words = F.when(F.coalesce(firm, F.lit(False)), transcript.order_by_words(F.col("e"), F.col("t"), F.col("a"), F.col("b"), margin))
    # letters are compared only where they decide; of nulls nothing is
    few = lambda c: F.when(F.col("n") < 2, F.col(c))
    # words have decided before the rows are dealt, so that none of their sets is
    asked = told.select(KEY, "idx", "l1", "l2", "n", few("all").alias("all"), by_words.alias("_words"))
    judged = spread(asked, KEY, "idx").withColumn("_seq", text.order_verdict(few("all"), few("l1"), few("l2")))
    dash = text.dash_prefixed(F.col("l1")) | text.dash_prefixed(F.col("l2"))
    return judged.select(KEY, "idx", "l1", "l2", text.cap_signal(F.col("l1"), F.col("l2")).alias("suspicious"), F.when(dash, F.lit(None).cast("boolean")).when(F.col("n") < 2, F.col("_seq")).otherwise(F.col("_words")).alias("swapped"))


def summary(files: DataFrame, samples: DataFrame, orders: DataFrame, threshold: float, swap_least: int, swap_share: float) -> DataFrame:
    """One row a file from ``samples(file_id, score)`` and ``orders(file_id, idx, tested, suspicious, swapped)``.

    ``avg_score`` and ``flag`` over samples with a score, ``ok`` if half of them or more reach ``threshold``; ``confirmed`` of ``checked`` cues with a verdict, their
    ``rate``, ``severe`` where enough are swapped; ``issues`` lists swapped cues, ``flagged`` those that look swapped and were not settled.
    """
    scored = samples.where("score is not null").groupBy(KEY).agg(F.avg("score").alias("avg_score"), F.count("*").alias("samples"), F.count_if(F.col("score") >= threshold).alias("passing"))
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("idx"))))
    lines = orders.groupBy(KEY).agg(F.count_if("swapped").alias("confirmed"), F.count("swapped").alias("checked"), F.count_if("tested").alias("tested"), listed(F.col("swapped")).alias("issues"), listed(F.col("swapped").isNull() & F.col("suspicious")).alias("flagged"))
    every = files.select(KEY).join(scored, KEY, "left").join(lines, KEY, "left").fillna(0, ["samples", "confirmed", "checked", "tested"])
    rate = F.when(F.col("checked") > 0, F.round(F.col("confirmed") / F.col("checked"), 3))
    severe = (F.col("checked") > 0) & (F.col("confirmed") >= swap_least) & (F.col("confirmed") / F.greatest("checked", F.lit(1)) >= swap_share)
    flag = F.when(F.col("samples") == 0, "unknown").when(2 * F.col("passing") >= F.col("samples"), "ok").otherwise("SUSPECT")
    none = F.expr("cast(array() as array<bigint>)")
    return every.select(KEY, F.round("avg_score", 6).alias("avg_score"), "samples", flag.alias("flag"), "confirmed", "checked", "tested", rate.alias("rate"), severe.alias("severe"), F.coalesce("issues", none).alias("issues"), F.coalesce("flagged", none).alias("flagged"))


def stopped_probes(probes: DataFrame, seconds: float, words: int) -> DataFrame:
    """``probes(file_id, gap, k, cost, speech, words)`` of a gap in order, as far as an early stop goes: up to the first at which the sums reach both bars.

    A probe's cost counts only if none before it has decided its gap. ``hit`` says that the gap was decided; sums are those at the stop.
    """
    w = Window.partitionBy(KEY, "gap").orderBy("k")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = probes.withColumn("speech", F.sum("speech").over(so_far)).withColumn("words", F.sum("words").over(so_far))
    cleared = sums.withColumn("_hit", ((F.col("speech") >= seconds) & (F.col("words") >= words)).cast("int"))
    before = F.coalesce(F.max("_hit").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = cleared.withColumn("_b", before).where("_b = 0")
    return run.groupBy(KEY, "gap").agg(F.sum("cost").alias("cost"), F.count("*").alias("probes"), F.max("_hit").cast("boolean").alias("hit"), F.max("speech").alias("speech"), F.max("words").alias("words"))
