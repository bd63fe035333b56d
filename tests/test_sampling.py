"""Timelines, clips, evidence and verdicts: stated cases, and the two checks against plain versions over a whole table."""

import difflib
import re
import statistics

import pytest
from pyspark.sql import functions as F

from cuelattice.functions.text import STOPWORDS
from cuelattice.operators import sampling as s
from cuelattice.plans import sampling as plan

SPAN = "file_id string, start long, end long"


def spans(spark, rows, kind=SPAN):
    return spark.createDataFrame(rows, kind)


def states(spark, files, whole=(), clips=(), speech=()):
    return s.timeline(spans(spark, files, "file_id string, duration long"), spans(spark, whole, "file_id string, rank int, start long, end long"), spans(spark, clips), spans(spark, speech))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_clips_that_cover_a_third_never_make_silence(spark):
    clips = [("a", t, t + 10) for t in (0, 30, 60)]
    told = states(spark, [("a", 90)], clips=clips, speech=[("a", 2, 8), ("a", 35, 45)])
    assert rows(told, "start", "end", "state") == [(0, 2, "silent"), (2, 8, "heard"), (8, 10, "silent"), (10, 30, "unmeasured"), (30, 35, "silent"), (35, 45, "heard"), (45, 60, "unmeasured"), (60, 70, "silent"), (70, 90, "unmeasured")]
    gaps = spans(spark, [("a", t, t + 2) for t in range(0, 90, 2)], "file_id string, lo long, hi long")
    found = rows(s.silent_gaps(gaps, told, 7), "lo", "hi")
    assert found and all(any(lo >= a and hi <= b for _, a, b in clips) for lo, hi in found)


def test_sources_by_rank_and_files_without_any(spark):
    whole = [("a", 2, 0, 5), ("a", 1, 20, 30), ("b", 2, 0, 5), ("b", 2, 3, 200)]
    told = states(spark, [("a", 40), ("b", 50), ("c", 10), ("d", 0)], whole, [("a", 0, 40)], [("a", 0, 40)])
    assert rows(told, "file_id", "start", "end", "state") == [("a", 0, 20, "silent"), ("a", 20, 30, "heard"), ("a", 30, 40, "silent"), ("b", 0, 50, "heard"), ("c", 0, 10, "unmeasured")]
    assert states(spark, []).count() == 0


def test_first_cached_row_of_a_half_open_range(spark):
    cached = spans(spark, [("a", 5, 10), ("a", 1, 20), ("a", 0, 30)], "file_id string, slot long, at long")
    asked = spans(spark, [("a", 10, 20), ("a", 10, 21), ("a", 11, 20), ("b", 0, 99)], "file_id string, lo long, hi long")
    assert sorted(map(tuple, s.first_within(asked, cached, 8).collect())) == [("a", 10, 20, 5, 10), ("a", 10, 21, 1, 20), ("a", 11, 20, None, None), ("b", 0, 99, None, None)]


CUES = [("a", i, t, t + 2_000, "x" * 5) for i, t in enumerate(range(0, 1_300_000, 10_000))]
NUDGES = (0, 10_000, -10_000, 20_000, -20_000, 30_000, -30_000)


def picked(spark, told, lo, hi, base):
    cues = spark.createDataFrame(CUES, "file_id string, idx long, start long, end long, text string")
    region = spans(spark, [("a", lo, hi, base)], "file_id string, lo long, hi long, base long")
    return s.pick_times(region, told, cues, 30_000, NUDGES, 3_000, 60_000).first()["at"]


@pytest.mark.parametrize(("heard", "partial", "region", "want"), [
    ([(0, 1_300_000)], False, (100_000, 200_000, 150_000), 150_000),
    ([(115_000, 140_000)], False, (90_000, 220_000, 100_000), 110_000),
    ([(100_000, 120_000)], False, (600_000, 700_000, 650_000), None),
    ([(100_000, 120_000)], True, (600_000, 700_000, 650_000), 650_000),
    ([(150_000, 200_000)], True, (90_000, 220_000, 160_000), 160_000),
])
def test_clips_move_onto_speech_and_only_measured_files_are_silent(spark, heard, partial, region, want):
    found = [("a", *h) for h in heard]
    told = states(spark, [("a", 1_300_000)], [] if partial else [("a", 1, *h) for h in heard], found if partial else [], found if partial else [])
    assert picked(spark, told, *region) == want


def test_silent_file_without_speech_and_file_not_known(spark):
    silent = spans(spark, [("a", 0, 1_300_000, "silent")], SPAN + ", state string")
    assert picked(spark, silent, 100_000, 200_000, 150_000) is None
    assert picked(spark, silent.limit(0), 100_000, 200_000, 150_000) == 150_000


def test_extra_clips_for_ranges_that_no_clip_starts_in(spark):
    files = spans(spark, [("a", 1_300_000, 2)], "file_id string, duration long, n int")
    cues = spark.createDataFrame(CUES, "file_id string, idx long, start long, end long, text string")
    told = states(spark, [("a", 1_300_000)])
    targets = spans(spark, [("a", 0, 50_000), ("a", 400_000, 500_000), ("a", 200_000, 220_000)], "file_id string, lo long, hi long")
    clusters = spans(spark, [("a", 700_000, 720_000), ("a", 710_000, 800_000)], "file_id string, lo long, hi long")
    got = rows(s.sample_slots(files, cues, clusters, told, targets, 30_000, NUDGES, 3_000, 60_000), "kind", "lo", "at")
    assert got == [("extra", 200_000, 200_000), ("extra", 400_000, 400_000), ("extra", 400_000, 450_000), ("filler", 0, 0), ("filler", 650_000, 650_000), ("heuristic", 650_000, 700_000)]


def test_grid_is_thinned_evenly_to_its_budget(spark):
    files = spans(spark, [("a", 100_000), ("b", 10_000_000), ("c", 0)], "file_id string, duration long")
    got = s.grid(files, 30_000, s.thinned(F.col("duration"), 30_000, 60)).groupBy("file_id").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    assert rows(got, "file_id", "n", "last") == [("a", 4, 90_000), ("b", 60, 59 * 166_667)]


def test_probes_stop_at_the_first_that_decides(spark):
    probes = [("a", 0, k, 10, x, w) for k, (x, w) in enumerate([(5, 10), (6, 60), (9, 99)])] + [("a", 50, 0, 10, 9, 200), ("a", 50, 1, 4, 0, 0), ("b", 0, 0, 7, 0, 0)]
    told = s.stopped_probes(spans(spark, probes, "file_id string, gap long, k long, cost long, speech long, words long"), 10, 50)
    assert rows(told, "file_id", "gap", "cost", "probes", "hit", "speech", "words") == [("a", 0, 20, 2, True, 11, 70), ("a", 50, 14, 2, False, 9, 200), ("b", 0, 7, 1, False, 0, 0)]


def toks(text):
    text = re.sub(r"[\[(][^\[\]()]*[\])]", " ", " ".join((text or "").split("\n")))
    return {t.lower() for t in re.findall(r"[a-zA-ZæøåÆØÅéèêëüöäßñçÉÈÊËÜÖÄ']{4,}", text)} - set(STOPWORDS)


def letters(t):
    return re.sub(r"[^a-z0-9 ]", "", t.lower())


def plain_order(cue, said):
    l1, l2 = cue["text"].split("\n")
    if l1.lstrip(" ").startswith("-") or l2.lstrip(" ").startswith("-"):
        return None
    own = sorted((x for x in said if cue["start"] <= (x["start"] + x["end"]) / 2 <= cue["end"]), key=lambda x: x["start"])
    if len(own) < 2:
        heard = letters(own[0]["text"] if own else "")
        gap = difflib.SequenceMatcher(None, heard, letters(l1) + " " + letters(l2)).ratio() - difflib.SequenceMatcher(None, heard, letters(l2) + " " + letters(l1)).ratio()
        return True if gap <= -0.1 else False if gap >= 0.1 else None
    mid = (cue["start"] + cue["end"]) / 2
    halves = [" ".join(x["text"] for x in own if ((x["start"] + x["end"]) / 2 < mid) == early) for early in (True, False)]
    if not all(h.strip() for h in halves):
        return None
    e, t = map(toks, halves)
    a, b = toks(l1), toks(l2)
    e, t, a, b = e - t, t - e, a - b, b - a
    if not a & (e | t) or not b & (e | t) or not any(toks(x["text"]) & a and toks(x["text"]) & b for x in own):
        return None
    gap = len(e & b) / len(b) + len(t & a) / len(a) - len(e & a) / len(a) - len(t & b) / len(b)
    return True if gap >= 0.15 else False if gap <= -0.15 else None


def plain_evidence(at, until, said, cues):
    inside = [x for x in said if at <= x["start"] < until]
    words, shown = set().union(*[toks(x["text"]) for x in inside]), [c for c in cues if at - plan.REACH <= c["start"] <= until + plan.REACH]
    score = round(len(words & set().union(*[toks(c["text"]) for c in shown])) / len(words), 3) if words else None
    best = {}
    for x in sorted(inside, key=lambda x: (x["start"], x["idx"])):
        ranked = sorted((-len(toks(x["text"]) & toks(c["text"])) / len(toks(c["text"])), c["start"], c["idx"]) for c in shown if toks(x["text"]) & toks(c["text"]))
        if ranked:
            c = next(c for c in shown if c["idx"] == ranked[0][2])
            if -ranked[0][0] >= 0.5 and len(toks(x["text"]) & toks(c["text"])) >= 2:
                best.setdefault(c["idx"], (x["start"] - c["start"]) / 1000)
    shift = statistics.median(best.values()) if best else None
    good = len(best) >= 3 and statistics.median(abs(v - shift) for v in best.values()) <= 1
    return len(inside), score, shift if good else None


def tables(spark, sf_dir):
    lines = plan.verified(spark, sf_dir)
    by = lambda df: {f: [r.asDict() for r in group] for f, group in _grouped(df.collect())}
    return by(plan._files(lines)), by(plan._shown(lines)), by(plan._said(lines))


def _grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.file_id, []).append(r)
    return out.items()


def verdict(scores):
    have = [x for x in scores if x is not None]
    return len(have), round(sum(have) / len(have), 6) if have else None, "unknown" if not have else "ok" if 2 * sum(x >= 0.6 for x in have) >= len(have) else "SUSPECT"


def test_full_check_against_plain(spark, sf_dir):
    files, cues, said = tables(spark, sf_dir)
    windows = dict(_grouped(s.full_windows(plan._files(plan.verified(spark, sf_dir)), plan._shown(plan.verified(spark, sf_dir)), plan.CLIP, plan.WIDTH).collect()))
    got = {r.file_id: r for r in plan.full_verdicts(spark, sf_dir).collect()}
    assert set(got) == set(files)
    decided = 0
    for f, r in got.items():
        told = [(w["at"], *plain_evidence(w["at"], w["until"], said.get(f, []), cues[f])) for w in windows[f]]
        told = [x for x in told if x[1]]
        assert (r.samples, r.avg_score, r.flag) == verdict([x[2] for x in told]), f
        orders = {c["idx"]: plain_order(c, said.get(f, [])) for c in cues[f] if len([x for x in c["text"].split("\n") if x.strip()]) == 2}
        assert sorted(i for i, v in orders.items() if v) == list(r.issues), f
        assert (r.confirmed, r.checked, r.tested) == (sum(v is True for v in orders.values()), sum(v is not None for v in orders.values()), len(orders))
        decided += r.checked
        taken = [x[0] for x in told]
        more = [plain_evidence(t, t + plan.CLIP, said.get(f, []), cues[f])[2] for t in range(0, files[f][0]["duration"], 60_000) if not any(abs(t - x) < 30_000 for x in taken)]
        shifts = [x[3] for x in told if x[3] is not None] + [x for x in more if x is not None]
        assert (r.shifts or 0) == len(shifts) and (r.shift is None if not shifts else abs(r.shift - statistics.median(shifts)) < 0.002), f
    assert decided > 20 and any(r.confirmed for r in got.values())


def test_sampled_check_against_plain(spark, sf_dir):
    files, cues, said = tables(spark, sf_dir)
    got = {r.file_id: r for r in plan.sampled_verdicts(spark, sf_dir).collect()}
    slots = dict(_grouped(plan.sample_slots(spark, sf_dir).collect()))
    assert set(got) == set(files)
    for f, r in got.items():
        cached = {k: k * plan.KEPT_EVERY for k in range(-(-files[f][0]["duration"] // plan.KEPT_EVERY))}
        origins, scores, hearts = [], [], []
        for x in slots[f]:
            near = min((k for k, t in cached.items() if x["lo"] <= t < x["hi"]), default=None)
            if x.kind == "heuristic":
                hit = None
                hearts.append((x["at"], x["until"]))
            elif x.kind == "filler" and x["at"] is not None:
                hit = cached.get(x.slot) if x["lo"] <= cached.get(x.slot, -1) < x["hi"] else None
            else:
                hit = cached[near] if near is not None else None
            origins.append("cached" if hit is not None else "silent" if x["at"] is None else "fresh")
            at, until = (hit, hit + plan.CLIP) if hit is not None else (x["at"], x["until"])
            scores.append(plain_evidence(at, until, said.get(f, []), cues[f])[1] if at is not None else None)
        assert (r.samples, r.avg_score, r.flag) == verdict(scores), f
        assert (r.cached, r.fresh, r.silent) == tuple(origins.count(o) for o in ("cached", "fresh", "silent"))
        assert r.tested >= r.checked and len(r.issues) == r.confirmed


def test_verdicts_follow_their_evidence(spark, sf_dir):
    full = {r.file_id: r for r in plan.full_verdicts(spark, sf_dir).collect()}
    holes = {r.file_id for r in plan.missing_middle(spark, sf_dir).where("hit").select("file_id").distinct().collect()}
    got = {r.file_id: r for r in plan.file_verdicts(spark, sf_dir).collect()}
    assert set(got) == set(full) and len({(r.flag, r.reason) for r in got.values()}) >= 2
    for f, r in got.items():
        assert (r.swapped, r.checked, r.samples, r.gap) == (full[f].confirmed, full[f].checked, full[f].samples, f in holes)
        severe = r.checked >= 10 and r.swapped >= 5 and r.swapped / r.checked >= 0.1
        if severe:
            assert (r.flag, r.reason) == ("SUSPECT", "lines_out_of_order")
        elif full[f].flag == "SUSPECT":
            assert (r.flag, r.reason) == ("SUSPECT", "wrong_subtitle")
        elif full[f].flag == "unknown":
            assert r.reason in ("no_speech_heard", "partly_out_of_sync", "unreliable_timing")
        elif r.gap:
            assert r.flag == "SUSPECT" and r.reason in ("missing_lines", "partly_out_of_sync", "unreliable_timing")
        elif r.flag == "ok":
            assert not r.late and r.rung != "drift"
