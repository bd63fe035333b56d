"""What keeps queries within bounds as tables grow: shapes of plans, and the same results from what is batched as from one at a time."""

import difflib
import glob
import random
import statistics
import time

import numpy as np

from cuelattice.functions import sequences, text, transcript
from cuelattice.operators import dense, intervals, robust, sampling
from cuelattice.params import DEFAULTS
from cuelattice.plans import transcripts
from cuelattice.stored import stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_are_rows_and_no_call_each(spark):
    c = spark.createDataFrame([("f", float(t), t + 2.0) for t in range(0, 300, 7)], "file_id string, start double, end double")
    assert "InPandas" not in plan(intervals.window_shifts(c, c))
    assert intervals.window_shifts(c, c).count() == 9


def test_windows_scored_together_are_scored_as_alone(spark):
    rng = random.Random(3)
    spans = lambda n, most: np.array([(a, a + rng.uniform(0, most)) for a in (rng.uniform(0, 90) for _ in range(n))]).reshape(-1, 2)
    own, said = [spans(rng.randint(1, 9), 8) for _ in range(40)], [spans(rng.randint(0, 9), 40) for _ in range(40)]
    owner = lambda lists: np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    t0 = np.array([rng.uniform(-35, 0) for _ in own])
    best, gain = intervals._best_shifts(np.concatenate(own), owner(own), np.concatenate(said), owner(said), t0, DEFAULTS)
    for k in range(len(own)):
        lone = intervals._best_shifts(own[k], owner(own[k : k + 1]), said[k], owner(said[k : k + 1]), t0[k : k + 1], DEFAULTS)
        assert (best[k], round(gain[k], 9)) == (lone[0][0], round(lone[1][0], 9))


def test_ratios_are_those_of_difflib():
    rng = random.Random(7)
    for _ in range(150):
        letters = "ab cdefghijklmnopqrstuvwxyzé😀"[: rng.choice([2, 5, 12, 28])]
        a, b = ("".join(rng.choices(letters, k=rng.choice([0, 1, 30, 199, 200, 260]))) for _ in range(2))
        at = rng.randrange(len(a) + 1)
        b = rng.choice([b, b[:100] + a[at : at + 150] + b[100:]])
        assert sequences.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_an_order_is_judged_once_and_by_many_tasks(spark):
    rows = spark.createDataFrame([(f"f{k}", k, k * 30.0, f"alpha bravo {k} charlie\ndelta echo {k} foxtrot") for k in range(9)], "file_id string, idx int, t double, text string")
    told = dense.swap_evidence(dense.swap_verdicts(rows, rows))
    assert plan(told).count("ArrowEvalPython") == 1 and plan(told).count("Generate explode") >= 2 and "xxhash64" in plan(told)
    assert {(r.swapped, r.checked) for r in told.collect()} == {(0, 1)} and told.count() == 9


def test_runs_of_slots_are_scored_as_slots_are(spark):
    rng = random.Random(9)
    spans = lambda: [(f, a, a + rng.randint(0, 400)) for f in ("f", "g") for a in (rng.randint(-900, 9000) for _ in range(12))]
    own, said, shifts = spans(), [*spans(), ("h", 1, 9)], [-12, -3, 0, 5, 12]
    touched = lambda rows, f: {k for n, a, b in rows if n == f and b > a for k in range(a // 10, (b - 1) // 10 + 1)}
    wanted = {(f, h, sum(1 if k + h in touched(said, f) else -1 for k in touched(own, f))) for f in ("f", "g") for h in shifts}
    frames = [spark.createDataFrame(x, "file_id string, start long, end long") for x in (own, said)]
    scores = intervals.slot_score(*frames, 10, shifts)
    assert set(map(tuple, scores.collect())) == wanted and len(wanted) == scores.count()
    # the shifts become rows after the last exchange only
    assert plan(scores).index("_s") < plan(scores).index("Exchange")


def test_two_lines_are_trimmed_of_spaces_and_not_of_their_number(spark):
    rows = spark.createDataFrame([("01 first\n12 second ",), ("a\u00a0\n \u3000B",), ("C:\\Name\nB",)], "text string")
    assert [r[0] for r in rows.select(text.two_lines(rows.text, marked=False)).collect()] == [["01 first", "12 second"], ["a", "B"], ["C:\\Name", "B"]]


def test_pairs_of_points_are_never_rows(spark):
    rng = random.Random(2)
    data = [(f, rng.randint(0, 30), rng.randint(0, 99)) for f in range(6) for _ in range(3 + f)] + [(9, 1, 1), (9, 1, 2), (9, 1, 3), (10, 1, 1)]
    slopes = robust.theil_sen(spark.createDataFrame(data, "file_id int, a long, c long"))
    assert "Join" not in plan(slopes)
    wanted = {}
    for f in range(6):
        own = [x[1:] for x in data if x[0] == f]
        wanted[f] = (len(own), statistics.median([(d - c) / (b - a) for a, c in own for b, d in own if a < b]))
    assert {r.file_id: (r.n, r.slope) for r in slopes.collect()} == wanted


def test_clips_are_rated_without_pairs_of_clips_and_spans(spark):
    rng = random.Random(4)
    spans = lambda n, least: [(f, a, a + rng.randint(least, 90)) for f in ("f", "g") for a in (rng.randint(-200, 900) for _ in range(n))]
    # odd spans too: of no length, and ending before they start
    own, said, clip, step = [*spans(9, 0), ("f", 300, 290), ("g", 410, 360), (None, 0, 900)], [*spans(25, 0), ("f", 500, 495), ("g", 40, 40), (None, 0, 900)], 20, 7
    regions = [("f", -150, 333), ("f", -150, 333), ("f", 200, 210), ("g", 5, 5), ("g", 0, 899), ("g", 9, 8), ("h", 0, 50), (None, 0, 50)]
    wanted = set()
    for f, lo, hi in regions:
        rated = []
        for at in range(lo, hi + 1, step):
            met = [(a, b) for n, a, b in said if n == f and f and b > at and a < at + clip]
            if any(n == f and b > at and a < at + clip for n, a, b in own) and sum(min(b, at + clip) - max(a, at) for a, b in met) >= 3:
                rated.append((-sum(min(b, at + clip) - max(a, at) for a, b in met), at))
        if f and rated:
            wanted.add((f, lo, hi, min(rated)[1], -min(rated)[0]))
    kind = "file_id string, {} long, {} long"
    frames = [spark.createDataFrame(regions, kind.format("lo", "hi")), *[spark.createDataFrame(x, kind.format("start", "`end`")) for x in (own, said)]]
    for width in (11, 30, 5000):
        got = dense.scan_regions(*frames, clip, step, 3, width)
        assert set(map(tuple, got.collect())) == wanted and got.count() == len(wanted) > 2
    assert "Join" not in plan(got)


def test_clips_get_what_segments_and_cues_share_and_no_words_of_cues(spark):
    rng = random.Random(6)
    words = ["alpha", "bravo", "delta", "gamma", "kilos", "tango"]
    rows = lambda n: [(f, k // 2, rng.randint(0, 300), " ".join(rng.choices(words, k=rng.randint(0, 4)))) for f in ("f", "g") for k in range(n)]
    said, own = rows(40), rows(30)
    clips = [(f, a, a + n) for f in ("f", "g", "h") for a, n in [(rng.randint(-20, 280), rng.choice([0, 15, 40, 300])) for _ in range(9)]]
    kinds = "file_id string, idx int, start long, text string", "file_id string, at long, until long"
    told = sampling.clip_evidence(spark.createDataFrame(clips, kinds[1]), *[spark.createDataFrame(x, kinds[0]) for x in (said, own)], 30, 20, DEFAULTS)
    assert plan(told).count("Join ") == 4
    wanted = set()
    for f, lo, hi in clips:
        inside = [(k, t, set(w.split())) for n, k, t, w in said if n == f and lo <= t < hi]
        shown = [(k, t, set(w.split())) for n, k, t, w in own if n == f and lo - 30 <= t <= hi + 30]
        heard, seen = (set().union(*[w for _, _, w in x]) for x in (inside, shown))
        best, taken = {}, {}
        for k, t, w in inside:
            for c, u, v in shown:
                if w & v:
                    best[k] = min(best.get(k, (9,)), (-len(w & v) / len(v), u, c, len(w & v), t))
        for k, (share, u, c, shared, t) in best.items():
            if -share >= 0.5 and shared >= 2:
                taken[c] = min(taken.get(c, (999,)), (t, k, (t - u) / 1000))
        d = [x[2] for x in taken.values()]
        m = statistics.median(d) if len(d) >= 3 else None
        wanted.add((f, lo, hi, len(inside), round(len(heard & seen) / len(heard), 3) if heard else None, len(d), None if m is None else round(m, 9)))
    once_each = lambda x: {r[:3]: r for r in x}
    got = {(r.file_id, r.at, r.until, r.said, r.score, r.anchors, None if r.shift is None else round(r.shift, 9)) for r in told.collect()}
    plain = {k for k in once_each(wanted) if len({(n, i) for n, i, t, _ in said if n == k[0] and k[1] <= t < k[2]}) == once_each(wanted)[k][3]}
    # a number that two segments of a clip share is one segment to the anchors, whichever times it has
    assert {k: v[:5] for k, v in once_each(got).items()} == {k: v[:5] for k, v in once_each(wanted).items()}
    assert {k: v for k, v in once_each(got).items() if k in plain} == {k: v for k, v in once_each(wanted).items() if k in plain} and len(plain) > 9


def test_the_sets_that_tell_an_order_are_worked_out_once(spark):
    rows = spark.createDataFrame([(["alpha", "both"], ["bravo", "both"], ["bravo", "same"], ["alpha", "same"]), (["alpha"], ["bravo"], ["alpha"], ["bravo"]), (["alpha"], ["bravo"], [], ["bravo"]), (["x"], ["y"], ["z"], ["w"])], "e array<string>, l array<string>, a array<string>, b array<string>")
    told = rows.select(transcript.order_by_words(*map(rows.__getattr__, "elab")).alias("v"))
    assert plan(told).count("array_except") == 8
    assert [r.v for r in told.collect()] == [True, False, None, None]


def test_letters_are_compared_only_where_they_decide(spark, monkeypatch):
    cues = spark.createDataFrame([("f", 0, 0, 10, "alpha bravo\ncharlie delta"), ("f", 1, 20, 30, "alpha bravo\ncharlie delta")], "file_id string, idx int, start long, end long, text string")
    said = spark.createDataFrame([("f", 0, 4, "charlie delta"), ("f", 4, 10, "alpha bravo"), ("f", 20, 30, "charlie delta alpha bravo")], "file_id string, start long, end long, text string")
    asked, judge = [], text.order_verdict
    monkeypatch.setattr(text, "order_verdict", lambda *c: asked.extend(map(str, c)) or judge(*c))
    assert {r.idx: r.swapped for r in sampling.judged_order(cues, said, 20).collect()} == {0: None, 1: True}
    assert len(asked) == 3 and all("n, 2" in c.replace("<(", "") or "n < 2" in c for c in asked) and not any("ELSE" in c for c in asked)


def test_a_line_is_misheard_once(spark):
    lines = spark.createDataFrame([(1, 1, 0, 60, "some words of a line"), (1, 2, 600, 660, "")], "conv long, k long, start long, end long, text string")
    told = transcripts.heard(lines)
    assert told.columns == ["model", "conv", "k", "start", "end", "text"] and plan(told.select("text")).count("md5") == 1 and {r.k for r in told.collect()} == {1}


def test_rows_made_of_ranges_are_never_broadcast(spark):
    """Few files make many regions, clips and bands of them; the planner sees the size of the files."""
    files = spark.range(2).selectExpr("id AS file_id", "100L AS duration", "5L AS n")
    rows = spark.createDataFrame([(f, k, k * 7, k * 7 + 5, "alpha bravo delta") for f in (0, 1) for k in range(12)], "file_id long, idx int, start long, end long, text string")
    windows = sampling.full_windows(files, rows, 10, 20)
    told = sampling.clip_evidence(windows, rows, rows, 30, 20, DEFAULTS)
    more = sampling.uncovered(sampling.grid(files, 10, 20), rows.selectExpr("file_id", "start AS at"), 3, 20)
    spans = sampling.grid(files, 10, 20).selectExpr("file_id", "at AS lo", "until AS hi")
    states = sampling.states_of(spans, rows.selectExpr("file_id", "start", "end", "'heard' AS state"), 20)
    assert [plan(x).count("Broadcast") for x in (windows, told, more, states)] == [0, 0, 0, 0]
    assert (told.count(), more.count()) == (windows.count(), 2 * 2) and {r.heard for r in states.collect()} == {2, 6, 7, 8}
    assert all(r.score == 1.0 for r in told.where("said > 0").collect())


def test_a_stored_table_leaves_no_shuffle_files(spark):
    dirs = [d.toString() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", held()
    asked = spark.conf.get(key, None)
    told = stored(spark.range(99).selectExpr("id % 7 AS a", "id").groupBy("a").count())
    until = time.time() + 10
    while held() - before and time.time() < until:
        time.sleep(0.1)
    assert not held() - before and spark.conf.get(key, None) == asked and told.count() == 7


def test_words_judge_an_order_before_its_rows_are_dealt(spark):
    rows = spark.range(3).selectExpr("id AS file_id", "1 AS idx", "0L AS start", "9L AS end", "'alpha bravo\\ncharlie delta' AS text")
    above, below = plan(sampling.judged_order(rows, rows, 20)).split("xxhash64")
    assert "AS _words" in below and "own_a" not in above
