"""Corrections of whole files on planted transcripts: rates, offsets, runs, cut cues, and files that must be left alone."""

import itertools

import pytest
from pyspark.sql import functions as F

from cuelattice.functions import labels
from cuelattice.operators import correct, robust

N = 200
CUE = "file_id string, idx int, start long, end long, text string"
SEG = "file_id string, idx int, start double, end double, text string"


def _word(n):
    return "".join("bcdfghklmn"[int(d)] + "a" for d in f"{n:04d}")


def line(k):
    return " ".join(_word(4 * k + j) for j in range(4))


def spoken_at(k):
    return 5.0 + 6.0 * k + (k * 7 % 5) * 0.02


@pytest.fixture(scope="module")
def data(spark):
    """Segments of files that are right, off by a known rate, off by an offset, off in one stretch, and that have nothing heard."""
    moves = {
        "right": lambda t, k: t,
        "pal": lambda t, k: t * 25 / 24,
        "late": lambda t, k: t - 2.2,
        "run": lambda t, k: t - 8.0 if 90 <= k < 110 else t,
    }
    cues, segments = [], []
    for f, move in moves.items():
        for k in range(N):
            t = spoken_at(k)
            at = round(move(t, k) * 1000)
            cues.append((f, k, at, at + 2000, line(k)))
            segments.append((f, k, t, t + 2.0, line(k)))
    cues.append(("deaf", 0, 0, 1000, "unheard"))
    return spark.createDataFrame(cues, CUE).cache(), spark.createDataFrame(segments, SEG).cache()


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(f, False, False) for f in ("right", "pal", "late", "run", "deaf")], "file_id string, changed boolean, over_blocks boolean")


def test_rate_is_read_snapped_and_only_where_there_is_one(data, files):
    cues, segments = data
    got = {r.file_id: r for r in correct.rate_fixes(segments, cues, cues, files).collect()}
    assert set(got) == {"pal"} and abs(got["pal"].ratio - 24 / 25) < 1e-9 and abs(got["pal"].offset) < 0.1
    fixed = correct.retimed(cues.where("file_id = 'pal'"), correct.rate_fixes(segments, cues, cues, files)).collect()
    assert max(abs(r.start / 1000 - spoken_at(r.idx)) for r in fixed) < 0.15


def test_offset_is_read_where_the_file_is_level(data, files):
    cues, segments = data
    got = {r.file_id: r for r in correct.offset_fixes(segments, cues, cues, files).collect()}
    assert set(got) == {"late"} and abs(got["late"].offset - 2.2) < 0.01 and abs(got["late"].worst - 2.2) < 0.01


def test_runs_are_confirmed_by_speech_and_planned_by_cues(spark):
    cues = spark.createDataFrame([(f, k, 10_000 * k - (8000 if k in (3, 4) else 0), 10_000 * k - (8000 if k in (3, 4) else 0) + 2000, "") for f in ("run", "false", "deaf") for k in range(8)], CUE)
    speech = spark.createDataFrame([("run", 10_000 * k, 10_000 * k + 2000) for k in range(8)] + [("false", 22_000, 24_000), ("false", 32_000, 34_000)], "file_id string, start long, end long")
    found = spark.createDataFrame([(f, 1, 30.0, 40.0, 8.0, 22.0, 32.0) for f in ("run", "false", "deaf")], "file_id string, run long, from_a double, to_a double, dev double, cue_from double, cue_to double")
    assert {r.file_id for r in correct.heard_runs(found, cues, speech, around=0).collect()} == {"run", "deaf"}
    segments = spark.createDataFrame([("run", 0, 0.0, 100.0, ""), ("deaf", 0, 0.0, 44.0, "")], SEG)
    plan = {r.file_id: (r.lo, r.hi, r.by) for r in correct.run_plan(found.where("file_id <> 'false'"), cues, segments).collect()}
    assert plan == {"run": (22_000.0, 42_000.0, 8000), "deaf": (22_000.0, float("inf"), 8000)}
    twice = found.where("file_id = 'run'").unionByName(found.where("file_id = 'run'").withColumns({"run": F.lit(2).cast("long"), "cue_from": F.lit(32.0), "cue_to": F.lit(50.0)}))
    assert correct.run_plan(twice, cues, segments).count() == 0


def test_stretches_large_and_overwhelming(spark):
    stretched = [("big", 10.0 * k, 0.02 * 10 * k + (k % 3) * 0.02) for k in range(120)]
    partly = [("part", 10.0 * k, 0.02 * 10 * k if k % 8 else 40.0) for k in range(120)]
    level = [("level", 10.0 * k, (k % 3) * 0.1) for k in range(120)]
    points = spark.createDataFrame(stretched + partly + level, "file_id string, a double, c double")
    cues = points.select("file_id", F.lit(0).alias("idx"), F.lit(600_000).cast("long").alias("start"), F.lit(602_000).cast("long").alias("end"), F.lit("").alias("text")).distinct()
    got = {r.file_id: r for r in correct.stretch_fixes(points, cues).collect()}
    assert set(got) == {"big"} and abs(got["big"].ratio - 1 / 0.98) < 1e-3 and got["big"].left < 0.1
    assert {r.file_id for r in correct.rescued_ramps(points, cues).collect()} == {"big"}
    fits = spark.createDataFrame([("big", 1.0, 0.0), ("level", 1.0, 0.0), ("gone", 1.0, 0.0)], "file_id string, ratio double, offset double")
    left = {r.file_id: r.left for r in correct.quarter_left(points, fits).collect()}
    assert left["gone"] == 0 and left["level"] < 0.2 and abs(left["big"] - 0.02 * 10 * 104.5) < 0.5


def test_cut_cues_are_put_back(spark):
    base = [(f, k, 1000 * k + 500, 1000 * k + 900, "") for f in ("line", "bent", "few") for k in range(30 if f != "few" else 12)]
    cut = []
    for f, k, s, e, t in base:
        s2, e2 = s - 3500, e - 3500
        if f == "bent" and k == 20:
            s2 += 4000
        cut.append((f, k, max(0, s2), max(0, e2), t))
    other = [("other", k, 0 if k < 3 else k, k + 9, "") for k in range(9)]
    clean = [("clean", 0, 5, 9, ""), ("clean", 1, 7, 9, "")]
    current, baseline = spark.createDataFrame(cut + other + clean, CUE), spark.createDataFrame(base + clean[:1], CUE)
    got = correct.unclamped(current, baseline).collect()
    assert {r.file_id for r in got} == {"line", "clean"}
    assert sorted((r.start, r.end) for r in got if r.file_id == "line") == [(1000 * k - 3000, 1000 * k - 2600) for k in range(30)]


def test_baselines_deny_a_ramp_only_when_flat_or_other(spark):
    kind = "file_id string, slope double, intercept double, tilt double, rho double, gain double, resid double, keep_frac double, n_kept long"
    ramp = lambda f, slope: (f, slope, 0.0, slope * 1200, 0.99, 3.0, 0.2, 0.95, 100)
    flat = lambda f: (f, 0.0, -3.9, 0.1, 0.0, 0.0, 0.2, 0.95, 100)
    noisy = lambda f: (f, 0.0, 0.0, 0.5, 0.0, 0.0, 2.0, 0.4, 100)
    probes = spark.createDataFrame([ramp("same", 0.02), flat("same"), flat("flat"), ramp("other", 0.002), noisy("noisy")], kind)
    asked = spark.createDataFrame([(f, 0.02) for f in ("same", "flat", "other", "noisy", "none")] , "file_id string, ramp double")
    assert {r.file_id: r.shown for r in correct.shows_ramp(asked, probes).collect()} == {"same": True, "flat": False, "other": False, "noisy": True, "none": True}
    anyone = asked.withColumn("ramp", F.lit(None).cast("double"))
    assert {r.file_id: r.shown for r in correct.shows_ramp(anyone, probes).collect()}["other"]


def test_condemning_anchors(spark):
    kind = "file_id string, idx int, shift double, score double"
    shifts = {"two": [3, -3, 0.1], "three": [3, 3, -2.6, 2.5], "lone": [12, 0.1], "quiet": [1, None]}
    samples = spark.createDataFrame([(f, k, None if s is None else float(s), 0.3) for f, v in shifts.items() for k, s in enumerate(v)], kind)
    made = lambda full, winner, spread: spark.createDataFrame([(f, full, winner, spread) for f in shifts], "file_id string, full boolean, winner string, spread double")
    count = lambda *a: {f: len(list(g)) for f, g in itertools.groupby(sorted(r.file_id for r in correct.condemning(samples, made(*a)).collect()))}
    assert count(True, None, None) == {"three": 3}
    assert count(False, None, None) == {"three": 3, "two": 2} == count(True, "old", 90.0)
    assert count(True, "blocks", 20.0) == {"three": 3, "two": 2, "lone": 1} and count(True, "new", 90.0) == {"three": 3}


def test_resync_candidates(spark):
    cuts = spark.createDataFrame([("f", "current", 300.0), ("f", "original", 300.0), ("g", "current", 300.0), ("h", "current", 300.0)], "file_id string, candidate string, cut double")
    after = [("f", "current", 100.0, 0.4), ("f", "current", 500.0, 0.6), ("f", "current", 310.0, 9.0), ("f", "original", 100.0, 0.2), ("f", "original", 500.0, 0.2), ("g", "current", 100.0, 0.1), ("g", "current", 200.0, None), *[("h", "current", 100.0 * k, 2.6 if k < 5 else 0.0) for k in (1, 2, 4, 5)]]
    left = correct.resync_residuals(cuts, spark.createDataFrame(after, "file_id string, candidate string, t double, shift double"), 30.0)
    assert {(r.file_id, r.candidate): round(r.residual, 6) for r in left.collect()} == {("f", "current"): 0.5, ("f", "original"): 0.2}
    assert [tuple(r)[:2] for r in correct.best_candidate(left).collect()] == [("f", "original")]


def test_drift_needs_both_measurements(spark):
    points = spark.createDataFrame([(f, 6.0 * k, 0.001 * 6 * k + (k % 3) * 0.01) for f in ("both", "against", "weak") for k in range(220)], "file_id string, a double, c double")
    cues = points.select("file_id", F.lit(0).alias("idx"), F.lit(900_000).cast("long").alias("start"), F.lit(902_000).cast("long").alias("end"), F.lit("").alias("text")).distinct()
    onset = spark.createDataFrame([("both", 0.9), ("against", -0.9), ("weak", 0.2)], "file_id string, tilt double")
    got = correct.drift_fixes(points, cues, onset).collect()
    assert [(r.file_id, r.ratio, r.name) for r in got] == [("both", 1.001, "23.976 -> 24")] and abs(got[0].worst - 0.902) < 1e-6


def test_rewrites_are_taken_back(spark):
    kind = "file_id string, a double, c double"
    made = lambda f, bad, n=100: [(f, float(k), 3.0 if k < bad else 0.1) for k in range(n)]
    before = spark.createDataFrame(made("worse", 2) + made("fine", 2) + made("wrong", 2) + made("thin", 0, 20) + made("kept", 2), kind)
    after = spark.createDataFrame(made("worse", 40) + made("fine", 16) + made("thin", 20, 20) + made("kept", 90) + [("fine", 500.0 + k, 9.0) for k in range(99)], kind)
    files = [("worse", "fixed (Δ1.0s)", None, None), ("fine", "fixed", None, None), ("wrong", "fixed", 1.001, "wrong_subtitle"), ("thin", "fixed", None, None), ("kept", "already in sync", None, None)]
    got = correct.undone(before, after, spark.createDataFrame(files, "file_id string, status string, rate double, reason string"))
    assert {r.file_id: r.why for r in got.collect()} == {"worse": "worse", "fine": None, "wrong": "wrong_file", "thin": None, "kept": None}


def test_clip_tilts_and_leans(spark):
    clips = spark.createDataFrame([("walks", 60.0 * k, 0.1 * k) for k in range(10)] + [("short", 60.0 * k, 1.0 * k) for k in range(3)] + [("two", 0.0, 0.0), ("two", 500.0, 5.0), ("two", 300.0, None)], "file_id string, start double, shift double")
    lengths = spark.createDataFrame([(f, 600.0) for f in ("walks", "short", "two")], "file_id string, duration double")
    assert [(r.file_id, round(r.walk, 6)) for r in correct.clip_tilt(clips, lengths).collect()] == [("walks", 1.0)]
    probes = spark.createDataFrame([(1.5, 0.6, 0.8), (1.5, None, 0.9), (1.4, 0.9, 0.9)], "tilt double, rho double, keep_frac double")
    assert [r[0] for r in probes.select(correct.leans_like_a_rate()).collect()] == [True, False, False]
    assert robust.gate_level() is not None


def test_texts_of_outcomes(spark):
    kind = "flag string, status string, shift double, score string, action string"
    given = [("SUSPECT", "fixed", 1.0, "0.5", "quarantined -> /x; more"), ("SUSPECT", "", None, None, "none (action=off)"), ("unknown", "fixed", None, None, None), ("ok", "fixed (Δ2.3s)", 2.34, "0.61", None), (None, "fixed", None, None, None), ("ok", None, None, "0.9", None), (None, None, None, None, None)]
    got = spark.createDataFrame(given, kind).select(labels.outcome(*map(F.col, ("flag", "status", "shift", "score", "action"))).alias("o")).collect()
    assert [tuple(r.o) for r in got] == [("suspect", "SUSPECT — needs redownload (quarantined)"), ("suspect", "SUSPECT — needs redownload"), ("suspect", labels.NOT_VERIFIED), ("sync", "Synced (Δ2.3s), score 0.61"), ("sync", "Synced"), ("ok", "OK (score 0.9)"), ("ok", "OK")]
    errors = spark.createDataFrame([(None,), ([],), ([None, "VAD silence-skip: x"],), ([None, "timeout"],)], "e array<string>")
    assert [r[0] for r in errors.select(labels.unknown_reason(F.col("e"))).collect()] == ["check_failed", "check_failed", "no_speech_heard", "check_failed"]
    acts = [("off", False, True, "/q", True), ("remediate", True, True, "/q", True), ("quarantine", False, True, "/q", True), ("quarantine", False, True, None, True), ("blacklist", False, False, "/q", True), ("blacklist", False, True, "/q", False), ("blacklist", False, True, None, False), ("blacklist", False, True, None, True)]
    told = spark.createDataFrame(acts, "a string, d boolean, k boolean, m string, l boolean").select(labels.action_text(*map(F.col, "adkml"))).collect()
    assert [r[0] for r in told] == ["none (action=off)", "would remediate [dry-run]", "quarantined -> /q", "quarantine failed", "quarantined -> /q; blacklist skipped (no match)", "blacklist failed; quarantined -> /q instead", "blacklist failed, and could not quarantine either", "blacklisted"]
