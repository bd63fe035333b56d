"""Operators on small made-up rows: ties, empty tables, missing evidence, recovery of damages put in."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cuelattice.functions import labels, paths, text
from cuelattice.operators import align, dense, intervals, library, retime, robust, runs, state, verdict
from cuelattice.params import DEFAULTS
from cuelattice.sources import feeds, subtitle


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def cues(spark, data):
    return spark.createDataFrame(data, "file_id string, idx int, start long, end long, text string")


def test_nested_cue_does_not_shrink_a_gap(spark):
    c = cues(spark, [("f", 0, 0, 100, "a"), ("f", 1, 10, 20, "b"), ("f", 2, 130, 140, "c")])
    assert rows(intervals.gaps(c, 20)) == [("f", 100, 130)]


def test_union_and_complement(spark):
    c = cues(spark, [("f", 0, 10, 20, ""), ("f", 1, 20, 30, ""), ("f", 2, 50, 60, ""), ("f", 3, 52, 55, "")])
    assert rows(intervals.union(c)) == [("f", 10, 30), ("f", 50, 60)]
    lengths = spark.createDataFrame([("f", 100), ("none", 40)], "file_id string, duration long")
    assert rows(intervals.complement(c, lengths)) == [("f", 0, 10), ("f", 30, 50), ("f", 60, 100), ("none", 0, 40)]


def test_coverage_of_a_window_without_speech_is_zero(spark):
    w = spark.createDataFrame([("f", 0, 10), ("f", 40, 50)], "file_id string, lo long, hi long")
    s = spark.createDataFrame([("f", 5, 25)], "file_id string, start long, end long")
    for f in (intervals.coverage(w, s), intervals.banded_coverage(w, s, 7)):
        assert rows(f) == [("f", 0, 10, 5), ("f", 40, 50, 0)]


def test_nearest_takes_the_earlier_of_two(spark):
    p = spark.createDataFrame([("f", 1, 10), ("f", 2, 100)], "file_id string, idx long, t long")
    o = spark.createDataFrame([("f", 8), ("f", 12)], "file_id string, t long")
    assert rows(intervals.nearest(p, o, 5)) == [("f", 1, 10, 8)]


def test_loops_keep_the_first_of_five(spark):
    c = cues(spark, [("f", k, k, k + 1, "same" if k < 5 else "x") for k in range(9)])
    assert [r.idx for r in runs.collapse_loops(c, 5).orderBy("idx").collect()] == [0, 5, 6, 7, 8]
    assert runs.collapse_loops(c, 6).count() == 9


def test_match_gives_a_cue_to_its_earliest_segment(spark):
    kind = "file_id string, idx int, t double, toks array<string>"
    s = spark.createDataFrame([("f", 0, 5.0, ["alpha", "bravo"]), ("f", 1, 6.0, ["alpha", "bravo"])], kind)
    c = spark.createDataFrame([("f", 0, 5.0, ["alpha", "bravo"]), ("f", 1, 9.0, ["alpha", "bravo"])], kind)
    assert [tuple(r)[:3] for r in align.match(s, c, 30, 30).collect()] == [("f", 0, 0)]


def test_theil_sen_and_fit_recover_a_drift(spark):
    rng = random.Random(4)
    data = [("f", float(a), 0.002 * a + 1.5 + rng.uniform(-0.05, 0.05)) for a in range(0, 3000, 40)] + [("f", float(a), 60.0) for a in range(7, 400, 80)]
    p = spark.createDataFrame(data, "file_id string, a double, c double")
    line = robust.rate_fit(p).first()
    assert abs(line.slope - 0.002) < 1e-4 and abs(line.intercept - 1.5) < 0.1
    probe = robust.stretch_probe(p).first()
    assert abs(probe.slope - line.slope) < 1e-9 and probe.n_kept == line.n_kept


def test_spearman_without_variance_is_null(spark):
    p = spark.createDataFrame([("f", float(k), 1.0) for k in range(6)], "file_id string, a double, c double")
    assert robust.spearman(p).first().rho is None


def test_block_clusters_are_anchored_at_their_first(spark):
    base = [("f", float(k), 0.0) for k in range(1000, 1020)]
    off = [("f", 0.0, 3.0), ("f", 250.0, 3.0), ("f", 500.0, 3.0)]
    p = spark.createDataFrame(base + off, "file_id string, a double, c double")
    assert rows(runs.block_clusters(p, 2.5, 5.0, 300.0)) == [("f", 0.0, 250.0, 2, 3.0)]
    far = spark.createDataFrame([*base, *off, ("f", 700.0, 9.0)], "file_id string, a double, c double")
    assert rows(runs.block_clusters(far, 2.5, 5.0, 300.0)) == [("f", 700.0, 700.0, 1, 9.0)]


def test_sliding_medians_are_exact(spark):
    rng = random.Random(1)
    c = [rng.randrange(100) for _ in range(30)]
    p = spark.createDataFrame([("f", k, k, v) for k, v in enumerate(c)], "file_id string, idx int, a int, c int")
    got = {r.idx: r.med for r in runs.sliding_medians(p, 6).collect()}
    assert got == {k: statistics.median(c[k : k + 6]) for k in range(25)}


def test_order_of_rows_does_not_matter(spark):
    data = [("f", k, (k * 37) % 101, (k * 37) % 101 + 9, "t") for k in range(60)]
    shuffled = data[:]
    random.Random(2).shuffle(shuffled)
    one, other = cues(spark, data), cues(spark, shuffled).repartition(7)
    for f in (lambda c: intervals.union(c), lambda c: intervals.gaps(c, 1), lambda c: retime.deoverlap(c), lambda c: retime.jitter(c, 1, 9, 3)):
        assert rows(f(one)) == rows(f(other))


def test_damages(spark):
    c = cues(spark, [("f", k, 1000 * k, 1000 * k + 800, "one\nTwo") for k in range(20)])
    assert retime.shift_all(c, -1500).count() == 18
    assert retime.drop_span(c, 4000, 8000).count() == 16
    assert retime.cut_version(c, 4000, 8000).agg(F.max("start")).first()[0] == 15000
    assert retime.swap_lines(c, 5).where("text = 'Two\none'").count() == 4
    assert rows(retime.rescale(c, 1.0)) == rows(c)
    shift = intervals.best_shift(intervals.slot_score(retime.shift_all(cues(spark, [("f", k, a, a + 500, "") for k, a in enumerate((5000, 9000, 20000, 33000, 34000))]), 3000), cues(spark, [("f", k, a, a + 500, "") for k, a in enumerate((5000, 9000, 20000, 33000, 34000))]), 500, list(range(-10, 11))))
    assert shift.first()["shift"] == -6


def test_text_rules(spark):
    df = spark.createDataFrame([("(sighs) Hello there, Wonderful people of Århus ♪",), ("Wonderful (music) morning\nit rains",), (None,)], "t string")
    got = df.select(text.tokens(F.col("t")).alias("k"), text.is_nonspeech(F.col("t")).alias("n")).collect()
    assert got[0].k == [] and set(got[1].k) == {"wonderful", "morning", "rains"} and got[2].k == [] and not got[1].n
    pair = spark.createDataFrame([("i was there", "He left")], "a string, b string").select(text.cap_signal(F.col("a"), F.col("b"))).first()[0]
    assert pair is True
    r = spark.createDataFrame([("abcd", "bcde")], "a string, b string").select(text.sequence_ratio(F.col("a"), F.col("b"))).first()[0]
    assert abs(r - 0.75) < 1e-9
    parts = list(text.split_cue("First sentence here. Second one is longer than the first.", 0, 10, 30, 7))
    assert parts[0][0] == 0 and parts[-1][1] == 10 and " ".join(p for _, _, p in parts) == "First sentence here. Second one is longer than the first."


def test_labels_and_paths(spark):
    one = spark.range(1)
    got = one.select(
        labels.parse_delta(F.lit("fixed (Δ-2.50s, 3 sync blocks)")), labels.parse_sections(F.lit("fixed (Δ-2.50s, 3 sync blocks)")), labels.run_percent(F.lit(10), F.lit(10), F.lit(True)),
        paths.episode_code(F.lit("Show.s1e7.mkv")), paths.kind_for(F.lit("/tv/x/y.mkv"), ["/movies"], ["/tv"]), paths.media_root_for(F.lit("/tv/x/y.mkv"), ["/tv"]), labels.bytes_text(F.lit(2_500_000)),
    ).first()
    assert tuple(got) == (-2.5, 3, 99, "S01E07", "series", "/tv", "2.4 MB")


def test_state(spark):
    old = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("a", None, None), ("b", 3, "z"), (None, 9, None)], "k string, v int, w string")
    assert rows(state.upsert(old, new, ["k"], ("w",))) == sorted([("a", None, "x"), ("b", 3, "z"), (None, 9, "y")], key=repr)
    runs_ = spark.createDataFrame([(1, "running")], "id int, status string")
    with pytest.raises(RuntimeError):
        state.create_run(runs_, runs_)


def test_table_versions(spark, tmp_path):
    from cuelattice.schemas import SETTINGS

    t = state.Table(spark, f"file://{tmp_path}/t", SETTINGS)
    assert t.read().count() == 0
    for value in ("1", "2", "3"):
        t.upsert(spark.createDataFrame([("a", value)], SETTINGS), ["key"])
    assert rows(t.read()) == [("a", "3")] and len(t.versions()) == 2


def test_cascades(spark):
    yes = F.lit(True)
    one = spark.range(1)
    pick = lambda **e: tuple(one.select(verdict.final_verdict(e).alias("v")).first().v)
    assert pick(content_ok=yes) == ("ok", None)
    assert pick(content_ok=yes, swaps=yes, wrong=yes) == ("SUSPECT", "lines_out_of_order")
    assert pick(content_ok=yes, gap=yes, overrun=yes) == ("SUSPECT", "missing_lines")
    assert pick() == ("unknown", "no_speech_heard")
    clips = spark.createDataFrame([("few", 0.1), ("good", 0.0), ("good", 0.1), ("good", 0.0), ("late", 2.0), ("late", 2.1), ("late", 2.0)], "file_id string, shift double")
    none = spark.createDataFrame([], "file_id string, tilt double")
    assert {r.file_id: r.state for r in verdict.screen(clips, none).collect()} == {"few": "unknown", "good": "ok", "late": "needs_sync"}


def test_candidates_are_compared_on_common_regions(spark):
    data = [("f", "old", 1, 3.0, 0.5), ("f", "new", 1, 0.2, 0.5), ("f", "new", 2, 99.0, 0.0)]
    p = spark.createDataFrame(data, "file_id string, candidate string, region int, resid double, score double")
    assert verdict.choose_candidate(p).first().winner == "new"


def test_library_page_and_filter(spark):
    df = spark.createDataFrame([(1, "B", None), (2, "a", 5), (3, "b", 7)], "id int, title string, n int")
    assert [r.id for r in library.page(df, "-n", "id", ("n",), 1, 3).collect()] == [3, 2, 1]
    with pytest.raises(ValueError):
        library.page(df, "title", "id", ("n",), 1, 3)
    assert {r.id for r in df.where(library.file_filter(title="b")).collect()} == {1, 3}


def test_params_can_be_scaled():
    assert DEFAULTS.scaled("min_gap", 1.25).min_gap == 25.0 and DEFAULTS.scaled("loop_min", 0.8).loop_min == 4


def test_subtitles_are_read_and_written(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,500\n<i>Hej</i>\nder\n\n2\n00:00:03,000 --> 00:00:04,000\nblåbær\n".encode("cp1252"))
    (tmp_path / "b.vtt").write_text("WEBVTT\n\n00:05.000 --> 00:06.000\nHi\n")
    (tmp_path / "c.ass").write_text("[Events]\nFormat: Layer, Start, End, Style, Text\nDialogue: 0,0:00:01.50,0:00:02.00,Default,{\\b1}One\\NTwo, three\n")
    got = {(r.file_id[-5:], r.idx): (r.start_ms, r.end_ms, r.text) for r in subtitle.read(spark, f"file://{tmp_path}").collect()}
    assert got == {("a.srt", 0): (1000, 2500, "Hej\nder"), ("a.srt", 1): (3000, 4000, "blåbær"), ("b.vtt", 0): (5000, 6000, "Hi"), ("c.ass", 0): (1500, 2000, "One\nTwo, three")}
    made = subtitle.as_srt(subtitle.read(spark, f"file://{tmp_path}", "a.srt")).first().srt
    assert [c for c in subtitle.parse(made)] == [(1000, 2500, "Hej\nder"), (3000, 4000, "blåbær")]


def test_feeds(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("start_s\tend_s\n1.0\t2.5\nx\ty\n3.0\t3.0\n")
    assert [(r.start, r.end) for r in feeds.speech_intervals(spark, f"file://{tmp_path}/v.tsv").collect()] == [(1.0, 2.5)]
    files = spark.createDataFrame([("/m/A.mkv", "/m", "A.mkv", ".mkv"), ("/m/A.en.srt", "/m", "A.en.srt", ".srt"), ("/n/B.mkv", "/n", "B.mkv", ".mkv"), ("/n/subs/x.srt", "/n/subs", "x.srt", ".srt")], "path string, dir string, name string, ending string")
    assert rows(feeds.pairs(files)) == [("/m/A.mkv", "/m/A.en.srt", "en"), ("/n/B.mkv", "/n/subs/x.srt", None)]


def test_archives(spark):
    from cuelattice.operators import archive

    kind = "path string, dir string, name string, ending string, size long, mtime long"
    files = spark.createDataFrame([("/b/s/a.20240101-010203.srt", "/b/s", "a.20240101-010203.srt", ".srt", 3, 5), ("/m/V.da.srt", "/m", "V.da.srt", ".srt", 3, 9), ("/m/V.en.srt", "/m", "V.en.srt", ".srt", 3, 7), ("/m/V.srt", "/m", "V.srt", ".srt", 3, 2)], kind)
    assert [(r.relative, r.original) for r in archive.archived(files, "/b/").collect()] == [("s/a.20240101-010203.srt", "a.srt")]
    videos = spark.createDataFrame([("/m/V.mkv", "/m", "V", 3)], "video_path string, dir string, stem string, since long")
    assert [r.subtitle_path for r in archive.fresh_sibling(files, videos, "en").collect()] == ["/m/V.en.srt"]


def test_sequence_order_reads_whole_texts(spark, tmp_path):
    """Texts that differ only after their first 200 characters are told apart, as difflib does."""
    import difflib
    import re

    from cuelattice.plans import words

    long = [c * 120 + "".join(chr(97 + (i * i * k + i) % 26) for i in range(140)) for k, c in ((3, "a"), (5, "a"), (7, "b"), (11, "b"))]
    said = {1: ["one two three", "four five six"], 2: [long[0], long[1]], 3: ["q" * 200 + " short tail", "q" * 200 + " 0123456789" * 9], 4: [long[2], "x" * 10, long[3]]}
    rows = [(c, i, "user", t) for c, ts in said.items() for i, t in enumerate(ts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plain = lambda t: re.sub("[^a-z0-9 ]", "", t.lower())
    want, cut = {}, {}
    for size, out in ((None, want), (200, cut)):
        for c, ts in said.items():
            for i, (a, b) in enumerate(zip(ts, ts[1:], strict=False)):
                a, b = plain(a[:size]), plain(b[:size])
                told = f"{a} {b}" if i % 2 == 0 else f"{b} {a}"
                gap = difflib.SequenceMatcher(None, told, f"{a} {b}").ratio() - difflib.SequenceMatcher(None, told, f"{b} {a}").ratio()
                out[c, i] = True if gap <= -0.1 else False if gap >= 0.1 else None
    assert want != cut
    assert {(r.conv_id, r.turn): r.swapped for r in words.sequence_order(spark, str(tmp_path)).collect()} == want


def series(spark, points, key="f"):
    return spark.createDataFrame([(key, float(a), float(c)) for a, c in points], "file_id string, a double, c double")


def test_gate_levels_of_stated_probes(spark):
    base = {"slope": 0.0005, "intercept": 0.0, "tilt": 1.0, "rho": 0.5, "gain": 0.12, "resid": 0.2, "n_kept": 150, "keep_frac": 0.96, "span": 1500.0}
    cases = [({}, 1), ({"tilt": 0.7}, 0), ({"gain": 0.0}, 0), ({"tilt": 2.0, "rho": 0.8, "gain": 0.3}, 2), ({"slope": 0.001, "tilt": 0.9, "rho": 0.54, "gain": 0.08, "resid": 0.39}, 2)]
    cases += [({"tilt": 4.7, "rho": 0.88, "gain": 0.62, "resid": 0.52}, 2), ({"n_kept": 39}, 0), ({"slope": 0.09, "tilt": 9.0, "rho": 0.99, "gain": 3.0}, 0), ({"rho": None}, 0), ({"keep_frac": 0.8}, 0)]
    df = spark.createDataFrame([{**base, **c, "want": w} for c, w in cases], "slope double, intercept double, tilt double, rho double, gain double, resid double, n_kept long, keep_frac double, span double, want int")
    assert all(r.level == r.want for r in df.select("want", robust.gate_level().alias("level")).collect())
    flat = spark.createDataFrame([(0.96, 0.9, 0.2, 0.5), (0.96, 0.4, 0.1, 0.29), (0.96, 0.4, 0.1, 0.31), (0.8, 0.1, 0.1, 0.1), (0.96, 1.0, 0.1, 0.1)], "keep_frac double, tilt double, intercept double, resid double")
    assert [tuple(r) for r in flat.select(robust.is_flat(), robust.is_flat(True)).collect()] == [(True, False), (True, True), (True, False), (False, False), (False, False)]


def test_a_probe_reads_the_points_it_keeps(spark):
    line = [(a, 0.002 * a) for a in range(0, 1000, 20)]
    mess = [(a + 7, 30.0 + a % 90) for a in range(0, 1000, 40)]
    got = robust.stretch_probe(series(spark, line + mess)).first()
    assert got.n_kept == 50 and got.n_raw == 75 and got.resid < 1e-9 and got.rho > 0.999 and abs(got.tilt - 1.96) < 1e-6 and abs(got.keep_frac - 50 / 75) < 1e-9
    assert abs(got.gain - statistics.median(abs(c - statistics.median(x for _, x in line)) for _, c in line)) < 1e-9


def test_measured_rates_snap_to_known_ones(spark):
    def snapped(slope, noise=0.0):
        ratio = 1 / (1 - slope)
        pts = [(a, slope * a + 0.4 + noise * (a % 3 - 1)) for a in range(0, 1500, 10)]
        fit = spark.createDataFrame([("f", slope, 0.4)], "file_id string, slope double, intercept double")
        r = robust.snap_rate(series(spark, pts), fit).first()
        return r.ratio, r.name, ratio

    ratio, name, _ = snapped(1 - 1000 / 1001)
    assert name == "23.976/24" and ratio == 1001 / 1000
    assert snapped(1 - 25 / 24)[:2] == (24 / 25, "25/24")
    ratio, name, measured = snapped(0.02)
    assert ratio == measured and name == "stretch +2.04%"


def test_regions_join_absorb_drop_and_refuse(spark):
    found = lambda pts: [(r.n, round(r.med, 1)) for r in runs.regions(series(spark, pts)).orderBy("region").collect()]
    flat = lambda value, *span: [(t, value) for t in range(*span, 20)]
    assert found(flat(15.1, 0, 380) + flat(0.0, 400, 1260)) == [(19, 15.1), (43, 0.0)]
    assert found(flat(0.1, 0, 660) + [(680, -6.6)] + flat(0.1, 700, 960) + flat(-18.5, 980, 1240)) == [(47, 0.1), (13, -18.5)]
    drift = [(200, 37.2), (300, 21.7), (340, 14.8), (380, 5.6), (400, 2.0), (500, -1.1), (520, -2.8), (560, -11.8), (680, -31.0), (700, -34.4), (720, -38.8), (780, -36.3)]
    assert found(drift) == []
    assert found(flat(0.0, 0, 300) + [(320, -12.0)] + flat(-25.0, 340, 700)) == [(15, 0.0), (18, -25.0)]
    assert found(flat(0.0, 0, 300) + [(320, 40.0)] + flat(-25.0, 340, 700)) == []
    assert found(flat(0.1, 0, 400) + [(401, 30.0)] + flat(-18.5, 420, 800)) == []


def test_resync_plans_cut_in_the_widest_pause(spark):
    lines = cues(spark, [("f", k, t * 1000, t * 1000 + 2000, "x") for k, t in enumerate([*range(0, 370, 10), *range(398, 1300, 10)])])
    pts = [(t, 15.1) for t in range(20, 380, 20)] + [(t, 0.0) for t in range(400, 1260, 20)]
    got = runs.resync_plan(lines, series(spark, pts)).orderBy("region").collect()
    assert [(r.shift, r.n) for r in got] == [(15.1, 18), (0.0, 43)] and got[0].lo_ms is None and got[1].hi_ms is None
    assert got[0].hi_ms == got[1].lo_ms == 380_000 and abs(got[0].cut_audio - 395.1) < 1e-9
    assert runs.resync_plan(lines, series(spark, [(t, 0.2) for t in range(0, 1200, 60)])).count() == 0


def test_signatures_need_every_reading(spark):
    steady = [(20.0 + 1280.0 * i / 61, 1.4 * i / 61) for i in range(62)]
    got = robust.drift_signature(series(spark, steady)).withColumn("passed", robust.signature_passes()).first()
    assert abs(got.tilt - 1.4) < 1e-6 and len(got.left_out) == 8 and got.rho > 0.99 and got.passed == got.tilt and got.binned > 1.2
    case = spark.createDataFrame([(-1.393, -0.879, [-1.3, -1.4, -1.35, -1.2, -1.45, -1.3, -1.38, -1.25]), (-1.393, -0.95, [-1.3] * 7 + [None]), (-1.393, -0.95, [-1.3] * 7 + [0.9]), (-1.393, -0.95, [-1.3] * 8), (1.393, None, [1.3] * 8)], "tilt double, binned double, left_out array<double>")
    assert [r[0] for r in case.select(robust.signature_passes()).collect()] == [None, None, None, -1.393, None]
    block = [(a, 0.0 if a < 1100 else 6.0) for a in range(0, 1300, 20)]
    assert robust.drift_signature(series(spark, block)).select(robust.signature_passes()).first()[0] is None
    assert robust.drift_signature(series(spark, steady[:19])).count() == 0


def test_best_cue_is_found_before_it_is_judged(spark):
    kind = "file_id string, idx int, t double, toks array<string>"
    s = spark.createDataFrame([("f", 0, 5.0, ["alpha", "beta", "gamma"])], kind)
    c = spark.createDataFrame([("f", 0, 5.0, ["alpha"]), ("f", 1, 9.0, ["beta", "gamma", "delta"])], kind)
    assert align.match(s, c, 30, 30).count() == 0
    assert align.match(s, c.where("idx = 1"), 30, 30).count() == 1


def test_runs_keep_side_and_cue_span(spark):
    pts = [(a, 0.0) for a in range(0, 400, 10)] + [(a, -4.0) for a in range(400, 500, 10)] + [(a, 0.0) for a in range(500, 900, 10)]
    got = runs.deviant_runs(series(spark, pts).withColumn("idx", F.col("a").cast("int")), 6, 2.0, 0.5).collect()
    assert len(got) == 1 and got[0].dev == -4.0 and got[0].cue_from >= 375 and got[0].cue_to <= 494.0 + 26 and got[0].n >= 10


def test_onset_tilt_follows_shifts_and_drifts(spark):
    rng = random.Random(8)
    onsets = sorted(rng.uniform(0, 1300) for _ in range(250))
    heard = spark.createDataFrame([("f", t) for t in onsets], "file_id string, t double")
    tilt = lambda move: robust.onset_tilt(spark.createDataFrame([("f", move(t)) for t in onsets], "file_id string, t double"), heard).first()
    assert abs(tilt(lambda t: t).tilt) < 1e-9 and abs(tilt(lambda t: t - 0.4).tilt) < 0.1
    assert abs(tilt(lambda t: t - 0.001 * t).tilt - 1.3) < 0.35
    assert tuple(robust.onset_tilt(heard.limit(10), heard).first()) == ("f", None, 10)


def test_block_witness_sees_a_moved_block(spark):
    rng = random.Random(5)
    t, spoken = 5.0, []
    while t < 900:
        spoken.append((t, t + rng.uniform(1.0, 3.5)))
        t = spoken[-1][1] + rng.uniform(0.4, 6.0)
    speech = spark.createDataFrame([("f", *s) for s in spoken], "file_id string, start double, end double")
    moved = lambda by: spark.createDataFrame([("f", a + (by if 300 < a < 480 else 0), b + (by if 300 < a < 480 else 0)) for a, b in spoken], "file_id string, start double, end double")
    assert intervals.block_witness(moved(0.0), speech).first().witness is False
    assert intervals.block_witness(moved(6.0), speech).first().witness is True
    assert intervals.block_witness(moved(6.0), speech.limit(0)).first().witness is False


def test_greedy_passes_over_one_file(spark):
    windows = spark.createDataFrame([("f", 0, 30), ("f", 40, 70), ("f", 85, 260), ("f", 300, 310)], "file_id string, lo int, hi int")
    assert rows(runs.cluster_windows(windows, 20, 240)) == sorted([("f", 0.0, 70.0, 2), ("f", 85.0, 260.0, 1), ("f", 300.0, 310.0, 1)], key=repr)
    quiet = spark.createDataFrame([("f", 95.0, 97.0), ("f", 280.0, 282.0)], "file_id string, start double, end double")
    assert rows(runs.chunk_plan(quiet, spark.createDataFrame([("f", 250.0)], "file_id string, duration double"), 100, 10, 15)) == sorted([("f", 0.0, 96.0), ("f", 96.0, 196.0), ("f", 196.0, 250.0)], key=repr)
    parts = spark.createDataFrame([("f", k, float(k), "x" * n) for k, n in enumerate((5, 5, 50, 3, 3, 3))], "file_id string, idx int, start double, text string")
    assert rows(runs.batches(parts, 3, 20)) == [("f", 0, 0), ("f", 1, 0), ("f", 2, 1), ("f", 3, 2), ("f", 4, 2), ("f", 5, 2)]


def test_order_verdicts_are_those_of_difflib(spark):
    cases = [("the cat sat on the mat", "the cat sat", "on the mat"), ("on the mat the cat sat", "the cat sat", "on the mat"), ("nothing alike here", "the cat sat", "on the mat")]
    got = spark.createDataFrame(cases, "told string, l1 string, l2 string").select(text.order_verdict(F.col("told"), F.col("l1"), F.col("l2"))).collect()
    assert [r[0] for r in got][:2] == [False, True]


def test_dense_anchors_use_a_cue_once_a_clip(spark):
    cue = [(1, 0, 10.0, ["river", "bridge"]), (1, 1, 55.0, ["river", "bridge"]), (1, 2, 20.0, ["lonely"])]
    seg = [(1, 0, 12.0, ["river", "bridge", "early"]), (1, 1, 14.0, ["river", "bridge"]), (1, 2, 31.0, ["river", "bridge"]), (1, 3, 32.0, ["lonely"])]
    kind = "file_id long, idx long, t double, toks array<string>"
    got = dense.dense_anchors(spark.createDataFrame(seg, kind), spark.createDataFrame(cue, kind), 30.0, 30.0, 60.0).collect()
    assert sorted((r.clip, r.s_idx, r.c_idx) for r in got) == [(0, 0, 0), (1, 2, 0)]
    assert dense.dense_anchors(spark.createDataFrame([], kind), spark.createDataFrame(cue, kind), 30.0, 30.0, 60.0).count() == 0


def test_swaps_are_told_by_words_wherever_the_cue_is(spark):
    first, second = "Nobody walked across yesterday", "because bridges collapsed overnight"
    cue = [(1, 0, 70.0, f"{second}\n{first}"), (1, 1, 71.0, f"{first}\n{second}"), (1, 2, 72.0, f"- {second}\n- {first}"), (1, 3, 500.0, f"{second}\n{first}"), (1, 4, 70.0, first), (1, 5, 70.0, None)]
    seg = [(1, 0, 2.0, f"{first} {second}"), (1, 1, 300.0, "nothing alike")]
    kind = "file_id long, idx long, t double, text string"
    cues, segments = spark.createDataFrame(cue, kind), spark.createDataFrame(seg, kind)
    got = dense.swap_verdicts(cues, segments)
    assert {r.idx: r.swapped for r in got.collect()} == {0: True, 1: False}
    (row,) = dense.swap_evidence(got).collect()
    assert (row.swapped, row.checked, row.rate) == (1, 2, 0.5)


def test_bridge_needs_one_segment_with_words_of_both_lines(spark):
    cues = spark.createDataFrame([(1, 0, 0.0, 4.0, ["apple"], ["pear"]), (1, 1, 50.0, 54.0, ["apple"], ["pear"])], "file_id long, idx long, start double, end double, first array<string>, second array<string>")
    seg = spark.createDataFrame([(1, 0.0, 2.0, ["apple"]), (1, 2.0, 4.0, ["pear"]), (1, 53.0, 60.0, ["pear", "apple"])], "file_id long, start double, end double, toks array<string>")
    assert {r.idx: r.bridge for r in dense.bridged(cues, seg, 10.0).collect()} == {0: False, 1: True}


def test_scan_takes_the_earliest_of_the_fullest_clips_with_a_cue(spark):
    spans = lambda *x: spark.createDataFrame([(1, *s) for s in x], "file_id long, start long, end long")
    regions = spark.createDataFrame([(1, 0, 100)], "file_id long, lo long, hi long")
    (row,) = dense.scan_regions(regions, spans((20, 22), (60, 62)), spans((0, 10), (20, 26), (60, 66)), 10, 5, 2, 30).collect()
    assert (row.clip_at, row.covered) == (20, 6)
    assert dense.scan_regions(regions, spans((200, 210)), spans((0, 10)), 10, 5, 2, 30).count() == 0


def test_window_text_and_declared_music(spark):
    c = spark.createDataFrame([(1, 1, 0, 9, "[Song plays]"), (1, 2, 9, 12, "second"), (1, 3, 9, 40, None)], "file_id long, idx long, start long, end long, text string")
    w = spark.createDataFrame([(1, 0, 9), (1, 10, 20)], "file_id long, lo long, hi long")
    assert {r.lo: r.text for r in dense.window_texts(w, c, 5).collect()} == {0: "[Song plays]\nsecond\n", 10: ""}
    gaps = spark.createDataFrame([(1, 9, 100), (1, 9, 900), (1, 12, 60)], "file_id long, g0 long, g1 long")
    got = dense.declared_music(gaps, c, text.declares_music(F.col("text")), 240).collect()
    assert {(r.g0, r.g1): r.declared for r in got} == {(9, 100): True, (9, 900): False, (12, 60): False}
