"""Learned path mapping, rows merged by column, seeded blocks and rates."""

import math

from pyspark.sql import functions as F

from cuelattice.functions import paths
from cuelattice.operators import catalog, intervals, library
from cuelattice.sources import feeds, probe


def frame(spark, column, values):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def learned(spark, ours, theirs):
    o, t = frame(spark, "path", ours), frame(spark, "path", theirs)
    matches = catalog.same_files(o, t)
    pairs = catalog.learned_pairs(matches)
    return {tuple(r) for r in pairs.collect()}, {r.theirs: (r.ours, r.how) for r in catalog.resolved(o, t, pairs, matches).collect()}


def test_prefix_is_learned_from_shared_endings(spark):
    ours = [f"/media/tv/Billions/Season 1/B S01E0{k}.mkv" for k in (1, 2)]
    pairs, found = learned(spark, ours, [p.replace("/media", "") for p in ours])
    assert pairs == {("/tv", "/media/tv", 2)} and found == {p.replace("/media", ""): (p, "learned") for p in ours}


def test_endings_that_several_files_share_wait_for_the_prefix(spark):
    ours = ["/m/a/Show/S1/e1.mkv", "/m/b/Show/S1/e1.mkv", "/m/a/Other/S1/e2.mkv", "/m/here.mkv"]
    theirs = ["/x/a/Show/S1/e1.mkv", "/x/b/Show/S1/e1.mkv", "/x/a/Other/S1/e2.mkv", "/m/here.mkv", "/y/nothing/like/it.mkv"]
    _, found = learned(spark, ours, theirs)
    assert found["/x/a/Other/S1/e2.mkv"] == (ours[2], "learned") and found["/m/here.mkv"] == ("/m/here.mkv", "exact")
    assert [found[t] for t in theirs[:2]] == [(ours[0], "learned"), (ours[1], "learned")] and found["/y/nothing/like/it.mkv"] == (None, "unmatched")


def test_ending_without_a_prefix_that_fits_and_empty_tables(spark):
    o, t = frame(spark, "path", ["/p/Show/S1/e1.mkv"]), frame(spark, "path", ["/q/Show/S1/e1.mkv"])
    matches = catalog.same_files(o, t)
    none = catalog.learned_pairs(matches).limit(0)
    assert [tuple(r) for r in catalog.resolved(o, t, none, matches).collect()] == [("/q/Show/S1/e1.mkv", "/p/Show/S1/e1.mkv", "ending")]
    set_by_hand = paths.path_pairs(F.lit("/p=/q"))
    assert [r.how for r in catalog.resolved(o, t, none, matches, set_by_hand).collect()] in (["exact"], ["ending"])
    assert learned(spark, [], []) == (set(), {})


def test_many_files_of_one_name_make_no_pairs(spark):
    ours = spark.range(20_000).select(F.concat(F.lit("/m/"), "id", F.lit("/Show/S1/e1.mkv")).alias("path"))
    theirs = spark.range(20_000).select(F.concat(F.lit("/x/"), "id", F.lit("/Show/S1/e1.mkv")).alias("path"))
    matches = catalog.same_files(ours, theirs)
    assert matches.count() == 20_000 and {tuple(r) for r in catalog.learned_pairs(matches).collect()} == {("/x", "/m", 20_000)}


def test_columns_come_from_the_first_source_that_has_them(spark):
    a = spark.createDataFrame([("k", None, 1)], "id string, x string, y long")
    b = spark.createDataFrame([("k", "b", 2), ("l", "b2", None)], "id string, x string, y long")
    c = spark.createDataFrame([("l", 5), ("m", 6)], "id string, z long")
    got = {r.id: r.asDict() for r in catalog.merged({"a": a, "b": b, "c": c}, "id", ["x", "y", "z"]).collect()}
    assert got["k"] == {"id": "k", "x": "b", "x_from": "b", "y": 1, "y_from": "a", "z": None, "z_from": None}
    assert (got["l"]["x"], got["l"]["y"], got["l"]["z_from"]) == ("b2", None, "c") and got["m"]["z"] == 6


def test_video_rows_carry_ids_and_look_for_languages_only_where_needed(spark):
    scanned = spark.createDataFrame([("/m/a.mkv", "Guess", "S01E01", True, 1, 10), ("/m/b.mkv", "", None, False, 1, 10), ("/m/c.mkv", "C", None, False, 2, 10)], "video_path string, title string, season_episode string, has_external boolean, mtime long, size long")
    connector = spark.createDataFrame([("/m/a.mkv", "Real", "S02E03", None, 7), ("/m/gone.mkv", "Gone", None, 1, 1)], "video_path string, title string, season_episode string, series_id long, episode_id long")
    probes = spark.createDataFrame([("/m/a.mkv", ["xx"]), ("/m/b.mkv", ["yy"]), ("/m/c.mkv", [])], "video_path string, langs array<string>")
    before = spark.createDataFrame([("/m/a.mkv", 3, 4, 1, 10, ["en"]), ("/m/b.mkv", None, None, 1, 10, ["en"]), ("/m/c.mkv", None, None, 1, 10, ["en"])], "video_path string, series_id long, episode_id long, mtime long, size long, langs array<string>")
    got = {r.video_path[3]: r for r in catalog.video_rows(scanned, connector, probes, before).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].title, got["a"].season_episode, got["a"].series_id, got["a"].series_id_from, got["a"].episode_id, got["a"].langs, got["a"].matched) == ("Real", "S02E03", 3, "before", 7, None, True)
    assert (got["b"].title, got["b"].langs, got["b"].langs_from, got["b"].has_subtitle) == ("/m", ["en"], "before", True)
    assert (got["c"].langs, got["c"].langs_from, got["c"].has_subtitle, got["c"].matched) == ([], "probe", False, False)


def test_seeded_blocks_keep_their_distance_however_rows_are_dealt(spark):
    files = spark.range(3000).select(F.col("id").alias("file_id"), F.when(F.col("id") % 50 == 0, 100_000).otherwise(1_200_000 + F.col("id") * 1000).alias("duration"))
    make = lambda f: sorted(tuple(r) for r in catalog.spaced_blocks(f, 2, 3, 90_000, 300_000, 30_000, 5).collect())
    got = make(files)
    assert got == make(files.repartition(17)) and got != sorted(tuple(r) for r in catalog.spaced_blocks(files, 2, 3, 90_000, 300_000, 30_000, 6).collect())
    by, lengths = {}, {r.file_id: r.duration for r in files.collect()}
    for f, k, lo, hi, shift in got:
        by.setdefault(f, []).append((k, lo, hi))
        assert 90_000 <= hi - lo <= 300_000 and 2_000 <= abs(shift) <= 20_000
    for f, own in by.items():
        assert [k for k, _, _ in sorted(own)] == list(range(len(own))) and 0 <= min(lo for _, lo, _ in own) and max(hi for _, _, hi in own) <= lengths[f]
        assert all(b[1] - a[2] >= 30_000 for a, b in zip(sorted(own), sorted(own)[1:]))
        assert len(own) in (2, 3) or lengths[f] == 100_000
    assert {len(v) for v in by.values()} >= {2, 3}


def test_rates_are_even_by_their_logarithm(spark):
    got = catalog.drawn_rate(spark.range(4000).withColumnRenamed("id", "file_id"), 0.0015, 0.05, 10_000, 3).collect()
    assert all(0.0015 <= abs(r.rate) <= 0.05 and abs(r.offset) <= 10_000 for r in got)
    low = sum(abs(r.rate) < math.sqrt(0.0015 * 0.05) for r in got) / len(got)
    assert 0.45 < low < 0.55 and 0.45 < sum(r.rate > 0 for r in got) / len(got) < 0.55


def test_cues_move_with_their_block(spark):
    cues = spark.createDataFrame([("a", 0, 1_000, 1_100), ("a", 1, 5_000, 6_000), ("a", 2, 9_000, 9_500)], "file_id string, idx long, start long, end long")
    blocks = spark.createDataFrame([("a", 0, 0, 2_000, -5_000), ("a", 1, 5_000, 9_000, 2_500)], "file_id string, block long, start long, end long, shift long")
    assert sorted(tuple(r) for r in catalog.shifted_blocks(cues, blocks).collect()) == [("a", 0, 0, 200), ("a", 1, 7_500, 8_500), ("a", 2, 9_000, 9_500)]


def test_probes(spark):
    bodies = ['{"streams":[{"index":0,"codec_type":"audio","tags":{"language":"ger"}},{"index":1,"codec_type":"audio","tags":{"title":"English (description)"}},{"index":2,"codec_type":"audio","tags":{"language":"und","title":"English"}}],"format":{"duration":"12.5"}}', '{"streams":[{"index":0,"codec_type":"audio","tags":{"language":"DAN"}},{"index":1,"codec_type":"subtitle","tags":{"language":"fra"}},{"index":2,"codec_type":"subtitle"},{"index":3,"codec_type":"subtitle","tags":{"language":"unk"}}]}', "broken", None, "{}"]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, body string")
    audio = probe.streams(F.col("body"), "audio")
    got = [tuple(r) for r in df.select(probe.english_index(audio), probe.audio_language(audio), probe.embedded_languages(probe.streams(F.col("body"), "subtitle")), probe.duration(F.col("body"))).collect()]
    assert got == [(2, "en", [], 12.5), (None, "da", ["fr"], None), *[(None, None, [], None)] * 3]


def test_completed_rows_supersede_skipped_ones(spark):
    rows = [("m", "a", 1, "skipped"), ("m", "a", 2, "ok"), ("m", "a", 3, "error"), ("m", "a", 4, "skipped"), ("m", None, 1, "skipped"), ("m", None, 2, "skipped"), ("n", "a", 1, None), ("n", "a", 2, "skipped")]
    got = library.resumed(spark.createDataFrame(rows, "model string, scenario string, n long, status string"), ["model", "scenario"], "n", "status")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("m", "a", 3, "error"), ("m", None, 1, "skipped"), ("n", "a", 1, None)]))


def test_touched_lines_and_order_of_episodes(spark):
    df = spark.createDataFrame([([3, 1, 5], [5, 9, 1, 7]), ([], [2])], "injected array<int>, fixed array<int>")
    assert [tuple(r.t) for r in df.select(library.touched(F.col("injected"), F.col("fixed")).alias("t")).collect()] == [(3, 2, 0.667, [7, 9]), (0, 0, None, [2])]
    files = spark.createDataFrame([("S01E10", "/a/x.mkv"), (None, "/a/Zeta.mkv"), ("S01E02", "/a/y.mkv"), ("", "/b/alpha.mkv")], "code string, path string")
    assert [r.path for r in files.orderBy(library.episode_order(F.col("code"), F.col("path"))).collect()] == ["/a/y.mkv", "/a/x.mkv", "/b/alpha.mkv", "/a/Zeta.mkv"]


def test_same_timing(spark):
    kind = "file_id string, idx int, start long"
    old = spark.createDataFrame([("a", 0, 1), ("a", 1, 5), ("b", 0, 1), ("c", 0, 2)], kind)
    new = spark.createDataFrame([("a", 0, 1), ("a", 1, 5), ("b", 0, 2), ("c", 0, 2), ("c", 1, 9), ("d", 0, 1)], kind)
    assert {r.file_id: r.same for r in intervals.same_timing(old, new).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_current_paths_and_segments(spark):
    body = '{"data":[{"sonarrEpisodeId":1,"subtitles":[{"code2":"en","path":null},{"code2":"en","path":"/a.en.srt"},{"code2":"en","path":"/b.en.srt"},{"code2":"da","path":"/a.da.srt"}]},{"sonarrEpisodeId":2}]}'
    got = feeds.current_paths(spark.createDataFrame([(body,), ("broken",)], "body string")).collect()
    assert sorted(map(tuple, got)) == [(1, "da", "/a.da.srt"), (1, "en", "/a.en.srt")]
    raw = spark.createDataFrame([(("1.5", "2", " hi ", "0.1", "x", None),)], "r struct<start:string,end:string,text:string,no_speech_prob:string,avg_logprob:string,compression_ratio:string>")
    assert tuple(raw.select(feeds.normal_segment(F.col("r")).alias("s")).first().s) == (1.5, 2.0, "hi", 0.1, None, None)
