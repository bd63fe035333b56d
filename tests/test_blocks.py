"""Matching blocks against ``difflib``, drift and word quality on small and planted transcripts."""

import difflib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelattice.operators import blocks
from cuelattice.plans import transcripts

KIND = "file_id long, pos long, token string"


def sides(spark, files):
    make = lambda k: spark.createDataFrame([(f, p, t) for f, pair in files.items() for p, t in enumerate(pair[k])], KIND)
    return make(0), make(1)


def plain(a, b):
    return [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]


@pytest.mark.parametrize("grams", [(1,), (8, 3, 1), (2, 1)])
def test_blocks_are_those_of_difflib(spark, grams):
    rng, files = random.Random(8), {}
    for f in range(40):
        letters = rng.choice(["ab", "abcdef", "abcdefghijklmnopqrstuvwxyz"])
        a = rng.choices(letters, k=rng.randrange(0, 120))
        b = [t for t in a if rng.random() > 0.15] if f % 2 else rng.choices(letters, k=rng.randrange(0, 120))
        for _ in range(rng.randrange(6)):
            b.insert(rng.randrange(len(b) + 1), rng.choice(letters))
        files[f] = (a, b)
    files[90] = (["same"] * 40, ["same"] * 25)
    files[91] = (["x"], [])
    files[92] = ([None, "x"], ["x", None])
    got = {}
    for r in blocks.matching_blocks(*sides(spark, files), grams).collect():
        got.setdefault(r.file_id, []).append((r.a, r.b, r.size))
    for f, (a, b) in files.items():
        want = plain(a, b) if f != 92 else [(1, 0, 1)]
        merged = []
        for x, y, n in sorted(got.get(f, [])):
            if merged and merged[-1][0] + merged[-1][2] == x and merged[-1][1] + merged[-1][2] == y:
                merged[-1] = (*merged[-1][:2], merged[-1][2] + n)
            else:
                merged.append((x, y, n))
        assert merged == want, f


def test_matched_tokens_are_those_of_difflib():
    rng = random.Random(2)
    for _ in range(300):
        letters = rng.choice(["ab", "abcdef", "abcdefghijklmnopqrstuvwxyz"])
        a, b = (rng.choices(letters, k=rng.randrange(0, 90)) for _ in range(2))
        if rng.random() < 0.6:
            b = [t for t in a if rng.random() > 0.1] + b[:3]
        assert blocks.matched_tokens(np.array(a, dtype=str), np.array(b, dtype=str)) == sum(n for _, _, n in plain(a, b))


def lines(spark, rows):
    return spark.createDataFrame(rows, "file_id long, start double, end double, token string")


def test_drift_of_equal_missing_and_one_sided(spark):
    a = lines(spark, [(1, 1.0, 2.0, "hello there"), (1, 5.0, 6.0, "how are you"), (1, 9.0, 10.0, "fine"), (2, 1.0, 2.0, "one"), (3, 0.0, 1.0, "only here")])
    b = lines(spark, [(1, 1.4, 2.4, "hello there"), (1, 9.0, 10.0, "fine"), (2, 1.0, 2.0, "one"), (4, 0.0, 1.0, "only there")])
    got = {r.file_id: r for r in blocks.drift(a, b).collect()}
    assert (got[1].matched, got[1].start_max, got[1].matched_pct, got[1].similarity) == (2, 0.4, 66.7, 0.8)
    assert (got[2].matched_pct, got[2].start_max, got[2].start_median) == (100.0, 0.0, 0.0)
    assert (got[3].matched, got[3].lines_b, got[3].start_p95) == (0, 0, None) and (got[4].lines_a, got[4].matched_pct) == (0, 0.0)
    assert blocks.drift(a.limit(0), b.limit(0)).count() == 0


def test_whole_query_against_difflib(spark, sf_dir):
    got = {r.model: r for r in transcripts.model_quality(spark, sf_dir).collect()}
    truth = transcripts.verified(spark, sf_dir)
    told = transcripts.heard(truth)
    words = {("truth", r.file_id): r.words for r in transcripts._words(truth).collect()} | {(r.model, r.file_id): r.words for r in transcripts._words(told, "model").collect()}
    files = sorted(f for m, f in words if m == "truth")
    for m in transcripts.MODELS:
        hits = sum(n for f in files for _, _, n in plain(words["truth", f], words.get((m, f), [])))
        assert (got[m].hits, got[m].words, got[m].heard) == (hits, sum(len(words["truth", f]) for f in files), sum(len(words.get((m, f), [])) for f in files))
        assert got[m].recall == round(hits / got[m].words, 3) and got[m].precision == round(hits / got[m].heard, 3)
    assert got["tiny"].recall < got["base"].recall < got["large"].recall


def test_anchor_quality_counts_clips_without_anchors(spark):
    anchors = spark.createDataFrame([("a", 0, float(i), float(i) + d) for i, d in enumerate((0.1, 0.2, 0.3, 2.0))], "file_id string, clip long, s_t double, c_t double")
    lengths = spark.createDataFrame([("a", "m", 61.0), ("b", "m", 20.0)], "file_id string, model string, duration double")
    got = blocks.anchor_quality(anchors, lengths, "model").first()
    offsets = [0.1, 0.2, 0.3, 2.0]
    near = sum(abs(o - statistics.median(offsets)) <= 0.5 for o in offsets)
    assert (got.files, got.anchors_per_10min, got.share_near, got.clips_with_anchors) == (2, round(4 / (81 / 60) * 10, 1), near / 4, 0.25)
