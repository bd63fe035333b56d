import itertools
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from cuelattice.llm import registry, sharding, shingles, simhash, suffix


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, sf_dir).collect(), before.schema)
        assert after.columns == docs.columns and 0 < after.count() <= before.count(), name
        before = after
    assert before.where("text = '' or text is null").count() == 0
    groups = registry.simhash.near_duplicates(before)
    assert before.count() == before.select("doc_id").distinct().count() and groups.count() == before.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert pieces.select("doc_id").distinct().count() == before.count()


def test_repeated_and_missing_ids(spark, sf_dir):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one two three four five six", "en", "s", 5), (1, "one two three four five six", "en", "s", 5), (None, "quite another text is here", "en", "s", 5), (None, "one two three four five six", None, None, None)]
    left = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, kind), sf_dir).collect()
    assert sorted((r.doc_id is None, r.text) for r in left) == [(False, rows[0][1]), (True, rows[2][1])]


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_keep_clashing_columns_as_they_are(spark, sf_dir):
    own = {"score": F.lit("mine"), "lang_pred": F.lit(7), "spans": F.lit(1.5), "item_ids": F.lit("i"), "n_words": F.lit("n"), "touched": F.lit("t"), "kept": F.lit(3), "_row": F.lit("r"), "__text": F.lit("x"), "_text_read": F.lit("y"), "_bucket": F.lit("b"), "whole": F.lit("w"), "a.b": F.lit(9)}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").drop("n_chars").limit(40)
    docs = docs.unionByName(docs.limit(3)).select("*", *[v.alias(c) for c, v in own.items()])
    values = tuple(docs.select(*[f"`{c}`" for c in own]).first())
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, sf_dir).collect(), docs.schema)
        assert now.columns == docs.columns and {tuple(r) for r in now.select(*[f"`{c}`" for c in own]).collect()} == {values}, name
    assert now.count() > 0
    shuffled = sharding.shuffle_into_shards(docs, 4)
    assert shuffled.columns == [*docs.columns, "shard", "slot"] and {tuple(r) for r in shuffled.select(*[f"`{c}`" for c in own]).collect()} == {values}


def test_sequences_can_be_built_from_the_result(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    pieces = corpus_pipeline.packing_stage(spark, docs, sf_dir).collect()
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        told = sequences.setdefault(p.sequence_id, [])
        assert p.offset == len(told) and len(p.ids) == 4 * p.length
        told += np.frombuffer(p.ids, "<u4").tolist()
    assert all(len(s) <= 4096 for s in sequences.values()) and sum(map(len, sequences.values())) == sum(p.length for p in pieces)


def _components(texts):
    """Smallest index each text is linked to, by comparing all pairs of five-word shingle sets."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    low = list(range(len(texts)))
    for a, b in itertools.combinations(low[:], 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and low[a] != low[b]:
            keep, gone = sorted((low[a], low[b]))
            low = [keep if x == gone else x for x in low]
    return low


def test_near_duplicates_are_those_of_brute_force(spark, sf_dir):
    """Chains, edits on both sides of the threshold, and a group larger than a piece."""
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = ["", " ", "one two", "One  two", "one two three"]
    for _ in range(40):
        words = r.choices(vocabulary, k=r.randint(20, 200))
        for _ in range(r.randint(1, 6)):
            texts.append(" ".join(words))
            words = [r.choice(vocabulary) if r.random() < 0.02 else w for w in words]
    base = r.choices(vocabulary, k=120)
    for _ in range(60):
        at = r.randrange(120)
        texts.append(" ".join(w if i not in (at, (at + 40) % 120) else r.choice(vocabulary) for i, w in enumerate(base)))
    want = _components(texts)
    assert len(set(want)) < len(texts) - 80
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for listed, size in ((8, 2048), (4, 16)):
        found = {x.doc_id: x.component_id for x in simhash.near_duplicate_texts(docs, listed=listed, tree_size=size).collect()}
        assert [found[i] for i in range(len(texts))] == want
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()
    assert sorted(x.doc_id for x in kept) == sorted(set(want))


def test_fingerprints_of_similar_sets_are_within_the_radius():
    """Pairs of similarity 0.8 and little more, of few and of many shingles: at most one in a thousand is farther apart than the radius."""
    rng = np.random.default_rng(11)
    far = pairs = 0
    for shared in [4, 8, 12, 20, 40, 80, 200]:
        for _ in range(400):
            own = max(0, shared // 8)
            drawn = rng.integers(0, 1 << 63, shared + 2 * own + (own == 0), dtype=np.uint64) * np.uint64(2)
            a, b = np.concatenate((drawn[:shared], drawn[shared : shared + max(1, own)])), np.concatenate((drawn[:shared], drawn[shared + max(1, own) :]))
            assert shingles.similarity(np.sort(a), np.sort(b)) >= 0.8
            pairs += 1
            far += (shingles.set_fingerprint(a) ^ shingles.set_fingerprint(b)).bit_count() > simhash.TEXT_RADIUS
    assert far <= pairs / 1000


def test_one_text_repeated_very_often(spark, sf_dir):
    """A hot text of 100,000 rows, among others, in near-duplicates, repeated passages and fingerprints."""
    n = 100_000
    hot = " ".join(f"hot{i}" for i in range(60))
    many = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 != 7, F.lit(hot)).otherwise(F.concat(F.lit("cold "), F.col("id").cast("string"))).alias("text"))
    groups = simhash.near_duplicates(many).groupBy("component_id").count().orderBy(F.desc("count")).first()
    assert groups["count"] == n - n // 1000 and groups.component_id == 0
    texts = simhash.near_duplicate_texts(many).groupBy("component_id").count().orderBy(F.desc("count")).first()
    assert texts["count"] == n - n // 1000 and texts.component_id == 0
    cut = suffix.remove_repeats(many, length=40, gram=12, words=51).agg(F.sum((F.size("spans") == 1).cast("long")).alias("cut"), F.count("*").alias("n"), F.sum("n_repeat_words").alias("words")).first()
    assert cut.n == n and cut.cut == n - n // 1000 and cut.words == 60 * (n - n // 1000)


def test_repeated_passages_of_more_than_fifty_words_go(spark, sf_dir):
    """Planted runs of 45 to 60 short words, at starts, ends and between; 51 are cut from both places, 50 stay."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyzåé", k=r.randint(1, 6)))
    rows, want = [], []
    for n in [45, 49, *[50] * 12, *range(51, 61)]:
        passage = [word() for _ in range(n)]
        for k in range(2):
            before, after = [f"x{len(rows)}"] + [word() for _ in range(20 * k)], [f"y{len(rows)}"] + [word() for _ in range(9)]
            rows.append(" ".join(before + passage + after))
            want.append(before + after if n > 50 else before + passage + after)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {x.doc_id: x for x in corpus_pipeline.repeated_passage_stage(spark, docs, sf_dir).collect()}
    assert [left[i].text.split() for i in range(len(rows))] == want
    assert all(x.n_chars == len(x.text) for x in left.values())
