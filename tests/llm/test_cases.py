"""What each operator does with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cuelattice.llm import chat, decontaminate, langid, lattice, licenses, packing, quality, sharding, simhash, suffix
from cuelattice.llm.registry import tokenizer_file

LONG = "word " * 40_000
KIND = "doc_id long, text string, lang string, source string, n_chars long, fp long, id long, t string, key string, bin long, spans string, item_ids string, score double, shard int, n string, word string, _t string"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, "The same text twice."), (2, "The same text twice."), (3, None), (4, ""), (5, LONG), (6, " \n\t "), (None, "no id here"), (7, "tie"), (7, "tie"), (8, "x"), (9, "🙂 é ퟿")]
    extra = (5, 6, "t", "k", 7, "s", "i", 0.5, 3, "n", "w", "u")
    rows = [(i, t, None if i in (3, 7) else "en", None if i == 4 else "src", None if i == 5 else 1, *extra) for i, t in texts]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def test_simhash(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 11 and simhash.near_duplicates(none).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and by[3].fingerprint == "0" * 16 and {by[3].component_id, by[4].component_id, by[6].component_id} == {3}


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "the same text"), (1, "twice"), (None, "tie"), (2, None), (3, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(odd, items).collect()}
    assert got[1].item_ids == [1] and [tuple(s) for s in got[1].spans] == [(0, 4)] and got[7].item_ids == [] and got[3].n_words == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert all(not r.item_ids for r in decontaminate.contamination(odd, items.limit(0)).collect())


def test_language(odd, none):
    model = langid.train(odd, F.lit(True))
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[6].lang_pred == "und" and got[1].lang_pred == "en" and 0 <= got[1].score <= 1
    assert langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.train(none, F.lit(True))).collect()} == {"und"}


def test_copies_teach_a_language_once(spark):
    rows = [("en", "the cat and the dog")] * 3 + [("de", "der hund und die katze")]
    once = spark.createDataFrame(rows, "lang string, text string")
    hot = once.unionByName(spark.createDataFrame([("en", "qqq zzz")], "lang string, text string"))
    many = hot.unionByName(spark.range(3_000).select(F.lit("en").alias("lang"), F.lit("qqq zzz").alias("text")))
    few, lot = (langid.train(t, F.lit(True), train_rows=50) for t in (hot, many))
    assert few.langs == lot.langs == ["de", "en"] and few.codes.tolist() == lot.codes.tolist() and few.ranks.tolist() == lot.ranks.tolist()


def test_equal_distances_go_to_the_smallest_name(spark):
    rows = [(lang, "one text in both") for lang in ("xb", "xa")]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"), F.lit(True))
    assert model.predict("one text in both") == ("xa", 1.0)


def test_packing(odd, none):
    got = packing.pack(odd, tokenizer_file(), size=64, open_bins=3, merge_rows=2).collect()
    assert sum(r.length for r in got if r.doc_id == 3) == 1 and sum(1 for r in got if r.doc_id == 7) == 2
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(none, tokenizer_file()).count() == 0


def test_quality(odd, none):
    got = {r.doc_id: r for r in quality.quality(odd).collect()}
    assert got[3].n_words == 0 and got[3].base_failed and not got[3].kept and got[5].n_words == 40_000 and got[5].n_repeat_words == 40_000
    assert quality.quality(none).count() == 0


def test_suffix(odd, none):
    got = {r.doc_id: r for r in suffix.remove_repeats(odd, carry=["lang"]).collect()}
    assert len(got[5].kept) == 0 and bytes(got[1].kept) == b"The same text twice." and bytes(got[3].kept) == b""
    assert suffix.remove_repeats(none).count() == 0


def test_sharding(odd, none):
    got = sharding.shuffle_into_shards(odd, shards=4, bucket_rows=2)
    slots = {}
    for r in got.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, slots.values())) == [2, 3, 3, 3] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shuffle_into_shards(none).count() == 0


def test_lattice(odd, none):
    path = tokenizer_file("piece_bpe_32k.model")
    got = {r.doc_id: r for r in lattice.score(odd, F.col("doc_id") != 5, path, broadcast_words=2).collect()}
    assert got[3].n_tokens == 1 and got[5].n_tokens == 40_001 and got[1].score < 0 and got[3].score == got[4].score
    assert lattice.score(none, F.lit(True), path).count() == 0


def test_licenses(odd, none):
    assert all(r.n_blocks == 0 and r.findings == [] for r in licenses.scan(odd).collect()) and licenses.scan(none).count() == 0


def test_chat(spark):
    kind = "id long, record string, layout string, turns string"
    rows = [(1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}'), (2, "not json"), (3, None), (4, '{"strange":1}'), (None, '{"prompt":"p","completion":"c"}'), (5, '{"conversations":[{"from":"human","value":"<|im_end|>\\\\n"},{"from":"gpt","value":"\\\\\\\\|"}]}'), (6, '{"instruction":"i","input":"","output":"o"}'), (7, '{"turn":2,"role":"assistant","text":"later"}'), (7, '{"turn":1,"role":"us\\ner","text":"first"}')]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], kind)
    out = chat.format_chat(df, "id", "record").withColumn("back", chat.read_back(F.col("formatted")))
    got = {r.id: r for r in out.collect()}
    turns = lambda k: [tuple(t) for t in got[k].back]
    assert turns(1) == [("user", "a"), ("assistant", "")] and got[2].layout is None and got[2].formatted == "" and got[3].formatted == "" and got[4].layout is None
    assert turns(None) == [("user", "p"), ("assistant", "c")] and turns(5) == [("user", "<|im_end|>\\n"), ("assistant", "\\\\|")] and turns(6) == [("user", "i"), ("assistant", "o")]
    assert turns(7) == [("us\ner", "first"), ("assistant", "later")]
    assert chat.format_chat(df.limit(0), "id", "record").count() == 0


def test_chat_layouts_of_one_fingerprint_are_refused(spark):
    twice = (*chat.LAYOUTS, replace(chat.LAYOUTS[0], name="again"))
    with pytest.raises(ValueError, match="again"):
        chat.layout_table(spark, twice)
    assert chat.layout_table(spark).count() == len(chat.LAYOUTS)


def test_chat_records_with_further_fields(spark):
    given = [(1, '{"id":7,"messages":[{"role":"user","content":"a","name":"n"},{"role":"assistant","content":"b"}]}'), (2, '{"prompt":"p","completion":"c","metadata":{"k":[1]}}'), (3, '{"prompt":"p","completion":"c","question":"q"}'), (4, '{"messages":[],"id":1}'), (5, '{"turn":1,"role":"user","text":"t","lang":"en"}'), (6, '{"messages":5,"role":null}')]
    out = chat.format_chat(spark.createDataFrame(given, "id long, record string"), "id", "record").withColumn("back", chat.read_back(F.col("formatted")))
    got = {r.id: (r.layout, [tuple(t) for t in r.back]) for r in out.collect()}
    assert got == {1: ("messages", [("user", "a"), ("assistant", "b")]), 2: ("prompt_completion", [("user", "p"), ("assistant", "c")]), 3: (None, []), 4: (None, []), 5: ("turn_rows", [("user", "t")]), 6: (None, [])}
