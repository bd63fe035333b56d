"""The divergence audit and the archive: SQL twins, plain versions, odd rows, crowded groups."""

import base64
import glob
import hashlib
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cuelattice.llm import divergence, registry, warc
from cuelattice.llm.common import new_path


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_source_divergence", "op13_content_addressed_archive"])
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ours, theirs = registry.queries()[name](spark, sf_dir), con.sql(registry.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    right = [tuple(r[theirs.columns.index(c)] for c in columns) for r in theirs.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in ours.collect()), key=repr) == sorted(right, key=repr)


def test_trie_keeps_counts_and_order():
    rng, trie, want = random.Random(1), divergence.Trie(), Counter()
    for _ in range(5000):
        term = "".join(rng.choices("abé猫🙂", k=rng.randrange(1, 7))).encode()
        trie.leaf(term)[0] += 1
        want[term] += 1
    assert [(t, leaf[0]) for t, leaf in trie] == sorted(want.items()) and trie.leaves == len(want)


def test_shares_are_exact():
    import numpy as np

    counts = np.array([0, 1, 7, 10**15], np.int64)
    assert divergence.shares(counts, 10**15 + 9).tolist() == [1 + 10**9 * (c + 2) // (10**15 + 9) for c in counts.tolist()]


def plain_audit(rows, least, best):
    groups, seen, langs = {}, Counter(), {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = (text or "").encode().translate(divergence.TABLE).decode().split(" ")
        groups.setdefault((lang, source), Counter()).update(t for t in terms if t)
        seen.update((lang, t) for t in set(terms) if t)
        langs.setdefault(lang, set()).add(source)
    out = []
    for lang, sources in langs.items():
        kept = sorted(t for (k, t), n in seen.items() if k == lang and n >= least)
        count = {s: Counter({t: groups[lang, s][t] for t in kept}) for s in sources}
        whole = sum(count.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(sum(gap(share(count[s], t), share(count[o], t)) for t in kept), o) for o in sources if o != s]
            terms = [(gap(share(count[s], t), share(whole, t)), t) for t in kept if count[s][t] and share(count[s], t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(ranked, 1) if part == "pair" or k <= best]
    return sorted(out)


@pytest.mark.parametrize(("leaves", "pairs", "groups"), [(150_000, 4_000_000, 1_000_000), (3, 1, 2)])
def test_audit_against_plain(spark, monkeypatch, leaves, pairs, groups):
    rng = random.Random(3)
    words = ["ab", "Ab", "abc", "b", "é", "É", "猫", "x1y", "zz"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 9))), rng.choice(["en", "de", None, "fr"]), rng.choice(["s", "s", "s", None, "t", "u"])) for _ in range(300)]
    rows += [(None, "it", "s"), ("", "it", "t"), ("12 34", "it", "u"), ("letters " * 50_000, "en", "long")]
    docs = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "text string, lang string, source string, value long, item string, rank int").repartition(3)
    monkeypatch.setattr(divergence, "KEPT_PAIRS", pairs)
    taken = divergence.leaves_of
    monkeypatch.setattr(divergence, "leaves_of", lambda *a: taken(*a, pending=leaves, leaves=leaves))
    got = sorted(tuple(r) for r in divergence.audit(docs, least_docs=4, best=3, groups_at_once=groups).collect())
    assert got == plain_audit(rows, 4, 3)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


PAGES = "page_id long, url string, html string, address string, copies long, header string, payload string, _n long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 3, "y", "z", 4) for r in rows], PAGES)


ODD = [(1, "http://a", "x"), (2, None, "x"), (3, "http://c\r\nWARC-Type: no", None), (4, "u", ""), (None, "u", "x"), (5, "é", "a\r\n\r\nWARC/1.1\r\nb é"), (5, "é", "a\r\n\r\nWARC/1.1\r\nb é"), (6, "z", "\r\n\r\n"), (None, None, "only"), (-7, "u", "long " * 100_000)]


def told(spark, rows, **how):
    path = new_path(spark)
    warc.store(pages(spark, rows), path, **how)
    return path


@pytest.mark.parametrize("meeting", [1, 2, 1000])
def test_round_trip(spark, meeting):
    restored = warc.restore(spark, told(spark, ODD), meeting).cache()
    whole = sorted(bytes(r.payload) for r in restored.collect())
    assert whole == sorted((h or "").encode() for _, _, h in ODD)
    files = new_path(spark)
    warc.export_warc(restored, files, records_per_file=2)
    back = sorted((bytes(r.header), bytes(r.http), bytes(r.payload)) for r in warc.read_warc(spark, files).collect())
    want = sorted((bytes(r.header), bytes(r.http), bytes(r.payload) if b"WARC-Type: response" in bytes(r.header) else b"") for r in restored.collect())
    assert back == want
    for r in restored.collect():
        assert base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()) in bytes(r.header)


def types(spark, rows, **how):
    restored = warc.restore(spark, told(spark, rows, **how))
    head = [bytes(r.header).decode().split("\r\n") for r in restored.collect()]
    return Counter((h[2].split(":")[3], h[1].split(" ")[1]) for h in head)


def test_smallest_id_is_kept(spark):
    assert types(spark, ODD[:5]) == Counter({("1", "response"): 1, ("2", "revisit"): 1, ("", "revisit"): 1, ("3", "response"): 1, ("4", "revisit"): 1})
    assert set(k for _, k in types(spark, ODD[:5], least=2)) == {"response"}
    assert types(spark, []) == Counter()


def test_payload_that_is_not_its_address(spark):
    path, broken = told(spark, ODD), new_path(spark)
    spark.read.parquet(f"{path}/payloads").withColumn("body", F.concat("body", F.lit(b"!"))).write.parquet(f"{broken}/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{broken}/records")
    with pytest.raises(PySparkException, match="differs from its address"):
        warc.restore(spark, broken).collect()


def test_common_payload_is_stored_once(spark):
    rows = spark.range(30_000).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.when(F.col("id") % 3 == 0, "same page").otherwise(F.concat(F.lit("page "), "id")).alias("html"))
    path = new_path(spark)
    warc.store(rows, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 20_001
    back = warc.restore(spark, path, 100)
    assert back.count() == 30_000 and back.where(F.col("payload") == F.lit(b"same page")).count() == 10_000
