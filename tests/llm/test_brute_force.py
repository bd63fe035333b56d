"""Operators and queries against plain versions of the same rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelattice.llm import decontaminate, langid, lattice, licenses, packing, quality, registry, sharding, simhash, suffix
from cuelattice.llm.components import components


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op1(spark, sf_dir, docs):
    codes = {i: plain_simhash(t) for i, t in docs}
    root = {i: i for i in codes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(codes)
    for a in ids:
        for b in ids:
            if a < b and (codes[a] ^ codes[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op1_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {i: (f"{codes[i]:016x}", find(i)) for i in ids}


@pytest.mark.parametrize("size", [2048, 5])
def test_links_of_crowded_fingerprints(spark, size):
    rng = random.Random(size)
    base = [rng.getrandbits(64) for _ in range(4)]
    codes = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (2**64 - 1) for b in base for _ in range(60)})
    signed = [simhash._signed(c) for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    roots = {r.u: r.root for r in components(simhash.links(df, 4, size)).collect()}
    label = {c: roots.get(c, c) for c in signed}
    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                assert label[a] == label[b]
    groups = Counter(label.values())
    expect = {}
    for c in signed:
        near = [k for k in expect if any(((c ^ m) & (2**64 - 1)).bit_count() <= 4 for m in expect[k])]
        merged = [c] + [m for k in near for m in expect.pop(k)]
        expect[c] = merged
    assert sorted(groups.values()) == sorted(map(len, expect.values()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=40), st.lists(st.lists(st.sampled_from("ab"), min_size=1, max_size=6), max_size=6))
def test_wu_manber_finds_what_a_scan_finds(words, patterns):
    words = [w.encode() for w in words]
    items = [(k, " ".join(p).encode()) for k, p in enumerate(patterns)]
    n, spans, who = decontaminate.scan(b" ".join(words), decontaminate.matchers(items, 3))
    hit, found = set(), set()
    for k, p in enumerate(patterns):
        p = [x.encode() for x in p]
        size = min(3, len(p))
        for i in range(len(p) - size + 1):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == p[i : i + size]:
                    hit |= set(range(j, j + size))
                    found.add(k)
    assert n == len(words) and who == found and {x for a, b in spans for x in range(a, b)} == hit


def test_decontamination_in_blocks_of_items_is_the_same(spark, sf_dir):
    d, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda df: sorted((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r.item_ids) for r in df.collect())
    assert rows(decontaminate.contamination(d, b)) == rows(decontaminate.contamination(d, b, matcher_bytes=2_000))


def test_op4_on_held_out_documents(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    got = registry.op4_language_id(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98


def test_profiles_match_a_plain_out_of_place_distance():
    def plain(text, size):
        words = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
        padded = f" {words} "
        counts = Counter(c for c in padded if c != " ")
        counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
        return [code(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]

    samples = {"a": "the cat sat on the mat with that hat", "b": "der hund und die katze sind nicht da"}
    by = {k: langid.ranked(*langid.grams(v), 30) for k, v in samples.items()}
    assert {k: v.tolist() for k, v in by.items()} == {k: plain(v, 30) for k, v in samples.items()}
    text = "that mat and the hund"
    own = plain(text, 30)
    far = {k: sum(abs(r - plain(v, 30).index(g)) if g in plain(v, 30) else 30 for r, g in enumerate(own)) for k, v in samples.items()}
    best = min(sorted(far), key=far.get)
    assert langid.Profiles(by, 30).predict(text) == (best, pytest.approx(1 - far[best] / (30 * len(own))))


def test_op5(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.tokenizer_file())
    want = {}
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[i, piece] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = registry.op5_best_fit_packing(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    bins = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 4096 and len(bins) <= 1.05 * sum(bins.values()) / 4096 + 1


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abcXYZ éÀßµªº²½ñ'’.,!|<>_-\\\n\t\x85́ÅΣ中0१🙂"), max_size=16))
def test_words_encoded_apart_are_the_text_encoded_whole(text):
    encoder = packing.encoder(registry.tokenizer_file())
    assert encoder.text(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_op6_statistics(spark, sf_dir, docs):
    got = {r.doc_id: r for r in registry.op6_quality_rules(spark, sf_dir).collect()}
    for i, t in docs:
        want = plain_statistics(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (got[i].kept and got[i].base_failed)


def plain_mcd(x):
    """Minimum covariance determinant of whole-number rows in numpy: center, covariance and scale."""
    ridge, p = quality._RIDGE * np.eye(5), 5
    level = lambda m, c: np.floor(100 * np.log1p(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)))
    moments = lambda rows: (rows.mean(0), np.cov(rows.T, bias=True) + ridge)

    def scale(m, c):
        own = np.sort(level(m, c))
        return max(math.expm1(own[math.ceil(len(x) / 2) - 1] / 100) / 4.351, 1.0)

    def step(m, c):
        own = level(m, c)
        return moments(x[own <= np.sort(own)[math.ceil(quality.SHARE * len(x)) - 1]])

    m = np.median(x, 0)
    d = np.maximum(1.4826 * np.median(np.abs(x - m), 0), quality._RIDGE**0.5)
    z = (x - m) / d
    starts = [np.diag(d * d)]
    for t in (np.round(1000 * np.tanh(z)), np.round(1000 * z / np.sqrt(np.maximum((z * z).sum(1), 1e-6))[:, None])):
        product = t.T @ t
        size = np.sqrt(np.maximum(np.diag(product), 1))
        shape = product / np.outer(size, size) * np.outer(d, d)
        np.fill_diagonal(shape, d * d)
        starts.append(shape)
    now = min((step(*step(m, c)) for c in starts), key=lambda e: round(np.linalg.slogdet(e[1])[1], 9))
    while True:
        after = step(*now)
        done, now = abs(np.linalg.slogdet(after[1])[1] - np.linalg.slogdet(now[1])[1]) < 1e-9, after
        if done:
            break
    last = moments(x[np.expm1(level(*now) / 100) <= 12.833 * scale(*now)])
    assert p == len(m)
    return (*last, scale(*last))


def test_op6_estimates_are_those_of_numpy(spark):
    """Two groups with a far cluster each; rows with ties."""
    rng = np.random.default_rng(3)
    x = {g: np.round(np.vstack([rng.normal(0, 300, (400, 5)) @ np.triu(rng.normal(1, 0.3, (5, 5))), rng.normal(at, 50, (40, 5)), np.zeros((30, 5))])).astype(int) for g, at in (("a", 9000), ("b", -4000))}
    rows = spark.createDataFrame([(k, g, *map(int, r)) for g in x for k, r in enumerate(x[g])], "id long, grp string, " + ", ".join(f"x{i} long" for i in range(5)))
    for est in quality.estimates(rows, settled=1e-9).collect():
        mean, cov, scale = plain_mcd(x[est.grp])
        got = np.array([[est[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        assert np.allclose([est[f"m{i}"] for i in range(5)], mean) and np.allclose(got @ got.T, cov) and est.scale == pytest.approx(scale)


def test_op6_kept_is_that_of_numpy(spark, sf_dir):
    """Every document of sf0.01: pooled groups, transformed statistics, estimates and verdict in numpy."""
    big = sf_dir.replace("sf0.001", "sf0.01")
    table = spark.read.parquet(f"{big}/documents.parquet")
    got = {r.doc_id: r for r in quality.quality(table, settled=1e-9).collect()}
    docs = table.collect()
    fit, group = {}, {}
    for r in docs:
        n, chars, symbols, dup, repeat = plain_statistics(r.text)
        lines = max(1, sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (r.text or "").split("\n")))
        if n >= 50 and 100 * repeat <= 50 * n:
            raw = [math.log1p(n), math.log(max(chars, 1) / n) * 4, math.log1p(100 * symbols / n), math.sqrt(dup / lines) * 2, math.sqrt(repeat / n) * 2]
            fit[r.doc_id] = np.array([math.floor(1000 * v + 0.5) for v in raw])
            group[r.doc_id] = (r.lang, r.source)
    sizes = Counter(group.values())
    rest = Counter()
    for (lang, _), n in sizes.items():
        rest[lang] += n if n < quality.MIN_ROWS else 0
    none = sum(n for (lang, _), n in sizes.items() if n < quality.MIN_ROWS and rest[lang] < quality.MIN_ROWS)
    name = {i: g if sizes[g] >= quality.MIN_ROWS else g[0] if rest[g[0]] >= quality.MIN_ROWS else "all" if none >= quality.MIN_ROWS else None for i, g in group.items()}
    limit = quality.chi_squared_limit(quality.TAIL)
    assert limit == pytest.approx(50.692, abs=0.001)
    want = {}
    for g in set(name.values()):
        ids = [i for i in fit if name[i] == g]
        if g is None:
            want |= dict.fromkeys(ids, True)
            continue
        x = np.array([fit[i] for i in ids])
        mean, cov, scale = plain_mcd(x)
        d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean) / scale
        want |= dict(zip(ids, (d2 <= limit).tolist(), strict=True))
    assert {i: r.kept for i, r in got.items()} == {r.doc_id: want.get(r.doc_id, False) for r in docs}
    assert 0.9 < sum(want.values()) / len(want) < 1
    query = {r.doc_id: r.kept for r in registry.op6_quality_rules(spark, big).collect()}
    assert sum(query[i] != r.kept for i, r in got.items()) <= len(got) // 500


def test_suffix_array_is_the_sorted_order():
    rng = np.random.default_rng(0)
    for n in [*range(1, 30), 200, 500]:
        s = rng.integers(1, 3, n)
        assert suffix.suffix_array(s, 10**9).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def plain_repeats(texts, size):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, int)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                covered[i] += 1
                covered[i + size] -= 1
        out.append(np.cumsum(covered)[:-1] > 0)
    return out


def test_op7(spark, sf_dir, docs):
    got = {r.doc_id: r for r in registry.op7_suffix_array_dedup(spark, sf_dir).collect()}
    texts = [(t or "").encode() for _, t in docs]
    for (i, _), text, gone in zip(docs, texts, plain_repeats(texts, 400), strict=True):
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("records", [4096, 2])
def test_suffix_on_small_alphabets(spark, records):
    rng = random.Random(records)
    shared = ["".join(rng.choice("abé") for _ in range(60)) for _ in range(4)]
    texts = ["".join(rng.choice([rng.choice(shared)[rng.randrange(20) :], rng.choice("abc") * rng.randrange(25)]) for _ in range(rng.randrange(6))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix.remove_repeats(df, length=24, gram=16, records=records, symbols=500).collect()}
    raw = [t.encode() for t in texts]
    want = {i: np.frombuffer(t, np.uint8)[~g].tobytes() for i, (t, g) in enumerate(zip(raw, plain_repeats(raw, 24), strict=True))}
    assert got == want


def test_op8(spark, sf_dir, docs):
    got = registry.op8_hypergeometric_sharding(spark, sf_dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs}
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(k, [])) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_communication_matrix_is_exact_and_uniform():
    sent, sizes = np.array([5, 0, 9, 3]), np.array([6, 6, 5])
    total = np.zeros((4, 3))
    for seed in range(400):
        matrix = np.array([sharding.matrix_row(seed, sent, sizes, p) for p in range(4)])
        assert (matrix.sum(1) == sent).all() and (matrix.sum(0) == sizes).all()
        total += matrix
    assert np.allclose(total / 400, np.outer(sent, sizes) / sent.sum(), atol=0.25)


def test_hypergeometric_draws_beyond_a_billion(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(sharding, "_NUMPY_TOTAL", 0)
    for good, bad, taken in ((30, 70, 40), (70, 30, 40), (30, 70, 95), (500, 20, 6), (4, 9000, 5000)):
        drawn = np.array([sharding.draw_good(rng, good, bad, taken) for _ in range(6000)])
        n, share = good + bad, good / (good + bad)
        var = taken * share * (1 - share) * (n - taken) / (n - 1)
        assert drawn.min() >= max(0, taken - bad) and drawn.max() <= min(good, taken)
        assert abs(drawn.mean() - taken * share) < 4 * math.sqrt(var / 6000) + 1e-9 and abs(drawn.var() - var) < 0.12 * var + 0.02
    room = np.full(50, 10**9)
    counts = sharding.draw_counts(rng, room, 20 * 10**9)
    assert counts.sum() == 20 * 10**9 and abs(counts - 4 * 10**8).max() < 10**5


def test_lattice_sums_all_segmentations():
    pieces = lattice.Pieces({"▁a": -1.0, "a": -1.5, "b": -2.0, "ab": -0.7, "▁": -2.5, "bab": -3.0}, [-6.0] * 256, -1.2)

    def brute(text):
        if not text:
            return [(0.0, Counter())]
        out = []
        for k in range(1, len(text) + 1):
            w = pieces.weight.get(text[:k])
            names = [text[:k]]
            if w is None and k == 1:
                w, names = -6.0 * len(text[0].encode()), [text[0].encode()]
            if w is not None:
                out += [(w + v, c + Counter(names)) for v, c in brute(text[k:])]
        return out

    for text in ("▁abab", "▁aé", "▁bbab", "▁"):
        every = brute(text)
        total = math.log(sum(math.exp(v) for v, _ in every))
        assert pieces.log_probability(text) == pytest.approx(total)
        into = {}
        pieces.expected(text, 3, into)
        want = Counter()
        for v, c in every:
            for name, n in c.items():
                want[name] += 3 * n * math.exp(v - total)
        assert into == pytest.approx(dict(want))


def test_op9(spark, sf_dir, docs):
    got = {r.doc_id: r for r in registry.op9_lattice_scoring(spark, sf_dir).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), "end"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, words in tokens.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(words), sum(c[w] > 0 for w in words), n)
        assert got[i].base_score == pytest.approx(base) and got[i].score < 0
    few = lattice.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, registry.tokenizer_file("piece_bpe_32k.model"), broadcast_words=50)
    assert all(r.score == pytest.approx(got[r.doc_id].score) and r.n_known == got[r.doc_id].n_known for r in few.collect())


def test_licenses_are_told_apart(spark):
    texts = {
        "CC-BY-NC-4.0": "prose\nLicensed under  CC BY-NC 4.0.\nmore",
        "CC-BY-4.0": "Licensed under CC BY 4.0.",
        "Apache-2.0": "# Licensed under the Apache License,\n# Version 2.0.",
        "GPL-3.0": "x\nThis work is licensed under the GNU General Public License, version 3.",
        "MIT": "released under the MIT license",
        "": "The driver has a license to drive; no copyright applies.",
    }
    names = list(texts)
    df = spark.createDataFrame([(k, texts[n]) for k, n in enumerate(names)], "doc_id long, text string")
    got = {r.doc_id: {f.license for f in r.findings} for r in licenses.scan(df).collect()}
    assert got == {k: {n} - {""} for k, n in enumerate(names)}


def test_op10_finds_every_planted_line(spark, sf_dir, docs):
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    got = {r.doc_id: r.licenses for r in registry.op10_license_scans(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()}
    for r in spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").collect():
        want = sorted({name for line, name in lines.items() if line in (r.text or "").split("\n")})
        assert set(want) <= set(filter(None, got[r.doc_id].split(",")))


def test_licenses_have_their_own_places_and_none_is_lost(spark):
    """Notices twice in a block, wrapped after a copyright line, far along one line, and reworded or cut ones by the dozen."""
    gpl = next(t for n, t in licenses.NOTICES if n == "GPL-3.0" and "later version" in t)
    wrapped, line = [], ""
    for w in gpl.split():
        line, done = (w, line) if len(line) + len(w) > 60 else (f"{line} {w}".strip(), "")
        wrapped += [done] if done else []
    wrapped.append(line)
    twice = "Licensed under CC BY 4.0.\nSome prose here.\nLicensed under CC BY 4.0."
    texts = [twice, "prose\nCopyright 2020 Foo\n" + "\n".join(wrapped) + "\nint main() {}", "x " * 5000 + gpl + " y" * 5000, "Released under the terms of the MIT License."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.findings for r in licenses.scan(df).collect()}
    assert [texts[0][f.start : f.end] for f in got[0]] == ["Licensed under CC BY 4.0"] * 2
    assert [f.license for f in got[1]] == ["GPL-3.0"] and texts[1][got[1][0].end - 14 : got[1][0].end] == " later version"
    assert [(f.license, f.start) for f in got[2]] == [("GPL-3.0", 10_000)] and [f.license for f in got[3]] == ["MIT"]
    rng = random.Random(6)
    varied = []
    for name, text in licenses.NOTICES:
        for _ in range(6):
            words = text.split()
            if len(words) > 20:  # a word less, a word more, other case and spacing
                words.pop(next(k for k in rng.sample(range(len(words)), len(words)) if not licenses._DECISIVE.search(words[k].lower())))
                words.insert(rng.randrange(1, len(words)), "hereby")
            said = "  ".join(w.upper() if rng.random() < 0.2 else w for w in words)
            varied.append((name, f"Some text before.\n\n# {said}\n\nAnd after it."))
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(varied)], "doc_id long, text string")
    told = {r.doc_id: {f.license for f in r.findings} for r in licenses.scan(df).collect()}
    recall = sum(name in told[k] for k, (name, _) in enumerate(varied)) / len(varied)
    print("license recall", recall, len(varied))
    assert recall >= 0.9
