"""Removal of repeated passages by a distributed difference-cover suffix array.

Every string of ``length`` bytes has a least ``gram`` (by hash, leftmost first) that depends on its own bytes alone, so
equal strings agree in it. Runs of strings with the same least gram are records; a gram that occurs once cannot belong to a
repeated string, and equal records are repeated as they stand. What remains, one record for each distinct content whose
gram has several contents, is dealt to tasks by gram, so that equal strings meet. There the records, with the gram
they share as one symbol, are suffix-sorted: triples at two of three positions are sorted and named, names are sorted
by recursion, the remaining suffixes are merged in, and adjacent prefixes are compared symbol by symbol. The recursion stops when names
span a whole string. A gram with more than ``records`` contents has its strings grouped by offset and hash instead, so
that no group is sorted in one task; strings are then compared by 128-bit hashes.

Defined cases: null and empty texts are kept as empty; texts shorter than ``length`` bytes are kept whole; repeated rows
repeat each other's strings; matches do not cross rows; an empty table gives an empty result; columns besides id and text
are carried only when named.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable, flushed, rows_of, scratch, sorted_groups, to_batch, utf8

LENGTH = 400
#: A shorter gram is shared by more contents, a longer one makes more records.
GRAM = 160
#: Least repeated passage and gram where strings are told in words.
WORDS, WORD_GRAM = 51, 12
#: Distinct contents of one gram that are sorted in one task.
RECORDS = 4096
#: Symbols that are sorted at once, unless one gram has more.
SYMBOLS = 1 << 18
_PIECE = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_FILTER_BITS = 24
_SALTS = 64
_U = np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 17, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[size] = (both[0], both[1])
    return _powers[size]


def least_grams(text: bytes, length: int = LENGTH, gram: int = GRAM, unit: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Place of the least gram of the string at each place, and the hash of the gram at each place; ``unit`` bytes are one place."""
    n = len(text)
    up, down = _power_tables(n)
    prefix = np.zeros(n + 1, _U)
    np.cumsum((np.frombuffer(text, np.uint8).astype(_U) + _U(1)) * up[:n], out=prefix[1:])
    size = gram * unit
    h = (prefix[size::unit] - prefix[:-size:unit]) * down[: n - size + 1 : unit]
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        h ^= h >> _U(shift)
        h *= _U(factor)
    h ^= h >> _U(32)
    low = _U(_PIECE * 4 - 1)
    key = (h & ~low) | np.arange(len(h), dtype=_U)
    width = length - gram + 1
    rows = np.concatenate((key, np.full(-len(key) % width, ~_U(0)))).reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, 1).ravel()
    last = len(key) - width + 1
    return (np.minimum(ahead[:last], behind[width - 1 : width - 1 + last]) & low).astype(np.int64), h


def runs(text: bytes, length: int = LENGTH, gram: int = GRAM, unit: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First string, number of strings, offset of the gram from the first, and the gram's hash, for each run; whole arrays, one for each part of a very long text."""
    size = length * unit
    for at in range(0, max(1, len(text) - size + 1), _PIECE):
        part = text if len(text) <= _PIECE + size else text[at : at + _PIECE + size - unit]
        if len(part) < size:
            return
        least, h = least_grams(part, length, gram, unit)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        grams = least[first]
        yield first + at // unit, np.diff(np.concatenate((first, [len(least)]))), grams - first, h[grams].view(np.int64)
        if part is text:
            return


def suffix_array(s: np.ndarray, depth: int, spans: int = 1) -> np.ndarray:
    """Suffixes of ``s`` (symbols from 1, under 2**21) in the order of their first ``depth`` symbols, by the difference cover {1, 2} mod 3.

    ``spans``: how many symbols of the first text a symbol stands for; naming ends when names span ``depth``.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.concatenate((s.astype(np.int64), np.zeros(3, np.int64)))
    n0 = (n + 2) // 3
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sampled = np.concatenate((one, two))
    triple = (padded[sampled] << 42) | (padded[sampled + 1] << 21) | padded[sampled + 2]
    order = np.argsort(triple, kind="stable")
    ordered = triple[order]
    names = np.empty(len(sampled), np.int64)
    names[order] = np.cumsum(np.concatenate(([1], ordered[1:] != ordered[:-1])))
    if 3 * spans < depth and names.max() < len(names):
        order = suffix_array(names, depth, 3 * spans)
    rank = np.zeros(n + 4, np.int64)
    by_rank = sampled[order]
    rank[by_rank] = np.arange(1, len(by_rank) + 1)
    by_rank = by_rank[by_rank < n]
    zero = np.arange(0, n, 3)
    pair = (padded[zero] << 32) | rank[zero + 1]
    zero = zero[np.argsort(pair, kind="stable")]
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    below_one = np.searchsorted((padded[ones] << 32) | rank[ones + 1], (padded[zero] << 32) | rank[zero + 1])
    three = lambda i: (padded[i] << 42) | (padded[i + 1] << 21) | rank[i + 2]
    below_two = np.searchsorted(three(twos), three(zero))
    assert n0 == len(zero)
    place = np.concatenate((2 * np.arange(len(by_rank)) + 1, 2 * (below_one + below_two)))
    return np.concatenate((by_rank, zero))[np.argsort(place, kind="stable")]


def repeated_windows(s: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Which positions of ``valid`` start ``width`` symbols that another position of ``valid`` starts as well."""
    sa = suffix_array(s, width)
    at = sa[valid[sa]]
    out = np.zeros(len(s), bool)
    if len(at) < 2:
        return out
    views = np.lib.stride_tricks.sliding_window_view(s, width)
    for lo in range(0, len(at) - 1, 8192):
        own = at[lo : lo + 8193]
        rows = views[own]
        same = (rows[1:] == rows[:-1]).all(1)
        out[own[1:][same]] = True
        out[own[:-1][same]] = True
    return out


def _sort_records(batches: Iterator[pa.RecordBatch], length: int, gram: int, symbols: int, unit: int = 1) -> Iterator[tuple[bytes, int, int]]:
    """Records ``(fp, key, first, n, left, right)`` sorted by ``fp`` to repeated spans ``(key, start, end)``."""
    width, kind = length - gram + 1, "<u4" if unit == 4 else np.uint8
    blank = bytes(unit)
    parts: list[bytes] = []
    held: list[tuple[bytes, int, int, int, int, int]] = []
    size, group = 0, 0

    def sort() -> Iterator[tuple[bytes, int, int]]:
        # each record is its left side, the gram as one symbol, its right side, and an end
        text = np.frombuffer(b"".join(parts), kind)
        kinds, s = (256, text.astype(np.int64)) if unit == 1 else (lambda u: (len(u[0]), u[1].astype(np.int64)))(np.unique(text, return_inverse=True))
        _, _, ns, starts, marks, groups = (np.array(c) if k else c for k, c in enumerate(zip(*held, strict=True)))
        ends = np.append(starts[1:], len(s))
        s += 2
        s[marks] = kinds + 2 + groups
        s[ends - 1] = 1
        edges = np.zeros(len(s) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + ns, -1)
        found = repeated_windows(s, np.cumsum(edges[:-1]) > 0, width)
        # a record has places after its last string, so runs of found places do not join those of the next record
        steps = np.flatnonzero(np.diff(np.concatenate(([0], found.astype(np.int8), [0]))))
        for a, b, k in zip(steps[::2].tolist(), steps[1::2].tolist(), (np.searchsorted(starts, steps[::2], "right") - 1).tolist(), strict=True):
            key, first, _, at, _, _ = held[k]
            yield key, first + a - at, first + b - at - 1 + length

    for _, (keys, firsts, counts, lefts, rights) in sorted_groups(batches, 1):
        for key, first, n, left, right in zip(keys, firsts, counts, lefts, rights, strict=True):
            mark = size + len(left) // unit
            held.append((key, first, n, size, mark, group))
            parts += (left, blank, right, blank)
            size = mark + len(right) // unit + 2
        group += 1
        if size >= symbols:
            yield from sort()
            parts, held, size, group = [], [], 0, 0
    if held:
        yield from sort()


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit for each value of the keys' first 24 bits: a fixed size, whatever the number of keys; full, it lets all pass."""
    bit = F.conv(F.substring(F.hex("key"), 1, 6), 16, 10).cast("long")
    word = keys.select((bit / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast({'conv(substring(hex(key), 1, 6), 16, 10)'} as int) % 64)").alias("b"))
    told = word.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros((1 << _FILTER_BITS) // 64, np.int64)
    bits[told["w"].to_numpy()] = told["b"].to_numpy()
    return bits


def _passes(bits: np.ndarray, key: bytes) -> bool:
    at = int.from_bytes(key[:3], "big")
    return bool((int(bits[at >> 6]) >> (at & 63)) & 1)


def _key(text: bytes) -> bytes:
    return hashlib.md5(text, usedforsecurity=False).digest()


def _inner(text: bytes, start: int, end: int) -> list[int]:
    """The part of a span that covers whole characters."""
    while start < end and text[start] & 0xC0 == 0x80:
        start += 1
    while start < end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return [start, end]


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, records: int = RECORDS, symbols: int = SYMBOLS, unit: int = 1, encode: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """``(key, spans array<struct<start,end>>, copies)``: spans of each distinct text (by its MD5) that repeated strings cover, and its rows.

    With ``encode`` a text's strings are those of its encoded form, of which ``unit`` bytes are one symbol (1 or 4); lengths and spans count symbols.
    """
    with scratch() as keep:
        return _spans(keep, docs, text_col, length, gram, records, symbols, unit, encode or (lambda t: t))


def _spans(keep: Callable, docs: DataFrame, text_col: str, length: int, gram: int, records: int, symbols: int, unit: int, encode: Callable[[bytes], bytes]) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    width = length - gram + 1
    texts = docs.select(utf8(text_col).alias("t")).where("t is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("key", pa.binary()), ("first", pa.int32()), ("n", pa.int32()), ("offset", pa.int32()), ("fp", pa.int64()), ("content", pa.int64())])

        keys, contents, columns = [], [], []

        def done() -> pa.RecordBatch:
            first, n, offset, fp = (np.concatenate(c) for c in zip(*columns, strict=True))
            made = to_batch(out, [keys, first.astype(np.int32), n.astype(np.int32), offset.astype(np.int32), fp, np.array(contents, np.uint64).view(np.int64)])
            keys.clear(), contents.clear(), columns.clear()
            return made

        for (text,) in rows_of(batches):
            coded = encode(text)
            key = _key(text)
            for found in runs(coded, length, gram, unit) if len(coded) >= length * unit else ():
                first, n, offset, _ = found
                digest = xxhash.xxh3_64_intdigest
                contents += [digest(coded[a:b], k) for a, b, k in zip((first * unit).tolist(), ((first + n - 1 + length) * unit).tolist(), offset.tolist(), strict=True)]
                keys += [key] * len(first)
                columns.append(found)
                if len(keys) >= 20_000:
                    yield done()
        if keys:
            yield done()

    found = durable(texts.mapInArrow(cut, "key binary, first int, n int, offset int, fp long, content long"))
    by_content = found.groupBy("fp", "content").agg(F.count("*").alias("copies"), F.min(F.struct("key", "first", "n", "offset")).alias("one"))
    by_gram = by_content.groupBy("fp").agg(F.sum("copies").alias("total"), F.count("*").alias("contents")).where("total > 1").select("fp", "contents")
    shared = durable(by_content.join(by_gram, "fp").where("copies > 1 or contents > 1"))
    equal = found.join(shared.where("copies > 1").select("fp", "content"), ["fp", "content"], "left_semi")
    spans = equal.select("key", F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + length).alias("end")).distinct()

    mixed = shared.where("contents > 1").select("fp", "contents", "one.*")
    wanted = durable(mixed.groupBy("key").agg(F.collect_list(F.struct("fp", "contents", "first", "n", "offset")).alias("records")))
    bits = spark.sparkContext.broadcast(_filter(wanted))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            seen: set[bytes] = set()
            for (text,) in rows_of(batches):
                key = _key(text)
                if key not in seen and _passes(bits.value, key):
                    seen.add(key)
                    yield key, encode(text)

        return flushed(pa.schema([("key", pa.binary()), ("t", pa.binary())]), each(), 200)

    # one copy of a text a task, then one of all, before texts meet their records
    single = texts.mapInArrow(named, "key binary, t binary").groupBy("key").agg(F.first("t").alias("t"))
    held = single.join(wanted, "key").select("key", "t", F.inline("records"))
    gram_end = F.col("first") + F.col("offset") + gram
    both = held.select("fp", "contents", "key", "first", "n", "offset", F.expr(f"substring(t, first * {unit} + 1, offset * {unit})").alias("left"), F.substring(F.col("t"), gram_end * unit + 1, (F.col("n") - 1 + length - F.col("offset") - gram) * unit).alias("right"))
    sides = durable(both)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return flushed(pa.schema([("key", pa.binary()), ("start", pa.int32()), ("end", pa.int32())]), _sort_records(batches, length, gram, symbols, unit))

    few = sides.where(F.col("contents") <= records).select("fp", "key", "first", "n", "left", "right")
    spans = spans.unionByName(few.repartition("fp").sortWithinPartitions("fp").mapInArrow(search, "key binary, start int, end int"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("fp", pa.int64()), ("offset", pa.int32()), ("h", pa.binary()), ("key", pa.binary()), ("start", pa.int32())])

        def each() -> Iterator[tuple]:
            for fp, key, first, n, offset, left, right in rows_of(batches):
                for i in range(n):
                    own = offset - i
                    yield fp, own, xxhash.xxh3_128_digest(left[i * unit :] + right[: (width - 1 - own) * unit]), key, first + i

        return flushed(out, each())

    many = sides.where(F.col("contents") > records).select("fp", "key", "first", "n", "offset", "left", "right").repartition("key", "first")
    single = durable(many.mapInArrow(windows, "fp long, offset int, h binary, key binary, start int"))
    again = single.groupBy("fp", "offset", "h").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    hot = single.join(again, ["fp", "offset", "h"], "left_semi").select("key", "start", (F.col("start") + length).alias("end"))
    covered = spans.unionByName(hot).distinct().groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    # every row that is long enough has one run that starts at zero
    rows = found.where("first = 0").groupBy("key").agg(F.count("*").alias("copies"))
    return keep(covered.join(rows, "key"))


def _joined(spans: list[dict] | None) -> list[list[int]]:
    """Sorted spans with those that touch made one."""
    joined: list[list[int]] = []
    for s in spans or ():
        if joined and s["start"] <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], s["end"])
        else:
            joined.append([s["start"], s["end"]])
    return joined


def _applied(docs: DataFrame, id_col: str, text_col: str, carry: list[str], covered: DataFrame, act: Callable[..., tuple], fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """``(id_col, carry..., fields...)``: what ``act`` makes of each row's text and its text's columns in ``covered(key, copies, ...)``.

    Rows whose text is not covered stay where they are. Texts of more than a 10,000th of all covered rows, at most 10,000, are named to
    all tasks, and their rows are spread over salts.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_filter(covered))
    total = covered.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    often = frozenset(bytes(r.key) for r in covered.where(F.col("copies") > max(_SALTS, total // 10_000)).select("key").collect())
    hot = spark.sparkContext.broadcast(often)
    marks = [c for c in covered.columns if c not in ("key", "copies")]
    base = docs.select(F.coalesce(utf8(text_col), F.lit(b"")).alias("__text"), F.col(id_col), *[F.col(c) for c in carry])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema[1:])

    def chosen(batch: pa.RecordBatch, hit: bool) -> tuple[pa.RecordBatch, list[bytes]]:
        keys = [_key(t) for t in batch.column(0).to_pylist()]
        passed = [_passes(bits.value, k) is hit for k in keys]
        return batch.filter(pa.array(passed, pa.bool_())), [k for k, p in zip(keys, passed, strict=True) if p]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, keys = chosen(batch, True)
            if own.num_rows:
                salts = [zlib.crc32(repr(i).encode()) % _SALTS if k in hot.value else 0 for k, i in zip(keys, own.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(keys, pa.binary()), pa.array(salts, pa.int32())], names=[*own.schema.names, "__key", "__salt"])

    def result_of(texts: list[bytes], given: Iterable[tuple], rest: pa.RecordBatch) -> pa.RecordBatch:
        made = list(zip(*(act(t, *g) for t, g in zip(texts, given, strict=True)), strict=True))
        columns = [*rest.columns, *(pa.array(m, kind) for m, (_, _, kind) in zip(made, fields, strict=True))]
        return pa.RecordBatch.from_arrays(columns, names=[*rest.schema.names, *(name for name, _, _ in fields)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 1 + len(marks)
        for batch in batches:
            given = zip(*(c.to_pylist() for c in batch.columns[1:n]), strict=True)
            if batch.num_rows:
                yield result_of(batch.column(0).to_pylist(), given, batch.select(batch.schema.names[n:]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, _ = chosen(batch, False)
            if own.num_rows:
                yield result_of(own.column(0).to_pylist(), [(None,) * len(marks)] * own.num_rows, own.select(own.schema.names[1:]))

    names = [F.col(f"`{f.name}`") for f in base.schema[1:]]
    result = f"{kept}, " + ", ".join(f"`{name}` {kind}" for name, kind, _ in fields)
    salts = F.when(F.col("copies") > max(_SALTS, total // 10_000), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    found = covered.select(F.col("key").alias("__key"), *[F.col(m).alias(f"__{m}") for m in marks], F.explode(salts).alias("__salt"))
    touched = base.mapInArrow(named, f"__text binary, {kept}, __key binary, __salt int").join(found, ["__key", "__salt"], "left").select("__text", *[f"__{m}" for m in marks], *names)
    return touched.mapInArrow(cut, result).unionByName(base.mapInArrow(whole, result))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, length: int = LENGTH, gram: int = GRAM, records: int = RECORDS, symbols: int = SYMBOLS, whole_characters: bool = False, words: int | None = None) -> DataFrame:
    """``(id_col, carry..., n_bytes, spans array<struct<start,end>>, kept binary)``: each row's removed byte spans and what is left.

    With ``whole_characters`` a character that a span covers in part is kept, so that what is left is UTF-8. With ``words`` a column
    ``n_repeat_words`` follows: words inside runs of so many or more words that occur again, whatever their bytes; nothing of these is removed.
    """
    own = ("n_bytes", "spans", "kept", "n_repeat_words")
    carry = [c for c in carry or [] if c not in (id_col, *own)]
    covered = repeated_spans(docs, text_col, length, gram, records, symbols)
    span_list = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    fields = [("n_bytes", "long", pa.int64()), ("spans", "array<struct<start:int,end:int>>", span_list), ("kept", "binary", pa.binary())]
    if words:
        by_word = repeated_word_spans(docs, text_col, words).select("key", F.col("spans").alias("word_spans"), F.col("copies").alias("_copies"))
        covered = durable(covered.join(by_word, "key", "full").select("key", "spans", "word_spans", F.coalesce("copies", "_copies").alias("copies")))
        fields.append(("n_repeat_words", "long", pa.int64()))

    def act(text: bytes, spans: list[dict] | None, of_words: list[dict] | None = None) -> tuple:
        joined = _joined(spans)
        if whole_characters:
            joined = [s for s in (_inner(text, *s) for s in joined) if s[0] < s[1]]
        kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in joined)], [*(a for a, _ in joined), len(text)], strict=True)) if joined else text
        out = len(text), [{"start": a, "end": b} for a, b in joined], kept
        return (*out, sum(b - a for a, b in _joined(of_words))) if words else out

    return _applied(docs, id_col, text_col, carry, covered, act, fields)


def word_symbols(text: bytes | None) -> bytes:
    """Four bytes of hash for each word of a text, so that equal runs of words are equal strings whatever their length in bytes."""
    return np.fromiter(map(xxhash.xxh32_intdigest, (text or b"").split()), "<u4").tobytes()


def without_words(text: bytes, spans: list[dict] | None) -> tuple[bytes, bool]:
    """The text less the words under spans of its words, and whether any went."""
    gone = _joined(spans)
    if not gone:
        return text, False
    places = [m.span() for m in re.finditer(rb"\S+", text)]
    kept, at = [], 0
    for first, last in gone:
        kept.append(text[at : places[first][0]])
        at = places[last - 1][1]
    return b"".join([*kept, text[at:]]), True


def repeated_word_spans(docs: DataFrame, text_col: str = "text", words: int = WORDS, gram: int = WORD_GRAM) -> DataFrame:
    """:func:`repeated_spans` with words as symbols: runs of ``words`` or more words that occur again."""
    return repeated_spans(docs, text_col, words, gram, unit=4, encode=word_symbols)


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, words: int = WORDS, gram: int = WORD_GRAM) -> DataFrame:
    """``(id_col, carry..., touched boolean, kept binary)``: every run of ``words`` or more words that occurs again is cut from all places.

    Words are what white space (ASCII) parts; white space between them does not count. The sort is that of :func:`remove_repeats` with
    words as symbols.
    """
    carry = [c for c in carry or [] if c not in (id_col, "touched", "kept")]

    def act(text: bytes, spans: list[dict] | None) -> tuple:
        kept, touched = without_words(text, spans)
        return touched, kept

    return _applied(docs, id_col, text_col, carry, repeated_word_spans(docs, text_col, words, gram), act, [("touched", "boolean", pa.bool_()), ("kept", "binary", pa.binary())])
