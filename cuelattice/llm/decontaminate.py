"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are all windows of ``window`` consecutive item words (an item of fewer words is one window). For each pattern
length a matcher has a table of shifts, addressed by the hash of a block of two words, which tells how far the search may skip;
buckets of test strings by the hash of their last block, with a hash of their first word; and a direct comparison that confirms
each occurrence. Patterns are places in the items' text, so a matcher takes a few times the bytes of its items.

Defined cases: null and empty texts have no words and no hits; repeated item ids count once; item rows without words or
without an id are ignored; repeated document rows each keep a row; empty tables give empty results; columns besides id and text
are ignored.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable, utf8

#: Bytes of one broadcast matcher, at most about; more items are searched in as many passes as that needs, one after the other.
MATCHER_BYTES = 64 << 20
#: Bytes of a matcher for each byte of item text, at most about.
_PER_BYTE = 8
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and all that is not ASCII, after A-Z were lower-cased."""
    return (text or b"").translate(_WORDS).split()


class WuManber:
    """A matcher for word sequences of one length: all windows of ``items``, which have at least so many words each."""

    def __init__(self, length: int, items: list[tuple[int, list[bytes]]]) -> None:
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        words = [w for _, own in items for w in own]
        sizes = np.array([len(own) for _, own in items])
        first = np.cumsum(sizes) - sizes
        self.text = b" ".join(words)
        at = np.cumsum([0, *(len(w) + 1 for w in words)])
        self.at = array("I", at.astype(np.uint32).tobytes())
        crc, digest = zlib.crc32, xxhash.xxh3_64_intdigest
        codes = np.fromiter(map(crc, words) if self.block == 1 else (crc(a + b" " + b) for a, b in zip(itertools.chain([b""], words), words, strict=False)), np.uint32, len(words))
        place = np.arange(len(words), dtype=np.int32) - np.repeat(first, sizes).astype(np.int32)
        self.mask = (1 << max(8, int(8 * len(words)).bit_length())) - 1
        table = np.full(self.mask + 1, min(self.default, 255), np.uint8)
        inner = place >= self.block - 1
        np.minimum.at(table, codes[inner] & np.uint32(self.mask), np.clip(length - 1 - place[inner], 0, 255).astype(np.uint8))
        self.shift = table.tobytes()
        # one entry for each window, with all its items
        ends = np.flatnonzero(place >= length - 1).astype(np.uint32)
        starts = ends - np.uint32(length - 1)
        hashes = np.fromiter((digest(self.text[a:b]) for a, b in zip(at[starts].tolist(), (at[ends + 1] - 1).tolist(), strict=True)), np.uint64, len(ends))
        order = np.lexsort((hashes, codes[ends]))
        starts, ends, hashes = starts[order], ends[order], hashes[order]
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (codes[ends[1:]] != codes[ends[:-1]])))
        for k in np.flatnonzero(~new).tolist():  # equal by hash: by bytes as well
            own, before = (self.text[at[starts[i]] : at[ends[i] + 1] - 1] for i in (k, k - 1))
            new[k] = own != before
        one = np.flatnonzero(new)
        self.codes, self.starts = array("I", codes[ends[one]].tobytes()), array("I", starts[one].tobytes())
        self.heads = array("H", np.fromiter((crc(words[k]) & 0xFFFF for k in starts[one].tolist()), np.uint16, len(one)).tobytes())
        self.bounds = array("I", np.append(one, len(ends)).astype(np.uint32).tobytes())
        ids = np.array([i for i, _ in items], np.int64)
        self.items = array("q", ids[np.searchsorted(first, starts, "right") - 1].tobytes())

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """Start and items of each occurrence, in order."""
        at, n, back, one = self.length - 1, len(words), self.length - 1, self.block == 1
        shift, mask, crc = self.shift, self.mask, zlib.crc32
        while at < n:
            code = crc(words[at] if one else words[at - 1] + b" " + words[at])
            if skip := shift[code & mask]:
                at += skip
                continue
            if found := self._tests(code, words[at - back : at + 1]):
                yield at - back, found
            at += 1

    def _tests(self, code: int, words: list[bytes]) -> set[int]:
        low = bisect_left(self.codes, code)
        high = bisect_right(self.codes, code, low)
        if low == high:
            return set()
        head, line, found = zlib.crc32(words[0]) & 0xFFFF, b" ".join(words), set()
        for k in range(low, high):
            if self.heads[k] == head:
                a, b = self.at[self.starts[k]], self.at[self.starts[k] + self.length] - 1
                if b - a == len(line) and self.text[a:b] == line:
                    found.update(self.items[self.bounds[k] : self.bounds[k + 1]])
        return found


def matchers(items: Iterable[tuple[int, bytes | None]], window: int = 10) -> list[WuManber]:
    by_length: dict[int, list[tuple[int, list[bytes]]]] = {}
    for item, text in items:
        words = words_of(text)
        if words and item is not None:
            by_length.setdefault(min(window, len(words)), []).append((item, words))
    return [WuManber(k, by_length[k]) for k in sorted(by_length)]


def scan(text: bytes | None, found_by: list[WuManber]) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, hit spans (word positions, end excluded, disjoint, in order) and items."""
    words = words_of(text)
    spans: list[tuple[int, int]] = []
    items: set[int] = set()
    for matcher in found_by:
        for start, who in matcher.search(words):
            spans.append((start, start + matcher.length))
            items |= who
    return len(words), merge(spans), items


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    joined: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if joined and start <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((start, end))
    return joined


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, matcher_bytes: int = MATCHER_BYTES, carry: list[str] | None = None) -> DataFrame:
    """``(id_col, carry..., n_words, spans array<struct<start,end>>, item_ids array<long>)`` for each document row.

    The item table is read in blocks whose matchers take about ``matcher_bytes``. One block is one pass and no join. More blocks are searched
    one after the other over a numbered copy of the rows, so that no task holds two matchers; hits are written and joined to their rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = items.select(F.col(item_id_col).cast("long").alias("i"), utf8(item_text_col).alias("t"))
    size = source.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    passes = max(1, -(-size * _PER_BYTE // matcher_bytes))
    carry = [c for c in carry or [] if c not in (id_col, "n_words", "spans", "item_ids")]
    names = [id_col, *carry]
    if passes == 1:
        return _searched(docs.select(utf8(text_col).alias("__text"), *names), source, window, True)
    rows = durable(docs.select(F.monotonically_increasing_id().alias("__row"), utf8(text_col).alias("__text"), *names))
    texts = rows.select("__text", "__row")
    found = [durable(_searched(texts, source.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == k), window, k == 0)) for k in range(passes)]
    words, hits = found[0].select("__row", "n_words"), found[0].where(F.size("item_ids") > 0).select("__row", "spans", "item_ids")
    for other in found[1:]:
        hits = hits.unionByName(other.select("__row", "spans", "item_ids"))
    merged = hits.groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    joined = rows.drop("__text").join(words, "__row").join(merged, "__row", "left")
    none = lambda c: F.coalesce(c, F.expr(f"cast(array() as {'array<struct<start:int,end:int>>' if c == 'spans' else 'array<bigint>'})"))
    return joined.select(*names, "n_words", _merged(none("spans")).alias("spans"), none("item_ids").alias("item_ids"))


def _merged(spans: Column) -> Column:
    """Sorted disjoint spans; those that touch are one."""
    start = F.lit(None).cast("array<struct<start:int,end:int>>")
    last = lambda a: F.element_at(a, -1)
    one = lambda s: F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))
    grown = lambda a, s: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))
    step = lambda a, s: F.when(a.isNull(), one(s)).when(s["start"] <= last(a)["end"], grown(a, s)).otherwise(F.concat(a, one(s)))
    return F.coalesce(F.aggregate(F.array_sort(spans), start, step), F.expr("cast(array() as array<struct<start:int,end:int>>)"))


def _searched(rows: DataFrame, items: DataFrame, window: int, every: bool) -> DataFrame:
    """The columns after the first, the text, with ``n_words, spans, item_ids``; without ``every`` only rows with hits."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(matchers(((r.i, r.t and bytes(r.t)) for r in items.toLocalIterator()), window)))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    span_list = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = pickle.loads(shared.value)
        for batch in batches:
            told = [scan(text, found_by) for text in batch.column(0).to_pylist()]
            made = {
                "n_words": pa.array([n for n, _, _ in told], pa.int64()),
                "spans": pa.array([[{"start": a, "end": b} for a, b in spans] for _, spans, _ in told], span_list),
                "item_ids": pa.array([sorted(who) for _, _, who in told], pa.list_(pa.int64())),
            }
            out = pa.RecordBatch.from_arrays([*batch.columns[1:], *made.values()], names=[*batch.schema.names[1:], *made])
            yield out if every else out.filter(pa.array([bool(who) for _, _, who in told], pa.bool_()))

    return rows.mapInArrow(run, f"{kept}, n_words bigint, spans array<struct<start:int,end:int>>, item_ids array<bigint>")
