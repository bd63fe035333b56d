"""How far the sources of a language are apart, by exact integer arithmetic over term counts from mergeable radix tries.

Every task counts its documents' terms in one byte trie a language, whose leaves hold a counter for each source. Leaves leave in UTF-8 order, are dealt by
prefix ranges and merged where equal terms meet. A second traversal streams the kept terms through every pair of sources and keeps the best candidates.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, durable, utf8

#: Numbers of (group, term) pairs after which a task folds them into its tries, and leaves after which the tries are sent off.
PENDING, LEAVES = 1_500_000, 400_000
#: Groups that one broadcast holds, pairs of sources whose sums a task keeps, and numbers of one dense block.
GROUPS, KEPT_PAIRS, CELLS = 1_000_000, 4_000_000, 1 << 20
#: Bits of a key: a language's number (13), a term's (27), a source's (23). A task starts new numbers before they run out.
TERMS, SOURCES = (1 << 27) - 1, (1 << 23) - 1
#: Letters lower-cased, bytes of other characters as they are, everything else a space.
TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Trie:
    """Radix trie over bytes. A node is ``[label, children by first byte or None, leaf or None]``; a leaf is ``[documents, sources, counts]``."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.leaves = 0

    def leaf(self, term: bytes) -> list:
        """The leaf of a term, made on first use: an edge that the term leaves half-way is split there."""
        node, at, end = self.root, 0, len(term)
        while at < end:
            children = node[1]
            if children is None:
                children = node[1] = {}
            child = children.get(term[at])
            if child is None:
                child = children[term[at]] = [term[at:], None, None]
                at = end
            elif term.startswith(child[0], at):
                at += len(child[0])
            else:
                label, same = child[0], 1
                while at + same < end and same < len(label) and label[same] == term[at + same]:
                    same += 1
                child[0] = label[same:]
                child = children[term[at]] = [label[:same], {label[same]: child}, None]
                at += same
            node = child
        if node[2] is None:
            node[2] = [0, [], []]
            self.leaves += 1
        return node[2]

    def __iter__(self) -> Iterator[tuple[bytes, list]]:
        """Leaves in the order of their bytes, which is UTF-8's order of code points."""
        open_nodes = [(b"", self.root)]
        while open_nodes:
            before, node = open_nodes.pop()
            term = before + node[0]
            if node[2] is not None:
                yield term, node[2]
            if node[1]:
                open_nodes += [(term, node[1][b]) for b in sorted(node[1], reverse=True)]


class Numbers(dict):
    """Keys numbered in the order in which they are asked for."""

    def __missing__(self, key) -> int:  # noqa: ANN001
        self[key] = n = len(self)
        return n


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


LEAF = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
LEAF_TYPE = "lang string, term string, docs bigint, sources array<string>, counts array<bigint>"


def leaves_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", pending: int = PENDING, leaves: int = LEAVES) -> DataFrame:
    """``(lang, term, docs, sources, counts)``: what each task counted, its terms in order; nulls are empty."""
    spark = docs.sparkSession
    bounded_batches(spark)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), utf8(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, langs, sources = Numbers(), Numbers(), Numbers()
        tries: dict[int, Trie] = defaultdict(Trie)
        # pending counts by (language, term, source) and documents by (language, term)
        counts, docs = (np.zeros(0, np.int64), np.zeros(0, np.int64)), (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def fold() -> None:
            nonlocal counts, docs
            key, n = counts
            if not len(key):
                return
            term_of, source = key >> 23, (key & SOURCES).tolist()
            start = np.flatnonzero(np.append(True, term_of[1:] != term_of[:-1]))
            told, n, terms = docs[1].tolist(), n.tolist(), list(words)
            for k, (here, a, b) in enumerate(zip(term_of[start].tolist(), start.tolist(), [*start[1:].tolist(), len(key)], strict=True)):
                leaf = tries[here >> 27].leaf(terms[here & TERMS])
                leaf[0] += told[k]
                leaf[1] += source[a:b]
                leaf[2] += n[a:b]
            counts = docs = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def sent() -> Iterator[pa.RecordBatch]:
            names, of = list(sources), list(langs)
            for lang, trie in tries.items():
                part: list[tuple[bytes, list]] = []
                for one in trie:
                    part.append(one)
                    if len(part) >= 20_000:
                        yield batch_of(of[lang], part, names)
                        part = []
                if part:
                    yield batch_of(of[lang], part, names)
            for table in (tries, words, langs, sources):
                table.clear()

        for batch in batches:
            for step in range(0, batch.num_rows, 4096):
                part = batch.slice(step, 4096)
                lang = np.fromiter(map(langs.__getitem__, part.column(0).to_pylist()), np.int64)
                source = np.fromiter(map(sources.__getitem__, part.column(1).to_pylist()), np.int64)
                told = [np.fromiter(map(words.__getitem__, t.translate(TABLE).split()), np.int64) if t else np.zeros(0, np.int64) for t in part.column(2).to_pylist()]
                each = np.repeat(np.arange(len(told)), [len(t) for t in told])
                doc_term, n = np.unique(each << 27 | np.concatenate(told), return_counts=True)
                doc, term = doc_term >> 27, doc_term & TERMS
                lang_term = lang[doc] << 27 | term
                counts = added(np.concatenate([counts[0], lang_term << 23 | source[doc]]), np.concatenate([counts[1], n]))
                docs = added(np.concatenate([docs[0], lang_term]), np.concatenate([docs[1], np.ones(len(doc), np.int64)]))
                full = len(words) > leaves or len(langs) >= 2000 or len(sources) >= SOURCES - 4096
                if len(counts[0]) >= pending or full:
                    fold()
                    if full or sum(t.leaves for t in tries.values()) >= leaves:
                        yield from sent()
        fold()
        yield from sent()

    return rows.mapInArrow(run, LEAF_TYPE)


def batch_of(lang: str, part: list[tuple[bytes, list]], names: list[str]) -> pa.RecordBatch:
    """Leaves of one language's trie as rows; sources are named."""
    terms, leaves = zip(*part, strict=True)
    offsets = pa.array(np.cumsum([0, *(len(x[1]) for x in leaves)]), pa.int32())
    named = pa.array(names, pa.string()).take(pa.array(list(chain.from_iterable(x[1] for x in leaves)), pa.int64()))
    counts = pa.array(list(chain.from_iterable(x[2] for x in leaves)), pa.int64())
    columns = [pa.array([lang] * len(part), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([x[0] for x in leaves], pa.int64()), pa.ListArray.from_arrays(offsets, named), pa.ListArray.from_arrays(offsets, counts)]
    return pa.RecordBatch.from_arrays(columns, schema=LEAF)


def merged(leaves: DataFrame, least_docs: int = 10) -> DataFrame:
    """Tries merged by prefix range: leaves of equal terms added up, those in at least ``least_docs`` documents of their language.

    Prefixes of 64 characters deal the ranges. A range is one stream in UTF-8 order, in which the tries' leaves of a term follow each other, so a task holds one leaf.
    """
    bounded_batches(leaves.sparkSession)
    ranged = leaves.repartitionByRange("lang", F.substring("term", 1, 64)).sortWithinPartitions("lang", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            starts = _first_of_each(rows)
            if len(starts) and starts[-1]:
                yield from _summed(rows.slice(0, starts[-1]), starts[:-1], least_docs)
            held = rows.slice(starts[-1]) if len(starts) else rows
        if held is not None and held.num_rows:
            yield from _summed(held.combine_chunks(), _first_of_each(held.combine_chunks()), least_docs)

    return ranged.mapInArrow(run, LEAF_TYPE)


def _first_of_each(rows: pa.Table) -> np.ndarray:
    """Places where the (language, term) of sorted rows changes."""
    new = np.ones(rows.num_rows, bool)
    if rows.num_rows > 1:
        same = [pc.equal(rows[c].slice(1), rows[c].slice(0, rows.num_rows - 1)).to_numpy() for c in ("lang", "term")]
        new[1:] = ~(same[0] & same[1])
    return np.flatnonzero(new)


def _summed(rows: pa.Table, starts: np.ndarray, least_docs: int) -> Iterator[pa.RecordBatch]:
    """One leaf for each run of rows, without those in too few documents; counts of a source are added."""
    seen = rows["docs"].to_numpy()
    docs = np.add.reduceat(seen, starts)
    keep = docs >= least_docs
    if not keep.any():
        return
    group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(seen)]))
    mine = rows.filter(pa.array(keep[group])).combine_chunks()
    lists, counts = mine["sources"].chunk(0), mine["counts"].chunk(0)
    names = lists.flatten().dictionary_encode()
    entry = np.repeat((np.cumsum(keep) - 1)[group[keep[group]]], lists.value_lengths().to_numpy())
    wide = max(1, len(names.dictionary))
    key, n = added(entry * wide + names.indices.to_numpy(), counts.flatten().to_numpy())
    offsets = pa.array(np.searchsorted(key // wide, np.arange(keep.sum() + 1)), pa.int32())
    first = rows.take(pa.array(starts[keep])).combine_chunks()
    columns = [first["lang"].chunk(0), first["term"].chunk(0), pa.array(docs[keep]), pa.ListArray.from_arrays(offsets, names.dictionary.take(pa.array(key % wide))), pa.ListArray.from_arrays(offsets, pa.array(n))]
    yield pa.RecordBatch.from_arrays(columns, schema=LEAF)


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """``1 + floor(10^9 * (count + 2) / total)`` by long division in base 1,000, exact for totals below 9 * 10^15."""
    rest, found = counts + 2, np.zeros_like(counts)
    found, rest = found + rest // total, rest % total
    for _ in range(3):
        rest = rest * 1000
        found, rest = found * 1000 + rest // total, rest % total
    return 1 + found


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def compared(kept: DataFrame, groups: dict[str, tuple[list[str], list[int]]], vocabulary: dict[str, int], best: int) -> DataFrame:
    """``(lang, source, part, item, value)``: sums over a task's terms for pairs of sources, and each source's ``best`` candidate terms of a task."""
    spark = kept.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((groups, vocabulary))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, vocabulary = shared.value
        places = {lang: {s: k for k, s in enumerate(sources)} for lang, (sources, _) in groups.items()}
        sums: dict[str, np.ndarray] = {}
        candidates: dict[tuple[str, int], list[tuple[int, bytes]]] = {}

        def pair_rows(lang: str, i: int, values: np.ndarray) -> pa.RecordBatch:
            sources = groups[lang][0]
            other = [k for k in range(len(sources)) if k != i]
            n = len(other)
            return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([sources[i]] * n, pa.string()), pa.array(["pair"] * n), pa.array([sources[k] for k in other], pa.string()), pa.array(values[other], pa.int64())], schema=schema)

        def term_rows() -> Iterator[pa.RecordBatch]:
            rows = [(lang, groups[lang][0][i], "term", term.decode(), value) for (lang, i), found in candidates.items() for value, term in found]
            candidates.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        def block(lang: str, terms: list[str], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            extra, n = 2 * vocabulary[lang], np.array(groups[lang][1], np.int64)
            p, q = shares(counts, n + extra), shares(counts.sum(1), int(n.sum()) + extra)
            wide = len(n) ** 2 > KEPT_PAIRS
            if not wide and lang not in sums:
                sums[lang] = np.zeros((len(n), len(n)), np.int64)
            for i in range(len(n)):
                values = gap(p[:, i : i + 1], p).sum(0)
                if wide:
                    yield pair_rows(lang, i, values)
                else:
                    sums[lang][i] += values
                more = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q))
                if len(more):
                    value = gap(p[more, i], q[more])
                    if len(more) > best:
                        far = value >= np.partition(value, -best)[-best]
                        more, value = more[far], value[far]
                    own = candidates.get((lang, i), []) + [(int(v), terms[k].encode()) for v, k in zip(value, more, strict=True)]
                    candidates[lang, i] = sorted(own, key=lambda c: (-c[0], c[1]))[:best]
            if len(candidates) > 20_000:
                yield from term_rows()

        for batch in batches:
            langs, terms, _, sources, counts = batch.columns
            told, words = np.array(langs.to_pylist(), object), terms.to_pylist()
            at = np.asarray(sources.offsets)
            for lang in sorted(set(told)):
                here, where = np.flatnonzero(told == lang), places[lang]
                step = max(1, CELLS // len(where))
                for part in (here[k : k + step] for k in range(0, len(here), step)):
                    dense = np.zeros((len(part), len(where)), np.int64)
                    for row, k in enumerate(part):
                        dense[row, [where[s] for s in sources.values[at[k] : at[k + 1]].to_pylist()]] = counts.values[at[k] : at[k + 1]].to_numpy()
                    yield from block(lang, [words[k] for k in part], dense)
        for lang, values in sums.items():
            for i in range(len(values)):
                yield pair_rows(lang, i, values[i])
        yield from term_rows()

    return kept.mapInArrow(run, "lang string, source string, part string, item string, value bigint")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, best: int = 10, groups_at_once: int = GROUPS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances between the sources of a language (``pair``) and the terms that set a source apart from its language (``term``).

    Null languages, sources and texts are empty strings; a source without terms still has its pairs, and of equal values the item that sorts first in UTF-8 ranks first.
    An empty table gives no rows. The sources and totals of all languages are broadcast: their pairs are rows of the result, so they are about its square root;
    more than ``groups_at_once`` groups take several passes.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kept = durable(merged(durable(leaves_of(docs, text_col, lang_col, source_col)), least_docs))
    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("z")).groupBy("lang", F.col("z.sources").alias("source")).agg(F.sum("z.counts").alias("n"))
    every = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source")).distinct()
    groups = durable(every.join(counted, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")))
    vocabulary = {r.lang: r.v for r in kept.groupBy("lang").agg(F.count("*").alias("v")).collect()}
    told: list[DataFrame] = []
    held: dict[str, tuple[list[str], list[int]]] = {}
    for r in groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g")).toLocalIterator():
        if r.lang in vocabulary:
            if held and sum(len(s) for s, _ in held.values()) + len(r.g) > groups_at_once:
                told.append(compared(kept.where(F.col("lang").isin(list(held))), held, vocabulary, best))
                held = {}
            held[r.lang] = ([g.source for g in r.g], [g.n for g in r.g])
    told.append(compared(kept.where(F.col("lang").isin(list(held))), held, vocabulary, best))
    found = told[0]
    for more in told[1:]:
        found = found.unionByName(more)
    found = durable(found)
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    every = pairs.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(ranked))
    return every.where((F.col("part") == "pair") | (F.col("rank") <= best))
