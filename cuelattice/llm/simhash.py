"""SimHash near-duplicates: BK-trees over shards of fingerprints.

A fingerprint bit is set when it is set in more than half of the document's shingle hashes. Two fingerprints within
``radius`` bits agree in at least ``m - radius`` of any ``m`` bit blocks, so each fingerprint is routed to one shard for
every choice of ``m - radius`` blocks and no link is lost. A shard holds its fingerprints in a BK-tree whose children are
keyed by their Hamming distance to the parent; a search follows only edges within the radius, and enters no subtree that is
joined to it already. Trees go to the task that holds their shard's searches rather than to every executor, because all trees
together grow with the corpus.

:func:`near_duplicates` links by fingerprints alone. :func:`near_duplicate_texts` links by the similarity of shingle sets: sets of
similarity 0.8 differ in about ten bits and in up to ``TEXT_RADIUS``, which bit blocks cannot route (they would be under three bits), so
there shards are blocks of least shingles, the trees propose pairs, and whole sets decide.

Defined cases: null and empty texts (or white space only) have fingerprint 0 and link like any other; texts of fewer words
than a shingle hash the whole sequence; repeated rows and ties keep one row each; an empty table gives an empty result;
columns besides the id and the text are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable, flushed, join_classes, rows_of, sorted_groups, utf8
from .components import components
from .shingles import SHINGLE, SIMILARITY, alike, factors, set_fingerprint, shard_keys, shingle_set

SEED = 42
#: Bits by which sets of similarity 0.8 may differ; ten on average, with a deviation of three.
TEXT_RADIUS = 24
#: Members of a text shard whose pairs are listed; sets of a larger one travel to its tasks.
LISTED = 8
#: Fingerprints in one BK-tree at most; a larger shard is cut into pieces, and each pair of pieces is one task's work.
TREE_SIZE = 2048
_CHUNK = 1 << 15


def simhash64(text: bytes | None, shingle: int = 4) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total, last = np.zeros(64, np.int64), n - shingle + 1
    for lo in range(0, last, _CHUNK):
        hi = min(last, lo + _CHUNK)
        pairs = zip(starts[lo:hi].tolist(), ends[lo + shingle - 1 : hi + shingle - 1].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in pairs], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * total > last, bitorder="little").tobytes(), "little")


class BKTree:
    """Fingerprints by Hamming distance; a node's children are keyed by their distance to it.

    Nodes may be joined into groups. ``whole[node]`` is a member of the one group that the node and all below it belong to, or -1.
    """

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []
        self.group: list[int] = []
        self.whole: list[int] = []

    def root(self, node: int) -> int:
        group = self.group
        while group[node] != node:
            group[node] = group[group[node]]
            node = group[node]
        return node

    def add(self, code: int, near: Iterable[int] = ()) -> None:
        """Insert a code as one group with the nodes in ``near``."""
        own = len(self.codes)
        self.group.append(own)
        for node in near:
            self.group[self.root(node)] = own
        path, here = [], 0
        while own:
            path.append(here)
            step = (code ^ self.codes[here]).bit_count()
            below = self.children[here].get(step)
            if below is None:
                self.children[here][step] = own
                break
            here = below
        for node in path:
            if self.whole[node] >= 0 and self.root(self.whole[node]) != own:
                self.whole[node] = -1
        self.codes.append(code)
        self.children.append({})
        self.whole.append(own)

    def apart(self, code: int, radius: int, alike: Callable[[int], bool] | None = None) -> list[int]:
        """One node for each group that has a code at ``radius`` bits or fewer (and ``alike``); none of a found group is looked at again."""
        codes, children, found, roots = self.codes, self.children, [], set()
        todo = [0] if codes else []
        while todo:
            here = todo.pop()
            if roots and self.whole[here] >= 0 and self.root(self.whole[here]) in roots:
                continue
            d = (code ^ codes[here]).bit_count()
            if d <= radius and (root := self.root(here)) not in roots and (alike is None or alike(here)):
                roots.add(root)
                found.append(here)
            if edges := children[here]:
                lo, hi = d - radius, d + radius
                todo += [node for step, node in edges.items() if lo <= step <= hi]
        return found


def spanning(codes: list[int], radius: int, alike: Callable[[int, int], bool] | None = None) -> Iterator[tuple[int, int]]:
    """Enough index pairs of a shard to join all codes that are within ``radius`` (and alike)."""
    tree = BKTree()
    for i, code in enumerate(codes):
        near = tree.apart(code, radius, alike and (lambda j, i=i: alike(i, j)))
        for j in near:
            yield i, j
        tree.add(code, near)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, fp)``: each row's fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)
    out = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return flushed(out, ((i, _signed(simhash64(t, shingle))) for i, t in rows_of(batches)))

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def _parts_of(mask: int, parts: int) -> list[int]:
    """The bits of ``mask`` in ``parts`` even parts."""
    bits = [1 << k for k in range(64) if mask >> k & 1]
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(bits[a:b]) for a, b in itertools.pairwise(edges)]


def _masks(blocks: int, radius: int) -> list[int]:
    parts = _parts_of(2**64 - 1, blocks)
    return [sum(chosen) for chosen in itertools.combinations(parts, blocks - radius)]


def _blocks_for(n: int, radius: int) -> int:
    """More and shorter blocks, of which more must agree, as fingerprints become many."""
    blocks = radius + 1
    while blocks < radius + 4 and n > (256 << (64 * (blocks - radius) // blocks)):
        blocks += 1
    return blocks


def links(distinct: DataFrame, radius: int = 4, tree_size: int = TREE_SIZE) -> DataFrame:
    """``distinct(fp)`` to ``(u, v)``: enough links between fingerprints within ``radius`` bits to join all that are linked.

    A shard of more than ``tree_size`` codes is dealt out again by what its codes can still differ in: the bits that are not its own are
    cut into ``radius + 1`` parts, of which linked codes agree in one. Only what is as large after that is cut into pieces.
    """
    masks = _masks(_blocks_for(distinct.count(), radius), radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("choice", "block"))
    sizes = keyed.groupBy("choice", "block").agg(F.count("*").alias("n")).where("n > 1")
    plain = keyed.join(sizes.where(F.col("n") <= tree_size).select("choice", "block"), ["choice", "block"])
    inner = [F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m | p))).alias("block")) for k, p in enumerate(_parts_of(~m & (2**64 - 1), radius + 1))]) for m in masks]
    crowded = keyed.join(sizes.where(F.col("n") > tree_size).select("choice", "block"), ["choice", "block"])
    finer = crowded.select("fp", "choice", F.explode(F.get(F.array(*inner), F.col("choice"))).alias("x")).select("fp", (F.lit(len(masks)) + F.col("choice") * (radius + 1) + F.col("x.part")).alias("choice"), "x.block")
    again = finer.groupBy("choice", "block").agg(F.count("*").alias("n")).where("n > 1").select("choice", "block", F.ceil(F.col("n") / tree_size).cast("int").alias("pieces"))
    routed = plain.select("fp", "choice", "block", F.lit(1).alias("pieces")).unionByName(finer.join(again, ["choice", "block"]).select("fp", "choice", "block", "pieces"))
    keys = ["choice", "block", "a", "b"]
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int]]:
            for _, (codes,) in sorted_groups(batches, 4):
                for i, j in spanning([c & (2**64 - 1) for c in codes], radius):
                    yield codes[i], codes[j]

        return flushed(out, found())

    return _pieces(routed, "fp").select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "u long, v long")


def _pieces(routed: DataFrame, code: str) -> DataFrame:
    """Rows of a shard with its number of ``pieces``, dealt to pairs ``a, b`` of pieces; a pair has both whole, and one piece is by itself."""
    own = F.pmod(F.xxhash64(code), F.col("pieces")).cast("int")
    dealt = routed.withColumn("own", own).withColumn("other", F.explode(F.expr("filter(sequence(0, pieces - 1), x -> pieces = 1 or x <> own)")))
    return dealt.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, tree_size: int = TREE_SIZE, fps: Callable | None = None) -> DataFrame:
    """``(id_col, fingerprint, component_id)``: each row, its fingerprint in 16 hex digits, the smallest id it is linked to.

    ``fps`` may replace :func:`fingerprints` (same arguments, same columns).
    """
    hashed = durable((fps or fingerprints)(docs, id_col, text_col, shingle))
    classes = durable(hashed.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    roots = components(links(classes.select("fp"), radius, tree_size)).select(F.col("u").alias("fp"), "root")
    named = classes.join(roots, "fp", "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = durable(named.join(lowest, "root").select("fp", "n", "component_id"))
    return join_classes(hashed, label, "fp", "n", hashed.count()).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicate_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = TEXT_RADIUS, listed: int = LISTED, tree_size: int = TREE_SIZE) -> DataFrame:
    """``(id_col, component_id)``: each row and the smallest id that links of similarity ``least`` or more lead to. Ids must be unique.

    Texts of equal shingle sets are one node. BK-trees over each shard's fingerprints propose pairs, and sets confirm them: small shards
    list their pairs first, so that a pair met in several shards is confirmed once; a large one is searched where its sets are at hand.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t"))
    links = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    read = lambda held: np.frombuffer(held, np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = factors()

        def each() -> Iterator[tuple]:
            for i, t in rows_of(batches):
                held = shingle_set(t, shingle)
                yield i, xxhash.xxh3_128_digest(held.tobytes()), _signed(set_fingerprint(held)), shard_keys(held, order)

        return flushed(pa.schema([("id", pa.int64()), ("same", pa.binary()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))]), each(), 4000)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return flushed(pa.schema([("id", pa.int64()), ("held", pa.binary())]), ((i, shingle_set(t, shingle).tobytes()) for i, t in rows_of(batches)), 500)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, int]]:
            for (group,) in rows_of(batches):
                for k, one in enumerate(group):
                    tree = BKTree()
                    tree.add(one["fp"] & (2**64 - 1))
                    for other in group[k + 1 :]:
                        if tree.apart(other["fp"] & (2**64 - 1), radius):
                            yield min(one["id"], other["id"]), max(one["id"], other["id"])

        return flushed(links, each())

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return flushed(links, ((u, v) for u, v, a, b in rows_of(batches) if alike(read(a), read(b), least)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, int]]:
            for _, (ids, codes, held) in sorted_groups(batches, 3):
                sets = list(map(read, held))
                for i, j in spanning([c & (2**64 - 1) for c in codes], radius, lambda i, j, sets=sets: alike(sets[i], sets[j], least)):
                    yield ids[i], ids[j]

        return flushed(links, each())

    signed = durable(texts.mapInArrow(sign, "id long, same binary, fp long, keys array<long>"))
    classes = durable(signed.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    keyed = signed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "fp", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    grouped = durable(keyed.join(sizes, "key"))
    sets = durable(texts.join(grouped.select("id").distinct(), "id", "left_semi").mapInArrow(hold, "id long, held binary"))

    few = grouped.where(F.col("n") <= listed).groupBy("key").agg(F.collect_list(F.struct("id", "fp")).alias("group")).select("group")
    pairs = few.mapInArrow(propose, "u long, v long").distinct()
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("held").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("held").alias("b")), "v")
    found = both.select("u", "v", "a", "b").mapInArrow(confirm, "u long, v long")

    many = _pieces(grouped.where(F.col("n") > listed).withColumn("pieces", F.ceil(F.col("n") / tree_size).cast("int")), "id")
    dealt = many.join(sets, "id").select("key", "a", "b", "id", "fp", "held")
    joined = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(search, "u long, v long")

    roots = components(found.unionByName(joined)).select(F.col("u").alias("rep"), "root")
    label = durable(classes.join(roots, "rep", "left").select("same", "n", F.coalesce("root", "rep").alias("component_id")))
    return join_classes(signed.select("id", "same"), label, "same", "n", signed.count()).select(F.col("id").alias(id_col), "component_id")
