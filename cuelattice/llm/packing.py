"""Bounded-space online best-fit packing of token sequences.

Each task packs the pieces it reads into a fixed number of open bins, held in a bitset keyed by free space: the lowest set
bit at or above a piece's length is the best fit. When a new bin would exceed the number, the fullest closes. Bins that are
still open at a task's end are packed again, as pieces, in ever fewer tasks until one task has seen the last of them.

Defined cases: a null text is an empty one and gives the end token alone; a document of more than ``size`` tokens is cut
into full pieces and a rest; repeated rows are packed each for itself; an empty table gives an empty result; columns besides
id and text are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable, flushed, rows_of

SIZE = 4096
OPEN_BINS = 512
#: Open bins of other tasks that one task of the later rounds packs.
MERGE_ROWS = 65_536
END_ID = 1
#: Words, and stems without case and marks, that a worker remembers in each of two generations; what the older one is asked
#: for moves to the younger. A word is remembered when its stem comes up again.
_WORDS, _STEMS = 60_000, 200_000


class Bins:
    """A fixed number of open bins of one capacity."""

    def __init__(self, capacity: int, limit: int, first: int) -> None:
        self.capacity, self.limit, self.next = capacity, limit, first
        self.free = 0  # bit f: some open bin has f free
        self.by_free: dict[int, list[int]] = {}
        self.open = 0

    def _push(self, bin_id: int, free: int) -> None:
        self.by_free.setdefault(free, []).append(bin_id)
        self.free |= 1 << free
        self.open += 1

    def _pop(self, free: int) -> int:
        held = self.by_free[free]
        bin_id = held.pop()
        if not held:
            self.free &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece."""
        fit = self.free >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            bin_id = self._pop(room)
        else:
            if self.open >= self.limit:
                self._pop((self.free & -self.free).bit_length() - 1)
            bin_id, room = self.next, self.capacity
            self.next += 1
        if room > length:
            self._push(bin_id, room - length)
        return bin_id, self.capacity - room

    def left(self) -> Iterator[tuple[int, int]]:
        """Open bins and what they hold."""
        for free, held in self.by_free.items():
            for bin_id in held:
                yield bin_id, self.capacity - free


#: ASCII marks that may end a word; the apostrophe is not among them, since the tokenizer keeps some endings with it.
_MARKS = '!"#$%&()*+,-./:;<=>?@[]^_`{|}~\\'
#: The normalizer and splitter for which a word of letters may be handed to the model at once.
_PLAIN_STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Encoder(dict):
    """White-space separated words to their token ids, as little-endian 32-bit bytes; remembers the latest of them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = any(any(map(str.isspace, t.content)) for t in self.tokenizer.get_added_tokens_decoder().values())
        parts = json.loads(self.tokenizer.to_str())
        steps = (parts.get("normalizer") or {}).get("normalizers", []), (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = next((x["pattern"].get("Regex") for x in steps[1] if x["type"] == "Split"), "")
        self.plain = ([x["type"] for x in steps[0]], [x["type"] for x in steps[1]], pattern) == _PLAIN_STEPS
        self.letters = _byte_letters()
        self.old: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.old_stems: dict[str, bytes] = {}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            mark = word.rstrip(_MARKS)
            plain = self.plain and mark.isalpha() and (mark.isascii() or max(mark) < "\u0100")  # letters that the normalizer only lower-cases, then a run of marks
            stem = mark.lower() if plain else word
            ids = self.stems.get(stem)
            again = ids is not None
            if not again:
                ids = self.old_stems.get(stem)
                if ids is None:
                    if plain:
                        ids = self._packed([t.id for t in self.tokenizer.model.tokenize(stem.encode().decode("latin-1").translate(self.letters))])
                    else:
                        ids = self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
                if len(self.stems) >= _STEMS:
                    self.stems, self.old_stems = {}, self.stems
                if len(stem) <= 64:
                    self.stems[stem] = ids
            if plain and len(mark) < len(word):
                ids += self[word[len(mark) :]]
            if not again or len(word) > 64:
                return ids
        if len(self) >= _WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        """The tokenizer drops white space and no token spans it, so words may be encoded apart and remembered."""
        if self.whole:
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_encoders: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    """One for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def _merge_rounds(left: DataFrame, size: int, limit: int, merge_rows: int) -> DataFrame:
    """``left(bin, held)`` to ``(bin, sequence, base)``: where each open bin goes in the end."""
    spark = left.sparkSession
    out = pa.schema([("bin", pa.int64()), ("held", pa.int64()), ("sequence", pa.int64()), ("base", pa.int64())])
    now, moved, round_no = left, None, 0
    while True:
        round_no += 1
        tasks = max(1, -(-now.count() // merge_rows))

        def run(batches: Iterator[pa.RecordBatch], round_no=round_no) -> Iterator[pa.RecordBatch]:
            bins = Bins(size, limit, (round_no << 56) + (TaskContext.get().partitionId() << 32))

            def each() -> Iterator[tuple]:
                for bin_id, held in rows_of(batches):
                    yield (bin_id, held, *bins.place(held))
                for bin_id, held in bins.left():
                    yield None, held, bin_id, 0

            return flushed(out, each())

        put = durable(now.repartition(tasks, F.xxhash64("bin")).sortWithinPartitions(F.xxhash64("bin")).mapInArrow(run, "bin long, held long, sequence long, base long"))
        step = put.where("bin is not null").select("bin", "sequence", "base")
        if moved is None:
            moved = step
        else:
            on = step.select(F.col("bin").alias("sequence"), F.col("sequence").alias("then"), F.col("base").alias("more"))
            moved = moved.join(on, "sequence", "left").select("bin", F.coalesce("then", "sequence").alias("sequence"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        if tasks == 1:
            return moved
        now = put.where("bin is null").select(F.col("sequence").alias("bin"), "held")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, open_bins: int = OPEN_BINS, end_id: int = END_ID, payload: str = "ids", merge_rows: int = MERGE_ROWS) -> DataFrame:
    """``(id_col, piece, start, length, ids | ids_crc32, sequence_id, offset)``, a row for each piece.

    ``payload`` ``"ids"`` returns each piece's token ids as little-endian unsigned 32-bit bytes, ``"crc32"`` only their CRC.
    """
    bounded_batches(docs.sparkSession)
    kind = {"ids": ("ids", pa.binary(), "binary"), "crc32": ("ids_crc32", pa.int64(), "long")}[payload]
    out = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), (kind[0], kind[1]), ("bin", pa.int64()), ("offset", pa.int64())])
    end = end_id.to_bytes(4, "little")

    def pieces(rows: Iterable[tuple]) -> Iterator[tuple]:
        own_encoder = encoder(tokenizer_path)
        bins = Bins(size, open_bins, TaskContext.get().partitionId() << 32)
        for doc_id, text in rows:
            ids = own_encoder.text(text or "") + end
            for piece, start in enumerate(range(0, len(ids) // 4, size)):
                own = ids[4 * start : 4 * (start + size)]
                yield (doc_id, piece, start, len(own) // 4, own if payload == "ids" else zlib.crc32(own), *bins.place(len(own) // 4))
        for bin_id, held in bins.left():
            yield None, -1, 0, held, None, bin_id, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return flushed(out, pieces(rows_of(batches)), 2_000)

    put = durable(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id long, piece int, start long, length long, {kind[0]} {kind[2]}, bin long, offset long"))
    moved = _merge_rounds(put.where("piece < 0").select("bin", F.col("length").alias("held")), size, open_bins, merge_rows)
    placed = put.where("piece >= 0").join(moved, "bin", "left")
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", kind[0], F.coalesce("sequence", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
