"""Subword lattice likelihood: the probability of a text summed over all its segmentations into vocabulary pieces.

The pieces and their scores come from an existing vocabulary. Where the scores are merge ranks, as in the public one, they are
read as Zipf weights, 1 over the rank; one expectation step over the corpus's word counts then turns them into piece
probabilities. White space ends pieces, so a text's lattice falls into its words' lattices: each distinct word is scored once by a
forward recursion in log space, and a text's score is the sum over its words and the end of text. The corpus is gathered as
word counts, however many; the most frequent words, up to a fixed number, are broadcast, and all others are joined.

Defined cases: null, empty and blank texts are the end token alone; without training texts all counts are zero and pieces
keep their first weights; repeated rows are scored each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, durable, flushed, rows_of, utf8

#: Words that are broadcast at most; the rest, and words unseen in training, are joined.
BROADCAST_WORDS = 150_000
#: Distinct words that a task counts before it passes the counts on.
COUNTED_WORDS = 400_000
_SPACE = "▁"
_NO_PIECE = 1.0
_UNIT = 1e6
_LN10 = math.log(10)


class Pieces:
    """A unigram vocabulary: log weights by piece, bytes for characters that it lacks, and the end of text."""

    def __init__(self, weight: dict[str, float], byte_weight: list[float], end: float) -> None:
        self.weight, self.byte_weight, self.end = weight, byte_weight, end
        # every ending of a piece, so that a search backwards from a position stops as soon as no piece ends so
        self.endings = {piece[k:]: _NO_PIECE for piece in weight for k in range(1, len(piece))} | weight

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Pieces of a sentencepiece model file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain, in_bytes = {}, [0] * 256
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                in_bytes[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain[model.id_to_piece(i)] = float(model.get_score(i))
        low, high = min(plain.values()), max(plain.values())
        ranks = high - low > 1000  # not log probabilities, but numbers of merges
        weight = {p: -math.log1p(high - s) if ranks else s for p, s in plain.items()}
        total = math.fsum(map(math.exp, weight.values())) + 2
        scale = math.log(total)
        return cls({p: w - scale for p, w in weight.items()}, [-math.log(256) - scale] * 256, -scale)

    def _bytes_weight(self, char: str) -> float:
        return sum([self.byte_weight[b] for b in char.encode("utf-8", "surrogatepass")])

    def log_probability(self, text: str) -> float:
        """Natural logarithm of the summed weight of all segmentations: the forward recursion."""
        weight, forward = self.endings.get, [0.0]
        for end in range(1, len(text) + 1):
            terms, last = [], end - 1
            for start in range(last, -1, -1):
                w = weight(text[start:end])
                if w is None or w == _NO_PIECE:
                    if start == last:
                        terms.append(forward[start] + self._bytes_weight(text[start:end]))
                    if w is None:
                        break
                else:
                    terms.append(forward[start] + w)
            forward.append(_log_sum(terms))
        return forward[-1]

    def expected(self, text: str, times: float, into: dict[str | bytes, float]) -> None:
        """Add the expected number of uses of each piece in ``times`` copies of ``text``: forward and backward recursion."""
        weight, exp, n = self.endings.get, math.exp, len(text)
        forward, edges = [0.0], []
        for end in range(1, n + 1):
            own, terms, last = [], [], end - 1
            for start in range(last, -1, -1):
                piece: str | bytes = text[start:end]
                w = weight(piece)
                if w is None or w == _NO_PIECE:
                    if start == last:
                        lone = self._bytes_weight(piece)
                        own.append((start, piece.encode("utf-8", "surrogatepass"), lone))
                        terms.append(forward[start] + lone)
                    if w is None:
                        break
                else:
                    own.append((start, piece, w))
                    terms.append(forward[start] + w)
            edges.append(own)
            forward.append(_log_sum(terms))
        whole = forward[n]
        ahead: list[list[float]] = [[] for _ in range(n)] + [[0.0]]
        for end in range(n, 0, -1):
            if not ahead[end]:
                continue  # no segmentation ends a piece here and goes on
            back = _log_sum(ahead[end])
            for start, piece, w in edges[end - 1]:
                through = back + w
                ahead[start].append(through)
                into[piece] = into.get(piece, 0.0) + times * exp(forward[start] + through - whole)


def _log_sum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    most = max(terms)
    return most + math.log(sum([math.exp(t - most) for t in terms]))


def _word_text(word: bytes) -> str:
    return _SPACE + word.decode("utf-8", "surrogateescape")


def _count_rows(held_out: Counter, learned: Counter) -> Iterator[tuple[bytes, int, int]]:
    for word, n in learned.items():
        yield word, n, n + held_out.pop(word, 0)
    for word, n in held_out.items():
        yield word, 0, n


def word_counts(docs: DataFrame, learn_from: Column, text_col: str = "text", counted: int = COUNTED_WORDS) -> DataFrame:
    """``(word binary, c, uses)`` over all texts: how often a word occurs in training texts, and in all."""
    bounded_batches(docs.sparkSession)
    out = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("uses", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            counts = (Counter(), Counter())
            for text, training in rows_of(batches):
                counts[training].update((text or b"").lower().split())
                if len(counts[0]) + len(counts[1]) >= counted:
                    yield from _count_rows(*counts)
                    counts = (Counter(), Counter())
            yield from _count_rows(*counts)

        return flushed(out, each())

    rows = docs.select(utf8(text_col).alias("t"), F.coalesce(learn_from, F.lit(False)).alias("l"))
    return rows.mapInArrow(count, "word binary, c long, uses long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("uses").alias("uses"))


def learned_pieces(words: DataFrame, first: Pieces, texts: int) -> Pieces:
    """Piece probabilities by one expectation step over ``words(word, c)`` and ``texts`` ends of text; sums are whole millionths."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(first)
    out = pa.schema([("piece", pa.binary()), ("is_byte", pa.bool_()), ("n", pa.int64())])

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: dict[str | bytes, float] = {}
        for word, c in rows_of(batches):
            shared.value.expected(_word_text(word), c, into)

        def each() -> Iterator[tuple]:
            in_bytes = [0.0] * 256
            for piece, n in into.items():
                if isinstance(piece, str):
                    yield piece.encode(), False, round(n * _UNIT)
                else:
                    for b in piece:
                        in_bytes[b] += n
            yield from ((bytes([b]), True, round(n * _UNIT)) for b, n in enumerate(in_bytes) if n)

        return flushed(out, each())

    # at most one row for each piece and byte
    used = words.where("c > 0").select("word", "c").mapInArrow(expect, "piece binary, is_byte boolean, n long").groupBy("piece", "is_byte").agg(F.sum("n").alias("n")).collect()
    by_piece = {bytes(r.piece).decode(): r.n / _UNIT for r in used if not r.is_byte}
    by_byte = {bytes(r.piece)[0]: r.n / _UNIT for r in used if r.is_byte}
    least = 0.1  # so that pieces the corpus lacks keep some probability
    total = math.fsum(by_piece.values()) + math.fsum(by_byte.values()) + texts + least * (len(first.weight) + 257)
    chance = lambda n: math.log((n + least) / total)
    return Pieces({p: chance(by_piece.get(p, 0.0)) for p in first.weight}, [chance(by_byte.get(b, 0.0)) for b in range(256)], chance(texts))


def _frequent(words: DataFrame, most: int) -> int:
    """The least use count that at most ``most`` words reach."""
    level = F.floor(16 * F.log2("uses")).cast("int")
    total, last = 0, 1 << 62
    for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("uses").alias("least")).orderBy(F.desc("level")).collect():
        total += r.n
        if total > most:
            return last
        last = r.least
    return 1


def score(docs: DataFrame, learn_from: Column, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``(id_col, n_tokens, n_known, train_tokens, base_score, score)`` for each row; both scores are log10 probabilities.

    ``base_score`` is that of a word unigram with add-one smoothing, ``score`` that of the lattice.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    counted = durable(word_counts(docs, learn_from, text_col))
    texts = docs.where(F.coalesce(learn_from, F.lit(False))).count()
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v")).first()
    tokens, kinds = sums.n + texts, sums.v + (texts > 0)
    pieces = learned_pieces(counted, Pieces.load(pieces_path), texts)
    shared = spark.sparkContext.broadcast(pieces)
    base = lambda c: math.log10((c + 1) / (tokens + kinds + 1))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("uses", pa.int64()), ("lp", pa.float64())])
        return flushed(out, ((w, c, u, shared.value.log_probability(_word_text(w)) / _LN10) for w, c, u in rows_of(batches)))

    weighed = durable(counted.mapInArrow(weigh, "word binary, c long, uses long, lp double"))
    bar = _frequent(weighed, broadcast_words)
    often = weighed.where(F.col("uses") >= bar).select("word", "c", "lp").toArrow()
    table = spark.sparkContext.broadcast((often["word"].to_pylist(), often["c"].to_numpy(), often["lp"].to_numpy()))
    end = (base(texts), pieces.end / _LN10, int(texts > 0))
    fields = [("row", pa.int64()), ("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64()), ("word", pa.binary()), ("times", pa.int64())]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, logs = table.value
        place = {w: k for k, w in enumerate(names)}.get
        known = np.append(counts > 0, False)
        bases = np.append(np.array([base(c) for c in counts.tolist()]), 0.0)
        lattice = np.append(logs, 0.0)
        task, missing = TaskContext.get().partitionId() << 36, len(names)

        def each() -> Iterator[tuple]:
            for k, (doc_id, text) in enumerate(rows_of(batches)):
                words = (text or b"").lower().split()
                at = np.array(list(map(place, words, itertools.repeat(missing))), np.int64)
                yield task + k, doc_id, len(words) + 1, int(known[at].sum()) + end[2], float(bases[at].sum()) + end[0], float(lattice[at].sum()) + end[1], None, 0
                for word, times in Counter([words[i] for i in np.flatnonzero(at == missing).tolist()]).items():
                    yield task + k, None, 0, 0, 0.0, 0.0, word, times

        return flushed(pa.schema(fields), each())

    read = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t"))
    part = durable(read.mapInArrow(first_pass, "row long, id long, n_tokens long, n_known long, base double, lp double, word binary, times long"))
    rare = part.where("word is not null").select("row", "word", "times").join(weighed.where(F.col("uses") < bar).select("word", "c", F.col("lp").alias("own")), "word")
    times = F.col("times").cast("double")
    base_of = F.log10((F.col("c") + 1) / F.lit(float(tokens + kinds + 1)))
    rare = rare.select("row", F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("n_tokens"), (F.col("times") * (F.col("c") > 0).cast("long")).alias("n_known"), (times * base_of).alias("base"), (times * F.col("own")).alias("lp"))
    every = part.where("word is null").select("row", "id", "n_tokens", "n_known", "base", "lp").unionByName(rare)
    summed = every.groupBy("row").agg(F.max("id").alias("id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "lp")])
    return summed.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lp").alias("score"))


def log_probabilities(pieces: Pieces, texts: Iterable[str]) -> list[float]:
    """log10 probabilities of whole texts under ``pieces``, word by word, with the end of text."""
    each = lambda t: sum(pieces.log_probability(_word_text(w)) for w in t.encode().lower().split()) + pieces.end
    return [each(t) / _LN10 for t in texts]
