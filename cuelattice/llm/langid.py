"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile is a text's or language's ``profile`` most frequent 1- to 3-grams of letters, words padded with a space. The
out-of-place distance sums, over a document's profile, how far each n-gram's rank is from its rank in the language's, and
the most where the language has it not. The language with the least distance wins; ties go to the smallest name.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any learned language every text is; null
labels teach nothing; an empty table gives an empty result; repeated rows keep a row each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, rows_of, to_batch

PROFILE = 400
#: Different labelled texts learned from, for each language, as expected number: they are taken by their hash, and copies of a text teach once.
TRAIN_ROWS = 6_000
#: More learned languages than this are refused, since the profiles are broadcast.
MAX_LANGUAGES = 2_000
UNDETERMINED = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of the text's 1- to 3-grams and their counts; a code is 21 bits for each character."""
    c = np.frombuffer(f" {_NO_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    pairs = (c[:-1] << np.uint64(21)) | c[1:]
    triples = ((pairs[:-1] << np.uint64(21)) | c[2:])[c[1:-1] != 32]
    return np.unique(np.concatenate((c[c != 32], pairs, triples)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, profile: int = PROFILE) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    if len(codes) > profile:
        least = np.partition(counts, len(counts) - profile)[len(counts) - profile]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:profile]]


class Profiles:
    """Languages' profiles in a form that a document is compared with at once."""

    def __init__(self, by_lang: dict[str, np.ndarray], profile: int = PROFILE) -> None:
        self.langs, self.profile = sorted(by_lang), profile
        self.codes = np.unique(np.concatenate([by_lang[x] for x in self.langs])) if self.langs else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int32)  # the last row: in no profile
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, by_lang[lang]), k] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 less the share of the greatest possible distance."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        own = ranked(*grams(text), self.profile)
        if not len(own):
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.codes, own)
        at[(at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        there = self.ranks[at]
        apart = np.where(there < 0, self.profile, np.abs(there - np.arange(len(own))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.profile * len(own)))


def train(docs: DataFrame, learn_from: Column, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE, train_rows: int = TRAIN_ROWS) -> Profiles:
    """Profiles from the rows of ``docs`` where ``learn_from`` holds and text and label are set.

    A language's copies of a text count once, so a text that fills a third of the rows neither rules the profile nor breaks ``train_rows``;
    the number of different texts is a sketch's estimate within about two hundredths.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where(learn_from).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).where("lang is not null and t is not null")
    different = F.approx_count_distinct(F.xxhash64("t"), 0.02).alias("texts")
    sizes = {r.lang: r.texts for r in rows.groupBy("lang").agg(different).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    if not sizes:
        return Profiles({}, profile)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, train_rows / n) * (1 << 30))])
    taken = rows.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < share[F.col("lang")]).dropDuplicates(["lang", "t"])
    out = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in rows_of([batch]):
                texts.setdefault(lang, []).append(text)
            for lang, held in texts.items():
                codes, counts = grams(" ".join(held))
                yield to_batch(out, [[lang] * len(codes), codes.astype(np.int64), counts])

    summed = taken.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= profile)
    by_lang: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "rank", "code").collect():
        by_lang.setdefault(r.lang, []).append((r["rank"], r.code))
    return Profiles({lang: np.array([c for _, c in sorted(held)], np.uint64) for lang, held in by_lang.items()}, profile)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``(id_col, lang_pred, score)`` and the columns named in ``carry`` for each row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    carry = [c for c in carry or [] if c not in (id_col, "lang_pred", "score")]
    kept = docs.select(F.col(id_col), *[F.col(c) for c in carry])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores = zip(*map(model.predict, batch.column(0).to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], "lang_pred", "score"])

    read = docs.select(F.col(text_col).alias("_text_read"), F.col(id_col), *[F.col(c) for c in carry])
    return read.mapInArrow(run, f"{schema}, lang_pred string, score double")
