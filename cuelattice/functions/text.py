"""Text rules as column expressions; only sequence matching and recursive splitting need Python, and get it in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sequences

# Words that carry no content, as the overlap rules leave them out.
STOPWORDS = tuple(
    """your yours yourself yourselves this that these those been being having doing and but because until while against between into
    through during before after above below from down again further then once here there when where why how both each more most other some
    such only same than very will just don't should should've now aren't couldn't didn't doesn't hadn't hasn't haven't isn't mustn't needn't
    shouldn't wasn't weren't won't wouldn't yeah okay well like know gonna wanna gotta right really actually guess mean said says tell told
    look looks looking going come came still about something someone anything everything nothing thing things people guys they them their
    theirs what which were have with would could also even much many you're you've you'll you'd she's hers herself himself itself themselves
    whom it's he's""".split()
)
# The spaces that lines are trimmed of, Unicode's space separators, and patterns of the text rules.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
WORD = r"[a-zA-ZæøåÆØÅéèêëüöäßñçÉÈÊËÜÖÄ']{4,}"
ASIDE = r"[\[(][^\[\]()]*[\])]"
NONSPEECH = r"^-?\s*(?:(?:[\[(][^\[\]()]*[\])]|\*[^*]+\*)\s*)+$"
MUSIC_WORD = r"(?i)\b(?:music|song|singing|sings)\b"
MUSIC_NOTES = "[♪♫]"
MUSIC_CUE = r"(?i)^\s*[\[(][^\])]*(?:\b(?:PLAYS|PLAYING|MUSIC|SONG|SINGING|SINGS)\b|♪)[^\])]*[\])]\s*$"


def lines(text: Column) -> Column:
    return F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\\N"), F.lit("\n")), "\n")


def speech_text(text: Column) -> Column:
    """What is spoken: lines with a music note and bracketed asides are left out."""
    spoken = F.filter(lines(text), lambda x: ~x.rlike(MUSIC_NOTES))
    return F.regexp_replace(F.array_join(spoken, " "), ASIDE, " ")


def tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct lower-cased words of four letters or more that are not stopwords."""
    found = F.transform(F.regexp_extract_all(speech_text(text), F.lit(WORD), F.lit(0)), F.lower)
    return F.array_except(found, F.array(*map(F.lit, stopwords)) if stopwords else F.expr("cast(array() as array<string>)"))


def overlap(of: Column, against: Column) -> Column:
    """Share of ``of``'s tokens that ``against`` has; null without tokens."""
    return F.when(F.size(of) > 0, F.size(F.array_intersect(of, against)) / F.size(of))


def is_nonspeech(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))).rlike(NONSPEECH)


def is_music(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return text.rlike(MUSIC_NOTES) | (is_nonspeech(text) & text.rlike(MUSIC_WORD))


def declares_music(text: Column) -> Column:
    """A bracketed cue that tells of music being played or sung."""
    return F.coalesce(text.rlike(MUSIC_CUE), F.lit(False))


def two_lines(text: Column, marked: bool = True) -> Column:
    """The two lines of a text that has just two with something in them besides spaces, else null; ``marked`` texts break at ``\\N`` as well."""
    parts = lines(text) if marked else F.split(F.coalesce(text, F.lit("")), "\n")
    # a function of one argument: with two, the line's number would be taken for what is to be trimmed
    said = F.filter(F.transform(parts, lambda x: F.trim(x, F.lit(SPACES))), lambda x: x != "")
    return F.when(F.size(said) == 2, said)


def cap_signal(first: Column, second: Column) -> Column:
    """The first line starts in lower case, the second in upper, and the first ends no sentence."""
    return first.rlike(r"^[^\p{L}]*\p{Ll}") & second.rlike(r"^[^\p{L}]*\p{Lu}") & ~first.rlike(r"[.!?]\W*$")


def dash_prefixed(line: Column) -> Column:
    return F.ltrim(line).startswith("-")


def sequence_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9 ]", "")


def clean_hint(text: Column, limit: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def low_confidence(no_speech: Column, logprob: Column, compression: Column) -> Column:
    """Whether a segment is doubtful; figures that are missing never make it so."""
    return F.coalesce((no_speech > 0.6) & (logprob < -1.0), F.lit(False)) | F.coalesce(compression > 2.4, F.lit(False))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two texts, as ``difflib`` finds them."""

    @F.pandas_udf(T.DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else sequences.ratio(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return ratio(a, b)


def order_verdict(heard: Column, first: Column, second: Column, margin: float = 0.1) -> Column:
    """True: the lines were said in the other order; false: in this one; null: too close to tell."""

    @F.pandas_udf(T.DoubleType())
    def gaps(told: pd.Series, kept: pd.Series, other: pd.Series) -> pd.Series:
        one = lambda t, a, b: None if t is None or a is None or b is None else sequences.ratio(t, a) - sequences.ratio(t, b)
        return pd.Series([one(*row) for row in zip(told, kept, other, strict=True)], dtype="float64")

    told, space = sequence_text(heard), F.lit(" ")
    # not deterministic to Spark, so that conditions on the verdict are not moved ahead of it, where it would be found again; both bars read one gap
    gap = gaps.asNondeterministic()(told, F.concat(sequence_text(first), space, sequence_text(second)), F.concat(sequence_text(second), space, sequence_text(first)))
    return F.get(F.transform(F.array(gap), lambda g: F.when(g <= -margin, F.lit(True)).when(g >= margin, F.lit(False))), F.lit(0))


def wrapped(text: Column, parts: Column) -> Column:
    """Words in ``parts`` runs of nearly equal number, earlier runs longer."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    size = lambda k: F.floor(n / parts).cast("int") + (k < n % parts).cast("int")
    start = lambda k: k * F.floor(n / parts).cast("int") + F.least(k, n % parts) + 1
    runs = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.array_join(F.slice(words, start(k), size(k)), " "))
    return F.filter(runs, lambda r: r != "")


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _halves(words: list[str]) -> tuple[str, str]:
    cut = (len(words) + 1) // 2
    return " ".join(words[:cut]), " ".join(words[cut:])


def split_cue(text: str, start: float, end: float, max_chars: int, max_seconds: float, depth: int = 4) -> Iterator[tuple[float, float, str]]:
    """Sentences, then halves while a part is too long in characters or seconds; time is shared out by characters."""
    parts = [p for p in _SENTENCE.split(" ".join(text.split())) if p]
    total = sum(map(len, parts)) or 1
    at = start
    for k, part in enumerate(parts):
        to = end if k == len(parts) - 1 else at + (end - start) * len(part) / total
        words = part.split()
        if depth > 0 and len(words) > 1 and (len(part) > max_chars or to - at > max_seconds):
            left, right = _halves(words)
            middle = at + (to - at) * len(left) / (len(left) + len(right))
            yield from split_cue(left, at, middle, max_chars, max_seconds, depth - 1)
            yield from split_cue(right, middle, to, max_chars, max_seconds, depth - 1)
        else:
            yield at, max(to, at + 0.05), part
        at = to


@F.udtf(returnType="part int, part_start double, part_end double, part_text string")
class SplitCue:
    """Table function: one long segment to readable cues."""

    def eval(self, text: str, start: float, end: float, max_chars: int, max_seconds: float) -> Iterator[tuple[int, float, float, str]]:
        if text is not None and start is not None and end is not None:
            for k, (a, b, part) in enumerate(split_cue(text, start, end, max_chars, max_seconds)):
                yield k, a, b, part
