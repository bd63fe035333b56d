"""What a container says of itself: streams, languages and length from a prober's JSON, as columns. An answer that cannot be read says nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWER = "struct<streams:array<struct<index:int,codec_type:string,tags:struct<language:string,title:string>>>,format:struct<duration:string>>"
# Three-letter codes that stream tags use, with the two-letter code of each; tags that mean that nothing was set; words of titles of other than the main track.
CODES = (("eng", "en"), ("dan", "da"), ("swe", "sv"), ("nor", "no"), ("nob", "no"), ("nno", "no"), ("deu", "de"), ("ger", "de"), ("fra", "fr"), ("fre", "fr"), ("spa", "es"), ("ita", "it"), ("nld", "nl"), ("dut", "nl"), ("por", "pt"),
         ("fin", "fi"), ("isl", "is"), ("ice", "is"), ("jpn", "ja"), ("kor", "ko"), ("zho", "zh"), ("chi", "zh"), ("rus", "ru"), ("pol", "pl"), ("ces", "cs"), ("cze", "cs"))
UNSET = ("und", "unk", "undefined")
OTHER_TRACK = ("commentary", "subs", "subtitle", "description")
ENGLISH = ("en", "eng", "english")


def streams(body: Column, kind: str) -> Column:
    """The streams of a kind (``audio``, ``subtitle``, ``video``) in their order; none of an answer that cannot be read."""
    every = F.coalesce(F.from_json(body, ANSWER)["streams"], F.from_json(F.lit("[]"), "array<struct<index:int,codec_type:string,tags:struct<language:string,title:string>>>"))
    return F.filter(every, lambda s: s["codec_type"] == kind)


def duration(body: Column) -> Column:
    """Seconds; null where they are not told or not a number."""
    return F.from_json(body, ANSWER)["format"]["duration"].try_cast("double")


def language_of_tag(tag: Column) -> Column:
    """Two-letter code of a stream's tag where there is one, else the tag itself if it is shaped like a code; null where none was set."""
    low = F.lower(F.coalesce(tag, F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in CODES for x in pair])
    return F.when(~low.isin(*UNSET), F.coalesce(F.try_element_at(known, low), F.when(low.rlike("^[a-z]{2,3}$"), low)))


def english_index(audio: Column) -> Column:
    """Place among the audio streams of the first English one: by its tag, or by its title where the tag says nothing and the title names no other track."""

    def english(s: Column) -> Column:
        tag, title = F.lower(F.coalesce(s["tags"]["language"], F.lit(""))), F.lower(F.coalesce(s["tags"]["title"], F.lit("")))
        by_title = title.contains("english")
        for word in OTHER_TRACK:
            by_title = by_title & ~title.contains(word)
        return F.when((tag != "") & (tag != "und"), tag.isin(*ENGLISH)).otherwise(by_title)

    return F.nullif(F.array_position(F.transform(audio, english), True) - 1, F.lit(-1))


def audio_language(audio: Column) -> Column:
    """``en`` where there is an English track, which is the one to listen to; else the first track's."""
    return F.when(english_index(audio).isNotNull(), "en").otherwise(language_of_tag(F.get(audio, F.lit(0))["tags"]["language"]))


def embedded_languages(subtitles: Column) -> Column:
    """Languages of the subtitle streams, each once, in order of name."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(subtitles, lambda s: language_of_tag(s["tags"]["language"])), lambda c: c.isNotNull())))
