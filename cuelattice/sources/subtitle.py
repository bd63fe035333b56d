"""Subtitle files as rows: a reader for SRT, WebVTT and ASS/SSA with one row for each cue, and an SRT writer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
_STAMP = re.compile(r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})")
_ARROW = re.compile(r"^\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})")
_TAG = re.compile(r"\{[^}]*\}|</?[a-zA-Z][^>]*>")


def decoded(content: bytes) -> str:
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding fits")


def milliseconds(stamp: str) -> int:
    hours, minutes, seconds, rest = _STAMP.match(stamp.strip()).groups()
    return ((int(hours or 0) * 60 + int(minutes)) * 60 + int(seconds)) * 1000 + int(rest.ljust(3, "0"))


def parse(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and text of each cue, by what the text looks like."""
    rows = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if any(r.startswith("[Events]") for r in rows):
        yield from _parse_ass(rows)
        return
    k = 0
    while k < len(rows):
        if not (m := _ARROW.match(rows[k])):
            k += 1
            continue
        said = []
        k += 1
        while k < len(rows) and rows[k].strip() and not _ARROW.match(rows[k]):
            said.append(rows[k])
            k += 1
        if k < len(rows) and _ARROW.match(rows[k]) and said and said[-1].strip().isdigit():
            said.pop()
        yield milliseconds(m[1]), milliseconds(m[2]), _TAG.sub("", "\n".join(said)).strip()


def _parse_ass(rows: list[str]) -> Iterator[tuple[int, int, str]]:
    names: list[str] = []
    for row in rows:
        head, _, rest = row.partition(":")
        if head == "Format" and "Text" in rest:
            names = [x.strip().lower() for x in rest.split(",")]
        elif head == "Dialogue" and names:
            values = dict(zip(names, rest.split(",", len(names) - 1), strict=False))
            yield milliseconds(values["start"]), milliseconds(values["end"]), _TAG.sub("", values["text"].replace("\\N", "\n").replace("\\n", "\n")).strip()


def read(spark: SparkSession, path: str, pattern: str = "*.{srt,vtt,ass,ssa}") -> DataFrame:
    """``(file_id, idx, start_ms, end_ms, text, error)``; a file that cannot be read has one row with the error alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")
    out = pa.schema([("file_id", pa.string()), ("idx", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("text", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(name, k, a, b, t, None) for k, (a, b, t) in enumerate(parse(decoded(content or b"")))]
                except (ValueError, AttributeError, KeyError) as e:
                    rows.append((name, None, None, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return files.mapInArrow(run, "file_id string, idx int, start_ms long, end_ms long, text string, error string")


def stamp(ms: F.Column) -> F.Column:
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), two(ms % 3_600_000 / 60_000), F.lit(":"), two(ms % 60_000 / 1000), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def as_srt(cues: DataFrame, key: str = "file_id", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """``(key, srt)``: each file's cues as one SRT text, in time order."""
    held = F.sort_array(F.collect_list(F.struct(F.col(start).alias("a"), F.col(end).alias("b"), "idx", "text")))
    block = lambda c, k: F.concat((k + 1).cast("string"), F.lit("\n"), stamp(c["a"]), F.lit(" --> "), stamp(c["b"]), F.lit("\n"), c["text"], F.lit("\n"))
    return cues.groupBy(key).agg(F.array_join(F.transform(held, block), "\n").alias("srt"))


def write(cues: DataFrame, folder: str, key: str = "file_id") -> None:
    """One text file in a folder for each file; refuses a folder that exists."""
    as_srt(cues, key).select(F.col(key).alias("name"), F.col("srt").alias("value")).write.mode("errorifexists").partitionBy("name").text(folder)
