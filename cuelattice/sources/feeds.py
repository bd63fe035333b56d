"""Other inputs as rows: folders, speech intervals, transcripts, aligner logs, connector answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import shift_seconds
from ..functions.paths import base_name, episode_code, language_after_stem, stem

VIDEO_ENDINGS = (".mkv", ".mp4", ".avi", ".m4v", ".mov", ".ts", ".webm")
SUBTITLE_ENDINGS = (".srt", ".ass", ".ssa", ".vtt")
TRANSCRIPT = "struct<transcription:array<struct<offsets:struct<`from`:bigint,`to`:bigint>,text:string>>,result:struct<language:string>>"


def listing(spark: SparkSession, path: str, pruned: tuple[str, ...] = ()) -> DataFrame:
    """``(path, dir, name, ending, size, mtime)`` of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    for p in pruned:
        files = files.where(~F.col("path").startswith(p))
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), base_name(F.col("path")).alias("name"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ending"), "size", "mtime")


def pairs(files: DataFrame) -> DataFrame:
    """Videos with their subtitles: those of the same folder whose name starts with the video's stem; only where there is none, those of folders below
    that start so, share its episode code, or belong to the folder's only video."""
    from pyspark.sql import Window

    videos = files.where(F.col("ending").isin(*VIDEO_ENDINGS)).select(F.col("path").alias("video_path"), F.col("dir").alias("v_dir"), stem(F.col("path")).alias("v_stem"))
    videos = videos.withColumn("alone", F.count("*").over(Window.partitionBy("v_dir")) == 1)
    subs = files.where(F.col("ending").isin(*SUBTITLE_ENDINGS)).select(F.col("path").alias("subtitle_path"), "name", F.col("dir").alias("s_dir"))
    subs = subs.withColumn("v_dir", F.explode(F.array("s_dir", F.regexp_replace("s_dir", "/[^/]*$", ""))))
    fits = F.col("name").startswith(F.concat(F.col("v_stem"), F.lit(".")))
    same = F.col("s_dir") == F.col("v_dir")
    code = episode_code(F.col("name"))
    below = fits | F.coalesce(code == episode_code(F.col("v_stem")), F.lit(False)) | F.col("alone")
    met = videos.join(subs, "v_dir").withColumn("rank", F.when(same & fits, 1).when(~same & below, 2)).where("rank is not null")
    best = met.withColumn("_b", F.min("rank").over(Window.partitionBy("video_path"))).where("rank = _b")
    return best.select("video_path", "subtitle_path", F.when(F.col("name").startswith(F.col("v_stem")), language_after_stem(F.col("name"), F.length("v_stem"))).alias("lang"))


def speech_intervals(spark: SparkSession, path: str) -> DataFrame:
    """``(file_id, start, end)`` of tab-separated files; headers, text and empty intervals are skipped."""
    rows = spark.read.schema("start string, end string").option("sep", "\t").csv(path).select(F.input_file_name().alias("file_id"), F.expr("try_cast(start as double)").alias("start"), F.expr("try_cast(end as double)").alias("end"))
    return rows.where((F.col("end") > F.col("start")) & (F.col("start") >= 0))


def transcript_segments(text: Column) -> Column:
    """A transcriber's JSON to ``array<struct<start,end,text>>`` in seconds."""
    parts = F.from_json(text, TRANSCRIPT)["transcription"]
    return F.transform(parts, lambda x: F.struct((x["offsets"]["from"] / 1000.0).alias("start"), (x["offsets"]["to"] / 1000.0).alias("end"), x["text"].alias("text")))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``(file_id, language, start, end, text)``; bytes that are no UTF-8 become replacement characters."""
    read = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("j"))
    return read.select("file_id", F.from_json("j", TRANSCRIPT)["result"]["language"].alias("language"), F.inline_outer(transcript_segments(F.col("j"))))


def aligner_blocks(log: Column) -> Column:
    """``array<struct<n,shift>>`` of an aligner's log lines that move a number of lines by a time."""
    pattern = F.lit(r"shifted block of (\d+) subtitles with length [0-9:.]+ by (-?[0-9:.]+)")
    return F.arrays_zip(F.transform(F.regexp_extract_all(log, pattern, F.lit(1)), lambda x: x.cast("int")).alias("n"), F.transform(F.regexp_extract_all(log, pattern, F.lit(2)), shift_seconds).alias("shift"))


def silences(log: Column, duration: Column) -> Column:
    """``array<struct<start,end>>`` of a log of silence starts and ends; one that is still open ends with the file."""
    starts = F.transform(F.regexp_extract_all(log, F.lit(r"silence_start: (-?[0-9.]+)"), F.lit(1)), lambda x: F.greatest(F.lit(0.0), x.cast("double")))
    ends = F.transform(F.regexp_extract_all(log, F.lit(r"silence_end: ([0-9.]+)"), F.lit(1)), lambda x: x.cast("double"))
    return F.transform(starts, lambda s, k: F.struct(s.alias("start"), F.coalesce(F.get(ends, k), duration).alias("end")))


def speech_log(log: Column) -> Column:
    """``array<struct<start,end>>`` in seconds of ``start = x, end = y`` in hundredths."""
    pick = lambda k: F.transform(F.regexp_extract_all(log, F.lit(r"start = ([0-9.]+), end = ([0-9.]+)"), F.lit(k)), lambda x: x.cast("double") / 100)
    return F.arrays_zip(pick(1).alias("start"), pick(2).alias("end"))


def response_items(body: Column, item: str) -> Column:
    """``data`` of a connector's answer; none of a broken one."""
    return F.coalesce(F.from_json(body, f"struct<data:array<{item}>>")["data"], F.from_json(F.lit("[]"), f"array<{item}>"))


def wanted_keys(answers: DataFrame, id_field: str) -> DataFrame:
    """``(id, lang)`` of every missing subtitle that a connector's answers ask for."""
    items = answers.select(F.explode(response_items(F.col("body"), f"struct<{id_field}:bigint,missing_subtitles:array<struct<code2:string>>>")).alias("i"))
    return items.select(F.col(f"i.{id_field}").alias("id"), F.explode("i.missing_subtitles.code2").alias("lang")).where("id is not null and lang is not null").distinct()


def current_paths(answers: DataFrame) -> DataFrame:
    """``(episode_id, lang, path)``: the subtitle that a connector has now for an episode and language, the first of several in its answer."""
    items = answers.select(F.explode(response_items(F.col("body"), "struct<sonarrEpisodeId:bigint,subtitles:array<struct<code2:string,path:string>>>")).alias("i"))
    each = items.select(F.col("i.sonarrEpisodeId").alias("episode_id"), F.posexplode("i.subtitles").alias("k", "s")).where("s.code2 is not null and s.path is not null and s.path <> ''")
    return each.groupBy("episode_id", F.col("s.code2").alias("lang")).agg(F.min_by("s.path", "k").alias("path"))


def normal_segment(raw: Column) -> Column:
    """A transcriber's segment with times as numbers, trimmed text, and its confidence figures where they are numbers."""
    figure = lambda name: raw[name].try_cast("double").alias(name)
    return F.struct(raw["start"].cast("double").alias("start"), raw["end"].cast("double").alias("end"), F.trim(F.coalesce(raw["text"], F.lit(""))).alias("text"), *map(figure, ("no_speech_prob", "avg_logprob", "compression_ratio")))
