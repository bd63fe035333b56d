"""Archived copies as rows, and which to keep; moving files is left to whoever owns the storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import original_name


def archived(files: DataFrame, folder: str) -> DataFrame:
    """Copies below a folder, newest first, with the name and relative path they had."""
    inside = files.where(F.col("path").startswith(folder.rstrip("/") + "/"))
    relative = F.substr(F.col("path"), F.lit(len(folder.rstrip("/")) + 2))
    return inside.select("path", relative.alias("relative"), original_name(F.col("name")).alias("original"), "size", "mtime").orderBy(F.desc("mtime"), "path")


def outdated(files: DataFrame, keep: int) -> DataFrame:
    """Files beyond the ``keep`` last by name in each folder."""
    last = Window.partitionBy("dir").orderBy(F.desc("name"))
    return files.withColumn("_n", F.row_number().over(last)).where(F.col("_n") > keep).drop("_n")


def fresh_sibling(files: DataFrame, videos: DataFrame, language: str) -> DataFrame:
    """``videos(video_path, dir, stem, since)``: the newest subtitle of each that came after ``since`` in its folder, of the language or of none."""
    from ..functions.paths import language_of_file

    s = files.where(F.col("ending").isin(".srt", ".ass", ".ssa", ".vtt")).select("dir", "name", F.col("path").alias("subtitle_path"), "mtime")
    tag = language_of_file(F.col("name"))
    met = videos.join(s, "dir").where(F.col("name").startswith(F.concat(F.col("stem"), F.lit("."))) & (F.col("mtime") > F.col("since")) & F.coalesce(tag == language, F.lit(True)))
    newest = Window.partitionBy("video_path").orderBy(F.desc("mtime"), "subtitle_path")
    return met.withColumn("_r", F.row_number().over(newest)).where("_r = 1").select("video_path", "subtitle_path", "mtime")


def due(candidates: DataFrame, tried: DataFrame, min_score: float, attempts: int) -> DataFrame:
    """Replacement candidates still worth a try, best first: not tried yet, at the least score (none asked for if 0), up to the attempts left."""
    left = candidates.join(tried.select("video_path", "subs_id"), ["video_path", "subs_id"], "left_anti")
    used = tried.groupBy("video_path").agg(F.count("*").alias("used"))
    good = left if min_score <= 0 else left.where(F.coalesce("score", F.lit(0)) >= min_score)
    order = Window.partitionBy("video_path").orderBy(F.desc(F.coalesce("score", F.lit(0))), "subs_id")
    ranked = good.join(used, "video_path", "left").withColumn("turn", F.row_number().over(order) + F.coalesce("used", F.lit(0)))
    return ranked.where(F.col("turn") <= attempts).drop("used")
