"""The library's own files and a connector's view of them: path mapping learned from shared endings, rows merged column by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

#: Parts of a path, file name included, that must agree before two paths are taken for one file.
LEAST_PARTS = 3


def _tails(files: DataFrame, least: int) -> DataFrame:
    """``(path, n, tail)``: every ending of ``least`` parts or more that only one path has."""
    parts = F.split("path", "/")
    ends = files.select("path").distinct().select("path", parts.alias("p")).where(F.size("p") >= least).select("path", "p", F.explode(F.sequence(F.lit(least), F.size("p"))).alias("n"))
    keyed = ends.select("path", "n", F.array_join(F.slice("p", F.size("p") - F.col("n") + 1, F.col("n")), "/").alias("tail"))
    return keyed.groupBy("n", "tail").agg(F.count("*").alias("c"), F.min("path").alias("path")).where("c = 1").drop("c")


def same_files(ours: DataFrame, theirs: DataFrame, least: int = LEAST_PARTS) -> DataFrame:
    """``(theirs, ours)``: paths of both sides by the longest ending that is unique on either side. An ending that several files share decides nothing, so no pairs meet under it."""
    met = _tails(theirs, least).withColumnRenamed("path", "theirs").join(_tails(ours, least).withColumnRenamed("path", "ours"), ["n", "tail"])
    return met.groupBy("theirs").agg(F.max_by("ours", F.col("n")).alias("ours"))


def learned_pairs(matches: DataFrame) -> DataFrame:
    """``(theirs, ours, votes)``: the prefixes that are left of matched paths before their common ending, by how many files say so.

    Where nothing would be left of theirs, both keep the first folder they share; paths that are the same say nothing.
    """
    pair = paths.suggested_pair(F.col("ours"), F.col("theirs"))
    folder = F.concat(F.lit("/"), F.get(F.split("theirs", "/"), F.lit(1)))
    kept = F.when(F.col("p.theirs") == "", F.struct(folder.alias("theirs"), F.concat("p.ours", folder).alias("ours"))).otherwise(F.col("p"))
    return matches.where("ours <> theirs").select("theirs", pair.alias("p")).select(kept.alias("p")).groupBy(F.col("p.theirs").alias("theirs"), F.col("p.ours").alias("ours")).agg(F.count("*").alias("votes"))


def resolved(ours: DataFrame, theirs: DataFrame, pairs: DataFrame, matches: DataFrame, configured: Column | None = None) -> DataFrame:
    """``(theirs, ours, how)``: ``exact`` where the path, rewritten by the ``configured`` pairs, is one of ours; ``learned`` where a learned prefix leads to one, the pair with most votes first;
    ``ending`` where only the ending agrees; else null and ``unmatched``. Prefixes are whole parts, joined by equality of each leading part of a path."""
    own, every = ours.select(F.col("path").alias("ours")).distinct(), theirs.select(F.col("path").alias("theirs")).distinct()
    as_set = every.withColumn("ours", paths.mapped_path(F.col("theirs"), configured, back=True) if configured is not None else F.col("theirs"))
    exact = as_set.join(own, "ours", "left_semi").select("theirs", "ours", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("votes"), F.lit("exact").alias("how"))
    parts = F.split("theirs", "/")
    heads = every.select("theirs", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("head"))
    led = heads.join(pairs.select(F.col("theirs").alias("head"), F.col("ours").alias("to"), "votes"), "head").withColumn("ours", F.concat("to", F.substr(F.col("theirs"), F.length("head") + 1)))
    learned = led.join(own, "ours", "left_semi").select("theirs", "ours", F.lit(1).alias("rank"), "votes", F.lit("learned").alias("how"))
    ending = matches.select("theirs", "ours", F.lit(2).alias("rank"), F.lit(0).cast("long").alias("votes"), F.lit("ending").alias("how"))
    best = exact.unionByName(learned).unionByName(ending).groupBy("theirs").agg(F.min_by(F.struct("ours", "how"), F.struct("rank", -F.col("votes"), "ours")).alias("b"))
    return every.join(best, "theirs", "left").select("theirs", F.col("b.ours").alias("ours"), F.coalesce("b.how", F.lit("unmatched")).alias("how"))


def merged(sources: dict[str, DataFrame], key: str, columns: list[str]) -> DataFrame:
    """One row a key: each column's first value that is not null, in the order of ``sources``, with the source's name in ``<column>_from``.

    Sources need not have every column, nor every key; of a source's several rows of a key the least value counts. One aggregation, whatever the number of sources.
    """
    every: DataFrame | None = None
    kinds = {c: next(d.schema[c].dataType for d in sources.values() if c in d.columns) for c in columns}
    for k, (name, d) in enumerate(sources.items()):
        own = d.select(key, F.lit(k).alias("_rank"), F.lit(name).alias("_from"), *[(F.col(c) if c in d.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns])
        every = own if every is None else every.unionByName(own)
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct("_rank", F.col(c).alias("v"), "_from"))).alias(c) for c in columns]
    told = every.groupBy(key).agg(*first)
    return told.select(key, *[x for c in columns for x in (F.col(f"{c}.v").alias(c), F.col(f"{c}._from").alias(f"{c}_from"))])


def video_rows(scanned: DataFrame, connector: DataFrame, probes: DataFrame, before: DataFrame) -> DataFrame:
    """The library's video dimension with where each value comes from.

    ``scanned(video_path, title, season_episode, has_external, mtime, size)`` says which videos there are; a connector's title, number and ids come before the guesses; ids that it no
    longer tells are carried from ``before``. ``langs`` of embedded subtitles are the connector's, else those of ``before`` if time and size have not changed, else those of ``probes``, and only
    looked for where there is no subtitle outside; null means not looked for.
    """
    there = scanned.select("video_path")
    fresh = before.join(scanned.select("video_path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), "has_external"), "video_path").where("not has_external and mtime = _m and size = _s").select("video_path", "langs")
    asked = probes.join(scanned.where("not has_external").select("video_path"), "video_path", "left_semi").select("video_path", "langs")
    carried = before.select("video_path", "series_id", "episode_id").join(fresh, "video_path", "left")
    sources = {"connector": connector.join(there, "video_path", "left_semi"), "before": carried.join(there, "video_path", "left_semi"), "probe": asked, "guess": scanned.select("video_path", "title", "season_episode")}
    rows = merged(sources, "video_path", ["title", "season_episode", "series_id", "episode_id", "langs"])
    told = scanned.select("video_path", "has_external", "mtime", "size").join(rows, "video_path", "left")
    parent = F.regexp_replace("video_path", "/[^/]*$", "")
    return told.withColumn("title", F.coalesce(F.when(F.col("title") != "", F.col("title")), parent)).withColumn("has_subtitle", F.col("has_external") | F.coalesce(F.size("langs") > 0, F.lit(False))).withColumn("matched", F.coalesce(F.col("title_from") == "connector", F.lit(False)))


def spaced_blocks(files: DataFrame, least: int, most: int, lo: int, hi: int, gap: int, seed: int) -> DataFrame:
    """``(file_id, block, start, end, shift)``: for each ``files(file_id, duration)`` two to three blocks and the like, ``least`` to ``most`` of them, that keep ``gap`` apart.

    Lengths are drawn from ``lo..hi`` and shifts from 2 to 20 seconds either way, all by hashes of the file and the draw, so rows may be dealt as they like. Room that lengths and gaps leave is cut
    at sorted draws, which spaces the blocks without trying again; where a file has no room for as many, it has fewer, and none if it has room for none.
    """
    draw = lambda salt, *keys: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "file_id", *keys), F.lit(1 << 30)) / float(1 << 30)
    wanted = files.where("duration > 0").withColumn("n", (least + F.floor(draw(1) * (most - least + 1))).cast("int"))
    each = wanted.select("file_id", "duration", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    each = each.withColumn("length", (lo + F.floor(draw(2, "block") * (hi - lo + 1))).cast("long")).withColumn("u", draw(3, "block")).withColumn("shift", ((2_000 + F.floor(draw(4, "block") * 18_001)) * F.when(draw(5, "block") < 0.5, -1).otherwise(1)).cast("long"))
    w = Window.partitionBy("file_id").orderBy("block")
    fitting = each.withColumn("used", F.sum(F.col("length") + gap).over(w.rowsBetween(Window.unboundedPreceding, 0)) - gap).where("used <= duration")
    whole = Window.partitionBy("file_id")
    room = fitting.withColumn("room", F.first("duration").over(whole) - F.max("used").over(whole))
    cuts = Window.partitionBy("file_id").orderBy("u", "block")
    placed = room.withColumn("at", F.row_number().over(cuts))
    spare = F.floor(F.col("room") * F.col("u")).cast("long")
    before = F.coalesce(F.sum(F.col("length") + gap).over(cuts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.select("file_id", (F.col("at") - 1).alias("block"), (spare + before).cast("long").alias("start"), (spare + before + F.col("length")).cast("long").alias("end"), "shift")


def drawn_rate(files: DataFrame, lo: float, hi: float, most_offset: int, seed: int) -> DataFrame:
    """``(file_id, rate, offset)``: a rate drawn evenly by its logarithm from ``lo..hi``, either sign, and an offset up to ``most_offset`` either way, by hashes of the file."""
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "file_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.exp(F.log(F.lit(lo)) + draw(6) * (F.log(F.lit(hi)) - F.log(F.lit(lo)))) * F.when(draw(7) < 0.5, -1).otherwise(1)
    return files.select("file_id", rate.alias("rate"), F.floor((draw(8) * 2 - 1) * most_offset).cast("long").alias("offset"))


def shifted_blocks(cues: DataFrame, blocks: DataFrame, least: int = 200) -> DataFrame:
    """Cues that start in a block moved by its shift, not before 0 and no shorter than ``least``; blocks of a file do not overlap."""
    met = cues.join(blocks.select(F.col("file_id").alias("_f"), F.col("start").alias("_lo"), F.col("end").alias("_hi"), "shift"), (F.col("file_id") == F.col("_f")) & (F.col("start") >= F.col("_lo")) & (F.col("start") < F.col("_hi")), "left")
    start = F.greatest(F.lit(0).cast("long"), F.col("start") + F.coalesce("shift", F.lit(0)))
    moved = F.col("shift").isNotNull()
    return met.withColumn("_s", start).withColumn("end", F.when(moved, F.greatest(F.col("_s") + least, F.col("end") + F.col("shift"))).otherwise(F.col("end"))).withColumn("start", F.col("_s")).select(*cues.columns)
