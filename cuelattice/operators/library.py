"""Reports on the library: filters, pages, grouped views, time buckets, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import ATTENTION_FLAGS, SYNC_KINDS


def file_filter(q: str | None = None, flag: str | None = None, status: str | None = None, lang: str | None = None, reason: str | None = None, sync_kind: str | None = None, title: str | None = None, run_id: int | None = None) -> Column:
    """A conjunction of the filters that are set; ``%`` and ``_`` in ``q`` stay wildcards; reason ``other`` stands for none."""
    out = F.lit(True)
    if q:
        out &= F.greatest(*[F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False)) for c in ("video_path", "subtitle_path", "title")])
    if flag == "attention":
        out &= F.col("correctness_flag").isin(*ATTENTION_FLAGS)
    elif flag:
        out &= F.col("correctness_flag") == flag
    if status:
        out &= F.col("sync_status") == status
    if lang:
        out &= F.col("lang") == lang
    if reason:
        out &= F.col("reason").isNull() if reason == "other" else F.col("reason") == reason
    if sync_kind:
        out &= F.expr(SYNC_KINDS[sync_kind])
    if title:
        out &= F.collate(F.col("title"), "UTF8_LCASE") == title
    if run_id is not None:
        out &= F.col("run_id") == run_id
    return out


def page(rows: DataFrame, sort: str, tie: str, allowed: tuple[str, ...], number: int, size: int) -> DataFrame:
    """One page, ``-`` before the column for descending order, nulls last either way, ties by ``tie``."""
    name = sort.removeprefix("-")
    if name not in allowed:
        raise ValueError(f"cannot sort by {name}")
    key = F.col(name).desc_nulls_last() if sort.startswith("-") else F.col(name).asc_nulls_last()
    return rows.orderBy(key, F.col(tie)).offset((number - 1) * size).limit(size)


def after(rows: DataFrame, key: str, last: int, size: int) -> DataFrame:
    """The ``size`` rows that follow key ``last``."""
    return rows.where(F.col(key) > last).orderBy(key).limit(size)


def last_rows(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The last ``size`` rows in ascending order."""
    return rows.orderBy(F.desc(key)).limit(size).orderBy(key)


def newest(rows: DataFrame, keys: list[str], when: str, arrival: str, n: int = 1) -> DataFrame:
    """The ``n`` newest rows of each key; of equal times the one that arrived first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(when), arrival)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def health(files: DataFrame) -> DataFrame:
    """One pass over files to counts by state, with the health percentage: in sync, fixed and generated among those checked."""
    status, flag = F.coalesce("sync_status", F.lit("")), F.coalesce("correctness_flag", F.lit(""))
    fixed = status.startswith("fixed") | status.startswith("would fix")
    n = lambda c: F.count_if(c)
    counts = files.agg(
        F.count("*").alias("total"), n(status == "missing").alias("missing"), n((status != "missing") & (flag == "skipped")).alias("skipped"),
        n((status != "missing") & (flag == "generated")).alias("generated"), n((status != "missing") & (flag == "ok") & fixed).alias("fixed"),
        n((status != "missing") & (flag == "ok") & ~fixed).alias("insync"), n((status != "missing") & flag.isin(*ATTENTION_FLAGS)).alias("attention"),
        F.countDistinct(F.when(status != "missing", F.col("video_path"))).alias("videos"), F.avg("avg_score").alias("avg_score"),
    )
    checked = F.col("total") - F.col("missing") - F.col("skipped")
    good = F.col("insync") + F.col("fixed") + F.col("generated")
    return counts.withColumn("other", checked - good - F.col("attention")).withColumn("pct", F.when(checked > 0, F.floor(1000 * good / checked + 0.5) / 10))


def score_bucket(score: Column, edges: tuple[float, ...]) -> Column:
    """``<e0``, ``e0-e1`` ..., ``>=en``; ``none`` without a score."""
    out = F.lit(f">={edges[-1]}")
    for lo, hi in reversed(list(zip(edges, edges[1:], strict=False))):
        out = F.when(score < hi, F.lit(f"{lo}-{hi}")).otherwise(out)
    return F.when(score.isNull(), F.lit("none")).otherwise(F.when(score < edges[0], F.lit(f"<{edges[0]}")).otherwise(out))


def week_label(when: Column) -> Column:
    """``YYYY-Www`` with weeks that start on Monday and days before the first Monday in week 0."""
    week = F.floor((F.dayofyear(when) + 6 - F.weekday(when)) / 7)
    return F.concat(F.year(when).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def match_rate(checks: DataFrame, when: str, ok: Column, suspect: Column, score: str, by: str = "day") -> DataFrame:
    """Checks, passes, suspects and mean score by day or week."""
    bucket = F.date_format(when, "yyyy-MM-dd") if by == "day" else week_label(F.col(when))
    return checks.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(suspect).alias("suspect"), F.avg(score).alias("avg_score"))


def vote(samples: DataFrame, key: str, score: str, threshold: float) -> DataFrame:
    """Mean score and a majority: half of the valid samples or more at the threshold make a file ok; none valid, unknown."""
    counts = samples.groupBy(key).agg(F.avg(score).alias("avg_score"), F.count_if(F.col(score) >= threshold).alias("good"), F.count(score).alias("valid"))
    return counts.withColumn("flag", F.when(F.col("valid") == 0, "unknown").when(2 * F.col("good") >= F.col("valid"), "ok").otherwise("SUSPECT"))


def first_of(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union by precedence: for each key the row of the earliest source that has one."""
    every = None
    for k, s in enumerate(sources):
        s = s.withColumn("_priority", F.lit(k))
        every = s if every is None else every.unionByName(s)
    w = Window.partitionBy(*keys).orderBy("_priority")
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_priority")


def best_matches(pairs: DataFrame, key: str, rank: Column) -> DataFrame:
    """Candidate pairs of each key that share its best rank."""
    return pairs.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(Window.partitionBy(key))).where("_rank = _best").drop("_rank", "_best")


def missing(wanted: DataFrame, *have: DataFrame) -> DataFrame:
    """Rows of ``wanted`` that no other frame has, by all columns."""
    for h in have:
        wanted = wanted.join(h, wanted.columns, "left_anti")
    return wanted


def agreement(members: DataFrame, sets: int) -> DataFrame:
    """``members(item, set)``: how many items all sets share, all items, and items of one set alone."""
    each = members.distinct().groupBy("item").agg(F.count("*").alias("n"))
    return each.agg(F.count_if(F.col("n") == sets).alias("common"), F.count("*").alias("union"), F.count_if(F.col("n") == 1).alias("alone")).withColumn("jaccard", F.when(F.col("union") > 0, F.col("common") / F.col("union")))


def resumed(rows: DataFrame, keys: list[str], order: str, status: str, done: tuple[str, ...] = ("ok", "error")) -> DataFrame:
    """One row a key: the last one that was completed, by ``order``, else the first; a null status counts as completed. Keys may be null."""
    complete = F.coalesce(F.col(status).isin(*done), F.lit(True))
    rank = F.struct(complete.alias("c"), F.when(complete, F.col(order)).otherwise(-F.col(order)).alias("o"))
    best = rows.groupBy(*[F.col(k) for k in keys]).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), rank).alias("_b"))
    return best.select(*keys, "_b.*").select(*rows.columns)


def touched(injected: Column, fixed: Column) -> Column:
    """How many of the injected indexes were fixed, their share, and the fixed ones that were not injected, in order."""
    injected, fixed = F.array_distinct(injected), F.array_distinct(fixed)
    hit, extra = F.size(F.array_intersect(injected, fixed)), F.array_sort(F.array_except(fixed, injected))
    return F.struct(F.size(injected).alias("injected"), hit.alias("hit"), F.when(F.size(injected) > 0, F.round(hit / F.size(injected), 3)).alias("share"), extra.alias("extra"))


def episode_order(code: Column, path: Column) -> Column:
    """Sorts episodes by their number; files without one come last, by name."""
    number = F.regexp_extract(F.coalesce(code, F.lit("")), r"(?i)E(\d+)", 1)
    named = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    return F.struct((number == "").cast("int").alias("extra"), F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(0)).alias("n"), F.when(number == "", named).otherwise("").alias("name"))
