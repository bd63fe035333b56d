"""Quality rules: word and line statistics of whole texts, and robust multivariate outliers, in DataFrame functions alone.

For each language and source the minimum covariance determinant is sought by concentration steps from several deterministic starts (after
DetMCD, Hubert et al. 2012): medians with deviations, and with the correlations of hyperbolic tangents and of spatial signs. A step keeps
the closest ``share`` of rows and takes mean and covariance from it. Each start makes two steps, the one of least determinant goes on until
the determinant stands, and a last estimate is taken from all rows within the 0.975 quantile of chi-squared. A row is rejected when its
squared Mahalanobis distance has a chi-squared chance under ``tail``. Groups with too few rows are pooled by language, then altogether.
Statistics are scaled to whole numbers, so that sums are exact, distances are told in bounded levels, and the verdict does not depend on
how rows are dealt out; one aggregation by level gives a step its quantile and its sums.

Defined cases: a null or blank text has no words and fails the base rule; null languages and sources are groups of their
own; without enough rows for any estimate the base rule decides alone; repeated rows and ties keep a row each; an empty
table gives an empty result; columns besides id, text, language and source are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a group's rows that the covariance is taken from; steps at most, should a determinant not stand; change of its logarithm that counts as none.
SHARE, STEPS, SETTLED = 0.75, 30, 0.01
#: Least rows for an estimate of its own.
MIN_ROWS = 60
#: Chance under chi-squared below which a row is an outlier: one row in a thousand million.
TAIL = 1e-9
#: Median and 0.975 quantile of chi-squared with five degrees of freedom.
_CHI2_MEDIAN, _CHI2_NEAR = 4.351, 12.833
_SCALE = 1000
#: Added to variances (in scaled units): less than a fifth of a unit is no deviation, and a statistic that is the same for all rows does not
#: make the matrix singular.
_RIDGE = 200.0**2
_P = 5
_SALTS = 64
_LEVELS = 100
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]


def chi_squared_limit(tail: float) -> float:
    """Where chi-squared with five degrees of freedom leaves ``tail`` above."""
    above = lambda x: math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > tail else (low, mid)
    return high


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            found = F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
            return _let(F.sort_array(found), lambda p: F.aggregate(F.transform(p, lambda a, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - a, F.lit(3)))), F.lit(0), lambda t, x: t + x))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(placed, twice))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(windows, covered))


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in ``keep`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` (long).

    Three-word windows are compared by 64-bit hashes within one text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, r"[ \t-\r]"), "")
    lines = F.filter(F.split(text, F.lit("\n")), lambda x: x.rlike(r"[^ \t-\r]"))
    by_word = _let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeat_words(w).alias("repeat")))
    by_line = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    read = docs.select(*keep, by_word.alias("_w"), by_line.alias("_l"), F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).alias("_s"))
    names = {"n_words": "_w.n", "word_chars": "_w.chars", "n_symbols": "_s", "n_dup_lines": "_l.dup", "n_repeat_words": "_w.repeat", "n_lines": "_l.n"}
    return read.select(*keep, *[F.col(v).cast("long").alias(k) for k, v in names.items()])


def _with_group(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join each row to its group's one row; groups are repeated for each salt, so that a large group's rows stay spread out."""
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("id", "x0", "x1"), F.lit(_SALTS)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")


def _features() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    raw = [
        F.log1p(F.col("n_words").cast("double")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words) * 4,
        F.log1p(100 * F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / lines) * 2,
        F.sqrt(F.col("n_repeat_words") / words) * 2,
    ]
    return {f"x{i}": F.round(x * _SCALE).cast("long") for i, x in enumerate(raw)}


def _pooled(rows: DataFrame, min_rows: int) -> DataFrame:
    """``rows`` with ``grp``: language and source, or a pool of small groups; null if even that is small."""
    named = rows.withColumn("_one", F.to_json(F.struct("lang", "source"))).withColumn("_rest", F.to_json(F.struct("lang")))
    sizes = named.where("fit").groupBy("_one", "_rest").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < min_rows)
    rest = small.groupBy("_rest").agg(F.sum("n").alias("m"))
    total = small.join(rest, "_rest").where(F.col("m") < min_rows).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    everything = F.lit("all") if total >= min_rows else F.lit(None).cast("string")
    own, pool = F.concat(F.lit("own "), "_one"), F.concat(F.lit("rest "), "_rest")
    picked = sizes.join(rest, "_rest", "left").select("_one", F.when(F.col("n") >= min_rows, own).when(F.col("m") >= min_rows, pool).otherwise(everything).alias("grp"))
    return _with_group(named, picked, "_one", "left").drop("_one", "_rest")


def _factor(shapes: DataFrame) -> DataFrame:
    """``(grp, start, m.., c..)`` to mean, lower triangle ``l00..`` of the covariance's Cholesky factor, and ``logdet``."""
    out = shapes
    for i, j in _PAIRS:
        rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = 2 * sum((F.log(f"l{i}{i}") for i in range(_P)), F.lit(0.0))
    return out.select("grp", "start", *[f"m{i}" for i in range(_P)], *[f"l{i}{j}" for i, j in _PAIRS], logdet.alias("logdet"))


def _from_sums(sums: DataFrame) -> DataFrame:
    """Mean and covariance of ``(grp, start, n, s.., s..)``."""
    n = F.col("n").cast("double")
    mean = [(F.col(f"s{i}").cast("double") / n).alias(f"m{i}") for i in range(_P)]
    spread = [(F.col(f"s{i}{j}").cast("double") / n - (F.col(f"s{i}").cast("double") / n) * (F.col(f"s{j}").cast("double") / n) + (_RIDGE if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    return _factor(sums.select("grp", "start", *mean, *spread))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution, from columns ``x, m, l``; computed once, as an array fold would be."""
    done: list[Column] = []

    def step(i: int) -> Column:
        if i == _P:
            return sum((z * z for z in done), F.lit(0.0))
        z = (F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * done[k] for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}")

        def inner(v: Column) -> Column:
            done.append(v)
            return step(i + 1)

        return _let(z, inner)

    return step(0)


def _level(d2: Column) -> Column:
    """Distances in steps of a hundredth of their logarithm: few enough values to aggregate by."""
    return F.floor(_LEVELS * F.log1p(d2)).cast("long")


def _cells(rows: DataFrame, now: DataFrame) -> DataFrame:
    """Rows and sums by group, start and level of distance, with ``upto``, the rows up to and with the level, and ``total``."""
    placed = _with_group(rows, now, "grp").select("grp", "start", *[f"x{i}" for i in range(_P)], _level(_distance()).alias("level"))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(_P)] + [F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(20,0)")).alias(f"s{i}{j}") for i, j in _PAIRS]
    every = Window.partitionBy("grp", "start")
    cells = placed.groupBy("grp", "start", "level").agg(F.count("*").alias("n"), *sums)
    return cells.withColumn("upto", F.sum("n").over(every.orderBy("level"))).withColumn("total", F.sum("n").over(every))


def _summed(cells: DataFrame) -> DataFrame:
    return cells.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in ("n", *(f"s{i}" for i in range(_P)), *(f"s{i}{j}" for i, j in _PAIRS))])


def _scale(cells: DataFrame) -> DataFrame:
    """``(grp, start, scale)``: the median distance over chi-squared's. Never below one: where statistics are tied, the median says nothing."""
    middle = cells.where(2 * F.col("upto") >= F.col("total")).groupBy("grp", "start").agg(F.min("level").alias("level"))
    return middle.select("grp", "start", F.greatest(F.expm1(F.col("level") / _LEVELS) / _CHI2_MEDIAN, F.lit(1.0)).alias("scale"))


def _starts(rows: DataFrame) -> DataFrame:
    """Three first estimates for each group: medians, with deviations alone and with two robust correlations."""
    middle = rows.groupBy("grp").agg(*[F.percentile(f"x{i}", F.lit(0.5)).alias(f"m{i}") for i in range(_P)])
    spread = _with_group(rows, middle, "grp").groupBy("grp").agg(*[F.percentile(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), F.lit(0.5)).alias(f"d{i}") for i in range(_P)])
    scales = [F.greatest(1.4826 * F.col(f"d{i}"), F.lit(_RIDGE**0.5)).alias(f"d{i}") for i in range(_P)]
    base = durable(middle.join(spread, "grp").select("grp", *[f"m{i}" for i in range(_P)], *scales))
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"d{i}") for i in range(_P)]
    length = F.sqrt(F.greatest(sum((v * v for v in z), F.lit(0.0)), F.lit(1e-6)))
    made = _with_group(rows, base, "grp").select("grp", *[F.round(_SCALE * F.tanh(v)).cast("long").alias(f"t{i}") for i, v in enumerate(z)], *[F.round(_SCALE * v / length).cast("long").alias(f"u{i}") for i, v in enumerate(z)])
    products = made.groupBy("grp").agg(*[F.sum(F.col(f"{k}{i}") * F.col(f"{k}{j}")).cast("double").alias(f"{k}{i}{j}") for k in "tu" for i, j in _PAIRS])
    both = base.join(products, "grp")

    def shape(start: int, k: str | None) -> DataFrame:
        def entry(i: int, j: int) -> Column:
            if i == j:
                return F.col(f"d{i}") * F.col(f"d{i}")
            if k is None:
                return F.lit(0.0)
            return F.col(f"d{i}") * F.col(f"d{j}") * F.col(f"{k}{i}{j}") / F.sqrt(F.greatest(F.col(f"{k}{i}{i}"), F.lit(1.0)) * F.greatest(F.col(f"{k}{j}{j}"), F.lit(1.0)))

        return both.select("grp", F.lit(start).alias("start"), *[f"m{i}" for i in range(_P)], *[entry(i, j).alias(f"c{i}{j}") for i, j in _PAIRS])

    return _factor(shape(0, None).unionByName(shape(1, "t")).unionByName(shape(2, "u")))


def estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS, settled: float = SETTLED) -> DataFrame:
    """``rows(id, grp, x0..)`` to each group's mean, Cholesky factor and ``scale``, which makes the median distance consistent."""
    rows = rows.where("grp is not null")
    step = lambda now: durable(_from_sums(_summed(_cells(rows, now).where(F.col("upto") - F.col("n") < F.ceil(share * F.col("total"))))))
    now = step(step(durable(_starts(rows))))
    best = Window.partitionBy("grp").orderBy("logdet", "start")
    now = durable(now.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r"))
    for _ in range(steps):
        after = step(now)
        change = after.join(now.select("grp", F.col("logdet").alias("before")), "grp").agg(F.max(F.abs(F.col("before") - F.col("logdet")))).first()[0]
        now = after
        if change is None or change < settled:
            break
    cells = durable(_cells(rows, now))
    near = cells.join(_scale(cells), ["grp", "start"]).where(F.expm1(F.col("level") / _LEVELS) <= _CHI2_NEAR * F.col("scale"))
    last = durable(_from_sums(_summed(near)))
    return durable(last.join(_scale(_cells(rows, last)), ["grp", "start"]).drop("start", "logdet"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL, share: float = SHARE, steps: int = STEPS, min_rows: int = MIN_ROWS, settled: float = SETTLED) -> DataFrame:
    """``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept)`` for each row."""
    read = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    counted = durable(statistics(read, "text", ("id", "lang", "source")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = durable(_pooled(counted.withColumns(_features()).withColumn("base_failed", failed).withColumn("fit", ~F.col("base_failed")), min_rows))
    fitted = estimates(rows.where("fit").select("id", "grp", *[f"x{i}" for i in range(_P)]), share, steps, settled)
    judged = _with_group(rows, fitted, "grp", "left").withColumn("distance", F.when(F.col("scale").isNotNull() & ~F.col("base_failed"), _distance() / F.col("scale")))
    near = F.coalesce(F.col("distance") <= chi_squared_limit(tail), F.lit(True))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (~F.col("base_failed") & near).alias("kept"))
