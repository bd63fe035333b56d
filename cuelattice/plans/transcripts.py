"""Queries that compare transcripts: sentences of ``conversations`` are the verified lines, models that mishear some words the transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import blocks, dense
from ..stored import once, stored
from .analogues import table

QUERIES: dict = {}

#: Share of words, of 256, that each model mishears.
MODELS = {"large": 4, "base": 20, "tiny": 60}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def verified(spark: SparkSession, d: str) -> DataFrame:
    """``(conv, k, start, end, text)``: sentences in order; each takes 60 ms a character, with half a second after it."""
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("conv"), "turn", F.posexplode(F.split("text", "[.!?\n]+")).alias("j", "part")).withColumn("text", F.trim("part")).where("text != ''")
    order = Window.partitionBy("conv").orderBy("turn", "j")
    length = (F.length("text") * 60).cast("long")
    before = F.coalesce(F.sum(length + 500).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return said.select("conv", F.row_number().over(order).cast("long").alias("k"), before.alias("start"), (before + length).alias("end"), "text")


def _mishears(model: Column, limit: Column) -> Column:
    """The words of ``text`` by number, without those that the model mishears."""
    words = F.split("text", " ")
    lost = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", model, "conv", "k", i.cast("string"))), 1, 2), 16, 10).cast("int") < limit
    return F.array_join(F.filter(words, lambda w, i: (w != "") & ~lost(i)), " ")


def heard(lines: DataFrame, models: dict[str, int] = MODELS) -> DataFrame:
    """``(model, conv, k, start, end, text)``: what each model makes of the lines; it runs slow by one part in 500 and 120 ms, and lines of which nothing is heard are missing."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(n).alias("limit")) for m, n in models.items()]))
    rows = lines.withColumn("_m", each).select("*", "_m.model", "_m.limit")
    late = lambda c: (F.col(c) + F.floor(F.col(c) / 500) + 120).cast("long")
    told = once(rows.select("model", "limit", "conv", "k", late("start").alias("start"), late("end").alias("end"), "text"), text=_mishears(F.col("model"), F.col("limit")))
    return told.where("text != ''").drop("limit")


_LINES = r"""s AS (SELECT conv_id AS conv, turn, generate_subscripts(p, 1) AS j, trim(unnest(p)) AS text FROM (SELECT conv_id, turn, string_split_regex(text, '[.!?\n]+') AS p FROM conversations)),
v AS (SELECT conv, row_number() OVER w AS k, CAST(coalesce(sum(length(text) * 60 + 500) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s0, length(text) * 60 AS len, text FROM s WHERE text <> '' WINDOW w AS (PARTITION BY conv ORDER BY turn, j)),
h0 AS (SELECT conv, k, s0, s0 + len AS e0, list_filter(string_split(text, ' '), lambda w, i: w <> '' AND CAST(concat('0x', substr(md5(concat_ws('|', 'base', conv, k, i - 1)), 1, 2)) AS INTEGER) >= 20) AS w FROM v),
h AS (SELECT conv, k, s0 + s0 // 500 + 120 AS s0, e0 + e0 // 500 + 120 AS e0, array_to_string(w, ' ') AS text FROM h0 WHERE len(w) > 0)"""
_NORM = "trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'))"


@query(f"""WITH RECURSIVE {_LINES}, a AS (SELECT conv AS f, row_number() OVER (PARTITION BY conv ORDER BY s0, s0 + len) - 1 AS i, s0, s0 + len AS e0, {_NORM} AS t FROM v),
b AS (SELECT conv AS f, row_number() OVER (PARTITION BY conv ORDER BY s0, e0) - 1 AS j, s0, e0, {_NORM} AS t FROM h),
p AS (SELECT a.f, i, j - i AS d, i - row_number() OVER (PARTITION BY a.f, j - i ORDER BY i) AS g FROM a JOIN b ON a.f = b.f AND a.t = b.t),
r AS (SELECT f, min(i) AS i, min(i) + d AS j, count(*) AS n FROM p GROUP BY f, d, g),
x AS (SELECT DISTINCT f, 0 AS a0, 1000000 AS a1, 0 AS b0, 1000000 AS b1, CAST(NULL AS STRUCT(l BIGINT, i BIGINT, j BIGINT)) AS m FROM r
  UNION ALL SELECT f, unnest([a0, m.i - m.l]), unnest([m.i, a1]), unnest([b0, m.j - m.l]), unnest([m.j, b1]), m FROM (SELECT x.f, a0, a1, b0, b1, min({{'l': -(least(n, a1 - i, b1 - j) - greatest(0, a0 - i, b0 - j)), 'i': i + greatest(0, a0 - i, b0 - j), 'j': j + greatest(0, a0 - i, b0 - j)}}) AS m
    FROM x JOIN r ON r.f = x.f AND least(n, a1 - i, b1 - j) > greatest(0, a0 - i, b0 - j) GROUP BY x.f, a0, a1, b0, b1)),
z AS (SELECT DISTINCT f, m FROM x WHERE m IS NOT NULL), c AS (SELECT f, m.i + unnest(range(-m.l)) AS i, m.j + unnest(range(-m.l)) AS j FROM z),
q AS (SELECT c.f, (b.s0 - a.s0) / 1000 AS s, (b.e0 - a.e0) / 1000 AS e FROM c JOIN a ON a.f = c.f AND a.i = c.i JOIN b ON b.f = c.f AND b.j = c.j),
k AS (SELECT f, count(*) AS n, median(s) AS sm, list_sort(list(abs(s))) AS s, list_sort(list(abs(e))) AS e FROM q GROUP BY f), na AS (SELECT f, count(*) AS n FROM a GROUP BY f), nb AS (SELECT f, count(*) AS n FROM b GROUP BY f)
SELECT coalesce(na.f, nb.f) AS file_id, coalesce(na.n, 0) AS lines_a, coalesce(nb.n, 0) AS lines_b, coalesce(k.n, 0) AS matched, round(100 * coalesce(k.n, 0) / greatest(coalesce(na.n, 0), coalesce(nb.n, 0)), 1) AS matched_pct, round(2 * coalesce(k.n, 0) / (coalesce(na.n, 0) + coalesce(nb.n, 0)), 3) AS similarity,
  round(sm, 3) AS start_median, round(s[1 + least(k.n - 1, CAST(floor(k.n * 0.5) AS BIGINT))], 3) AS start_p50, round(s[1 + least(k.n - 1, CAST(floor(k.n * 0.95) AS BIGINT))], 3) AS start_p95, round(s[k.n], 3) AS start_max, round(e[1 + least(k.n - 1, CAST(floor(k.n * 0.95) AS BIGINT))], 3) AS end_p95
FROM na FULL JOIN nb ON na.f = nb.f LEFT JOIN k ON k.f = coalesce(na.f, nb.f)""")
def transcript_drift(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation's verified lines against the ``base`` model's transcript, by whole lines of equal letters and digits."""
    lines = verified(spark, d)
    shaped = lambda t: t.select(F.col("conv").alias("file_id"), (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"), F.trim(text.sequence_text(F.col("text"))).alias("token"))
    return blocks.drift(shaped(lines), shaped(heard(lines, {"base": MODELS["base"]})))


def _words(rows: DataFrame, *keys: str) -> DataFrame:
    """The words of a conversation's lines in order."""
    said = F.regexp_extract_all(F.lower(text.speech_text(F.col("text"))), F.lit("[a-z0-9']+"), F.lit(0))
    ordered = F.array_sort(F.collect_list(F.struct("k", said.alias("w"))))
    return rows.groupBy(F.col("conv").alias("file_id"), *keys).agg(F.flatten(F.transform(ordered, lambda x: x["w"])).alias("words"))


@query(None)
def model_quality(spark: SparkSession, d: str) -> DataFrame:
    """Recall, precision and anchors of three models over all conversations; blocks of words over whole files are too many pairs for SQL, a test holds them against ``difflib``."""
    lines = stored(verified(spark, d))
    named = F.concat_ws("/", "model", F.col("conv").cast("string")).alias("file_id")
    told = stored(heard(lines)).select(named, "*")
    truth = lines.withColumn("model", F.explode(F.array(*map(F.lit, MODELS)))).select(named, "*")
    words = blocks.word_quality(_words(lines), _words(told, "model"), "model")
    shown = lambda t: t.select("file_id", F.col("k").alias("idx"), (F.col("start") / 1000).alias("t"), text.tokens(F.col("text")).alias("toks"))
    anchors = dense.dense_anchors(shown(told), shown(truth), 30, 30, 60)
    lengths = told.groupBy("file_id", "model").agg((F.max("end") / 1000).alias("duration"))
    return words.join(blocks.anchor_quality(anchors, lengths, "model"), "model")
