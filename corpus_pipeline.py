"""From raw documents to packed training sequences: language, near-duplicates, repeated passages, benchmark leaks, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm import decontaminate, langid, packing, simhash, suffix
from cuelattice.llm.common import durable
from cuelattice.llm.registry import tokenizer_file

#: A document whose nearest language is farther than this score is in none of the languages learned.
MIN_LANGUAGE_SCORE = 0.25


def _held(docs: DataFrame, *without: str) -> DataFrame:
    """``doc_id``, ``text`` and ``lang`` with the other columns of the row in one struct, so that no column that an operator adds meets one of theirs."""
    fields = [F.col(f"`{c}`").alias(f"f{k}") for k, c in enumerate(docs.columns) if c not in without]
    return docs.select("doc_id", "text", "lang", F.struct(*fields).alias("whole"))


def _released(held: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again; ``changed`` ones have a value of their own."""
    return held.select(*[changed.get(c, F.col(f"whole.f{k}")).alias(c) for k, c in enumerate(docs.columns)])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike every learned language, go."""
    profiles = langid.train(docs, F.lit(True))
    named = langid.identify(_held(docs), profiles, carry=["whole"])
    return _released(named.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays, one of them if it is repeated.

    Near-duplicates have a Jaccard similarity of 0.8 or more over five-word shingles; fingerprints in BK-trees propose them, shingle sets decide.
    Only where ids are missing or repeated are rows numbered, which takes a written copy of them.
    """
    seen = docs.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    if seen["rows"] == seen["ids"]:
        groups = simhash.near_duplicate_texts(docs.select("doc_id", "text"))
        return docs.join(groups.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(*[f"`{c}`" for c in docs.columns])
    rows = durable(_held(docs).withColumn("_row", F.monotonically_increasing_id()))
    groups = simhash.near_duplicate_texts(rows.select("_row", "text"), "_row", "text")
    ranked = groups.join(rows.select("_row", "doc_id"), "_row")
    first = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("one"))
    return _released(rows.join(first.select("one._row"), "_row", "left_semi"), docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of more than 50 words that repeat are cut from texts; a document of which nothing is left goes. ``n_chars``, where there is one, follows the text."""
    marked = _held(docs, "text").withColumn("whole", F.col("whole").withField("no_text", F.col("text").isNull()))
    cut = suffix.remove_repeated_words(marked, carry=["whole"])
    left = cut.where(~F.col("touched") | F.col("kept").cast("string").rlike(r"\S"))
    changed = {"text": F.when(~F.col("whole.no_text"), F.col("kept").cast("string"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("touched"), F.length(F.col("kept").cast("string")).cast(kind)).otherwise(F.col(f"whole.f{docs.columns.index('n_chars')}"))
    return _released(left, docs, **changed)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(_held(docs), items, carry=["whole"])
    return _released(found.where(F.size("item_ids") == 0), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, each with its ids (little-endian unsigned 32-bit) and its place in a training sequence."""
    return packing.pack(docs, tokenizer_file(), payload="ids")


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", repeated_passage_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Language profiles, bit distances under chains of links, and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
