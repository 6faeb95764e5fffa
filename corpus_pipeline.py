"""A corpus pipeline: toxic documents go, repeated passages go, near copies go, sources are mixed, texts are encoded.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet and reads it as the next
stage's documents. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crewline.llm import linewindows, mixing, sentencepiece_lattice, toxicity, trie_join
from crewline.llm.common import materialize, read_table

NEAR = trie_join.Join(words=5, percent=80)


def _columns(frame: DataFrame, like: DataFrame) -> DataFrame:
    return frame.select(*[F.col(f"`{c}`") for c in like.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text does not score above 0.5, which is what a text without evidence gets. Empty texts, null ids and repeated rows are judged like all others."""
    p = toxicity.Ftrl()
    sample = toxicity.labelled_sample(docs, read_table(spark, sf_dir, "labels"), F.col("toxic"), p.max_rows)
    named = docs.withColumnRenamed("score", "__score") if "score" in docs.columns else docs
    judged = toxicity.score(named, toxicity.train(sample, p), p).where("score <= 0.5").drop("score")
    return _columns(judged.withColumnRenamed("__score", "score"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; one that had text and has none left goes."""
    freed = linewindows.line_dedup(docs)
    left = freed.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", "\\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _columns(left, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word n-grams at 0.8 one row with the smallest id; documents without words or id stay.

    Rows are numbered in order of their ids and judged by number, so rows that share an id are judged each by its own text.
    """
    numbered = materialize(docs.orderBy("doc_id", F.xxhash64("text")).withColumn("__row", F.monotonically_increasing_id()))
    rows = numbered.where("doc_id IS NOT NULL").select(F.col("__row").alias("doc_id"), "text")
    groups = trie_join.ngram_groups(rows, NEAR)
    later = materialize(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__row")).distinct())
    kept = numbered.join(later, "__row", "left_anti")
    return _columns(kept, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their rates, at the size at which no language or quality has to shrink."""
    labelled = mixing.language_and_quality(docs, read_table(spark, sf_dir, "labels"))
    rated = mixing.mixed(docs, labelled, mixing.TARGETS, cover=True)
    # At that size rates are about 1 or more; a document is never dropped by rounding.
    return _columns(rated.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("copies"))))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, ids, round_trip``: the pieces of each document."""
    pieces = sentencepiece_lattice.Pieces(sentencepiece_lattice.model_path())
    coded = sentencepiece_lattice.encode(docs, pieces)
    return coded.select("doc_id", F.size("ids").alias("n_pieces"), "ids", F.col("exact").alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

# Learned weights, n-gram groups and rates cannot be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
