"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, tokenisation.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as Parquet and
read again as the next stage's input.  All stages but the last return the columns of ``documents``, whatever their
names.  Rows without an id or a text pass like all others: a null text has the score of an empty one, no lines, no
shingles and no words, so no stage but the classifier can drop it.  Rows that repeat an id are judged by themselves, but
where copies are looked for they are one document.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.llm import bpe, quality
from narrascope.llm.decontaminate import decontaminate
from narrascope.llm.line_dedup import dedup_lines
from narrascope.llm.ngram_join import ngram_jaccard_join
from narrascope.llm.queries import vocabulary
from narrascope.session import Scratch


def _beside(docs: DataFrame, made: tuple[str, ...], step) -> tuple[DataFrame, list]:
    """What ``step`` makes of the documents, and their own columns in it, also those named like one that ``step`` makes."""
    own = {c: f"__own_{c}" for c in docs.columns if c in made}
    return step(docs.withColumnsRenamed(own)), [F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored, own = _beside(docs, ("score", "predicted"), lambda d: quality.score(d, model))
    return scored.where("predicted = 1").select(*own)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those that consist of nothing else go."""
    clean, own = _beside(docs, ("n_lines", "n_removed"), dedup_lines)
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return clean.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))).select(*[length if c == "n_chars" else x for c, x in zip(docs.columns, own)])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near copies; rows without an id stay."""
    groups = ngram_jaccard_join(docs, k=5, threshold=80).select("doc_id", "component_id").distinct()
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found, own = _beside(docs, ("n_words", "hit_spans", "hit_items"), lambda d: decontaminate(d, benchmark))
    return found.where(F.size("hit_spans") == 0).select(*own)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining document's token count and the digests of its ids and of their decoded bytes."""
    return bpe.round_trip(docs, vocabulary(), keep=["doc_id"])


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", token_stage),
]

#: SQL expresses neither the trained classifier nor the tokens; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            work.drop(f"stage-{k - 1}")
        work.release()
    return docs
