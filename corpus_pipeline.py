"""Corpus pipeline: five operators, each on what the one before it kept.

STAGES are (name, function) with functions (spark, docs, sf_dir) -> DataFrame; each result is written as Parquet and read again as the
docs of the next. All but the last return the columns of documents. There is no SQL for the learned stages, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.llm import jaccard, packing, quality_fm, suffix_dedup, toxicity
from grantlens.llm.common import Scratch, read, sided

ORACLE_SQL = None


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """Space for a stage; shuffle files of the stages before go."""
    new = Scratch(spark, name)
    new.release()
    return new


def _score_column(scored: DataFrame, docs: DataFrame) -> str:
    return next(c for c in scored.columns if c not in docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    _scratch(spark, "quality")
    scored = quality_fm.score(docs, quality_fm.fit(docs, read(spark, sf_dir, "labels")), keep=True)
    return scored.where(F.col(_score_column(scored, docs)) >= quality_fm.THRESHOLD).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), _scratch(spark, "toxicity"))
    scored = toxicity.score(docs, model, keep=True)
    return scored.where(F.col(_score_column(scored, docs)) < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word sets with a similarity of 0.8 or more: that with the smallest id.

    Rows with one id are one document, of which one row stays; rows without id stay, but for one of equal texts.
    """
    found = jaccard.join(docs, _scratch(spark, "near"), words=5, percent=80).select("doc_id", "component_id")
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    left = docs.join(sided(gone), "doc_id", "left_anti").select(*docs.columns)
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return left
    # ids with several rows, which is rare: one row of each, and those without id by their text
    several = left.join(again, left.doc_id.eqNullSafe(again.doc_id), "left_semi")
    once = left.join(again, left.doc_id.eqNullSafe(again.doc_id), "left_anti")
    chosen = several.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(several.where("doc_id IS NULL").dropDuplicates(["text"]))
    return once.unionByName(chosen)


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat elsewhere; n_chars follows a text that is cut. Every document stays, if with less text."""
    made = suffix_dedup.cut(docs, suffix_dedup.repeated_spans(docs, _scratch(spark, "repeats")), as_text=True)
    cut = next(c for c in made.columns if c not in docs.columns)
    less = F.col(f"{cut}.n_removed") > 0
    changed = {"text": F.when(less, F.col(f"{cut}.kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(less, F.length(f"{cut}.kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return made.withColumns(changed).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    # fewer words are kept than by the operator alone: executors' heaps have grown by now
    return packing.pack(docs, _scratch(spark, "packing"), packing.default_tokenizer(), keep=200_000)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeated_text_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        docs = scratch.save(made, f"stage-{k}")
        scratch.release()
    return docs
