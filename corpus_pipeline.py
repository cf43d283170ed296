"""Clean, de-duplicate and pack the documents: four stages over the whole table.

Every stage works on all rows the one before kept; all but the last return the
columns they were given, unchanged."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from epiframe.llm import language, packing, simhash, toxicity
from epiframe.llm.common import cut
from epiframe.llm.queries import folds, table


def carried(docs: DataFrame) -> DataFrame:
    """Rows as one struct beside what a stage reads, so no column of theirs clashes with a stage's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents whose score is 0.5 or more go."""
    labels = folds(table(spark, sf_dir, "labels"), 5, 0).where("not held_out")
    scored = toxicity.score_documents(carried(docs), labels, keep=["row"])
    return unpacked(scored.where("score < 0.5"), docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or whose best language has a posterior under one half, go."""
    learn = folds(docs.select("doc_id", "text", "lang"), 3, 1).where("not held_out")
    model = language.train(learn, public_tokenizers.path("piece_bpe_32k.model"))
    found = language.identify(carried(docs), model)
    kept = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= 0.5)
    return unpacked(found.where(kept), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group the document with the smallest doc_id stays."""
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of the remaining documents into sequences of 4096 tokens, a row per piece."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096), size=4096)


STAGES = [("toxicity", clean), ("language", known_language), ("simhash", near_duplicates), ("packing", packed)]

#: SQL cannot express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
