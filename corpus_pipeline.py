"""Five stages from raw documents to packed sequences, each one of the corpus operators.

Quality classifier, exact dedup, near dedup, mixing of sources to target
weights, packing. Every stage but the last takes and returns the columns of
`documents`; each is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.exact_dedup import drop_copies
from lodestone.llm.mixing import mixed_documents
from lodestone.llm.near_dedup import drop_near
from lodestone.llm.packing import pack
from lodestone.llm.quality_classifier import keep_good
from lodestone.llm.shared import clear, remove, shared_folder, tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on `labels`, does not reject.

    Null, empty and very long texts are scored by their features; null sources
    and languages are groups of their own; a score at the threshold keeps. Rows
    that repeat id, text, source and language stay or go together. Columns stay
    as they are, whatever their names; an empty table stays empty.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id.

    Null counts as empty; null ids are the smallest; of rows that tie, as they
    repeat id and text, one stays. Texts are compared whole. Columns stay as they
    are, whatever their names; an empty table stays empty.
    """
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), that with the smallest doc_id.

    Null, empty and wordless texts are near nothing and stay; null ids are the
    largest. Rows that repeat id and text stay or go together: the stage before
    leaves one of them. Whole texts count, very long ones too. Columns stay as
    they are, whatever their names; an empty table stays empty.
    """
    return drop_near(docs, similarity=0.8, width=5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, in its order: once, twice, cut, or not at all.

    A null source is a source, the last; documents without words, null ones
    among them, are taken in no pass. Equal rows are documents of their own; of
    documents that tie in the order the text's hash decides. Very long texts may
    be cut where the mix ends. Other columns go along, n_chars is set anew for
    cut texts; an empty table stays empty.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens.

    The streams are the files of the stage before, whose rows stand in the mix's
    order, so a rerun gives the same pieces. A document that the mix takes twice
    is two documents here, with one doc_id. Null and empty texts are the end
    token; very long ones run over many sequences; an empty table gives no piece.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048, end=1)


#: Scratch tables of the stage that ran last, by application.
_MADE: dict[str, set[str]] = {}


def _staged(stage):
    """The stage as a function that first deletes the scratch tables of the stage before, whose result is written and read again by then.

    If `docs` reads one of them after all, they stay.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        old = _MADE.pop(app, set()) & tables(spark)
        if old and not any(path in f for f in docs.inputFiles() for path in old):
            clear(spark, keep=tables(spark) - old)
        before = tables(spark)
        out = stage(spark, docs, sf_dir)
        _MADE[app] = tables(spark) - before
        return out

    run_stage.__doc__, run_stage.__name__ = stage.__doc__, stage.__name__
    return run_stage


STAGES = [(name, _staged(f)) for name, f in (("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing sources", mixture), ("packing", packing))]
#: Training, tokenising and iterative joins have no form in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again.

    A stage's scratch tables and the result before its own are deleted once its
    result is written; the last result stays, as the caller reads it.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        others = tables(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        clear(spark, keep=others)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
