"""From raw documents to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined cases, in every stage: null and empty texts pass (the classifier rejects those that it scores below its threshold);
rows that repeat a doc_id are kept or dropped together, but for lines, where each text loses its own; of equal texts near
duplicates keep the least doc_id; an empty table stays empty; other columns pass through the first four stages.
A stage deletes the intermediate tables of the stage before it in its thread, whose result has been written by then.
"""

from __future__ import annotations

import threading
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netohm.llm import decontamination, line_dedup, order_minhash, packing, quality_classifier, tokens, work

_BEFORE = threading.local()


def _stage(f):
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        work.delete(spark, getattr(_BEFORE, "tables", []))
        with work.collected() as made:
            out = f(spark, docs, sf_dir)
        _BEFORE.tables = made
        return out

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; labels of all labelled documents teach it."""
    scored = quality_classifier.classify(docs, work.table(spark, sf_dir, "labels"))
    return docs.join(scored.where("predicted = 0").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later copies of line runs; documents that lose all their words go. n_chars follows the text where lines went."""
    own = {c: f"kept{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}  # names that the operator's columns can't clash with
    out = line_dedup.remove_repeated_runs(docs.withColumnsRenamed(own))
    emptied = (F.col("n_deleted") > 0) & (F.translate("text", " \t\n\x0b\x0c\r", "") == "")
    kept = out.where(~F.coalesce(emptied, F.lit(False)))
    length = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long") if "n_chars" in docs.columns else None
    return kept.select(*[length.alias(c) if c == "n_chars" else F.col(own.get(c, c)).alias(c) for c in docs.columns])


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return order_minhash.keep_one(docs)


@_stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold benchmark items."""
    return decontamination.decontaminate(docs, work.table(spark, sf_dir, "benchmark"))


@_stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of token ids."""
    return packing.pack(docs, tokens.default_path(), end_id=0)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("benchmark decontamination", benchmark), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    base = f"{work.shared_dir(spark)}/netohm-pipeline-{uuid.uuid4().hex}"
    docs = work.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            work.delete(spark, [f"{base}/{k - 1}"])
    return docs


#: Token ids, learnt scores and sketches are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None
