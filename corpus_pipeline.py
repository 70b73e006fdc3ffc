"""A corpus pipeline of five stages, each one of the corpus operators on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents``; where the text changes, so does ``n_chars``.

Defined cases: null and empty texts pass the first four stages unless judged or linked like any
other document; empty tables give empty tables; extra columns pass through all but
the last stage; rows with the same identifier are treated as the operators state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, line_dedup, packing, quality, simhash
from strandlake.llm.common import fold
from strandlake.session import discard, materialize, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled table outside its held-out fold."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), ~fold("doc_id", 5, 0))
    scored = quality.score_documents(docs, model, score="_quality", verdict="_accepted")
    return scored.where("_accepted").drop("_quality", "_accepted")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds; documents of no line left stay, empty."""
    out = line_dedup.dedup_lines(docs, n_lines="_n_lines", n_dropped="_n_dropped")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.drop("_n_lines", "_n_dropped")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by SimHash: that of the smallest identifier; of repeated rows, one."""
    return simhash.one_of_each(docs, words=NEAR_WORDS, similarity=NEAR_SIMILARITY)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it stands or re-parameterised."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack(docs.select("doc_id", "text"))


#: Words of a shingle, and similarity of shingle sets, in the near-duplicate stage.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # What a stage has read is not read again; a table of the caller is left alone.
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenising, learned scores and fingerprints have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
