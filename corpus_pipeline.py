"""From documents to token ids: quality rules, line dedup, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; all but the last return the columns
of documents. Null ids, null, empty and very long texts, repeated rows and empty tables are handled as the operators'
docstrings say; extra columns of any name travel along unchanged, in all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import linededup, minhash, mixing, pieces, quality
from ledgerlens.llm.common import Scratch, importable, set_aside

POLICY = "v2"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    packed, back = set_aside(docs, "doc_id", "text")
    return back(quality.ledger(packed).filter(quality.verdict(POLICY)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text."""
    packed, back = set_aside(docs, "doc_id", "text", "n_chars")
    out = linededup.drop_frequent_lines(packed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), F.col("n_chars")))
    return back(out)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return minhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, a row for each copy, in training order."""
    decided = Scratch(spark).write(mixing.mix(docs), "mix")
    return mixing.training_order(docs, decided)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, after the columns of documents, as `ids`; where documents has that name, with _ after it."""
    importable(spark)
    packed, back = set_aside(docs, "text")
    name = "ids"
    while name in docs.columns:
        name += "_"
    return back(pieces.encode(packed, pieces.model_file()), F.col("ids").alias(name))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_neardup", neardup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: MinHash and tokenizers have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again before the next stage."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
