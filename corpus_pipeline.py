"""A training corpus in five stages: quality rules, near copies, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before kept. It is written as Parquet and read
again before the next. Stages keep the columns of documents, the last returns the pieces with their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxlattice.llm import decontam, jaccard, packing, quality, secrets
from voxlattice.llm.common import discard, materialise, read
from voxlattice.llm.queries import CAPACITY, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return quality.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the smallest id stays."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more repeats benchmark windows go; the others stay as they are."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack(packing.pieces(docs, tokenizer(), CAPACITY), CAPACITY)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("best_fit_packing", best_fit_packing),
]
#: The local search of the last stage, and its tokens, cannot be said in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        discard(*written)  # what this stage has read; the last table stays for the rows that run returns
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
