"""The corpus pipeline: quality filter, near-duplicates, decontamination, mixing, token records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lawmill.llm.common import materialize
from lawmill.llm.latent_leaks import decontamination_stage
from lawmill.llm.mixing import mixing_stage
from lawmill.llm.quality import quality_stage
from lawmill.llm.simhash import simhash_stage
from lawmill.llm.token_bins import token_bins_stage

#: Each takes (spark, docs, sf_dir) and works on all that the one before it kept.
STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", simhash_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_bins", token_bins_stage),
]
#: Training, fingerprints and the tokenizer are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
