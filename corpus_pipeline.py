"""A training corpus from documents: five stages, each one of the corpus operators.

Every stage works on all that the stage before it kept; ``run`` writes each
stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelith.llm import decontam, linededup, packing, simhash, toxicity
from voxelith.llm.common import discard, doc_crc, materialise, read
from voxelith.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), lambda c: doc_crc(c) % 3 != 1)
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks that an earlier document has go from the later ones."""
    return linededup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with a benchmark item go."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row for each piece."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash", dedup_documents), ("decontamination", decontaminate), ("packing", pack)]

#: Learned scores and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of ``documents``; each stage's table goes once the next one is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = materialise(stage(spark, docs, sf_dir), name)
        if before:
            discard(spark, before)
        before = path
    return docs
