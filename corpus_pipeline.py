"""The corpus pipeline: toxicity, quality rules, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result to the shared folder
and reads it back as the next one's documents. All but the last return the columns of documents. Further columns of
the documents ride along unchanged, whatever their names; nulls, repeated rows and empty tables are handled as the
operators' own docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm import mixing, packing, quality_rules, simhash, toxicity
from tallyflow.llm.common import cut, table

#: SQL can't express the fitted lexicon, the linked fingerprints or the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def _with_rest(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The id and the text, and all other columns in one that can't clash with what an operator adds."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_rest")), rest


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    packed, rest = _with_rest(docs)
    scored = toxicity.score(packed, table(spark, sf_dir, "labels"), extra=["_rest", "text"])
    own = {c: F.col("_rest").getField(c).alias(c) for c in rest}
    return scored.where("predicted = 0").select(*[own.get(c, F.col(c)) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go, and documents that fail the base rules or lose half their words."""
    packed, rest = _with_rest(docs)
    cleaned = quality_rules.clean_lines(packed, with_text=True, extra=["_rest"]).where("kept")
    own = {c: F.col("_rest").getField(c).alias(c) for c in rest} | {"text": F.col("clean_text").alias("text")}
    if "n_chars" in own:
        own["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return cleaned.select(*[own.get(c, F.col(c)) for c in docs.columns])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
