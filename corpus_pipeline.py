"""A corpus pipeline: toxicity, language, near duplicates, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of documents; the
last returns the mixture. What a stage rejects is gone for those after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, language_id, mixing, ngram_join, toxicity
from lodestone.llm._util import discard, materialize

#: A language that is less likely than this against all others together is no decision.
LANGUAGE_SCORE = 0.5


def kept(docs: DataFrame, judge: Callable[..., DataFrame], condition: str) -> DataFrame:
    """The rows of docs that an operator's columns let pass. The columns go through it under names of their own, so none
    clashes with the operator's."""
    plain = docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])
    own = dict(zip(docs.columns, plain.columns, strict=True))
    judged = judge(plain, id_col=own["doc_id"], text_col=own["text"], keep=plain.columns)
    return judged.filter(condition).select(*plain.columns).toDF(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. Null and empty texts are not; repeated rows are judged alike; an empty table stays one."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept(docs, lambda d, **names: toxicity.score(d, model, **names), "predicted = 0")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that was learnt, or in none more likely than not, go; so do null texts and those without a letter.
    Repeated rows are judged alike; an empty table stays one."""
    model = language_id.train(docs)
    return kept(docs, lambda d, **names: language_id.predict(d, model, **names), f"lang_pred <> '{language_id.UNKNOWN}' and score >= {LANGUAGE_SCORE}")


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that with the least doc_id (null last), the first of those that share it. So repeated rows
    and copies without an id go like any others; texts without words are no group and all stay.

    Rows are told apart by numbers, which are written with them first, so that all that follows sees the same ones.
    """
    plain = docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])
    own = dict(zip(docs.columns, plain.columns, strict=True))
    doc_id = F.col(own["doc_id"])
    plain = materialize(plain.withColumn("_row", F.monotonically_increasing_id()), "pipeline-numbered")
    groups = ngram_join.join(plain.select(F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), "_row").alias("doc_id"), F.col(own["text"]).alias("text")))
    gone = groups.filter("doc_id <> component_id").select("doc_id._row")
    return plain.join(gone, "_row", "left_anti").select(*own.values()).toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. Null and empty texts are not; repeated rows are judged alike; an empty table stays one."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return kept(docs, lambda d, **names: decontaminate.scan(d, benchmark, **names), "not contaminated")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each row that is left: none of null or empty texts; repeated rows count each on its own;
    of an empty table there are no rows."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("duplicates", duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL has no form for the trained stages; the tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again; what the next one has read is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        old, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            discard(old)
    return STAGES[-1][1](spark, docs, sf_dir)
