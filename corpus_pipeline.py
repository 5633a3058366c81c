"""A corpus pipeline over ``documents``: each stage applies one operator to all that the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which :func:`run` writes as
Parquet and reads again for the next. Rows without a doc_id cannot be named by a decision and
are always kept; rows that share a doc_id stay or go together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structaudit.llm import bpe, decontam, langid, pii, simhash
from structaudit.llm.common import shared_folder, table
from structaudit.llm.queries import word_vocabulary

#: Documents whose language is less certain than this go.
LEAST_SCORE = 0.3


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without those whose doc_id is in ``ids``. A row travels as one struct beside the id, so no column can
    clash; rows without an id stay where they are and are not dealt out for the join."""
    gone = ids.where("doc_id is not null").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = rows.where("row.doc_id is not null")
    kept = named.join(gone, F.col("row.doc_id").cast("bigint") == F.col("gone"), "left_anti").union(rows.where("row.doc_id is null"))
    return kept.select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was recognised; those without a letter and the doubtful go."""
    found = langid.identify(docs, langid.fit(docs))
    return _without(docs, found.where((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < LEAST_SCORE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class, the one with the smallest doc_id."""
    found = simhash.simhash_groups(docs, words=3, radius=3)
    return _without(docs, found.where("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item or an edited copy of one."""
    return _without(docs, decontam.contaminated_documents(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each span of personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as token ids, with digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, word_vocabulary(), with_ids=True)


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("personal_data", personal_data), ("encoding", encoding),
]

#: Learned languages and token ids have no SQL; the pipeline is tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
