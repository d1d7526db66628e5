"""A corpus pipeline over ``documents``: filter, deduplicate, decontaminate, mask, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import bpe, classify, common, decontaminate, pii, queries, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score under 0.5).

    The classifier is fitted on labelled documents of its input. A null or empty text is scored
    as empty; a null id has no label; repeated rows are scored alike and all stay or go. Without labels all stay.
    """
    labels = common.table(spark, sf_dir, "labels")
    model = classify.fit_quality(docs, labels, classify.fold(F.col("id"), 3) != 1, metadata=queries.METADATA)
    scored = classify.scored(docs, model, {f"c{i}": common.column(docs, c) for i, c in enumerate(docs.columns)}, metadata=queries.METADATA)
    return scored.where("score >= 0.5").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.

    Near are texts that have 0.8 of their five-word shingles in common, and groups what such links lead to. Null
    and empty texts are copies of each other. Of rows with one id one stays; rows without an id have no place in the
    order and stay.
    """
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in windows of benchmark items.

    A null or empty text is clean. Rows of one id and text are judged alike; a null id is judged by its text.
    """
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, disguised ones too, replaced by <EMAIL>, <IP>, <CARD> or <PHONE>.

    No row goes; a null text stays null; ``n_chars`` is the new length. Repeated rows are masked alike, other columns
    stay, and an empty table stays empty.
    """
    return pii.mask(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian, four bytes each) and digests of each document.

    A null text has no ids. Each row stands for itself, repeated ones too; columns other than ``doc_id`` are left out; an empty
    table gives no rows."""
    out = bpe.encode_texts(docs, queries.vocabulary())
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next.

    Empty documents give no rows. Without labels the first stage rejects none, without benchmark items the third.
    """
    docs, root = common.table(spark, sf_dir, "documents"), common.scratch(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = common.written(stage(spark, docs, sf_dir), f"{root}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
