"""The corpus pipeline: quality rules, near-dedup, PII, mixing and BPE, each a whole-table stage over the last one's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.bpe import encode_documents
from ionloom.llm.common import cut, table
from ionloom.llm.dedup import keep_one
from ionloom.llm.mixing import mixed
from ionloom.llm.pii import mask_pii
from ionloom.llm.quality import good_documents
from ionloom.llm.queries import vocabulary_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go, an empty table gives none, repeated rows share a verdict."""
    return good_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id; of repeated rows one stays. Null texts all stay."""
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in their texts; null and empty texts pass as they are."""
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target shares of sources, languages and topics; nulls are classes of their own, and the hash of
    doc_id decides, so repeated rows share a decision. An empty table gives none."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their number of each document; every text is decoded again and must be the document's.

    Null and empty texts have no tokens; repeated rows stay, each with its tokens."""
    out = encode_documents(docs, vocabulary_path(), proof=True)
    return out.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_dedup", dedup), ("pii", pii), ("mixing", mixing), ("bpe", tokens)]

#: Dedup, sampling and BPE are not SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is materialised for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
