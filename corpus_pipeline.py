"""The corpus pipeline: documents without toxic ones, copies and near copies, mixed by source and cut into pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basalt.llm import exact_dedup, mixing, pieces, simhash, toxicity
from basalt.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, rejects go.

    A null or empty text is scored like a text without words.  Without labels of both kinds, and of an empty table, all stay.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the most code points, then the smallest id.

    Null and blank texts are one group, null ids come last, and rows alike in id and text are one row.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that links of alike texts connect: five words a shingle, Jaccard 0.8 or more.

    SimHash fingerprints within three bits meet under Golay keys and are checked by their sets; the sets then find what the
    bits leave apart.
    The smallest id stays, of equal ids the text with the smallest hash.  Texts without words are one group; a text of
    fewer words is one shingle.  Null ids come last.
    """
    return simhash.drop_near_copies(docs, size=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, its repetitions one after the other.

    Null is a source of its own.  Rows alike in id and text are taken alike; a document without words may be taken too.
    """
    return mixing.repeat_rows(docs, mixing.mix_sources(docs))


def cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with sampled pieces, decoded again and held against the text.

    Draws are seeded by id and repetition, so each repetition of a document is cut anew.  Null texts have no pieces.
    """
    return pieces.with_pieces(docs, copies=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", cut),
]

#: Learning, fingerprints and sampled pieces are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each stage's rows written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs, "pipeline")
    return docs
