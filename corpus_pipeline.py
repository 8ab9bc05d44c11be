"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, packing.

Every stage takes the documents that its predecessor kept, written as Parquet and read again, and
all but the last return the columns of ``documents``.

Defined results, of every stage: a null text counts as an empty one, which is not toxic, has no lines
and is a near copy of other empty ones, of which one stays; a null ``doc_id``, lang or source is a
value like others, but rows without ``doc_id`` are no originals of lines and no near copies; texts
are handled whole, whatever their length; ties go by ``doc_id``, then text; rows that are equal in
all columns are near copies; further columns pass through, whatever their names; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import line_dedup, packing, simhash_dedup, source_mix, toxicity
from veilspark.llm.common import table, write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are deleted; documents that have lost every line go."""
    return line_dedup.clean_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of the 5-word shingles shared) one document stays."""
    return simhash_dedup.keep_one_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that source, language and topic have their target weights."""
    return source_mix.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: No stage is one that SQL can express; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
