"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists (name, function) pairs; every function takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's ``docs``.  All but the last return the columns of documents.

Every stage takes nulls in any column, empty and very long texts, ties and
repeated rows, empty tables, and extra columns, also of the operators' own
names; extra columns are kept by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm import line_dedup, mixing, packing, quality, simhash_dedup
from churnscope.llm.common import documents, materialize, table
from churnscope.llm.queries import tokenizer_file
from churnscope.session import fresh_path

#: Share of the tokens that the mixture takes.
MIX_BUDGET = 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null text is scored as an empty one; a null id counts as the text ``""`` in
    the folds and has no label; equal rows are accepted or rejected together; an
    empty table stays empty.
    """
    return quality.accept(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def drop_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs.

    Of copies the one in the smallest doc_id (null before all) is the first.  Null
    and empty texts stay as they are; a document all of whose lines are later
    copies goes; an empty table stays empty.
    """
    return line_dedup.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash near-duplicate group, that of the smallest id.

    Null, empty and blank texts share the fingerprint zero and are one group like
    any other; of rows that share the kept id one stays, rows without an id all
    stay; an empty table stays empty.
    """
    return simhash_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target shares of source, language and topic.

    A null source or language counts as the empty value; null and empty texts have
    no tokens; rows of equal id fare alike where their cells do; an empty table
    stays empty.
    """
    return mixing.sample(docs, budget=MIX_BUDGET)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece: its place in the packed sequences.

    Null and empty texts are one piece of the closing id alone; longer texts than
    a sequence are cut; rows of equal id, piece and ids get places of their own;
    an empty table gives none.
    """
    pieces = packing.tokenize_pieces(docs, tokenizer_file())
    digests = materialize(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.best_fit_pack(digests, order=("doc_id", "piece", "ids_crc32"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_copied_lines),
    ("simhash_near_dedup", near_dedup),
    ("mixing_sources", mix),
    ("best_fit_packing", pack),
]

#: SQL cannot express the classifier, shingle fingerprints or the packing search; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; every stage's result goes through a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
