"""The registered queries of this package and, where SQL expresses them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm import alignment, ann, chat, collocations, decontamination, fingerprints, line_dedup, lm, mixing, packing, quality, sharding, simhash_dedup
from churnscope.llm.common import documents, materialize, table


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    pieces = packing.tokenize_pieces(documents(spark, sf_dir), tokenizer_file())
    digests = materialize(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.best_fit_pack(digests, order=("doc_id", "piece", "ids_crc32"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; shard sizes balanced, equal texts together."""
    return sharding.shard_documents(documents(spark, sf_dir))


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic, tokens, calibrated probability and the sampling's decision for every document."""
    rows = mixing.sampled(documents(spark, sf_dir))
    return rows.select("doc_id", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50."""
    vectors = materialize(ann.usable(table(spark, sf_dir, "embeddings")))
    return ann.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash_dedup.near_duplicates(documents(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every whole text under the recurrent model and under smoothed counts."""
    return lm.score_texts(documents(spark, sf_dir))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures read back from every formatted conversation, and from one that quotes control strings."""
    given = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    quoted = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", quoted), (-1, 1, "assistant", quoted)],
                                "conv_id long, turn long, role string, text string")
    turns = given.unionByName(own).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.digests(chat.format_conversations(turns))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of repeated line runs."""
    return line_dedup.dedup_lines(documents(spark, sf_dir)).drop("runs")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how many documents lie near those with doc_id % 100 = 0.

    ``n_within`` (null for the other documents): documents, the row itself
    included, whose fingerprint differs in at most 7 of 256 bits.
    """
    rows = materialize(fingerprints.edited_likeness(documents(spark, sf_dir)))
    asked = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    near = fingerprints.count_within(rows.select("fingerprint"), rows.filter(asked).select("fingerprint"))
    return (rows.filter(asked).join(near, "fingerprint", "left").select(*rows.columns, "n_within")
            .unionByName(rows.filter(~asked).withColumn("n_within", F.lit(None).cast("long"))))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two vocabularies, their groups of equal bytes and how common the links are."""
    import public_tokenizers

    rows, _ = alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                              public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    return rows


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two to four words of each language, by how firmly their parts hold together."""
    return collocations.collocations(documents(spark, sf_dir))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in runs of ten words of a benchmark item, and which items those are."""
    rows = decontamination.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"), "n_near")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sharding": op3_sharding,
    "op4_mixing_sources": op4_mixing_sources,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_line_dedup": op9_line_dedup,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
}

#: The others: search, learning or hashing that SQL cannot express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_mixing_sources": mixing.oracle_sql(),
    "op8_chat_formatting": chat.oracle_sql(),
    "op9_line_dedup": line_dedup.oracle_sql(),
    "op12_phrase_collocations": collocations.oracle_sql(),
}
