"""Corpus pipeline: documents to token counts and hashes, through five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
folder that spark.checkpoint.dir names and read again as the docs of the next stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm import language_id, line_dedup, mixing, near_copies, pieces
from chronolex.llm.common import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (``und``: null texts, texts without a letter) go; a missing ``lang`` is the predicted one.

    A very long text is scored whole. Repeated rows go or stay alike; an empty table gives no rows. Here and in the other stages columns
    beyond those of documents are left behind, so their names can't clash.
    """
    d = docs.select(*COLUMNS)
    told = language_id.identify(d, language_id.fit(d), SCHEMA).filter(F.col("lang_pred") != language_id.UNDETERMINED)
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated in five documents or more stay in one; n_chars follows the text.

    A null text is one empty line and stays null, a very long one is split like any other. Rows that share an id
    count as one document, a row without an id keeps its lines, and no row goes; an empty table gives no rows.
    """
    d = docs.select(*COLUMNS)
    return line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays: the one with the smallest id (of rows with one id, one).

    SimHash under the stage's own rule: covering tables over parts of wide fingerprints bring pairs together, their
    distance is compared, and links are checked on whole sets of shingles, of very long texts as well. Null
    and blank texts are copies of each other. Of rows without an id, one of each set of shingles stays that no row
    with an id has. An empty table gives no rows.
    """
    d = docs.select(*COLUMNS).withColumn("_th", F.xxhash64("text"))
    groups = near_copies.near_duplicates(d, "doc_id long, _th long").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = groups.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("fp")).alias("fp")).agg(F.min("_th").alias("_th"))
    stay = stay.select(F.col("doc_id").alias("_id"), F.col("_th").alias("_own")).distinct()
    kept = d.join(stay, F.expr("doc_id <=> _id AND _th = _own"), "left_semi")
    return kept.dropDuplicates(["doc_id", "_th"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: documents repeat as often as the mix takes them, or go.

    A null source is one of its own. Repeated rows have one key and are taken each, a text without a word
    adds nothing to its source, a very long one counts whole; an empty table gives no rows.
    """
    d = docs.select(*COLUMNS)
    return mixing.expand(d, mixing.mix(d))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of each document's ids and of the text that they decode to.

    A null text is encoded as the empty one, a very long one whole; repeated rows give equal rows, an
    empty table none.
    """
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Language identification, fingerprints and encoding are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
