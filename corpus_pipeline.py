"""From raw documents to packed token sequences: the stages of a training-data pipeline.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet in the shared
folder and read again as the next stage's docs. Stages that hand texts to Python bound the session's
Arrow batches by bytes; no result depends on how rows are batched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.llm import langid, lines, mixing, ngram_join, packing
from panelcast.llm.components import sized
from panelcast.llm.queries import table, word_tokenizer
from panelcast.session import bound_batches, write_and_read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the kernel model can tell; ``lang`` stays as given.

    Out go texts that are null or have no letter, and those whose best language has a score below
    LEAST_SCORE, hardly more than a guess among four.
    """
    bound_batches(spark)
    model = langid.fit(langid.train_part(docs))
    told = langid.identify(docs.select(*COLUMNS), model)
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones, nearly or exactly; n_chars follows the text.

    A document of which nothing but white space is left goes: all it said stands in others.
    """
    bound_batches(spark)
    kept = lines.dedupe_lines(docs.select(*COLUMNS))
    kept = kept.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\s]"))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group linked by word shingles."""
    bound_batches(spark)
    groups = ngram_join.similar(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    groups = write_and_read(groups, "copies")
    return docs.select(*COLUMNS).join(sized(groups, groups.count()), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document stands there once per copy."""
    return mixing.emit(mixing.mix(docs), COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    bound_batches(spark)
    return packing.pack(docs, word_tokenizer()).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", dedupe_lines),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
