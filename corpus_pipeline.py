"""From raw documents to packed training sequences, stage by stage, over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainscope.llm.jaccard import keep_first
from grainscope.llm.language import in_a_language, train_language_model
from grainscope.llm.linededup import dedup_lines
from grainscope.llm.packing import pack
from grainscope.llm.queries import WORDS
from grainscope.llm.secretscan import labelled_tokens, pair_weights, redact
from grainscope.plans.registry import query
from grainscope.session import save_and_reload, shared_dir


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns of these names renamed, and what gives the names back: a stage adds columns of its own there."""
    held = {c: f"_own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(held), lambda out: out.drop(*names).withColumnsRenamed({v: k for k, v in held.items()})


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language of the table go: NULL text, no letters, or 64 bytes and more that the network gives to
    all languages nearly alike (score below 0.4375 for four). Without labels enough to learn
    from, all with letters stay."""
    with_own_names, own_names = set_aside(docs, "lang_pred", "score")
    return own_names(in_a_language(with_own_names, train_language_model(docs))).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line passages go from the texts, and texts that become empty go."""
    with_own_names, own_names = set_aside(docs, "n_lines", "n_removed", "n_spans")
    kept = own_names(dedup_lines(with_own_names).where((F.col("n_removed") == 0) | (F.col("text") != "")))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that of the smallest id; repeated rows and rows without an id
    leave like the others."""
    return keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark."""
    clean = redact(docs, pair_weights(labelled_tokens(docs)))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all texts in sequences of 4096; one row per piece. Workers outlive a stage with what they remember, so
    few words are remembered here."""
    return pack(docs, WORDS, max_words=150_000, slice_bytes=1 << 20)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("secrets", secrets),
    ("packing", packing)]

#: Training a network, components of links and token ids are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result but the last is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = save_and_reload(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
