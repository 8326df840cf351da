"""Queries over the corpus tables, one for each operator of this subpackage, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words that a cube-balanced mix of sources takes from each."""
    from .mixing import mix_sources

    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the near-duplicate component that circulant MinHash and exact verification give them."""
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with base statistics and the verdict of risk-controlled rules."""
    from .quality import apply_rules

    found = apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumn("rejected_by", F.concat_ws(",", "rejected_by"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records, found through the two-level capture index and read back."""
    from .warc import archive_and_read

    found = archive_and_read(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a calibrated toxicity score from their nearest labelled examples."""
    from .toxicity import score_documents, train

    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, _table(spark, sf_dir, "labels")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents that overlap a benchmark item."""
    from .decontamination import overlaps

    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), short=True)


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the bytes that a run-length index finds in documents before them."""
    from .suffix_dedup import repeated_bytes

    return repeated_bytes(_table(spark, sf_dir, "documents")).drop("spans")


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and one that speaks in control strings, formatted in windows and read back."""
    from .chat import format_chats, read_back

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(turns.unionByName(more)))


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the summed log-probability of each word given both sides."""
    from .scoring import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .extraction import extract

    return extract(_table(spark, sf_dir, "pages"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their SimHash fingerprint and the component that covering codes find."""
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents that score highest for each benchmark item."""
    from .lexical import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their orders, by language."""
    from .audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources, "op2_decontaminate": op2_decontaminate,
        "op4_repeated_passages": op4_repeated_passages, "op5_chat_windows": op5_chat_windows,
        "op6_pseudo_likelihood": op6_pseudo_likelihood, "op8_main_text": op8_main_text, "op3_quality_rules": op3_quality_rules,
        "op7_warc": op7_warc, "op9_toxicity": op9_toxicity, "op10_near_duplicates": op10_near_duplicates,
        "op11_simhash": op11_simhash, "op12_ranked_search": op12_ranked_search, "op13_filter_audit": op13_filter_audit
    }


def oracle_sql() -> dict[str, str]:
    from .oracle import oracles

    return oracles()
