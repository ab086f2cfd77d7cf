"""The operators on the given tables, under the names and with the columns of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import repeats
from .bpe_codec import digests, encode_decode
from .common import table
from .conversations import damaged, repaired
from .decontaminate import leaks
from .near_dedup import near_duplicates
from .quality_model import scored
from .quality_rules import judged
from .secret_scan import scan
from .spelling import spelling_variants
from .token_counts import count_tokens
from .token_files import checksums, read_tokens, write_tokens
from .url_filter import filtered
from .warc import lookup, write_archives

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents")))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, and which; no other rows."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("host")


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksums(read_tokens(write_tokens(table(spark, sf_dir, "documents"))))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of all pages are looked up in the index, and their records read by range."""
    pages = table(spark, sf_dir, "pages")
    records = lookup(write_archives(pages), pages, payload=False)
    return records.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.without_repeats(table(spark, sf_dir, "documents")))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))
