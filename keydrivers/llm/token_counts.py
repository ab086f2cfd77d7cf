"""Token counts with a shortcut for whole tokens.

Which vocabulary strings encode alone as one token is proven from the vocabulary, before any text is
read. Pre-tokens found among them count one each; only the rest is merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_bpe, public, vocabulary
from .common import BoundedCache, as_texts, letters, picked, slices

CACHE = 400_000


@lru_cache(maxsize=4)
def _counts(blob: bytes) -> BoundedCache:
    """Number of tokens by pre-token: the proven ones stay, others are merged when first seen."""
    bpe = byte_bpe(blob)
    return BoundedCache(lambda x: len(bpe.merge(x.encode())), CACHE, bpe.whole_tokens())


def count_tokens(
    docs: DataFrame,
    limit: int = 1024,
    vocab: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    A null text counts as empty: 0 bytes, 0 tokens. A null id stays null. Special strings within a
    text are one token each, as the library takes them. Repeated rows give repeated results, other
    columns are not carried, no rows give no rows.
    """
    blob = vocabulary(docs.sparkSession, vocab or public("byte_bpe_50k.json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, counts = byte_bpe(blob.value), _counts(blob.value)
        known = counts.__getitem__

        def count(text: str) -> int:
            total = 0
            for part, _ in bpe.segments(text):
                total += 1 if part is None else sum(map(known, bpe.pre_tokens(part)))
            return total

        for part in slices(batches, "text"):
            found = [count(x) for x in as_texts(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("n_bytes"), pa.array(found, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = picked(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("bigint"),
        "text",
        F.octet_length(letters(F.col("text"))).cast("bigint").alias("n_bytes"),
    )
    counted = rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
