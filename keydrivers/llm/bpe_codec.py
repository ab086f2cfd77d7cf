"""BPE encoding and decoding of whole texts by forced-boundary splitting.

Byte pairs that stand inside no vocabulary token mark places no merge can cross. Pre-tokens are cut
there, the fragments are merged on their own, and their ids are put together. Fragments come back
far more often than words, so most are found in a small table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_bpe, public, vocabulary
from .common import as_texts, give_back, picked, slices

SCHEMA = "doc_id bigint, n_tokens bigint, token_ids array<int>, decoded string"


def encode_decode(
    docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Ids and decoded text of every row: doc_id, n_tokens, token_ids, decoded.

    A null text counts as empty: no ids, decoded to an empty text. A null id stays null. Repeated
    rows give repeated results. Other columns are not carried. No rows give no rows. Texts of any
    length are taken whole: a task holds some MB of texts at a time, or one text if it is longer.
    """
    blob = vocabulary(docs.sparkSession, vocab or public("byte_bpe_50k.json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(blob.value)
        try:
            for part in slices(batches, "text"):
                encoded = [np.frombuffer(bpe.packed(x), dtype=np.int32) for x in as_texts(part.column("text"))]
                ends = np.cumsum([0, *map(len, encoded)])
                ids = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.concatenate(encoded), pa.int32())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(ends), pa.int64()),
                        ids,
                        pa.array([bpe.decode(x.tolist()) for x in encoded], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "token_ids", "decoded"],
                )
        finally:
            # The worker goes on with other stages, which have no use for what is remembered here.
            bpe.forget()
            give_back()

    rows = picked(docs, doc_id=id_col, text=text_col)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(run, SCHEMA)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    decimals = F.concat_ws(",", F.col("token_ids").cast("array<string>"))
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2(decimals, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
