"""Token counts by a whole-token shortcut.

Offline, once: prove which vocabulary strings are a single pre-token that the library encodes as that one token.
At scan time a pre-token in the proven set counts one without any merging; only the rest is merged. Nothing is
shuffled: the scan is one map over the texts, and what is broadcast is bounded by the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .bpe import ByteBpe, prove_whole_tokens
from .common import file_bytes, small_batches

LIMIT = 512


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``; other columns are dropped.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are counted like any row, and an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast((file_bytes(vocabulary), prove_whole_tokens(vocabulary)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = ByteBpe(*shipped.value)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            n = [enc.count(t) for t in texts]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"].astype("Int64"),
                    "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
                    "n_tokens": n,
                    "over_limit": [k > limit for k in n],
                }
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(
        scan, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
