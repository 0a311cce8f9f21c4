"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm import bpe
from cartulary.llm.common import free_memory, fresh, without

#: Pre-tokens that are held at once; more of them are handled in further rounds.
CHUNK = 200_000


def chunks(texts: list[str], tokenizer: bpe.Tokenizer) -> Iterator[tuple[list[int], list[str]]]:
    """Pre-tokens of one text after another, cut into pieces of bounded size: (how many of each text, pre-tokens)."""
    sizes: list[int] = []
    pieces: list[str] = []
    for text in texts:
        found = tokenizer.pretokens(text)
        sizes.append(len(found))
        pieces += found
        if len(pieces) >= CHUNK:
            yield sizes, pieces
            sizes, pieces = [], []
    if sizes:
        yield sizes, pieces


def token_counts(docs: DataFrame, tokenizer_json: str, limit: int = 512, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) of each whole text.

    tokenizer_json: the contents of a byte-level BPE file of the tokenizers library. Counts are without
    begin, end or padding; special strings inside a text count as their one token. A null text counts as
    empty (0 bytes, 0 tokens). Rows stay as they are, repeated ones too; columns of the same names are replaced.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = bpe.load(spec.value)
        pool = bpe.Pool(tokenizer, keep_ids=False)
        for texts in batches:
            out = []
            for sizes, pieces in chunks([t or "" for t in texts], tokenizer):
                codes = pool.codes(pieces)
                each = pool.counts[codes]
                ends = np.cumsum(sizes)
                total = np.append(0, np.cumsum(each))
                out.append(total[ends] - total[ends - sizes])
                if len(pool.index) > pool.LIMIT:
                    pool.clear()
            yield pd.Series(np.concatenate(out) if out else np.empty(0, np.int64))
        pool.clear()
        free_memory()

    out = without(docs, "n_bytes", "n_tokens", "over_limit")
    if text not in out.columns:
        raise ValueError(f"no column {text} to count")
    (n,) = fresh(out, "tokens")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return (
        out.withColumn(n, count(body))
        .select("*", F.octet_length(body).cast("long").alias("n_bytes"), F.col(n).alias("n_tokens"), (F.col(n) > limit).alias("over_limit"))
        .drop(n)
    )
