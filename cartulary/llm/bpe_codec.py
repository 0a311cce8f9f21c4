"""BPE encoding and decoding: batched merge rounds over flat symbol arrays, and back to text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm import bpe
from cartulary.llm.common import free_memory, fresh, without
from cartulary.llm.token_counts import chunks


def encode(docs: DataFrame, tokenizer_json: str, text: str = "text") -> DataFrame:
    """docs with `ids`: the token ids of each whole text, as the tokenizers library gives them without special tokens added.

    A null text encodes as empty. Special strings inside a text become their one token. Rows stay as they
    are, repeated ones too; a column named ids is replaced.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = bpe.load(spec.value)
        pool = bpe.Pool(tokenizer, keep_ids=True)
        for texts in batches:
            out = []
            for sizes, pieces in chunks([t or "" for t in texts], tokenizer):
                ids, counts = pool.gather(pool.codes(pieces))
                ends = np.append(0, np.cumsum(counts))[np.cumsum(sizes)]
                out += np.split(ids, ends[:-1])
                if len(pool.index) > pool.LIMIT:
                    pool.clear()
            yield pd.Series(out, dtype=object)
        pool.clear()
        free_memory()

    if text not in docs.columns:
        raise ValueError(f"no column {text} to encode")
    return without(docs, "ids").withColumn("ids", encoded(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def decode(docs: DataFrame, tokenizer_json: str, ids: str = "ids") -> DataFrame:
    """docs with `decoded`: the text of each id array; null ids decode as empty, bytes that are no UTF-8 as U+FFFD."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = bpe.load(spec.value).token_bytes.__getitem__
        for rows in batches:
            yield pd.Series([b"".join(map(table, np.asarray(x).tolist())).decode("utf-8", "replace") if x is not None else "" for x in rows], dtype=object)

    return without(docs, "decoded").withColumn("decoded", decoded(F.col(ids)))


def round_trip(docs: DataFrame, tokenizer_json: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of encode() followed by decode(), in one pass over each text."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    @F.pandas_udf(schema)
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = bpe.load(spec.value)
        table = tokenizer.token_bytes.__getitem__
        pool = bpe.Pool(tokenizer, keep_ids=True)
        for texts in batches:
            rows = []
            for sizes, pieces in chunks([t or "" for t in texts], tokenizer):
                ids, counts = pool.gather(pool.codes(pieces))
                ends = np.append(0, np.cumsum(counts))[np.cumsum(sizes)]
                for one in np.split(ids, ends[:-1]):
                    text_again = b"".join(map(table, one.tolist())).decode("utf-8", "replace")
                    rows.append((len(one), hashlib.sha256(one.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text_again.encode()).hexdigest()))
                if len(pool.index) > pool.LIMIT:
                    pool.clear()
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        pool.clear()
        free_memory()

    out = without(docs, "n_tokens", "ids_sha256", "decoded_sha256")
    kept = [F.col(f"`{c}`") for c in out.columns]
    (name,) = fresh(out, "both")
    return out.withColumn(name, both(F.coalesce(F.col(f"`{text}`"), F.lit("")))).select(*kept, f"{name}.*")
