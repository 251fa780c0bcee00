"""Byte-level BPE by a rank file: ids of whole texts by the tiktoken library and raw bytes back from the ids."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.segments import rank_encoder_of, read_ranks


@cache
def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id; ids without a token are empty."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode(text: Column | str, path: str, pattern: str) -> Column:
    """Ids of each whole text (null: none) as array<int>. Long texts are cut at safe boundaries first, so equal to one call."""

    @F.pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        encoder = rank_encoder_of(path, pattern)
        return pd.Series([np.frombuffer(x, dtype="<u4").astype("i4") for x in _chunked(encoder, texts)])

    return ids_of(text)


def decode(ids: Column | str, path: str) -> Column:
    """Raw bytes of an id array (null or empty: no bytes); bytes that are no valid UTF-8 stay as they are."""

    @F.pandas_udf("binary")
    def bytes_of(column: pd.Series) -> pd.Series:
        table = token_bytes(path)
        return pd.Series([b"" if ids is None else b"".join(map(table.__getitem__, ids.tolist())) for ids in column])

    return bytes_of(ids)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    A null text counts as empty: 0 tokens, both digests of nothing. One row per input row, repeated rows and null ids
    included; other columns are left out. Encoding and decoding happen in one step, so that ids do not travel.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        encoder, table = rank_encoder_of(path, pattern), token_bytes(path)
        decimal = _decimals(len(table))
        out = []
        for raw in _chunked(encoder, texts):
            ids = np.frombuffer(raw, dtype="<u4").tolist()
            written = b" ".join(map(decimal.__getitem__, ids))
            back = b"".join(map(table.__getitem__, ids))
            out.append((len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(back).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests("text").alias("d")).select("doc_id", "d.*")


@cache
def _decimals(n: int) -> list[bytes]:
    return [b"%d" % i for i in range(n)]


def _chunked(encoder, texts: pd.Series, step: int = 256):
    """Ids of the texts, a few texts at a time, so that only their segments are in memory."""
    for at in range(0, len(texts), step):
        yield from encoder(texts.iloc[at:at + step])
