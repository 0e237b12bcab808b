"""Sizes in tokens of a public subword tokenizer."""

from __future__ import annotations

import base64
import functools
import os

from pyspark.sql import SparkSession

#: Where the vocabulary lies by default; every operator takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how this family of tokenizers cuts text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_SHIPPED: dict[str, set[str]] = {}


@functools.cache
def encoding(path: str = VOCABULARY):  # noqa: ANN201
    """The tokenizer of a vocabulary file of ranks; read once per Python worker."""
    import tiktoken
    from pyspark import SparkFiles

    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def byte_lengths(path: str = VOCABULARY):  # noqa: ANN201
    """Bytes of each token id."""
    import numpy as np

    e = encoding(path)
    out = np.zeros(e.max_token_value + 1, np.int64)
    for b, i in e._mergeable_ranks.items():
        out[i] = len(b)
    return out


def ship(spark: SparkSession, path: str) -> None:
    """Send the vocabulary file to the executors, for those that don't have it at its path."""
    if os.path.exists(path) and path not in _SHIPPED.setdefault(spark.sparkContext.applicationId, set()):
        spark.sparkContext.addFile(path)
        _SHIPPED[spark.sparkContext.applicationId].add(path)


def clean(text: str) -> str:
    """Lone surrogates can't be encoded; they become question marks."""
    return text.encode("utf-8", "replace").decode("utf-8")
