"""Token counts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the vocabulary files and the one used; both are parameters of token_count.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"


def vocabulary_path(folder: str | None = None, name: str = VOCABULARY) -> str:
    """Path of a vocabulary file: below ``folder``, the environment variable TOKENIZER_FOLDER, the default folder or the installed package."""
    for place in (folder, os.environ.get("TOKENIZER_FOLDER"), FOLDER):
        if place and os.path.exists(path := os.path.join(place, name)):
            return path
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a whole text; 0 for null. Strings of special tokens count as ordinary text."""
    path = path or vocabulary_path()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(path)
        for batch in batches:
            yield pd.Series([0 if x is None else len(encoder.encode_ordinary(x)) for x in batch], dtype="int64")

    return count(text)
