"""Sizes of texts in tokens of a public byte-level BPE vocabulary. The vocabulary file's folder is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Folder of the public vocabularies, the same on every executor.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that this public vocabulary splits text with before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(folder: str):  # noqa: ANN201 - the library is imported where it runs
    """The tokenizer of a folder, once a process."""
    import tiktoken

    with open(f"{folder}/{VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | None, folder: str = TOKENIZER_DIR) -> int:
    """Tokens of a text; none for null."""
    return len(encoding(folder).encode_ordinary(text)) if text else 0


def token_sizes(documents: DataFrame, *keep: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, *keep, tokens) of ``documents``; each row is read once and its text dropped at once."""
    kept = ["doc_id", *keep]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[kept].assign(tokens=[token_count(t, folder) for t in b["text"]])

    types = dict(documents.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", tokens long"
    return documents.select(*kept, "text").mapInPandas(rows, schema)
