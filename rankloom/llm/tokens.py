"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType

#: Where the vocabulary files lie on every machine; a parameter of each operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How that vocabulary's byte-pair encoder cuts a text first.
CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def counter(path: str = TOKENIZER) -> Callable[[str], int]:
    """A function that counts a text's tokens; special tokens' strings are ordinary text."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding(os.path.basename(path), pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text; null has none."""

    @F.pandas_udf(IntegerType())
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path)
        for series in values:
            yield series.map(lambda t: count(t) if t else 0).astype("int32")

    return run(F.coalesce(text, F.lit("")))
