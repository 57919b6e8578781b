"""Tokens of a text and the windows over them.

The default tokenizer is native: a token is a word with the white space that
follows it (the first also has what stands before it), so that joined tokens
give the text back. Any other tokenizer is a pair of functions, one from a text
column to an array of token texts, one to their number.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import is_blank


@dataclass(frozen=True)
class Tokenizer:
    split: Callable[[Column], Column]

    def count(self, text: Column) -> Column:
        return F.size(self.split(text))


WORDS = Tokenizer(lambda text: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:^\s+)?\S+\s*"), F.lit(0)))


def tiktoken_tokenizer(ranks_path: str, pattern: str) -> Tokenizer:
    """Byte-pair tokens of a rank file ("base64 rank" lines), by an Arrow UDF.

    Joined tokens give the text back: a character whose bytes are dealt to
    several tokens is in the text of the one that ends it, and the others have
    what is whole before it. The number of tokens is exact.
    """

    @F.pandas_udf("array<string>")
    def split(text: pd.Series) -> pd.Series:
        enc = _ranked(ranks_path, pattern)
        return text.map(lambda t: _token_texts([enc.decode_single_token_bytes(i) for i in enc.encode_ordinary(t or "")]))

    return Tokenizer(lambda text: split(text))


@cache
def _ranked(path: str, pattern: str):
    """One encoding for each rank file and worker process."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _token_texts(tokens: list[bytes]) -> list[str]:
    whole = codecs.getincrementaldecoder("utf-8")("replace")
    return [whole.decode(t) for t in tokens]


def n_windows(n: Column, size: int, overlap: int) -> Column:
    """0 for no token, 1 up to ``size``, else one per step until the end."""
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / (size - overlap))).cast("int")


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Texts of the token windows in order, blank ones left out."""
    n = n_windows(F.size(tokens), size, overlap)
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(tokens, i * (size - overlap) + 1, F.lit(size)), ""))
    return F.when(n > 0, F.filter(parts, lambda t: ~is_blank(t))).otherwise(F.array().cast("array<string>"))
