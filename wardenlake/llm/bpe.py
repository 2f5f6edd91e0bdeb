"""Encoding a corpus with a public byte-level BPE vocabulary.

Every pre-token is merged with a segment tree over its byte positions: a leaf holds the rank of the pair that
starts there, an inner node the smallest rank below it, the left one on ties. The root thus names the
leftmost pair of lowest rank; a merge updates the pairs of the two live neighbours and the dead position, each in
logarithmic time. A pre-token of n bytes costs O(n log n), also when it is one run of a
million equal signs.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-tokens whose ids a worker keeps; only speed depends on it.
CACHE = 200_000
NO_PAIR = 1 << 30


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of texts by a vocabulary of ranks, without special tokens (their strings are ordinary text)."""

    def __init__(self, vocabulary: str, pattern: str) -> None:
        import regex

        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks, n = self.ranks, len(piece)
        token = [piece[i : i + 1] for i in range(n)]
        if n == 1:
            return [ranks[piece]]
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NO_PAIR] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = ranks.get(piece[i : i + 2], NO_PAIR)
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a <= b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (low := tree[1]) < NO_PAIR:
            k = 1
            while k < width:
                k = 2 * k if tree[2 * k] == low else 2 * k + 1
            i = k - width
            j = after[i]
            token[i] += token[j]
            token[j] = b""
            nxt, prv = after[j], before[i]
            after[i] = nxt
            if nxt < n:
                before[nxt] = i
            changed = [(i, ranks.get(token[i] + token[nxt], NO_PAIR) if nxt < n else NO_PAIR)]
            if j < n - 1:
                changed.append((j, NO_PAIR))
            if prv >= 0:
                changed.append((prv, ranks.get(token[prv] + token[i], NO_PAIR)))
            for at, rank in changed:
                k = width + at
                tree[k] = rank
                while k > 1:
                    k >>= 1
                    a, b = tree[2 * k], tree[2 * k + 1]
                    low = a if a <= b else b
                    if tree[k] == low:
                        break
                    tree[k] = low
        return [ranks[t] for t in token if t]

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        for piece in self.split(text):
            got = known.get(piece)
            if got is None:
                got = self.merged(piece.encode("utf-8", "replace"))
                if len(known) >= CACHE:
                    known.clear()
                if len(piece) < 100:
                    known[piece] = got
            ids += got
        return ids


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder for each Python worker. The default vocabulary is found where the worker is, not where the driver is."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    if (vocabulary, pattern) not in _encoders:
        _encoders[vocabulary, pattern] = Encoder(vocabulary, pattern)
    return _encoders[vocabulary, pattern]


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def ids_column(text: Column, vocabulary: str | None = None, pattern: str | None = None) -> Column:
    """The token ids of a text column: an empty array for NULL and empty text, never NULL."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary, pattern)
        for texts in batches:
            yield pd.Series([enc.encode(t) if t else [] for t in texts], dtype=object)

    return run(text)


def count_column(text: Column, vocabulary: str | None = None, pattern: str | None = None) -> Column:
    """The number of tokens of a text column; 0 for NULL and empty text."""

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary, pattern)
        for texts in batches:
            yield pd.Series([len(enc.encode(t)) if t else 0 for t in texts], dtype="int64")

    # not to be run again, or before a repartition, for a filter on its result
    return run.asNondeterministic()(text)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(``id_col``, ids): the ids of every row's whole text.

    One row for each row, repeated ids included. NULL and empty texts have an empty array. Other columns are ignored.
    Rows are encoded where ``df`` has them; the operator itself shuffles nothing.
    """
    return df.select(F.col(id_col), ids_column(F.col(text_col), vocabulary).alias("ids"))
