"""Encoding of texts with a public byte-level BPE tokenizer.

The encoding of every prefix of a piece ends in exactly one token. So the last token of each prefix is found from left
to right: an automaton over the vocabulary gives the tokens that end at a byte, and the first of them (longest first)
that may stand after the last token of the prefix before it is the one. Whether two tokens may stand side by side is
tested by undoing their merges: no merge across their border may come before the merges that made them. The ids then
follow from the back-pointers. Linear in the bytes, whatever the piece.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_KEPT = 200_000  # pieces whose ids a worker remembers; only saves time


class ByteBpe:
    """A byte-level BPE vocabulary given as ranks; a token's rank is its id and the order of its merge."""

    def __init__(self, path: str):
        self.ids: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ids[base64.b64decode(token)] = int(rank)
        self.bytes = {i: t for t, i in self.ids.items()}
        self.pieces = regex.compile(PATTERN)
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.memory: dict[str, list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        for i in sorted(self.bytes):  # in merge order, so that a token's parts are ready before it
            token = self.bytes[i]
            if len(token) > 1:
                a, b = self._last_merge(token, i)
                self.parts[i] = (a, b)
                self.pairs[a, b] = i

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge made ``token``: the split into two tokens that may stand side by side before that merge."""
        for cut in range(len(token) - 1, 0, -1):
            a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
            if a is not None and b is not None and a < rank and b < rank and self._border_holds(a, b):
                return a, b
        raise ValueError(f"no merge makes the token {token!r}")

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a text that encodes to a, then b, by themselves encodes to a, b together."""
        key = (a, b)
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) > 4 * _KEPT:
                self.beside.clear()
            known = self.beside[key] = self._border_holds(a, b)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        limit = 1 << 62  # merges before this rank have been made on both sides
        parts, pairs = self.parts, self.pairs
        while True:
            across = pairs.get((left, right))
            if across is not None and across < limit:
                return False
            # Undo the later of the two merges at the border; at a tie the left one came first.
            rank_left = left if left in parts else -1
            rank_right = right if right in parts else -1
            if rank_left < 0 and rank_right < 0:
                return True
            if rank_left > rank_right:
                limit = rank_left
                left = parts[left][1]
            else:
                limit = rank_right + 1
                right = parts[right][0]

    def piece(self, data: bytes) -> list[int]:
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        last = [-1] * (n + 1)
        back = [0] * (n + 1)
        compatible = self._compatible
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - size
            if begin == 0 or last[begin] >= 0 and compatible(last[begin], token):
                last[end] = token
                back[end] = begin
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none of a NULL or empty one. Strings that look like special tokens are ordinary text."""
        out: list[int] = []
        if not text:
            return out
        memory = self.memory
        for piece in self.pieces.findall(text):
            ids = memory.get(piece)
            if ids is None:
                ids = self.piece(piece.encode("utf-8", "replace"))
                if len(piece) < 64:
                    if len(memory) > _KEPT:
                        memory.clear()
                    memory[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def tokenizer(folder: str = TOKENIZERS, name: str = VOCABULARY) -> ByteBpe:
    return ByteBpe(os.path.join(folder, name))


def encode_corpus(df: DataFrame, key: str, field: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row: the ids of its text by a byte-level BPE vocabulary, without special tokens.

    NULL and empty texts give an empty list, never a missing row; texts of any length are encoded whole; repeated rows
    and NULL keys are kept as they are; other columns are not read. Each text is encoded where it lies, no shuffle.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(folder, name)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [np.array(bpe.encode(t), "int32") for t in pdf["text"]]})

    kind = dict(df.dtypes)[key]
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{field}`").alias("text")).mapInPandas(encode, f"doc_id {kind}, ids array<int>")


def count_tokens(field: str, folder: str = TOKENIZERS, name: str = VOCABULARY):
    """A column with the number of tokens of ``field``; 0 for NULL and empty texts. A filter on it doesn't count again."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tokenizer(folder, name)
        for s in texts:
            yield s.map(lambda t: len(bpe.encode(t))).astype("int64")

    return count.asNondeterministic()(F.coalesce(F.col(field), F.lit("")))
