"""Token counts by heap-and-linked-list byte-pair merging.

A text's token count is the number of its byte symbols minus the merges done on them; token
identifiers are never formed. Merging pops the adjacent pair of the lowest rank (leftmost first)
from a heap and joins it in a linked list, so a run of n symbols costs O(n log n) however long it is.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries that a worker remembers of words and of runs before it starts afresh; bounds its memory.
REMEMBERED = 400_000


class Merges:
    """The merge list of a vocabulary: ranks of pairs and what they join to, by symbol codes.

    A symbol's code is private to this object: the byte symbols come first, then joined ones.
    """

    def __init__(self, merges: list[list[str]]):
        self.code: dict[str, int] = {}
        self.rank_of: dict[int, int] = {}
        self.joined: list[int] = []
        code = lambda symbol: self.code.setdefault(symbol, len(self.code))
        for rank, (left, right) in enumerate(merges):
            self.rank_of[code(left) << 32 | code(right)] = rank
            self.joined.append(code(left + right))

    def merged_length(self, symbols: str) -> int:
        """Symbols left when no adjacent pair of ``symbols`` has a rank any more."""
        n = len(symbols)
        if n < 2:
            return n
        rank_of, joined, known = self.rank_of, self.joined, self.code
        part = [known.get(s, -1) for s in symbols]
        heap = []
        left = part[0]
        for i in range(n - 1):
            right = part[i + 1]
            rank = rank_of.get(left << 32 | right)
            if rank is not None:
                heap.append(rank << 32 | i)
            left = right
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges = 0
        while heap:
            entry = pop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or part[i] < 0 or rank_of.get(part[i] << 32 | part[j]) != rank:
                continue  # one of the two was merged into another pair meanwhile
            part[i] = whole = joined[rank]
            part[j] = -1
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (rank := rank_of.get(whole << 32 | part[k])) is not None:
                    push(heap, rank << 32 | i)
            if (h := before[i]) >= 0 and (rank := rank_of.get(part[h] << 32 | whole)) is not None:
                push(heap, rank << 32 | h)
        return n - merges


class _Remembered(dict):
    """A dictionary that computes what it lacks and empties itself when full."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(key) <= 64:  # longer keys hardly come twice
            self[key] = value
        return value


class TokenCounter:
    """Counts the tokens of texts under one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # Unicode classes of the pattern differ between regex libraries' Unicode versions, so the
        # split into runs and their byte symbols come from the vocabulary's own pre-tokenizer.
        self.runs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.space = self.runs(" ")[0][0]
        self.by_run = _Remembered(Merges(spec["model"]["merges"]).merged_length)
        self.by_chunk = _Remembered(self._chunk)

    def _plain(self, text: str) -> int:
        return sum(self.by_run[run] for run, _ in self.runs(text))

    def _chunk(self, chunk: str) -> int:
        # a chunk after a line break keeps that break, any other chunk stands after one space
        if chunk.isascii():
            if chunk.isalpha():
                return self.by_run[self.space + chunk]
            if chunk[-1] in ".," and chunk[:-1].isalpha():
                return self.by_run[self.space + chunk[:-1]] + 1
        return self._plain(chunk if chunk[:1] == "\n" else " " + chunk)

    def _segment(self, text: str) -> int:
        # When words are parted by single spaces or line breaks only, no run reaches over such a
        # parting (a run takes one space before it at most), so words can be counted one by one.
        if text.split() == text.replace("\n", " ").split(" "):
            first, *rest = text.replace("\n", " \n").split(" ")
            return self._plain(first) + sum(map(self.by_chunk.__getitem__, rest))
        return self._plain(text)

    def count(self, text: str | None) -> int:
        """Tokens of a text; strings of special tokens in it count as that one token."""
        if not text:
            return 0
        if not self.special or not any(s in text for s in self.special):
            return self._segment(text)
        parts = self.at_special.split(text)  # every second one is a special string
        return len(parts) // 2 + sum(self._segment(s) for s in parts[::2] if s)


@lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def n_tokens(text: Column, path: str) -> Column:
    """Tokens of a text column (long) under the vocabulary file ``path``, null as empty."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _counter(path).count
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each whole text.

    Null and empty texts have 0 bytes and 0 tokens. Rows, their order of repetition and all other
    columns stay; columns of docs named like the three results give way to them. Long texts cost
    O(n log n). Only the text travels to Python; nothing is shuffled.
    """
    return docs.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
            "n_tokens": n_tokens(F.col(text), path),
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)
