"""Encoding and decoding by byte-pair merging with identifiers.

A word's symbols form a doubly linked list. A priority queue holds the merges that adjacent symbols allow,
by rank and then by place; the least is popped and done, unless one of its two symbols has meanwhile been
merged into another (a stale entry, which is skipped). So n symbols cost O(n log n), however long the word.
Decoding concatenates the strings that the vocabulary has for the identifiers.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private

#: Words and parts of texts that a worker remembers in each of two generations, and the longest of them: its memory's bound.
WORDS, PARTS, LONGEST = 250_000, 100_000, 64
#: Characters of a text that are looked up at once.
STRETCH = 1 << 20
#: A Latin-1 part in lower case of letters, then marks but the apostrophe, which may begin a word of its own.
_WORD_AND_MARKS = re.compile(r"([a-z\u00DF-\u00F6\u00F8-\u00FF]*)([!-&(-/:-@\[-`{-~]*)")


class _Remembered(dict):
    """A dictionary that computes what it lacks; what was not asked for lately goes when it is full."""

    def __init__(self, compute: Callable[[str], bytes], most: int):
        super().__init__()
        self.compute, self.most = compute, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= LONGEST:  # longer ones hardly come twice
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Identifiers of texts under a word-wise tokenizer file, and texts of identifiers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec["decoder"] is not None or spec["post_processor"] is not None or model["byte_fallback"]:
            raise ValueError("only files that decode by joining the vocabulary's strings are known here")
        library = Tokenizer.from_file(path)
        # Unicode's classes and case rules differ between versions, so normal form and words are the file's own
        self.normal = library.normalizer.normalize_str
        self.words = library.pre_tokenizer.pre_tokenize_str
        self.vocabulary: dict[str, int] = model["vocab"]
        self.ending: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        id_of = self.vocabulary
        self.rank_of = {id_of[a] << 32 | id_of[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.joined = [id_of[a + b] for a, b in model["merges"]]
        self.strings = [""] * (1 + max([*id_of.values(), *self.special.values()]))
        for text, number in (id_of | self.special).items():
            self.strings[number] = text
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {c: byte_level(chr(c))[0][0] for c in range(0xDF, 0x100) if chr(c).isalpha()}
        self.by_word = _Remembered(lambda word: array("i", self.merged(word)).tobytes(), WORDS)
        self.by_part = _Remembered(lambda part: self._part(part) if part else b"", PARTS)

    def merged(self, word: str) -> list[int]:
        """Identifiers of a word of byte symbols: merges by a queue of ranks over a linked list."""
        id_of, rank_of, joined = self.vocabulary, self.rank_of.get, self.joined
        part = [id_of[s] for s in word[:-1]]
        part.append(id_of[word[-1] + self.ending])
        n = len(part)
        allowed = [rank_of(a << 32 | b, -1) for a, b in zip(part, part[1:], strict=False)]  # by the pair at i and after[i]
        allowed.append(-1)
        queue = [rank << 32 | i for i, rank in enumerate(allowed) if rank >= 0]
        if not queue:
            return part
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while queue:
            entry = pop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            if allowed[i] != rank:
                continue  # stale: one of the two has been merged meanwhile
            j = after[i]
            part[i] = whole = joined[rank]
            part[j] = allowed[j] = allowed[i] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                allowed[i] = rank = rank_of(whole << 32 | part[k], -1)
                if rank >= 0:
                    push(queue, rank << 32 | i)
            h = before[i]
            if h >= 0:
                allowed[h] = rank = rank_of(part[h] << 32 | whole, -1)
                if rank >= 0:
                    push(queue, rank << 32 | h)
        return [p for p in part if p >= 0]

    def _part(self, part: str) -> bytes:
        """Identifiers of a part between spaces or line breaks, as 32-bit integers."""
        plain = _WORD_AND_MARKS.fullmatch(part.lower()) if max(part) < "\u0100" else None
        if plain:  # letters are one word and marks another; normal form and lower case are Python's too
            words = [w.translate(self.letters) for w in plain.groups() if w]
        else:
            words = [w for w, _ in self.words(self.normal(part))]
        return b"".join([self.by_word[w] for w in words])

    def _stretch(self, text: str) -> bytes:
        # no word spans white space, and neither normal form nor lower case looks across a space or line break
        return b"".join(map(self.by_part.__getitem__, text.replace("\n", " ").split(" ")))

    def encode(self, text: str | None) -> bytes:
        """Identifiers of a whole text as 32-bit integers; strings of special tokens are those tokens."""
        if not text:
            return b""
        out = []
        for k, piece in enumerate(self.at_special.split(text)):
            if k % 2:
                out.append(array("i", [self.special[piece]]).tobytes())
                continue
            at = 0
            while at < len(piece):
                end = at + STRETCH
                if end < len(piece):  # a stretch ends at a space
                    end = piece.find(" ", end) + 1 or len(piece)
                out.append(self._stretch(piece[at:end]))
                at = end
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary's strings of the identifiers, parted by spaces, as the file has no decoder of its own."""
        strings = self.strings
        return " ".join([strings[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    return Codec(path)


def _lists(found: list[bytes]) -> pa.Array:
    """Arrow lists of 32-bit integers of the given byte strings."""
    ends = np.cumsum([0, *(len(f) // 4 for f in found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))


def encoded(text: Column, path: str) -> Column:
    """array<int> of the identifiers of a text column, null as empty: no special tokens added."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(path)
        for texts in batches:
            yield _lists([codec.encode(t.as_py()) for t in texts])

    return ids(text)


def decoded(ids: Column, path: str) -> Column:
    """The text (string) that a column of identifiers stands for; null counts as no identifiers."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(path)
        for lists in batches:
            yield pa.array([codec.decode(one.values.to_numpy(zero_copy_only=False)) if one.is_valid else "" for one in lists], pa.string())

    return texts(ids)


def coded(text: Column, path: str) -> Column:
    """struct<ids: array<int>, decoded: string> of a text column: ``encoded`` and ``decoded`` in one pass of one worker."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(path)
        for texts in batches:
            found = [codec.encode(t.as_py()) for t in texts]
            back = pa.array([codec.decode(np.frombuffer(f, "<i4")) for f in found], pa.string())
            yield pa.StructArray.from_arrays([_lists(found), back], ["ids", "decoded"])

    return both(text)


def encode_and_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids (array<int>), n_tokens (long) and decoded (string) of each whole text.

    Null and empty texts have no identifiers and decode to the empty string. Rows, however often they repeat,
    and all other columns stay; columns of docs named like the results give way. An empty table gives no
    rows. Nothing is shuffled; a task holds one batch of texts and a bounded memory of parts.
    """
    own = private(docs) + "coded"
    both = docs.withColumn(own, coded(F.col(text), path))
    made = {"ids": F.col(f"{own}.ids"), "n_tokens": F.size(f"{own}.ids").cast("long"), "decoded": F.col(f"{own}.decoded")}
    return both.withColumns(made).drop(own)
