"""Packing by power-of-two decomposition.

A document of n token ids (its text's ids and one closing id) is cut into n // longest pieces of the
longest length and then into the powers of two that make up the rest, longest first. Every piece is a
sequence of its own, so no sequence holds parts of two documents and none is padded; sequences of one
length share a bucket, which is what a trainer batches.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, let, private, slices

#: Words that a worker remembers before it starts afresh; bounds its memory.
REMEMBERED = 300_000
#: Classes of Latin-1 bytes: letters and digits "a", white space " ", all else ".".
_CLASSES = bytes(
    b"a"[0] if chr(i).isalnum() else b" "[0] if chr(i).isspace() and not 0x1C <= i <= 0x1F else b"."[0] for i in range(256)
)
_WORD_AND_MARKS = re.compile(r"([a-z]+)([^\sa-zA-Z0-9']+)")


class TokenIds:
    """The ids of texts under a word-wise tokenizer file, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and no token spans it, so parts of a text between spaces or line
    breaks are encoded once and looked up from then on. White space of other kinds stays inside a part
    and is left to the tokenizer, as are the strings of special tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merged = self.tokenizer.model.tokenize
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {c: byte_level(chr(c))[0][0] for c in range(128, 256) if chr(c).isalpha()}
        self.known: dict[str, bytes] = {}

    def _parts(self, text: str) -> list[str]:
        """A text's parts. In a Latin-1 text without special tokens lower case is the tokenizer's; there,
        if no two marks stand together, full stops and commas are parts, as they are tokens, of their own."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            if "<|" not in text:
                text = text.lower()
                if b".." not in raw.translate(_CLASSES):
                    text = text.replace(".", " . ").replace(",", " , ")
        return text.replace("\n", " ").split(" ")

    def _word(self, part: str) -> bytes:
        merged = self.merged(part if part.isascii() else part.translate(self.letters))
        return struct.pack(f"<{len(merged)}I", *[t.id for t in merged])

    def _encoded(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        other, marks = [], {}
        for part in parts:
            # lower-case Latin-1 letters are one run to the tokenizer: it would only merge their bytes
            if part.isalpha() and part.islower() and max(part) < "\u0100":
                yield part, self._word(part)
            elif part.isascii() and (m := _WORD_AND_MARKS.fullmatch(part)):
                marks.setdefault(m[2], []).append(m[1])
            else:
                other.append(part)
        ids = self.tokenizer.encode_batch_fast(other + list(marks), add_special_tokens=False)
        packed = [struct.pack(f"<{len(found.ids)}I", *found.ids) for found in ids]
        yield from zip(other, packed, strict=False)
        for (mark, words), after in zip(marks.items(), packed[len(other) :], strict=True):
            for word in words:
                yield word + mark, self._word(word) + after

    def of(self, texts: list[str]) -> list[bytes]:
        parted = list(map(self._parts, texts))
        known = self.known
        new = list(set().union(*parted).difference(known))
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set().union(*parted))
        known.update(self._encoded(new))
        found = [b"".join(map(known.__getitem__, parts)) for parts in parted]
        for part in new:
            if len(part) > 64:  # hardly comes twice
                del known[part]
        return found


@lru_cache(maxsize=2)
def _token_ids(path: str) -> TokenIds:
    return TokenIds(path)


def token_ids(text: Column, path: str, closing_id: int) -> Column:
    """Ids of a text column with the closing id, as little-endian unsigned 32-bit binary."""
    end = closing_id.to_bytes(4, "little")

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = _token_ids(path)
        for texts in batches:
            yield pd.Series([x + end for some in slices(texts.tolist()) for x in ids.of(some)], dtype="object")

    return encoded(text)


def cuts(n: Column, longest: int) -> Column:
    """Structs (start, length) of the pieces of n ids: whole longest pieces, then the rest's powers of two."""
    whole = F.when(n >= longest, F.sequence(F.lit(0).cast("long"), (n / longest).cast("long") - 1)).otherwise(
        F.array().cast("array<long>")
    )
    rest = n % longest
    powers = [1 << k for k in reversed(range((longest - 1).bit_length()))]
    long_pieces = F.transform(
        whole, lambda k: F.struct((k * longest).alias("start"), F.lit(longest).cast("long").alias("length"))
    )
    short_pieces = F.array(
        *(
            F.when(
                rest.bitwiseAND(p) != 0,
                # before this piece come the long ones and the larger powers of the rest
                F.struct((n - rest % (2 * p)).alias("start"), F.lit(p).cast("long").alias("length")),
            )
            for p in powers
        )
    )
    return F.concat(long_pieces, F.array_compact(short_pieces))


#: A bucket's pieces are dealt over so many cells, and numbered in each; bits of a piece's number in its cell.
CELLS, _NUMBER = 1 << 20, 37


def pack(docs: DataFrame, path: str, closing_id: int = 1, longest: int = 2048, text: str = "text") -> DataFrame:
    """One row per piece of each document.

    Columns: those of docs but the text, then start, length, doc_tokens (long), input_ids (binary,
    the piece's ids as little-endian unsigned 32-bit), bucket (log2 of length), sequence_id (one per
    piece, ordered by bucket, unique) and offset (0: a piece begins its sequence). Columns of docs
    with these names give way. A null or empty text is the closing id alone: one piece of length 1.
    Repeated rows are packed as often as they come; an empty table gives no rows. ``longest`` must be a
    power of two.

    A document's ids are cut before its pieces become rows, so work and memory grow with its length. One
    shuffle brings pieces of one length together: each bucket is parted by a hash of the piece into
    cells, and a piece's number is its place in its cell, the same however rows were dealt before.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    made = ("start", "length", "doc_tokens", "input_ids", "bucket", "sequence_id", "offset")
    own = private(docs)
    kept = columns_of(docs, (*made, text))
    ids, hashed, cell = f"{own}ids", f"{own}hash", f"{own}cell"
    # maps have no hash and variants none either; rows that differ in those alone are numbered as they come
    by = [c for c, kind in docs.dtypes if c.lower() not in made and c != text and not re.search("map<|variant", kind)]
    tokens = docs.select(*kept, token_ids(F.col(text), path, closing_id).alias(ids)).withColumn(
        "doc_tokens", (F.octet_length(ids) / 4).cast("long")
    )
    # let: a column's bytes would be copied for each piece, a variable's are not
    cut = let(
        F.col(ids),
        lambda raw: F.transform(
            cuts(F.col("doc_tokens"), longest),
            lambda c: F.struct(
                c["start"].alias("start"),
                c["length"].alias("length"),
                F.substring(raw, (c["start"] * 4 + 1).cast("int"), (c["length"] * 4).cast("int")).alias("input_ids"),
            ),
        ),
    )
    pieces = tokens.select(*kept, "doc_tokens", F.inline(cut))
    bucket = sum((F.col("length") >= (1 << k)).cast("int") for k in range(1, longest.bit_length()))
    keyed = pieces.withColumn("bucket", bucket.cast("int")).withColumn(
        hashed, F.xxhash64(*(F.col("`" + c.replace("`", "``") + "`") for c in by), "start", "input_ids")
    )
    place = F.row_number().over(Window.partitionBy("bucket", cell).orderBy(hashed)) - 1
    number = F.shiftleft(F.col("bucket").cast("long"), 57) + F.shiftleft(F.col(cell), _NUMBER) + place
    return (
        keyed.withColumn(cell, F.pmod(hashed, F.lit(CELLS)))
        .withColumn("sequence_id", number)
        .select(*kept, "start", "length", "doc_tokens", "input_ids", "bucket", "sequence_id", F.lit(0).cast("long").alias("offset"))
    )
