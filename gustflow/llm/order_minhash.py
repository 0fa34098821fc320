"""Document fingerprints by order MinHash, in DataFrame functions only.

A text is cut into units: words, and every letter of a script that is written without spaces by itself.
A k-mer is a run of so many units. Each occurrence of a k-mer gets a number, counted from the text's
start, so that k-mers that repeat count as often as they come. A fingerprint has a fixed number of places;
each has two hash functions of its own over (k-mer, number). At a place the occurrence with the least hash
under each is selected, both are put back into the order that they have in the text, and hashed as a tuple. So a
fingerprint tells texts apart that have the same k-mers in another order, and its likeness falls with the
edit distance, not only with the change of a set.

Occurrences become rows, and a text's minima are plain aggregates over them: each row costs a hash and a comparison
for each function, in compiled code, whatever the number of places. What is compared carries its position: 43 bits of
hash, then 21 of the position (of texts beyond 2**21 units, of the position's part of the whole). Texts
themselves never travel with their k-mers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialise

#: Places of a fingerprint, and units of a k-mer.
PLACES, UNITS = 32, 2
#: Bits of a position beside a hash.
POSITION = 21
#: Rows of a range of ids that is put in order by one task, about.
RANGE_ROWS = 250_000

# Code points of scripts without spaces between words (Thai and Lao, Myanmar, Khmer, kana, Han).
_ALONE = r"฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\x{20000}-\x{3FFFF}"
_UNIT = rf"[^\x20\x09-\x0D{_ALONE}]+|[{_ALONE}]"


def _kmers(text: Column, units: int) -> Column:
    """(hash, position) of each k-mer of a text, sorted: equal ones are neighbours, in text order."""

    def of(found: Column) -> Column:
        first = F.sequence(F.lit(0), F.greatest(F.size(found) - units, F.lit(0)))
        made = F.transform(first, lambda i: F.struct(F.xxhash64(*(F.get(found, i + k) for k in range(units))).alias("h"), i.alias("at")))
        return F.when(F.size(found) > 0, F.sort_array(made)).otherwise(F.slice(F.sort_array(made), 1, 0))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_UNIT), F.lit(0)), of)


def _numbered(kmers: Column) -> Column:
    """Structs (x, at): the hash of each k-mer with its occurrence's number, and its position.

    Almost all k-mers come once; those that come again are put beside each other first, so that the r-th of a
    run has number r.
    """
    number = lambda k, r: F.struct(F.xxhash64(k["h"], r).alias("x"), k["at"].alias("at"))
    differs = lambda some, k, j: F.coalesce(F.get(some, j - 1)["h"] != k["h"], F.lit(True))

    def later(again: Column) -> Column:
        begins = F.filter(F.transform(again, lambda k, j: F.when(differs(again, k, j), j)), lambda j: j.isNotNull())
        runs = lambda begin: F.transform(
            begin,
            lambda b, r: F.transform(
                F.slice(again, b + 1, F.coalesce(F.get(begin, r + 1), F.size(again)) - b), lambda k, n: number(k, n + 1)
            ),
        )
        return F.flatten(let(begins, runs))

    def both(marked: Column) -> Column:
        firsts = F.transform(F.filter(marked, lambda k: k["first"]), lambda k: number(k, F.lit(0)))
        return F.concat(firsts, let(F.filter(marked, lambda k: ~k["first"]), later))

    marked = F.transform(kmers, lambda k, j: F.struct(k["h"].alias("h"), k["at"].alias("at"), differs(kmers, k, j).alias("first")))
    return let(marked, both)


def signatures(texts: DataFrame, keys: list[str], text: str = "text", places: int = PLACES, units: int = UNITS) -> DataFrame:
    """keys and bins (an array of ``places`` numbers, empty for a text without units) of each distinct value of the keys.

    Rows with equal keys must have equal texts. Null texts count as empty; equal texts have equal fingerprints. A
    text of fewer units than a k-mer's is one k-mer. Occurrences meet their key's others within a task before anything
    is shuffled: a row for each key goes on.
    """
    most = 1 << POSITION
    placed = let(
        let(_kmers(F.col(text), units), _numbered),
        lambda found: F.when(F.size(found) <= most, found).otherwise(
            F.transform(found, lambda k: F.struct(k["x"].alias("x"), (k["at"].cast("long") * most / F.size(found)).cast("int").alias("at")))
        ),
    )
    # outer: else Spark would compute the array once more, to leave out the empty ones
    rows = texts.select(*keys, F.inline_outer(placed))
    low = most - 1
    drawn = lambda j: F.xxhash64("x", F.lit(j)).bitwiseAND(F.lit(~low)).bitwiseOR(F.col("at").cast("long"))
    minima = rows.groupBy(*keys).agg(F.count("x").alias("_n"), *(F.min(drawn(j)).alias(f"_m{j}") for j in range(2 * places)))

    def in_order(a: Column, b: Column) -> Column:
        of = lambda v: F.shiftright(v, POSITION)
        first = a.bitwiseAND(F.lit(low)) <= b.bitwiseAND(F.lit(low))
        return F.when(first, F.xxhash64(of(a), of(b))).otherwise(F.xxhash64(of(b), of(a)))

    tuples = F.array(*(in_order(F.col(f"_m{2 * j}"), F.col(f"_m{2 * j + 1}")) for j in range(places)))
    return minima.select(*keys, F.when(F.col("_n") > 0, tuples).otherwise(F.array().cast("array<bigint>")).alias("bins"))


def as_text(bins: Column) -> Column:
    """A fingerprint as a string: its numbers in hexadecimal, parted by points; empty for none."""
    return F.array_join(F.transform(bins, lambda x: F.lower(F.hex(x))), ".")


def likeness(a: Column, b: Column) -> Column:
    """The share of places at which two fingerprints agree (1 if both are empty, 0 if one is)."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda n, x: n + x)
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(same / most)


def _successors(keys: DataFrame, order: list[str]) -> DataFrame:
    """keys (distinct rows) with ``_to``: a struct of the next row's columns in order, the first one's after the last.

    Rows are dealt over ranges of about RANGE_ROWS rows by their quantiles, whatever the gaps between them; each
    range is put in order by itself, and its last row goes on with the first one of the next range. The
    table of those has one row for each range.
    """
    parts = max(1, -(-keys.count() // RANGE_ROWS))
    ranged = materialise(keys.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    one = F.struct(*order)
    heads = ranged.groupBy("_range").agg(F.min(one).alias("_head"))
    by_range = Window.orderBy("_range")
    everything = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    onward = heads.select("_range", F.coalesce(F.lead("_head").over(by_range), F.first("_head").over(everything)).alias("_onward"))
    following = F.lead(one).over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_to", following)
        .join(F.broadcast(onward), "_range")
        .select(*keys.columns, F.when(F.col("_to").isNotNull(), F.col("_to")).otherwise(F.col("_onward")).alias("_to"))
    )


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, n_chars, edited, and the fingerprints bins, edited_bins and next_bins of each whole text.

    ``edited`` is the text with its last floor(n_chars / 4) code points replaced by the first as many
    (or all) of the next document's, by ascending id, the first one's after the last. Null texts count
    as empty, and an empty text has an empty fingerprint. Null ids come last; rows of one id are ordered by a
    hash of the text, so that repeated rows follow each other. A single document is its own next; an empty
    table gives no rows. Other columns are left out, whatever their names.

    A whole text is shuffled once, by its key. What goes on to the document before is no more of a text than
    that document's edit takes, and the fingerprint. Each text is fingerprinted once before and its
    edited text once after; fingerprints come back to the texts by the key, which both are partitioned by.
    """
    zero = F.lit("0").cast(docs.schema[doc].dataType)
    rows = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        "*",
        F.char_length("text").cast("long").alias("n_chars"),
        F.col("doc_id").isNull().alias("_null"),
        F.coalesce("doc_id", zero).alias("_id"),
        F.xxhash64("text").alias("_h"),
    )
    key = ["_null", "_id", "_h"]
    after = _successors(rows.select(*key, F.floor(F.col("n_chars") / 4).cast("int").alias("_cut")).distinct(), key)
    # the first of some equal rows is followed by the next document, any other one by its like
    asked = materialise(
        after.select(*(F.col(f"_to.{k}").alias(k) for k in key), F.lit(1).alias("_given"), "_cut", F.struct(*key).alias("_by"))
    )
    on = lambda prefix: reduce(Column.__and__, (F.col(k) == F.col(prefix + k) for k in key))
    named = lambda df, prefix: df.withColumnsRenamed({k: prefix + k for k in key})
    # all joins go by the key alone, so that whatever needs the texts reads one exchange of them
    texts = rows.select(*key, "text", "n_chars").withColumn("_copy", F.row_number().over(Window.partitionBy(*key).orderBy("n_chars")))
    one = named(asked.select(*key, "_given", "_cut", "_by"), "_of")
    by = [F.col(f"_by.{k}").alias(f"_b{k}") for k in key]
    begins = texts.join(one, on("_of") & (F.col("_copy") <= F.col("_given"))).select(*by, F.substring("text", F.lit(1), F.col("_cut")).alias("_begin"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    begin = F.coalesce("_begin", F.substring("text", F.lit(1), cut))
    met = texts.join(begins, on("_b") & (F.col("_copy") == 1), "left").select(
        *key, "_copy", "text", "n_chars", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), begin).alias("edited")
    )
    # the first of some equal rows has an edited text of its own, the others have one in common
    first = F.col("_copy") == 1
    edits = met.filter(F.col("_copy").isin(1, 2)).select(*key, first.alias("_first"), "edited")
    after_edit = signatures(edits, [*key, "_first"], "edited").withColumnRenamed("bins", "edited_bins")
    prints = signatures(rows, key)
    following = named(prints, "_p").join(one, reduce(Column.__and__, (F.col("_p" + k) == F.col("_of" + k) for k in key))).select(
        *by, F.col("bins").alias("next_bins")
    )
    out = met.join(named(prints, "_p"), on("_p")).join(following, on("_b") & first, "left").join(
        named(after_edit, "_e"), on("_e") & F.when(first, F.col("_first")).otherwise(~F.col("_first"))
    )
    return out.select(
        F.when(~F.col("_null"), F.col("_id")).alias("doc_id"), "text", "n_chars", "edited", "bins", "edited_bins", F.coalesce("next_bins", "bins").alias("next_bins")
    )
