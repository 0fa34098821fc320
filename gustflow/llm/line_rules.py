"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, white space collapsed) and hashed; for each host the documents that
hold a line are counted; lines held by more documents of a host than its limit are removed; documents
that lose too much are rejected. A few rules on the document alone come before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, broadcast_if_small, columns_of, let, materialise, private, word_count

#: The symbols that n_symbols counts, and the white space between words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

#: Lines that a host's list may have, and pairs of host and line that all lists may hold, to be sent to
#: every task; beyond them the pairs go back to the documents by joins.
LISTED, PAIRS = 1_000, 200_000
#: Parts that the documents of a line are dealt over where pairs are too many to broadcast.
SALTS = 16


def words_of(text: Column) -> Column:
    """The words of a text in order (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), lambda w: w != "")


def placed_windows(words: Column) -> Column:
    """The 3-word windows of a text as structs (64-bit hash, position), sorted: equal ones are neighbours."""
    n = F.size(words)
    windows = F.slice(
        F.arrays_zip(words.alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c")), 1, F.greatest(n - 2, F.lit(0))
    )
    return F.sort_array(F.transform(windows, lambda w, i: F.struct(F.xxhash64(w).alias("h"), i.alias("p"))))


def covered_words(placed: Column) -> Column:
    """Words that lie in a window which comes twice or more, first included (long)."""
    repeated = F.filter(placed, lambda x, j: (x["h"] == F.get(placed, j - 1)["h"]) | (x["h"] == F.get(placed, j + 1)["h"]))
    return F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))).cast("long")


def lines_of(text: Column) -> Column:
    """The \\n-split lines of a text that hold a word (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD_CLASS))


def line_hash(line: Column) -> Column:
    """64-bit hash of a normalised line."""
    return F.xxhash64(F.lower(F.btrim(F.regexp_replace(line, f"{SPACE_CLASS}+", " "))))


def with_measures(docs: DataFrame, text: str) -> DataFrame:
    """docs with the measures on a document alone (long)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = f"{private(docs)}words"
    of_words = let(
        words_of(F.col(text)),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), let(placed_windows(w), covered_words).alias("repeated")),
    )
    return (
        docs.withColumn(words, of_words)
        .withColumns(
            {
                "n_words": F.col(f"{words}.n"),
                "word_chars": F.char_length(F.translate(whole, SPACES, "")).cast("long"),
                "n_symbols": (F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": let(lines_of(F.col(text)), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
                "n_repeat_words": F.col(f"{words}.repeated"),
            }
        )
        .drop(words)
    )


def held_lines(docs: DataFrame, host: str, text: str, *more: Column) -> DataFrame:
    """host, line (hash) and more: each row gives each of its lines once."""
    lines = F.explode(F.array_distinct(F.transform(lines_of(F.col(text)), line_hash)))
    return docs.select(F.col(host).alias("host"), *more, lines.alias("line"))


def frequent_lines(docs: DataFrame, host: str, text: str, doc: str, min_docs: int, share: float | None) -> DataFrame:
    """host, line: the lines held by more of a host's distinct documents than its limit.

    The limit is ``min_docs``; with a ``share``, that share of the host's documents if it is more. Rows of
    one id are one document; rows without an id are one if their texts are equal. Counts are of two
    steps, distinct documents by (host, line, document) and then sums before the shuffle, so a very common
    line is dealt over all tasks first and a row per task then.
    """
    of = F.xxhash64(F.col(doc), F.when(F.col(doc).isNull(), F.col(text))).alias("of")
    held = held_lines(docs, host, text, of).distinct()
    counts = held.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs)
    if share is None:
        return counts.select("host", "line")
    hosts = docs.select(F.col(host).alias("_host"), of).distinct().groupBy("_host").agg(F.count("*").alias("_docs"))
    over = counts.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).filter(F.col("n") > F.col("_docs") * F.lit(share))
    return over.select("host", "line")


def with_frequent(docs: DataFrame, frequent: DataFrame, host: str, text: str, hashes: str) -> DataFrame:
    """docs with their measures and ``hashes``: frequent lines of the host, all that the document holds among them.

    Short lists are broadcast, one a host. Otherwise each document gets the lines that it holds itself,
    under a hash of its row: rows whose hashes are equal share a list, which changes nothing, since a
    list has frequent lines of the host only.
    """
    own = private(docs)
    of, row, mine = f"{own}host", f"{own}row", f"{own}mine"
    lists = frequent.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n").alias("longest"), F.sum("n").alias("pairs")).first()
    if (lists["longest"] or 0) <= LISTED and (lists["pairs"] or 0) <= PAIRS:
        listed = frequent.groupBy(F.col("host").alias(of)).agg(F.sort_array(F.collect_list("line")).alias(hashes))
        return with_measures(docs, text).join(F.broadcast(listed), F.col(host).eqNullSafe(F.col(of)), "left").drop(of)
    kinds = [c for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant"))]
    docs = docs.withColumn(row, F.xxhash64(*(F.col("`" + c.replace("`", "``") + "`") for c in kinds)))
    held = held_lines(docs, host, text, F.col(row).alias("row"))
    pairs, few = broadcast_if_small(frequent.select(F.col("host").alias(of), F.col("line").alias("_line")), PAIRS)
    same = F.col("host").eqNullSafe(F.col(of)) & (F.col("line") == F.col("_line"))
    if not few:  # a very common line has a row for each document
        pairs = pairs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same &= F.pmod(F.col("row"), F.lit(SALTS)) == F.col("_salt")
    found = held.join(pairs, same).groupBy(of, F.col("row").alias(mine)).agg(F.collect_set("line").alias(hashes))
    met = F.col(host).eqNullSafe(F.col(of)) & (F.col(row) == F.col(mine))
    return with_measures(docs, text).join(found.hint("shuffle_hash"), met, "left").drop(of, row, mine)


def apply_rules(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    min_docs: int = 20,
    share: float | None = None,
    least_left: float = 0.3,
    doc: str = "doc_id",
) -> DataFrame:
    """docs with the document measures, base_failed, removed_words, clean_text and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows.
    clean_text: the text without lines (and lines without words stay) that are above the host's limit:
    ``min_docs`` distinct documents or, with a ``share``, that share of the host's if it is more;
    removed_words: the words of those. kept: not base_failed, and at least ``least_left`` of the words left.
    Null and empty texts have no words and fail the base rules; a null host is a host; repeated rows of one
    id count as one document and are all judged. A line held by just as many documents as the limit
    stays. An empty table gives no rows. Columns of docs named like the new ones give way. No text is
    shuffled unless a host's list or all pairs of host and line are too many to broadcast; then each text
    is shuffled once, to meet its own lines.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "clean_text", "kept")
    docs = docs.select(*columns_of(docs, made))
    hashes, judged = f"{private(docs)}hashes", f"{private(docs)}judged"
    frequent = materialise(frequent_lines(docs, host, text, doc, min_docs, share))
    joined = with_frequent(docs, frequent, host, text, hashes)
    whole = F.coalesce(F.col(text), F.lit(""))

    def judge(lines: Column) -> Column:
        """Words of the lines that go, and the lines that stay; each line is hashed and looked up once."""
        marked = F.transform(
            lines, lambda x: F.struct(x.alias("line"), (x.rlike(WORD_CLASS) & F.array_contains(F.col(hashes), line_hash(x))).alias("over"))
        )
        return let(
            marked,
            lambda m: F.struct(
                F.aggregate(F.filter(m, lambda x: x["over"]), F.lit(0).cast("long"), lambda n, x: n + word_count(x["line"])).alias("removed"),
                F.array_join(F.transform(F.filter(m, lambda x: ~x["over"]), lambda x: x["line"]), "\n").alias("clean"),
            ),
        )

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words") >= F.col("n_words") * F.lit(least_left)
    return (
        joined.withColumn(judged, F.when(F.col(hashes).isNotNull(), let(F.split(whole, "\n"), judge)))
        .withColumn("base_failed", failed)
        .withColumn("removed_words", F.coalesce(F.col(f"{judged}.removed"), F.lit(0).cast("long")))
        .withColumn("clean_text", F.when(F.col(text).isNotNull(), F.coalesce(F.col(f"{judged}.clean"), F.col(text))))
        .withColumn("kept", ~F.col("base_failed") & left)
        .drop(hashes, judged)
    )
