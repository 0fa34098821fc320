"""MinHash near-deduplication by a signature-coordinate inverted join.

Every document's set of word shingles gets a MinHash signature; documents with equal sets are one
class from then on. Classes are posted under each pair of a coordinate and its value. Two classes that are
similar enough have at least ``matches_of(percent)`` values in common (collisions).

Prefix: postings are ordered by the length of their list, shortest first, and a class goes on with the first
SIGNATURE - matches + 1 of its postings only; any two with enough collisions meet in one of those lists.
Lists of one member are the shortest of all, so text of a class's own uses the prefix up, and passages
that many documents share hardly ever get into it. Skip: collisions in the longer lists, behind the
prefix, are not merged but counted by looking at the two signatures, in the first common list only;
pairs that are known to be connected, or that too many shingles of their own keep apart, are skipped.
What has enough collisions is confirmed on the full sets, and components come from the confirmed links.

No list is ever paired with itself as a whole. First each of its members meets the list's pivots only.
That connects almost all of a large group of near copies; then only members outside the largest
component of their list meet the others of that list, in other components. A link that this leaves out
joins two classes that are connected without it, so components are those of all links. Lists that hold a
large part of all postings are dealt over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, columns_of, heavy_keys, materialise, private, salted_join

#: MinHash values of a signature, which are its coordinates.
SIGNATURE = 64
#: How often a link of just the least similarity may have too few collisions.
MISSED = 1e-5


def matches_of(percent: int) -> int:
    """Collisions that a pair needs: 41 of 64 at 85 percent, 36 at 80.

    The greatest number that a link of just that similarity falls short of less often than MISSED, by the
    binomial distribution; links of higher similarity do so less often still.
    """
    p, below, at = percent / 100, 0.0, 0
    while at < SIGNATURE:
        below += math.comb(SIGNATURE, at) * p**at * (1 - p) ** (SIGNATURE - at)
        if below > MISSED:
            break
        at += 1
    return at


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of so many words, A-Z in lower case.

    A text with fewer words is one shingle, one without words none.
    """
    import xxhash

    # bytes.lower and bytes.split know ASCII only: A-Z, and \\x20 \\x09-\\x0D
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts))
    width = min(words, len(parts))
    rolled = np.full(len(parts) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        rolled = _mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + each[k : k + len(rolled)])
    return np.unique(rolled)


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    a, b = (rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) for _ in range(2))
    return a * np.uint64(2) + np.uint64(1), b


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each permutation, mixed with its coordinate's number: equal
    numbers are equal coordinate-value pairs. Memory is bounded for long texts."""
    a, b = _permutations()
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[at : at + 1024, None] * a + b).min(axis=0))
    return _mixed(_mixed(least) + np.arange(SIGNATURE, dtype=np.uint64))


def _chunks(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """Batches in parts of a few rows, so that a task holds the results of those only."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def sketch(docs: DataFrame, words: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class (digest of the set; null if it is empty) and coordinates (the signature)."""

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for rows in _chunks(batches):
            out: list[tuple] = []
            for of, t in zip(rows["id"], rows["text"], strict=True):
                found = shingle_hashes(t, words)
                if not len(found):
                    out.append((of, 0, None, None))
                    continue
                out.append((of, len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), signature(found).view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "class", "coordinates"]).astype(
                {"doc_id": "Int64", "n_shingles": "int64"}
            )

    return docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(
        sketched, "doc_id long, n_shingles long, class binary, coordinates array<long>"
    )


def _sets(docs: DataFrame, needed: DataFrame, words: int, doc: str, text: str) -> DataFrame:
    """rep, set (array of shingle hashes) and n of the classes in ``needed`` (rep, class)."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for rows in _chunks(batches):
            out = []
            for rep, of, t in zip(rows["rep"], rows["class"], rows["text"], strict=True):
                found = shingle_hashes(t, words)
                if hashlib.blake2b(found.tobytes(), digest_size=16).digest() == bytes(of):  # an id may have other texts
                    out.append((rep, found.view(np.int64), len(found)))
            yield pd.DataFrame(out, columns=["rep", "set", "n"]).astype({"rep": "int64", "n": "int64"})

    # few classes go to the texts, of many the texts go to the classes
    few, _ = broadcast_if_small(needed)
    rows = docs.select(F.col(doc).cast("long").alias("rep"), F.col(text).alias("text")).join(few, "rep")
    return rows.mapInPandas(made, "rep long, set array<long>, n long").dropDuplicates(["rep"])


def _collisions(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of the ids in ``links`` (a, b).

    Links may come twice, in either direction or from an id to itself; the last say nothing, and an id that has
    no other link has no row. No links give no rows. Ids are not null.

    Edges are contracted round by round: every id goes to its least neighbour, edges inside a group
    vanish, and the rest is contracted again; the number of groups halves at least each round.
    """
    edges = materialise(links.select("a", "b").filter("a <> b").distinct())
    ids = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    labels = materialise(ids.withColumn("component", F.col("id")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m"))
        for _ in range(2):  # pointers to pointers
            further = least.select(F.col("v").alias("m"), F.col("m").alias("_n"))
            least = least.join(further, "m", "left").select("v", F.coalesce("_n", "m").alias("m"))
        least = materialise(least)
        labels = materialise(
            labels.join(least, labels.component == least.v, "left").select("id", F.coalesce("m", "component").alias("component"))
        )
        at_a = edges.join(least.select(F.col("v").alias("a"), F.col("m").alias("x")), "a", "left").select(F.coalesce("x", "a").alias("a"), "b")
        at_b = at_a.join(least.select(F.col("v").alias("b"), F.col("m").alias("y")), "b", "left").select("a", F.coalesce("y", "b").alias("b"))
        edges = materialise(at_b.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels


def near_duplicates(
    docs: DataFrame, percent: int = 85, words: int = 5, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of docs.

    Documents are linked if 100 * intersection >= percent * union of their sets of shingles;
    component_id is the least id reachable over links. kept: the id is its component's. Documents
    without words (null and empty texts) are linked with nothing. Rows of one id count as one document
    in the linking; a null id is linked with nothing, its component is null, and it is kept. An empty table
    gives no rows. The collisions that are needed follow from ``percent``.
    """
    drawn = materialise(sketch(docs, words, doc, text))
    named = drawn.filter(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialise(
        named.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("coordinates").alias("coordinates"))
    )
    label = components(_confirmed(docs, classes, percent, words, doc, text))
    # a class of one that is linked with nothing has its id for a component; only the others go back to their documents
    of_class = classes.join(label, F.col("rep") == F.col("id"), "left").filter((F.col("copies") > 1) | F.col("component").isNotNull())
    back = materialise(of_class.select("class", "copies", F.coalesce("component", "rep").alias("of")))
    often = materialise(heavy_keys(back, "class", "copies"))
    met = salted_join(named.select("doc_id", "n_shingles", "class"), back.drop("copies"), "class", often, "left", by="doc_id")
    others = drawn.filter(F.col("class").isNull() | F.col("doc_id").isNull())
    return (
        met.select("doc_id", "n_shingles", F.coalesce("of", "doc_id").alias("component_id"))
        .unionByName(others.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicate(docs: DataFrame, percent: int = 85, words: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that ``near_duplicates`` does not keep; all columns stay.

    Rows of one id are all kept or all gone, rows with a null id and texts without words stay. An empty table
    gives no rows.
    """
    of = f"{private(docs)}gone"
    gone = near_duplicates(docs, percent, words, doc, text).filter(~F.col("kept")).select(F.col("doc_id").alias(of)).distinct()
    return docs.join(gone, F.col(doc).cast("long") == F.col(of), "left_anti").select(*columns_of(docs))


def _postings(classes: DataFrame, matches: int) -> DataFrame:
    """rep and prefix: the keys of the lists, shortest first, in which a class meets those with enough collisions."""
    posted = classes.select(F.explode("coordinates").alias("key"), "rep")
    # counts first, summed before the shuffle: almost all lists have one member and need no join
    lists = materialise(posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    often = materialise(heavy_keys(lists, "key", "n"))
    shared = salted_join(posted, lists, "key", often, by="rep").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("lists"))
    # the lists of one come first: what they leave of the prefix
    left = F.size("lists") - F.lit(matches - 1)
    prefix = F.transform(F.slice("lists", 1, F.greatest(left, F.lit(0))), lambda x: x["key"])
    return shared.filter(left > 0).select("rep", prefix.alias("prefix"))


def _confirmed(docs: DataFrame, classes: DataFrame, percent: int, words: int, doc: str, text: str) -> DataFrame:
    """Links (a, b) between classes whose components are those of all links."""
    matches = matches_of(percent)
    postings = materialise(_postings(classes, matches))
    known = materialise(postings.join(classes, "rep").select("rep", "class", "prefix", "coordinates"))
    sets = materialise(_sets(docs, known.select("rep", "class"), words, doc, text))
    # shingles that no other member has bound every intersection; by 32 bits of the hash, so that two
    # that fall together only loosen the bound
    alone = (
        sets.select("rep", F.explode("set").alias("h"))
        .groupBy(F.shiftright("h", 32).cast("int").alias("h"))
        .agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
        .filter("n = 1")
        .groupBy("rep")
        .agg(F.count("*").alias("alone"))
    )
    facts = materialise(
        known.join(sets.select("rep", "n"), "rep")
        .join(alone, "rep", "left")
        .withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0)))
        .filter(100 * F.col("most") >= percent * F.col("n"))
        .select("rep", "prefix", "coordinates", F.struct("n", "most").alias("size"))
    )
    members = facts.select("rep", F.explode("prefix").alias("key"))
    lengths = materialise(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    often = materialise(heavy_keys(lengths, "key", "n"))
    members = materialise(salted_join(members, lengths.select("key"), "key", often, by="rep"))

    def possible(a: Column, b: Column) -> Column:
        most = F.least(a["most"], b["most"])
        return 100 * most >= percent * (a["n"] + b["n"] - most)

    def side(name: str, *columns: str) -> DataFrame:
        return facts.select(F.col("rep").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))

    def confirm(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"), F.col("n").alias("na"))
        right = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"), F.col("n").alias("nb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return (
            pairs.join(left, "a")
            .join(right, "b")
            .withColumn("both", both)
            .filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both")))
            .select("a", "b")
        )

    # two pivots a list: the member with the least share of shingles of its own, and one by hash
    sized = members.join(facts.select("rep", (1 - F.col("size.most") / F.col("size.n")).alias("own")), "rep")
    pivots = sized.groupBy("key").agg(
        F.min(F.struct("own", "rep")).alias("central"), F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep")).alias("any")
    )
    met = salted_join(members, pivots.select("key", F.array("central.rep", "any.rep").alias("pivots")), "key", often, by="rep")
    to_pivots = (
        met.select("rep", F.explode("pivots").alias("p"))
        .filter(F.col("rep") != F.col("p"))
        .select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b"))
        .distinct()
    )
    near = materialise(
        to_pivots.join(side("a", "coordinates", "size"), "a")
        .join(side("b", "coordinates", "size"), "b")
        .filter(possible(F.col("a_size"), F.col("b_size")) & (_collisions(F.col("a_coordinates"), F.col("b_coordinates")) >= matches))
        .select("a", "b")
    )
    first = materialise(confirm(near))
    now = members.join(components(first), F.col("rep") == F.col("id"), "left").select("key", "rep", F.coalesce("component", "rep").alias("of"))
    sizes = now.groupBy("key", "of").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.count("*").alias("groups"), F.max_by("of", F.struct("n", "of")).alias("main"))
    unsettled = materialise(largest.filter("groups > 1").select("key", "main"))
    rows = materialise(salted_join(now, unsettled, "key", often, by="rep").join(facts, "rep"))
    rest = rows.filter("of <> main").select(
        "key", F.col("rep").alias("r"), F.col("of").alias("r_of"), *(F.col(c).alias(f"r_{c}") for c in ("size", "prefix", "coordinates"))
    )
    first_common = F.get(F.array_intersect("prefix", "r_prefix"), F.lit(0))
    pairs = (
        salted_join(rows, rest, "key", often, by="rep")
        .filter(
            (F.col("r_of") != F.col("of"))
            & ((F.col("of") == F.col("main")) | (F.col("r") < F.col("rep")))
            & possible(F.col("size"), F.col("r_size"))
            & (_collisions(F.col("coordinates"), F.col("r_coordinates")) >= matches)
            & (first_common == F.col("key"))
        )
        .select(F.least("r", "rep").alias("a"), F.greatest("r", "rep").alias("b"))
        .distinct()
        .join(near, ["a", "b"], "left_anti")
    )
    return first.union(confirm(pairs))
