"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (by a hash), gone through ``epochs`` times at
most. A document's virtual finish time is the tokens of its source up to and with it, divided by the
source's weight. All queues are served in the order of finish times until the total budget is spent:
documents go to ranges of virtual time, ranges before the one where the budget ends are taken whole,
and only that one is sorted. A source that runs out leaves its share to the others in proportion to
their weights, which is what the targets (water-filling under the caps) say as well. A source whose next
document was too long to fit gets one that comes closest to what it lacks instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, columns_of, materialise, private, word_count

#: Ranges of virtual time; the work of the last sort is a part of so many of the whole.
RANGES = 4096
#: Documents of a bucket of a source's shuffled order, about; no task sorts a whole source.
BUCKET_ROWS = 512


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """source, source_size, weight and target of each source, from one row (source, source_size) each.

    Weights go to the sources in code point order (null last), again and again. Targets share
    ``share`` times the sum of sizes by weight; none exceeds ``epochs`` times its source's size.
    There is one row per source, so the two windows over all sources are small beside the documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("double")).withColumn(
        "_cap", F.col("source_size") * float(epochs)
    )
    # If the sources whose caps are lowest against their weights are full, the rest stand at _level.
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = (
        weighted.withColumn("_budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_open"))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
    )
    level = F.min_by(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level")), F.when(F.col("_ratio") >= F.col("_level"), F.col("_ratio"))).over(everything)
    return filled.withColumn(
        "target", F.least(F.col("_cap"), F.coalesce(F.col("weight") * level, F.col("_cap")))
    ).select("source", "source_size", "weight", "target")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    epochs: int = 2,
    doc: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """docs with size, source_size, target, copies and taken.

    size: words of the text (null: 0). copies: how often the mix holds the document (0 to ``epochs``);
    taken: copies * size. Documents are shuffled by a hash of id and text, so reruns agree; rows alike
    in both are taken alike. A null source is a source of its own, after the others; a null id is hashed like
    any other. Entries that finish together are served by source, hash and round. An empty table gives no
    rows; a table without words takes nothing of it but empty texts' copies of size 0. Columns of docs with
    these names give way.

    Only (source, hash, size) is shuffled, never a text, and a hot source is cut into buckets of its
    shuffled order. What comes back to the documents is one row per source: the hash up to which each
    round takes it; it is broadcast if there are few sources, else joined under salts.
    """
    key = F.xxhash64(F.col(doc), F.col(text))
    narrow = materialise(docs.select(F.col(source).alias("source"), key.alias("key"), word_count(F.col(text)).alias("size")))
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, share, epochs))
    ends = materialise(_ends(narrow, targets, share, epochs))
    end = [f"_end{e}" for e in range(epochs)]
    rounds = lambda key: sum(F.coalesce((key <= F.col(c)).cast("int"), F.lit(0)) for c in end)
    cut = materialise(
        targets.join(ends, _same(targets.source, ends.source), "left").select(
            targets.source.alias("_source"), "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("_taken"), *end
        )
    )
    # what a source lacks, for its next document was too long, one other document may make up
    lacking = cut.filter(F.col("_taken") < F.col("target"))
    gap = F.col("target") - F.col("_taken")
    off = F.abs(F.col("size") - gap)
    # rows alike in the key are one document here too: they are taken together, so their sizes count together
    fillers = (
        _with_source(narrow, lacking, "source", F.col("key"))
        .filter((rounds(F.col("key")) < epochs) & (F.col("size") < 2 * gap))
        .groupBy("source", "key", "target", "_taken")
        .agg(F.sum("size").alias("size"))
        .filter(off < gap)
        .groupBy("source")
        .agg(F.min(F.struct(off.alias("off"), F.col("key").alias("key"))).alias("_f"))
        .select(F.col("source").alias("_fs"), F.col("_f.key").alias("_filler"))
    )
    chosen = materialise(
        cut.join(fillers, _same(F.col("_source"), F.col("_fs")), "left").select("_source", "source_size", "target", "_filler", *end)
    )
    own = private(docs)
    mine = f"{own}key"
    renamed = chosen.select(
        F.col("_source").alias(f"{own}source"), "source_size", "target", F.col("_filler").alias(f"{own}filler"), *(F.col(c).alias(f"{own}{c}") for c in end)
    )
    kept = columns_of(docs, ("size", "source_size", "target", "copies", "taken"))
    keyed = docs.select(*kept, word_count(F.col(text)).alias("size"), key.alias(mine))
    served = sum(F.coalesce((F.col(mine) <= F.col(f"{own}{c}")).cast("int"), F.lit(0)) for c in end)
    filled = F.coalesce((F.col(mine) == F.col(f"{own}filler")).cast("int"), F.lit(0))
    return (
        _with_source(keyed, renamed, source, F.col(mine), "left", own)
        .withColumn("copies", (served + filled).cast("int"))
        .withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
        .select(*kept, "size", "source_size", "target", "copies", "taken")
    )


def _with_source(rows: DataFrame, sources: DataFrame, source: str, key: Column, how: str = "inner", own: str = "_") -> DataFrame:
    """rows with the columns of their source (named ``own`` and source): few sources are broadcast, many joined under salts."""
    small, few = broadcast_if_small(sources)
    named, of, salt = f"{own}source", f"{own}of", f"{own}salt"
    if few:
        return rows.join(small, _same(F.col(source), F.col(named)), how).drop(named)
    salts = 64
    salted = sources.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn(of, F.pmod(key, F.lit(salts)).cast("int"))
    return dealt.join(salted, _same(F.col(source), F.col(named)) & (F.col(of) == F.col(salt)), how).drop(named, of, salt)


def _ends(narrow: DataFrame, targets: DataFrame, share: float, epochs: int) -> DataFrame:
    """source, _taken (words) and _end<round>: the greatest key that the budget reaches in it (null: none)."""
    docs = narrow.count()
    bits = max(1, min(40, (docs // BUCKET_ROWS).bit_length()))
    bucketed = narrow.withColumn("bucket", F.shiftright("key", 64 - bits))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")
    )
    # rows alike in the key are one entry: the frame takes them in together
    within = Window.partitionBy("source", "bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    queued = (
        bucketed.withColumn("_within", F.sum("size").over(within))
        .join(offsets, _same(F.col("source"), F.col("_s")) & (F.col("bucket") == F.col("_b")))
        .withColumn("_upto", F.col("_before") + F.col("_within"))
        .select("source", "key", "size", "_upto")
    )
    dims = targets.select(F.col("source").alias("_s"), "source_size", "weight")
    rounds = F.explode(F.array(*(F.lit(e) for e in range(epochs))))
    entries = (
        queued.join(dims, _same(F.col("source"), F.col("_s")))
        .withColumn("round", rounds)
        .withColumn("finish", (F.col("_upto") + F.col("round") * F.col("source_size")) / F.col("weight"))
    )
    latest = targets.agg(F.max(F.col("source_size") * epochs / F.col("weight")).alias("m")).first()["m"] or 1.0
    total = targets.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    budget = share * total
    width = max(latest, 1.0) / RANGES
    ranged = materialise(
        entries.select("source", "key", "size", "round", "finish").withColumn("range", F.floor(F.col("finish") / width))
    )
    # the range where the budget ends: at most RANGES + 1 rows
    histogram = ranged.groupBy("range").agg(F.sum("size").alias("_sum"))
    running = histogram.withColumn("_upto", F.sum("_sum").over(Window.orderBy("range")))
    last = running.filter(F.col("_upto") > budget).orderBy("range").limit(1).select("range", (F.col("_upto") - F.col("_sum")).alias("before")).first()
    if last is None:
        taken = ranged
    else:
        crossing = (
            ranged.filter(F.col("range") == last["range"])
            .withColumn("_run", F.sum("size").over(Window.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "key", "round")))
            .filter(F.col("_run") + last["before"] <= budget)
            .drop("_run")
        )
        taken = ranged.filter(F.col("range") < last["range"]).unionByName(crossing)
    return taken.groupBy("source").agg(
        F.sum("size").alias("_taken"), *(F.max(F.when(F.col("round") == e, F.col("key"))).alias(f"_end{e}") for e in range(epochs))
    )
