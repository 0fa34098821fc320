"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scan import materialise  # noqa: F401  (the operators take it from here)

#: Words of the contracts: runs of anything but space and \t \n \v \f \r.
WORD_CLASS = r"[^\x20\x09-\x0D]"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private(df: DataFrame) -> str:
    """A beginning that no column of df has, for columns of one's own beside them."""
    names = [c.lower() for c in df.columns]
    prefix = "_own_"
    while any(c.startswith(prefix) for c in names):
        prefix = "_" + prefix
    return prefix


def columns_of(df: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """df's columns but those named ``but`` (in any case), whatever characters their names have."""
    left_out = {b.lower() for b in but}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in left_out]


#: Keys that are dealt over several tasks in ``salted_join``, and over how many.
HEAVY, SALTS = 4096, 32


def heavy_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """The HEAVY most frequent keys: any other has at most one part in HEAVY of all rows."""
    return counts.orderBy(F.desc(n)).limit(HEAVY).select(F.col(key).alias("_heavy"))


def salted_join(rows: DataFrame, lists: DataFrame, key: str, heavy: DataFrame, how: str = "inner", by: str | None = None) -> DataFrame:
    """rows joined with lists by a key (not null) that may be very frequent in rows.

    Rows of heavy keys (a column ``_heavy``, HEAVY of them at most, so they are broadcast) are dealt over SALTS
    parts by a hash of ``by`` (default: of all their columns), and the rows of lists with such keys stand in
    each part. Columns of the two but the key must differ.
    """
    few = F.broadcast(heavy)
    salt = F.pmod(F.xxhash64(*([by] if by else rows.columns)), F.lit(SALTS)).cast("int")
    dealt = rows.join(few, rows[key] == few["_heavy"], "left").withColumn(
        "_salt", F.when(F.col("_heavy").isNotNull(), salt).otherwise(F.lit(0))
    ).drop("_heavy")
    everywhere = F.when(F.col("_heavy").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = lists.join(few, lists[key] == few["_heavy"], "left").withColumn("_salt", F.explode(everywhere)).drop("_heavy")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(parts))


def word_count(text: Column) -> Column:
    """Number of words (long); null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD_CLASS}+")), F.lit(0)).cast("long")


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if it has at most so many rows; df must be cheap to count (materialised)."""
    small = df.count() <= rows
    return (F.broadcast(df) if small else df), small


def chance(*keys: str) -> Column:
    """A number in [0, 1) drawn from the keys' hash: the same in every run and partitioning."""
    return F.pmod(F.xxhash64(*keys), F.lit(1_000_003)) / F.lit(1_000_003.0)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, limit: int, longest: int, inputs: list[str], parts: int = 5, doc: str = "doc_id"
) -> list[dict]:
    """About ``limit`` labelled rows to learn from, in an order that is the same in every run.

    Only ids whose crc32 modulo ``parts`` is not 0 are drawn, each with the chance that makes up the
    limit; rows of one id count once (the least of them), and the greatest of contradicting labels.
    Texts of more than ``longest`` characters are no examples. So the driver gets about ``limit`` rows
    of so many characters at most, however large the tables.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull() & (fold(doc, parts) != 0))
    usable = usable.groupBy(doc).agg(F.max(label).alias("_label"))
    rate = limit / max(1, usable.count())
    chosen = usable.filter(chance(doc) < rate)
    rows = (
        docs.filter(F.coalesce(F.char_length("text"), F.lit(0)) <= longest)
        .select(doc, F.struct(*inputs).alias("_row"))
        .join(F.broadcast(chosen), doc)  # about ``limit`` rows
        .groupBy(doc, "_label")
        .agg(F.min("_row").alias("_row"))
    )
    found = rows.select(F.col("_label").alias("label"), "_row.*", F.xxhash64(doc).alias("_at")).toArrow().to_pylist()
    return sorted(found, key=lambda r: r["_at"])


def held_out(doc: str = "doc_id", parts: int = 5, at: int = 0) -> Column:
    """Whether the id is kept from learning: crc32 of its text modulo ``parts`` is ``at``."""
    return fold(doc, parts) == at


def slices(texts: list[str | None], chars: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in order, null as empty, in lists of about so many characters."""
    some: list[str] = []
    size = 0
    for t in texts:
        some.append(t or "")
        size += len(some[-1])
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once per row, however often ``use`` refers to it.

    A column that lambdas refer to is computed again for every element where the optimizer puts its
    expression in its place (it does below a filter); a lambda's own variable never is.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
