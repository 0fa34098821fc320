"""Fill-in-the-middle examples, as relations.

A text is a row of units: words with the white space before them, and white space that no word follows. Units
become rows, numbered by their place; a running sum of their lengths over a document gives where each unit ends.
Each document that is to be cut asks for two ordinals, joined with the units; what is found is gathered for
each document, and the text is cut there by code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Units of a text; possessive, as the two classes have nothing in common.
UNIT = rf"{_SPACE}*+{_WORD}++|{_SPACE}++"
#: The strings that mark prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(doc: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32, drawn from a document's id: 8-digit groups of a digest; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def chosen_form(text: Column, draw: list[Column], rate: int, spm_rate: int) -> Column:
    """plain, spm or psm: ``rate`` percent of the texts are cut, ``spm_rate`` percent of those suffix first."""
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    return (
        F.when((text == "") | marked | (draw[2] % 100 >= rate), F.lit("plain"))
        .when(draw[3] % 100 < spm_rate, F.lit("spm"))
        .otherwise(F.lit("psm"))
    )


def output_of(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    """The training text: the parts in the form's order, each after its mark; a plain text as it is."""
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    return (
        F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(form == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(text)
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Cut texts hold no marks of their own, so each mark comes once."""
    after = lambda mark: F.substring_index(output, mark, -1)
    before = lambda found, mark: F.substring_index(found, mark, 1)
    psm = F.concat(before(after(PREFIX), SUFFIX), after(MIDDLE), before(after(SUFFIX), MIDDLE))
    spm = F.concat(before(after(PREFIX), MIDDLE), after(MIDDLE), before(after(SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, text, n (units, long), form, prefix_chars and middle_chars (long, null if plain) and output of each text.

    A null text counts as empty, and an empty one is plain, as is one that holds a mark; a null id is drawn as an
    empty one. Repeated rows come as often as they do in docs, cut alike. Columns of docs but the two are
    left out, whatever their names. An empty table gives no rows.

    Whole texts are shuffled once, by their key (hashes of id and text); rows with one key are put together and
    counted before they are cut, and units, which travel as ordinals and lengths, stay where their text is:
    running sums, the join with the requests and the gathering all use that one partitioning. The text itself
    goes with its first unit only. The shuffle has the session's number of partitions, not fewer: its
    rows become many.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = draws(F.col("doc_id"), seed)
    plain_rows = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = ["_k1", "_k2"]
    keyed = plain_rows.select(
        F.xxhash64("text", "doc_id").alias("_k1"),
        F.xxhash64(F.lit(seed), "doc_id", F.char_length("text"), "text").alias("_k2"),
        "doc_id",
        "text",
        chosen_form(F.col("text"), cut, rate, spm_rate).alias("form"),
    )
    # which units' ends are wanted: a row per document, prefix and middle end after so many units
    counted = keyed.filter("form <> 'plain'").withColumn("_n", F.regexp_count("text", F.lit(UNIT)))
    ends = [h % (F.col("_n") + 1) for h in cut[:2]]
    asked = counted.select(*key, F.least(*ends).alias("_first"), F.greatest(*ends).alias("_second")).groupBy(*key).agg(
        F.first("_first").alias("_first"), F.first("_second").alias("_second")
    )
    once = (
        keyed.repartition(parts, *key)
        .groupBy(*key)
        .agg(F.first(F.struct("doc_id", "text", "form")).alias("_row"), F.count(F.lit(1)).alias("_copies"))
    )
    # a text that is not cut is one row, its own only unit
    units = F.when(F.col("_row.form") == "plain", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(F.col("_row.text"), F.lit(UNIT), F.lit(0))
    )
    begins = F.col("_at") == 0
    unit_rows = once.select(*key, "_row", "_copies", F.posexplode(units).alias("_at", "_unit")).select(
        *key,
        (F.col("_at") + 1).alias("_ordinal"),
        F.char_length("_unit").alias("_length"),
        F.when(begins, F.col("_row")).alias("_row"),
        F.when(begins, F.col("_copies")).alias("_copies"),
    )
    running = Window.partitionBy(*key).orderBy("_ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = unit_rows.withColumn("_end", F.sum("_length").over(running))
    # requests meet units by ordinal within a document; an end before the first unit is 0
    met = ended.join(asked.withColumnsRenamed({k: "_of" + k for k in key}), [F.col(k) == F.col("_of" + k) for k in key], "left")
    at = lambda wanted: F.max(F.when(F.col("_ordinal") == F.col(wanted), F.col("_end")))
    found = met.groupBy(*key).agg(
        F.first("_row", ignorenulls=True).alias("_row"),
        F.max("_copies").alias("_copies"),
        F.max("_ordinal").alias("_units"),
        at("_first").alias("_first"),
        at("_second").alias("_second"),
    )
    is_plain = F.col("_row.form") == "plain"
    first, second = (F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("_first", "_second"))
    size = F.char_length("_row.text")
    out = found.select(
        "_copies",
        F.col("_row.doc_id").alias("doc_id"),
        F.col("_row.text").alias("text"),
        F.when(is_plain, F.regexp_count("_row.text", F.lit(UNIT))).otherwise(F.col("_units")).cast("long").alias("n"),
        F.col("_row.form").alias("form"),
        F.when(~is_plain, first.cast("long")).alias("prefix_chars"),
        F.when(~is_plain, (second - first).cast("long")).alias("middle_chars"),
        output_of(
            F.col("_row.form"),
            F.substring("_row.text", F.lit(1), first),
            F.substring("_row.text", first + 1, second - first),
            F.substring("_row.text", second + 1, size),
            F.col("_row.text"),
        ).alias("output"),
    )
    return out.withColumn("_copies", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).drop("_copies")
