"""Work units that a stream asks for: each computed once for a fingerprint, whatever is stopped and started again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sink import missing_units, write_units


def stream_units(
    requests: DataFrame,
    path: str,
    checkpoint: str,
    compute: Callable[[DataFrame], DataFrame],
    by: Sequence[str],
    fingerprint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Compute the units (columns ``by``) that the stream ``requests`` asks for and put them under ``path``.

    ``compute`` gets the units of a batch that are not there yet under this fingerprint and returns their rows, with
    the columns ``by``. Rows of a unit replace those that another fingerprint left; the other units stay. A batch that
    was stopped half way is asked for again by Spark and finds what is still missing, so each unit is there once.
    A unit without rows is computed again whenever it is asked for. Without ``every`` (such as "1 minute") what has
    been asked for so far is done and the query ends.
    """

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        wanted = batch.select(*by).distinct()
        lacking = missing_units(spark, path, wanted, by, fingerprint)
        if lacking.isEmpty():
            return
        write_units(compute(lacking).withColumn("fingerprint", F.lit(fingerprint)), path, by)

    writer = requests.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
