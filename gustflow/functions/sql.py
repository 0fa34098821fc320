"""The library from SQL: scalar functions that Catalyst inlines, and table functions over partitions."""

from __future__ import annotations

import datetime as dt
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

#: name(parameters) RETURNS type -> expression; SQL functions, so nothing leaves the JVM.
SCALARS = {
    "wind_speed(u DOUBLE, v DOUBLE) RETURNS DOUBLE": "sqrt(u * u + v * v)",
    "wind_from(u DOUBLE, v DOUBLE) RETURNS DOUBLE": "pmod(270 - degrees(atan2(v, u)), 360)",
    "season_of(d DATE) RETURNS STRING": "CASE WHEN month(d) IN (12, 1, 2) THEN 'DJF' WHEN month(d) IN (3, 4, 5) THEN 'MAM' WHEN month(d) IN (6, 7, 8) THEN 'JJA' WHEN d IS NOT NULL THEN 'SON' END",
    "squared_loss(y DOUBLE, p DOUBLE) RETURNS DOUBLE": "(y - p) * (y - p)",
    "pinball_loss(y DOUBLE, p DOUBLE, tau DOUBLE) RETURNS DOUBLE": "greatest(tau * (y - p), (tau - 1) * (y - p))",
    "huber_loss(y DOUBLE, p DOUBLE, delta DOUBLE) RETURNS DOUBLE": "CASE WHEN abs(y - p) <= delta THEN 0.5 * (y - p) * (y - p) ELSE delta * (abs(y - p) - 0.5 * delta) END",
}


class DayRuns:
    """key, day, run: rows of a table (key, day) PARTITION BY key ORDER BY day with the number of their run of days.

    Rows come in batches; a batch goes on where the last one of its key stopped.
    """

    def __init__(self) -> None:
        self.before: int | None = None
        self.run = 0

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        keys, days = rows.column(0), rows.column(1).cast(pa.date32(), safe=False)
        if not pa.types.is_string(keys.type):
            held = keys.dictionary_encode()
            keys = pa.array([None if k is None else str(k) for k in held.dictionary.to_pylist()], pa.string()).take(held.indices)
        at = days.cast(pa.int32()).to_numpy(zero_copy_only=False).astype(float)  # unknown days: nan, which is far from none
        gaps = np.diff(at, prepend=np.nan if self.before is None else self.before) > 1
        runs = self.run + np.cumsum(gaps)
        self.before, self.run = (None if np.isnan(at[-1]) else int(at[-1])), int(runs[-1])
        yield pa.table({"key": keys, "day": days, "run": pa.array(runs, pa.int64())})


class Lookback:
    """key, day, window: of a table (key, day, value) PARTITION BY key ORDER BY day the last ``length`` values, this one last."""

    def __init__(self) -> None:
        self.values: deque = deque()

    def eval(self, length: int, row: Row) -> Iterator[tuple[str, dt.date, list[float]]]:
        self.values.append(row[2])
        if len(self.values) > length:
            self.values.popleft()
        if len(self.values) == length:
            yield None if row[0] is None else str(row[0]), row[1], list(self.values)


def register_sql(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``: SCALARS, day_runs(TABLE) and lookback(length, TABLE)."""
    for signature, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udtf.register("day_runs", arrow_udtf(DayRuns, returnType="key string, day date, run bigint"))
    spark.udtf.register("lookback", udtf(Lookback, returnType="key string, day date, window array<double>"))
