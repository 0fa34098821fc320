"""Choosing: winners with ranked fallback, champions, top-k screening, preferences, decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How each metric is better.
HIGHER, LOWER, NEAR_ZERO = "higher", "lower", "near zero"
DIRECTION = {"r2": HIGHER, "rmse": LOWER, "bias": NEAR_ZERO, "bias_p90": NEAR_ZERO, "rmse_p90": LOWER}


def badness(metric: str) -> Column:
    """A key that is least for the best value of the metric."""
    c = F.col(metric)
    return {HIGHER: -c, LOWER: c, NEAR_ZERO: F.abs(c)}[DIRECTION[metric]]


def ranked(df: DataFrame, by: Sequence[str], metric: str, ties: Sequence[str], out: str = "rank") -> DataFrame:
    """df with the rank (from 1) by the metric in each group, nulls last, ties by the given columns."""
    w = Window.partitionBy(*by).orderBy(badness(metric).asc_nulls_last(), *ties)
    return df.withColumn(out, F.row_number().over(w))


def winners(df: DataFrame, by: Sequence[str], metric: str, ties: Sequence[str]) -> DataFrame:
    return ranked(df, by, metric, ties).filter("rank = 1").drop("rank")


def winners_with_fallback(df: DataFrame, available: DataFrame, by: Sequence[str], metric: str, ties: Sequence[str]) -> DataFrame:
    """The best candidate of each group that is among ``available`` (ties columns), with the best one's
    name as fallback_from where that is another."""
    r = ranked(df, by, metric, ties)
    best = r.filter("rank = 1").select(*by, F.concat_ws("/", *ties).alias("_best"))
    usable = winners(r.drop("rank").join(available.select(*ties).distinct(), list(ties), "left_semi"), by, metric, ties)
    name = F.concat_ws("/", *ties)
    return usable.join(best, list(by)).withColumn("fallback_from", F.when(name != F.col("_best"), F.col("_best"))).drop("_best")


def preferred_split(df: DataFrame, by: Sequence[str], split: str = "split") -> DataFrame:
    """Rows of each group's preferred split: common_test, else test, else the first by name."""
    order = F.when(F.col(split) == "common_test", F.lit("0")).when(F.col(split) == "test", F.lit("1")).otherwise(F.concat(F.lit("2"), F.col(split)))
    return df.withColumn("_o", order).withColumn("_m", F.min("_o").over(Window.partitionBy(*by))).filter("_o = _m").drop("_o", "_m")


def champion(df: DataFrame, by: Sequence[str], slack: float = 0.05) -> DataFrame:
    """The row of each group with the least tail error among those within ``slack`` of its best r2."""
    close = df.withColumn("_b", F.max("r2").over(Window.partitionBy(*by))).filter(F.col("r2") >= F.col("_b") - slack).drop("_b")
    return winners(close, by, "rmse_p90", ["model"])


#: Rules that champion_rules compares.
CHAMPION_RULES = ("r2", "rmse_p90", "r2_slack_then_rmse_p90")


def champion_rules(scores: DataFrame, by: Sequence[str], slack: float = 0.05) -> DataFrame:
    """by, rule, model, test_r2, test_rmse_p90: each rule's choice by validation scores, with its test scores.

    scores: by, model, split (val, test), r2, rmse_p90. Rows without both scores are no candidates; a choice
    without a test row is left out; ties go to the model's name.
    """
    val = scores.filter((F.col("split") == "val") & F.col("r2").isNotNull() & F.col("rmse_p90").isNotNull())
    best = F.max("r2").over(Window.partitionBy(*by))
    close = val.withColumn("_close", F.col("r2") >= best - slack)
    order = {"r2": [F.desc("r2")], "rmse_p90": [F.asc("rmse_p90")], "r2_slack_then_rmse_p90": [F.desc("_close"), F.asc("rmse_p90")]}
    ranks = {rule: F.row_number().over(Window.partitionBy(*by).orderBy(*order[rule], "model")) for rule in CHAMPION_RULES}
    chosen = F.filter(F.array(*(F.when(rank == 1, F.lit(rule)) for rule, rank in ranks.items())), lambda r: r.isNotNull())
    picks = close.withColumn("_rules", chosen).select(*by, "model", F.explode("_rules").alias("rule"))
    test = scores.filter("split = 'test'").select(*by, "model", F.col("r2").alias("test_r2"), F.col("rmse_p90").alias("test_rmse_p90"))
    return picks.join(test, [*by, "model"]).select(*by, "rule", "model", "test_r2", "test_rmse_p90")


def rule_summary(picks: DataFrame) -> DataFrame:
    """rule, n, n_models and the mean test scores of what each rule chose."""
    return picks.groupBy("rule").agg(
        F.count("*").alias("n"), F.count_distinct("model").alias("n_models"), F.avg("test_r2").alias("test_r2"), F.avg("test_rmse_p90").alias("test_rmse_p90")
    )


def top_models(df: DataFrame, by: Sequence[str], k: int, slack: float = 0.05, same_r2: float = 0.002, same_p90: float = 0.01) -> DataFrame:
    """by, rank, model, r2_val, rmse_p90_val, r2_test, rmse_test, rmse_p90_test, gap_r2 (val less test), omitted.

    df: by, model, split (val, test), r2, rmse, rmse_p90, n_nonfinite; one row for each. Models are chosen by their
    validation scores alone: those with both scores known and nothing that diverged, first the ones within the
    slack of the group's best r2 by tail error, then the others by r2; ties go to the model's name. A model
    equivalent to one already taken is not taken but named with it, until k are taken. A chosen model without a
    test row has null test scores.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    val = df.filter((F.col("split") == "val") & known("r2") & known("rmse_p90") & (F.col("n_nonfinite") == 0))
    far = F.col("r2") < F.max("r2").over(Window.partitionBy(*by)) - slack
    kind = "array<struct<model:string,r2:double,rmse_p90:double,omitted:array<string>>>"
    entry = lambda e, omitted: F.struct(e["model"].alias("model"), e["r2"].alias("r2"), e["rmse_p90"].alias("rmse_p90"), omitted.alias("omitted"))

    def step(taken: Column, c: Column) -> Column:
        same = lambda e: (F.abs(e["r2"] - c["r2"]) <= same_r2) & (F.abs(e["rmse_p90"] - c["rmse_p90"]) <= same_p90)
        twin = F.get(F.filter(taken, same), F.lit(0))["model"]
        named = F.transform(taken, lambda e: F.when(e["model"] == twin, entry(e, F.array_append(e["omitted"], c["model"]))).otherwise(e))
        return F.when(F.size(taken) >= k, taken).when(twin.isNotNull(), named).otherwise(F.array_append(taken, entry(c, F.array().cast("array<string>"))))

    # a group's models (some dozens) as one array, in the order in which they are gone through
    order = F.struct(far.alias("far"), F.when(far, -F.col("r2")).otherwise(F.col("rmse_p90")).alias("key"), "model", "r2", "rmse_p90")
    queue = val.withColumn("_c", order).groupBy(*by).agg(F.sort_array(F.collect_list("_c")).alias("_queue"))
    chosen = queue.select(*by, F.posexplode(F.aggregate("_queue", F.array().cast(kind), step)).alias("_at", "_e"))
    test = df.filter("split = 'test'").select(*by, F.col("model").alias("_m"), *(F.col(c).alias(f"{c}_test") for c in ("r2", "rmse", "rmse_p90")))
    met = chosen.withColumn("_m", F.col("_e.model")).join(test, [*by, "_m"], "left")
    return met.select(
        *by, (F.col("_at") + 1).alias("rank"), F.col("_m").alias("model"), F.col("_e.r2").alias("r2_val"), F.col("_e.rmse_p90").alias("rmse_p90_val"),
        "r2_test", "rmse_test", "rmse_p90_test", (F.col("_e.r2") - F.col("r2_test")).alias("gap_r2"), F.array_join("_e.omitted", ", ").alias("omitted"),
    )


def common_dates(df: DataFrame, by: Sequence[str], combo: Sequence[str], day: str) -> DataFrame:
    """Rows of the days that every combination of a group has."""
    held = df.select(*by, day, F.struct(*combo).alias("_c")).distinct()
    need = held.groupBy(*by).agg(F.count_distinct("_c").alias("_all"))
    full = held.groupBy(*by, day).agg(F.count("*").alias("_n")).join(need, list(by)).filter("_n = _all").select(*by, day)
    return df.join(full, [*by, day], "left_semi")


def decision(df: DataFrame, feature: str, season: str, gain: str, control: str) -> DataFrame:
    """feature, mean_gain, seasons_up, decision: keep if the mean gain is over the noise floor (the
    greatest seasonal mean of the control) and positive in 3 seasons, open if over the floor only; else discard."""
    seasonal = df.groupBy(feature, season).agg(F.avg(gain).alias("_g"))
    floor = seasonal.filter(F.col(feature) == control).agg(F.max("_g").alias("_floor"))
    summed = seasonal.filter(F.col(feature) != control).groupBy(feature).agg(F.avg("_g").alias("mean_gain"), F.count_if(F.col("_g") > 0).alias("seasons_up"))
    over, steady = F.col("mean_gain") > F.col("_floor"), F.col("seasons_up") >= 3
    return summed.crossJoin(F.broadcast(floor)).select(  # one row
        feature, "mean_gain", "seasons_up", F.when(over & steady, "keep").when(over, "open").otherwise("discard").alias("decision")
    )
