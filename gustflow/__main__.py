"""Command line: python -m gustflow <command>. Tables are parquet paths on any file system that Spark reads.

    list                              names of the registered queries
    run NAME SF_DIR OUT               one query's rows
    arms OUT                          arms of a study from base and new features and their groups
    prepare ROWS OUT                  complete rows with train, val and test by months, purged at borders
    screen PREPARED ARMS OUT          models of each arm by cluster and season, with validation errors
    study PREPARED MODELS OUT         test residuals of each arm and model, as draws reads them
    aggregate RESIDUALS OUT           metrics of each arm and model, by cluster and of all
    draws RESIDUALS OUT               bootstrap metrics of residuals (arm, model, tag, station, day, y, e) by year-month
    effects METRICS OUT               paired effects of one arm over another from what draws wrote
    champions SCORES OUT              what each champion rule chooses (arm, season, model, split, r2, rmse_p90)
    correct GRID STATIONS ... OUT     the corrected grid from grid, stations, predictions and scores
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import season
from .operators import inference, metrics, selection
from .plans import arms as A
from .plans.study import corrected_product
from .queries import registered


#: Metrics that ``draws`` writes.
METRICS = ["rmse", *(f"{m}_p{q}" for q in (90, 95, 99) for m in ("bias", "rmse")), *(f"pinball_{q}" for q in (90, 95, 99)), "r2"]


def names(text: str) -> list[str]:
    return [t.strip() for t in text.split(",") if t.strip()]


def numbers(text: str) -> list[int]:
    return [int(t) for t in names(text)]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gustflow")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list")

    def command(name: str, *paths: str) -> argparse.ArgumentParser:
        made = sub.add_parser(name)
        for p in (*paths, "out"):
            made.add_argument(p)
        return made

    command("run", "name", "sf_dir")
    made = command("arms")
    made.add_argument("--base", type=names, required=True, help="features, parted by commas")
    made.add_argument("--new", type=names, required=True)
    made.add_argument("--group", action="append", default=[], metavar="NAME=FEATURES", help="a group's features; may be given again")
    made.add_argument("--sets", type=names, default=["anchors", "groups", "controls"])
    made.add_argument("--static", type=names, default=[])
    prepare = command("prepare", "rows")
    prepare.add_argument("--features", type=names, required=True)
    prepare.add_argument("--discovered", type=names, default=[])
    prepare.add_argument("--test-months", type=numbers, default=[1, 4, 7, 10])
    prepare.add_argument("--val", type=names, default=[], help="validation blocks, such as 2001-02,2003-05")
    prepare.add_argument("--controls", action="store_true", help="add the control columns: noise, and --static features of other stations")
    prepare.add_argument("--static", type=names, default=[])
    prepare.add_argument("--gap", type=int, default=0, help="days purged after a border of splits")
    screen = command("screen", "prepared", "arms")
    screen.add_argument("--y", default="y")
    screen.add_argument("--models", type=names, default=["least_squares", "ridge"])
    screen.add_argument("--least", type=int, default=20)
    study = command("study", "prepared", "models")
    study.add_argument("--y", default="y")
    command("aggregate", "residuals")
    draws = command("draws", "residuals")
    draws.add_argument("--n", type=int, default=2000)
    draws.add_argument("--seed", type=int, default=42)
    effects = command("effects", "metrics")
    effects.add_argument("--worse", default="base")
    effects.add_argument("--better", default="full")
    effects.add_argument("--anchor", help="arm whose metrics scale the smallest effect of interest; that of --worse if left out")
    effects.add_argument("--metric", action="append", choices=METRICS, help="may be given again; all if left out")
    champions = command("champions", "scores")
    champions.add_argument("--slack", type=float, default=0.05)
    correct = command("correct", "grid", "stations", "predictions", "scores")
    correct.add_argument("--available", help="usable (pipeline, arm) pairs; all of the scores' if left out")
    correct.add_argument("--metric", default="rmse", choices=sorted(selection.DIRECTION))
    correct.add_argument("--k", type=int, default=15)
    return top


def result(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    read = spark.read.parquet
    if args.command == "run":
        known = registered()[0]
        if args.name not in known:
            raise ValueError(f"there is no query {args.name!r}; see list")
        return known[args.name](spark, args.sf_dir)
    if args.command == "arms":
        group_of = {f: g for g, _, some in (given.partition("=") for given in args.group) for f in names(some)}
        return A.arm_table(spark, A.study_arms(args.base, args.new, group_of, args.sets, args.static))
    if args.command == "prepare":
        label = A.month_blocks(args.test_months, [tuple(map(int, v.split("-"))) for v in args.val])
        rows = read(args.rows)
        rows = rows if "season" in rows.columns else rows.withColumn("season", season(F.col("day")))
        made = A.prepared(rows, args.features, "cluster", "station", "day", label, args.gap, args.discovered)
        return A.with_controls(made, args.static, "station", "day") if args.controls else made
    if args.command == "screen":
        return A.screened_arms(read(args.prepared), A.read_arms(read(args.arms)), ["cluster"], "season", args.y, args.models, args.least)
    if args.command == "study":
        return A.arm_residuals(read(args.prepared), read(args.models), ["cluster"], "season", "station", "day", args.y)
    if args.command == "aggregate":
        return metrics.grouping_metrics(read(args.residuals), [["arm", "model"], ["arm", "model", "cluster"]], "y", "y_pred")
    if args.command == "draws":
        block = (F.year("day") * 100 + F.month("day")).alias("block")
        rows = read(args.residuals).select("*", block)
        sums = inference.block_sums(rows, ["arm", "model", "tag"], "block", "y", "e", inference.TAILS, inference.TAUS, ["station", "day"])
        months = sorted(r["block"] for r in rows.select("block").distinct().collect())  # year-months of a calendar
        return inference.drawn_metrics(sums, inference.seeded_draws(spark, months, args.n, args.seed), ["arm", "model", "tag"], "block")
    if args.command == "effects":
        drawn = read(args.metrics)
        return inference.effect_table(drawn, "arm", "tag", "model", args.worse, args.better, args.metric or METRICS, args.anchor)
    if args.command == "champions":
        return selection.champion_rules(read(args.scores), ["arm", "season"], args.slack)
    scores = read(args.scores)
    usable = read(args.available) if args.available else scores.select("pipeline", "arm").distinct()
    return corrected_product(read(args.grid), read(args.stations), read(args.predictions), scores, usable, args.metric, args.k)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(registered()[0])))
        return
    spark = spark or SparkSession.builder.appName("gustflow").getOrCreate()
    result(spark, args).write.mode("errorifexists").parquet(args.out)


if __name__ == "__main__":
    main()
