"""Block bootstrap, paired effects, multiple testing, Diebold-Mariano."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inference as I
from .tables import PANEL, panel, register, rounded

REGISTRY: dict = {}

#: Draws of the bootstrap.
DRAWS = 2000
_ARMS = [("base", "m1", 0.0, 1.05), ("base", "m2", 0.1, 0.95), ("full", "m1", 0.2, 0.8), ("full", "m2", 0.15, 0.9)]



def _tail_sql(q: int) -> str:
    inside = f"y >= cuts[{(90, 95, 99).index(q) + 1}]"
    return f"count(*) FILTER ({inside})::DOUBLE AS n_p{q}, sum(CASE WHEN {inside} THEN e ELSE 0 END) AS se_p{q}, sum(CASE WHEN {inside} THEN e * e ELSE 0 END) AS see_p{q}"


def _pin_sql(q: int) -> str:
    return f"sum(greatest({q / 100} * -e, {q / 100 - 1:.2f} * -e)) AS pin_{q}"


_RESID = f"""{PANEL}, resid AS (SELECT arm, model, tag, station, day, year(day) * 100 + month(day) AS block, y, y * a + proxy * (b + 0.0193 * tag) - y AS e FROM panel
 CROSS JOIN (VALUES {', '.join(map(str, _ARMS))}) t(arm, model, a, b) CROSS JOIN (VALUES (0), (1)) r(tag) WHERE month(day) IN (1, 4, 7, 10)),
cuts AS (SELECT arm, model, tag, quantile_cont(y, [0.9, 0.95, 0.99]) AS cuts FROM resid GROUP BY 1, 2, 3),
sums AS (SELECT arm, model, tag, block, count(*)::DOUBLE AS n, sum(e * e) AS see, sum(y) AS sy, sum(y * y) AS syy, {', '.join(map(_tail_sql, (90, 95, 99)))}, {', '.join(map(_pin_sql, (90, 95, 99)))}
 FROM resid JOIN cuts USING (arm, model, tag) GROUP BY 1, 2, 3, 4),
draws AS (SELECT b, block, CASE WHEN b = 0 THEN 1 ELSE ((b * 7919 + block * 104729 + b * b * 31 + b * block * 17) % 10007) % 3 END AS c FROM (SELECT DISTINCT block FROM sums) CROSS JOIN (SELECT unnest(range({DRAWS + 1})) AS b))"""


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of two arms, two models and two replicates (tags); of four months a year, as the test split is."""
    kinds = F.explode(
        F.array(
            *(
                F.struct(F.lit(a).alias("arm"), F.lit(m).alias("model"), F.lit(t).alias("tag"), F.lit(x).alias("a"), F.lit(b).alias("b"))
                for a, m, x, b in _ARMS
                for t in (0, 1)
            )
        )
    )
    p = panel(spark, sf_dir).filter(F.month("day").isin(1, 4, 7, 10)).withColumn("_k", kinds)
    e = F.col("y") * F.col("_k.a") + F.col("proxy") * (F.col("_k.b") + 0.0193 * F.col("_k.tag")) - F.col("y")
    return p.select("_k.arm", "_k.model", "_k.tag", "station", "day", (F.year("day") * 100 + F.month("day")).alias("block"), "y", e.alias("e"))


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each arm, model, replicate and year-month, computed once."""
    return I.block_sums(residuals(spark, sf_dir), ["arm", "model", "tag"], "block", "y", "e", I.TAILS, I.TAUS, ["station", "day"]).persist()


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sums(spark, sf_dir)
    return I.drawn_metrics(s, draws(s), ["arm", "model", "tag"], "block")


def draws(s: DataFrame) -> DataFrame:
    b, block = F.col("b"), F.col("block").cast("long")
    c = F.when(b == 0, 1).otherwise(((b * 7919 + block * 104729 + b * b * 31 + b * block * 17) % 10007) % 3)
    return s.select("block").distinct().withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DRAWS).cast("long")))).select("b", "block", c.alias("c"))


@register(REGISTRY, f"WITH {_RESID} SELECT arm, model, tag, block, n, round(see, 0) AS see, round(sy, 2) AS sy, round(syy, 0) AS syy, n_p90, round(se_p90, 1) AS se_p90, n_p95, n_p99, round(see_p99, 0) AS see_p99, round(pin_90, 2) AS pin_90, round(pin_99, 2) AS pin_99 FROM sums")
def a18_block_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sums(spark, sf_dir).select("arm", "model", "tag", F.col("block").cast("long").alias("block"), "n", "see", "sy", "syy", "n_p90", "se_p90", "n_p95", "n_p99", "see_p99", "pin_90", "pin_99")
    return rounded(rounded(rounded(s, "see", "syy", "see_p99", places=0), "sy", "pin_90", "pin_99", places=2), "se_p90", places=1)


#: The ten metrics of the robustness analysis, and r2.
NAMES = ("rmse", *(f"{m}_p{q}" for q in (90, 95, 99) for m in ("bias", "rmse")), *(f"pinball_{q}" for q in (90, 95, 99)), "r2")


def _per(c: str, n: str) -> str:
    return f"sum(c * {c}) / nullif(sum(c * {n}), 0)"


def _metrics_sql(name: str, joined: str) -> str:
    return f"""{name} AS (SELECT arm, model, tag, b, sqrt({_per('see', 'n')}) AS rmse, {', '.join(f"{_per(f'se_p{q}', f'n_p{q}')} AS bias_p{q}, sqrt({_per(f'see_p{q}', f'n_p{q}')}) AS rmse_p{q}" for q in (90, 95, 99))},
 {', '.join(f"{_per(f'pin_{q}', 'n')} AS pinball_{q}" for q in (90, 95, 99))},
 1 - sum(c * see) / nullif(sum(c * syy) - sum(c * sy) * sum(c * sy) / nullif(sum(c * n), 0), 0) AS r2 FROM {joined} GROUP BY 1, 2, 3, 4)"""


_METRICS = _metrics_sql("metrics", "sums JOIN draws USING (block)")


@register(REGISTRY, f"WITH {_RESID}, {_METRICS} SELECT arm, model, tag, b, {', '.join(f'round({m}, {6 if m == 'r2' else 2}) AS {m}' for m in NAMES)} FROM metrics")
def x02_block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(drawn(spark, sf_dir).drop("rows"), *NAMES[:-1], places=2), "r2", places=6)


def _effect_sql(metrics: str, out: str) -> str:
    """Effects with their smallest effect of interest and verdict, from a table of drawn metrics."""
    return f"""v_{out} AS (SELECT arm, model, tag, b, unnest([{', '.join(f"'{m}'" for m in NAMES)}]) AS metric, unnest([{', '.join(NAMES)}]) AS value FROM {metrics}),
d_{out} AS (SELECT metric, tag, model, b, (max(value) FILTER (arm = 'base') - max(value) FILTER (arm = 'full')) * CASE WHEN metric = 'r2' OR metric LIKE 'bias%' THEN -1 ELSE 1 END AS d FROM v_{out} GROUP BY 1, 2, 3, 4),
t_{out} AS (SELECT metric, tag, b, avg(d) AS d FROM d_{out} GROUP BY 1, 2, 3), m_{out} AS (SELECT metric, b, avg(d) AS d FROM t_{out} GROUP BY 1, 2),
boot_{out} AS (SELECT metric, max(d) FILTER (b = 0) AS effect, stddev_samp(d) FILTER (b > 0) AS se_boot FROM m_{out} GROUP BY 1),
rep_{out} AS (SELECT metric, count(*) AS n_replicates, stddev_samp(d) / sqrt(count(*)) AS se_rep FROM t_{out} WHERE b = 0 GROUP BY 1),
scale_{out} AS (SELECT metric, 0.01 * abs(avg(value)) AS sesoi FROM v_{out} WHERE b = 0 AND arm = 'base' GROUP BY 1),
e_{out} AS (SELECT *, 2::BIGINT AS n_models, sqrt(se_boot * se_boot + se_rep * se_rep) AS se, effect - 1.96 * se AS ci_lo, effect + 1.96 * se AS ci_hi FROM boot_{out} JOIN rep_{out} USING (metric) JOIN scale_{out} USING (metric)),
{out} AS (SELECT *, CASE WHEN ci_lo > sesoi THEN 'adds' WHEN ci_hi < -sesoi THEN 'harms' WHEN ci_lo >= -sesoi AND ci_hi <= sesoi THEN 'no information' ELSE 'inconclusive' END AS verdict FROM e_{out})"""


@register(REGISTRY, f"""WITH {_RESID}, {_METRICS}, {_effect_sql('metrics', 'effects')} SELECT metric, round(effect, 4) AS effect, round(se, 4) AS se, n_replicates, n_models,
 round(ci_lo, 4) AS ci_lo, round(ci_hi, 4) AS ci_hi, round(effect / nullif(se, 0), 3) AS z, round(sesoi, 4) AS sesoi, verdict FROM effects""")
def x03_x07_paired_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.effect_table(drawn(spark, sf_dir).persist(), "arm", "tag", "model", "base", "full", NAMES)
    e = e.select("metric", "effect", "se", "n_replicates", "n_models", "ci_lo", "ci_hi", "z", "sesoi", "verdict")
    return rounded(rounded(e, "effect", "se", "ci_lo", "ci_hi", "sesoi"), "z", places=3)


_COMPARED = [("full", "base", "full", "features", "base"), ("back", "full", "base", "selection", "full")]


def _family_sql(name: str, worse: str, better: str, axis: str, anchor: str, primary: str) -> str:
    """Effects of one comparison by family, from the drawn metrics ``v``."""
    sign = "CASE WHEN metric = 'r2' OR metric LIKE 'bias%' THEN -1 ELSE 1 END"
    return f"""SELECT '{name}' AS comparison, '{axis}' AS axis, family, metric, effect, sqrt(se_boot * se_boot + se_rep * se_rep) AS se, n_replicates, n_models, '{primary}' = metric AND family = 'all' AS judged,
 (SELECT 0.01 * abs(avg(value)) FROM v WHERE b = 0 AND arm = '{anchor}' AND metric = '{primary}') AS sesoi FROM (
 SELECT family, metric, max(d) FILTER (b = 0) AS effect, stddev_samp(d) FILTER (b > 0) AS se_boot, coalesce(max(rep) FILTER (b = 0), 0) AS se_rep, max(n) AS n_replicates, max(k) AS n_models FROM (
  SELECT family, metric, b, avg(d) AS d, stddev_samp(d) / sqrt(count(*)) AS rep, count(*) AS n, max(k) AS k FROM (
   SELECT family, metric, tag, b, avg(d) AS d, count(*) AS k FROM (SELECT metric, tag, model, b, (max(value) FILTER (arm = '{worse}') - max(value) FILTER (arm = '{better}')) * {sign} AS d FROM v GROUP BY 1, 2, 3, 4)
   JOIN (VALUES ('m1', 'linear'), ('m2', 'other'), ('m1', 'all'), ('m2', 'all')) f(model, family) USING (model) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@register(REGISTRY, f"""WITH {_RESID}, {_METRICS}, v AS (SELECT arm, model, tag, b, unnest([{', '.join(f"'{m}'" for m in NAMES)}]) AS metric, unnest([{', '.join(NAMES)}]) AS value FROM metrics),
e AS ({' UNION ALL '.join(_family_sql(*c, p) for c, p in zip(_COMPARED, ('rmse', 'rmse_p90'), strict=True))})
SELECT comparison, axis, family, metric, round(effect, 4) AS effect, round(se, 4) AS se, n_replicates, n_models, round(sesoi, 4) AS sesoi,
 CASE WHEN judged THEN CASE WHEN effect - 1.96 * se > sesoi THEN 'adds' WHEN effect + 1.96 * se < -sesoi THEN 'harms' WHEN effect - 1.96 * se >= -sesoi AND effect + 1.96 * se <= sesoi THEN 'no information' ELSE 'inconclusive' END END AS verdict FROM e""")
def x03_effects_by_family_and_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two comparisons on two axes, by model family and over all models."""
    e = I.study_effects(drawn(spark, sf_dir).persist(), "arm", "tag", "model", _COMPARED, {"m1": "linear"}, NAMES, {"selection": "rmse_p90"})
    return rounded(e.select("comparison", "axis", "family", "metric", "effect", "se", "n_replicates", "n_models", "sesoi", "verdict"), "effect", "se", "sesoi")


#: Days of a moving block.
STRETCH = 15
_MOVING = f"""days AS (SELECT day, pos, sum(g) OVER (ORDER BY pos) AS run FROM (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos, CASE WHEN day - lag(day) OVER (ORDER BY day) > 1 THEN 1 ELSE 0 END AS g FROM (SELECT DISTINCT day FROM resid))),
valid AS (SELECT s.pos AS start, row_number() OVER (ORDER BY s.pos) - 1 AS k FROM days s JOIN days t ON t.pos = s.pos + {STRETCH - 1} AND t.run = s.run),
by_day AS (SELECT arm, model, tag, pos, count(*)::DOUBLE AS n, sum(e * e) AS see, sum(y) AS sy, sum(y * y) AS syy, {', '.join(map(_tail_sql, (90, 95, 99)))}, {', '.join(map(_pin_sql, (90, 95, 99)))} FROM resid JOIN cuts USING (arm, model, tag) JOIN days USING (day) GROUP BY 1, 2, 3, 4),
stretches AS (SELECT arm, model, tag, start, {', '.join(f'sum({c}) AS {c}' for c in ('n', 'see', 'sy', 'syy', *(f'{s}_p{q}' for q in (90, 95, 99) for s in ('n', 'se', 'see')), 'pin_90', 'pin_95', 'pin_99'))}, 1 AS one FROM by_day JOIN valid ON pos BETWEEN start AND start + {STRETCH - 1} GROUP BY 1, 2, 3, 4),
stretch_draws AS (SELECT b, start, count(*) AS c FROM (SELECT b, (b * 7919 + j * 104729 + b * b * 31 + b * j * 17) % 10007 % (SELECT count(*) FROM valid) AS k FROM (SELECT unnest(range(1, {DRAWS + 1})) AS b) CROSS JOIN (SELECT unnest(range(((SELECT count(*) FROM days) + {STRETCH - 1}) // {STRETCH})) AS j)) JOIN valid USING (k) GROUP BY 1, 2)"""


@register(REGISTRY, f"""WITH {_RESID}, {_METRICS}, {_MOVING}, {_metrics_sql('moved', '(SELECT *, 0 AS b, 1 AS c FROM by_day)')}, {_metrics_sql('shifted', 'stretches JOIN stretch_draws USING (start)')},
moving AS (SELECT * FROM moved UNION ALL SELECT * FROM shifted), {_effect_sql('metrics', 'monthly')}, {_effect_sql('moving', 'stretched')},
u AS (SELECT 'months' AS scheme, metric, ci_hi - ci_lo AS w, verdict FROM monthly UNION ALL SELECT 'moving', metric, ci_hi - ci_lo, verdict FROM stretched)
SELECT u.scheme, round(quantile_cont(u.w / m.w, 0.5), 4) AS median_width, round(min(u.w / m.w), 4) AS least_width, round(max(u.w / m.w), 4) AS greatest_width, round(100 * avg((u.verdict = m.verdict)::INT), 4) AS same_verdicts
FROM u JOIN u m ON m.scheme = 'months' AND m.metric = u.metric GROUP BY 1""")
def x10_scheme_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-months against moving blocks of days: widths of the intervals and verdicts."""
    keys = ["arm", "model", "tag"]
    by_day = I.block_sums(residuals(spark, sf_dir), keys, "day", "y", "e", I.TAILS, I.TAUS, ["station", "day"]).persist()
    days = I.numbered_days(by_day, "day").persist()
    starts = [r["at"] for r in days.filter(F.col("at") + STRETCH - 1 <= F.col("run_end")).orderBy("at").collect()]  # days of a calendar
    b, j = F.col("b"), F.col("j")
    place = (b * 7919 + j * 104729 + b * b * 31 + b * j * 17) % 10007 % len(starts)
    drawn_starts = (
        spark.range(1, DRAWS + 1)
        .select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-days.count() // STRETCH) - 1).cast("long"))).alias("j"))
        .groupBy("b", F.get(F.array(*map(F.lit, starts)), place.cast("int")).alias("start"))
        .agg(F.count("*").alias("c"))
    )
    schemes = {"months": drawn(spark, sf_dir), "moving": I.moving_block_metrics(by_day, days, drawn_starts, keys, "day", STRETCH)}
    tables = [I.effect_table(m.persist(), "arm", "tag", "model", "base", "full", NAMES).withColumn("scheme", F.lit(k)) for k, m in schemes.items()]
    return rounded(I.scheme_summary(tables[0].unionByName(tables[1]), "months"), "median_width", "least_width", "greatest_width", "same_verdicts")


@register(REGISTRY, f"""WITH {_RESID}, {_METRICS}, d AS (SELECT model, tag, b, max(rmse) FILTER (arm = 'base') - max(rmse) FILTER (arm = 'full') AS d FROM metrics GROUP BY 1, 2, 3)
SELECT model, tag, round(max(d) FILTER (b = 0), 4) AS effect, round(quantile_cont(d, 0.025) FILTER (b > 0), 4) AS ci_lo, round(quantile_cont(d, 0.975) FILTER (b > 0), 4) AS ci_hi FROM d GROUP BY 1, 2""")
def x43_paired_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(I.paired_interval(drawn(spark, sf_dir), "arm", ["model", "tag"], "base", "full", "rmse"), "effect", "ci_lo", "ci_hi")


_SEASONAL = """g AS (SELECT l_suppkey % 23 AS feature, l_linestatus AS split, month(l_shipdate) % 4 AS season, avg(l_discount - l_tax * 1.25) AS g FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT split, max(g) AS f FROM g WHERE feature = 0 GROUP BY 1), s AS (SELECT feature, split, avg(g) AS m, count(*) FILTER (g > 0) AS up FROM g WHERE feature > 0 GROUP BY 1, 2),
kept AS (SELECT feature, split FROM s JOIN f USING (split) WHERE m > f AND up >= 3)"""


@register(REGISTRY, f"WITH {_SEASONAL} SELECT feature, coalesce(bool_or(split = 'O'), false) AS in_first, coalesce(bool_or(split = 'F'), false) AS in_second FROM kept GROUP BY 1")
def x43_selection_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features kept by validation (status O) against those kept by the test split (status F)."""
    from ..operators.relations import overlap
    from ..operators.selection import decision
    from .tables import table

    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 23).alias("feature"), "l_linestatus", (F.month("l_shipdate") % 4).alias("season"), (F.col("l_discount") - F.col("l_tax") * 1.25).alias("gain")
    )
    kept = lambda split: decision(lines.filter(F.col("l_linestatus") == split), "feature", "season", "gain", 0).filter("decision = 'keep'")
    return overlap(kept("O"), kept("F"), "feature")


_PS = "ps AS (SELECT s_suppkey AS k, s_nationkey % 3 AS family, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE ((s_suppkey * 7919) % 1000) / 1000.0 END AS p FROM supplier)"


@register(REGISTRY, f"""WITH {_PS}, r AS (SELECT *, p IS NOT NULL AS known, count(p) OVER (PARTITION BY family) AS n, row_number() OVER (PARTITION BY family, p IS NOT NULL ORDER BY p) AS rank FROM ps)
SELECT k, family, round(CASE WHEN known THEN least(min(p * n / rank) OVER (PARTITION BY family, known ORDER BY rank DESC), 1) END, 9) AS q FROM r""")
def x04_t07_benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tables import table

    k = F.col("s_suppkey")
    p = F.when(k % 10 != 0, ((k * 7919) % 1000) / 1000.0)
    ps = table(spark, sf_dir, "supplier").select(k.alias("k"), (F.col("s_nationkey") % 3).alias("family"), p.alias("p"))
    return rounded(I.benjamini_hochberg(ps, "p", ["family"]).select("k", "family", "q"), "q", places=9)


@register(REGISTRY, """WITH e AS (SELECT s_suppkey AS k, s_acctbal / 10000 - 0.3 AS lo, s_acctbal / 10000 AS hi, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE 0.1 END AS se FROM supplier)
SELECT k, CASE WHEN se IS NULL THEN 'indeterminate' WHEN lo > 0.25 THEN 'adds' WHEN hi < -0.25 THEN 'harms' WHEN lo >= -0.25 AND hi <= 0.25 THEN 'no information' ELSE 'inconclusive' END AS verdict FROM e""")
def x05_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tables import table

    k = F.col("s_suppkey")
    hi, se = F.col("s_acctbal") / 10000, F.when(k % 10 != 0, F.lit(0.1))
    return table(spark, sf_dir, "supplier").select(k.alias("k"), I.verdict(hi - 0.3, hi, se, F.lit(0.25)).alias("verdict"))


#: Rows that one arm lacks, errors that are not known, and a day in twenty without any of arm full.
_LACKS = "arm = 'full' AND model = 'm2' AND station % 7 = 3"
_UNKNOWN = "(arm = 'base' AND station % 11 = 5) OR (arm = 'full' AND dayofyear(day) % 20 = 7)"
_DIFF = f"""WITH {_RESID}, uneven AS (SELECT * REPLACE (CASE WHEN {_UNKNOWN} THEN NULL ELSE e END AS e) FROM resid WHERE NOT ({_LACKS})),
pairs AS (SELECT b.model, b.tag, b.station, b.day, b.e * b.e - f.e * f.e AS d FROM uneven b JOIN uneven f USING (model, tag, station, day) WHERE b.arm = 'base' AND f.arm = 'full'),
diff AS (SELECT day, avg(d) AS d FROM (SELECT DISTINCT day FROM uneven) LEFT JOIN (SELECT model, tag, day, avg(d) AS d FROM pairs GROUP BY 1, 2, 3) USING (day) GROUP BY 1)"""


def _uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = residuals(spark, sf_dir).filter(f"NOT ({_LACKS})")
    return rows.withColumn("e", F.when(F.expr(_UNKNOWN), F.lit(None)).otherwise(F.col("e")))


@register(REGISTRY, _DIFF + " SELECT day, round(d, 2) AS d FROM diff")
def x08_loss_differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(I.loss_differential(_uneven(spark, sf_dir), "day", "arm", ["model", "tag"], "e", "base", "full"), "d", places=2)


@register(REGISTRY, _DIFF + """, g AS (SELECT *, sum(n) OVER (ORDER BY day) AS run FROM (SELECT *, CASE WHEN day - lag(day) OVER (ORDER BY day) > 1 THEN 1 ELSE 0 END AS n FROM diff)),
c AS (SELECT day, run, d, d - avg(d) OVER () AS c FROM g WHERE d IS NOT NULL), l AS (SELECT d, c, """ + ", ".join(f"CASE WHEN lag(run, {k}) OVER (ORDER BY day) = run THEN c * lag(c, {k}) OVER (ORDER BY day) END AS p{k}" for k in range(1, 6)) + """ FROM c)
SELECT count(*) AS n, CASE WHEN count(*) >= 10 THEN round(avg(d), 0) END AS mean, CASE WHEN count(*) >= 10 THEN round(avg(d) / sqrt(greatest((sum(c * c)""" + "".join(f" + 2 * (1 - {k} / 6.0) * coalesce(sum(p{k}), 0)" for k in range(1, 6)) + ") / count(*), 1e-12) / count(*)) * sqrt((count(*) - 1) / count(*)), 5) END AS dm FROM l")
def x09_diebold_mariano(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.loss_differential(_uneven(spark, sf_dir), "day", "arm", ["model", "tag"], "e", "base", "full")
    return rounded(rounded(I.diebold_mariano(d, "day", "d").drop("p"), "mean", places=0), "dm", places=5)


@register(REGISTRY, f"WITH {_RESID}, {_METRICS} SELECT arm, model, tag, round(max(rmse) FILTER (b = 0), 4) AS rmse, round(quantile_cont(rmse, 0.025) FILTER (b > 0), 4) AS ci_lo, round(quantile_cont(rmse, 0.975) FILTER (b > 0), 4) AS ci_hi, row_number() OVER (ORDER BY max(rmse) FILTER (b = 0), arm, model, tag) AS rank FROM metrics GROUP BY 1, 2, 3")
def x36_x40_percentile_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = I.ranked_intervals(drawn(spark, sf_dir), ["arm", "model", "tag"], "rmse")
    return rounded(ranks.withColumn("rank", F.col("rank").cast("long")), "rmse", "ci_lo", "ci_hi")


@register(REGISTRY)
def x06_seeded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sums(spark, sf_dir)
    blocks = sorted(r["block"] for r in s.select("block").distinct().collect())  # year-months
    return I.drawn_metrics(s, I.seeded_draws(spark, blocks, DRAWS, 42), ["arm", "model", "tag"], "block").drop("rows")
