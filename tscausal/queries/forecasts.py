"""Forecast configurations, their errors and their comparison.

The relational queries compare three methods that need no fit: the last value, the value a year before the target, and
the mean of the last three.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clean, forecast, report, selection, stats
from ..params import DEFAULT
from ..sources import panels as P
from . import corr, query, r6, rounded

E = ["entity"]
PARAMS = replace(DEFAULT, horizon=24)
PANEL_SQL = P.monthly_positions_sql("n_name", 24)
NAIVE_SQL = PANEL_SQL + """, origins AS (
  SELECT o.entity, h AS horizon, o.pos AS t0, a.level AS actual, o.level AS last,
    b.level AS year_before, CASE WHEN count(o.level) OVER w = 3 THEN avg(o.level) OVER w END AS mean3
  FROM (SELECT * FROM panel CROSS JOIN (SELECT unnest([1, 3, 6, 12])::INTEGER AS h)) o LEFT JOIN panel a ON a.entity = o.entity AND a.pos = o.pos + h LEFT JOIN panel b ON b.entity = o.entity AND b.pos = o.pos + h - 12
  WINDOW w AS (PARTITION BY o.entity, h ORDER BY o.pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
), results AS (
  SELECT entity, m AS method, horizon, t0, actual, CASE m WHEN 'Persistence' THEN last WHEN 'YearBefore' THEN year_before ELSE mean3 END AS pred
  FROM (SELECT o.*, n FROM origins o JOIN (SELECT entity, max(n) AS n FROM panel GROUP BY entity) USING (entity)), (SELECT unnest(['Persistence', 'YearBefore', 'Mean3']) AS m)
  WHERE t0 >= n - 25 AND t0 <= n - 2 AND t0 + horizon <= n - 1 AND last IS NOT NULL
)"""
METRICS_SQL = NAIVE_SQL + """, known AS (SELECT *, actual IS NOT NULL AND pred IS NOT NULL AS k FROM results), metrics AS (
  SELECT entity, method, horizon, sqrt(avg(CASE WHEN k THEN (pred - actual) * (pred - actual) END)) AS rmse, avg(CASE WHEN k THEN abs(pred - actual) END) AS mae,
    1 - sum(CASE WHEN k THEN (pred - actual) * (pred - actual) END) / nullif(var_pop(CASE WHEN k THEN actual END) * count(CASE WHEN k THEN 1 END), 0) AS nse,
    CASE WHEN abs(sum(CASE WHEN k THEN actual END)) >= 1e-6 * greatest(1.0, sum(CASE WHEN k THEN abs(actual) END)) THEN 100 * sum(CASE WHEN k THEN actual - pred END) / sum(CASE WHEN k THEN actual END) END AS pbias,
    count(CASE WHEN k THEN 1 END) AS n_eval, count(*) AS n_origins
  FROM known GROUP BY ALL)"""
PAIRS = (("Persistence", "YearBefore"), ("Persistence", "Mean3"), ("YearBefore", "Mean3"))


def results(spark, d):
    """(entity, method, horizon, t0, actual, pred) of the three methods."""
    panel = P.monthly_positions(spark, d, "n_name", 24).select("entity", "pos", "level")
    rows = forecast.rolling_persistence(panel, E, "pos", "level", PARAMS)
    w = Window.partitionBy("entity").orderBy("pos")
    mean = panel.select("entity", F.col("pos").alias("t0"), F.when(F.count("level").over(w.rowsBetween(-2, 0)) == 3, F.avg("level").over(w.rowsBetween(-2, 0))).alias("mean3"))
    before = panel.select("entity", (F.col("pos") + 12).alias("target"), F.col("level").alias("year_before"))
    wide = rows.join(mean, ["entity", "t0"], "left").withColumn("target", F.col("t0") + F.col("horizon")).join(before, ["entity", "target"], "left")
    methods = F.array(*(F.struct(F.lit(m).alias("method"), F.col(c).alias("pred")) for m, c in (("Persistence", "pred"), ("YearBefore", "year_before"), ("Mean3", "mean3"))))
    return wide.select("entity", "horizon", "t0", "actual", F.explode(methods).alias("m")).select("entity", "m.method", "horizon", "t0", "actual", "m.pred")


def metrics(spark, d):
    return stats.forecast_metrics(results(spark, d), ["entity", "method", "horizon"])


@query(f"WITH {NAIVE_SQL} SELECT entity, horizon, t0, {r6('actual')} AS actual, {r6('pred')} AS pred FROM results WHERE method = 'Persistence'")
def persistence_rolling(spark, d):
    panel = P.monthly_positions(spark, d, "n_name", 24).select("entity", "pos", "level")
    return forecast.rolling_persistence(panel, E, "pos", "level", PARAMS).select("entity", "horizon", "t0", rounded("actual").alias("actual"), rounded("pred").alias("pred"))


@query(f"""WITH {PANEL_SQL} SELECT p.entity, p.pos AS t0, {r6('p.level')} AS actual, {r6('l.level')} AS pred FROM panel p JOIN panel l ON l.entity = p.entity AND l.pos = p.n - 25 WHERE p.pos >= p.n - 24""")
def persistence_single(spark, d):
    panel = P.monthly_positions(spark, d, "n_name", 24).select("entity", "pos", "level")
    return forecast.single_persistence(panel, E, "pos", "level", PARAMS).select("entity", "t0", rounded("actual").alias("actual"), rounded("pred").alias("pred"))


@query(f"WITH {METRICS_SQL} SELECT entity, method, horizon, {', '.join(f'{r6(f'metrics.{c}')} AS {c}' for c in ('rmse', 'mae', 'nse', 'pbias'))}, n_eval, n_origins FROM metrics")
def forecast_metrics(spark, d):
    return metrics(spark, d).select("entity", "method", "horizon", *(rounded(c).alias(c) for c in ("rmse", "mae", "nse", "pbias")), "n_eval", "n_origins")


ALIGNED_SQL = NAIVE_SQL + f""", pairs(method_1, method_2) AS (VALUES {', '.join(map(str, PAIRS))}),
aligned AS (SELECT a.entity, method_1, method_2, a.horizon, a.t0, a.actual, a.pred AS pred_1, b.pred AS pred_2 FROM pairs JOIN results a ON a.method = method_1 JOIN results b ON b.method = method_2 AND b.entity = a.entity AND b.horizon = a.horizon AND b.t0 = a.t0
  QUALIFY count(*) OVER (PARTITION BY a.entity, method_1, method_2, a.horizon) >= 10)"""


def aligned(spark, d):
    pairs = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("method_1"), F.lit(b).alias("method_2")) for a, b in PAIRS))).alias("p")).select("p.*")
    return forecast.aligned(results(spark, d), E, pairs)


@query(f"WITH {ALIGNED_SQL} SELECT entity, method_1, method_2, horizon, t0, {r6('actual')} AS actual, {r6('pred_1')} AS pred_1, {r6('pred_2')} AS pred_2 FROM aligned")
def align_origins(spark, d):
    return aligned(spark, d).select("entity", "method_1", "method_2", "horizon", "t0", *(rounded(c).alias(c) for c in ("actual", "pred_1", "pred_2")))


_Z = "abs(dm_stat) / sqrt(2.0)"
_T = f"(1 / (1 + 0.3275911 * {_Z}))"
_TERMS = " + ".join(f"CASE WHEN {k} < horizon AND n - {k} >= 2 THEN 2 * (1 - {k} / horizon) * c{k} ELSE 0 END" for k in range(1, 12))
TESTS_SQL = ALIGNED_SQL + f""", dif AS (SELECT entity, method_1, method_2, horizon, t0, (actual - pred_1) * (actual - pred_1) - (actual - pred_2) * (actual - pred_2) AS x FROM aligned WHERE actual IS NOT NULL AND pred_1 IS NOT NULL AND pred_2 IS NOT NULL),
lagged AS (SELECT *, {', '.join(f'lag(x, {k}) OVER w AS x{k}' for k in range(1, 12))} FROM dif WINDOW w AS (PARTITION BY entity, method_1, method_2, horizon ORDER BY t0)),
sums AS (SELECT entity, method_1, method_2, horizon, count(*) AS n, avg(x) AS m, var_pop(x) AS v, {', '.join(f'covar_pop(x, x{k}) AS c{k}' for k in range(1, 12))} FROM lagged GROUP BY entity, method_1, method_2, horizon),
stat AS (SELECT entity, method_1, method_2, horizon, n, CASE WHEN n >= 10 THEN m / sqrt(greatest(v + {_TERMS}, 1e-12) / n) END AS dm_stat FROM sums),
tests AS (SELECT *, 2 * (1 - 0.5 * (1 + sign(abs(dm_stat)) * (1 - {_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))) * exp(-{_Z} * {_Z})))) AS p_value FROM stat)"""


def _bounded(x):
    """A variance at its floor makes statistics beyond any use, with digits that no two engines share."""
    return F.when(F.abs(x) < 1e6, F.col(x))


@query(f"WITH {TESTS_SQL} SELECT entity, method_1, method_2, horizon, {r6('CASE WHEN abs(tests.dm_stat) < 1e6 THEN tests.dm_stat END')} AS dm_stat, {r6('tests.p_value')} AS p_value, n FROM tests")
def dm_test(spark, d):
    rows = stats.diebold_mariano(aligned(spark, d), ["entity", "method_1", "method_2"], "t0", "horizon")
    return rows.select("entity", "method_1", "method_2", "horizon", rounded(_bounded("dm_stat")).alias("dm_stat"), rounded("p_value").alias("p_value"), "n")


KEYS = "entity, method_1, method_2, horizon"
BATTERY_SQL = TESTS_SQL + f""", ranked AS (SELECT {KEYS}, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, {KEYS}) AS q, row_number() OVER (ORDER BY p_value, {KEYS}) AS r FROM tests WHERE p_value IS NOT NULL),
battery AS (SELECT t.*, p_fdr FROM tests t LEFT JOIN (SELECT {KEYS}, least(1.0, min(q) OVER (ORDER BY r DESC)) AS p_fdr FROM ranked) USING ({KEYS}))"""


def battery(spark, d):
    return forecast.accuracy_battery(results(spark, d), E, PAIRS)


@query(f"WITH {BATTERY_SQL} SELECT {KEYS}, {r6('CASE WHEN abs(battery.dm_stat) < 1e6 THEN battery.dm_stat END')} AS dm_stat, {r6('battery.p_fdr')} AS p_fdr, CASE WHEN NOT coalesce(battery.p_fdr < 0.2, false) THEN '' WHEN battery.dm_stat < 0 THEN method_1 ELSE method_2 END AS winner FROM battery")
def dm_battery_fdr(spark, d):
    rows = report.winner(battery(spark, d), 0.2)
    return rows.select("entity", "method_1", "method_2", "horizon", rounded(_bounded("dm_stat")).alias("dm_stat"), rounded("p_fdr").alias("p_fdr"), "winner")


_SURE = "coalesce(p_fdr < 0.2, false)"


@query(f"""WITH {BATTERY_SQL} SELECT method_1, method_2, count(DISTINCT entity) AS entities, count(*) AS tests, count(CASE WHEN {_SURE} THEN 1 END) AS significant, count(CASE WHEN {_SURE} AND dm_stat < 0 THEN 1 END) AS favours_1,
  count(CASE WHEN {_SURE} AND dm_stat >= 0 THEN 1 END) AS favours_2, {', '.join(f'count(CASE WHEN {_SURE} AND horizon = {h} THEN 1 END) AS significant_h{h}' for h in (1, 3, 6, 12))} FROM battery WHERE p_value IS NOT NULL GROUP BY method_1, method_2""")
def dm_summary(spark, d):
    return report.accuracy_summary(battery(spark, d), "entity", 0.2)


@query(f"WITH {METRICS_SQL} SELECT method, {', '.join(f'{r6(f'avg(CASE WHEN horizon = {h} THEN rmse END)')} AS rmse_h{h}, count(CASE WHEN horizon = {h} THEN rmse END) AS n_h{h}' for h in (1, 3, 6, 12))} FROM metrics WHERE n_origins > 0 GROUP BY method")
def rmse_summary(spark, d):
    rows = report.rmse_summary(metrics(spark, d))
    return rows.select("method", *(c for h in (1, 3, 6, 12) for c in (rounded(f"rmse_h{h}").alias(f"rmse_h{h}"), F.col(f"n_h{h}"))))


@query(f"""WITH {METRICS_SQL}, cells AS (SELECT entity FROM metrics WHERE method IN ('Persistence', 'YearBefore') AND horizon IN (1, 12) AND rmse IS NOT NULL AND n_origins > 0 GROUP BY entity HAVING count(*) = 4)
SELECT method, horizon, {r6('avg(rmse)')} AS rmse, count(*) AS n FROM metrics SEMI JOIN cells USING (entity) WHERE method IN ('Persistence', 'YearBefore') AND horizon IN (1, 12) GROUP BY method, horizon""")
def matched_rmse(spark, d):
    return report.matched_rmse(metrics(spark, d), "entity", ["Persistence", "YearBefore"], [1, 12]).select("method", "horizon", rounded("rmse").alias("rmse"), "n")


RATIO_SQL = METRICS_SQL + ", ratios AS (SELECT m.entity, m.method, m.horizon, m.rmse / nullif(b.rmse, 0) AS ratio FROM metrics m JOIN metrics b ON b.entity = m.entity AND b.horizon = m.horizon AND b.method = 'Persistence' WHERE m.method <> 'Persistence')"


@query(f"WITH {RATIO_SQL} SELECT entity, method, horizon, {r6('ratios.ratio')} AS ratio FROM ratios")
def ratio_to_baseline(spark, d):
    return report.relative_rmse(metrics(spark, d), "entity").select("entity", "method", "horizon", rounded("ratio").alias("ratio"))


@query(f"WITH {RATIO_SQL} SELECT method, horizon, count(CASE WHEN ratio < 1 THEN 1 END) AS n_better, count(ratio) AS n FROM ratios GROUP BY method, horizon")
def better_than_baseline(spark, d):
    return report.better_than_baseline(report.relative_rmse(metrics(spark, d), "entity"))


@query(f"WITH {METRICS_SQL}, x AS (SELECT entity, method, rmse FROM metrics WHERE horizon = 12) SELECT entity, {', '.join(f"""coalesce(max(CASE WHEN method = '{m}' AND rmse IS NOT NULL THEN 'valid' END), 'n/a') AS {m}""" for m in ('Persistence', 'YearBefore', 'SARIMA'))} FROM x GROUP BY entity")
def config_pivot(spark, d):
    rows = report.configuration_matrix(metrics(spark, d).where("horizon = 12"), "entity", ["Persistence", "YearBefore", "SARIMA"])
    return rows.select("entity", *(F.when(F.col(m) == "n/a", "n/a").otherwise("valid").alias(m) for m in ("Persistence", "YearBefore", "SARIMA")))


def lag_sets(spark, d, by="r_name"):
    """(entity, variable, lag) by the largest absolute correlation with the deseasonalised level, training rows."""
    return stats.pearson_by_lag(P.monthly_positions(spark, d, by).where("is_train"), E, "pos", P.MONTHLY[1:], "level", list(range(1, 13)))


PEARSON_SQL = P.monthly_positions_sql("n_name") + f""", train AS (SELECT * FROM panel WHERE is_train), long AS (SELECT entity, pos, unnest({P.MONTHLY[1:]}) AS variable, unnest([{', '.join(P.MONTHLY[1:])}]) AS x FROM train),
c AS (SELECT l.entity, variable, k.lag::INTEGER AS lag, {corr("x", "level")} AS r, count(CASE WHEN x IS NOT NULL AND level IS NOT NULL THEN 1 END) AS n FROM long l CROSS JOIN (SELECT unnest(range(1, 13)) AS lag) k JOIN train t ON t.entity = l.entity AND t.pos = l.pos + k.lag GROUP BY ALL),
lags AS (SELECT entity, variable, lag, r FROM c WHERE n >= 20 AND r IS NOT NULL AND NOT isnan(r) QUALIFY row_number() OVER (PARTITION BY entity, variable ORDER BY abs(r) DESC, lag) = 1)"""


@query(f"WITH {PEARSON_SQL} SELECT entity, variable, lag, {r6('lags.r')} AS r FROM lags")
def pearson_lag_select(spark, d):
    return lag_sets(spark, d, "n_name").select("entity", "variable", "lag", rounded("r").alias("r"))


def matrix(spark, d, by="n_name"):
    lags = lag_sets(spark, d, by)
    return forecast.method_matrix(lags, E, {"all": lags.select("entity", "variable", "lag"), "causal_direct": lags.where("abs(r) > 0.2").select("entity", "variable", "lag")})


_FORESIGHT = f"""{PEARSON_SQL}, sets AS (SELECT entity, 'all' AS s, lag FROM lags UNION ALL SELECT entity, 'causal_direct', lag FROM lags WHERE abs(r) > 0.2),
m AS (SELECT entity, unnest(['SARIMAX_' || s, 'Trees_' || s]) AS method, unnest(['sarima', 'trees']) AS family, n, least_lag FROM (SELECT entity, s, count(*) AS n, min(lag) AS least_lag FROM sets GROUP BY ALL)
  UNION ALL SELECT entity, unnest(['SARIMA', 'Persistence', 'Trees_level_only']), unnest(['sarima', 'persistence', 'trees']), 0, NULL FROM (SELECT DISTINCT entity FROM lags))"""


@query(f"WITH {_FORESIGHT} SELECT entity, method, least_lag AS min_lag, coalesce(least(least_lag, 37), 37)::INTEGER AS n_free, {r6('coalesce(least(least_lag, 37), 37) / 37')} AS share_free FROM m")
def foresight_flags(spark, d):
    return forecast.foresight(matrix(spark, d)).select("entity", "method", "min_lag", "n_free", rounded("share_free").alias("share_free"))


@query(f"WITH {_FORESIGHT} SELECT entity, method, family, n::INTEGER AS n_drivers FROM m")
def method_matrix(spark, d):
    return matrix(spark, d).select("entity", "method", "family", F.size("lags").alias("n_drivers"))


@query()
def stepwise_aic(spark, d):
    panel = P.monthly_positions(spark, d, "n_name").where("is_train")
    return selection.stepwise_lags(panel.select("entity", "pos", "level", *P.MONTHLY[1:]), E, "pos", "level", lag_sets(spark, d, "n_name").select("entity", "variable", "lag"))


@query()
def vif(spark, d):
    return selection.variance_inflation(P.monthly_positions(spark, d, "n_name"), E, P.MONTHLY[1:])


def _anomalies(spark, d):
    rows = P.monthly_positions(spark, d).withColumn("season", F.month("month"))
    for v in P.MONTHLY:
        rows = clean.deseasonalise(rows, E, "season", v)
    return rows.select("entity", "pos", *P.MONTHLY)


def _tuned(spark, d):
    """The panel has some eighty months, and folds need sixty after twelve lags: the test part is short here."""
    return forecast.tune_trees(_anomalies(spark, d), E, "pos", "level", replace(DEFAULT, horizon=6))


@query()
def tree_grid_cv(spark, d):
    return _tuned(spark, d)


def _fitted(spark, d, family, horizon):
    methods = matrix(spark, d, "r_name").where(F.col("family") == family)
    shape = forecast.chosen_shape(_tuned(spark, d)) if family == "trees" else DEFAULT.tree_grid[0]
    rows = forecast.run_methods(_anomalies(spark, d), methods, E, "pos", "level", P.MONTHLY[1:], shape, PARAMS)
    return rows.where("horizon = 0") if horizon == "single" else rows.where("horizon > 0")


@query()
def tree_recursive(spark, d):
    return _fitted(spark, d, "trees", "single")


@query()
def tree_rolling(spark, d):
    return _fitted(spark, d, "trees", "rolling")


@query()
def sarima_single(spark, d):
    """SARIMA and SARIMAX of every region, single split with intervals."""
    return _fitted(spark, d, "sarima", "single")


@query()
def sarima_rolling(spark, d):
    return _fitted(spark, d, "sarima", "rolling")
