"""Semantics that decide results: gaps, order, neighbours, families of tests, forecasts."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tscausal.functions import scalars
from tscausal.operators import calendar, clean, crossmap, edm, forecast, gaps, graph, report, sarima, screening, selection, stats, windows
from tscausal.operators.trees import BoostedTrees
from tscausal.params import DEFAULT
from tscausal.sources import files, grid, panels

E = ["entity"]


def series(spark, values, entity="a"):
    return spark.createDataFrame([(entity, i, v) for i, v in enumerate(values)], "entity string, pos long, x double")


def column(df, name, order="pos"):
    return [r[name] for r in df.orderBy(order).collect()]


def gapped(n_gap):
    return [None, 1.0, 2.0, *[None] * n_gap, 9.0, 10.0, None, None]


def test_bounded_fill_and_limited_ffill_differ_on_long_gaps(spark):
    six, seven = series(spark, gapped(6)), series(spark, gapped(7))
    assert column(gaps.bounded_fill(six, E, "pos", "x", 6), "x") == pytest.approx([1.0, 1.0, *range(2, 11), 10.0, 10.0])
    assert column(gaps.bounded_fill(seven, E, "pos", "x", 6), "x")[3:10] == [None] * 7
    assert column(gaps.limited_ffill(seven, E, "pos", "x", 6), "x") == [None, 1.0, *[2.0] * 7, None, 9.0, 10.0, 10.0, 10.0]
    for values in (gapped(6), gapped(7), [None, None, 3.0], [1.0], [None, None]):
        mine = forecast.bounded_fill(np.array([np.nan if v is None else v for v in values]), 6)
        theirs = column(gaps.bounded_fill(series(spark, values), E, "pos", "x", 6), "x")
        assert [None if math.isnan(v) else pytest.approx(v) for v in mine] == theirs


def test_runs_and_exclusion(spark):
    df = series(spark, gapped(7)).withColumn("is_train", F.col("pos") < 12)
    assert gaps.longest_gap(df, E, "pos", "x").first().longest == 7
    assert [tuple(r)[1:] for r in gaps.gap_spans(df, E, "pos", "x").orderBy("span_start").collect()] == [(3, 10), (12, 13)]
    assert gaps.without_long_gaps(df, E, "pos", "x", 6).count() == 0 and gaps.without_long_gaps(df, E, "pos", "x", 7).count() == 14
    assert gaps.longest_gap(series(spark, [1.0, 2.0]), E, "pos", "x").first().longest == 0


def test_outliers_need_a_jump_and_a_level(spark):
    rng = random.Random(1)
    values = [10 + math.sin(i / 2) + rng.random() / 5 for i in range(60)]
    values[30], values[31] = 40.0, None
    months = [f"{2000 + i // 12}-{i % 12 + 1:02d}-01" for i in range(60)]
    df = spark.createDataFrame([("a", "s", m, v) for m, v in zip(months, values)], "entity string, station string, month string, x double").withColumn("month", F.col("month").cast("date"))
    bad = clean.outliers(df, ["entity", "station"], "month", "x")
    assert [str(r.month) for r in bad.collect()] == [months[30]]
    kept = clean.null_out(df, bad, ["entity", "station", "month"], "x")
    assert kept.count() == 60 and kept.where("x IS NULL").count() == 2
    assert clean.outliers(df.where("month < '2000-06-01'"), ["entity", "station"], "month", "x").count() == 0


def test_combined_stations_have_no_step(spark):
    rows = [("a", "s", i, 5.0) for i in range(6)] + [("a", "t", i, 25.0) for i in range(3, 9)]
    df = spark.createDataFrame(rows, "entity string, station string, pos long, x double")
    assert set(column(clean.combine_stations(df, E, "station", "pos", "x"), "value")) == {15.0}
    assert column(clean.combine_stations(df, E, "station", "pos", "x", raw=True), "value") == [5.0] * 3 + [15.0] * 3 + [25.0] * 3


def test_season_means_come_from_training_rows(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0, 100.0, 100.0]).withColumn("s", F.col("pos") % 2).withColumn("is_train", F.col("pos") < 4)
    assert column(clean.deseasonalise(df, E, "s", "x"), "x") == [-1.0, -1.0, 1.0, 1.0, 98.0, 97.0]


def test_strict_sum_coverage_and_completeness(spark):
    df = spark.createDataFrame([("a", "s", 1, 1.0), ("a", "t", 1, None), ("a", "s", 2, 1.0), ("a", "t", 2, 2.0)], "entity string, station string, pos long, x double")
    assert [r.v for r in df.groupBy("pos").agg(calendar.strict_sum("x").alias("v")).orderBy("pos").collect()] == [None, 3.0]
    assert column(calendar.coverage(df, E, "pos", "x"), "coverage") == [0.5, 1.0]


def test_features_of_training_and_recursion_agree(spark):
    values = [random.Random(i).random() for i in range(30)]
    values[7] = None
    df = windows.level_features(series(spark, values), E, "pos", "x").orderBy("pos")
    names = [c for c in df.columns if c.startswith("level_")]
    table = forecast.level_table(np.array([np.nan if v is None else v for v in values]), DEFAULT.level_lags)
    for r, row in zip(df.collect(), table):
        assert [r[c] for c in names] == [None if math.isnan(v) else pytest.approx(v) for v in row]


def test_cross_map_numpy_equals_relations(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=80).cumsum(), rng.normal(size=80).cumsum()
    x[10:13], y[40] = np.nan, np.nan
    clean_ = lambda v: None if np.isnan(v) else float(v)
    df = spark.createDataFrame([("a", i, clean_(a), clean_(b)) for i, (a, b) in enumerate(zip(x, y))], "entity string, pos long, c double, e double")
    got = {r.lag: (r.n, r.rho) for r in edm.cross_map(df, E, "pos", "c", "e", [-3, 0, 4], 3).collect()}
    for lag, (n, rho) in got.items():
        mine, points = crossmap.skills(x[:, None], y, lag, 3, 1)
        assert points == n and mine[0] == pytest.approx(rho, abs=1e-9)
    assert edm.cross_map(df.where("pos < 20"), E, "pos", "c", "e", [0], 3).count() == 0


def test_ties_and_exact_matches(spark):
    values = [0.0, 1.0] * 20
    df = spark.createDataFrame([("a", i, float(i % 4), v) for i, v in enumerate(values)], "entity string, pos long, c double, e double")
    rho = edm.cross_map(df, E, "pos", "c", "e", [0], 2).first().rho
    assert crossmap.skills(np.array([[float(i % 4)] for i in range(40)]), np.array(values), 0, 2, 1)[0][0] == pytest.approx(rho, abs=1e-9)
    d = np.random.default_rng(0).integers(0, 5, (60, 60)).astype(float)
    assert (crossmap.nearest(d, 4) == np.argsort(d, axis=1, kind="stable")[:, :4]).all()


def test_surrogates_keep_values_and_spectrum():
    x = np.random.default_rng(3).normal(size=200).cumsum()
    made = crossmap.surrogates(x, 5, 100, np.random.default_rng(4))
    assert (np.sort(made, axis=1) == np.sort(x)).all() and not (made == x).all(axis=1).any()
    power = lambda v: np.abs(np.fft.rfft(v - v.mean()))
    assert all(np.corrcoef(power(x), power(s))[0, 1] > 0.99 for s in made)


def test_direction_of_coupled_maps():
    rows = np.array([(x, y) for _, x, y in panels.coupled_maps()])
    params = replace(DEFAULT, surrogates=60)
    forth = crossmap.edge_record(rows[:, 0], rows[:, 1], "x", "y", 4, 1, params)
    back = crossmap.edge_record(rows[:, 1], rows[:, 0], "y", "x", 4, 1, params)
    assert forth["obs_lag"] == 3 and forth["obs_rho"] > 0.95 and forth["p_value"] == pytest.approx(1 / 61) and forth["convergence_diagnostic_pass"]
    assert back["obs_lag"] < 0 and back["obs_rho"] > 0.6 and back["p_value"] == pytest.approx(1 / 61)
    assert crossmap.edge_record(rows[:15, 0], rows[:15, 1], "x", "y", 4, 1, params)["status"] == "insufficient_data"


def test_false_discovery_excludes_invalid_rows(spark):
    p = [0.01, 0.02, 0.03, 0.5, None, 0.001]
    status = ["OK"] * 5 + ["insufficient_data"]
    df = spark.createDataFrame([(i, v, s, 1 - i % 3, True) for i, (v, s) in enumerate(zip(p, status))], "i int, p_value double, status string, obs_lag int, convergence_diagnostic_pass boolean")
    got = stats.causal_evidence(df).orderBy("i").collect()
    assert [r.p_fdr for r in got] == [pytest.approx(0.04), pytest.approx(0.04), pytest.approx(0.04), 0.5, None, None]
    assert [r.lag_resolution for r in got] == ["resolved", "unresolved", "rejected_reverse", "not_significant", "not_significant", "not_significant"]
    assert [r.causal_evidence for r in got] == [True, True, False, False, False, False]


def test_rank_tests():
    assert stats.kendall(list(range(9)), list(range(9))) == (1.0, pytest.approx(2 / math.factorial(9)))
    assert stats.kendall([1, 2, 3, 4], [1, 3, 2, 4])[0] == pytest.approx(2 / 3)
    assert stats.kendall([1, 1, 1], [1, 2, 3])[0] != stats.kendall([1, 1, 1], [1, 2, 3])[0]  # no order, no tau
    # Published values for 7 against 38 (exact) and 14 against 76 (normal) without ties.
    assert stats.mann_whitney_p(7, 38, 201) == pytest.approx(0.032353642450069, rel=1e-9)
    assert stats.mann_whitney_p(14, 76, 799) == pytest.approx(0.0030086277873796, rel=1e-9)
    assert sum(stats._rank_sums(4, 5)) == math.comb(9, 4)


def test_normal_distribution(spark):
    z = [-3.0, -1.0, 0.0, 0.5, 2.5]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(scalars.normal_cdf(F.col("z")).alias("p")).collect()
    assert [r.p for r in got] == [pytest.approx(0.5 * math.erfc(-v / math.sqrt(2)), abs=2e-7) for v in z]


def test_metrics_mask_and_guard(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 1.0), ("a", 3.0, 3.0), ("b", 2.0, 1.0), ("b", 2.0, 3.0), ("c", None, 1.0)], "m string, actual double, pred double")
    got = {r.m: r for r in stats.forecast_metrics(df, ["m"]).collect()}
    assert (got["a"].n_eval, got["a"].n_origins, got["a"].pbias, got["a"].nse) == (2, 3, -25.0, 0.5)
    assert got["b"].nse is None and got["c"].rmse is None and got["c"].n_origins == 1


def test_graph_with_a_cycle(spark):
    arcs = spark.createDataFrame([("a", *e) for e in [("x", "level"), ("y", "x"), ("level", "y"), ("z", "w")]], "entity string, cause string, effect string")
    assert {r.variable for r in graph.ancestors(arcs, E, "level").collect()} == {"x", "y"}
    found = {r.node: r.component for r in graph.components(spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("y", "z")], "a string, b string")).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "a", "y": "y", "z": "y"}
    areas = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 9), (0, None)], "node int, next_down int")
    assert {r.node for r in graph.upstream(areas, areas.where("node = 1")).collect()} == {1, 2, 3}


def test_stepwise_and_inflation():
    rng = np.random.default_rng(0)
    a, b, c = rng.normal(size=(3, 200))
    y = 2 * a - b + rng.normal(scale=0.1, size=200)
    assert selection.stepwise(y, {"c": c, "b": b, "a": a})[:2] == ["a", "b"]
    assert selection.stepwise(y[:15], {"a": a[:15]}) == [] and selection.stepwise(y, {}) == []
    assert selection.inflation(np.column_stack([a, b, a + 0.01 * c])).max() > 100
    assert np.isnan(selection.inflation(a[:, None])).all()


def test_trees_fit_and_single_rows_agree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = np.where(x[:, 0] > 0, 3.0, -3.0) + x[:, 1]
    model = BoostedTrees(3, 0.1, 80).fit(x, y)
    assert np.sqrt(((model.predict(x) - y) ** 2).mean()) < 0.6
    assert [model.row(r) for r in x[:20]] == pytest.approx(model.predict(x)[:20].tolist())
    assert int(np.argmax(model.gain)) == 0


def test_sarima_recovers_and_updates():
    rng, y = np.random.default_rng(5), [0.0]
    for _ in range(300):
        y.append(0.8 * y[-1] + rng.normal())
    y = np.array(y)
    model = sarima.fit(y, None, (1, 0, 0), (0, 0, 0), 12)
    assert -model.ar[1] == pytest.approx(0.8, abs=0.08) and model.sigma2 == pytest.approx(1, abs=0.2)
    mean, error = model.predict(3)
    assert mean[0] == pytest.approx(model.beta[0] + 0.8 * (y[-1] - model.beta[0]), abs=0.3) and (np.diff(error) > 0).all()
    model.append(np.array([5.0]))
    assert model.predict(1)[0][0] > 3
    with pytest.raises(ValueError):
        model.append(np.array([np.nan]))
    walk = sarima.fit(rng.normal(size=120).cumsum(), None, (0, 1, 1), (0, 0, 0), 12)
    walk.append(np.array([1.0, 2.0]))
    assert np.isfinite(walk.predict(4)[0]).all()
    x = rng.normal(size=(301, 1))
    with_driver = sarima.fit(y + 3 * x[:, 0], x, (1, 0, 0), (0, 0, 0), 12)
    assert with_driver.beta[1] == pytest.approx(3, abs=0.3)
    with pytest.raises(sarima.Degenerate):
        sarima.auto(np.ones(60))


def test_rolling_rules():
    params = replace(DEFAULT, horizon=12, horizons=(1, 3), max_gap=2)
    y = np.sin(np.arange(90) / 3) + np.arange(90) / 50
    y[80:84] = np.nan  # a gap of four in the test part
    rows = forecast.run_trees(y, {}, {}, (2, 0.1, 30), params)
    single = [r for r in rows if r[0] == 0]
    assert len(single) == 12 and not any(math.isnan(r[3]) for r in single)  # its own predictions bridge the gap
    origins = {(h, t) for h, t, _, _ in rows if h}
    assert (1, 79) in origins and (1, 83) not in origins
    assert all(t + h <= 89 for h, t in origins)
    full, _ = forecast.run_sarima(y, {}, {}, params)
    assert max(t for h, t, *_ in full if h) == 79  # an update with a missing value ends the walk


def test_method_failure_is_a_row(spark):
    params = replace(DEFAULT, horizon=6, horizons=(1, 3), level_lags=(1, 2))
    rng = random.Random(3)
    rows = [("a", i, math.sin(i) + rng.random() / 9, None if i > 55 else rng.random()) for i in range(70)]
    panel = spark.createDataFrame(rows, "entity string, pos long, level double, d double")
    lags = spark.createDataFrame([("a", "d", 1)], "entity string, variable string, lag int")
    methods = forecast.method_matrix(panel, E, {"all": lags, "none": lags.where("false")})
    assert {r.method for r in methods.collect()} == {"SARIMA", "Persistence", "Trees_level_only", "SARIMAX_all", "Trees_all"}
    got = forecast.run_methods(panel, methods, E, "pos", "level", ["d"], (2, 0.1, 20), params).collect()
    assert {r.status.split(":")[0] for r in got if r.method == "SARIMAX_all"} == {"error"}
    assert {r.status for r in got if r.method in ("SARIMA", "Trees_level_only", "Persistence")} == {"ok"}
    assert forecast.foresight(methods, params).where("method = 'SARIMAX_all'").first().n_free == 1


def test_report_division_and_matrix(spark):
    rows = [("a", "m", 1, 1.0, 5), ("a", "n", 1, 2.0, 5), ("b", "m", 1, 3.0, 5), ("b", "n", 1, None, 0)]
    m = spark.createDataFrame(rows, "entity string, method string, horizon int, rmse double, n_origins long")
    assert [r.entity for r in report.complete_entities(m, "entity", ["m", "n"], [1]).collect()] == ["a"]
    assert {tuple(r) for r in report.configuration_matrix(m, "entity", ["m", "n", "o"]).collect()} == {("a", "1.0000", "2.0000", "n/a"), ("b", "3.0000", "n/a", "n/a")}


def test_scalars(spark):
    row = spark.sql("SELECT 'Kettle R. (at Lake-X), Above Dam' AS n, ' Yes ' AS b, '1e3' AS v, 'x1' AS w, 'b' AS p, 'a' AS q").select(
        scalars.name_tokens("n", ("LAKE",)).alias("t"), scalars.parse_bool("b").alias("b"), scalars.to_number("v").alias("v"), scalars.to_number("w").alias("w"), scalars.pair_key("p", "q").alias("k"),
        scalars.excluded_direction("n").alias("x"), scalars.pair_seed("p", "q").alias("s"), scalars.fingerprint(F.struct("p", "q")).alias("f"), scalars.p_text(F.lit(0.0001)).alias("pt"), scalars.number_text(F.lit(1.23456), 3).alias("nt"),
    ).first()
    assert set(row.t) == {"KETTLE", "R", "AT", "X", "ABOVE", "DAM"} and (row.b, row.v, row.w, row.k, row.x) == (True, 1000.0, None, "a|b", True)
    assert row.s == crossmap.edge_seed("b", "a") and len(row.f) == 16 and row.pt == "1.00e-04" and row.nt == "1.235"


def test_grid_means(spark):
    cells = grid.cells_in_box(spark.createDataFrame([("a", 0.0, 0.1, 0.0, 0.1)], "area string, south double, north double, west double, east double"), buffer=0.0)
    assert {(r.lat, r.lon) for r in cells.collect()} >= {(0.0, 0.0), (0.1, 0.1)}
    values = spark.createDataFrame([("2000-01-15", 0.04, 0.02, "T", 2.0), ("2000-01-15", 0.11, 0.09, "T", 4.0), ("2000-01-15", 5.0, 5.0, "T", 99.0)], "time string, lat double, lon double, variable string, value double").withColumn("time", F.col("time").cast("date"))
    assert grid.area_means(values, spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.1, 0.1)], "area string, lat double, lon double")).first().value == 3.0


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([("s1", "2001", "3", "1.5"), ("s1", "2001", "4", "--")], "Station string, `Année` string, Mois string, Niveau string")
    got = files.station_readings(raw, {"Station": "station", "Année": "year", "Mois": "month_number", "Niveau": "value"}).orderBy("month").collect()
    assert [(str(r.month), r.value) for r in got] == [("2001-03-01", 1.5), ("2001-04-01", None)]
    frame = spark.createDataFrame([("s1", "2001-03-01", 1.0)], "station string, month string, value double")
    months = spark.createDataFrame([("2001-03-01",), ("2001-04-01",)], "month string")
    assert files.union_stations([frame], months).count() == 2
    with pytest.raises(ValueError):
        files.union_stations([], months)
    tasks = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "entity string, k int")
    files.write_shards(tasks.where("entity = 'a'"), f"{tmp_path}/done", ["entity"])
    done = spark.read.parquet(f"{tmp_path}/done")
    assert [tuple(r) for r in files.remaining(tasks, done, ["entity", "k"]).collect()] == [("b", 1)]
    with pytest.raises(ValueError, match="1 results are missing"):
        files.require_complete(tasks, done, ["entity", "k"])
    files.export_csv(tasks, f"{tmp_path}/csv")
    assert files.read_csv(spark, f"{tmp_path}/csv", "entity string, k int").count() == 3
    assert files.read_text_table(spark, f"{tmp_path}/csv", numbers=["k"]).schema["k"].dataType.typeName() == "double"


def test_regulation_history(spark):
    rows = spark.createDataFrame([("s", 1950, 1960, 0), ("s", 1961, 1990, 1), ("t", 1950, None, 0)], "station string, year_from int, year_to int, regulated int")
    got = {r.station: (r.regulated, len(r.periods)) for r in screening.regulated_stations(rows).collect()}
    assert got == {"s": (1, 2), "t": (0, 1)}


def test_markdown(spark):
    df = spark.createDataFrame([("a", 1.23456), ("b", None)], "k string, v double")
    assert report.markdown(df.orderBy("k"), {"v": 2}) == "| k | v |\n| --- | --- |\n| a | 1.23 |\n| b |  |"
    with pytest.raises(ValueError):
        report.markdown(spark.range(20), limit=10)
