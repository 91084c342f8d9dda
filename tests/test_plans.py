"""Whole analyses from files to results, resuming, and the stream."""

import math
import random

import pytest

from tscausal.plans import cli
from tscausal.streaming import panels as streams


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("inputs"), random.Random(7)
    levels, drivers = ["entity,station,month,value"], ["entity,month,variable,value"]
    for entity in ("lake_a", "lake_b"):
        rain = [rng.random() for _ in range(130)]
        for i in range(130):
            month = f"{2000 + i // 12}-{i % 12 + 1:02d}-01"
            value = 3 + math.sin(i * math.pi / 6) + (0.8 * rain[i - 1] if i else 0) + 0.05 * rng.random()
            levels += [f"{entity},{s},{month},{'' if s == 't' and i % 40 == 9 else value + o}" for s, o in (("s", 0), ("t", 5))]
            drivers += [f"{entity},{month},rain,{rain[i]}", f"{entity},{month},noise,{rng.random()}"]
    (folder / "levels.csv").write_text("\n".join(levels))
    (folder / "drivers.csv").write_text("\n".join(drivers))
    return folder


def test_stages_from_csv_to_tests(spark, inputs, tmp_path):
    args = ["--stations", str(inputs / "levels.csv"), "--drivers", str(inputs / "drivers.csv"), "--out", str(tmp_path), "--surrogates", "19", "--horizon", "24"]
    for stage in ("panel", "embed", "within", "between", "forecast"):
        cli.main([stage, *args])
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    assert read("panel").where("variable = 'level' AND entity = 'lake_a'").count() == 130
    assert read("sizes").where("size BETWEEN 2 AND 10").count() == 6
    within = read("within")
    assert within.count() == 12 and within.where("status = 'OK'").count() == 12
    assert read("between").count() == 2
    shards = read("within_shards").count()
    cli.main(["within", *args])  # everything is done: nothing is tested again
    assert read("within_shards").count() == shards
    metrics = read("forecast_metrics")
    assert {"SARIMA", "Persistence", "Trees_level_only", "SARIMAX_all", "Trees_all"} <= {r.method for r in metrics.select("method").distinct().collect()}
    assert metrics.where("rmse IS NOT NULL").count() > 0 and read("forecast_tests").count() > 0


def test_stream_gives_closed_windows(spark, tmp_path):
    rows = [("a", f"2024-01-01 {h:02d}:{m:02d}:00", float(h)) for h in range(12) for m in (5, 35)]
    events = spark.createDataFrame(rows, "entity string, ts string, value double").selectExpr("entity", "cast(ts AS timestamp) AS ts", "value")
    events.write.parquet(f"{tmp_path}/in")
    means = streams.windowed_means(streams.event_stream(spark, f"{tmp_path}/in", "entity string, ts timestamp, value double"), "entity", "ts", "value", late="2 hours")
    streams.append_panel(means, f"{tmp_path}/panel", f"{tmp_path}/state").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/panel").orderBy("start").collect()
    assert [(r.level, r.n) for r in got] == [(float(h), 2) for h in range(len(got))] and len(got) >= 8
