"""Calendars, stations, gaps, seasons and lagged features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import convert_units, lag_map_json, month_offset, within_years
from ..operators import calendar, clean, gaps, report, windows
from ..sources import panels as P
from . import query, r6, rounded

E = ["entity"]
TRAIN = "s AS (SELECT *, pos < count(*) OVER (PARTITION BY entity) - 37 + min(pos) OVER (PARTITION BY entity) AS is_train FROM {})"


def _sparse_train(spark, d):
    rows = calendar.positions(P.sparse(spark, d), E, "pos", "k")
    return calendar.train_flag(rows, E, 37, "k").drop("k")


@query(f"WITH {P.SPARSE_SQL} SELECT entity, pos, {r6('x')} AS x FROM sparse")
def calendar_densify(spark, d):
    return P.sparse(spark, d).select("entity", F.col("pos").cast("long").alias("pos"), rounded("x").alias("x"))


@query(f"""WITH {P.monthly_sql()}, d AS (SELECT r_name AS entity, date_trunc('month', l_shipdate)::DATE AS month, avg(l_extendedprice) AS v
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT entity, month, {r6('level')} AS level, {r6('v')} AS driver FROM monthly LEFT JOIN d USING (entity, month)""")
def panel_left_assemble(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    places = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("entity"))
    drivers = t("lineitem").join(places, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("entity", F.trunc("l_shipdate", "month").alias("month")).agg(F.avg("l_extendedprice").alias("v"))
    panel = calendar.assemble(P.monthly(spark, d).select("entity", "month", "level"), [drivers], E, "month", "1 month")
    return panel.select("entity", "month", rounded("level").alias("level"), rounded("v").alias("driver"))


@query(f"""WITH {P.SPARSE_SQL}, a AS (SELECT pos, x FROM sparse WHERE entity = 0 AND pos < 500), b AS (SELECT pos, x FROM sparse WHERE entity = 1 AND pos > 200),
u AS (SELECT coalesce(a.pos, b.pos) AS pos, a.x AS value_a, b.x AS value_b FROM a FULL JOIN b ON a.pos = b.pos)
SELECT s.pos, {r6('value_a')} AS value_a, {r6('value_b')} AS value_b FROM (SELECT unnest(range(min(pos), max(pos) + 1)) AS pos FROM u) s LEFT JOIN u USING (pos)""")
def pair_union_panel(spark, d):
    rows = P.sparse(spark, d)
    a, b = rows.where("entity = 0 AND pos < 500").select("pos", F.col("x").alias("value")), rows.where("entity = 1 AND pos > 200").select("pos", F.col("x").alias("value"))
    return calendar.union_panel(a, b, "pos").select(F.col("pos").cast("long").alias("pos"), rounded("value_a").alias("value_a"), rounded("value_b").alias("value_b"))


OUTLIERS_SQL = P.STATIONS_SQL + """,
seen AS (SELECT *, x - lag(x) OVER (PARTITION BY entity, station ORDER BY month) AS dx FROM stations WHERE x IS NOT NULL),
m1 AS (SELECT entity, station, median(dx) AS dm, median(x) AS xm, count(dx) AS n FROM seen GROUP BY ALL),
m2 AS (SELECT s.*, dm, xm, n FROM seen s JOIN m1 USING (entity, station)),
m3 AS (SELECT entity, station, median(abs(dx - dm)) AS ds, median(abs(x - xm)) AS xs FROM m2 GROUP BY ALL),
z AS (SELECT m2.*, ds, xs FROM m2 JOIN m3 USING (entity, station) WHERE n >= 10 AND ds > 0 AND xs > 0),
flagged AS (
  SELECT entity, station, month FROM z WHERE abs(dx - dm) / (1.4826 * ds) > 3
  UNION SELECT entity, station, (month - INTERVAL 1 MONTH)::DATE FROM z WHERE abs(dx - dm) / (1.4826 * ds) > 3
), bad AS (
  SELECT entity, station, month FROM z SEMI JOIN flagged USING (entity, station, month) WHERE abs(x - xm) / (1.4826 * xs) > 2.5
)"""


def _bad(rows):
    return clean.outliers(rows, ["entity", "station"], "month", "x", 3.0, 2.5)


@query(f"WITH {OUTLIERS_SQL} SELECT entity, station, month FROM bad")
def station_outlier_screen(spark, d):
    """With thresholds of 3 and 2.5: the data holds nothing beyond 6 and 5."""
    return _bad(P.stations(spark, d))


CLEAN_SQL = OUTLIERS_SQL + ", cleaned AS (SELECT s.entity, s.station, s.month, CASE WHEN b.month IS NULL THEN x END AS x FROM stations s LEFT JOIN bad b ON s.entity = b.entity AND s.station = b.station AND s.month = b.month)"


@query(f"""WITH {CLEAN_SQL}, own AS (SELECT *, avg(x) OVER (PARTITION BY entity, station) AS m FROM cleaned),
g AS (SELECT entity, avg(m) AS g FROM (SELECT entity, station, avg(x) AS m FROM cleaned GROUP BY ALL) GROUP BY entity)
SELECT entity, month, {r6('avg(x - m) + any_value(g)')} AS value FROM own JOIN g USING (entity) GROUP BY entity, month""")
def station_combine_anomaly(spark, d):
    rows = P.stations(spark, d)
    kept = clean.null_out(rows, _bad(rows), ["entity", "station", "month"], "x")
    return clean.combine_stations(kept, E, "station", "month", "x").select("entity", "month", rounded("value").alias("value"))


@query(f"WITH {P.STATIONS_SQL} SELECT entity, month, {r6('avg(x)')} AS value FROM stations GROUP BY ALL")
def station_combine_raw(spark, d):
    return clean.combine_stations(P.stations(spark, d), E, "station", "month", "x", raw=True).select("entity", "month", rounded("value").alias("value"))


@query(f"WITH {P.STATIONS_SQL} SELECT entity, month, {r6('count(x) / count(*)')} AS coverage FROM stations GROUP BY ALL")
def station_coverage(spark, d):
    return calendar.coverage(P.stations(spark, d), E, "month", "x").select("entity", "month", rounded("coverage").alias("coverage"))


@query(f"""WITH {P.monthly_positions_sql('n_name')}
SELECT entity, month, {r6('level - avg(CASE WHEN is_train THEN level END) OVER (PARTITION BY entity, month(month))')} AS level FROM panel""")
def deseasonalise_train_only(spark, d):
    rows = P.monthly_positions(spark, d, "n_name").withColumn("season", F.month("month"))
    return clean.deseasonalise(rows, E, "season", "level").select("entity", "month", rounded("level").alias("level"))


@query(f"WITH {P.HOURLY_SQL} SELECT entity, pos, {r6('level - avg(level) OVER (PARTITION BY entity, pos % 24)')} AS level FROM hourly")
def deseasonalise_full(spark, d):
    rows = P.hourly(spark, d).withColumn("season", F.col("pos") % 24)
    return clean.deseasonalise(rows, E, "season", "level", None).select("entity", F.col("pos").cast("long").alias("pos"), rounded("level").alias("level"))


RUNS_SQL = P.SPARSE_SQL + ", " + TRAIN.format("sparse") + """,
islands AS (SELECT *, count(x) OVER (PARTITION BY entity ORDER BY pos) AS g FROM s),
runs AS (SELECT entity, g, min(pos) AS a, max(pos) AS b, count(*) AS n FROM islands WHERE x IS NULL GROUP BY ALL),
train_runs AS (SELECT entity, g, count(*) AS n FROM islands WHERE x IS NULL AND is_train GROUP BY ALL)"""


@query(f"WITH {RUNS_SQL} SELECT entity, coalesce(max(n), 0)::BIGINT AS longest FROM (SELECT DISTINCT entity FROM s) LEFT JOIN runs USING (entity) GROUP BY entity")
def longest_gap(spark, d):
    return gaps.longest_gap(P.sparse(spark, d), E, "pos", "x")


@query(f"WITH {RUNS_SQL} SELECT entity, pos, {r6('x')} AS x FROM s ANTI JOIN (SELECT entity FROM train_runs WHERE n > 12) USING (entity)")
def long_gap_exclusion(spark, d):
    """A limit of 12: with the default of 6 nothing would be left of this panel."""
    return gaps.without_long_gaps(_sparse_train(spark, d), E, "pos", "x", 12).select("entity", F.col("pos").cast("long").alias("pos"), rounded("x").alias("x"))


@query(f"WITH {RUNS_SQL} SELECT entity, {r6('avg((x IS NULL)::INT)')} AS missing, avg((x IS NULL)::INT) > 0.15 AS warned FROM s WHERE is_train GROUP BY entity")
def gap_warning(spark, d):
    return gaps.gap_share(_sparse_train(spark, d), E, "x", 0.15).select("entity", rounded("missing").alias("missing"), "warned")


@query(f"WITH {RUNS_SQL} SELECT entity, a AS span_start, least(b + 1, top) AS span_end FROM runs JOIN (SELECT entity, max(pos) AS top FROM s GROUP BY entity) USING (entity) WHERE n >= 2")
def gap_spans(spark, d):
    out = gaps.gap_spans(P.sparse(spark, d), E, "pos", "x")
    return out.select("entity", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"))


@query(f"""WITH {RUNS_SQL}, w AS (
  SELECT i.entity, i.pos, i.x, r.n, p.x AS l, q.x AS r, r.a, r.b FROM islands i LEFT JOIN runs r ON i.entity = r.entity AND i.g = r.g AND i.x IS NULL
  LEFT JOIN s p ON p.entity = r.entity AND p.pos = r.a - 1 LEFT JOIN s q ON q.entity = r.entity AND q.pos = r.b + 1)
SELECT entity, pos, {r6('CASE WHEN x IS NOT NULL THEN x WHEN n <= 6 THEN coalesce(l + (r - l) * (pos - a + 1) / (b - a + 2), l, r) END')} AS x FROM w""")
def bounded_gap_fill(spark, d):
    return gaps.bounded_fill(P.sparse(spark, d), E, "pos", "x", 6).select("entity", F.col("pos").cast("long").alias("pos"), rounded("x").alias("x"))


@query(f"WITH {P.SPARSE_SQL} SELECT entity, pos, {r6('last_value(x IGNORE NULLS) OVER (PARTITION BY entity ORDER BY pos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS x FROM sparse")
def limited_ffill(spark, d):
    return gaps.limited_ffill(P.sparse(spark, d), E, "pos", "x", 6).select("entity", F.col("pos").cast("long").alias("pos"), rounded("x").alias("x"))


@query(f"""WITH {P.STATIONS_SQL}, y AS (SELECT DISTINCT entity, station, unnest(range(1995, 2003)) AS year FROM stations),
c AS (SELECT entity, station, year, count(CASE WHEN x IS NOT NULL AND month(month) <> 2 THEN 1 END) AS k FROM y LEFT JOIN (SELECT *, year(month) AS year FROM stations) USING (entity, station, year) GROUP BY ALL)
SELECT entity, station, sum(k)::BIGINT AS months_present, {r6('100.0 * sum(k) / (12 * count(CASE WHEN NOT (year = 2002 AND k = 0) THEN 1 END))')} AS completeness,
  coalesce(bool_or(k = 0 AND year <> 2002), false) AS has_missing_year FROM c GROUP BY ALL""")
def yearly_completeness(spark, d):
    rows = P.stations(spark, d).withColumn("full", F.month("month") != 2)
    out = calendar.yearly_completeness(rows, ["entity", "station"], "month", "x", "full", 1995, 2002, True)
    return out.select("entity", "station", "months_present", rounded("completeness").alias("completeness"), "has_missing_year")


@query(f"WITH {P.STATIONS_SQL} SELECT entity, month, {r6('CASE WHEN count(x) = count(*) THEN sum(x) END')} AS total FROM stations GROUP BY ALL")
def flow_sum_strict_null(spark, d):
    return P.stations(spark, d).groupBy("entity", "month").agg(rounded(calendar.strict_sum("x")).alias("total"))


@query(f"WITH {P.monthly_sql()} SELECT entity, month, {r6('CASE WHEN year(month) BETWEEN 1997 AND 1999 THEN level END')} AS level FROM monthly")
def subperiod_mask(spark, d):
    rows = P.monthly(spark, d).withColumns({"y": F.year("month"), "a": F.lit(1997), "b": F.lit(1999)})
    return rows.select("entity", "month", rounded(within_years("level", "y", "a", "b")).alias("level"))


@query(f"""WITH {P.monthly_sql()}, x AS (SELECT entity, month, unnest(['T', 'SWE', 'P', 'R', 'Evap', 'WL']) AS variable, disc AS value FROM monthly)
SELECT entity, month, variable, {r6("CASE variable WHEN 'T' THEN value - 273.15 WHEN 'SWE' THEN value * 1000 WHEN 'P' THEN value * 1000 * day(last_day(month)) WHEN 'R' THEN value * 1000 * day(last_day(month)) WHEN 'Evap' THEN -value * 1000 * day(last_day(month)) ELSE value END")} AS value,
  ((year(month) - 1995) * 12 + month(month))::INTEGER AS number FROM x""")
def unit_convert(spark, d):
    rows = P.monthly(spark, d).select("entity", "month", F.explode(F.array(*map(F.lit, ("T", "SWE", "P", "R", "Evap", "WL")))).alias("variable"), F.col("disc").alias("value"))
    return rows.select("entity", "month", "variable", rounded(convert_units("variable", "value", "month")).alias("value"), month_offset("month", F.lit("1995-01-01").cast("date")).cast("int").alias("number"))


LEVEL_W = "OVER (PARTITION BY entity ORDER BY pos)"


def _full(how, n, lag=1):
    frame = f"OVER (PARTITION BY entity ORDER BY pos ROWS BETWEEN {lag + n - 1} PRECEDING AND {lag} PRECEDING)"
    return lambda x: f"CASE WHEN count({x}) {frame} = {n} THEN {how}({x}) {frame} END"


@query(f"""WITH {P.HOURLY_SQL} SELECT entity, pos, {', '.join(f"{r6(f'lag(level, {k}) {LEVEL_W}')} AS level_lag{k}" for k in (1, 2, 3, 6, 12))},
{r6(f'lag(level, 1) {LEVEL_W} - lag(level, 2) {LEVEL_W}')} AS level_diff1, {r6(f'lag(level, 1) {LEVEL_W} - lag(level, 4) {LEVEL_W}')} AS level_diff3,
{r6(_full('avg', 3)('level'))} AS level_mean3, {r6(_full('avg', 6)('level'))} AS level_mean6, {r6(_full('stddev_samp', 3)('level'))} AS level_std3 FROM hourly""")
def level_features(spark, d):
    rows = windows.level_features(P.hourly(spark, d), E, "pos", "level")
    return rows.select("entity", F.col("pos").cast("long").alias("pos"), *(rounded(c).alias(c) for c in rows.columns if c.startswith("level_")))


@query(f"""WITH {P.HOURLY_SQL} SELECT entity, pos, {', '.join(f"{r6(f'lag({v}, {k}) {LEVEL_W}')} AS {v}_at, {r6(_full('avg', 3, k)(v))} AS {v}_mean3, {r6(_full('avg', 6, k)(v))} AS {v}_mean6" for v, k in (('p', 2), ('t', 5)))} FROM hourly""")
def driver_antecedents(spark, d):
    rows = windows.driver_features(P.hourly(spark, d).select("entity", "pos", "p", "t"), E, "pos", {"p": 2, "t": 5})
    return rows.select("entity", F.col("pos").cast("long").alias("pos"), *(rounded(c).alias(c) for c in rows.columns if c not in ("entity", "pos", "p", "t")))


@query(f"""WITH {P.monthly_sql('n_name')}, c AS (SELECT entity, count(level) AS n FROM monthly GROUP BY entity),
f AS (SELECT *, n // 2 AS a, (n - n // 2) // 4 AS size, unnest([0, 1, 2]) AS fold FROM c)
SELECT entity, n, fold, (a + fold * size)::BIGINT AS train_end, (a + (fold + 1) * size)::BIGINT AS val_end FROM f WHERE size >= 5 AND a + (fold + 1) * size <= n""")
def expanding_splits(spark, d):
    counts = P.monthly(spark, d, "n_name").groupBy("entity").agg(F.count("level").alias("n"))
    out = windows.expanding_splits(counts)
    return out.select("entity", "n", "fold", F.col("train_end").cast("long").alias("train_end"), F.col("val_end").cast("long").alias("val_end"))


@query(f"WITH {P.monthly_positions_sql()} SELECT entity, month, pos, is_train FROM panel")
def train_test_cut(spark, d):
    return P.monthly_positions(spark, d).select("entity", "month", "pos", "is_train")


@query(f"""WITH {P.monthly_positions_sql()}, l AS (SELECT entity, month, is_train, unnest(['level', 'qty']) AS variable, unnest([level, qty]) AS value FROM panel),
a AS (SELECT entity, month, variable, value - avg(CASE WHEN is_train THEN value END) OVER (PARTITION BY entity, variable, month(month)) AS value FROM l),
x AS (SELECT 'raw' AS layer, entity, month, variable, value FROM l UNION ALL SELECT 'deseasonalised', entity, month, variable, value FROM a)
SELECT layer, entity, month, variable, {r6('value')} AS value FROM x""")
def dataset_layers_union(spark, d):
    long = P.monthly_positions(spark, d).select("entity", "month", "is_train", F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in ("level", "qty")))).alias("x")).select("entity", "month", "is_train", "x.*")
    anomaly = clean.deseasonalise(long.withColumn("season", F.month("month")), ["entity", "variable"], "season", "value")
    rows = report.dataset_layers(long.select("entity", "month", "variable", "value"), anomaly.select("entity", "month", "variable", "value"))
    return rows.select("layer", "entity", "month", "variable", rounded("value").alias("value"))


@query(f"""WITH {P.SPARSE_SQL} SELECT 'raw' AS layer, entity::VARCHAR AS variable, {r6('100 * avg((x IS NOT NULL)::INT)')} AS percent FROM sparse GROUP BY ALL""")
def dataset_completeness(spark, d):
    rows = P.sparse(spark, d).select(F.lit("raw").alias("layer"), F.col("entity").cast("string").alias("variable"), F.col("x").alias("value"))
    return report.completeness(rows).select("layer", "variable", rounded("percent").alias("percent"))


@query("""WITH x AS (SELECT o_custkey % 20 AS entity, o_orderpriority AS variable, count(*)::INTEGER AS lag FROM orders GROUP BY ALL)
SELECT entity, '{' || string_agg('"' || variable || '":' || lag, ',' ORDER BY variable) || '}' AS lags FROM x GROUP BY entity""")
def json_lag_map(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").groupBy((F.col("o_custkey") % 20).alias("entity"), F.col("o_orderpriority").alias("variable")).agg(F.count("*").cast("int").alias("lag"))
    return rows.groupBy("entity").agg(F.collect_list(F.struct("variable", "lag")).alias("e")).select("entity", lag_map_json("e").alias("lags"))


@query(f"""WITH {P.HOURLY_SQL}, c AS (SELECT entity, level - avg(level) OVER (PARTITION BY entity) AS x FROM hourly)
SELECT entity, count(x) AS n, count(*) - count(x) AS n_missing, {r6('stddev_samp(x)')} AS std, {r6('quantile_cont(x, 0.75) - quantile_cont(x, 0.25)')} AS iqr, {r6('max(x) - min(x)')} AS span FROM c GROUP BY entity""")
def availability_stats(spark, d):
    return report.availability(P.hourly(spark, d), E, "level").select("entity", "n", "n_missing", *(rounded(c).alias(c) for c in ("std", "iqr", "span")))
