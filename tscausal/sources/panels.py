"""Panels from the tables at hand, each with a SQL twin that opens a query as a list of CTEs.

hourly: five event types by hour, the level and five more variables; sparse: users in fives by hour, with real gaps;
monthly, by region or nation: order and item statistics; stations: market segments as stations of a nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendar import densify, positions, train_flag

HOURLY = ["level", "p", "r", "t", "swe", "evap"]
MONTHLY = ["level", "cnt", "qty", "disc", "tax"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("pos", F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, pos, level, p, r, t, swe, evap), complete hours."""
    cells = _events(spark, sf_dir).groupBy(F.col("event_type").alias("entity"), "pos").agg(
        F.avg("value").alias("level"), F.count("*").cast("double").alias("p"), F.sum("value").alias("r"), F.max("value").alias("t"), F.min("value").alias("swe"), F.count_distinct("user_id").cast("double").alias("evap")
    )
    return densify(cells, ["entity"], "pos")


HOURLY_SQL = """
hourly_cells AS (
  SELECT event_type AS entity, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS pos, avg(value) AS level, count(*)::DOUBLE AS p, sum(value) AS r,
    max(value) AS t, min(value) AS swe, count(DISTINCT user_id)::DOUBLE AS evap
  FROM events GROUP BY ALL
), hourly AS (
  SELECT s.entity, s.pos, level, p, r, t, swe, evap
  FROM (SELECT entity, unnest(range(min(pos), max(pos) + 1)) AS pos FROM hourly_cells GROUP BY entity) s LEFT JOIN hourly_cells USING (entity, pos)
)"""


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, pos, x) with gaps of all lengths."""
    cells = _events(spark, sf_dir).groupBy(F.expr("user_id div 5").alias("entity"), "pos").agg(F.avg("value").alias("x"))
    return densify(cells, ["entity"], "pos")


SPARSE_SQL = """
sparse_cells AS (
  SELECT user_id // 5 AS entity, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS pos, avg(value) AS x FROM events GROUP BY ALL
), sparse AS (
  SELECT s.entity, s.pos, x FROM (SELECT entity, unnest(range(min(pos), max(pos) + 1)) AS pos FROM sparse_cells GROUP BY entity) s LEFT JOIN sparse_cells USING (entity, pos)
)"""


def monthly(spark: SparkSession, sf_dir: str, by: str = "r_name") -> DataFrame:
    """(entity, month, level, cnt, qty, disc, tax), complete months; ``by``: r_name or n_name."""
    places = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    places = places.join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col(by).alias("entity"))
    month = F.trunc("o_orderdate", "month").alias("month")
    orders = _table(spark, sf_dir, "orders").join(places, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "entity", month)
    sums = orders.groupBy("entity", "month").agg(F.avg("o_totalprice").alias("level"), F.count("*").cast("double").alias("cnt"))
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax").join(orders.select("o_orderkey", "entity", "month"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.groupBy("entity", "month").agg(F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"))
    return densify(sums.join(items, ["entity", "month"], "left"), ["entity"], "month", "1 month")


def monthly_sql(by: str = "r_name") -> str:
    return f"""
monthly_orders AS (
  SELECT o_orderkey, o_totalprice, {by} AS entity, date_trunc('month', o_orderdate)::DATE AS month
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), monthly_sums AS (
  SELECT entity, month, avg(o_totalprice) AS level, count(*)::DOUBLE AS cnt FROM monthly_orders GROUP BY ALL
), monthly_items AS (
  SELECT entity, month, sum(l_quantity) AS qty, avg(l_discount) AS disc, avg(l_tax) AS tax FROM lineitem JOIN monthly_orders ON l_orderkey = o_orderkey GROUP BY ALL
), monthly AS (
  SELECT s.entity, s.month, level, cnt, qty, disc, tax
  FROM (SELECT entity, unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM monthly_sums GROUP BY entity) s
  LEFT JOIN monthly_sums USING (entity, month) LEFT JOIN monthly_items USING (entity, month)
)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, station, month, x): complete months of every station."""
    places = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("entity"), F.col("c_mktsegment").alias("station"))
    orders = _table(spark, sf_dir, "orders").join(places, F.col("o_custkey") == F.col("c_custkey"))
    return densify(orders.groupBy("entity", "station", F.trunc("o_orderdate", "month").alias("month")).agg(F.avg("o_totalprice").alias("x")), ["entity", "station"], "month", "1 month")


STATIONS_SQL = """
station_cells AS (
  SELECT n_name AS entity, c_mktsegment AS station, date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) AS x
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
), stations AS (
  SELECT s.entity, s.station, s.month, x
  FROM (SELECT entity, station, unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM station_cells GROUP BY entity, station) s
  LEFT JOIN station_cells USING (entity, station, month)
)"""


def hourly_train(spark: SparkSession, sf_dir: str, horizon: int = 37) -> DataFrame:
    return train_flag(hourly(spark, sf_dir), ["entity"], horizon)


def monthly_positions(spark: SparkSession, sf_dir: str, by: str = "r_name", horizon: int = 12) -> DataFrame:
    return train_flag(positions(monthly(spark, sf_dir, by), ["entity"], "month"), ["entity"], horizon)


def monthly_positions_sql(by: str = "r_name", horizon: int = 12) -> str:
    return monthly_sql(by) + f""",
panel AS (
  SELECT *, pos < n - {horizon} AS is_train FROM (
    SELECT *, row_number() OVER (PARTITION BY entity ORDER BY month) - 1 AS pos, count(*) OVER (PARTITION BY entity) AS n FROM monthly)
)"""


def coupled_maps(n: int = 335, strength: float = 0.32, seed: int = 0) -> list[tuple[int, float, float]]:
    """Two logistic maps of which x drives y (Sugihara et al. 2012): rows (pos, x, y)."""
    x, y, out = 0.4 + 0.01 * seed, 0.2, []
    for pos in range(n):
        out.append((pos, x, y))
        x, y = x * (3.8 - 3.8 * x), y * (3.5 - 3.5 * y - strength * x)
    return out
