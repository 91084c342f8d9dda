"""Files: typed CSV and JSON reads, resumable shards, durable intermediate tables."""

from __future__ import annotations

import sqlite3
import tempfile
import uuid
import warnings
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scalars import parse_bool, to_number

#: Schemas of the exchange formats.
LEVELS = "entity string, station string, month date, value double"
EDGES = (
    "cause string, effect string, status string, obs_lag int, obs_rho double, obs_n long, p_value double, null_mean double, null_std double, n_valid_surrogates int, "
    "convergence_diagnostic_pass string, kendall_tau double, kendall_p double, completed_at string"
)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a fixed schema; malformed numbers become null."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", enforceSchema=False)


def read_text_table(spark: SparkSession, path: str, numbers: list[str] = (), flags: list[str] = ()) -> DataFrame:
    """CSV read as text, then numbers and flags parsed tolerantly."""
    df = spark.read.csv(path, header=True)
    return df.withColumns({c: to_number(c) for c in numbers} | {c: parse_bool(c) for c in flags}) if numbers or flags else df


def read_sqlite(spark: SparkSession, path: str, sql: str, schema: str, rows: int = 10_000) -> DataFrame:
    """The rows that ``sql`` (one SELECT) gives in each SQLite file of ``path``, with the columns of ``schema`` in order.

    A task reads one file through Spark, so any store will do, and hands its rows on in batches; a file is held in memory
    and must be smaller than 2 GB. A file without the tables asked for is an error; one without rows gives none.
    """
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                db = sqlite3.connect(":memory:")
                db.deserialize(content.as_py())
                found = db.execute(sql)
                while some := found.fetchmany(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some), shape, strict=True)], schema=shape)
                db.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def station_readings(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Monthly readings as (station, month, value) from a download with columns named in another language.

    ``names`` maps the file's columns to station, year, month_number and value.
    """
    df = df.select(*(F.col(f"`{old}`").alias(new) for old, new in names.items()))
    return df.select("station", F.make_date(F.col("year").cast("int"), F.col("month_number").cast("int"), F.lit(1)).alias("month"), to_number("value").alias("value"))


def fetch_stations(stations: list[str], fetch: Callable[[str], DataFrame | None], warn: Callable[[str], None] = warnings.warn) -> list[DataFrame]:
    """What ``fetch`` (any reader: files, JDBC, a download) returns for each station. A station that fails or has no
    rows is left out with a warning; it is an error only if none is left."""
    found = []
    for station in stations:
        try:
            rows = fetch(station)
            if rows is None or rows.isEmpty():
                raise ValueError("no rows")
        except Exception as e:  # any reader's failure is that station's alone
            warn(f"station {station} is left out: {type(e).__name__}: {e}")
            continue
        found.append(rows.withColumn("station", F.lit(station)))
    if not found:
        raise ValueError(f"none of {len(stations)} stations has data")
    return found


def union_stations(frames: list[DataFrame], calendar: DataFrame) -> DataFrame:
    """All stations on one calendar (month); a station without rows is simply absent. At least one is needed."""
    if not frames:
        raise ValueError("no station has data")
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    months = calendar.select("month").distinct().agg(F.collect_list("month").alias("m"))  # some hundred months
    every = rows.select("station").distinct().join(months).select("station", F.explode("m").alias("month"))
    return every.join(rows, ["station", "month"], "left")


def write_shards(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends finished results, one folder per key, so that a later run can leave them out."""
    df.write.mode("append").partitionBy(*keys).parquet(path)


def remaining(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks that have no result yet."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def require_complete(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The results, or an error that names a few missing tasks: families of tests must not be merged in part."""
    missing = remaining(tasks, done, keys)
    some = missing.select(*keys).limit(5).collect()
    if some:
        raise ValueError(f"{missing.count()} results are missing, such as {[tuple(r) for r in some]}")
    return done


def read_parameters(spark: SparkSession, path: str, entities: DataFrame, variables: list[str], size: int = 3, tau: int = 1) -> DataFrame:
    """(entity, variable, size, tau, stored) from JSON files of objects with entity, variable, size and tau; what they
    lack, or hold without a positive size, gets the values given."""
    stored = spark.read.schema("entity string, variable string, size int, tau int").json(path).where("size > 0")
    stored = last_by(stored.withColumn("tau", F.coalesce("tau", F.lit(tau))), ["entity", "variable"], "size")
    wanted = entities.select("entity").distinct().withColumn("variable", F.explode(F.array(*map(F.lit, variables))))
    out = wanted.join(stored, ["entity", "variable"], "left")
    return out.select("entity", "variable", F.coalesce("size", F.lit(size)).alias("size"), F.coalesce("tau", F.lit(tau)).alias("tau"), F.col("size").isNotNull().alias("stored"))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def by_fingerprint(store: str, fingerprint: str, compute: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """The result kept under ``store``/``fingerprint``, computed and written there first if there is none."""
    path = f"{store}/{fingerprint}"
    if not exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last in order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a Parquet table in the folder of spark.checkpoint.dir; a temporary one only where none is set and Spark runs on this machine alone."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
