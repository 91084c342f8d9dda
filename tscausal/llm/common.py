"""Shared helpers: reading tables, durable intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts are separated by the six ASCII white-space characters only.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only where none is set and Spark runs on this machine alone."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        path = context.getCheckpointDir()
    return path


def durable(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``durable`` that nothing reads any more: what came from them has been written too."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node that can be reached.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each round replaces the edges, so the
    state never holds more than one row per edge, and a hub only meets aggregations with a map-side part and joins
    that Spark can split. Rounds grow with the logarithm of the longest path.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = durable(edges.where("a <> b").select(high.alias("u"), low.alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()  # of distinct edges: equal only if they are
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = now.union(now.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, now = now, durable(small.select("e.u", "e.v").where("u <> v").distinct())
        release(last)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = now.select(F.col("v").alias("u"), "v").distinct()
    return now.union(tops).toDF("node", "root")
