"""Token counts from an exact length histogram.

Documents are encoded once; only (length, documents) leaves a task. Every later question is answered by suffix sums
over the histogram: documents of at least a length, total tokens, quantiles, and the tokens that a context limit keeps.
The sums run in two levels (blocks of lengths, then lengths of a block), so no window holds the whole histogram.
"""

from __future__ import annotations

import base64
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable

#: Fixed value: the split pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The vocabulary's ranks, read on the driver: some 50,000 entries, sent to the executors as one broadcast."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(length long, n_docs long) counted within each batch; null and empty texts have length 0."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches):
        import tiktoken
        from collections import Counter

        encoding = tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        for batch in batches:
            counts = Counter(len(encoding.encode_ordinary(x)) if x else 0 for x in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["length", "n_docs"])

    return docs.select("text").mapInArrow(run, "length long, n_docs long")


def histogram(lengths: DataFrame, block: int = 64) -> DataFrame:
    """One row per occurring length: n_docs, and the sums that answer totals, quantiles and truncated totals.

    ``docs_from`` / ``tokens_from``: documents of at least this length and their tokens. ``docs_share``: documents of
    at most this length as a share of all (the quantile). ``kept_at``: tokens left if every document is cut to this
    length; ``lost_at``: tokens cut off by that.
    """
    each = durable(lengths.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))).withColumn("block", F.floor(F.col("length") / block))
    tokens = F.col("length") * F.col("n_docs")
    blocks = each.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(above), zero).alias("docs_above"), F.coalesce(F.sum("t").over(above), zero).alias("tokens_above"), F.sum("d").over(whole).alias("docs"), F.sum("t").over(whole).alias("tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("length"))
    rows = each.join(blocks, "block")
    rows = rows.withColumn("docs_from", F.col("docs_above") + F.sum("n_docs").over(within)).withColumn("tokens_from", F.col("tokens_above") + F.sum(tokens).over(within))
    kept = F.col("tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")
    return rows.select("length", "n_docs", "docs_from", "tokens_from", ((F.col("docs") - F.col("docs_from") + F.col("n_docs")) / F.col("docs")).alias("docs_share"), kept.alias("kept_at"), (F.col("tokens") - kept).alias("lost_at"))


def limits(table: DataFrame, at: list[int], spark: SparkSession) -> DataFrame:
    """(context, kept, lost, docs_cut) for any context lengths, from the histogram alone."""
    wanted = spark.createDataFrame([(int(x),) for x in at], "context long")
    rows = table.agg(*(F.sum(F.least(F.col("length"), F.lit(int(x))) * F.col("n_docs")).alias(f"k{i}") for i, x in enumerate(at)), *(F.sum(F.when(F.col("length") > int(x), F.col("n_docs")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(at)), F.sum(F.col("length") * F.col("n_docs")).alias("total"))
    stacked = rows.select(F.explode(F.array(*(F.struct(F.lit(int(x)).cast("long").alias("context"), F.col(f"k{i}").alias("kept"), (F.col("total") - F.col(f"k{i}")).alias("lost"), F.col(f"c{i}").alias("docs_cut")) for i, x in enumerate(at)))).alias("r")).select("r.*")
    return wanted.join(stacked, "context")


def op3_token_counts(docs: DataFrame) -> DataFrame:
    """The histogram of whole texts; repeated rows count each, an empty table has no rows."""
    return histogram(encoded_lengths(docs))
