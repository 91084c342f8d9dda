"""Exact top-k inner-product search with an impact-ordered, score-at-a-time index.

A block of rows is indexed by segments: for each component, the rows whose value falls into one quantised level. For a
query, a segment's impact is the most that its level can add beyond the component's lowest level. Segments are
processed by descending impact. At any time a row's score is at most what it has gathered, plus the base, plus the
largest impact still open in each component; a row can be a member of the answer only while that bound reaches the k-th
best score known exactly. Processing stops when this proves all but a few rows out (or at the end), and the possible
members are rescored exactly, so ties and results are those of the full product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable


class ImpactIndex:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, levels: int = 8):
        self.ids, self.rows, self.levels = ids, rows, levels
        low, high = rows.min(axis=0, initial=0), rows.max(axis=0, initial=0)
        width = np.maximum(1, -(-(high - low + 1) // levels))
        codes = (rows - low) // width
        at = np.arange(levels)
        self.least = low[:, None] + at * width[:, None]
        self.most = np.minimum(self.least + width[:, None] - 1, high[:, None])
        self.members = []
        for j in range(rows.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            cuts = np.searchsorted(codes[order, j], np.arange(levels + 1))
            self.members.append([order[a:b] for a, b in zip(cuts, cuts[1:])])

    def search(self, query: np.ndarray, k: int, own: int, every: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own; ties to the smaller id."""
        top = np.maximum(query[:, None] * self.most, query[:, None] * self.least)
        base = top.min(axis=1)
        gain = top - base[:, None]
        open_gain = gain.max(axis=1)
        ranked = np.argsort(-gain, axis=None, kind="stable")
        ranked = ranked[gain.ravel()[ranked] > 0]
        # The next impact of a component once a segment is done: the next lower level in the direction of the query.
        after = np.where((query > 0)[:, None], np.roll(gain, 1, axis=1), np.roll(gain, -1, axis=1))
        got = np.full(len(self.ids), base.sum(), dtype=np.int64)
        barred = self.ids == own
        got[barred] = np.iinfo(np.int64).min // 2
        bar, hopeful = None, ~barred
        if k < len(self.ids):
            for n, segment in enumerate(ranked.tolist()):
                j, c = divmod(segment, self.levels)
                got[self.members[j][c]] += gain[j, c]
                open_gain[j] = after[j, c]
                if (n + 1) % every == 0:
                    seen = np.argpartition(-got, k)[: k + 1]
                    seen = seen[~barred[seen]]
                    scores = np.sort(self.rows[seen] @ query)
                    if len(scores) >= k:
                        bar = max(scores[-k], bar if bar is not None else scores[-k])
                        hopeful = (got + open_gain.sum() >= bar) & ~barred
                        if hopeful.sum() <= 16 * k:
                            break
            else:
                if bar is not None:
                    hopeful = (got >= bar) & ~barred
        rows = np.flatnonzero(hopeful)
        scores = self.rows[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def vectors(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and floor(1024 x) of the rows without nulls and non-finite components."""
    ids, lists = table.column("vec_id"), table.column("embedding")
    if isinstance(lists, pa.ChunkedArray):
        ids, lists = ids.combine_chunks(), lists.combine_chunks()
    found = []
    for i, (key, x) in enumerate(zip(ids.to_pylist(), lists)):
        if key is None or not x.is_valid or x.values.null_count:
            continue
        v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(v).all():
            found.append((i, key, np.floor(1024 * v).astype(np.int64)))
    dims = max((len(v) for _, _, v in found), default=0)
    rows = np.zeros((len(found), dims), dtype=np.int64)
    for r, (_, _, v) in zip(rows, found):
        r[: len(v)] = v
    return np.array([i for i, _, _ in found], dtype=np.int64), np.array([k for _, k, _ in found], dtype=np.int64), rows


def top_k(data: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``data`` for each row of ``queries`` (vec_id, embedding).

    Rows with the query's own id are no candidates. Vectors that are null or hold null or non-finite components, and
    rows without id, take no part; shorter vectors count as padded with zeros. Components are taken as floor(1024 x),
    which must stay below 2**31. Repeated rows are candidates each, but one query; vectors that share a query's id share
    its ranks. Rows are dealt to blocks by a hash, so that copies and hot values spread; each block is
    indexed once for every ``query_rows`` queries and returns k rows a query, which are then merged.
    """
    keep = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    data, queries = (x.where(keep).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding") for x in (data, queries))
    data, queries = durable(data), durable(queries.dropDuplicates())
    blocks, parts = -(-data.count() // block_rows) or 1, -(-queries.count() // query_rows) or 1
    data = data.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (_, ids, rows), (_, query_ids, wanted) = vectors(left), vectors(right)
        dims = max(rows.shape[1], wanted.shape[1])
        rows, wanted = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (rows, wanted))
        index, out = ImpactIndex(ids, rows), []
        for own, query in zip(query_ids.tolist(), wanted):
            found, scores = index.search(query, k, own)
            out.append((np.full(len(found), own), found, scores))
        columns = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), (), ()))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(lambda x: pa.array(x, pa.int64()), columns))))

    each = data.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(embeddings: DataFrame) -> DataFrame:
    """The ten best rows for every row whose id is divisible by 100."""
    return top_k(embeddings, embeddings.where("vec_id % 100 = 0"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 10
"""
