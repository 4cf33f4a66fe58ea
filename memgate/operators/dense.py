"""Exact nearest vectors: blocks of vectors against a matrix of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of one broadcast block of queries; more queries take several passes.
BLOCK_BYTES = 64 << 20


def blocks(queries: DataFrame):
    """(ids, unit vectors) of the queries, BLOCK_BYTES at a time, by dimension."""
    ids, vectors, size = [], [], 0
    for key, v in queries.toLocalIterator():
        if not v:
            continue
        if vectors and (size >= BLOCK_BYTES or len(v) != len(vectors[0])):
            yield ids, np.array(vectors)
            ids, vectors, size = [], [], 0
        ids.append(key)
        vectors.append(v)
        size += 8 * len(v)
    if vectors:
        yield ids, np.array(vectors)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, item, cosine and rank of the k nearest other items of each query. vectors: (item, embedding); queries:
    (query_id, embedding), a stated set. A task keeps k items a query of what it has read; only those move."""
    spark = vectors.sparkSession
    found = None
    for ids, matrix in blocks(queries.select("query_id", "embedding")):
        norm = np.linalg.norm(matrix, axis=1)
        shared = spark.sparkContext.broadcast((np.array(ids, np.int64), matrix, norm))

        def run(batches, shared=shared):
            ids, matrix, norm = shared.value
            best: list = [None] * len(ids)
            for b in batches:
                items = b.column(0).to_numpy(zero_copy_only=False)
                rows = b.column(1).to_pylist()
                ok = np.array([v is not None and len(v) == matrix.shape[1] for v in rows], bool)
                if not ok.any():
                    continue
                own, m = items[ok], np.array([v for v, o in zip(rows, ok) if o], float)
                both = np.linalg.norm(m, axis=1)[:, None] * norm[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    cos = np.where(both > 0, m @ matrix.T / both, 0.0)
                cos = np.round(cos, 6)
                for q in range(len(ids)):
                    keep = own != ids[q]
                    s, i = cos[keep, q], own[keep]
                    if best[q] is not None:
                        s, i = np.concatenate((best[q][0], s)), np.concatenate((best[q][1], i))
                    at = np.lexsort((i, -s))[:k]
                    best[q] = s[at], i[at]
            rows = [(int(ids[q]), int(i), float(s)) for q, own in enumerate(best) if own is not None for s, i in zip(*own)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["query_id", "item", "cosine"])

        part = vectors.select("item", "embedding").mapInArrow(run, "query_id long, item long, cosine double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, item long, cosine double, rank long")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "item")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
