"""Exact top-k search by tiled matrix products and a tree of merges."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE_SCHEMA = "query_id long, shard int, vec_id long, score long"


@dataclass(frozen=True)
class Tiling:
    """About how many queries and rows a task multiplies, and how many lists a merge
    takes. None depends on the tables' sizes."""

    queries: int = 4096
    rows: int = 4096
    product: int = 512  # queries of one matrix product
    fan_in: int = 16


def usable(vector: Column) -> Column:
    """Not null, and neither null nor non-finite in any component."""
    fine = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _matrix(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, integer vectors as rows), by id."""
    ids = table["id"].to_numpy()
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in table["vector"].chunks]
    flat = np.concatenate(parts).astype(np.float64)
    order = np.argsort(ids, kind="stable")
    return ids[order], np.floor(256.0 * flat).reshape(len(ids), dim)[order]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point while every sum stays below 2**53."""
    dim = a.shape[1]
    if not dim:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * dim < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    limit = 2**63 - 1
    return np.clip(whole(a) @ whole(b).T, -limit, limit).astype(np.int64)


def _best_of_equal_ids(ids: np.ndarray, scores: np.ndarray, axis: int):
    """Rows (or columns) that share an id become one with their highest scores."""
    unique, first = np.unique(ids, return_index=True)
    if len(unique) == len(ids):
        return ids, scores
    return unique, np.maximum.reduceat(scores, first, axis=axis)


def tile_top(k: int, tiling: Tiling):
    """cogroup function: the k best rows of one shard for each query of one tile."""
    out = pa.schema(
        [("query_id", pa.int64()), ("shard", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())]
    )

    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return out.empty_table()
        dim, shard = key[0].as_py(), key[2].as_py()
        row_ids, b = _matrix(rows, dim)
        query_ids, a = _matrix(queries, dim)
        found: list[tuple] = []
        firsts = np.append(np.unique(query_ids, return_index=True)[1], len(query_ids))
        for at in range(0, len(firsts) - 1, tiling.product):
            start, stop = firsts[at], firsts[min(at + tiling.product, len(firsts) - 1)]
            ids, scores = _best_of_equal_ids(row_ids, _products(a[start:stop], b), 1)
            mine, scores = _best_of_equal_ids(query_ids[start:stop], scores, 0)
            for q, line in zip(mine, scores, strict=True):
                own = np.searchsorted(ids, q)
                at = np.arange(len(ids))
                if own < len(ids) and ids[own] == q:
                    at = np.delete(at, own)
                line = line[at]
                if len(line) > k:
                    # all above the k-th score, and of its ties those of smaller ids
                    bound = np.partition(line, len(line) - k)[len(line) - k]
                    above = np.flatnonzero(line > bound)
                    ties = np.flatnonzero(line == bound)[: k - len(above)]
                    take = np.concatenate([above, ties])
                else:
                    take = np.arange(len(line))
                found.append((np.full(len(take), q), ids[at][take], line[take]))
        q, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([q, np.full(len(q), shard, np.int32), v, s], schema=out)

    return run


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, tiling: Tiling = Tiling()
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product for
    each row that is a query, among all rows but its own; ties go to smaller vec_id.

    Components are floor(256 * x). vec_id names a vector: rows with the query's
    vec_id are its own, and of rows that share one the highest score counts. Rows
    with a null vec_id, and vectors that are null or hold a null or non-finite
    component, take no part. Only vectors of equal length are compared; empty ones
    score 0. A query without candidates has no row. Other columns are not looked at.

    Queries and rows are dealt by hash into tiles of bounded size, and each pair of
    tiles is one product: a row goes to every query tile and a query to every shard,
    which the question (all queries against all rows) asks for; no pair is a row.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("q")).filter(
        usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    )
    n_rows, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    shards = max(1, -(-n_rows // tiling.rows))
    tiles = max(1, -(-n_queries // tiling.queries))
    part = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    dim = F.size("embedding").alias("dim")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # under aliases, as the two sides of a cogroup may not share attributes
    own = [F.col("vec_id").alias("id"), F.col("embedding").alias("vector")]
    left = rows.filter("q").select(dim, part(tiles, 1).alias("tile"), every(shards).alias("shard"), *own)
    right = rows.select(dim, every(tiles).alias("tile"), part(shards, 2).alias("shard"), *own)
    keys = ("dim", "tile", "shard")
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile_top(k, tiling), TILE_SCHEMA)
    best = [F.col("score").desc(), F.col("vec_id")]
    while shards > 1:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / tiling.fan_in).cast("int"))
        ranked = F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*best))
        lists = lists.withColumn("rank", ranked).filter(F.col("rank") <= k).drop("rank")
        shards = -(-shards // tiling.fan_in)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best))
    return lists.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
