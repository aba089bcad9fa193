"""Exact top-k search: products of query tiles and shards, a selection in each tile, and a tree of merges."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

SHARD_ROWS, FAN_IN = 8_192, 16
#: A tile of queries: so many bytes of them, so that candidates are dealt out seldom, but within some bounds of rows.
TILE_BYTES, LEAST_TILE, MOST_TILE = 64 * 2**20, 2_048, 65_536
#: Queries whose products with a shard are held at once.
STEP = 256
LEAST, GREATEST = -(2**63), 2**63 - 1


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, dims, vector of long) with floor(scale * x) for each component; vectors that are null, empty or hold null,
    NaN or infinite components, and null ids, are left out."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    rows = vectors.where(good).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return rows.select("vec_id", F.size("x").alias("dims"), F.transform("x", lambda v: F.floor(v * scale)).alias("vector"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def best_of_tile(query_rows, queries, ids, row_of, rows, k: int):
    """(query rows, vec ids, scores): each query's ``k`` best in the tile, ties to the smaller id, its own row left out.

    Products are of doubles while these hold every sum exactly, and of Python's whole numbers beyond that; scores beyond a
    long are its least or greatest value."""
    order = np.argsort(ids, kind="stable")
    ids, row_of, rows = ids[order], row_of[order], rows[order]
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(rows.shape[1], 1)
    kind = np.float64 if most < 2**53 else object
    right = rows.astype(kind).T
    out_q, out_v, out_s = [], [], []
    for at in range(0, len(queries), STEP):
        scores = queries[at : at + STEP].astype(kind) @ right
        for q, line in zip(query_rows[at : at + STEP], scores, strict=True):
            other = np.flatnonzero(row_of != q)
            line = line[other]
            if kind is object:
                line = np.array([min(max(x, LEAST), GREATEST) for x in line], dtype=object)
            if len(line) > k and kind is np.float64:
                bar = np.partition(line, len(line) - k)[len(line) - k]
                above = np.flatnonzero(line > bar)
                picked = np.concatenate([above, np.flatnonzero(line == bar)[: k - len(above)]])
            else:
                picked = np.array(sorted(range(len(line)), key=lambda i: (-line[i], i))[:k], dtype=int)
            out_q.append(np.full(len(picked), q))
            out_v.append(ids[other[picked]])
            out_s.append(line[picked].astype(np.int64))
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_v, out_s)]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, query_tile: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each vector whose id ``every`` divides.

    Queries are dealt into tiles and all vectors into shards, both by hash; each pair of a tile and a shard is one task's
    product, of fixed size, which yields k rows a query. Lists then merge in a tree of ``FAN_IN`` shards a step.
    Each row is a query by itself: rows that repeat a query's id each have a list of ranks, and are candidates of each other, as
    only a query's own row is none. Vectors of other lengths than the query's are none either.
    Scores beyond a long are its least or greatest value, and tie as such. Fewer candidates than k give fewer rows; an empty table gives none; other columns are ignored.
    """
    rows = written(quantised(vectors).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    n, n_queries, dims = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.coalesce(F.max("dims"), F.lit(1))).collect()[0]
    query_tile = query_tile or min(MOST_TILE, max(LEAST_TILE, TILE_BYTES // (8 * dims)))
    shards, tiles = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n_queries / query_tile))
    tile = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile")
    shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    candidates = rows.select("dims", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), tile, F.col("vec_id").alias("other_id"), F.col("row").alias("other_row"), F.col("vector").alias("other"))
    queries = rows.where(is_query).select("dims", shard, F.pmod(F.xxhash64("row", F.lit(1)), F.lit(tiles)).cast("int").alias("tile"), "row", "vector")

    def product(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found, at = [np.zeros(0, np.int64)] * 3, 0
        else:
            at = key[1].as_py()
            found = best_of_tile(left["row"].to_numpy(), _matrix(left["vector"]), right["other_id"].to_numpy(), right["other_row"].to_numpy(), _matrix(right["other"]), k)
        return pa.table({"row": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64()), "shard": pa.array(np.full(len(found[0]), at), pa.int32())})

    key = ["dims", "shard", "tile"]
    lists = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(product, "row long, vec_id long, score long, shard int")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    while shards > FAN_IN:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int")).withColumn("rank", best("row", "shard")).where(F.col("rank") <= k).drop("rank")
        shards = math.ceil(shards / FAN_IN)
    ranked = lists.withColumn("rank", best("row")).where(F.col("rank") <= k)
    names = rows.where(is_query).select("row", F.col("vec_id").alias("query_id"))
    return ranked.join(names, "row").select("query_id", "rank", "vec_id", "score")
