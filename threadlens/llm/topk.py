"""Exact top-k search by tiled matrix products.

Vectors are dealt into shards and queries into blocks. A task holds one shard and one block of queries,
multiplies them tile by tile, keeps the best few of each tile, and the lists of all shards merge in a
tree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import shared_table, ship

FANOUT = 32


def quantised(flat: np.ndarray, rows: int) -> np.ndarray:
    """floor(256 * x) of each component, as 64-bit integers (kept within +-2**62)."""
    whole = np.floor(256.0 * flat.astype(np.float64))
    return np.clip(whole, -(2.0**62), 2.0**62).astype(np.int64).reshape(rows, -1)


def matrix(table: pa.Table, id_column: str, vector_column: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, quantised vectors), by id."""
    ids = table.column(id_column).to_numpy()
    flat = table.column(vector_column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return ids[order], quantised(flat, len(ids))[order]


def best_of_tile(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each row's k highest scores, ties to the smaller id. ``ids`` ascend."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        row, col = np.nonzero(scores >= least[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(scores.shape))
    value = scores[row, col]
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], ids[col[keep]], value[keep]


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int,
           tile: tuple[int, int] = (512, 4096)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of the k best per query in one shard, a query's own id left out."""
    out = [(np.empty(0, np.int64),) * 3]
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    exact = bound < 2.0**53  # then products of floats are exact; else integers, wrapping like a long
    left, right = (queries.astype(np.float64), vectors.astype(np.float64)) if exact else (queries, vectors)
    none = -np.inf if exact else np.iinfo(np.int64).min
    for i in range(0, len(query_ids), tile[0]):
        held = [(np.empty(0, np.int64),) * 3]
        for j in range(0, len(ids), tile[1]):
            scores = left[i : i + tile[0]] @ right[j : j + tile[1]].T
            lo = np.searchsorted(ids[j : j + tile[1]], query_ids[i : i + tile[0]], "left")
            hi = np.searchsorted(ids[j : j + tile[1]], query_ids[i : i + tile[0]], "right")
            for r in np.nonzero(hi > lo)[0]:
                scores[r, lo[r] : hi[r]] = none
            row, found, value = best_of_tile(scores, ids[j : j + tile[1]], k)
            real = value != none
            held.append((row[real], found[real], value[real].astype(np.int64)))
        row, found, value = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((found, -value, row))
        row, found, value = row[order], found[order], value[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((query_ids[i + row[keep]], found[keep], value[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, task_bytes: int = 8 << 20, shard_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """The ``k`` highest integer inner products of every query against every other vector.

    ``vectors``: vec_id, embedding (others are ignored); ``is_query`` picks the queries among its rows.
    Returns query_id, rank (from 1), vec_id, score; fewer than k rows where there are fewer candidates.
    Left out on both sides: null ids, null vectors, vectors with a null or non-finite component. A row
    repeated exactly counts once; a vector is only compared with vectors of its own length and never with
    its own id. Ties go to the smaller vec_id. Empty tables give an empty result.

    Components are kept within +-2**62 after scaling; a score beyond a long wraps.

    Scale: a task holds one shard and one block of queries, each of about ``task_bytes`` as 64-bit numbers (or ``shard_rows`` and
    ``block_rows`` vectors). Queries are sent to every shard and vectors to every block, so what is shuffled is the number of queries times
    that of vectors over the rows of a task: memory stays flat, and larger tasks shuffle less. Lists merge in a tree of fan-out
    32, so no task sees all shards of a query.
    """
    ship(vectors.sparkSession)
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    clean = shared_table(
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .withColumn("asks", F.coalesce(is_query, F.lit(False)))
        .select(F.col("vec_id").cast("long"), "embedding", "asks").where(finite).distinct(), "vectors")
    rows, asking, longest = clean.agg(F.count("*"), F.count_if("asks"), F.max(F.size("embedding"))).first()
    held = max(1, task_bytes // (8 * max(1, longest or 0)))
    shard_rows, block_rows = shard_rows or held, block_rows or held
    shards, blocks = max(1, math.ceil(rows / shard_rows)), max(1, math.ceil(asking / block_rows))
    width = F.size("embedding")
    dealt = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int")
    right = clean.select("vec_id", "embedding", width.alias("width"), dealt.alias("shard"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int")
    left = clean.where("asks").select(F.col("vec_id").alias("ask_id"), F.col("embedding").alias("ask"), width.alias("ask_width"),
                                      dealt.alias("ask_block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("ask_shard"))

    def pair(key, ask: pa.Table, have: pa.Table) -> pa.Table:
        if ask.num_rows == 0 or have.num_rows == 0:
            found = (np.empty(0, np.int64),) * 3
        else:
            query_ids, queries = matrix(ask, "ask_id", "ask")
            ids, stored = matrix(have, "vec_id", "embedding")
            if len(set(query_ids.tolist())) < len(query_ids):  # one id with several vectors: each asks
                parts = [search(query_ids[[i]], queries[[i]], ids, stored, k) for i in range(len(query_ids))]
                found = tuple(np.concatenate(x) for x in zip(*parts))
            else:
                found = search(query_ids, queries, ids, stored, k)
        shard = np.full(len(found[0]), key[0].as_py(), np.int32)
        return pa.table({"query_id": found[0], "shard": shard, "vec_id": found[1], "score": found[2]})

    lists = (left.groupBy("ask_shard", "ask_width", "ask_block").cogroup(right.groupBy("shard", "width", "block"))
             .applyInArrow(pair, "query_id long, shard int, vec_id long, score long"))
    best = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("down"), "vec_id"))), 1, k)
    merged, level = lists, shards
    while True:
        level = math.ceil(level / FANOUT)
        merged = merged.withColumn("shard", F.floor(F.col("shard") / FANOUT).cast("int"))
        merged = merged.groupBy("query_id", "shard").agg(best.alias("best"))
        if level == 1:
            break
        merged = merged.select("query_id", "shard", F.explode("best").alias("b")).select(
            "query_id", "shard", "b.vec_id", (-F.col("b.down")).alias("score"))
    return merged.select("query_id", F.posexplode("best").alias("place", "b")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.down")).alias("score"))
