"""Operator 10: exact top-k by inner product, reading sorted lists without random access.

Vectors are dealt into blocks; a block keeps one list per component, sorted by value. For a query, a
list is read from its top where the weight is positive and from its bottom where it is negative.
After reading to some depth, what is unread in a list lies between the value last read and the
list's other end, which gives each vector a lower and an upper bound of its score; the bounds of all
queries and vectors of a pair of blocks are matrix products. A vector whose upper bound is below the
k-th best lower bound cannot qualify. When few enough remain, or the lists end, the scores of the
remaining are resolved. The best k of each pair of blocks meet per query.

Scores are integers: components are floor(scale * x); vectors of different lengths count as padded
with zeros. Cases: vectors that are null, or hold null or non-finite components, and rows without id
take no part; a query is not its own candidate, nor is a row that repeats its id; a repeated query id
is asked once, with its smallest vector; ties go to the smaller id; with fewer than k others all are
returned; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VECTOR_BLOCK = 16384
QUERY_BLOCK = 8192         # queries that meet a vector block in one task
QUERIES_AT_ONCE = 512      # of which so many are held against it together
DEPTHS = (0.8, 0.9, 0.95, 1.0)  # parts of a list read before the bounds are compared


def _packed(rows: DataFrame, block: str) -> DataFrame:
    """One row per block: ids, vector length, integer components, and each component's sorted list."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy().astype(np.int64)
        vectors = table["vector"].to_pylist()
        whole = np.zeros((len(ids), max(map(len, vectors))), np.int64)
        for row, v in zip(whole, vectors):
            row[:len(v)] = v
        lists = np.argsort(whole, axis=0, kind="stable").astype(np.int32)
        return pa.table({block: pa.array([table[block][0].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()),
                         "width": pa.array([whole.shape[1]], pa.int32()), "whole": pa.array([whole.tobytes()], pa.binary()),
                         "lists": pa.array([lists.tobytes()], pa.binary())})

    return rows.groupBy(block).applyInArrow(run, f"{block} int, ids binary, width int, whole binary, lists binary")


def _unpack(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(table["ids"][0].as_py(), np.int64)
    own = table["width"][0].as_py()
    whole = np.zeros((len(ids), width), np.int64)
    lists = np.tile(np.arange(len(ids), dtype=np.int32)[:, None], (1, width))
    if own:
        whole[:, :own] = np.frombuffer(table["whole"][0].as_py(), np.int64).reshape(len(ids), own)
        lists[:, :own] = np.frombuffer(table["lists"][0].as_py(), np.int32).reshape(len(ids), own)
    return ids, whole, lists


def _number_type(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The fastest type in which every partial score is exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def aggregate_block(queries: np.ndarray, vectors: np.ndarray, lists: np.ndarray, k: int,
                    depths: tuple[float, ...] = DEPTHS, asks: np.ndarray | None = None,
                    ids: np.ndarray | None = None) -> list[np.ndarray]:
    """Per query the vectors that can be among its k best; given the ids of queries and vectors, without
    the vectors of the query's own id, however many they are."""
    own = np.zeros((len(queries), len(vectors)), bool) if asks is None else np.equal.outer(asks, ids)
    n, kind = len(vectors), _number_type(queries, vectors)
    if n <= k:
        return [np.flatnonzero(~o) for o in own]
    least = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    values = vectors.astype(kind)
    up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    column = np.arange(vectors.shape[1])
    bottom, top = values[lists[0], column], values[lists[-1], column]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
    open_ = np.arange(len(queries))
    for depth in depths:
        read = min(n, max(1, int(n * depth)))
        high, low = values[lists[n - read], column], values[lists[read - 1], column]
        p, m = up[open_], down[open_]
        if read < n:
            upper = p @ np.maximum(values, high).T + m @ np.minimum(values, low).T
            lower = p @ np.where(values >= high, values, bottom).T + m @ np.where(values <= low, values, top).T
        else:
            upper = lower = (p + m) @ values.T
        mine = own[open_]
        bar = np.partition(np.where(mine, kind(least), lower), n - k, axis=1)[:, n - k]
        may = (upper >= bar[:, None]) & ~mine
        done = may.sum(1) <= 8 * k if read < n else np.ones(len(open_), bool)
        for i in np.flatnonzero(done):
            out[open_[i]] = np.flatnonzero(may[i])
        open_ = open_[~done]
        if not len(open_):
            break
    return out


def top_k(rows: DataFrame, id_column: str, vector_column: str, is_query: Column, k: int, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for every row that satisfies ``is_query`` its k best others."""
    spark = rows.sparkSession
    vector = F.transform(vector_column, lambda x: F.floor(x.cast("double") * scale))
    whole = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = rows.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & whole)
    used = used.select(F.col(id_column).cast("long").alias("id"), vector.alias("vector"), is_query.alias("asks"))
    size = used.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    c_blocks, q_blocks = max(1, -(-size["n"] // VECTOR_BLOCK)), max(1, -(-size["q"] // QUERY_BLOCK))
    deal = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    # Of equal rows, all with one score, no list of k holds more than k; so no id and no row fills a block.
    copies = used.groupBy("id", "vector").agg(F.count("*").alias("copies"))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    cands = _packed(copies.select("id", "vector", deal(c_blocks, "id", "vector", "copy").alias("cb")), "cb")
    asked = used.where("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    asked = _packed(asked.withColumn("qb", deal(q_blocks, "id")), "qb")
    # The stated query set against all rows: every query block meets every vector block once.
    left = cands.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = asked.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    schema = "query_id long, vec_id long, score long"

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if c.num_rows and q.num_rows:
            width = max(c["width"][0].as_py(), q["width"][0].as_py())
            ids, vectors, lists = _unpack(c, width)
            asks, queries, _ = _unpack(q, width)
            for at in range(0, len(asks), QUERIES_AT_ONCE):
                a, q_ = asks[at:at + QUERIES_AT_ONCE], queries[at:at + QUERIES_AT_ONCE]
                for ask, query, some in zip(a, q_, aggregate_block(q_, vectors, lists, k, asks=a, ids=ids)):
                    score = vectors[some] @ query
                    best = np.lexsort((ids[some], -score))[:k]
                    for o, v in zip(out, (np.full(len(best), ask), ids[some][best], score[best])):
                        o.append(v)
        return pa.table({n: pa.array(np.concatenate([np.zeros(0, np.int64), *o]), pa.int64())
                         for n, o in zip(("query_id", "vec_id", "score"), out)})

    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
