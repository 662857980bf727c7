"""Exact top-k inner products: tiled matrix products, partial selection per tile, tree merge per query.

Queries are read as a stream and cut into chunks of bounded bytes; one chunk at a time is broadcast, every
shard of candidates is multiplied with it tile by tile (a bounded number of scores each), and a task
keeps only the best of each query over all its tiles. The tasks' lists are merged in two levels, so no task
ever meets more than the lists of its own branch. More queries mean more chunks, not a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialise

#: Candidates of a tile, and its scores (8 bytes each).
TILE = 2048
SCORES = 1 << 20
EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def _clean(batch: pa.RecordBatch, id_column: str, column: str) -> dict[int, tuple[np.ndarray, list]]:
    """By vector length: (ids, matrix of floor(256 x)) of the rows that take part."""
    ids, vectors = batch.column(id_column), batch.column(column)
    if not len(batch):
        return {}
    flat = vectors.flatten().cast(pa.float64())
    lengths = np.where(vectors.is_valid().to_numpy(False), vectors.value_lengths().fill_null(0).to_numpy(False), 0)
    values = flat.to_numpy(False)
    starts = np.cumsum(lengths) - lengths
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    good = (lengths > 0) & ids.is_valid().to_numpy(False) & (bad[starts + lengths] == bad[starts])
    names = ids.fill_null(0).to_numpy(False)
    out = {}
    for size in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == size))
        with np.errstate(over="ignore"):
            matrix = np.floor(values[starts[rows][:, None] + np.arange(size)] * 256)
        out[int(size)] = (names[rows].astype(np.int64), matrix)
    return out


def _tile_best(q, c, k):
    """(query row, candidate row, score) of the k best of each query in one tile; ids ascend within the tile."""
    width = len(c)
    bound = max(1.0, float(np.abs(q).max(initial=0))) * max(1.0, float(np.abs(c).max(initial=0))) * q.shape[1]
    if bound * width < EXACT:
        key = q @ c.T
        key *= width
        key += np.arange(width - 1, -1, -1)
        take = min(k, width)
        best = np.argpartition(key, width - take, axis=1)[:, width - take :] if take < width else np.broadcast_to(np.arange(width), (len(q), width))
        rows = np.repeat(np.arange(len(q)), take)
        cols = best.ravel()
        return rows, cols, np.floor_divide(key[rows, cols], width).astype(np.int64)
    ints_c = [[int(x) for x in v] for v in c]  # beyond the exact range of doubles: integers of any size, clipped to a long
    found = []
    for i, v in enumerate(q):
        mine = [int(x) for x in v]
        scored = [(max(-_LONG, min(_LONG, sum(a * b for a, b in zip(mine, w, strict=True)))), -j) for j, w in enumerate(ints_c)]
        found += [(i, -j, s) for s, j in sorted(scored, reverse=True)[:k]]
    a = np.array([x[:2] for x in found], dtype=np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1], np.array([x[2] for x in found], dtype=np.int64)


def _merge(query, vec, score, own, k):
    """Keep the k best of each query: highest score first, then the smaller id, the query's equal last."""
    order = np.lexsort((own, vec, -score, query))
    query, vec, score, own = query[order], vec[order], score[order], own[order]
    first = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
    keep = rank < k
    return query[keep], vec[keep], score[keep], own[keep]


def _search(shards: DataFrame, chunk, k: int, id_column: str, column: str) -> DataFrame:
    """Of each task, the k + 1 best of each query, among them perhaps the query's own row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = chunk.value
        tops = {}
        for batch in batches:
            for size, (ids, matrix) in _clean(batch, id_column, column).items():
                if size not in groups:
                    continue
                _, q_ids, q = groups[size]
                order = np.argsort(ids, kind="stable")
                ids, matrix = ids[order], matrix[order]
                for at in range(0, len(ids), TILE):
                    names, tile = ids[at : at + TILE], matrix[at : at + TILE]
                    step = max(1, SCORES // len(names))
                    for low in range(0, len(q), step):
                        mine = q[low : low + step].astype(np.float64)
                        r, c, s = _tile_best(mine, tile, k + 1)
                        own = (q_ids[low + r] == names[c]) & (mine[r] == tile[c]).all(axis=1)
                        found = (r, names[c], s, own)
                        held = tops.get((size, low))
                        tops[size, low] = _merge(*(found if held is None else (np.concatenate(p) for p in zip(held, found, strict=True))), k + 1)
        for (size, low), (r, v, s, own) in tops.items():
            number, q_ids, _ = groups[size]
            yield pa.RecordBatch.from_arrays([pa.array(number[low + r]), pa.array(q_ids[low + r]), pa.array(v), pa.array(s), pa.array(own)], ["query", "query_id", "vec_id", "score", "own"])

    return shards.mapInArrow(run, "query long, query_id long, vec_id long, score long, own boolean")


def _packed(id_column: str, column: str):
    """Queries as rows of (length, ids, quantised vectors): blocks that the driver reads one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(size, ids.tobytes(), matrix.tobytes()) for size, (ids, matrix) in _clean(batch, id_column, column).items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["size", "ids", "data"])

    return run


def _chunks(packed: DataFrame, limit: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Queries by vector length, as (number, ids, vectors), in chunks of about ``limit`` bytes; a query's number is its own."""
    groups, held, number = {}, 0, 0

    def done():
        return {s: tuple(np.concatenate(x) for x in zip(*v, strict=True)) for s, v in groups.items()}

    for r in packed.toLocalIterator():
        ids, data = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["data"], np.float64).reshape(-1, r["size"])
        step = max(1, limit // (8 * r["size"]))
        for at in range(0, len(ids), step):
            some = slice(at, at + step)
            groups.setdefault(r["size"], []).append((number + np.arange(len(ids[some])), ids[some], data[some]))
            number, held = number + len(ids[some]), held + data[some].nbytes
            if held >= limit:
                yield done()
                groups, held = {}, 0
    if groups:
        yield done()


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_column: str = "vec_id", column: str = "embedding", chunk_bytes: int = 64 << 20, branches: int = 16
) -> DataFrame:
    """The k best other rows of ``vectors`` for each row of ``queries`` (same columns) by inner product of floor(256 x).

    Returns query_id, rank, vec_id, score; other columns are ignored. Ties go to the smaller id. Rows with a null id, a null or
    empty vector, or null, NaN or infinite components take no part, nor do vectors of another length
    than the query's. A query's own row is one row with its id and its vector; further rows with that id
    are candidates, as are rows that repeat another id, each of them. Queries that repeat an id are searched each and get a list
    each, with that id. Fewer than k candidates: all of them. Empty tables: no rows. Vectors of any length; scores beyond a long are clipped to it.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    shards = vectors.select(id_column, column)
    asked = queries.select(id_column, column).where(F.col(id_column).isNotNull() & F.col(column).isNotNull())
    packed = materialise(asked.mapInArrow(_packed(id_column, column), "size int, ids binary, data binary"), "queries")
    branch = Window.partitionBy("query", "_branch").orderBy(F.desc("score"), "vec_id", "own")
    final = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    parts = []
    for groups in _chunks(packed, chunk_bytes):
        chunk = spark.sparkContext.broadcast(groups)
        found = _search(shards, chunk, k, id_column, column).withColumn("_branch", F.pmod(F.spark_partition_id(), F.lit(branches)))
        best = found.withColumn("_r", F.row_number().over(branch)).where(F.col("_r") <= k + 1).drop("_r", "_branch")
        # One of the rows that equal the query is its own; all of them have one score, so any will do.
        equal_first = Window.partitionBy("query").orderBy(F.desc("own"), "vec_id")
        others = best.withColumn("_place", F.row_number().over(equal_first)).where(~F.col("own") | (F.col("_place") > 1))
        ranked = others.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(materialise(ranked, "top-k"))
        chunk.destroy()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
