"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

A vector is a sparse row of terms, its components other than 0, quantised to integers. Candidates stay where they are read:
a task turns them into chunks of postings (term: rows, values). Queries are numbered and travel in blocks of bounded size,
one broadcast a block; for each block all candidates are scanned, and every query row scatters its weighted postings into a
dense array of scores, a number a candidate. Partition selection keeps the best of each chunk, chunk by chunk, and Spark
merges what the tasks kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sceneql.llm.common import prepared, table
from sceneql.llm.op10_order_minhash import numbered

K, EVERY, SCALE = 10, 100, 1024
#: Components and queries of a broadcast block at most (a longer vector is a block of its own); scores held at once by a task; queries that scatter together.
BLOCK_NUMBERS, BLOCK_QUERIES, SCORES, TILE = 1 << 20, 4096, 1 << 22, 16
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, and of each component other than 0: its place among those rows, its term, floor(scale * x))."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False)  # nulls: not a number
    row = np.repeat(np.arange(len(column)), length)
    term = np.arange(len(x)) - np.repeat(np.cumsum(length) - length, length)
    fit = pc.is_valid(column).to_numpy(zero_copy_only=False).copy()
    fit[row[~np.isfinite(x)]] = False
    keep = fit[row]
    place = np.cumsum(fit) - 1
    with np.errstate(over="ignore"):
        value = np.floor(scale * x[keep])
    row, term = place[row[keep]], term[keep]
    some = value != 0
    return np.flatnonzero(fit), row[some], term[some], value[some]


def postings(row: np.ndarray, term: np.ndarray, value: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (rows in ascending order, values)."""
    order = np.lexsort((row, term))
    row, term, value = row[order], term[order], value[order]
    cut = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    return {int(term[i]): (row[i:j], value[i:j]) for i, j in zip(cut, np.append(cut[1:], len(term)))}


def whole(x: np.ndarray) -> np.ndarray:
    """Floating-point integers as Python's, of any size."""
    return np.array([int(v) if np.isfinite(v) else 0 for v in x], dtype=object)


def selected(score: np.ndarray, most: int, safe: bool) -> np.ndarray:
    """Places of the `most` highest scores of each row, ties to the smaller place; in any order."""
    n = score.shape[1]
    if n <= most:
        return np.broadcast_to(np.arange(n), score.shape)
    if not safe:
        return np.array([sorted(range(n), key=lambda i: (-s[i], i))[:most] for s in score.tolist()])
    key = (score << (n - 1).bit_length()) | np.arange(n - 1, -1, -1)  # a score and how far its place is from the end
    return np.argpartition(key, n - most, axis=1)[:, n - most :]


class Best:
    """The highest scores of each query so far, with the candidates' ids; ties to the smaller id, a null id last."""

    def __init__(self, queries: int, most: int):
        self.most = most
        self.score, self.id = np.zeros((queries, 0), np.int64), np.zeros((queries, 0), np.int64)
        self.null = np.zeros((queries, 0), bool)

    def merge(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate([a, b], axis=1) for a, b in ((self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, ~score), axis=-1)[:, : self.most]  # ~score falls as score rises, without overflow
        self.score, self.id, self.null = (np.take_along_axis(x, order, axis=1) for x in (score, ids, null))


def _search(batches: Iterator[pa.RecordBatch], block: tuple, most: int, scale: int) -> Iterator[pa.RecordBatch]:
    """(no, query_id, vec_id, score, own) of the best candidates of one partition, `most` of each query at most."""
    no, query_id, (_, q_row, q_term, q_value) = block
    Q = len(no)
    if not Q:
        return
    tiles = [(i, min(i + TILE, Q)) for i in range(0, Q, TILE)]
    terms = [postings(q_row[at := np.flatnonzero((q_row >= i) & (q_row < j))] - i, q_term[at], q_value[at]) for i, j in tiles]
    q_most, q_terms = float(np.abs(q_value).max(initial=0)), int(np.bincount(q_row, minlength=1).max(initial=0))
    chunk, best = max(1, SCORES // max(Q, 1)), Best(Q, most)

    def scan(held: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(held).combine_chunks()
        fit, row, term, value = quantised(rows.column(1).chunk(0), scale)
        if not len(fit):
            return
        ids = rows.column(0).take(pa.array(fit))
        null = pc.is_null(ids).to_numpy()
        ids = pc.fill_null(ids, 0).to_numpy()
        order = np.lexsort((ids, null))  # places in the chunk follow the ids
        ids, null = ids[order], null[order]
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        C = len(ids)
        safe = q_most * float(np.abs(value).max(initial=0)) * max(q_terms, 1) < 2.0 ** (61 - C.bit_length())
        of_term = postings(rank[row], term, value.astype(np.int64) if safe else whole(value))
        parts = []
        for (i, j), asked in zip(tiles, terms):
            score = np.zeros((j - i, C), dtype=np.int64 if safe else object)
            for t, (at, weight) in asked.items():
                if t not in of_term:
                    continue
                docs, got = of_term[t]
                weight = weight.astype(np.int64) if safe else whole(weight)
                if len(docs) == C:
                    for r, w in zip(at.tolist(), weight.tolist()):
                        score[r] += w * got
                else:
                    for r, w in zip(at.tolist(), weight.tolist()):
                        score[r, docs] += w * got
            top = selected(score, most, safe)
            kept = np.take_along_axis(score, top, axis=1)
            if not safe:
                kept = np.array([[min(max(x, _LEAST), _MOST) for x in s] for s in kept.tolist()], dtype=np.int64).reshape(kept.shape)
            parts.append((kept, ids[top], null[top]))
        best.merge(*map(np.concatenate, zip(*parts)))

    held, n = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, chunk - n)
            b = b.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == chunk:
                scan(held)
                held, n = [], 0
    if held:
        scan(held)
    width = best.score.shape[1]
    if width:
        square = np.array([min(sum(int(v) ** 2 for v in whole(q_value[q_row == r])), _MOST) for r in range(Q)], dtype=object) if q_most >= 2.0**25 else np.bincount(q_row, weights=q_value * q_value, minlength=Q)
        own = (best.id == query_id[:, None]) & ~best.null & (best.score == square.astype(np.int64)[:, None])
        ids = pa.array(best.id.ravel(), mask=best.null.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(no, width)), pa.array(np.repeat(query_id, width)), ids, pa.array(best.score.ravel()), pa.array(own.ravel())], names=["no", "query_id", "vec_id", "score", "own"])


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of what all tasks kept, without the query's own row.

    Its own row, where it is among the k + 1 best, is an entry of its id and its score; another row with the same id and
    score can't be told from it in the result.
    """
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    best = found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k + 1)
    best = best.withColumn("_own", F.min(F.when(F.col("own"), F.col("_at"))).over(Window.partitionBy("no")))
    rank = F.col("_at") - F.when(F.col("_own") < F.col("_at"), 1).otherwise(0)
    return best.where("_own is null or _own <> _at").withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by `every`, the k other rows of highest score.

    Vectors that are null or hold a null or a number that isn't finite take no part. Vectors of other lengths count as if
    filled up with zeros; an empty one scores 0 with all. Ties go to the smaller id, a null id last. Rows that share an id are
    queries and candidates of their own. Scores beyond a long are its ends. Other columns are ignored. An empty table gives
    an empty result.
    """
    spark = prepared(vectors.sparkSession)
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"))
    sound = "vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    asked, total = numbered(d.where(F.col("vec_id") % every == 0).where(sound).select(F.col("vec_id").alias("query_id"), "vector"), "query_id")
    longest = asked.agg(F.max(F.size("vector"))).first()[0] or 1
    size = max(1, min(block_queries, BLOCK_NUMBERS // longest))
    found = []
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/top-k-{uuid.uuid4().hex}"
    for at in range(0, max(total, 1), size):
        block = asked.where(F.col("rank").between(at, at + size - 1)).select("rank", "query_id", "vector").toArrow().combine_chunks()
        column = block.column(2).chunk(0) if block.num_rows else pa.array([], pa.list_(pa.float64()))
        sent = spark.sparkContext.broadcast((block.column(0).to_numpy(), block.column(1).to_numpy(), quantised(column, scale)))
        found = merged(d.mapInArrow(lambda it, sent=sent: _search(it, sent.value, k + 1, scale), "no long, query_id long, vec_id long, score long, own boolean"), k)
        if total <= size:
            return found
        found.write.mode("append").parquet(path)  # so that one block's plan and broadcast are done with before the next
        sent.destroy()
    return spark.read.parquet(path)


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(prepared(spark), sf_dir, "embeddings"))


SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
