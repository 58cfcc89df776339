"""Importance resampling towards a target distribution, in two Arrow passes.

Features are runs of consecutive words, hashed into buckets. The first pass counts buckets: each partition gives one
np.bincount vector, and treeReduce merges them. From the counts of the documents and of the target come the buckets'
gains. The second pass gathers the broadcast gains (one number a bucket) and sums them over each document by bincount with
weights. Gumbel noise from a hash of the id turns the sums into a draw without replacement: the highest scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneql.llm import crc
from sceneql.llm import textops as X
from sceneql.llm.common import prepared, table
from sceneql.llm.op10_order_minhash import numbered

BUCKETS, MOST_WORDS, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024

#: Bytes of words once A-Z are lower case: digits, a-z and all of longer characters.
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def buckets(raw: np.ndarray, off: np.ndarray, most: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every run of 1, then 2, up to `most` words that lie in one row."""
    raw = X.LOWER[raw]
    row, start, end = crc.runs(_INSIDE[raw], off)
    state, at = crc.more(crc.begun(len(row)), raw, start, end), np.arange(len(row))
    for n in range(1, most + 1):
        yield row[at], crc.done(state) % size
        keep = np.flatnonzero(at + n < len(row))
        keep = keep[row[at[keep]] == row[at[keep] + n]]
        at = at[keep]
        state = crc.more(crc.byte(state[keep], 0x20), raw, start[at + n], end[at + n])


def _count(batches: Iterator[pa.RecordBatch], most: int, size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, dtype=np.int64)
    for b in batches:
        raw, off = X.utf8(b.column(0))
        for i, j in X.slices(off):
            for _, bucket in buckets(raw[off[i] : off[j]], off[i : j + 1] - off[i], most, size):
                total += np.bincount(bucket, minlength=size)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


def bucket_counts(texts: DataFrame, most: int = MOST_WORDS, size: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; the tree is deep enough that a task merges about 32 vectors."""
    vectors = texts.mapInArrow(lambda it: _count(it, most, size), "counts binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), dtype=np.int64))
    none = texts.sparkSession.sparkContext.parallelize([0], 1).map(lambda _: np.zeros(size, dtype=np.int64))
    depth = max(2, math.ceil(math.log(vectors.getNumPartitions() + 1, 32)))
    return none.union(vectors).treeReduce(np.add, depth)


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths, rounded down: the logarithm of its smoothed share of the target over that of the documents."""
    size, S, T = float(len(have)), float(have.sum()), float(want.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (S + size) / ((s + 1.0) * (T + size)))) for s, t in zip(have.tolist(), want.tolist())], dtype=np.float64)


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, off = X.utf8(b.column(1))
        words, features, weight = (np.zeros(b.num_rows, dtype=np.int64) for _ in range(3))
        for i, j in X.slices(off):
            for n, (row, bucket) in enumerate(buckets(raw[off[i] : off[j]], off[i : j + 1] - off[i], most, len(gain))):
                found = np.bincount(row, minlength=j - i)
                features[i:j] += found
                if not n:
                    words[i:j] = found
                weight[i:j] += np.bincount(row, weights=gain[bucket], minlength=j - i).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of the SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", most: int = MOST_WORDS, size: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null where it isn't drawn.

    Drawn are the `percent` of the rows with min_words words or more, rounded down, that have the highest scores; ties go to
    the smaller id, a null id last (it is hashed as an empty one), then to the smaller weight. Rows that share an id are
    rows of their own. A null or empty text has no features and weight 0, and so has every text where neither table has any.
    Other columns are ignored. An empty table gives an empty result; an empty target is one without features.
    """
    spark = prepared(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    have = bucket_counts(d.select("text"), most, size)
    want = bucket_counts(target.select(F.col(target_col).cast("string").alias("text")), most, size)
    sent = spark.sparkContext.broadcast(gains(have, want))  # one number a bucket
    kind = d.schema["doc_id"].dataType.simpleString()
    found = d.mapInArrow(lambda it: _weigh(it, sent.value, most), f"doc_id {kind}, n_words long, n_features long, weight long")
    # the order of the draw: rows that can't be drawn come after all others, by their own scores
    order = {"_late": F.col("n_words") < min_words, "_score": -F.col("score"), "_null": F.col("doc_id").isNull()}
    scored = found.withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumns(order).checkpoint()
    drawn = scored.where("not _late").count() * percent // 100
    ranked, _ = numbered(scored, *order, "doc_id", "weight")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(~F.col("_late") & (F.col("rank") < drawn), F.col("rank") + 1).alias("rank"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY r, w),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY w),
x AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
k AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x)::BIGINT, 2), lambda i: 16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM x, crc),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bw JOIN k USING (w) GROUP BY bucket),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000) / ((s.n::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket),
wt AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY r),
sc AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT)::BIGINT AS score FROM d LEFT JOIN wt ON d.r = wt.r),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight) AS p, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND p <= 10 * n // 100 THEN p::BIGINT END AS rank FROM o
"""
