"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on the presence of words and of five-byte grams within words is trained from confirmed toxic texts
(P) and unlabelled texts (U, any documents, whether labelled or not) under the non-negative risk
pi * E_P[loss(+)] + max(0, E_U[loss(-)] - pi * E_P[loss(-)]),  pi being the share of toxic rows among the labelled
training rows. It is fitted on a bounded sample: MOST_P confirmed and MOST_U unlabelled rows, the first by a
hash of their ids. Labels 0 count for pi alone. Scores read every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sceneql.llm import textops as X
from sceneql.llm.common import held_out, prepared, table

#: Bounds of the sample; hashed space, half of it words, half grams; features kept by association with P.
MOST_P, MOST_U, BITS, KEPT = 6000, 14000, 20, 512
#: Chosen by errors, then by logistic loss, on the fourth of the training remainders after training on the others: decay from
#: 3e-4, 1e-3 and 3e-3, then steps from 100, 200, 300 and 500 with rates of .02, .05 and .1.
STEPS, RATE, DECAY = 100, 0.1, 3e-4
_HALF = np.uint64(65 - BITS)
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("A") : ord("Z") + 1] += np.uint64(32)
_FOLD[X.NOT_LETTERS] = np.uint64(32)


def _all(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, letters only, in lower case, and of every five bytes within a word or at its ends."""
    n = len(off) - 1
    h, first, _, _ = X.words(raw, off, X.LOWER, X.NOT_LETTERS)
    row = np.repeat(np.arange(n), np.diff(first))
    if not len(h):
        return row, np.zeros(0, np.int64)
    text = np.full(len(raw) + 2 * n, 32, dtype=np.uint64)
    text[np.arange(len(raw)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))] = _FOLD[raw]
    of = np.repeat(np.arange(n), np.diff(off) + 2)
    inner = (text[1:-3] != 32) & (text[2:-2] != 32) & (text[3:-1] != 32)
    at = np.flatnonzero(inner & (of[:-4] == of[4:]))
    gram = text[at]
    for k in range(1, 5):
        gram = gram << np.uint64(8) | text[at + k]
    gram = (gram * np.uint64(0x9E3779B97F4A7C15)) >> _HALF
    return np.concatenate([row, of[at]]), np.concatenate([h >> _HALF, gram | np.uint64(1 << (BITS - 1))]).astype(np.int64)


def buckets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each distinct feature of each row."""
    row, k = _all(raw, off)
    pair = np.unique(row << BITS | k)
    return pair >> BITS, pair & ((1 << BITS) - 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, text): in how many texts of either kind each feature occurs."""
    for b in batches:
        raw, off = X.utf8(b.column(1))
        kind = b.column(0).to_numpy()
        for i, j in X.slices(off):
            row, k = buckets(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            pair, n = np.unique(kind[i:j][row].astype(np.int64) << BITS | k, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((pair >> BITS).astype(np.int32)), pa.array(pair & ((1 << BITS) - 1)), pa.array(n)], names=["toxic", "feature", "n"])


def _chosen(batches: Iterator[pa.RecordBatch], kept: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, text): the places in kept of each text's features."""
    for b in batches:
        raw, off = X.utf8(b.column(1))
        for i, j in X.slices(off):
            row, k = buckets(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            at = np.minimum(np.searchsorted(kept, k), len(kept) - 1)
            hit = kept[at] == k
            ends = np.searchsorted(row[hit], np.arange(j - i + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(at[hit].astype(np.int32)))], names=["toxic", "places"])


def associated(a: np.ndarray, b: np.ndarray, n: int, m: int, tested: int, most: int = KEPT) -> np.ndarray:
    """Places of the features whose presence differs most between n texts of P (in a of them) and m of U (in b), by the
    likelihood ratio statistic; chance alone reaches about twice the logarithm of how many features are tested."""
    share = (a + b) / max(n + m, 1)

    def part(x, of, expected):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(of * expected, 1e-9)), 0)

    g = part(a, n, share) + part(n - a, n, 1 - share) + part(b, m, share) + part(m - b, m, 1 - share)
    top = np.argsort(-g, kind="stable")[:most]
    return np.sort(top[g[top] > 2 * np.log(max(2, tested))])


def fit(p: np.ndarray, u: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias under the non-negative risk with logistic loss; p and u are presence matrices."""
    w, c = np.zeros(p.shape[1]), float(np.log(max(prior, 1e-3) / (1 - min(prior, 0.999))))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def mean_slope(x: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
        z = np.clip(x @ w.astype(np.float32) + c, -30, 30)
        slope = -sign / (1 + np.exp(sign * z))
        return float(np.mean(np.log1p(np.exp(-sign * z)))), np.append(slope.astype(np.float32) @ x, slope.sum()) / len(x)

    for t in range(1, steps + 1):
        _, up = mean_slope(p, 1)
        up_loss, up_neg = mean_slope(p, -1)
        u_loss, u_neg = mean_slope(u, -1)
        negative = u_loss - prior * up_loss
        grad = prior * up + (u_neg - prior * up_neg) if negative >= 0 else -(u_neg - prior * up_neg)
        grad[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, c = w - step[:-1], c - step[-1]
    return w, c


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float] | None:
    """(buckets, their weights, bias), or None without confirmed toxic training rows."""
    spark = prepared(docs.sparkSession)
    ruled = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = ruled.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not toxic:
        return None
    order = F.xxhash64("doc_id", F.lit("nnpu"))
    positive = ruled.where("toxic = 1").orderBy(order, "doc_id").limit(MOST_P).select("doc_id", F.lit(1).alias("toxic"))
    other = docs.select(F.col(id_col).cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct().orderBy(order, "doc_id").limit(MOST_U)
    # U is drawn from all documents, so that it holds its share of positives: those in both samples have both roles
    sample = positive.unionByName(other.select("doc_id", F.lit(0).alias("toxic")))
    # at most MOST_P + MOST_U rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("toxic", "text")
    sizes = dict(texts.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return None
    # at most 2**BITS features; those in fewer than three texts can't be told from chance
    counted = texts.mapInArrow(_frequencies, "toxic int, feature long, n long").groupBy("feature").agg(F.sum(F.col("n") * F.col("toxic")).alias("p"), F.sum("n").alias("all")).checkpoint()
    got = counted.where(F.col("all") >= 3).orderBy("feature").toArrow()
    p = got.column(1).to_numpy().astype(float)
    place = associated(p, got.column(2).to_numpy() - p, sizes[1], sizes[0], counted.count())
    kept = got.column(0).to_numpy()[place]
    if not len(kept):
        return kept, np.zeros(0), float(np.log(min(toxic / n, 0.49) / (1 - min(toxic / n, 0.49))))
    rows = texts.mapInArrow(lambda it: _chosen(it, kept), "toxic int, places array<int>").toArrow()
    role, places = rows.column(0).to_numpy(), rows.column(1).combine_chunks()
    x = np.zeros((len(role), len(kept)), dtype=np.float32)
    x[np.repeat(np.arange(len(role)), np.diff(np.asarray(places.offsets))), places.values.to_numpy()] = 1
    w, c = fit(x[role == 1], x[role == 0], min(toxic / n, 0.99))
    return kept, w, c


def _score(batches: Iterator[pa.RecordBatch], model, out: str) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is a text: the other columns, and the text's score."""
    weight, known, bias = np.zeros(1 << BITS), np.zeros(1 << BITS, dtype=bool), None
    if model:
        kept, w, bias = model
        weight[kept], known[kept] = w, True
    for b in batches:
        raw, off = X.utf8(b.column(b.num_columns - 1))
        score = np.zeros(b.num_rows)
        if model:
            for i, j in X.slices(off):
                row, k = _all(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                hit = known[k]
                pair = np.unique(row[hit] << BITS | k[hit])
                z = np.bincount(pair >> BITS, weight[pair & ((1 << BITS) - 1)], j - i) + bias
                score[i:j] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], names=[*b.schema.names[:-1], out])


def with_score(docs: DataFrame, labels: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column `out`, the score of each row's text. Rows stay where they are: nothing is shuffled.

    Null and empty texts get the score of a text without words. Rows with equal texts get equal scores. Without a
    confirmed toxic training row all scores are 0. Empty tables give an empty result. `out` must be a new name.
    """
    model = train(docs, labels, id_col, text_col)
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])
    return docs.withColumn("_toxicity_text", F.col(text_col).cast("string")).mapInArrow(lambda it: _score(it, model, out), schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; see with_score. A null id is not held out."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = with_score(d, labels, "score")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
