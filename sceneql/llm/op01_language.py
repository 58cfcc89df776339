"""Language identification as mixture inference.

Each language is a distribution over hashed byte trigrams, counted from all training texts. Expectation-maximisation
estimates a document's proportions of languages from its trigrams' likelihoods; the set of languages grows from the
likeliest one while the likelihood, penalised by half the logarithm of the trigrams for each further language, improves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneql.llm import textops as X
from sceneql.llm.common import held_out, prepared, table

#: Hashed trigrams, their prior count, EM steps, and the most languages a model may have (more raise an error).
BITS, PRIOR, STEPS, MOST_LANGUAGES = 16, 0.5, 12, 500
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[X.SPACE] = 32
_LOWER[[*range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 32


def trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed trigram) of every three bytes of each row, with a space before and behind; digits, signs and spaces are alike.

    Upper case letters of two bytes in Latin-1 count as lower case ones.
    """
    n = len(off) - 1
    out = np.full(len(raw) + 2 * n, 32, dtype=np.uint8)
    at = np.arange(len(raw)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))
    x = _LOWER[raw]
    if len(raw):
        second = np.append(False, raw[:-1] == 0xC3)
        x = np.where(second & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97), raw + 0x20, x)
    out[at] = x
    if len(out) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = (out[:-2].astype(np.uint32) << 16) | (out[1:-1].astype(np.uint32) << 8) | out[2:]
    row = np.repeat(np.arange(n), np.diff(off) + 2)
    keep = (row[:-2] == row[2:]) & ~((out[1:-1] == 32) & ((out[:-2] == 32) | (out[2:] == 32)))
    g = (g[keep] * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return row[:-2][keep], g.astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        raw, off = X.utf8(b.column(1))
        langs = np.array(b.column(0).to_pylist(), dtype=object)
        for i, j in X.slices(off):
            row, g = trigrams(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            for lang in set(langs[i:j]):
                own = (langs[i:j] == lang)[row]
                counts.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                counts[lang] += np.bincount(g[own], minlength=1 << BITS)
    for lang, c in counts.items():
        k = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(k) + 1), pa.string()), pa.array(np.append(k, -1)), pa.array(np.append(c[k], 0))], names=["lang", "gram", "n"])


def _likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, grams, counts): the language and its trigrams' likelihoods as bytes of float32."""
    for b in batches:
        out = []
        for gram, n in zip(b.column(1), b.column(2)):
            count = np.full(1 << BITS, PRIOR)
            count[np.asarray(gram.values)] += np.asarray(n.values)
            out.append((count / count.sum()).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["lang", "like"])


def train(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, likelihoods (trigram, language)) from rows (lang, text): counts over all of them.

    A language's counts meet as 2**BITS numbers at most and leave their task as 2**BITS bytes times four, so that the driver
    gets 131 MB for the most languages that there may be.
    """
    counted = texts.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).checkpoint()
    if counted.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    pair = F.filter(F.collect_list(F.struct("gram", "n")), lambda x: x["gram"] >= 0)
    lists = counted.groupBy("lang").agg(pair.alias("pairs")).select("lang", F.col("pairs.gram").alias("grams"), F.col("pairs.n").alias("counts"))
    got = sorted(lists.mapInArrow(_likelihoods, "lang string, like binary").collect(), key=lambda r: r.lang.encode())
    if not got:
        return [], np.full((1 << BITS, 1), 1 / (1 << BITS), dtype=np.float32)
    return [r.lang for r in got], np.ascontiguousarray(np.stack([np.frombuffer(r.like, dtype="<f4") for r in got], axis=1))


def mixtures(row: np.ndarray, gram: np.ndarray, n: int, like: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """(n, languages) proportions; rows of zeros where there is no trigram."""
    size = like.shape[0]
    pair, times = np.unique(row * size + gram, return_counts=True)
    r, p, times = pair // size, like[pair % size].astype(np.float64), times.astype(np.float64)
    first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
    docs = r[first]
    out = np.zeros((n, like.shape[1]))
    if not len(docs):
        return out
    total = np.add.reduceat(times, first)
    own = np.repeat(np.arange(len(docs)), np.diff(np.append(first, len(r))))

    def em(allowed: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions within the allowed languages and log-likelihoods, of the documents `which` (ascending)."""
        place = np.full(len(docs), -1)
        place[which] = np.arange(len(which))
        mine = place[own] >= 0
        q, c, o = p[mine], times[mine], place[own[mine]]
        start = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(steps):
            part = share[o] * q
            whole = part.sum(axis=1)
            share = np.add.reduceat(part * (c / whole)[:, None], start) / total[which][:, None]
            done = share.sum(axis=1, keepdims=True)
            share /= np.where(done > 0, done, 1)
        whole = (share[o] * q).sum(axis=1)
        return share, np.add.reduceat(c * np.log(np.maximum(whole, 1e-300)), start)

    # each language alone: no iteration is needed
    alone = np.add.reduceat(np.log(p) * times[:, None], first)
    everyone = np.arange(len(docs))
    if like.shape[1] == 1:
        out[docs] = 1.0
        return out
    full, _ = em(np.ones((len(docs), like.shape[1])), everyone)
    best = np.zeros_like(full)
    lead = alone.argmax(axis=1)
    best[everyone, lead] = 1.0
    score = alone.max(axis=1)
    full[everyone, lead] = 2.0  # the likeliest single one leads, the others follow by proportion
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(like.shape[1])[None, :], axis=1)
    which = everyone
    for m in range(2, like.shape[1] + 1):
        share, fit = em((rank[which] < m).astype(float), which)
        fit = fit - (m - 1) * 0.5 * np.log(total[which])
        better = fit > score[which]
        which = which[better]
        if not len(which):
            break
        best[which], score[which] = share[better], fit[better]
    out[docs] = best
    return out


def _predict(batches: Iterator[pa.RecordBatch], langs: list[str], like: np.ndarray) -> Iterator[pa.RecordBatch]:
    import regex

    letter = regex.compile(r"\p{L}")
    for b in batches:
        raw, off = X.utf8(b.column(1))
        share = np.zeros((b.num_rows, like.shape[1]))
        if langs:
            for i, j in X.slices(off):
                row, gram = trigrams(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                share[i:j] = mixtures(row, gram, j - i, like)
        best, score = share.argmax(axis=1), share.max(axis=1)
        known = [bool(langs) and s > 0 and bool(letter.search(t.as_py() or "")) for t, s in zip(b.column(1), score)]
        pred = [langs[k] if ok else "und" for k, ok in zip(best, known)]
        mixed = [sorted(((langs[k], float(x[k])) for k in np.flatnonzero(x)), key=lambda y: -y[1]) if ok else [] for x, ok in zip(share, known)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(np.where(known, np.minimum(score, 1.0), 0.0)), pa.array(mixed, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "proportions"])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, proportions) of every row; the model is learnt from rows that aren't held out.

    score is the predicted language's proportion. `und`, 0 and no proportions where the text is null or has no letters,
    or nothing was learnt. Ties go to the language that comes first by its bytes. Equal texts give equal results. A null
    id is not held out. Other columns are ignored. An empty table gives an empty result.
    """
    prepared(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    langs, like = train(d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 4, 2)).select("lang", "text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((langs, like))  # 2**BITS numbers a language
    found = d.select("doc_id", "text").mapInArrow(lambda it: _predict(it, *sent.value), f"doc_id {kind}, lang_pred string, score double, proportions map<string, double>")
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "proportions")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(prepared(spark), sf_dir, "documents"))
