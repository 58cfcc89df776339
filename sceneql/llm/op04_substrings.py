"""Substring deduplication by prefix-partitioned suffix trees.

Every window of WINDOW words is a suffix cut at that depth. Suffixes are grouped by the words from an anchor on, the first
place of the window's smallest gram, so that the suffixes before one anchor travel together as one stretch of text, with
what lies before the anchor as their beginning. Groups in one document only can't repeat and go no further. The groups'
prefixes vary in length: in a group with more suffixes than fit a task, equal stretches become one, with their smallest
document, and if there still are too many, the prefix is lengthened by GRAM words at a time, to the anchor's right as far
as a window reaches, then to its left.

In each memory-sized set of groups a tree is built: suffixes are ranked by their first 1, 2, 4, .. words, sorted, and the
common words of neighbours found from these ranks. Runs of neighbours with WINDOW words in common or more hang below one
deep internal node, a repeat; overlapping repeats of a stretch make up its maximal ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneql.llm import textops as X
from sceneql.llm.common import parts, prepared, table
from sceneql.llm.op10_order_minhash import numbered

WINDOW, GRAM = 50, 8
#: Suffixes that may share a prefix in one task; bytes of text of the groups that are built into trees at once; a key with
#: more than one in SHARE of all rows is joined by broadcast (so there are fewer than SHARE of them).
COMMON, CHUNK, SHARE = 400_000, 2_000_000, 1000
#: Bits of a place; the rest of a number is hash. A column of 2**31 bytes has at most 2**30 words.
_PLACE = np.uint64(30)
_U = np.uint64
#: Bits that tell the texts of one id apart, where ids are shared: 2**29 texts an id, 2**34 texts in all.
ROWS = 29
STRETCH = "prefix long, doc_id long, start int, n int, anchor int"


def stretches(h: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start word, number of windows, prefix hash, anchor) of each run of windows of one row with the same anchor.

    The anchor's distance from a window's start is a property of the window's words alone; where a run ends doesn't
    matter for what is found.
    """
    valid = X.ranges(first[:-1], np.maximum(np.diff(first) - window + 1, 0))
    if not len(valid):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z
    g = X.grams(h, gram)
    placed = (g >> _PLACE << _PLACE) | np.arange(len(g), dtype=np.uint64)
    at = (X.window_min(placed, window - gram + 1)[valid] & _U((1 << 30) - 1)).astype(np.int64)
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)
    i = np.flatnonzero(new)
    return valid[i], np.diff(np.append(i, len(valid))), g[at[i]], at[i]


def _list(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, off = X.utf8(b.column(1))
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for i, j in X.slices(off):
            h, first, _, _ = X.words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            s, n, g, at = stretches(h, first, window, gram)
            row = np.searchsorted(first, s, "right") - 1
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids[i:j][row]), pa.array((s - first[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array((at - s).astype(np.int32))], names=["prefix", "doc_id", "start", "n", "anchor"])


def _hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the words first .. last - 1, for each pair: words and their places, mixed and summed."""
    n = last - first
    at, place = X.ranges(first, n), X.ranges(np.zeros(len(n), np.int64), n).astype(np.uint64)
    edge = np.cumsum(n) - n
    return tuple(X.mix(np.add.reduceat(X.joined(h[at], place + _U(k << 40)), edge) + n.astype(np.uint64)).view(np.int64) for k in (1, 2))


def _rows(prefix, doc, start, n, anchor, x, y, lo, ln, raw) -> pa.RecordBatch:
    o = np.concatenate([[0], np.cumsum(ln)]).astype(np.int32)
    text = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(o), pa.py_buffer(raw[X.ranges(lo, ln)])])
    whole = [pa.array(np.asarray(c).astype(np.int32)) for c in (start, n, anchor)]
    return pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(doc), *whole, pa.array(x), pa.array(y), text], names=["prefix", "doc_id", "start", "n", "anchor", "x", "y", "words"])


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, hits list of (prefix, start, n, anchor)): the text of each hit and its hash."""
    for b in batches:
        b = b.filter(pa.compute.is_valid(b.column(2)))
        raw, off = X.utf8(b.column(1))
        ids, hits = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
        hit_off = np.asarray(hits.offsets)
        flat = hits.values
        prefix, start, n, anchor = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        for i, j in X.slices(off):
            base = int(off[i])
            h, first, ws, we = X.words(raw[base : off[j]], off[i : j + 1] - base)
            k = np.arange(hit_off[i], hit_off[j])
            row = np.repeat(np.arange(j - i), np.diff(hit_off[i : j + 1]))
            a = first[row] + start[k]
            z = a + n[k] + window - 2
            ok = z < first[row + 1]
            k, row, a, z = k[ok], row[ok], a[ok], z[ok]
            if len(k):
                x, y = _hashes(h, a, z + 1)
                yield _rows(prefix[k], ids[i:j][row], start[k], n[k], anchor[k], x, y, ws[a], we[z] - ws[a], raw[base : off[j]])


def _lengthen(batches: Iterator[pa.RecordBatch], window: int, gram: int, times: int) -> Iterator[pa.RecordBatch]:
    """Stretches by a prefix `times` grams longer: parts of them whose windows have the same words for a prefix."""
    for b in batches:
        raw, off = X.utf8(b.column(7))
        h, first, ws, we = X.words(raw, off)
        doc, start, n, anchor = (b.column(k).to_numpy() for k in (1, 2, 3, 4))
        row = np.repeat(np.arange(b.num_rows), n)
        s = X.ranges(first[:-1], n.astype(np.int64))
        at = (first[:-1] + anchor)[row]
        grown = at + gram * (times + 1)
        end = np.minimum(s + window, grown)
        begin = np.maximum(s, at - (grown - end))
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (end[1:] != end[:-1]) | (begin[1:] != begin[:-1]))) if len(row) else np.zeros(0, np.int64)
        if not len(new):
            continue
        many = np.diff(np.append(new, len(row)))
        r, a = row[new], s[new]
        z = a + many + window - 2
        x, y = _hashes(h, a, z + 1)
        key = _hashes(h, begin[new], end[new])[0].view(np.uint64)
        key = X.joined(key, ((at - begin)[new] + (times << 10)).astype(np.uint64)).view(np.int64)
        yield _rows(key, doc[r], a - first[r] + start[r], many, at[new] - a, x, y, ws[a], we[z] - ws[a], raw)


def suffix_tree(h: np.ndarray, suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes' places in lexical order, words that each has in common with the one before it, at most depth).

    Suffixes must have `depth` words. Two neighbours' common words are the depth of the internal node between them.
    """
    ranks = [np.unique(h, return_inverse=True)[1].astype(np.int64)]
    k = 1
    while 2 * k <= depth:
        ranks.append(np.unique(ranks[-1][:-k] * len(h) + ranks[-1][k:], return_inverse=True)[1])
        k *= 2
    order = np.lexsort((ranks[-1][suffixes + depth - k], ranks[-1][suffixes]))
    p, q = suffixes[order][1:], suffixes[order][:-1]
    common = np.zeros(len(p), dtype=np.int64)
    for step in range(len(ranks) - 1, -1, -1):
        size = 1 << step
        fits = common + size <= depth
        i, j = np.where(fits, p + common, 0), np.where(fits, q + common, 0)
        common += size * (fits & (ranks[step][i] == ranks[step][j]))
    return order, np.append(0, common)


def deep_nodes(h: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """Number of the internal node at the given depth above each suffix: equal numbers, equal first `depth` words."""
    order, common = suffix_tree(h, suffixes, depth)
    node = np.empty(len(suffixes), dtype=np.int64)
    node[order] = np.cumsum(common < depth) - 1
    return node


def _repeats(batches: Iterator[pa.RecordBatch], window: int, chunk: int, shift: int) -> Iterator[pa.RecordBatch]:
    """Rows (prefix, doc_id, n, x, y, words) sorted by prefix: the parts [first, end) of each that a smaller document has, too.

    shift: bits of a doc_id that tell rows of one document apart.
    """

    def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        doc, n, x, y = (t.column(k).to_numpy() for k in (1, 2, 3, 4))
        raw, off = X.utf8(t.column(5))
        h, first, _, _ = X.words(raw, off)
        suffixes = X.ranges(first[:-1], n.astype(np.int64))
        node = deep_nodes(h, suffixes, window)
        row = np.repeat(np.arange(len(n)), n)
        least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc[row])
        again = np.flatnonzero(doc[row] >> shift > least[node] >> shift)
        r, s = row[again], suffixes[again] - first[row[again]]
        new = np.ones(len(r), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
        i = np.flatnonzero(new)
        last = np.append(i[1:], len(r)) - 1
        end = s[last] + window if len(i) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c[r[i]]) for c in (doc, x, y)] + [pa.array(c.astype(np.int32)) for c in (s[i], end)], names=["doc_id", "x", "y", "first", "end"])

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        p = b.column(0).to_numpy()
        edges = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, np.int64)
        for i, j in zip(edges, np.append(edges[1:], len(p))):
            if size >= chunk and held[-1].column(0)[-1].as_py() != p[i]:
                yield done(held)
                held, size = [], 0
            held.append(b.slice(i, j - i))
            size += pa.compute.sum(pa.compute.binary_length(held[-1].column(5))).as_py() or 0
    if held:
        yield done(held)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, off = X.utf8(b.column(1))
        spans = b.column(2).to_pylist()
        words, gone, digest, kept = [], [], [], []
        for i in range(b.num_rows):
            w = raw[off[i] : off[i + 1]].tobytes().split()
            words.append(len(w))
            if spans[i]:
                edge = np.zeros(len(w) + 1, dtype=np.int32)
                for s in spans[i]:
                    edge[min(s["first"], len(w))] += 1
                    edge[min(s["end"], len(w))] -= 1
                stay = np.cumsum(edge[:-1]) <= 0
                w = [x for x, y in zip(w, stay) if y]
            gone.append(words[-1] - len(w))
            text = b" ".join(w)
            digest.append(hashlib.sha256(text).hexdigest())
            kept.append(text.decode("utf-8", "replace") if gone[-1] else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def spread(rows: DataFrame, found: DataFrame, on: list[str], hot: Column, how: str = "inner") -> DataFrame:
    """rows joined with found by unique keys; those that `hot` marks, fewer than SHARE, go to all tasks, so that no task gets all rows of one."""
    many = found.where(hot)
    direct = rows.join(F.broadcast(many), on, how)
    rest = rows.join(F.broadcast(many.select(on)), on, "left_anti").join(found.where(~hot), on, how)
    return direct.unionByName(rest)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, common: int = COMMON, chunk: int = CHUNK, shift: int = 0) -> DataFrame:
    """(doc_id, spans): the words [first, end) of each document whose windows also start in a document with a smaller id.

    docs: doc_id long, text string. Null ids take no part. shift: ids that differ in their last `shift` bits alone are rows of
    one document.
    """
    spark = prepared(docs.sparkSession)
    runs = docs.where("doc_id is not null").mapInArrow(lambda it: _list(it, window, gram), STRETCH).checkpoint()
    hot = F.col("copies") > max(1, runs.count() // SHARE)

    def before(x: str, y: str) -> Column:
        return F.shiftright(x, shift) < F.shiftright(y, shift)

    shared = runs.groupBy("prefix").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("n").alias("suffixes"), F.count("*").alias("copies")).where(before("least", "most")).select("prefix", "suffixes", "copies").checkpoint()
    full = f"{STRETCH}, x long, y long, words binary"

    def cut(which: DataFrame) -> DataFrame:
        hits = spread(runs, which.select("prefix", "copies"), ["prefix"], hot).groupBy("doc_id").agg(F.collect_list(F.struct("prefix", "start", "n", "anchor")).alias("hits"))
        # a left join, so that it and the one by which repeats are removed read one and the same shuffle of the texts
        return docs.join(hits, "doc_id", "left").select("doc_id", "text", "hits").mapInArrow(lambda it: _cut(it, window), full)

    def built(rows: DataFrame) -> DataFrame:
        dealt = rows.select("prefix", "doc_id", "n", "x", "y", "words").repartition(parts(spark), "prefix").sortWithinPartitions("prefix")
        return dealt.mapInArrow(lambda it: _repeats(it, window, chunk, shift), "doc_id long, x long, y long, first int, end int")

    small = F.col("suffixes") <= common
    found = built(cut(shared.where(small)).withColumn("x", F.col("start").cast("long"))).select("doc_id", (F.col("x") + F.col("first")).alias("first"), (F.col("x") + F.col("end")).alias("end"))
    if shared.where(~small).limit(1).count():
        found = found.unionByName(_of_large_groups(cut(shared.where(~small)), built, full, hot, before, window, gram, common))
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def _of_large_groups(rows: DataFrame, built, full: str, hot: Column, before: Callable[[str, str], Column], window: int, gram: int, common: int) -> DataFrame:
    """(doc_id, first, end) of repeats in groups of more than `common` suffixes: equal stretches become one, and what is
    still too large gets longer prefixes, until a prefix is the whole window."""
    found, times = None, 0
    while True:
        rows = rows.checkpoint()
        texts = rows.groupBy("prefix", "x", "y").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("most"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("words").alias("words")).checkpoint()
        groups = texts.groupBy("prefix").agg(F.min("doc_id").alias("from"), F.max("most").alias("to"), F.sum("n").alias("suffixes"), F.count("*").alias("texts")).where(before("from", "to")).select("prefix", "suffixes", "texts").checkpoint()
        fit = (F.col("suffixes") <= common) | (F.col("texts") == 1) | F.lit(gram * (times + 1) >= window)
        # of equal stretches, all but the smallest document's repeat from end to end; that one repeats what the tree finds
        trees = built(texts.join(groups.where(fit & (F.col("texts") > 1)).select("prefix"), "prefix")).groupBy("x", "y").agg(F.collect_list(F.struct("first", "end")).alias("parts"))
        told = texts.join(groups.where(fit).select("prefix"), "prefix").select("x", "y", F.col("doc_id").alias("least"), "most", "copies").join(trees, ["x", "y"], "left").where(F.col("parts").isNotNull() | before("least", "most")).drop("most")
        whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("n") + (window - 1)).cast("int").alias("end")))
        own = F.when(before("least", "doc_id"), whole).otherwise(F.col("parts"))
        late = spread(rows.select("x", "y", "doc_id", "start", "n"), told.checkpoint(), ["x", "y"], hot).select("doc_id", "start", F.explode(own).alias("part"))
        late = late.select("doc_id", (F.col("start") + F.col("part.first")).alias("first"), (F.col("start") + F.col("part.end")).alias("end"))
        found = late if found is None else found.unionByName(late)
        deep = groups.where(~fit).select("prefix", F.col("texts").alias("copies"))
        if not deep.limit(1).count():
            return found
        times += 1
        longer = spread(rows, deep, ["prefix"], hot).select(*rows.columns)
        rows = longer.mapInArrow(lambda it, times=times: _lengthen(it, window, gram, times), full)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): each document without words that a smaller document repeats.

    kept_text is null where nothing went. Null, empty and short texts lose nothing; a null id neither takes nor loses.
    Rows that repeat one row lose the same words. Rows that share an id but not a text are one document of several texts:
    each loses what a smaller document has, none what another of them has. Other columns are ignored. An empty table gives
    an empty result.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    again = d.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    ids, shift = None, 0
    if again.limit(1).count():
        prepared(docs.sparkSession)
        d, ids, shift = *_by_row(d), ROWS
    found = d.join(repeated_spans(d, shift=shift, **how), "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return found if ids is None else found.withColumnRenamed("doc_id", "_row").join(ids, "_row", "left").select("doc_id", *found.columns[1:])


def _by_row(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(d with a number for each id and text as its doc_id, (_row, doc_id) of these numbers).

    Numbers ascend by id; those of one id differ in their last ROWS bits. Null ids stay.
    """
    d = d.withColumn("_text", F.xxhash64("text"))
    texts, _ = numbered(d.where("doc_id is not null").select("doc_id", "_text").distinct(), "doc_id", "_text")
    first = texts.groupBy("doc_id").agg(F.min("rank").alias("_first"))
    key = F.shiftleft("_first", ROWS).bitwiseOR(F.col("rank") - F.col("_first"))
    rows = texts.join(first, "doc_id").select("doc_id", "_text", key.alias("_row")).checkpoint()
    keyed = d.join(rows, ["doc_id", "_text"], "left").select(F.col("_row").alias("doc_id"), "text").checkpoint()
    return keyed, rows.select("_row", "doc_id")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(prepared(spark), sf_dir, "documents")).drop("kept_text")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN m USING (h) WHERE doc_id > least),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.p) AS kept FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.p = e.p WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
