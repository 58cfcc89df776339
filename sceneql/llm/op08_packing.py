"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Tokens are cut into pieces of at most CAPACITY; a full piece is a sequence. The others are dealt into blocks of about
BLOCK pieces. On each block, islands breed packings: a crossover injects whole well-filled bins of one parent into the
other, drops the bins that hold an injected piece twice, trades displaced pieces for ones that leave less room, and puts
the rest back by best fit. After each epoch
every island's elite goes to the next island of its block. Only lengths and numbers of pieces are shuffled, no tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneql.llm.common import parts, prepared, table

#: Pieces a block; islands of it, epochs, generations of an epoch, packings of a generation. Loose pieces and bins that take
#: part in a trade, bins emptied by chance, share of the well-filled bins that a crossover injects.
CAPACITY, END, BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION, LOOSE, OTHERS, TRADED, INJECTED = 1024, 2, 4096, 2, 2, 10, 6, 24, 12, 48, 0.5
VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
_tokenizers: dict[str, tuple] = {}


def encoder(name: str = VOCABULARY):
    """text -> uint32 ids of the public vocabulary. The merge ranks are read by the faster of two libraries; texts that
    name the special token are left to the other, so both give the same ids."""
    if name not in _tokenizers:
        import base64

        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        with open(P.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _tokenizers[name] = fast, Tokenizer.from_file(P.path(f"{name}.json"))
    fast, plain = _tokenizers[name]

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)

    return encode


def _pieces(batches: Iterator[pa.RecordBatch], name: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(name)
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
            n = len(ids)
            cut = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
            for k in range(len(cut) - 1):
                for column, x in zip(out, (doc, k, cut[k], cut[k + 1] - cut[k], zlib.crc32(ids[cut[k] : cut[k + 1]]))):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], b.column(0).type), *(pa.array(x, pa.int64()) for x in out[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])


class Packing:
    """Bins of items (numbers into a list of sizes) under a capacity. Packings may share a bin's list: it is replaced, never changed."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None, fill: list[int] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins or []
        self.fill = [sum(map(sizes.__getitem__, b)) for b in self.bins] if fill is None else fill

    def best_fit(self, items: list[int]) -> None:
        """Put items, in the given order, where the least room is left."""
        sizes, cap, bins, fill = self.sizes, self.capacity, self.bins, self.fill
        rooms: dict[int, list[int]] = {}
        mask = 0
        for k, f in enumerate(fill):
            if f < cap:
                rooms.setdefault(cap - f, []).append(k)
                mask |= 1 << (cap - f)
        for i in items:
            size = sizes[i]
            fits = mask >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                held = rooms[room]
                k = held.pop()
                if not held:
                    mask &= ~(1 << room)
                bins[k] = [*bins[k], i]
                fill[k] += size
            else:
                k, room = len(bins), cap
                bins.append([i])
                fill.append(size)
            left = room - size
            if left:
                rooms.setdefault(left, []).append(k)
                mask |= 1 << left

    def score(self) -> tuple[int, float]:
        """Smaller is better: the number of bins, then how unevenly they are filled (squared fills, negated)."""
        return len(self.bins), -float((np.array(self.fill) ** 2).sum()) / self.capacity**2


def crossover(a: Packing, b: Packing, rng: np.random.Generator) -> Packing:
    """A child of a with some well-filled bins of b."""
    filled = np.argsort([-f for f in b.fill], kind="stable")[: max(1, len(b.bins) // 2)]
    chosen = filled[rng.random(len(filled)) < INJECTED] if len(filled) > 8 else filled[:1]
    taken = {i for k in chosen for i in b.bins[k]}
    kept, fill, out = [b.bins[k] for k in chosen], [b.fill[k] for k in chosen], []
    for x, f in zip(a.bins, a.fill):
        if taken.isdisjoint(x):
            kept.append(x)
            fill.append(f)
        else:
            out += [i for i in x if i not in taken]
    child = Packing(a.sizes, a.capacity, kept, fill)
    mutate(child, rng, out)
    return child


def mutate(p: Packing, rng: np.random.Generator, loose: list[int], others: int = OTHERS) -> None:
    """Empty a few of the least filled bins and some others, trade their items and the loose ones for fuller bins, fill
    bins anew with what is left, and put the rest back, largest first."""
    if len(p.bins) > 8:
        worst = np.argsort(p.fill, kind="stable")[: 2 + int(rng.integers(0, 4))]
        gone = set(worst.tolist()) | set(rng.integers(0, len(p.bins), min(others, len(p.bins) // 4)).tolist())
        loose = loose + [i for k in gone for i in p.bins[k]]
        p.bins, p.fill = [x for k, x in enumerate(p.bins) if k not in gone], [x for k, x in enumerate(p.fill) if k not in gone]
    loose = trade(p, loose, rng)
    p.best_fit(refill(p, sorted(loose, key=lambda i: (-p.sizes[i], i))))


def refill(p: Packing, loose: list[int], most: int = 4 * LOOSE) -> list[int]:
    """New bins of the largest loose item and the one or two others that leave the least room, as long as that is under
    one part in 64; the items of no such bin, largest first."""
    rest: list[int] = list(loose[most:])
    left = list(loose[:most])[::-1]  # from the smallest on: a partner is one search
    size = np.array([p.sizes[i] for i in left])
    while left:
        room = p.capacity - int(size[-1])
        n = int(np.searchsorted(size[:-1], room, "right"))
        small = size[:n]
        other = np.minimum(np.searchsorted(small, room - small, "right"), np.arange(n)) - 1
        sums = small + np.where(other >= 0, small[other], 0) if n else small
        at = int(np.argmax(sums)) if n else -1
        if room - (int(sums[at]) if n else 0) > p.capacity // 64:
            rest.append(left.pop())
            size = size[:-1]
            continue
        inside = [len(left) - 1, *([at] if n else []), *([int(other[at])] if n and other[at] >= 0 else [])]
        p.bins.append([left[k] for k in inside])
        p.fill.append(int(size[inside].sum()))
        size = np.delete(size, inside)
        for k in sorted(inside, reverse=True):
            del left[k]
    return sorted(rest, key=lambda i: (-p.sizes[i], i))


def trade(p: Packing, loose: list[int], rng: np.random.Generator, most: int = LOOSE, bins: int = TRADED) -> list[int]:
    """Fill bins that have room by exchanging one or two of their items (or none) for one or two loose ones that are larger together.

    Each bin takes the exchange that leaves the least room; `bins` of them, by chance, are tried. What is loose afterwards
    is smaller in sum. Of more than
    `most` loose items, as many by chance take part.
    """
    sizes, fill = p.sizes, p.fill
    loose = [loose[k] for k in rng.permutation(len(loose))]
    loose, aside = loose[:most], loose[most:]
    rooms = np.flatnonzero(np.array(fill) < p.capacity)
    stale = True
    for k in rng.permutation(rooms)[:bins].tolist():
        if not loose:
            break
        if stale:
            own = np.array([sizes[i] for i in loose])
            x, y = np.triu_indices(len(loose), 1)
            sums = np.concatenate([own, own[x] + own[y]])
            order = np.argsort(sums, kind="stable")
            sums, stale = sums[order], False
        bin_ = p.bins[k]
        outs = [(), *((i,) for i in range(len(bin_))), *((i, j) for i in range(len(bin_)) for j in range(i))]
        less = np.array([sum(sizes[bin_[i]] for i in o) for o in outs])
        at = np.searchsorted(sums, less + p.capacity - fill[k], "right") - 1
        gain = np.where(at >= 0, sums[at] - less, 0)
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            continue
        pick = int(order[at[best]])
        inside = {pick} if pick < len(loose) else {int(x[pick - len(loose)]), int(y[pick - len(loose)])}
        out = set(outs[best])
        p.bins[k] = [i for n, i in enumerate(bin_) if n not in out] + [loose[n] for n in inside]
        loose = [i for n, i in enumerate(loose) if n not in inside] + [bin_[n] for n in out]
        fill[k] += int(gain[best])
        stale = True
    return loose + aside


def evolve(sizes: list[int], capacity: int, elites: list[list[list[int]]], seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """The best bins found on one island from its elites (none: a fresh start)."""
    rng = np.random.default_rng(seed)
    pool = [Packing(sizes, capacity, [list(b) for b in e]) for e in elites]
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    least = -(-sum(sizes) // capacity)
    while len(pool) < population:
        p = Packing(sizes, capacity)
        noise = rng.random(len(sizes)) * (0.0 if not pool else 0.1)
        p.best_fit(order if not pool else sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise[i])))
        pool.append(p)
        if len(p.bins) <= least:
            break
    ranked = sorted(((p.score(), k, p) for k, p in enumerate(pool)), key=lambda x: x[:2])
    for _ in range(generations):
        if ranked[0][0][0] <= least or len(ranked) < 2:
            break
        half = max(2, len(ranked) // 2)
        for k in range(half, len(ranked)):
            i, j = rng.choice(half, 2, replace=False)
            child = crossover(ranked[i][2], ranked[j][2], rng)
            ranked[k] = child.score(), k, child
        ranked.sort(key=lambda x: x[:2])
    return ranked[0][2].bins


def _island(batches: Iterator[pa.RecordBatch], capacity: int, epoch: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, island, items, elites): the same with the island's elite (bin number of each item) and its score."""
    schema = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("elite", pa.list_(pa.int32())), ("n_bins", pa.int64()), ("squares", pa.float64())])
    for b in batches:
        for row in b.to_pylist():
            sizes = row["sizes"]
            elites = []
            for e in sorted(row["elites"] or []):
                bins: list[list[int]] = [[] for _ in range(max(e) + 1)]
                for i, k in enumerate(e):
                    bins[k].append(i)
                elites.append(bins)
            seed = [row["block"] & 0x7FFFFFFF, row["island"], epoch]
            best = evolve(sizes, capacity, elites, seed)
            of = [0] * len(sizes)
            for k, x in enumerate(best):
                for i in x:
                    of[i] = k
            n, squares = Packing(sizes, capacity, best).score()
            yield pa.RecordBatch.from_pylist([{"block": row["block"], "island": row["island"], "elite": of, "n_bins": n, "squares": squares}], schema=schema)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (uids, sizes, elite): (uid, sequence_id, offset) of each piece."""
    for b in batches:
        for row in b.to_pylist():
            uid, size, of = (np.array(row[k], dtype=np.int64) for k in ("uids", "sizes", "elite"))
            order = np.lexsort((uid, of))
            uid, size, of = uid[order], size[order], of[order]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            n = np.diff(np.append(first, len(of)))
            before = np.cumsum(size) - size
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(np.repeat(2 * uid[first], n)), pa.array(before - np.repeat(before[first], n))], names=["uid", "sequence_id", "offset"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY, capacity: int = CAPACITY, end: int = END, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): each piece of each document and its place.

    A null or empty text is the end token alone. Every row is packed, repeated rows and null ids, too. Other columns
    are ignored. An empty table gives an empty result. Reruns agree on the pieces' sequences up to their numbers.
    """
    spark = prepared(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = d.mapInArrow(lambda it: _pieces(it, name, capacity, end), "doc_id long, piece long, start long, length long, ids_crc32 long").withColumn("uid", F.monotonically_increasing_id()).checkpoint()
    short = pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-short.count() // block))
    held = short.groupBy(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("length", "uid"))).alias("items")).select("block", F.col("items.length").alias("sizes"), F.col("items.uid").alias("uids")).checkpoint()
    work = held.select("block", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    elites = work.select("block", "island", "sizes", F.lit(None).cast("array<array<int>>").alias("elites"))
    for epoch in range(epochs):
        n = min(parts(spark), blocks * islands)
        bred = elites.repartition(n, "block", "island").mapInArrow(lambda it, epoch=epoch: _island(it, capacity, epoch), "block long, island int, elite array<int>, n_bins long, squares double").checkpoint()
        moved = bred.unionByName(bred.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))) if islands > 1 else bred
        elites = moved.groupBy("block", "island").agg(F.collect_set("elite").alias("elites")).join(work, ["block", "island"]).select("block", "island", "sizes", "elites")
    best = bred.groupBy("block").agg(F.min_by("elite", F.struct("n_bins", "squares", "island")).alias("elite")).join(held, "block").select("uids", "sizes", "elite")
    placed = best.mapInArrow(_place, "uid long, sequence_id long, offset long")
    full = pieces.where(F.col("length") >= capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (2 * F.col("uid") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").unionByName(full)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(prepared(spark), sf_dir, "documents"))
