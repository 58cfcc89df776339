"""Scoring texts with a hierarchical Pitman-Yor language model.

Every word is a context: a restaurant for each preceding token (and for a text's start) serves every word that followed it,
and all restaurants share the unigram restaurant as their parent, whose base is uniform over the training words and one
more. Seatings are sampled by Gibbs: in each sweep every customer of every restaurant stands up and is seated again, and the
tables below are the parent's customers. A word of the parent has its count's mean number of tables.

No pair of words is left out. Tasks read texts a chunk at a time and send each distinct pair of a chunk once, with the
places of its texts in the chunk, to the part that its context is dealt to (pairs of the commonest contexts are dealt
one by one). A part holds its pairs as arrays and sweeps over them; the words' sums over all parts, which the parent
needs, are made in a second deal by word, between rounds of sweeps. In the end a part sends each chunk sums over its texts.
Given the parent's probabilities and each context's auxiliary number the pairs are independent, so parts sweep alone.
"""

from __future__ import annotations

import functools
import gc
import math
import pickle
import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneql.llm import textops as X
from sceneql.llm.common import held_out, prepared, table

#: Contexts whose pairs are dealt one by one; words that messages name by a number; Gibbs sweeps before and between samples; samples; steps of the parent a sweep.
SYMBOLS, COMMON, BURN, BETWEEN, SAMPLES, ROOT, SEED = 1024, 65536, 12, 3, 4, 20, 7
#: Rounds of sweeps, each with the parent as the last one left it; tokens of a chunk, and of a part if there are many; most customers of a dish whose tables are drawn from the exact law.
ROUNDS, CHUNK, PART, FEW = 2, 2_500_000, 3_000_000, 16
#: Counts up to EXACT have their own mean number of tables, larger ones share one for each 16th of an octave.
EXACT, OCTAVE = 1000, 16
#: Most tables of one rare word; the weight of a new one is near 1, so that more have no chance to speak of.
TABLES = 256
THETA = 1.0
END, START = np.uint64(0x9D5C_E1B0_73A6_4F21), np.uint64(0x3C79_AC49_2BA7_B653)
#: Turns in which chunks are scored: a turn's answers are on the disk together, and they grow with the parts until each pair has its own.
TURNS = 2
#: Seconds in which Py4J lets go of what Python has dropped; whether Spark removes a query's shuffles when it ends.
RELEASE_S, CLEANUP = 1.5, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What rows of the deals hold.
ROW = "to long, of long, kind int, data binary"
MESSAGE, STATE, LINKS, TEXTS, TABLES_OF, ASK, TOTAL, SUMS, ANSWER = range(9)


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of each place, first place of each row and the end): lower-cased words, then the end token, of every row."""
    h, first, _, _ = X.words(raw, off, X.LOWER)
    n = len(off) - 1
    out = np.empty(len(h) + n, dtype=np.uint64)
    at = first + np.arange(n + 1)
    last = at[1:] - 1
    out[last] = END
    inner = np.ones(len(out), dtype=bool)
    inner[last] = False
    out[inner] = h
    return out, at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of words that aren't rare here, and what all words add up to as the null word: enough to name the commonest."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, i = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return h, np.bincount(i, np.concatenate([y for _, y in held]), len(h)).astype(np.int64)

    def row() -> pa.RecordBatch:
        h, c = merged()
        often = c > c.sum() >> 20
        return pa.RecordBatch.from_arrays([pa.array([*h[often].view(np.int64), None], pa.int64()), pa.array(np.append(c[often], c.sum()))], names=["word", "n"])

    size = 0
    for b in batches:
        raw, off = X.utf8(b.column(0))
        for i, j in X.slices(off):
            held.append(np.unique(tokens(raw[off[i] : off[j]], off[i : j + 1] - off[i])[0], return_counts=True))
            size += len(held[-1][0])
        if size > 2_000_000:
            h, c = merged()
            if len(h) > 1_000_000:
                held = [(h, c)]
                yield row()
                held, size = [], 0
            else:
                held, size = [(h, c)], len(h)
    if held:
        yield row()


def find(hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place in the sorted hashes, or -1."""
    if not len(hashes):
        return np.full(len(h), -1)
    k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[k] == h, k, -1)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers; those that aren't hashes in as few bytes as their largest asks for, compressed with their numbers' first bytes first."""
    out = []
    for x in arrays:
        if x.dtype == np.uint64:
            out.append((x.dtype.str, len(x), x.tobytes()))
            continue
        if x.dtype.kind in "ui" and len(x):
            x = x.astype(np.promote_types(np.min_scalar_type(x.min()), np.min_scalar_type(x.max())))
        raw = np.ascontiguousarray(x).view(np.uint8)
        out.append((x.dtype.str, len(x), pa.compress(b"".join(raw[k :: x.itemsize].tobytes() for k in range(x.itemsize)), "zstd", asbytes=True) if len(x) else b""))
    return pickle.dumps(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, body in pickle.loads(data):
        x = np.zeros(n, dtype=kind)
        if x.dtype == np.uint64:
            x = np.frombuffer(body, dtype=kind)
        elif n:
            raw = np.frombuffer(pa.decompress(body, n * x.itemsize, "zstd", asbytes=True), np.uint8)
            for k in range(x.itemsize):
                x.view(np.uint8)[k :: x.itemsize] = raw[k * n : (k + 1) * n]
        out.append(x.astype(np.int64) if x.dtype.kind in "ui" and x.dtype != np.uint64 else x)
    return out


def named(h: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(1 + number of each hash among the common ones or 0, the other hashes)."""
    k = find(common, h)
    return (k + 1).astype(np.uint32), h[k < 0]


def hashes_of(code: np.ndarray, rest: np.ndarray, common: np.ndarray) -> np.ndarray:
    out = np.empty(len(code), dtype=np.uint64)
    out[code > 0] = common[code[code > 0].astype(np.int64) - 1]
    out[code == 0] = rest
    return out


def edges(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(1, np.int64)


def rows_of(rows: list[tuple]) -> pa.Table:
    to, of, kind, data = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"to": pa.array(to, pa.int64()), "of": pa.array(of, pa.int64()), "kind": pa.array(kind, pa.int32()), "data": pa.array(data, pa.binary())})


def in_order(t: pa.Table) -> list[tuple[int, int, bytes]]:
    """(kind, of, data) of a group's rows, in an order that doesn't depend on how they came."""
    kind, of = t.column("kind").to_numpy(), t.column("of").to_numpy()
    return [(int(kind[k]), int(of[k]), t.column("data")[int(k)].as_py()) for k in np.lexsort((of, kind))]


def _messages(batches: Iterator[pa.RecordBatch], common: np.ndarray, wide: np.ndarray, many: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of each chunk of texts (doc_id, held out, text), a row for each part, and a row about the texts."""
    held: list[tuple] = []
    task, taken, size = TaskContext.get().partitionId(), 0, 0

    def sent() -> Iterator[pa.RecordBatch]:
        number = task << 32 | taken
        token = np.concatenate([x[0] for x in held])
        length = np.concatenate([x[1] for x in held])
        train = np.concatenate([x[2] for x in held])
        ids = pa.RecordBatch.from_arrays([pa.concat_arrays([x[3] for x in held])], names=["doc_id"])
        held.clear()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ids.schema) as w:
            w.write_batch(ids)
        rows = [(number % many, number, TEXTS, pickle.dumps((sink.getvalue().to_pybytes(), packed(length))))]
        text = np.repeat(np.arange(len(length), dtype=np.uint32), length)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[np.cumsum(length) - length] = START
        key = X.joined(before, token)
        order = np.argsort(key, kind="stable")
        cut = edges(key[order])
        first, times = order[cut[:-1]], np.diff(cut)
        n = np.add.reduceat(train[text[order]].astype(np.int64), cut[:-1])
        text = text[order]
        key, before, token = key[first], before[first], token[first]
        by = np.argsort(before, kind="stable")
        run = edges(before[by])
        deal = before[by]
        for k in np.flatnonzero(find(wide, before[by[run[:-1]]]) >= 0):
            deal[run[k] : run[k + 1]] = key[by[run[k] : run[k + 1]]]
        part = (X.mix(deal) % np.uint64(many)).astype(np.int64)
        order = np.argsort(part.astype(np.uint16) if many < 1 << 16 else part, kind="stable")
        by, part = by[order], part[order]
        at = edges(part)
        for i, j in zip(at[:-1], at[1:]):
            g = by[i:j]
            run = edges(before[g])
            rows.append((int(part[i]), number, MESSAGE, packed(
                *named(before[g][run[:-1]], common), np.diff(run).astype(np.uint32), *named(token[g], common), n[g].astype(np.uint32), times[g].astype(np.uint32), text[X.ranges(cut[g], times[g])],
            )))
        yield from rows_of(rows).to_batches()

    for b in batches:
        raw, off = X.utf8(b.column(2))
        for i, j in X.slices(off):
            token, at = tokens(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            held.append((token, np.diff(at), ~b.column(1).slice(i, j - i).to_numpy(zero_copy_only=False), b.column(0).slice(i, j - i)))
            size += len(token)
            if size >= chunk:
                yield from sent()
                taken, size = taken + 1, 0
    if held:
        yield from sent()


class Part:
    """The pairs of a part: contexts and words by hash, and for each pair its context's and word's places, count and tables.

    Pairs are in the order of their contexts and then of their keys; words in that of the parts that they are dealt to.
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, own: np.ndarray, c: np.ndarray, w: np.ndarray, n: np.ndarray, t: np.ndarray):
        self.context, self.word, self.own, self.c, self.w, self.n, self.t = context, word, own, c, w, n, t

    @classmethod
    def read(cls, rows: list[tuple[int, int, bytes]], common: np.ndarray) -> Part:
        by = {kind: data for kind, _, data in rows if kind in (STATE, TABLES_OF)}
        context, rest, runs, word, other, own, w, n = unpacked(by[STATE])
        t = (n > 0).astype(np.float32)
        if TABLES_OF in by:
            t[n > 1] = unpacked(by[TABLES_OF])[0]
        return cls(hashes_of(context, rest, common), hashes_of(word, other, common), own, np.repeat(np.arange(len(runs)), runs), w, n, t)

    def state(self, part: int, common: np.ndarray) -> tuple:
        runs = np.bincount(self.c, minlength=len(self.context))
        return part, 0, STATE, packed(*named(self.context, common), runs, *named(self.word, common), self.own, self.w, self.n)

    def rows(self, part: int, common: np.ndarray, wide: np.ndarray) -> list[tuple]:
        """Its tables, what it says to the parts of its words, and sums of the commonest contexts."""
        out = [(part, 0, TABLES_OF, packed(self.t[self.n > 1]))]
        n, t = np.bincount(self.w, self.n, len(self.word)).astype(np.int64), np.bincount(self.w, self.t, len(self.word))
        at = np.append(0, np.cumsum(self.own))
        for k in np.flatnonzero(self.own):
            s = slice(at[k], at[k + 1])
            out.append((int(k), part, ASK, packed(*named(self.word[s], common), n[s], t[s].astype(np.float32))))
        place = find(wide, self.context)[self.c]
        of = place >= 0
        out.append((-1, part, SUMS, packed(np.array([(self.n == 1).sum(), (self.n == 2).sum()]), np.bincount(place[of], self.n[of], len(wide)), np.bincount(place[of], self.t[of], len(wide)))))
        return out

    def totals(self, rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and tables of its words over all parts."""
        at = np.append(0, np.cumsum(self.own))
        n, t = np.zeros(len(self.word), np.int64), np.zeros(len(self.word))
        for kind, of, data in rows:
            if kind == TOTAL:
                n[at[of] : at[of + 1]], t[at[of] : at[of + 1]] = unpacked(data)
        return n, t


def _merge(t: pa.Table, common: np.ndarray, many: int) -> pa.Table:
    """A part from its messages; what it keeps of each is the number of each pair."""
    part, out, said = t.column("to")[0].as_py(), [], []
    for kind, of, data in in_order(t):
        if kind == TEXTS:
            out.append((of, -1, TEXTS, data))
            continue
        before, rest, runs, code, other, n, times, text = unpacked(data)
        said.append((of, np.repeat(hashes_of(before, rest, common), runs), hashes_of(code, other, common), n, times, text))
    if not said:
        return rows_of(out)
    context, word, n = (np.concatenate([x[k] for x in said]) for k in (1, 2, 3))
    _, first, inverse = np.unique(X.joined(context, word), return_index=True, return_inverse=True)
    n = np.bincount(inverse, n, len(first)).astype(np.int64)
    by = np.argsort(context[first], kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    number = rank[inverse]
    context, word, n = context[first][by], word[first][by], n[by]
    context, c = np.unique(context, return_inverse=True)
    word, w = np.unique(word, return_inverse=True)
    owner = (X.mix(word ^ END) % np.uint64(many)).astype(np.int64)
    by = np.argsort(owner, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    own = Part(context, word[by], np.bincount(owner, minlength=many), c, rank[w], n, (n > 0).astype(np.float32))
    out.append(own.state(part, common))
    at = 0
    for of, _, words, _, times, text in said:
        out.append((part, of, LINKS, packed(np.diff(number[at : at + len(words)], prepend=0).astype(np.int32), times, text)))
        at += len(words)
    return rows_of(out)


def _begun(batches: Iterator[pa.RecordBatch], common: np.ndarray, wide: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What parts say before any sweep, when each pair has one table: apart from their states, so that it can go when it has been heard."""
    for b in batches:
        for to, data in zip(b.column(0), b.column(3)):
            yield from rows_of(Part.read([(STATE, 0, data.as_py())], common).rows(to.as_py(), common, wide)).to_batches()


def _total(t: pa.Table, common: np.ndarray) -> pa.Table:
    """To each part the counts and tables of the words that it named, over all parts; and how many words have so many tables."""
    own, rows = t.column("to")[0].as_py(), in_order(t)
    said = []
    for _, of, data in rows:
        code, rest, n, tables = unpacked(data)
        said.append((of, hashes_of(code, rest, common), n, tables))
    word, w = np.unique(np.concatenate([x[1] for x in said]), return_inverse=True)
    n = np.bincount(w, np.concatenate([x[2] for x in said]), len(word)).astype(np.int64)
    tables = np.bincount(w, np.concatenate([x[3] for x in said]), len(word))
    group, g = np.unique(group_of(tables[n > 0]), return_inverse=True)
    out = [(-1, own, SUMS, packed(np.array([n.sum(), (n > 0).sum()]), group, np.bincount(g, minlength=len(group)), np.bincount(g, tables[n > 0], len(group))))]
    at = 0
    for of, words, *_ in said:
        k = w[at : at + len(words)]
        out.append((of, own, TOTAL, packed(n[k], tables[k].astype(np.float32))))
        at += len(words)
    return rows_of(out)


class Sibuya:
    """A table's size where seats are given with a discount: p(n) = d G(n - d) / (G(1 - d) n!), heavy in its tail."""

    EXACT = 4096

    def __init__(self, discount: float):
        self.d = discount
        n = np.arange(2, self.EXACT + 1)
        self.log = np.concatenate([[-np.inf, math.log(discount)], math.log(discount) + np.cumsum(np.log((n - 1 - discount) / n))])

    def logp(self, n: np.ndarray) -> np.ndarray:
        """log p(n); beyond EXACT by the gamma functions' ratio for large numbers."""
        d, x = self.d, np.maximum(n, 1).astype(float)
        far = math.log(d) - math.lgamma(1 - d) - (1 + d) * np.log(x) + d * (1 + d) / (2 * x)
        return np.where(n <= self.EXACT, self.log[np.clip(n, 0, self.EXACT)], far)

    def draw(self, tilt: np.ndarray, most: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Sizes in proportion to p(n) * tilt**n; most + 1 stands for any larger one. A size is geometric with a beta-distributed chance."""
        out = np.zeros(len(tilt), dtype=np.int64)
        left = np.arange(len(tilt))
        while len(left):
            chance = np.clip(rng.beta(self.d, 1 - self.d, len(left)), 1e-300, 1 - 1e-16)
            size = 1 + np.floor(np.minimum(np.log(1 - rng.random(len(left))) / np.log1p(-chance), 4e18))
            keep = rng.random(len(left)) < np.exp(np.log(tilt[left]) * (size - 1))
            out[left[keep]] = np.minimum(size[keep], most[left[keep]] + 1)
            left = left[~keep]
        return out


class Seating:
    """Tables of many dishes that take Gibbs steps together; in each step every customer stands up and sits down again.

    Given its weight a of a new table, a dish's seating has the probability of a set of tables whose number is Poisson
    with mean a/d and whose sizes are Sibuya's, given that the sizes sum to the customers. A step deals a dish's tables
    to blocks by chance (so a block's mean is that share of a/d; one block, or about four tables each where the sum
    binds) and draws each block anew: all of its tables but one, which gets the rest, accepted by the Metropolis-Hastings
    ratio. A block's customers move as one, so the work grows with the tables, not with the customers.
    """

    BLOCK = 4

    def __init__(self, customers: np.ndarray, discount: float, rng: np.random.Generator):
        self.customers = customers.astype(np.int64)
        self.dish = np.flatnonzero(self.customers)
        self.size = self.customers[self.dish].astype(np.int64)
        self.rng, self.law = rng, Sibuya(discount)

    def tables(self) -> np.ndarray:
        return np.bincount(self.dish, minlength=len(self.customers))

    def step(self, weight: np.ndarray) -> None:
        """weight: of a new table, for each dish, in units of the discount (a/d)."""
        rng, law, d = self.rng, self.law, self.law.d
        moves = self.customers[self.dish] > 1
        dish, size = self.dish[moves], self.size[moves]
        if not len(dish):
            return

        def tilted(rate: np.ndarray, total: np.ndarray) -> np.ndarray:
            """1 - tilt = x with which the mean total is what it is: rate d (1 - x) x**(d - 1) = total, by Newton's steps."""
            r = np.log(total / (rate * d))
            u = -np.maximum(r, 0) / (1 - d) - np.minimum(r, 0)
            for _ in range(4):
                x = 1 / (1 + np.exp(-u))
                u = np.clip(u + ((1 - d) * np.logaddexp(0, -u) - np.logaddexp(0, u) - r) / (x + (1 - d) * (1 - x)), -60, 30)
            return np.clip(1 / (1 + np.exp(-u)), 1e-15, 1 - 1e-9)

        rate = np.maximum(weight, 1e-12)
        held = np.maximum(self.customers, 1)
        tight = rate * tilted(rate, held) ** d  # how much the sum of the sizes binds their number
        blocks = np.maximum(1, np.ceil(np.minimum(tight / 2, np.minimum(rate, held) / self.BLOCK))).astype(np.int64)
        label = (rng.random(len(dish)) * blocks[dish]).astype(np.int64)
        # the first of a block is kept apart: any of its tables, with chances as their sizes
        order = np.lexsort((rng.exponential(size=len(dish)) / size, label, dish))
        dish, size, label = dish[order], size[order], label[order]
        first = np.flatnonzero(np.append(True, (dish[1:] != dish[:-1]) | (label[1:] != label[:-1])))
        of, n = dish[first], np.diff(np.append(first, len(dish)))
        total = np.add.reduceat(size, first)
        own = rate[of] / blocks[of]
        tilt = 1 - tilted(own, total)
        more = rng.poisson(own * (1 - (1 - tilt) ** d))
        block = np.repeat(np.arange(len(of)), more)
        drawn = law.draw(tilt[block], total[block], rng)
        rest = total - np.bincount(block, drawn, len(of)).astype(np.int64)

        def log_weight(apart: np.ndarray) -> np.ndarray:
            return law.logp(apart) + apart * np.log(tilt) + np.log(apart)

        ratio = log_weight(np.maximum(rest, 1)) - log_weight(size[first])
        new = (rest > 0) & (np.log(1 - rng.random(len(of))) < ratio)
        stay = ~np.repeat(new, n)
        born = new[block]
        self.dish = np.concatenate([self.dish[~moves], dish[stay], of[block[born]], of[new]])
        self.size = np.concatenate([self.size[~moves], size[stay], drawn[born], rest[new]])


def discount(customers: np.ndarray, weight: np.ndarray | None = None) -> float:
    """From how many dishes have one customer and two; within .05 and .95."""
    one, two = (float(np.sum((customers == k) * (1 if weight is None else weight))) for k in (1, 2))
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


def pseudo(tables: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """For restaurants with so many tables: the auxiliary gamma numbers, given which all dishes are independent."""
    return rng.gamma(THETA / d + tables)


def fit_contexts(count: np.ndarray, seed: int = SEED) -> np.ndarray:
    """log10 of the averaged predictive probabilities (context, symbol) from counts (context, symbol).

    A sweep seats the tables of the contexts as customers of the parent afresh (ROOT steps), draws the parent's
    probabilities given that seating, and seats all customers of all contexts given those.
    """
    rng = np.random.default_rng(seed)
    rows, width = count.shape
    flat = count.ravel()
    some = np.flatnonzero(flat)
    context, symbol = some // width, some % width
    d1 = discount(flat)
    low = Seating(flat[some], d1, rng)
    d0 = discount(np.bincount(symbol, minlength=width))
    total = count.sum(axis=1)
    mean, taken = np.zeros((rows, width)), 0
    for step in range(BURN + BETWEEN * SAMPLES):
        t = low.tables()
        below = np.bincount(context, t, rows)
        c0 = np.bincount(symbol, t, width).astype(np.int64)
        top = Seating(c0, d0, rng)
        for _ in range(ROOT):
            top.step(np.full(width, float(pseudo(top.tables().sum(), d0, rng)) / width))
        t0 = top.tables()
        fresh = THETA + d0 * t0.sum()
        if step >= BURN and (step - BURN) % BETWEEN == 0:
            parent = (c0 - d0 * t0 + fresh / width) / (THETA + c0.sum())
            p = (THETA + d1 * below)[:, None] * parent[None, :]
            p[context, symbol] += flat[some] - d1 * t
            mean += p / (THETA + total)[:, None]
            taken += 1
        seen = np.flatnonzero(c0)
        drawn = rng.gamma(np.append(c0[seen] - d0 * t0[seen], fresh))
        share = np.zeros(width)
        share[seen] = drawn[:-1] / drawn.sum() + drawn[-1] / drawn.sum() / width
        low.step(pseudo(below, d1, rng)[context] * share[symbol])
    return np.log10(mean / taken)


def seatings(counts: np.ndarray, d: float, most: int = TABLES) -> np.ndarray:
    """(counts, tables 1 .. most): log of how much of all seatings have so many tables, each weighing one.

    By the recursion of the generalised Stirling numbers, S(n + 1, k) = S(n, k - 1) + (n - d k) S(n, k), up to EXACT
    customers. From there new tables come like a Poisson process whose clock runs with n**d / d.
    """
    k = np.arange(1, most + 1)
    s = np.zeros(most)
    s[0] = 1.0
    want = np.round(counts).astype(np.int64)
    out = np.full((len(counts), most), -np.inf)
    with np.errstate(divide="ignore"):
        for n in range(1, int(min(max(want, default=1), EXACT)) + 1):
            if n > 1:
                s = np.append(0.0, s[:-1]) + np.maximum(n - 1 - d * k, 0.0) * s
                s /= s.max()
            out[want == n] = np.log(s)
        start = np.log(s) - np.array([math.lgamma(EXACT - d * x) for x in k])
    jump = k[:, None] - k[None, :]
    factorial = np.array([math.lgamma(j + 1) for j in range(most)])[np.maximum(jump, 0)]
    for row in np.flatnonzero(want > EXACT):
        clock = math.log((float(want[row]) ** d - EXACT**d) / d)
        both = np.where(jump >= 0, jump * clock - factorial, -np.inf) + start
        peak = both.max(axis=1)
        out[row] = peak + np.log(np.exp(both - peak[:, None]).sum(axis=1)) - d * k * math.log(float(want[row]))
    return out


def table_law(logs: np.ndarray, weight: float, d: float) -> np.ndarray:
    """The probability of each number of tables; logs: of seatings, weight: of a new table, in units of d."""
    logs = logs + np.arange(1, logs.shape[1] + 1) * math.log(max(weight * d, 1e-300))
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit_words(count: np.ndarray, words: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, float, float, float]:
    """(mean tables of a word with each count, discount, weight of an unseen word, all customers plus strength).

    count: (mean) counts of groups of words, words: how many of each group. All words of a group have one law, so that
    a sweep seats all of them by one multinomial draw.
    """
    if not len(count):
        return np.zeros(0), 0.5, THETA, THETA
    rng = np.random.default_rng(seed)
    d, v = discount(np.round(count), words), float(words.sum()) + 1
    k, logs = np.arange(1, TABLES + 1), seatings(count, d)
    whole, mean, taken, rest = int(words.sum()), np.zeros(len(count)), 0, 0.0
    for step in range(BURN + BETWEEN * SAMPLES):
        law = table_law(logs, float(pseudo(np.array(whole), d, rng)) / v, d)
        whole = int(sum(rng.multinomial(int(n), p) @ k for n, p in zip(words, law)))
        if step >= BURN and (step - BURN) % BETWEEN == 0:
            mean, rest, taken = mean + law @ k, rest + (THETA + d * whole) / v, taken + 1
    return mean / taken, d, rest / taken, THETA + float((count * words).sum())


def group_of(count: np.ndarray) -> np.ndarray:
    count = np.round(count)
    return np.where(count <= EXACT, count, EXACT + 1 + np.floor(np.log2(np.maximum(count, 1) / EXACT) * OCTAVE)).astype(np.int64)


class Cells:
    """Tables of many dishes of two customers and more: of few customers by the exact law, of more by steps of a seating."""

    def __init__(self, n: np.ndarray, d: float, rng: np.random.Generator):
        self.d, self.rng = d, rng
        self.few = [(np.flatnonzero(n == c), seatings(np.array([float(c)]), d, int(c))) for c in np.unique(n[n <= FEW])]
        self.more = np.flatnonzero(n > FEW)
        self.seating = Seating(n[self.more], d, rng)

    def step(self, weight: np.ndarray) -> np.ndarray:
        """Tables after a sweep; weight: of a new table, in units of the discount."""
        out = np.empty(len(weight))
        for at, logs in self.few:
            p = logs + np.log(np.maximum(weight[at] * self.d, 1e-300))[:, None] * np.arange(1, logs.shape[1] + 1)
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (p[:, :-1] < self.rng.random((len(at), 1)) * p[:, -1:]).sum(axis=1)
        self.seating.step(weight[self.more])
        out[self.more] = self.seating.tables()[: len(self.more)]
        return out


class Model:
    """What all parts share: the commonest words and contexts, the discount, the parent by numbers of tables, and sums of the commonest contexts."""

    def __init__(self, common: np.ndarray, wide: np.ndarray, seed: int):
        self.common, self.wide, self.seed = common, wide, seed

    def learn(self, parts_: list[bytes], words: list[bytes]) -> None:
        rng = np.random.default_rng(self.seed)
        own = [unpacked(x) for x in parts_]
        one, two = sum((x[0] for x in own), np.zeros(2, np.int64))
        self.discount = min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
        self.wide_n, self.wide_t = (sum((x[k] for x in own), np.zeros(len(self.wide))) for k in (1, 2))
        self.wide_g = pseudo(self.wide_t, self.discount, rng)
        own = [unpacked(x) for x in words]
        self.n, self.v = (int(sum(x[0][k] for x in own)) for k in (0, 1))
        group, number, sums = (np.concatenate([x[k] for x in own] or [np.zeros(0)]) for k in (1, 2, 3))
        self.group, g = np.unique(group, return_inverse=True)
        number, sums = np.bincount(g, number, len(self.group)), np.bincount(g, sums, len(self.group))
        self.tables, self.less, self.unseen, self.whole = fit_words(sums / np.maximum(number, 1), number.astype(np.int64), self.seed)
        if not self.n:
            self.unseen = self.whole = 1.0

    def parent(self, tables: np.ndarray) -> np.ndarray:
        """The parent's probability of words that have so many tables below."""
        k = np.minimum(np.searchsorted(self.group, group_of(tables)), max(len(self.group) - 1, 0))
        seats = self.tables[k] if len(self.tables) else 0.0
        return np.where(tables > 0, np.maximum(tables - self.less * seats + self.unseen, 1e-12), self.unseen) / self.whole


def _sweep(t: pa.Table, m: Model, samples: int) -> pa.Table:
    """A part after a round of sweeps, with its pairs' mean tables."""
    number, rows = t.column("to")[0].as_py(), in_order(t)
    part = Part.read(rows, m.common)
    rng = np.random.default_rng([m.seed, number])
    share = m.parent(part.totals(rows)[1])
    move = np.flatnonzero(part.n > 1)
    c, share = part.c[move], share[part.w[move]]
    cells = Cells(part.n[move], m.discount, rng)
    kinds = np.bincount(part.c, part.n > 0, len(part.context))
    place = find(m.wide, part.context)
    tables, mean, taken = part.t[move].astype(float), np.zeros(len(move)), 0
    for step in range(BURN + BETWEEN * (samples - 1) + 1):
        g = pseudo(kinds + np.bincount(c, tables - 1, len(kinds)), m.discount, rng)
        g[place >= 0] = m.wide_g[place[place >= 0]]
        tables = cells.step(g[c] * share)
        if step >= BURN and (step - BURN) % BETWEEN == 0:
            mean, taken = mean + tables, taken + 1
    part.t[move] = mean / taken
    return rows_of(part.rows(number, m.common, m.wide))


def _answer(t: pa.Table, m: Model) -> pa.Table:
    """For each chunk the sums over its texts of what this part's pairs give."""
    rows = in_order(t)
    part = Part.read(rows, m.common)
    count, tables = part.totals(rows)
    n, seats = np.bincount(part.c, part.n, len(part.context)), np.bincount(part.c, part.t, len(part.context))
    place = find(m.wide, part.context)
    n[place >= 0], seats[place >= 0] = m.wide_n[place[place >= 0]], m.wide_t[place[place >= 0]]
    own = np.maximum(part.n - m.discount * part.t, 0.0)
    score = np.log10((own + (THETA + m.discount * seats)[part.c] * m.parent(tables)[part.w]) / (THETA + n)[part.c])
    base, known = np.log10(count + 1.0)[part.w], (count > 0)[part.w]
    out = []
    for kind, of, data in rows:
        if kind == LINKS:
            number, times, text = unpacked(data)
            k = np.repeat(np.cumsum(number, dtype=np.int64), times)
            some = np.flatnonzero(np.bincount(text))
            sums = [np.bincount(text, x[k])[some] for x in (score, base, known)]
            out.append((of, t.column("to")[0].as_py(), ANSWER, packed(np.diff(some, prepend=0), sums[0].astype(np.float32), sums[1], sums[2].astype(np.uint32))))
    return rows_of(out)


def _texts(t: pa.Table, n: int, v: int) -> pa.Table:
    """The rows of a chunk's texts from all parts' sums."""
    rows = in_order(t)
    ids, length = pickle.loads(next(data for kind, _, data in rows if kind == TEXTS))
    length = unpacked(length)[0].astype(np.int64)
    score, base, known = (np.zeros(len(length)) for _ in range(3))
    for kind, _, data in rows:
        if kind == ANSWER:
            step, *sums = unpacked(data)
            at = np.cumsum(step, dtype=np.int64)
            for whole, x in zip((score, base, known), sums):
                whole[at] += x
    with pa.ipc.open_stream(ids) as r:
        ids = r.read_all().column(0)
    return pa.table({"doc_id": ids, "n_tokens": length, "n_known": known.astype(np.int64), "base_score": base - length * math.log10(n + v + 1), "score": score})


def forget(spark: SparkSession) -> None:
    """Shuffles and checkpoints that nothing refers to any more, also those of earlier results, leave the disk when the JVM collects its garbage.

    Py4J lets go of the JVM's objects in a thread of its own that looks once a second: a collection without the wait would come
    too early and leave what was dropped last until the next call.
    """
    gc.collect()
    time.sleep(RELEASE_S)
    spark.sparkContext._jvm.System.gc()


@contextmanager
def removing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made inside remove their shuffles' files as soon as they have run: what they give is a checkpoint or with the driver."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", symbols: int = SYMBOLS, common: int = COMMON, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    symbols, common and chunk (tokens) say how pairs are dealt and sent and don't bound what is learnt. A null or empty text
    is the end token alone. A null id is not held out. Repeated rows are counted and scored as often as they occur. Other
    columns are ignored. Without training rows every token is unknown and scores are 0. An empty table gives an empty result.
    """
    spark = prepared(docs.sparkSession)
    forget(spark)
    d = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, 7, 2).alias("held"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    with removing_shuffles(spark):
        counts = d.where("not held").select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        top = counts.orderBy(F.col("word").isNotNull(), F.desc("n"), "word").limit(common + 1).toArrow()
    all_ = int(top.column(1)[0].as_py()) if len(top) else 0
    best = top.column(0).slice(1).to_numpy().astype(np.int64).view(np.uint64)
    many = max(spark.sparkContext.defaultParallelism, all_ // PART + 1)
    model = Model(np.sort(best), np.sort(np.append(best[:symbols], START)), seed)
    sent = spark.sparkContext.broadcast(model)

    def dealt(rows: DataFrame, f) -> DataFrame:
        return rows.groupBy("to").applyInArrow(f, ROW)

    def of(rows: DataFrame, *kinds: int) -> DataFrame:
        return rows.where(F.col("kind").isin(*kinds))

    def turn(number: str) -> Column:
        return F.pmod(F.hash(number), F.lit(TURNS))

    def swept(model: Broadcast, samples: int):
        return lambda t: _sweep(t, model.value, samples)

    def sums(rows: DataFrame) -> list[bytes]:
        return [bytes(r.data) for r in sorted(of(rows, SUMS).select("of", "data").collect())]

    with removing_shuffles(spark):
        messages = d.mapInArrow(lambda it: _messages(it, sent.value.common, sent.value.wide, many, chunk), ROW)
        first = dealt(messages, lambda t: _merge(t, sent.value.common, many)).checkpoint()
        state = of(first, STATE).mapInArrow(lambda it: _begun(it, sent.value.common, sent.value.wide), ROW).checkpoint()
        for k in range(ROUNDS + 1):
            totals = dealt(of(state, ASK), lambda t: _total(t, sent.value.common)).checkpoint()
            model.seed = seed + k
            model.learn(sums(state), sums(totals))
            now = spark.sparkContext.broadcast(model)
            if k == ROUNDS:
                state = of(state, TABLES_OF).checkpoint()
            known = of(first, STATE).unionByName(of(state, TABLES_OF)).unionByName(of(totals, TOTAL))
            if k:
                forget(spark)
            if k < ROUNDS:
                state = dealt(known, swept(now, SAMPLES if k == ROUNDS - 1 else 1)).checkpoint()
        n, v = model.n, model.v
        scored = []
        for k in range(TURNS):
            answers = dealt(known.unionByName(of(first, LINKS).where(turn("of") == k)), lambda t: _answer(t, now.value))
            texts = of(first, TEXTS).where(turn("to") == k).unionByName(answers).groupBy("to")
            scored.append(texts.applyInArrow(lambda t: _texts(t, n, v), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double").checkpoint())
    out = functools.reduce(DataFrame.unionByName, scored)
    return out.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(prepared(spark), sf_dir, "documents"))
