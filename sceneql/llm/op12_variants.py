"""Spelling variants: words and the much commoner words that are one edit away.

Words are counted over all texts, pre-aggregated by each task. Of two words that differ by one edit, either the first half
of one, or its last half, stands in the other unchanged. So words meet by their halves: a word is asked for under its own
two halves, and stands in the dictionary under the halves that a word one shorter, as long or one longer would ask for. A
task builds two minimal acyclic automata over the words that met in it, one of the words and one of the reversed words. It
walks a half exactly, completes the rest with one error, and reads the words it ends in by their perfect-hash numbers, the
number of words before them in the automaton's order. What both directions would find counts in the forward one alone.
Halves with very many words are salted: each part of their dictionary is searched apart.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneql.llm import crc
from sceneql.llm import textops as X
from sceneql.llm.common import parts, prepared, table

MIN_CHARS, MIN_N, MODULUS, RATIO = 6, 5, 199, 5
#: Distinct words that a task holds while it counts; rows that meet in a task; dictionary words under one half before it is salted.
HELD, TASK_ROWS, HALF_ROWS = 200_000, 60_000, 20_000

_ASCII = np.zeros(256, dtype=bool)
_ASCII[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def letters(raw: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF, which are C3 and one more byte, as UTF-8."""
    inside = _ASCII[raw]
    lead = np.flatnonzero(raw == 0xC3)
    inside[lead] = inside[lead + 1] = True  # a lead byte always has its second
    return inside


def words(raw: np.ndarray, off: np.ndarray, prefix: np.ndarray, modulus: int, least: int) -> tuple[pa.Array, list[str]]:
    """The words of rows: those that stay as they are, with `least` code points or more, and those that lose one.

    prefix: the checksum of what stands before each row's words when they are hashed.
    """
    raw = X.LOWER[raw]
    inside = letters(raw)
    row, start, end = crc.runs(inside, off)
    h = crc.done(crc.more(crc.begun(len(row), prefix[row]), raw, start, end))
    before = np.append(0, np.cumsum(raw == 0xC3))
    chars = end - start - (before[end] - before[start])
    changed = h % modulus == 0
    cut = []
    for i in np.flatnonzero(changed & (chars > least)).tolist():
        word, at = raw[start[i] : end[i]].tobytes().decode(), int(h[i] % chars[i])
        cut.append(word[:at] + word[at + 1 :])
    keep = ~changed & (chars >= least)
    start, size = start[keep], (end - start)[keep]
    data = raw[X.ranges(start, size)]
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))), cut


def _count(batches: Iterator[pa.RecordBatch], modulus: int, least: int, held: int = HELD) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        raw, off = X.utf8(b.column(1))
        prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ("" if i is None else i for i in b.column(0).to_pylist())], dtype=np.int64)
        for i, j in X.slices(off, 1 << 21):
            kept, cut = words(raw[off[i] : off[j]], off[i : j + 1] - off[i], prefix[i:j], modulus, least)
            found = pc.value_counts(kept)
            total.update(dict(zip(found.field(0).to_pylist(), found.field(1).to_pylist())))
            total.update(cut)
            if len(total) >= held:
                yield out()
                total.clear()
    yield out()


def counted(docs: DataFrame, modulus: int = MODULUS, min_chars: int = MIN_CHARS, min_n: int = MIN_N) -> DataFrame:
    """(word, n) of the distinct words of rows (doc_id, text), after some have lost a code point."""
    found = docs.mapInArrow(lambda it: _count(it, modulus, min_chars), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, with perfect-hash numbers.

    A word's number is its place among the words: the sum, along its path, of the words that end on the way and of those
    below the smaller letters passed over.
    """

    def __init__(self, ordered: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, last = [0], ""

        def settle(down: int) -> None:
            """Replace what hangs below depth `down` of the last word by equal states known before."""
            while len(path) > down + 1:
                state = path.pop()
                key = (self.final[state], *self.edges[state].items())
                same = known.setdefault(key, state)
                if same != state:
                    self.edges[path[-1]][last[len(path) - 1]] = same
                    if state == len(self.edges) - 1:
                        self.edges.pop()
                        self.final.pop()

        for word in ordered:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            settle(common)
            for c in word[common:]:
                self.edges.append({})
                self.final.append(False)
                self.edges[path[-1]][c] = len(self.edges) - 1
                path.append(len(self.edges) - 1)
            self.final[path[-1]] = True
            last = word
        settle(0)
        self._number()

    def _number(self) -> None:
        """Turn each edge's target into (target, words of the state that come before those of this edge)."""
        size: dict[int, int] = {}
        stack = [0]
        while stack:
            state = stack[-1]
            below = [t for t in self.edges[state].values() if t not in size] if state not in size else []
            if below:
                stack.extend(below)
                continue
            stack.pop()
            if state in size:
                continue
            at, numbered = int(self.final[state]), {}
            for c, t in self.edges[state].items():
                numbered[c] = (t, at)
                at += size[t]
            self.edges[state], size[state] = numbered, at

    def walk(self, state: int, number: int, word: str) -> tuple[int, int] | None:
        """The state and number after the letters of word; None where there is no such path."""
        for c in word:
            step = self.edges[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, half: str, rest: str) -> set[int]:
        """Numbers of the words that begin with half and go on as rest with exactly one inserted, deleted or replaced letter."""
        out: set[int] = set()
        at = self.walk(0, 0, half)
        if at is None:
            return out

        def end(state: int, number: int, word: str) -> None:
            last = self.walk(state, number, word)
            if last is not None and self.final[last[0]]:
                out.add(last[1])

        state, number = at
        for k in range(len(rest) + 1):
            after = rest[k + 1 :]
            if k < len(rest):
                end(state, number, after)  # without this letter
            for c, (t, first) in self.edges[state].items():
                end(t, number + first, rest[k:])  # with one more before it
                if k < len(rest) and c != rest[k]:
                    end(t, number + first, after)  # with another one in its place
            step = self.edges[state].get(rest[k]) if k < len(rest) else None
            if step is None:
                break
            state, number = step[0], number + step[1]
        # a letter inserted beside its like, and the word itself, are the same path
        whole = self.walk(*at, rest)
        if whole is not None and self.final[whole[0]]:
            out.discard(whole[1])
        return out


def salt(word: str, salts: int) -> int:
    return zlib.crc32(word.encode()) % salts


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, n_near, near): of each word that asks, how many near words it finds here and the commonest of them."""
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
    n = {word: count for _, _, word, count, *_ in rows}
    for back in (False, True):
        turn = (lambda w: w[::-1]) if back else (lambda w: w)
        mine = [r for r in rows if r[0] == back]
        ordered = sorted({turn(r[2]) for r in mine if r[4]})
        found = Automaton(ordered)
        out = []
        for _, half, word, count, _, asks, part, salts in mine:
            if not asks:
                continue
            rest = word[: len(word) - len(half)] if back else word[len(half) :]
            near = [turn(ordered[k]) for k in found.one_error(turn(half), turn(rest))]
            if back:
                near = [v for v in near if not v.startswith(first_half(word))]
            if salts > 1:
                near = [v for v in near if salt(v, salts) == part]
            best = min(near, key=lambda v: (-n[v], v), default=None)
            out.append((word, count, len(near), best and {"order": -n[best], "word": best}))
        for i in range(0, len(out), 10_000):
            columns = zip(*out[i : i + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.struct([("order", pa.int64()), ("word", pa.string())])))], names=["word", "n", "n_near", "near"])


def first_half(word: str) -> str:
    """The half of a word that the forward direction walks exactly."""
    return word[: len(word) // 2]


def halves(vocabulary: DataFrame) -> DataFrame:
    """(back, half, word, n, asks) of every half under which a word stands or asks.

    A word of L letters asks under its first L div 2 letters and under the others. It stands under the halves that words of
    L - 1, L and L + 1 letters ask for.
    """
    L = F.char_length("word")
    asked = {False: lambda n: F.floor(n / 2).cast("int"), True: lambda n: F.ceil(n / 2).cast("int")}
    sizes = [F.array_distinct(F.array(f(L - 1), f(L), f(L + 1))) for f in asked.values()]
    both = [vocabulary.select(F.lit(back).alias("back"), F.explode(size).alias("size"), "word", "n") for back, size in zip(asked, sizes)]
    forward = both[0].select("back", F.substring("word", F.lit(1), F.col("size")).alias("half"), "word", "n", (F.col("size") == F.floor(L / 2)).alias("asks"))
    backward = both[1].select("back", F.substring("word", L - F.col("size") + 1, F.col("size")).alias("half"), "word", "n", (F.col("size") == F.ceil(L / 2)).alias("asks"))
    return forward.unionByName(backward)


def near_words(vocabulary: DataFrame, task_rows: int = TASK_ROWS, half_rows: int = HALF_ROWS) -> DataFrame:
    """(word, n, n_near, near): of each of the distinct words, the number of words one edit away and the commonest (order:
    its count, negative; ties to the smallest word by code points)."""
    rows = halves(vocabulary)
    large = rows.groupBy("back", "half").agg(F.count("*").alias("rows")).where(F.col("rows") > half_rows).select("back", "half", F.ceil(F.col("rows") / half_rows).cast("int").alias("salts"))
    rows = rows.join(large, ["back", "half"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = (F.crc32(F.col("word").cast("binary")) % F.col("salts")).cast("int")
    # a word stands in its own part of the dictionary and asks in all of them
    rows = rows.withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(own))))
    rows = rows.select("back", "half", "word", "n", (F.col("part") == own).alias("stands"), "asks", "part", "salts")
    tasks = max(parts(vocabulary.sparkSession), -(-4 * vocabulary.count() // task_rows))
    met = rows.repartition(tasks, "back", "half", "part").mapInArrow(_match, "word string, n long, n_near long, near struct<order: long, word: string>")
    return met.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("near").alias("near"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form) without circles: where following the forms ends. Ways double in each round."""
    at = links.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = at.join(further, "root", "left").checkpoint()
        if not step.where("next is not null").limit(1).count():
            return at
        at = step.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_n: int = MIN_N, modulus: int = MODULUS, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every distinct word with min_chars letters and min_n occurrences or more.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case; where the CRC-32 of `<id>:<run>` is divisible by
    modulus, the run loses the letter at that number modulo its length. n_near counts words one edit away; form is the
    commonest of them, if it occurs ratio times as often or more, else null; root is where the forms lead. Ties go to the
    smallest word by code points. A null text has no words, a null id is hashed as an empty one, repeated rows count each
    time. min_chars is 2 at least. Other columns are ignored. An empty table gives an empty result.
    """
    prepared(docs.sparkSession)
    vocabulary = counted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), modulus, min_chars, min_n).checkpoint()
    found = near_words(vocabulary)
    near_n = -F.col("near.order")
    common = near_n >= ratio * F.col("n")
    found = found.select("word", F.when(common, F.col("near.word")).alias("form"), "n", "n_near", F.when(common, near_n).alias("form_n")).checkpoint()
    led = roots(found.where("form is not null").select("word", "form"))
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(prepared(spark), sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
d AS (SELECT id, w, count(*) AS n, hex(encode(id || ':' || w)) AS x FROM r GROUP BY id, w),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x)::BIGINT, 2), lambda i: 16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM d, crc),
c AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % len(w)) || substr(w, h % len(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM c WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word)::BIGINT + 1)) AS i FROM v)),
longer AS (SELECT DISTINCT cut.word AS a, cut.n AS an, v.word AS b, v.n AS bn FROM cut JOIN v ON cut.rest = v.word),
pairs AS (SELECT a.word AS a, b.word AS b, b.n AS bn FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a, b, bn FROM longer UNION ALL SELECT b, a, an FROM longer),
best AS (SELECT a, count(*) AS n_near, arg_min(b, (-bn, encode(b))) AS b, max(bn) AS bn FROM pairs GROUP BY a),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN bn >= 5 * v.n THEN b END AS form, CASE WHEN bn >= 5 * v.n THEN bn END AS form_n FROM v LEFT JOIN best ON v.word = a),
way AS (SELECT word, word AS at FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON way.at = f.word WHERE f.form IS NOT NULL),
last AS (SELECT way.word, way.at AS root FROM way JOIN f ON way.at = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN last ON f.word = last.word
"""
