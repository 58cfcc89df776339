"""Small tables with every awkward row, and brute-force versions."""

from __future__ import annotations

import itertools
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as columns of the input.
CLASHES = ["prefix", "start", "n", "hits", "spans", "bands", "bucket", "hub", "rep", "key", "key_a", "range", "named", "size", "before", "taken", "target", "row", "word", "score", "_key", "_text", "piece", "uid", "block", "host", "path", "role", "toxic", "features"]
WORDS = "the of and to in a is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
LONGEST = " ".join(itertools.islice(itertools.cycle(WORDS), 30_000))


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ing", "ed", "er", "", ""]) for _ in range(n))


def awkward(seed: int = 0) -> list[tuple]:
    """Nulls in each column, empty, blank, short, long, repeated, tied and shared texts."""
    rng = random.Random(seed)
    shared = prose(rng, 80)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", len(base)), (2, base, "en", "a", len(base)), (3, " ".join(near), "en", None, None), (4, None, "en", "a", None), (5, "", None, "b", 0), (6, " \t\n ", "en", "b", 4),
        (7, "one", "en", "b", 3), (8, "one two three", "fr", "c", 13), (9, shared + " " + prose(rng, 30), "fr", "a", 5), (10, prose(rng, 40) + " " + shared, "de", "a", 5), (11, LONGEST, "en", "a", len(LONGEST)),
        (12, LONGEST, "en", "c", len(LONGEST)), (13, "été À L'ÉCOLE " * 30, "fr", "b", 3), (14, base.upper(), "en", "a", 1), (15, "x" * 50_000, "en", "a", 1), (None, base, "en", "a", 1), (16, "!!! 123 ???", "en", "c", 9),
        (17, "word " * 300, "en", "c", 9), (18, "word " * 300, "en", "c", 9), (2**62, prose(rng, 60), "es", "a", 1), (-5, prose(rng, 60), "es", "a", 1), (19, "a\x0bb\x0cc d e f", "en", "a", 2), (20, "<|endoftext|> is text", "en", "a", 2),
    ]
    return rows


def frame(spark, rows, clashes: bool = True):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, SCHEMA)
    return d.select("*", *[F.lit("clash").alias(c) for c in CLASHES]) if clashes else d


def lowered(text: str | None) -> list[bytes]:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


def shingle_set(text: str | None) -> frozenset:
    w = lowered(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_components(rows: list[tuple], num: int = 85) -> dict:
    """doc_id -> (set size, smallest id reachable) by comparing all pairs."""
    sets = {r[0]: shingle_set(r[1]) for r in rows if r[0] is not None}
    up = {a: a for a in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        s, t = sets[a], sets[b]
        both = len(s & t)
        if s and t and 100 * both >= num * (len(s) + len(t) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {a: (len(s), find(a)) for a, s in sets.items()}


def without_repeats(rows: list[tuple], window: int = 50) -> dict:
    """doc_id -> (words, kept words) by listing all windows."""
    seen: dict = {}
    for i, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (text or "").encode().split()
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, text, *_ in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if seen[tuple(w[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        out[i] = (w, [x for x, g in zip(w, gone) if not g])
    return out
