"""Every operator on nulls, empty, long, repeated and tied rows, clashing columns and empty tables, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, awkward, frame, near_components, prose, without_repeats
from pyspark.sql import functions as F

from sceneql.llm import op01_language as L1
from sceneql.llm import op02_tiff as L2
from sceneql.llm import op03_toxicity as L3
from sceneql.llm import op04_substrings as L4
from sceneql.llm import op05_mixing as L5
from sceneql.llm import op06_pitman_yor as L6
from sceneql.llm import op07_html as L7
from sceneql.llm import op08_packing as L8
from sceneql.llm import op09_minhash as L9
from sceneql.llm import op10_order_minhash as L10
from sceneql.llm import op11_resampling as L11
from sceneql.llm import op12_variants as L12
from sceneql.llm import op13_exact_top_k as L13

ROWS = awkward()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i in (1, 7))) for i in (1, 3, 7, 8, 9)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda d: L1.identify(d),
    "op2": lambda d: L2.text_media(d),
    "op3": lambda d: L3.toxicity(d, d.sparkSession.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")),
    "op4": lambda d: L4.remove_repeats(d),
    "op5": lambda d: L5.mix(d),
    "op6": lambda d: L6.score_texts(d),
    "op7": lambda d: L7.main_text(d, "doc_id", "source", "text"),
    "op8": lambda d: L8.pack(d),
    "op9": lambda d: L9.near_duplicates(d),
    "op10": lambda d: L10.order_fingerprints(d),
    "op11": lambda d: L11.resample(d, d.sparkSession.createDataFrame([(1, "the of and"), (2, None)], "item_id long, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_all_null_rows(spark, name):
    n = OPERATORS[name](frame(spark, [(None, None, None, None, None)] * 2)).count()
    assert n == 2


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op9", "op10", "op11"])
def test_repeated_rows_are_rows(spark, docs, name):
    once, twice = OPERATORS[name](docs).count(), OPERATORS[name](docs.union(docs)).count()
    assert twice == 2 * once == 2 * len(ROWS)


def test_language(docs):
    got = {r.doc_id: r for r in L1.identify(docs).collect()}
    assert len(got) == len(ROWS)
    for i in (4, 5, 6, 16):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[1].lang_pred == got[2].lang_pred and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_media(docs):
    got = {r.doc_id: r for r in L2.text_media(docs).collect()}
    for i, text, *_ in ROWS:
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[1].feature == got[2].feature and got[1].media_sha256 == got[2].media_sha256


def test_toxicity(docs, labels):
    got = {r.doc_id: r for r in L3.toxicity(docs, labels).collect()}
    assert len(got) == len(ROWS) and got[1].score == got[2].score
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    none = L3.toxicity(docs, labels.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}


@pytest.mark.parametrize("how", [{}, {"common": 1}, {"chunk": 1000}])
def test_substrings(docs, how):
    want = without_repeats(ROWS)
    got = {r.doc_id: r for r in L4.remove_repeats(docs, **how).collect()}
    assert len(got) == len(ROWS)
    for i, (words, kept) in want.items():
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), i


@pytest.mark.parametrize("common", [L4.COMMON, 60])
def test_substrings_of_random_mosaics(spark, common):
    """Also where prefixes are lengthened several times."""
    rng = random.Random(5)
    pieces = [prose(rng, n) for n in (20, 35, 49, 50, 51, 70, 120, 8)]
    rows = [(i, " ".join(rng.choices(pieces, k=rng.randint(0, 6))), None, None, None) for i in range(120)]
    got = {r.doc_id: r for r in L4.remove_repeats(frame(spark, rows), common=common).collect()}
    for i, (words, kept) in without_repeats(rows).items():
        assert (got[i].n_words, got[i].kept_sha256) == (len(words), hashlib.sha256(b" ".join(kept)).hexdigest())


@pytest.mark.parametrize("common", [400_000, 1, 60])
def test_substrings_of_texts_that_share_an_id(spark, common):
    rnd = random.Random(common)
    p, q = prose(rnd, 60), prose(rnd, 80)
    r = prose(rnd, 55)
    rows = [(1, p), (2, p + " more"), (2, q), (2, q + " " + r), (3, r + " tail"), (4, q), (4, p), (4, q), (None, p), (-9, "short"), (-9, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = []
    for i, t in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            piece = w[k : k + 50]
            if i is not None and any(j is not None and j < i and any((u or "").split()[m : m + 50] == piece for m in range(len((u or "").split()) - 49)) for j, u in rows):
                gone[k : k + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    got = [(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in L4.remove_repeats(d, common=common).collect()]
    order = lambda x: tuple((v is None, v) if not isinstance(v, str) else (False, v) for v in x)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_mixing(docs):
    got = L5.mix(docs, range_rows=3).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        t = by.setdefault((r.source_size, r.target), 0)
        by[r.source_size, r.target] = t + r.taken
    assert all(abs(taken - target) < 1 for (_, target), taken in by.items())
    assert abs(sum(t for _, t in by) - 1.5 * sum(r.size for r in got)) < 1e-6 * sum(r.size for r in got)
    again = L5.mix(docs, range_rows=1000).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)


def test_language_model(docs):
    import math

    got = {r.doc_id: r for r in L6.score_texts(docs).collect()}
    from helpers import lowered

    c = Counter()
    for i, text, *_ in ROWS:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*lowered(text), None])
    n, v = sum(c.values()), len(c)
    for i, text, *_ in ROWS:
        w = [*lowered(text), None]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score <= 0 and math.isfinite(r.score)


def test_packing(docs):
    got = L8.pack(docs, block=7).collect()
    from tokenizers import Tokenizer
    import public_tokenizers as P
    import numpy as np

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in ROWS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length])) and 0 < r.length <= 1024
            at += r.length
        assert at == len(ids) and all(r.length == 1024 for r in pieces[i] if r.piece > 0)
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(used) <= -(-total // 1024) + 4


@pytest.mark.parametrize("block", [L9.BLOCK, 40])
def test_near_duplicates(docs, block, monkeypatch):
    monkeypatch.setattr(L9, "BLOCK", block)
    want = near_components(ROWS)
    got = {r.doc_id: r for r in L9.near_duplicates(docs).collect()}
    assert len(got) == len(ROWS)
    for i, (n, root) in want.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, root, root == i), i
    assert got[None].kept and got[None].component_id is None


@pytest.mark.parametrize("block", [L9.BLOCK, 2000])
def test_near_duplicate_families(spark, block, monkeypatch):
    """Copies with more and more changes, about the threshold: links and chains of links are found, others are not."""
    import random

    monkeypatch.setattr(L9, "BLOCK", block)
    rng = random.Random(9)
    rows, i = [], 0
    for family in range(4):
        base = prose(rng, 200).split()
        for k in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 12)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((i * 7 % 1000, " ".join(w), None, None, None))
            i += 1
    want = near_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in L9.near_duplicates(frame(spark, rows)).collect()}
    assert got == want and len({c for _, c in want.values()}) > 4


def test_order_fingerprints(docs):
    got = {r.doc_id: r for r in L10.order_fingerprints(docs).collect()}
    order = sorted(ROWS, key=lambda r: -(10**30) if r[0] is None else r[0], reverse=True)
    for k, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest()), i
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[1].fingerprint == got[2].fingerprint == got[None].fingerprint
    assert got[2].near_next == 1.0 and got[4].fingerprint == ""


def test_order_fingerprints_of_repeated_ids(spark, docs):
    assert L10.order_fingerprints(docs.union(docs)).count() == 2 * len(ROWS)


def crc_bucket(word):
    return zlib.crc32(word) % 10_000


@pytest.mark.parametrize("most", [1, 2])
def test_resampling(spark, docs, most):
    target = [(1, "The of and to in"), (2, None), (3, "was it for was it"), (4, "été à l'école 12")]
    got = L11.resample(docs, spark.createDataFrame(target, "item_id long, text string"), most=most, percent=25).collect()

    def features(text):
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        w = "".join(chr(c) if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else " " for c in raw).encode("latin-1").split()
        return w, Counter(b" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1))

    have, want = Counter(), Counter()
    for r in ROWS:
        for f, n in features(r[1])[1].items():
            have[crc_bucket(f)] += n
    for _, text in target:
        for f, n in features(text)[1].items():
            want[crc_bucket(f)] += n
    S, T = sum(have.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1.0) * (S + 10_000.0) / ((have[b] + 1.0) * (T + 10_000.0)))) for b in have}
    rows = []
    for r in ROWS:
        w, f = features(r[1])
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[crc_bucket(x)] * n for x, n in f.items())
        rows.append((r[0], len(w), sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3]))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: 25 * len(fit) // 100])}
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert rank and sorted([(x.doc_id, x.n_features, x.weight, x.score, x["rank"]) for x in got], key=order) == sorted([(r[0], r[2], r[3], r[4], rank.get(id(r))) for r in rows], key=order)


def test_resampling_towards_a_target(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["ship", "sail", "harbour", "mast"] if i % 5 == 0 else ["bread", "oven", "flour", "yeast"]) for _ in range(40))) for i in range(1000)]
    target = spark.createDataFrame([(1, "ship sail mast harbour " * 50)], "item_id long, text string")
    got = [r.doc_id for r in L11.resample(spark.createDataFrame(rows, "doc_id long, text string"), target).where("rank is not null").collect()]
    assert len(got) == 100 and all(i % 5 == 0 for i in got)


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, modulus=199, chars=6, least=5, ratio=5):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % modulus == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= chars and k >= least}
    out = {}
    for w in n:
        mine = [v for v in n if near(w, v)]
        best = min(mine, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best and n[best] >= ratio * n[w] else None, n[w], len(mine)]
    for w, (form, *_) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (form, root, out[w][1], out[w][2], n[form] if form else None)
    return out


def made_words(seed, alphabet, size):
    """Rows of words with edits of one another, some much commoner than others."""
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(alphabet) for _ in range(rnd.randrange(5, 9))) for _ in range(size)}
    for w in sorted(words):
        for _ in range(rnd.randrange(4)):
            k, c = rnd.randrange(len(w)), rnd.choice(alphabet)
            words.add(rnd.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]]))
    text = [w for w in sorted(words) for _ in range(rnd.choice([3, 5, 6, 30, 200]))]
    rnd.shuffle(text)
    return [(i, "-".join(text[i::40])) for i in range(40)]


@pytest.mark.parametrize("half_rows,task_rows", [(20_000, 60_000), (3, 40)])
@pytest.mark.parametrize("alphabet", ["ab", "abcdeé", "ÀÿaZ÷"])
def test_variants_equal_all_pairs(spark, monkeypatch, alphabet, half_rows, task_rows):
    rows = [*made_words(len(alphabet), alphabet, 60), (None, "letters Letters " * 9), (41, None), (42, "")]
    monkeypatch.setattr(L12.near_words, "__defaults__", (task_rows, half_rows))
    for modulus in (199, 3):
        got = L12.variants(spark.createDataFrame(rows, "doc_id long, text string"), modulus=modulus).collect()
        want = plain_variants(rows, modulus)
        assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
        assert alphabet == "abcdeé" or any(w[0] for w in want.values())


def test_variants_of_awkward_rows(docs):
    got = L12.variants(docs, min_n=1).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_variants(ROWS, least=1)


def test_variants_of_no_rows(spark):
    for rows in ([], [(None, None), (1, "")]):
        assert L12.variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_an_automaton_numbers_its_words():
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 7))) for _ in range(300)})
    found = L12.Automaton(words)
    for k, w in enumerate(words):
        state, number = found.walk(0, 0, w)
        assert number == k and found.final[state]
    assert len(found.edges) < sum(map(len, words)) / 3
    assert L12.Automaton([]).one_error("", "ab") == set()
    for w in words[:60]:
        half = len(w) // 2
        assert {words[k] for k in found.one_error(w[:half], w[half:])} == {v for v in words if v.startswith(w[:half]) and near(v, w)}


VECTORS = [
    (0, [0.5, -0.25, 0.0]), (100, [0.1, 0.1, 0.1]), (200, None), (300, [0.5, None, 0.1]), (400, [float("nan"), 0.0, 0.1]), (500, [float("inf"), 0.0, 0.0]), (600, []), (700, [0.0, 0.0, 0.0]), (-100, [1.0, 2.0]), (1, [0.5, -0.25, 0.0]), (2, [0.5, -0.25, 0.0]),
    (3, [0.4, 0.4, 0.4, 9.0]), (None, [0.5, 0.5, 0.5]), (100, [0.2, 0.2, 0.2]), (100, [0.1, 0.1, 0.1]), (7, [-3.0, 0.001, 0.0]), (8, [1e-9, -1e-9, 0.0]), (900, [3e30, 1.0, 0.0]), (10, [2e30, -1.0, 5.0]),
]


def plain_top_k(rows, k=10):
    fit = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(fit):
        if i is None or i % 100:
            continue
        scores = [(min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), j) for n, (j, w) in enumerate(fit) if n != at]
        best = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(best)]
    return out


@pytest.mark.parametrize("block,scores,k", [(4096, 1 << 22, 10), (2, 6, 3), (1, 1, 30)])
def test_exact_top_k(spark, monkeypatch, block, scores, k):
    monkeypatch.setattr(L13, "SCORES", scores)
    d = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").select("*", *[F.lit("clash").alias(c) for c in ("no", "rank", "score", "own", "query_id", "vector")])
    order = lambda x: tuple((v is None, v or 0) for v in x)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in L13.exact_top_k(d, k, block_queries=block).collect()]
    assert sorted(got, key=order) == sorted(plain_top_k(VECTORS, k), key=order)


def test_exact_top_k_of_random_vectors(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.choice([0.0, rnd.gauss(0, 0.1)]) for _ in range(24)]) for i in range(700)] + [(i, [0.125] * 24) for i in range(700, 1100)]
    got = L13.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)).collect()
    want = plain_top_k([(i, [float(np.float32(x)) for x in v]) for i, v in rows])
    assert sorted(map(tuple, got)) == sorted(want)


def test_exact_top_k_of_no_rows(spark):
    for rows in ([], [(1, [0.5])], [(None, None), (100, None)]):
        assert L13.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0
