"""Stages of the pipeline: columns, decisions against brute force, and the whole run."""

import random
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline as P
import pytest
from helpers import SCHEMA, awkward, frame, near_components, prose, without_repeats
from pyspark.sql import functions as F

ROWS = awkward(3)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    frame(spark, ROWS, clashes=False).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_are_the_named_ones():
    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash", "substrings", "mixing", "packing"] and P.ORACLE_SQL is None


@pytest.mark.parametrize("k", range(4))
def test_columns_and_empty_tables(spark, sf_dir, k):
    out = P.STAGES[k][1](spark, frame(spark, ROWS), sf_dir)
    assert out.columns == P.COLUMNS and [f.dataType for f in out.schema] == [f.dataType for f in spark.createDataFrame([], SCHEMA).schema]
    assert P.STAGES[k][1](spark, spark.createDataFrame([], SCHEMA), sf_dir).count() == 0


def test_toxic_documents_go(spark, sf_dir):
    from sceneql.llm.op03_toxicity import toxicity

    d = frame(spark, ROWS, clashes=False)
    bad = {r.doc_id for r in toxicity(d, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    got = P.drop_toxic(spark, d, sf_dir).collect()
    assert {tuple(r) for r in got} == {r for r in ROWS if r[0] not in bad}


def test_one_of_each_group_stays(spark, sf_dir):
    want = {i for i, (_, root) in near_components(ROWS).items() if i == root} | {None}
    got = P.drop_near_duplicates(spark, frame(spark, ROWS + ROWS[:3]), sf_dir).collect()
    assert Counter(r.doc_id for r in got) == Counter(want)
    assert {tuple(r) for r in got} <= set(ROWS)


def test_rows_without_ids_or_with_shared_ones_stay(spark, sf_dir):
    """Only rows with a non-null id and an equal text are repeats, in every stage that joins."""
    rng = random.Random(11)
    texts = [prose(rng, n) for n in (70, 70, 60, 80, 90, 55)]
    a, b, c, d, e, f = texts
    rows = [(None, a), (None, b), (None, a), (None, None), (5, c), (5, c), (5, d), (5, None), (9, c), (9, e + " " + d), (3, f), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    want = Counter(rows) - Counter([(5, c), (9, c)])
    got = P.drop_near_duplicates(spark, docs, sf_dir)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    left = P.drop_passages(spark, got, sf_dir).checkpoint()
    assert Counter((r.doc_id, r.text) for r in left.collect()) == want - Counter([(9, e + " " + d)]) + Counter([(9, e)])
    words = sum(len((r.text or "").split()) for r in left.collect())
    assert sum(len(r.text.split()) for r in P.mix_sources(spark, left, sf_dir).collect()) == int(1.5 * words)


def test_passages_go_once(spark, sf_dir):
    got = {r.doc_id: r for r in P.drop_passages(spark, frame(spark, ROWS, clashes=False), sf_dir).collect()}
    rows = {r[0]: r for r in ROWS}
    for i, (words, kept) in without_repeats(ROWS).items():
        if words and not kept:
            assert i not in got
        elif len(kept) == len(words):
            assert tuple(got[i]) == rows[i]
        else:
            assert got[i].text == b" ".join(kept).decode() and got[i].n_chars == len(got[i].text)


def test_the_mix_takes_its_words(spark, sf_dir):
    from sceneql.llm.op05_mixing import mix

    d = frame(spark, [r for r in ROWS if r[0] is None or r[0] != 15], clashes=False)
    want = {r.doc_id: r.taken for r in mix(d).collect() if r.taken}
    got = Counter()
    for r in P.mix_sources(spark, d, sf_dir).collect():
        got[r.doc_id] += len((r.text or "").encode().split())
    assert got == want


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    rows = out.collect()
    assert rows and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert max(Counter({r.sequence_id: 0 for r in rows}).values()) == 0
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_the_rest_works_without_this_subpackage(tmp_path):
    top = Path(P.__file__).resolve().parent
    shutil.copytree(top, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not any(k.startswith('op') or k == 'pipeline' for k in n); assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)


def test_errors_inside_the_subpackage_show(tmp_path):
    top = Path(P.__file__).resolve().parent
    shutil.copytree(top, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (tmp_path / "repo/sceneql/llm/op09_minhash.py").write_text("import no_such_module\n")
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path / "repo", capture_output=True)
    assert got.returncode and b"no_such_module" in got.stderr


def test_sums_of_stages_are_whole(spark, sf_dir):
    """Nothing but the stages' decisions drops rows."""
    d = frame(spark, ROWS, clashes=False)
    packed = P.pack_sequences(spark, d, sf_dir)
    assert packed.select("doc_id").distinct().count() == len(ROWS) == d.agg(F.count("*")).first()[0]
