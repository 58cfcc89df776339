"""Files, stages, batches and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneql.sources import tables as S
from sceneql.sources.batches import in_halves
from sceneql.sources.manifest import Manifest, config_hash
from sceneql.sources.providers import provider
from sceneql.streaming import sessions


def test_catalog(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("category\tvideo_id\ttitle\nA\tx1\tOne\nB\tx2\tTwo\n")
    got = {r.video_id: r.alias for r in S.read_catalog(spark, str(tmp_path / "c.tsv"), 2).collect()}
    assert got == {"x1": "video1", "x2": "video2"}
    with pytest.raises(ValueError):
        S.read_catalog(spark, str(tmp_path / "c.tsv"), 50)


def test_ratings(spark):
    d = spark.createDataFrame([("v", "1,2,5"), ("v", "3,3,3")], "video_id string, scores string")
    assert S.ratings(d, users=2).count() == 6
    with pytest.raises(Exception):
        S.ratings(spark.createDataFrame([("v", "1,9")], "video_id string, scores string"), users=1).collect()


def test_matrices(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    got = S.read_matrices(spark, str(tmp_path)).orderBy("row").collect()
    assert [r.vec for r in got] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]


def test_media_listing(spark, tmp_path):
    for n in ("video10.mp4", "video2.mp4", "trailer.mp4", "x.txt"):
        (tmp_path / n).write_bytes(b"0")
    assert [r.path.rsplit("/", 1)[1] for r in S.media_listing(spark, str(tmp_path)).collect()] == ["video2.mp4", "video10.mp4", "trailer.mp4"]


def test_ingest_numbers_new_contents(spark):
    known = spark.createDataFrame([(None, "video4")], "sha256 string, alias string")
    got = S.ingest(spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "content binary"), known, "content").collect()
    assert sorted(r.alias for r in got) == ["video5", "video6"]


def test_overrides_are_checked(spark):
    with pytest.raises(Exception):
        S.overrides(spark.createDataFrame([(2.0, 1.0, "A")], "start double, end double, speaker string")).collect()


def test_static_video_is_one_shot(spark):
    f = spark.createDataFrame([(0, i, 0.1) for i in range(50)], "v int, frame int, change double")
    assert [tuple(r) for r in S.detect_shots(f, ["v"], "frame", "change", 25.0).collect()] == [(0, 1, 0.0, 2.0)]


def test_manifest(spark, tmp_path):
    m, made = Manifest(spark, str(tmp_path)), []
    make = lambda: (made.append(1), spark.range(3).toDF("i"))[1]
    _, h = m.run("a", {"k": 1}, make)
    m.run("a", {"k": 1}, make)
    assert len(made) == 1
    m.run("a", {"k": 2}, make)
    assert len(made) == 2 and config_hash({"x": 1}, h) != config_hash({"x": 1})
    with pytest.raises(ZeroDivisionError):
        m.run("b", {}, lambda: 1 / 0)
    assert m.entry("b")["status"] == "failed"


def test_batches_in_halves():
    def call(rows):
        if 3 in rows:
            raise ValueError
        return rows

    assert in_halves([1, 2, 3, 4], call) == ([1, 2, 4], [3])


def test_missing_provider():
    with pytest.raises(LookupError):
        provider("faces")


def test_stream_equals_batch(spark, tmp_path):
    rows = [("v", float(t)) for t in (0.0, 1.0, 2.0, 10.0, 11.0, 500.0)]
    d = spark.createDataFrame(rows, "video_id string, s double").select("video_id", F.timestamp_micros((F.col("s") * 1000000).cast("long")).alias("ts"))
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = sessions.utterance_sessions(stream).writeStream.format("memory").queryName("utterances").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("utterances").collect()}
    want = {tuple(r) for r in sessions.utterance_sessions(d).collect()}
    assert got and got <= want and len(want) == 3


def test_numbers_follow_the_order(spark):
    d = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("_at"))
    got = S.numbered(d.select("k"), ["k"], "n").collect()
    assert len(got) == 5000 and all(r.n == r.k + 1 for r in got)
    assert S.numbered(d.select("k").where("k < 0"), ["k"], "n").count() == 0
    same = S.numbered(spark.range(60).select((F.col("id") % 3).alias("k")), ["k"], "n").collect()
    assert sorted(r.n for r in same) == list(range(1, 61)) and [r.k for r in sorted(same, key=lambda r: r.n)] == [i // 20 for i in range(60)]


def test_contents_get_free_aliases(spark):
    import hashlib

    hashes = sorted(hashlib.sha256(t.encode()).hexdigest() for t in "abc")
    known = spark.createDataFrame([(hashes[1], "video4")], "sha256 string, alias string")
    new = spark.createDataFrame([(t,) for t in "abca"], "text string")
    assert {r.sha256: r.alias for r in S.ingest(new, known, "text").collect()} == {hashes[0]: "video5", hashes[1]: "video4", hashes[2]: "video6"}
    assert S.ingest(new, known.where("false"), "text").count() == 3


def test_stages_report_and_stop(spark):
    from sceneql.sources.batches import Cancelled, run_stages

    seen = []
    assert run_stages(spark, [("a", lambda: 1), ("b", lambda: 2)], lambda *p: seen.append(p)) == [1, 2]
    assert seen == [("a", 1, 2), ("b", 2, 2)]
    with pytest.raises(Cancelled):
        run_stages(spark, [("a", lambda: 1)], cancelled=lambda: True)
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_a_stage_that_is_not_complete_is_not_taken_over(spark, tmp_path):
    a, b = Manifest(spark, str(tmp_path / "a")), Manifest(spark, str(tmp_path / "b"))
    with pytest.raises(RuntimeError):
        a.run("bad", {}, lambda: (_ for _ in ()).throw(RuntimeError("stage")))
    b.adopt(a, ["bad", "never"])
    assert b.entry("bad") is None and b.entry("never") is None


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    import os

    from sceneql.sources import atomic

    good = spark.range(5).selectExpr("id", "'a' as kind", "array(1.0D, double(id)) as vec")
    bad = good.selectExpr("if(id = 3, raise_error('broken'), id) as id", "kind", "vec")
    sinks = {
        "json": (lambda d, p: S.write_json(d.select("id"), p), lambda p: S.read_json(spark, p, "id long", lines=True).count()),
        "csv": (lambda d, p: S.write_csv(d.select("id"), p), lambda p: spark.read.option("header", True).csv(p).count()),
        "store": (S.write_store, lambda p: S.store_matrix(spark, p, "a").count()),
    }
    for name, (write, rows) in sinks.items():
        path = str(tmp_path / "sinks" / name)
        write(good, path)
        with pytest.raises(Exception, match="broken"):
            write(bad, path)
        assert rows(path) == 5
        write(good.limit(2), path)
        assert rows(path) == 2
    assert sorted(os.listdir(tmp_path / "sinks")) == sorted(sinks)
    # cut off between the two renames: the old table is found beside
    os.rename(tmp_path / "sinks/json", tmp_path / "sinks/.json.old")
    assert S.read_json(spark, str(tmp_path / "sinks/json"), "id long", lines=True).count() == 2
    assert atomic.current(spark, str(tmp_path / "nothing")) == str(tmp_path / "nothing")
    m = Manifest(spark, str(tmp_path / "stages"))
    m.run("s", {"v": 1}, lambda: good)
    with pytest.raises(Exception, match="broken"):
        m.run("s", {"v": 2}, lambda: bad)
    assert m.entry("s")["status"] == "failed" and spark.read.parquet(str(tmp_path / "stages/s")).count() == 5
    m.run("s", {"v": 2}, lambda: good.limit(1))
    assert m.entry("s")["status"] == "complete" and spark.read.parquet(str(tmp_path / "stages/s")).count() == 1
