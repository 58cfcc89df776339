"""Sources and sinks: JSON, CSV, TSV, matrices, annotations, media listings, timelines and the document store.

Sinks that replace a table write it aside and put it in place when it is whole (sources/atomic.py).
"""

from __future__ import annotations

import io
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sceneql.functions import text as T
from sceneql.sources.atomic import current, replace
from sceneql.sources.package import ship

SHOTS = "video_id string, scene_id int, start_frame long, end_frame long, start_timecode string, end_timecode string, start_seconds double, end_seconds double, duration_seconds double"


def shared_folder(spark: SparkSession) -> str:
    """The folder for what outlives a stage: the context's checkpoint folder, else the one that spark.checkpoint.dir names;
    one of this machine only where all runs on it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or f"{tempfile.gettempdir()}/sceneql-checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """df with its rows' numbers by `order`, from 1: a range shuffle, and sums of the counts of the ranges before; only these
    counts, a row a range, meet in one task. Rows that are equal in `order` are numbered in any order."""
    spark = df.sparkSession
    shared_folder(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    counts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    d = placed.withColumn("_range", F.shiftright("_at", 33)).join(counts, "_range")
    return d.withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_range", "_before", "_at")


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).json(current(spark, path), multiLine=not lines)


def write_json(df: DataFrame, path: str) -> None:
    """Replace the table at path; a failed job leaves the old one."""
    replace(df.sparkSession, path, df.write.json)


def write_csv(df: DataFrame, path: str) -> None:
    """Replace the table at path, with a header; a failed job leaves the old one."""
    replace(df.sparkSession, path, df.write.option("header", True).csv)


def read_catalog(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """A tab-separated catalog with alias video1, video2, .. by its ordinal column or, without one, by file order of a
    single file. Raises unless ids are unique and as many as expected."""
    d = spark.read.option("sep", "\t").option("header", True).csv(path)
    d = d.withColumn("_n", F.col("ordinal").cast("long") if "ordinal" in d.columns else F.monotonically_increasing_id())
    rank = F.row_number().over(Window.orderBy("_n"))  # one row a video of the catalog
    d = d.withColumn("alias", F.concat(F.lit("video"), rank)).drop("_n")
    n, unique = d.agg(F.count("*"), F.count_distinct("video_id")).first()
    if n != unique or (expected is not None and n != expected):
        raise ValueError(f"{n} rows with {unique} ids, expected {expected}")
    return d


def ratings(lines: DataFrame, scores: str = "scores", users: int | None = 20) -> DataFrame:
    """(video_id, user, frame, rating) of comma-separated ratings, one line a user; raises on values outside 1 to 5, uneven
    lengths or another number of users."""
    d = lines.withColumn("_r", F.transform(F.split(scores, ","), lambda x: F.trim(x).cast("int")))
    w = Window.partitionBy("video_id")
    bad = F.exists("_r", lambda x: x.isNull() | (x < 1) | (x > 5)) | (F.min(F.size("_r")).over(w) != F.max(F.size("_r")).over(w))
    if users is not None:
        bad = bad | (F.count("*").over(w) != users)
    d = d.withColumn("_r", F.when(bad, F.raise_error(F.lit("bad ratings")).cast("array<int>")).otherwise(F.col("_r")))
    d = d.withColumn("user", F.row_number().over(w.orderBy(scores)))
    return d.select("video_id", "user", F.posexplode("_r").alias("frame", "rating"))


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, vec) of .npy files of float matrices."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                m = np.load(io.BytesIO(raw.as_py()), allow_pickle=False).astype(np.float32)
                flat = pa.array(np.ascontiguousarray(m).ravel())
                off = pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(m)), pa.array(np.arange(len(m))), pa.ListArray.from_arrays(off, flat)], names=["path", "row", "vec"])

    return files.mapInArrow(rows, "path string, row long, vec array<float>")


def media_listing(spark: SparkSession, path: str, suffix: str = ".mp4") -> DataFrame:
    """Files by the number in their name; those without one last."""
    return by_number(spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length"))


def by_number(files: DataFrame) -> DataFrame:
    """files with the number at the end of their path's name, in its order; 999 without one."""
    return files.withColumn("number", F.coalesce(F.expr("try_cast(regexp_extract(path, '([0-9]+)[.][^.]*$', 1) as int)"), F.lit(999))).orderBy("number", "path")


def keyframe_names(files: DataFrame, path: str) -> DataFrame:
    """scene_id and kf_index of names like scene_3_kf1, in natural order."""
    return files.withColumn("scene_id", F.regexp_extract(path, r"scene_(\d+)_kf(\d+)", 1).cast("int")).withColumn("kf_index", F.regexp_extract(path, r"scene_(\d+)_kf(\d+)", 2).cast("int")).orderBy("scene_id", "kf_index")


def ingest(new: DataFrame, registry: DataFrame, content: str) -> DataFrame:
    """(sha256, alias) of new contents: the alias known for the hash, else the next free video number."""
    seen = new.select(F.sha2(F.col(content).cast("binary"), 256).alias("sha256")).distinct()
    last = F.coalesce(F.max(F.regexp_extract("alias", r"video(\d+)$", 1).cast("int")), F.lit(0))
    top = registry.agg(last.alias("_top"))
    d = seen.join(registry, "sha256", "left").crossJoin(F.broadcast(top))  # one row
    free = numbered(d.where("alias is null").select("sha256", "_top"), ["sha256"], "_rank")
    return d.where("alias is not null").select("sha256", "alias").unionByName(free.select("sha256", F.concat(F.lit("video"), F.col("_top") + F.col("_rank")).alias("alias")))


def overrides(df: DataFrame) -> DataFrame:
    """Speaker overrides; raises where a start isn't before its end or a value is missing."""
    bad = F.col("start").isNull() | F.col("end").isNull() | F.col("speaker").isNull() | (F.col("start") >= F.col("end"))
    return df.withColumn("start", F.when(bad, F.raise_error(F.lit("bad override")).cast("double")).otherwise(F.col("start")))


def detect_shots(frames: DataFrame, keys: Sequence[str], frame: str, change: str, fps: float, threshold: float = 0.5, least: int = 15) -> DataFrame:
    """(keys, scene_id, start_seconds, end_seconds) from each frame's change score: cuts over the threshold, at least 15
    frames apart; a video without a cut is one shot."""
    from sceneql.operators.intervals import thin

    last = frames.groupBy(*keys).agg((F.max(frame) + 1).cast("double").alias("_end"))
    cuts = thin(frames.where(F.col(change) > threshold).select(*keys, F.col(frame).cast("double").alias("_f"), F.col(frame).cast("bigint").alias("_t")), keys, "_f", float(least), "_t").select(*keys, "_f").where("_f > 0")
    starts = cuts.unionByName(last.select(*keys, F.lit(0.0).alias("_f")))
    w = Window.partitionBy(*keys).orderBy("_f")
    d = starts.withColumn("scene_id", F.row_number().over(w)).withColumn("_n", F.lead("_f").over(w)).join(last, list(keys))
    return d.select(*keys, "scene_id", F.round(F.col("_f") / fps, 3).alias("start_seconds"), F.round(F.coalesce("_n", "_end") / fps, 3).alias("end_seconds"))


def or_whole(shots: DataFrame, videos: DataFrame) -> DataFrame:
    """Shots, and one shot over the whole of each video that has none. videos: video_id, video_duration."""
    without = videos.join(shots.select("video_id").distinct(), "video_id", "left_anti")
    whole = without.select("video_id", F.lit(1).cast(shots.schema["scene_id"].dataType).alias("scene_id"), F.lit(0.0).alias("start_seconds"), F.col("video_duration").alias("end_seconds"), F.lit(True).alias("whole"))
    return shots.withColumn("whole", F.lit(False)).unionByName(whole)


def over_mad(df: DataFrame, keys: Sequence[str], change: str) -> DataFrame:
    """Rows whose change exceeds the median by 5.5 median deviations, within .20 and .72."""
    med = df.groupBy(*keys).agg(F.median(change).alias("_med"))
    mad = df.join(med, list(keys)).groupBy(*keys).agg(F.max("_med").alias("_med"), F.median(F.abs(F.col(change) - F.col("_med"))).alias("_mad"))
    limit = F.least(F.lit(0.72), F.greatest(F.lit(0.20), F.col("_med") + F.greatest(F.lit(0.08), 5.5 * F.col("_mad"))))
    return df.join(mad, list(keys)).where(F.col(change) > limit).drop("_med", "_mad")


def sharpest(shots: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, scene_id, kf_index, frame): the sharpest frame of each window, one window of short shots, three of others.

    frames: keys, frame, t, blur, of every second frame.
    """
    from sceneql.operators.joins import point_join

    # microseconds: the difference of two doubles misses a length of 10 s
    length = F.round(F.col("end_seconds") - F.col("start_seconds"), 6)
    windows = F.when(F.col("_length") < 10, F.array(F.struct(F.lit(0).alias("k"), F.lit(0.30).alias("a"), F.lit(0.70).alias("z")))).otherwise(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(z).alias("z")) for k, (a, z) in enumerate(((0.10, 0.35), (0.35, 0.65), (0.65, 0.90)))]))
    w = shots.select(*keys, "scene_id", "start_seconds", length.alias("_length")).select("*", F.explode(windows).alias("w"))
    w = w.select(*keys, "scene_id", F.col("w.k").alias("kf_index"), (F.col("start_seconds") + F.col("w.a") * F.col("_length")).alias("_a"), (F.col("start_seconds") + F.col("w.z") * F.col("_length")).alias("_z"))
    hits = point_join(frames, w, keys, "t", "_a", "_z", 30.0)
    return hits.groupBy(*keys, "scene_id", "kf_index").agg(F.max_by("frame", F.struct(F.col("blur"), -F.col("frame"))).alias("frame"))


def sample_frames(frames: DataFrame, keys: Sequence[str], interval: float, most: int | None = None) -> DataFrame:
    """The first frame of each interval of time, of several at one time the smallest."""
    d = frames.groupBy(*keys, F.floor(F.col("t") / interval).alias("k")).agg(F.min_by("frame", F.struct("t", "frame")).alias("frame"), F.min("t").alias("t"))
    if most is None:
        return d
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("k"))).where(F.col("_r") <= most).drop("_r")


def trim_graph(start: str, end: str, order: str) -> Column:
    """Aggregate: the filter graph that cuts a video to segments and joins them."""
    part = F.struct(F.col(order), F.col(start).alias("a"), F.col(end).alias("z"))
    parts = F.array_sort(F.collect_list(part))
    cut = F.transform(parts, lambda x, i: F.format_string("[0:v]trim=start=%.3f:end=%.3f,setpts=PTS-STARTPTS[v%d];[0:a]atrim=start=%.3f:end=%.3f,asetpts=PTS-STARTPTS[a%d]", x["a"], x["z"], i, x["a"], x["z"], i))
    join = F.concat(F.array_join(F.transform(parts, lambda x, i: F.format_string("[v%d][a%d]", i, i)), ""), F.format_string("concat=n=%d:v=1:a=1[v][a]", F.size(parts)))
    return F.concat_ws(";", F.array_join(cut, ";"), join)


def timeline_lines(kind: Column, start: str, end: str, label: str) -> Column:
    return F.concat(F.lit("["), T.timecode(start), F.lit(" - "), T.timecode(end), F.lit("] "), kind, F.lit(": "), F.col(label))


def write_store(docs: DataFrame, path: str) -> None:
    """Replace the document store: Parquet by kind, so a search of one kind reads no other; a failed job leaves the old one."""
    replace(docs.sparkSession, path, docs.write.partitionBy("kind").parquet)


def store_matrix(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(id, row, vec): the store's vectors as rows of a matrix, from 0 by id."""
    d = spark.read.parquet(current(spark, path))
    d = d.where(F.col("kind") == kind) if kind else d
    return numbered(d.select("id", "vec"), ["id"], "_n").select("id", (F.col("_n") - 1).alias("row"), "vec")


def search_store(spark: SparkSession, path: str, vector: Sequence[float], k: int, kind: str | None = None) -> DataFrame:
    """The k documents nearest to a vector by cosine; documents of another size are skipped."""
    from sceneql.functions.vectors import cosine

    d = spark.read.parquet(current(spark, path))
    d = d.where(F.col("kind") == kind) if kind else d
    q = F.array(*[F.lit(float(x)) for x in vector])
    return d.where(F.size("vec") == len(vector)).withColumn("similarity", cosine("vec", q, -1.0)).orderBy(F.desc("similarity"), "id").limit(k)
