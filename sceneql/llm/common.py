"""What the operators of this subpackage share: sessions, shared folders, components."""

from __future__ import annotations

import itertools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Send this package to the workers, once an application: they need not have the repository."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as d:
        path = Path(d, f"{top.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in [*sorted(top.rglob("*.py")), top.parent / "corpus_pipeline.py"]:
                z.write(p, p.relative_to(top.parent))
        keep = Path(tempfile.gettempdir(), f"{top.name}-{sc.applicationId}.zip")
        path.replace(keep)
    sc.addPyFile(str(keep))
    _shipped.add(sc.applicationId)


def prepared(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, for texts of very different lengths (a setting of the session from then on: plans read it when
    they run); a checkpoint folder of our own only where none is set and all runs on this machine."""
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "sceneql-checkpoints"))
    return spark


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether crc32 of the id's decimal digits leaves that remainder (a null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, component) for each node, component being its smallest node.

    In each round every node goes to the neighbour, or itself, with the least hash for that round, and the links between
    what is left are drawn anew. The order is another one each time and doesn't depend on the ids', so at least a quarter
    of the nodes are expected to go in a round and the number of rounds grows with the logarithm of the nodes. The node
    with the greatest hash of a component always goes, so that rounds end. Each round is checkpointed; nothing but one
    count a round reaches the driver: the joins are merges, as the driver would build the tables of the others.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = links.where("a <> b").select(F.inline(ways)).distinct().checkpoint()
    at = None
    for k in itertools.count():
        def placed(c: str) -> Column:
            return F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("hash"), F.col(c).alias("to"))

        to = both.groupBy("a").agg(F.least(F.min(placed("b")), placed("a")).getField("to").alias("to"))
        if at is not None and not both.limit(1).count():
            break
        to = to.checkpoint()
        if at is None:
            at = to.select(F.col("a").alias("node"), F.col("to").alias("last"))
        else:
            at = at.join(to.withColumnRenamed("a", "last").hint("merge"), "last", "left").select("node", F.coalesce("to", "last").alias("last")).checkpoint()
        near = both.join(to.withColumnRenamed("to", "x").hint("merge"), "a").select("x", "b")
        far = near.join(to.select(F.col("a").alias("b"), F.col("to").alias("y")).hint("merge"), "b")
        both = far.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().checkpoint()
    least = at.groupBy("last").agg(F.min("node").alias("component"))
    return at.join(least.hint("merge"), "last").select("node", "component")
