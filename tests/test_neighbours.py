"""Every row's nearest rows, by blocks: the rows of the exact expression over all pairs."""

import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneql.functions import vectors as V
from sceneql.operators import retrieval as R


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_are_the_exact_ones(spark, kind):
    rng = random.Random(9)
    nan, inf = float("nan"), float("inf")
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(60)]
    odd = [[0.0] * 5, [0.0] * 5, [1.0, None, 0.0, 0.0, 1.0], [nan] * 5, [inf, 1.0, 0.0, 0.0, 0.0], [1e-7, 0.0, 0.0, 0.0, 0.0], [-1e-6] * 5, [1.0, 2.0], [2.0, 4.0], [], None]
    rows = [(i if i != 7 else None, v) for i, v in enumerate([*base, *base[:20], *base[:5] * 4, *odd])] + [(3, base[40]), (4, base[4])]
    v = spark.createDataFrame(rows, f"i long, v array<{kind}>").repartition(3)
    pairs = v.where("size(v) > 0").select("i", F.col("v").alias("qv")).crossJoin(v.select(F.col("i").alias("j"), "v")).where("size(v) = size(qv)")
    w = Window.partitionBy("i").orderBy(F.desc("s"), "j")
    want = pairs.withColumn("s", V.cosine("v", "qv", -1.0)).withColumn("r", F.row_number().over(w)).where("r <= 4").select("i", "j", "s", "r")
    want = sorted(map(str, want.collect()))
    for block, part in ((1 << 18, 1 << 23), (40, 100), (5, 5000)):
        got = R.neighbours(v, "i", "v", "j", 4, block=block, part=part).select("i", "j", F.col("similarity").alias("s"), F.col("rank").alias("r"))
        assert sorted(map(str, got.collect())) == want
    assert R.neighbours(v.where("false"), "i", "v", "j", 4).count() == 0


def test_every_row_is_a_query(spark):
    from sceneql.plans import registry

    d = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select count(*) from '{d}/embeddings.parquet'").fetchall()[0][0]
    got = registry.queries()["sim_7_cosine_top_k"](spark, d).groupBy("kf_id").count().collect()
    assert len(got) == rows and {r["count"] for r in got} == {10}
