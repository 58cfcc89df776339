"""Similarity to one document of a key: the rows of the plain joins, with texts dealt in place of their tokens."""

import random

from sceneql.functions import text as T
from sceneql.operators import retrieval as R


def rows(df):
    return sorted((r.c, r.t, round(r.similarity, 9)) for r in df.collect())


def table(spark):
    rng = random.Random(3)
    words = ["ab", "a", "abc", "éa", "日本語", "Straße", "aba", "bab", "zz", "abcab"]
    told = [(c, t, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for c in range(30) for t in range(rng.randint(1, 6))]
    told += [*told[:9], (None, 0, "ab"), (None, 1, "ab"), (3, None, "ab abc"), (4, 2, None), (50, 1, "ab"), (51, 0, "ab"), (52, None, "ab"), (53, 0, "a b"), (53, 1, "zz zz"), (54, 0, ""), (54, 1, "ab")]
    return spark.createDataFrame(told, "c long, t long, x string").repartition(3)


def test_equals_the_joins(spark):
    d = table(spark)
    for most in (3, 2048):
        w = R.tfidf(d, "t", T.char_grams("x"), ["c"], most, False)
        want = rows(R.sparse_similarity(w.where("t is not null"), w.where("t = 0").withColumnRenamed("t", "u"), "t", "u", ["c"]))
        assert len(want) > 50
        for alone in (1 << 20, 60, -1):
            assert rows(R.similar_to(d, "t", "x", T.char_grams, "c", 0, most, alone)) == want
    assert rows(R.similar_to(d.where("false"), "t", "x", T.char_grams, "c", 0, 9)) == []


def test_tokens_stay_in_their_task(spark, tmp_path):
    from sceneql.plans import registry

    table(spark).selectExpr("c conv_id", "t turn", "x text").write.parquet(f"{tmp_path}/conversations.parquet")
    plan = registry.queries()["sim_5_relevance"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan[: plan.index("Generate")]
