"""What op9 builds on the driver, and that its links are found once."""

import random

import pyarrow as pa

from sceneql.llm.common import components
from sceneql.llm.op09_minhash import near_duplicates


def test_components_need_no_equal_reruns(spark):
    def another_tree(batches):
        """Links of 30 groups of 40 nodes: any tree of a group is right, and each run has another one, as blocks arrive in any order."""
        draw = random.SystemRandom()
        for _ in batches:
            links = []
            for g in range(30):
                nodes = draw.sample(range(g * 40, g * 40 + 40), 40)
                links += [(nodes[i], draw.choice(nodes[:i])) for i in range(1, 40)]
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in links], "b": [y for _, y in links]})

    links = spark.range(1).coalesce(1).mapInArrow(another_tree, "a long, b long")
    assert {(r.node, r.component) for r in components(links).collect()} == {(i, i // 40 * 40) for i in range(1200)}


def plans(spark, after):
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [runs.apply(i).physicalPlanDescription() for i in range(runs.size()) if runs.apply(i).executionId() > after]


def test_near_duplicates_broadcast_nothing(spark):
    spark.range(1).count()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    last = max(runs.apply(i).executionId() for i in range(runs.size()))
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words[i % 7 * 20 : i % 7 * 20 + 200], *([f"x{i}"] if i > 6 else [])])) for i in range(40)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 7 for i in range(40)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = plans(spark, last)
    assert len(ran) > 5 and not [x for x in ran if "BroadcastExchange" in x]
