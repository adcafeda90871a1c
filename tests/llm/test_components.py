import random

import numpy as np

from gridframe.llm.components import components, stars


def least(edges):
    at = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if at[a] != at[b]:
                at[a] = at[b] = min(at[a], at[b])
                changed = True
    return {k: v for k, v in at.items() if k != v}


def graph(seed):
    rnd = random.Random(seed)
    names = rnd.sample(range(-(10**12), 10**12), 400)
    edges = [(names[rnd.randrange(60)], names[rnd.randrange(60, 120)]) for _ in range(40)]  # trees and loops
    edges += list(zip(names[120:200], names[121:201], strict=True))  # a chain in random order
    edges += [(names[300], x) for x in names[301:]] + [(names[5], names[5])]  # a crowd and a loop
    rnd.shuffle(edges)
    return edges + edges[:20] + [(b, a) for a, b in edges[:20]]


def test_stars_reach_the_least_node():
    for seed in range(20):
        edges = graph(seed)
        u, v = stars(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
        assert dict(zip(u.tolist(), v.tolist(), strict=True)) == least(edges)


def test_blocks_and_rounds_give_the_same_components(spark):
    edges = graph(7)
    frame = spark.createDataFrame(edges, "u long, v long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        for block in (10, 10**6):
            got = components(frame, block).collect()
            assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["component"] for r in got} == least(edges)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert components(frame.limit(0)).collect() == []


def test_a_small_graph_takes_few_tasks(spark):
    """Rounds over all partitions of a shuffle took thousands of tasks for a few hundred edges."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context = spark.sparkContext
    try:
        context.setJobGroup("components", "")
        got = components(spark.createDataFrame(graph(3), "u long, v long")).collect()
        told = context.statusTracker()
        stages = {s for j in told.getJobIdsForGroup("components") for s in told.getJobInfo(j).stageIds}
        tasks = sum(x.numCompletedTasks for s in stages if (x := told.getStageInfo(s)))
        assert got and 0 < tasks < 200
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
