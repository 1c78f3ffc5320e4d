"""Shortest ways against a breadth-first walk."""

import time
from collections import deque
from random import Random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.functions.paths import Buckets, by_caller, chains, distances
from graphloom.session import cut


def plain(starts, edges, most=None):
    out = {}
    for p, c, d in edges:
        out.setdefault((p, c), set()).add(d)
    found = set()
    for p, s, n in starts:
        depth, queue = {n: 0}, deque([n])
        while queue:
            x = queue.popleft()
            if depth[x] == most:
                continue
            for y in out.get((p, x), ()):
                if y not in depth:
                    depth[y] = depth[x] + 1
                    queue.append(y)
        found |= {(p, s, y, d) for y, d in depth.items()}
    return sorted(found)


def found(spark, starts, edges, most=None):
    frames = spark.createDataFrame(starts, "project string, start string, node string"), spark.createDataFrame(
        sorted(set(edges)), "project string, caller string, callee string")
    return sorted(map(tuple, distances(*frames, most).collect()))


def cycle(n, project="p"):
    return [(project, f"c{i}", f"c{(i + 1) % n}") for i in range(n)]


def test_a_long_cycle_and_a_chain(spark):
    edges = cycle(10_000) + [("p", f"d{i}", f"d{i + 1}") for i in range(50)] + [("p", "c17", "d0"), ("q", "c0", "c1"), ("q", "lone", "lone")]
    starts = [("p", "S", "c5"), ("p", "d3", "d3"), ("p", "T", "d50"), ("q", "S", "c0"), ("q", "U", "nowhere"), ("q", "V", "lone")]
    assert found(spark, starts, edges) == plain(starts, edges)


def test_a_cycle_that_nothing_leads_into(spark):
    edges = cycle(300) + [("p", "a", "b"), ("p", "b", "c")]
    assert found(spark, [("p", "a", "a")], edges) == plain([("p", "a", "a")], edges)


@pytest.mark.parametrize("most", [None, 0, 1, 3])
def test_random_graphs(spark, most):
    """Sparse, so that chains of different lengths lie side by side and a way with more edges can be shorter."""
    rng = Random(7)
    edges = []
    for p in "pqr":
        for i in range(120):
            for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3])):
                edges.append((p, f"n{i}", f"n{rng.randrange(120)}"))
        for k in range(6):  # detours
            a, b = rng.randrange(120), rng.randrange(120)
            way = [f"n{a}", *[f"{p}x{k}_{j}" for j in range(rng.randrange(1, 9))], f"n{b}"]
            edges += [(p, c, d) for c, d in zip(way, way[1:])]
    starts = [(p, f"s{i}", f"n{i}") for p in "pqr" for i in range(0, 120, 9)]
    assert found(spark, starts, edges, most) == plain(starts, edges, most)


def test_shallow_graphs_take_no_chains_out(spark, monkeypatch):
    """Written edges serve several searches; chains are looked for only where a way is longer than PLAIN."""
    monkeypatch.setattr(paths, "chains", lambda *_: pytest.fail("chains of a shallow graph"))
    edges = [("p", f"a{i}", f"a{i + 1}") for i in range(paths.PLAIN - 1)] + [("p", "a0", "b"), ("q", "a0", "a1")]
    written = by_caller(spark.createDataFrame(edges, "project string, caller string, callee string"))
    for starts in ([("p", "S", "a0"), ("q", "S", "a0")], [("p", "T", "a3"), ("p", "b", "b")]):
        rows = distances(spark.createDataFrame(starts, "project string, start string, node string"), written)
        assert sorted(map(tuple, rows.collect())) == plain(starts, edges)
    written.close()


def test_starts_on_both_sides_of_the_last_plain_round(spark):
    """Long chains that end in themselves, in the start or in what was found before, by ways of other lengths."""
    edges = cycle(40) + [("p", f"d{i}", f"d{i + 1}") for i in range(30)] + [
        ("p", "d30", "d2"), ("p", "d9", "c3"), ("p", "c20", "d0"), ("p", "d0", "d25"), ("p", "c39", "e"), ("p", "e", "c35")]
    starts = [("p", n, n) for n in ("c0", "c8", "c9", "c31", "d0", "d1", "d8", "d30", "e")]
    assert found(spark, starts, edges) == plain(starts, edges)


def _shuffle_files(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")


def test_shuffle_files_go_once_a_table_is_written(spark):
    rows = spark.range(1000).select(F.lit("p").alias("project"), F.col("id").cast("string").alias("caller"), F.lit("x").alias("callee"))
    before = _shuffle_files(spark)
    cut(rows.repartition(3, "caller"))
    by_caller(rows).close()
    end = time.time() + 20
    while _shuffle_files(spark) > before and time.time() < end:
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_empty(spark):
    assert found(spark, [], [("p", "a", "b")]) == []
    assert found(spark, [("p", "s", "a")], []) == [("p", "s", "a", 0)]


def test_chains_keep_their_length(spark):
    edges = [("p", "a", "x0"), *[("p", f"x{i}", f"x{i + 1}") for i in range(40)], ("p", "x40", "b"), ("p", "a", "b"), ("p", "b", "a")]
    short, behind = chains(spark.createDataFrame(edges, "project string, caller string, callee string"), spark.createDataFrame([("p", "a")], "project string, node string"))
    assert sorted((r["node"], r["calls"]) for r in behind.collect()) == sorted([(f"x{i}", i + 1) for i in range(41)])
    assert sorted((r["caller"], r["callee"], r["calls"]) for r in short.collect()) == [("a", "b", 1), ("b", "a", 1)]


def test_a_round_moves_only_its_candidates(spark):
    """What is known is read from buckets; the one exchange below the anti-join is that of the new rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = Buckets(spark, ["k"])
        known.add(spark.range(1000).withColumnRenamed("id", "k"), 0)
        new = spark.range(500, 1500).withColumnRenamed("id", "k")
        plan = new.join(known.all(), "k", "left_anti")
        assert plan.count() == 500
        text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert text.count("Exchange hashpartitioning") == 1
        known.add(plan, 1)
        assert known.round(1).count() == 500 and known.all().count() == 1500
        assert known.close().count() == 1500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
