"""Joins on keys of which one holds most rows."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions.skew import split_join
from graphloom.operators.dedupe import infer_relations
from graphloom.session import prepare
from helpers import bag, graph, join


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_is_a_join(spark, how):
    large = spark.createDataFrame([("hot", i) for i in range(400)] + [(f"k{i % 30}", i) for i in range(200)] + [(None, 1), ("alone", 2)], "k string, v int")
    small = spark.createDataFrame([("hot", "a"), ("hot", "b"), *[(f"k{i}", "c") for i in range(20)], ("other", "d"), (None, "e")], "k string, w string")
    assert bag(split_join(large, small, ["k"], how), "k", "v", "w") == bag(large.join(small, "k", how), "k", "v", "w")
    none = large.where("false")
    assert split_join(none, small, ["k"], how).count() == 0


def test_a_hot_key_is_dealt_out(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large, small = spark.range(4000).selectExpr("'hot' as k", "id as v"), spark.createDataFrame([("hot", "a")], "k string, w string")
        rows = split_join(large, small, ["k"]).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
        assert len(rows) == 8 and max(r["n"] for r in rows) < 1200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_inference_in_one_large_project(spark):
    ents = [(f"f{i}", "Framework") for i in range(40)] + [(f"d{i}", "Database") for i in range(300)]
    g = join(graph(spark, ents, [("f1", "calls", "D2")]), graph(spark, [("f", "Framework"), ("d", "Database")], [], "q"))
    found = infer_relations(g).relations.where("type = 'uses'")
    assert found.count() == 40 * 300 - 1 + 1
    assert found.where("project = 'p' and source = 'f1'").count() == 299


def test_tasks_are_measured_before_rows_widen(spark):
    """16 MB of a shuffle a task: rows of keys become texts many times as wide behind it."""
    assert prepare(spark).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_training_operators_keep_the_size_of_tasks(spark):
    common = pytest.importorskip("graphloom.llm.common")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    assert common.prepare(spark).conf.get(key) != "16m"
    assert prepare(spark).conf.get(key) == "16m"
