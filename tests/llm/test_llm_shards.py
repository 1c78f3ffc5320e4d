"""Jump consistent hashing against published values and a plain loop."""

from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F, types as T

from graphloom.llm import shards

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def plain_jump(key, n):
    shard, following = -1, 0
    key %= 1 << 64
    while following < n:
        shard = following
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        following = int((shard + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return shard


def test_jump_is_the_published_function(spark):
    # Keys, numbers of shards and shards, as published with the function.
    known = [(1, 1, 0), (42, 57, 43), (0xDEAD10CC, 1, 0), (0xDEAD10CC, 666, 361), (256, 1024, 520)]
    for key, n, want in known:
        assert plain_jump(key, n) == want
        assert spark.range(1).select(shards.jump(F.lit(key).cast("long"), n)["shard"]).first()[0] == want


@pytest.mark.parametrize("n", [1, 2, 16, 17, 63, 64, 65, 1000])
def test_jump_of_many_keys(spark, n):
    keys = [0, 1, -1, (1 << 63) - 1, -(1 << 63), *(crc32(str(i).encode()) * 2654435761 % (1 << 63) for i in range(300))]
    rows = spark.createDataFrame([(k,) for k in keys], "key long").select("key", shards.jump(F.col("key"), n)["shard"].alias("s")).collect()
    assert all(r["s"] == plain_jump(r["key"], n) for r in rows)


def test_jump_of_checked_arithmetic(spark):
    for mode in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", mode)
        try:
            got = spark.range(1000).select("id", shards.jump(F.xxhash64("id"), 16)["shard"].alias("s"), F.xxhash64("id").alias("k")).collect()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
        assert all(r["s"] == plain_jump(r["k"], 16) for r in got)


def test_rows_that_jump_beyond_the_first_steps(spark, monkeypatch):
    monkeypatch.setattr(shards, "_JUMPS", 2)
    got = spark.range(500).select("id", shards.jump(F.col("id"), 300)["shard"].alias("s")).collect()
    assert all(r["s"] == plain_jump(r["id"], 300) for r in got)


def test_growing_moves_rows_only_into_the_new_shard(spark):
    for n in (1, 15, 16, 40):
        small, large = (shards.assign(spark.range(4000), ["id"], m).collect() for m in (n, n + 1))
        after = {r["id"]: r["shard"] for r in large}
        moved = 0
        for r in small:
            assert r["grown_shard"] == after[r["id"]]
            assert r["grown_shard"] in (r["shard"], n)
            moved += r["grown_shard"] != r["shard"]
        assert 0.7 < moved * (n + 1) / 4000 < 1.3
    assert max(Counter(r["shard"] for r in shards.assign(spark.range(16_000), ["id"]).collect()).values()) < 1150


ODD = [(1, "abc"), (2, None), (3, ""), (None, "no id"), (None, None), (4, "é\U0001f600"), (5, "same"), (5, "same"), (5, "other"), (7, "long " * 100_000)]


def test_place_odd_rows(spark):
    rows = ODD + [(8, "hot")] * 3000 + [(i, f"t{i}") for i in range(100, 1100)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6).selectExpr("*", "'extra' as shard", "1 as slot", "2 as size", "3 as grown_shard")
    got = shards.place(docs).collect()
    want = Counter((d, len((t or "").encode()) + 1, crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, homes = defaultdict(list), defaultdict(set)
    for r in got:
        assert r["law"] == "key" and 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0))
        homes[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(len(x) == 1 for x in homes.values())
    for items in slots.values():
        items.sort()
        assert [s for s, *_ in items] == list(range(len(items)))
        assert [x[1:] for x in items] == sorted(x[1:] for x in items)
    assert [f.dataType.simpleString() for f in shards.place(docs).schema] == ["bigint", "bigint", "bigint", "string", "int", "bigint", "int"]


def test_place_empty(spark):
    assert shards.place(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bad_number_of_shards(spark):
    with pytest.raises(ValueError):
        shards.jump(F.lit(1), 0)


def test_no_python_in_the_plan(spark):
    plan = shards.place(spark.createDataFrame(ODD, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_write(spark, folder):
    rows = spark.createDataFrame(ODD, SCHEMA)
    shards.write(rows, folder + "/out", ["doc_id"])
    back = spark.read.parquet(folder + "/out")
    assert Counter(map(tuple, back.select("doc_id", "text").collect())) == Counter(ODD)
    want = {(r["doc_id"], r["shard"]) for r in shards.assign(rows, ["doc_id"]).collect()}
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == want
