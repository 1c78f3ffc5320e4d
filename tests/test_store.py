"""The log of a graph against updates of whole graphs."""

import random
from pathlib import Path

import pytest

from graphloom.graph import Graph
from graphloom.operators import incremental
from graphloom.sinks.store import Delta, GraphStore, upsert_delta
from helpers import bag, files, graph, join

MANIFEST = "project string, path string, content_hash string"


def rows(g):
    e = bag(g.entities, "project", "name", "type", "description", "source_file", "ord")
    return e, bag(g.relations, "project", "source", "target", "type", "description", "source_file", "ord")


def test_delta_is_the_upsert(spark):
    old = join(
        graph(spark, [("A", "Module", "1", "x"), ("a", "Module", "2", "y"), ("B", "Module", "3", "x"), ("N", "Tool")], [("A", "uses", "B", "x"), ("B", "uses", "A", "y")]),
        graph(spark, [("A", "Module", "other", "x")], [("A", "uses", "A", "x")], "q"))
    new = graph(spark, [("a", "Module", "new"), ("C", "Module", "c1"), ("b", "Tool", "t"), ("c", "Module", "c2")], [("b", "uses", "a", "z"), ("C", "uses", "a")])
    gone = spark.createDataFrame([("p", "x"), ("r", "x")], "project string, path string")
    for files_gone in (None, gone):
        store = GraphStore(spark, f"{spark.conf.get('spark.checkpoint.dir')}/store-{files_gone is None}")
        store.create(old)
        store.commit(upsert_delta(store.snapshot(), new, files_gone, 3))
        left = old if files_gone is None else incremental.remove_files(old, gone)
        assert rows(store.snapshot()) == rows(incremental.upsert(left, new, generation=3))
        assert rows(store.snapshot(0)) == rows(old)


def listing(rng, names):
    terms = ["redis", "kafka", "docker", "spark", "flask"]
    return {f"{n}.md": f"# {n}\n\n## Part {rng.choice('xyz')}\n\nuses {rng.choice(terms)} and {rng.choice(terms)}" for n in names}


def test_updates_and_a_compaction_equal_whole_updates(spark, folder):
    rng = random.Random(9)
    store, manifest = GraphStore(spark, f"{folder}/s"), spark.createDataFrame([], MANIFEST)
    whole, state = Graph.empty(spark), {}
    for turn, names in enumerate(["abcdef", "abcd", "abdxyz", "yz"]):
        texts = {k: v if k not in state or rng.random() < 0.5 else state[k] for k, v in listing(rng, names).items()}
        state = texts
        now = files(spark, texts).unionByName(files(spark, {"same.md": "# Same\nredis"}, "still"))
        update = incremental.update_store(store, now, manifest)
        generation = store.commits()[-1].generation
        step = incremental.apply_incremental(now, manifest, whole, generation=generation)
        assert rows(update.graph) == rows(step.graph)
        whole, manifest = step.graph, step.manifest
        if turn == 2:
            before = rows(store.snapshot())
            store.compact()
            assert rows(store.snapshot()) == before
            store.vacuum()
            assert not Path(folder, "s", "entities", "generation=1").exists()
    assert [c.base for c in store.commits()] == [True, False, False, False, True, False]


def test_an_update_writes_only_changed_projects(spark, folder):
    store = GraphStore(spark, f"{folder}/s")
    first = files(spark, {"a.md": "# A\nredis"}).unionByName(files(spark, {"b.md": "# B\nkafka"}, "q"))
    update = incremental.update_store(store, first, spark.createDataFrame([], MANIFEST))
    second = files(spark, {"a.md": "# A\nredis"}).unionByName(files(spark, {"b.md": "# B\ndocker"}, "q"))
    incremental.update_store(store, second, update.manifest)
    changed = store.changed(store.commits()[-1].generation)
    assert {r.project for r in changed.entities.collect()} == {r.project for r in changed.relations.collect()} == {"q"}
    third = incremental.update_store(store, second.where("project = 'p'"), incremental.current_manifest(second))
    assert {r.project for r in third.graph.entities.collect()} == {"p"}


def test_a_write_that_broke_off_is_not_seen(spark, folder):
    store = GraphStore(spark, f"{folder}/s")
    assert rows(store.snapshot()) == ([], [])
    g = graph(spark, [("A", "Module")])
    store.create(g)
    g.entities.write.parquet(f"{folder}/s/entities/generation=1/project=p")
    assert store.snapshot().entities.count() == 1
    none = Graph.empty(spark)
    store.commit(Delta(*(x.selectExpr("*", "false as gone") for x in (none.entities, none.relations))))
    assert store.snapshot().entities.count() == 1 and [c.generation for c in store.commits()] == [0, 1]
    with pytest.raises(ValueError):
        store.snapshot(-1)
