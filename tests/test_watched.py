"""A tree as a stream, against scans of the whole tree."""

import os
import shutil
import time
from pathlib import Path

import pyarrow as pa

from graphloom.graph import Graph
from graphloom.operators import incremental
from graphloom.sinks.store import GraphStore
from graphloom.sources import watched
from graphloom.sources.tree import scan_tree
from graphloom.sources.watched import watch_tree
from graphloom.streaming import changes
from helpers import bag

MANIFEST = "project string, path string, content_hash string"


def put(root, texts, moment):
    for path, text in texts.items():
        file = Path(root, path)
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(text if isinstance(text, bytes) else text.encode())
        os.utime(file, (moment, moment))


STEPS = [
    {"a.md": "# A\nredis", "sub/b.py": 'class B(Base):\n    """Doc"""\n', "node_modules/x.md": "# no", "c.txt": "no", "latin.md": "# Café".encode("latin-1"),
     "wide.md": "# W\r\nkafka".encode("utf-16")},
    {"a.md": "# A\ndocker and redis", "new/d.md": "# D\nredis"},
    {"sub/b.py": "def f():\n    return 1\n"},
]


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination(120)


def test_a_tree_as_it_changes(spark, folder):
    root, now = f"{folder}/tree", int(time.time()) - 1000
    os.makedirs(root)
    seen = f"{folder}/seen"

    def drain():
        stream = watch_tree(spark, root, f"{folder}/listings", project="p", files_per_task=2)
        run(changes.watch_changes(stream.select("project", "path", "content_hash", "ts")).writeStream.format("parquet").option(
            "checkpointLocation", f"{folder}/state").option("path", seen))

    drain()
    want = []
    for i, texts in enumerate(STEPS):
        put(root, texts, now + i)
        if i == 1:
            os.remove(f"{root}/latin.md")
        drain()
        want += [[("a.md", "created"), ("latin.md", "created"), ("sub/b.py", "created"), ("wide.md", "created")],
                 [("a.md", "modified"), ("latin.md", "deleted"), ("new/d.md", "created")], [("sub/b.py", "modified")]][i]
        assert bag(spark.read.schema("path string, change_type string").parquet(seen), "path", "change_type") == sorted(want, key=repr)
    drain()
    assert spark.read.schema("path string").parquet(seen).count() == len(want)


def test_a_store_kept_up_with_a_tree(spark, folder):
    root, now = f"{folder}/tree", int(time.time()) - 1000
    os.makedirs(root)
    store = GraphStore(spark, f"{folder}/store")
    whole, manifest = Graph.empty(spark), spark.createDataFrame([], MANIFEST)
    for i, texts in enumerate(STEPS):
        put(root, texts, now + i)
        if i == 1:
            os.remove(f"{root}/latin.md")
        stream = watch_tree(spark, root, f"{folder}/listings", project="p")
        run(changes.update_from_tree(stream, store, f"{folder}/state"))
        files = scan_tree(spark, root, project="p")
        step = incremental.apply_incremental(files, manifest, whole, generation=store.commits()[-1].generation)
        whole, manifest = step.graph, step.manifest
        got = store.snapshot()
        assert bag(got.entities, "name", "type", "description", "source_file", "ord") == bag(whole.entities, "name", "type", "description", "source_file", "ord")
        assert bag(got.relations, "source", "target", "type", "ord") == bag(whole.relations, "source", "target", "type", "ord")
    # A stream whose state is lost begins anew and ends at the same graph.
    again = GraphStore(spark, f"{folder}/again")
    run(changes.update_from_tree(watch_tree(spark, root, f"{folder}/listings2", project="p"), again, f"{folder}/state2"))
    run(changes.update_from_tree(watch_tree(spark, root, f"{folder}/listings3", project="p"), again, f"{folder}/state3"))
    files = scan_tree(spark, root, project="p")
    full = incremental.apply_incremental(files, spark.createDataFrame([], MANIFEST), Graph.empty(spark), generation=1).graph
    assert bag(again.snapshot().entities, "name", "type", "source_file") == bag(full.entities, "name", "type", "source_file")
    shutil.rmtree(root)
    run(changes.update_from_tree(watch_tree(spark, root, f"{folder}/listings3", project="p"), again, f"{folder}/state3"))
    assert again.snapshot().entities.count() == 0


def test_tasks_and_batches_are_measured_in_bytes(folder, monkeypatch):
    monkeypatch.setattr(watched, "BYTES_PER_TASK", 1000)
    monkeypatch.setattr(watched, "BYTES_PER_BATCH", 300)
    sizes = [200, 200, 200, 200, 5000, 200, 0, 200]
    put(f"{folder}/tree", {f"f{i}.md": chr(97 + i) * size for i, size in enumerate(sizes)}, int(time.time()) - 1000)
    reader = watched._TreeReader({
        "path": f"{folder}/tree", "listings": f"{folder}/listings", "project": "p", "extensions": '["md"]', "ignore": "[]", "files_per_task": "256"})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [[p for p, _, _ in part.files] for part in parts] == [["f0.md", "f1.md", "f2.md", "f3.md"], ["f4.md"], ["f5.md", "f6.md", "f7.md"]]
    batches = [batch for part in parts for batch in reader.read(part)]
    assert [batch.num_rows for batch in batches] == [1, 1, 1, 1, 1, 2, 1]
    table = pa.Table.from_batches(batches)
    assert [len(text) for text in table.column("content").to_pylist()] == sizes
    assert [batch.num_rows for batch in reader.read(watched._Files([("gone.md", 0, True)]))] == [0]
    assert next(reader.read(watched._Files([("f0.md", 5, False)]))).to_pylist()[0]["content"] is None
