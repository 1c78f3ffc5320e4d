import random
import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from graphloom.operators import incremental
from graphloom.operators.dedupe import dedupe_entities
from graphloom.operators.extract import extract_graph
from graphloom.sinks.tables import write_graph, write_manifest
from graphloom.sources.graphs import read_graph, read_manifest
from graphloom.graph import Graph
from graphloom.streaming import changes
from helpers import bag, files, graph

MANIFEST = "project string, path string, content_hash string"


def test_detect_changes(spark):
    now = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", "3")], MANIFEST)
    before = spark.createDataFrame([("p", "a", "1"), ("p", "b", "x"), ("p", "d", "4")], MANIFEST)
    found = incremental.detect_changes(now, before)
    assert bag(found, "path", "change_type") == [("b", "modified"), ("c", "added"), ("d", "deleted")]
    assert bag(incremental.update_manifest(before, now, found), "path", "content_hash") == bag(now, "path", "content_hash")
    assert incremental.detect_changes(now, now).count() == 0


def test_remove_files_keeps_rows_without_source(spark):
    g = graph(spark, [("a", "Module", None, "x"), ("b", "Module", None, None), ("c", "Module", None, "y")], [("a", "uses", "b", "x")])
    left = incremental.remove_files(g, spark.createDataFrame([("p", "x")], "project string, path string"))
    assert bag(left.entities, "name") == [("b",), ("c",)] and left.relations.count() == 0


def test_upsert_replaces_in_place_and_appends(spark):
    old = graph(spark, [("A", "Module", "1"), ("a", "Module", "2"), ("B", "Module", "3")], [("A", "uses", "B")])
    new = graph(spark, [("a", "Module", "new"), ("C", "Module", "c1"), ("b", "Tool", "t"), ("c", "Module", "c2")], [("a", "uses", "b")])
    out = incremental.upsert(old, new, generation=3)
    rows = [(r.name, r.description, r.ord.gen) for r in out.entities.orderBy("ord").collect()]
    # Of two old rows with one lower-cased key the last is replaced; of two new ones the last is kept.
    assert rows == [("A", "1", 0), ("a", "new", 0), ("B", "3", 0), ("c", "c2", 3), ("b", "t", 3)]
    assert bag(out.relations, "source", "target") == [("a", "b")]
    again = incremental.upsert(out, new, generation=4)
    assert bag(again.entities, "name", "description") == bag(out.entities, "name", "description")


def test_apply_incremental(spark):
    first = files(spark, {"a.md": "# A\nuses redis", "b.md": "# B\nuses kafka"})
    none = spark.createDataFrame([], MANIFEST)
    start = incremental.apply_incremental(first, none, Graph.empty(spark))
    assert bag(start.changes, "path", "change_type") == [("a.md", "added"), ("b.md", "added")]
    full = extract_graph(first, infer=False)
    assert bag(start.graph.entities, "name", "type") == bag(full.entities, "name", "type")
    second = files(spark, {"a.md": "# A\nuses docker", "c.md": "# C"})
    step = incremental.apply_incremental(second, start.manifest, start.graph, generation=2)
    assert bag(step.changes, "path", "change_type") == [("a.md", "modified"), ("b.md", "deleted"), ("c.md", "added")]
    # What vanished from a modified file stays, unless asked otherwise.
    assert {r.name for r in step.graph.entities.collect()} == {"A", "redis", "docker", "C"}
    purged = incremental.apply_incremental(second, start.manifest, start.graph, generation=2, purge_modified=True)
    assert {r.name for r in purged.graph.entities.collect()} == {"A", "docker", "C"}
    still = incremental.apply_incremental(second, step.manifest, step.graph, generation=3)
    assert still.changes.count() == 0 and bag(still.graph.entities, "name") == bag(step.graph.entities, "name")


def test_watch_filter(spark):
    paths = ["a.py", "x/.git/a.py", "b.txt", "venv/c.md", "src/d.yaml", "environment/e.json", "f.pyc"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert bag(df.where(changes.watch_filter(F.col("path"))), "path") == [("a.py",), ("environment/e.json",), ("src/d.yaml",)]


def greedy(times, gap):
    out, last = [], None
    for t in sorted(times):
        if last is None or t - last >= gap:
            out.append(t)
            last = t
    return out


def test_debounce_equals_greedy(spark, monkeypatch):
    monkeypatch.setattr(changes, "BLOCK_GAPS", 3)
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    # One key with dense runs and long pauses holds most rows.
    offsets = {"hot": np.cumsum([rng.choice([0, 1, 2, 3, 50]) for _ in range(3000)]).tolist(),
               "cold": [0, 5, 9, 10, 11, 100], "once": [7]}
    rows = [(k, start + timedelta(seconds=int(s))) for k, v in offsets.items() for s in v]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "path string, ts timestamp_ntz")
    got = changes.debounce(df, ["path"], 10.0).collect()
    for key, times in offsets.items():
        kept = sorted(int((r.ts - start).total_seconds()) for r in got if r.path == key)
        assert kept == greedy(times, 10)


def drain(stream, folder, name):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint-{name}").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def feed(spark, folder, schema, batches):
    """A file stream that takes one file per micro-batch, oldest first."""
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
        os.listdir(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_streamed_changes(spark, folder):
    schema = "project string, path string, content_hash string, ts timestamp_ntz"
    t = [datetime(2024, 1, 1, 0, 0, s) for s in range(4)]
    batches = [
        [("p", "a", "1", t[0]), ("p", "b", "1", t[0])], [("p", "a", "1", t[1]), ("p", "b", "2", t[1])],
        [("p", "a", None, t[2]), ("p", "b", "2", t[2])], [("p", "a", "3", t[3])],
    ]
    got = drain(changes.watch_changes(feed(spark, folder, schema, batches)), folder, "seen_changes")
    assert bag(got, "path", "change_type", "ts") == sorted([
        ("a", "created", t[0]), ("b", "created", t[0]), ("b", "modified", t[1]), ("a", "deleted", t[2]), ("a", "created", t[3])], key=repr)


def test_streamed_debounce_equals_batch(spark, folder):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    times = np.cumsum([rng.choice([1, 2, 3, 15]) for _ in range(120)]).tolist()
    rows = [(rng.choice("ab"), start + timedelta(seconds=int(s))) for s in times]
    schema = "path string, ts timestamp_ntz"
    stream = feed(spark, folder, schema, [rows[i:i + 40] for i in range(0, 120, 40)])
    got = drain(changes.debounce_stream(stream, ["path"], 10.0), folder, "debounced")
    want = changes.debounce(spark.createDataFrame(rows, schema), ["path"], 10.0)
    assert bag(got, "path", "ts") == bag(want, "path", "ts")


def test_late_debounce_equals_batch(spark, folder):
    """Shuffled arrival within the delay; a last event far ahead moves the watermark over all others."""
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    times = np.cumsum([rng.choice([0, 1, 2, 3, 15, 900]) for _ in range(300)]).tolist()
    rows = [(rng.choice(["hot", "hot", "a", None]), start + timedelta(seconds=int(s)), i) for i, s in enumerate(times)]
    arrival = sorted(rows, key=lambda r: (r[1] - start).total_seconds() + rng.random() * 3000)
    schema = "path string, ts timestamp_ntz, n int"
    end = [("end", start + timedelta(days=9), -1)]
    stream = feed(spark, folder, schema, [arrival[i : i + 60] for i in range(0, 300, 60)] + [end, [("end", start + timedelta(days=18), -2)]])
    got = drain(changes.debounce_stream(stream, ["path"], 10.0, "1 hour"), folder, "debounced_late").where("n >= 0")
    want = changes.debounce(spark.createDataFrame(rows, schema), ["path"], 10.0)
    assert bag(got, "path", "ts") == bag(want, "path", "ts")
    assert arrival != rows and got.count() > 50


def test_late_changes(spark, folder):
    """The snapshots of test_streamed_changes, the second batch first."""
    schema = "project string, path string, content_hash string, ts timestamp_ntz"
    t = [datetime(2024, 1, 1, 0, s, 30) for s in range(4)]
    end = [[("p", "end", "1", datetime(2024, 1, 1 + d))] for d in (1, 2)]
    batches = [
        [("p", "a", "1", t[1]), ("p", "b", "2", t[1])], [("p", "a", "1", t[0]), ("p", "b", "1", t[0]), ("p", "a", "3", t[3])],
        [("p", "a", None, t[2]), ("p", "b", "2", t[2]), ("p", "b", "9", None)], *end,
    ]
    got = drain(changes.watch_changes(feed(spark, folder, schema, batches), "1 hour"), folder, "late_changes").where("path <> 'end'")
    assert bag(got, "path", "change_type", "ts") == sorted([
        ("a", "created", t[0]), ("b", "created", t[0]), ("b", "modified", t[1]), ("a", "deleted", t[2]), ("a", "created", t[3])], key=repr)


def test_rows_later_than_the_delay_are_dropped(spark, folder):
    start = datetime(2024, 1, 1)
    schema = "path string, ts timestamp_ntz"
    later = [timedelta(hours=1), timedelta(hours=9), timedelta(0), timedelta(days=3), timedelta(days=6)]
    batches = [[("a", start + x)] for x in later]
    got = drain(changes.debounce_stream(feed(spark, folder, schema, batches), ["path"], 10.0, "1 minute"), folder, "too_late")
    assert [r.ts for r in got.orderBy("ts").collect()] == [start + timedelta(hours=1), start + timedelta(hours=9), start + timedelta(days=3)]


def test_chunks_keep_runs_whole():
    rng = random.Random(6)
    for _ in range(60):
        keys = sorted(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        frame = pd.DataFrame({"k": keys, "v": range(len(keys))})
        at = sorted(rng.randint(0, len(keys)) for _ in range(rng.randint(0, 9)))
        pieces = [frame.iloc[a:b] for a, b in zip([0, *at], [*at, len(keys)])]
        seen, runs = [], []
        for chunk, bounds in changes._chunks(iter(pieces), ["k"]):
            for a, b in bounds:
                runs.append(chunk["k"].iloc[a])
                assert set(chunk["k"].iloc[a:b]) == {runs[-1]}
            assert [x for a, b in bounds for x in range(a, b)] == list(range(len(chunk)))
            seen += chunk["v"].tolist()
        assert seen == list(range(len(keys))) and runs == sorted(set(keys))


def test_watch_and_update(spark, folder):
    texts = [{"a.md": "# A\nredis"}, {"b.md": "# B\nkafka"}]
    state = {"step": -1}

    def load():
        state["step"] += 1
        step = state["step"]
        if step == 0:
            return files(spark, texts[0]), spark.createDataFrame([], MANIFEST), Graph.empty(spark)
        return files(spark, texts[1]), read_manifest(spark, f"{folder}/m{step - 1}"), read_graph(spark, f"{folder}/g{step - 1}")

    def store(update, batch_id):
        write_graph(update.graph, f"{folder}/g{state['step']}")
        write_manifest(update.manifest, f"{folder}/m{state['step']}")

    schema = "path string"
    stream = feed(spark, folder, schema, [[("a.md",)], [("b.md",)]])
    writer = changes.watch_and_update(stream, load, store, f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination(120)
    assert state["step"] == 1
    assert {r.name for r in read_graph(spark, f"{folder}/g1").entities.collect()} == {"B", "kafka"}
    assert dedupe_entities(read_graph(spark, f"{folder}/g1").entities).count() == 2
