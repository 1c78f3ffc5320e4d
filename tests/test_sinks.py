import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.operators import callflow, plugins, responses, views
from graphloom.sinks import lines as sinks
from graphloom.sinks import tables
from graphloom.sources.graphs import read_graph, read_manifest
from graphloom.sources.objects import read_elements
from helpers import bag, files, graph, join


def two(spark):
    return join(
        graph(spark, [("A'b", "Module", 'say "hi"', "a.md"), ("B", "Tool")], [("A'b", "uses", "B", "a.md")], "p"),
        graph(spark, [("C", "API", "x,y")], project="q"),
    )


def text(folder, project):
    """Parts of a project in reading order."""
    parts = sorted(Path(folder, f"project={project}").glob("part-*"))
    return "".join(p.read_text() for p in parts)


def test_parquet_round_trip(spark, folder):
    g = two(spark)
    tables.write_graph(g, f"{folder}/g")
    back = read_graph(spark, f"{folder}/g")
    assert bag(back.entities, "project", "name", "description", "ord") == bag(g.entities, "project", "name", "description", "ord")
    assert bag(back.relations, "source", "target", "type") == bag(g.relations, "source", "target", "type")
    plan = back.project("p").entities._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project" in plan


def test_json_object_round_trip(spark, folder):
    g = two(spark)
    tables.write_graph(g, f"{folder}/j", "json")
    objects = {p: json.loads(text(f"{folder}/j", p)) for p in ("p", "q")}
    assert [e["name"] for e in objects["p"]["entities"]] == ["A'b", "B"]
    assert objects["p"]["entities"][1] == {"name": "B", "type": "Tool", "description": None, "source_file": None}
    assert objects["q"] == {"entities": [{"name": "C", "type": "API", "description": "x,y", "source_file": None}], "relations": []}
    Path(folder, "in").mkdir()
    for name, value in objects.items():
        Path(folder, "in", f"{name}.graph.json").write_text(json.dumps(value, indent=2))
    back = read_graph(spark, f"{folder}/in", "json")
    assert bag(back.entities, "project", "name", "description") == bag(g.entities, "project", "name", "description")
    assert bag(back.relations, "project", "source") == bag(g.relations, "project", "source")


NASTY = ["plain", 'quote " and } brace', "back\\slash } \\\\", "{[]}", "new\nline }", '\\"}', "数据 }😀", "", "ends with \\", '"', "}" * 50, "a,b]"]


def nasty(spark):
    ents = [(f"n{i} {x}", "Module", x if i % 3 else None, x) for i, x in enumerate(NASTY * 20)]
    rels = [(f"s{i} {x}", "uses", x) for i, x in enumerate(NASTY * 15)]
    return join(graph(spark, ents, rels, "p +%/ 1"), graph(spark, [], rels[:3], "only relations"), graph(spark, ents[:2], [], "01"))


@pytest.mark.parametrize("split", ["64m", "300b"])
def test_json_store_round_trip(spark, folder, split):
    """What write_graph writes, read in one piece and in splits of a few hundred bytes."""
    g = nasty(spark)
    tables.write_graph(g, f"{folder}/j", "json")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        back = read_graph(spark, f"{folder}/j", "json")
        assert bag(back.entities, "project", "name", "type", "description", "source_file", "ord.pos") == bag(
            g.entities, "project", "name", "type", "description", "source_file", "ord.pos")
        assert bag(back.relations, "project", "source", "target", "ord.pos") == bag(g.relations, "project", "source", "target", "ord.pos")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("tail", ["", "\n"])
def test_json_files_in_splits(spark, folder, indent, tail):
    """Single-object files, compact and indented, with other keys, nested values and empty arrays."""
    entities = [{"name": x, "type": "Tool", "description": None, "source_file": x, "extra": {"a": [{"b": "}"}, 1]}} for x in NASTY * 10]
    values = {
        "a b+c": {"meta": {"k": "}", "deep": {"x": {"y": [{}]}}}, "note": "a { [ b", "entities": entities, "other": [{"name": "no"}], "relations": [{"source": "s", "target": "}", "type": "uses"}] * 3},
        "empty": {"entities": [], "relations": []}, "none": {}, "late": {"entities": [], "relations": [{"source": "x", "target": "y", "type": "uses"}]},
    }
    Path(folder, "in").mkdir()
    for name, value in values.items():
        Path(folder, "in", f"{name}.graph.json").write_text(json.dumps(value, indent=indent, ensure_ascii=False) + tail)
    Path(folder, "in", "notes.txt").write_text("not a graph }")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        back = read_graph(spark, f"{folder}/in", "json")
        assert bag(back.entities, "project", "name", "source_file", "ord.pos") == sorted((("a b+c", x, x, i) for i, x in enumerate(NASTY * 10)), key=repr)
        assert bag(back.relations, "project", "source", "target") == [*[("a b+c", "s", "}")] * 3, ("late", "x", "y")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
def test_json_elements_across_chunks(spark, folder, chunk):
    """Chunks of a few bytes up to one for all; only what crosses their edges is shuffled, not the object's text."""
    objects = {"a": [{"n": x, "more": {"b": [x, {"c": "}"}]}} for x in NASTY * 4], "b": [{"n": i} for i in range(3)]}
    Path(folder, "in").mkdir()
    for name, rows in objects.items():
        Path(folder, "in", f"{name}.json").write_text(json.dumps({"first": rows, "k": {"z": 1}, "second": rows[:2]}, ensure_ascii=False))
    unit = F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.json$", 1)
    found = [(r.unit, r.name, r.pos, json.loads(r.element)) for r in read_elements(spark, f"{folder}/in", unit, chunk=chunk).collect()]
    wanted = [(k, name, i, row) for k, rows in objects.items() for name, part in (("first", rows), ("second", rows[:2])) for i, row in enumerate(part)]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


def test_json_texts_are_not_shuffled(spark, folder):
    """Elements of one chunk leave it without an exchange of their texts."""
    Path(folder, "in").mkdir()
    Path(folder, "in", "a.json").write_text(json.dumps({"rows": [{"n": i} for i in range(500)]}))
    parts = read_elements(spark, f"{folder}/in", F.lit("a")).where("name = 'rows'")
    assert parts.count() == 500
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Union" in plan


def read_csv(folder, project):
    rows = []
    for part in sorted(Path(folder, f"project={project}").glob("part-*")):
        rows += list(csv.reader(part.open(newline="")))
    return rows


def test_csv(spark, folder):
    tables.export_csv(two(spark), folder)
    rows = read_csv(f"{folder}/entities", "p")
    assert ["name", "type", "description", "source_file"] in rows and ["A'b", "Module", 'say "hi"', "a.md"] in rows
    assert ["B", "Tool", "", ""] in rows
    tables.export_bulk_csv(two(spark), f"{folder}/bulk")
    assert ["A'b", "Module", 'say "hi"', "a.md", "Entity;Module"] in read_csv(f"{folder}/bulk/nodes", "p")
    assert [":START_ID", ":END_ID", ":TYPE"] in read_csv(f"{folder}/bulk/relationships", "p")
    raw = "".join(p.read_text() for p in Path(folder, "bulk/nodes/project=p").glob("part-*"))
    assert '"A\'b","Module","say ""hi""","a.md","Entity;Module"' in raw


def test_text_sinks_are_in_order(spark, folder):
    g = two(spark)
    sinks.export_cypher(g, f"{folder}/c")
    got = text(f"{folder}/c", "p").splitlines()
    assert got[3].startswith("CREATE INDEX") and got[4].startswith("CREATE INDEX")
    assert got[7] == ("CREATE (n:Module:Entity {name: 'A\\'b', type: 'Module', description: 'say \"hi\"', source_file: 'a.md'});")
    assert got[-1] == "MATCH (a:Entity {name: 'A\\'b'}), (b:Entity {name: 'B'}) CREATE (a)-[r:USES]->(b);"
    sinks.export_markdown(g, f"{folder}/m")
    report = text(f"{folder}/m", "p").splitlines()
    assert report[0] == "# p 知识图谱报告" and "| 实体 | 2 |" in report
    assert report.index("| B | Tool | - | - |") < report.index("## 关系列表") < report.index("| A'b | uses | B |")


def test_long_text_sink_uses_many_parts(spark, folder):
    g = graph(spark, [(f"n{i:05d}", "Module") for i in range(5000)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.export_cypher(g, folder)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list(Path(folder, "project=p").glob("part-*"))) > 2
    names = [line.split("name: '")[1][:6] for line in text(folder, "p").splitlines() if line.startswith("CREATE (")]
    assert names == sorted(names) and len(names) == 5000


def test_flow_and_database_json_and_manifest(spark, folder):
    flows = callflow.analyze_flows(files(spark, {"a.py": '@app.get("/x")\ndef x():\n    return 1\n'}))
    tables.write_flow(flows.endpoint_steps, flows.chain_steps, folder)
    assert spark.read.json(f"{folder}/api_endpoints").first().route == "/x"
    views.write_database_json(two(spark), f"{folder}/db")
    nodes = spark.read.json(f"{folder}/db/nodes")
    assert bag(nodes, "project", "id") == [("p", 0), ("p", 1), ("q", 0)]
    manifest = spark.createDataFrame([("p", "a", "h")], "project string, path string, content_hash string")
    tables.write_manifest(manifest, f"{folder}/m")
    assert bag(read_manifest(spark, f"{folder}/m"), "project", "path", "content_hash") == [("p", "a", "h")]


def test_responses(spark):
    texts = {
        "a": {"entities": [{"name": "A", "type": "Module", "description": "d"}, {"name": "B", "type": "Skill"}, {"type": "Tool"},
                           {"name": "C", "type": "Tool"}],
              "relations": [{"source": "a", "target": "C", "type": "uses"}, {"source": "A", "target": "B", "type": "uses"},
                            {"source": "A", "target": "C", "type": "likes"}]},
        "b": {"entities": [{"name": "a", "type": "Module", "description": "later"}]},
    }
    rows = [("p", k, json.dumps(v)) for k, v in texts.items()] + [("p", "c", "not json"), ("p", "d", "{}")]
    g = responses.parse_responses(spark.createDataFrame(rows, "project string, path string, response string"))
    assert bag(g.entities, "name", "description") == [("A", "d"), ("C", None)]
    assert bag(g.relations, "source", "target", "type") == [("a", "C", "uses")]
    prompt = responses.prompt_requests(files(spark, {"x.md": "y" * 9000, "z.py": "k"})).orderBy("path", "part").collect()
    assert [(r.path, r.part, r.parts) for r in prompt] == [("x.md", 0, 2), ("x.md", 1, 2), ("z.py", 0, 1)]
    assert prompt[0].message == "Analyze this document file (x.md):\n\n" + "y" * 8000
    assert prompt[1].message == "Analyze this document file (x.md):\n\n" + "y" * 1000
    assert prompt[2].message == "Analyze this code file (z.py):\n\nk"


def test_plugins(spark):
    def todo(path, content):
        if "boom" in content:
            raise RuntimeError("bad file")
        return [{"name": w, "type": "Feature"} for w in content.split() if w.isupper()], [
            {"source": path, "target": "TODO", "type": "references"}]

    registry = plugins.Registry()
    registry.register_extractor("todo", ["md", ".PY"], todo)
    registry.register_extractor("other", ["md"], lambda path, content: ([{"name": path, "type": "Document"}], []))
    f = files(spark, {"a.md": "X y", "b.py": "boom", "c.js": "Z", "d.MD": "W"})
    g, outcomes = plugins.extract_with_errors(f, registry)
    assert bag(g.entities, "name", "source_file") == [("W", "d.MD"), ("X", "a.md"), ("a.md", "a.md"), ("d.MD", "d.MD")]
    assert [r.name for r in g.entities.where("source_file = 'a.md'").orderBy("ord").collect()] == ["X", "a.md"]
    assert bag(outcomes, "path", "success", "entities", "relations", "error") == [
        ("a.md", True, 2, 1, None), ("b.py", False, 0, 0, "RuntimeError: bad file"), ("d.MD", True, 2, 1, None)]
    totals = plugins.extraction_totals(outcomes).first()
    assert (totals.total, totals.success, totals.failed, totals.entities) == (3, 2, 1, 4)
    registry.register_renderer("names", lambda graph, prefix="": graph.entities.select("name"))
    registry.register_exporter("count", lambda graph, path: (path, graph.entities.count()))
    assert registry.render("names", g).count() == 4 and registry.export("count", g, "x") == ("x", 4)
    with pytest.raises(KeyError):
        registry.render("unknown", g)
