from pyspark.sql import functions as F

from graphloom.operators.dedupe import dedupe_entities, dedupe_relations, infer_relations
from graphloom.operators.extract import extract_code, extract_documents, extract_facts, extract_graph, mention_lookup
from graphloom.sources.tree import decode_content, parse_documents, scan_projects, scan_tree
from helpers import bag, files, graph

PAGE = """# Shop

Uses FastAPI and Redis over https.

## 概述

skipped

## Orders
### Detail
first line
## Empty

## Billing

Charges customers.

- **Cart** - the cart
- **Cart**
`Ledger` – book
`db` - short

- `GET /orders` - list
- **POST /orders** — add
`DELETE /orders/{id}`

```
taskflow stop now
```
```bash
dataflow run all
ls
```
"""

CODE = '''"""Order module.

More."""
import os
from shop.cart import Cart
from . import base

class Order(Cart, Base):
    """An order."""

    def total(self):
        """Sum."""
        return 1

    def _hidden(self):
        return 2

class Plain(ABC):
    pass

class Bare:
    pass
'''


def test_document_rules(spark):
    g = extract_documents(files(spark, {"a.md": PAGE}))
    e = set(bag(g.entities, "name", "type", "description"))
    assert ("Shop", "Document", "文档: a.md") in e
    assert {n for n, t, _ in e if t in ("Framework", "Database", "Protocol")} == {"fastapi", "redis", "http", "https"}
    assert ("/orders", "API", "GET /orders - list") in e and ("/orders", "API", "POST /orders - add") in e
    assert ("/orders/{id}", "API", "DELETE /orders/{id} - ") in e
    assert {(n, d) for n, t, d in e if t == "Command"} == {
        ("dataflow run", "命令: dataflow run all"), ("taskflow stop", "命令: taskflow stop now")}
    modules = {(n, d) for n, t, d in e if t == "Module"}
    assert modules == {
        ("Orders", "first line"), ("Empty", None), ("Billing", "Charges customers."), ("Cart", None), ("Ledger", None)}
    r = set(bag(g.relations, "source", "type", "target"))
    assert ("Shop", "uses", "redis") in r and ("Shop", "contains", "Billing") in r
    assert ("Shop", "documents", "Cart") in r and ("Shop", "contains", "/orders") in r


def test_order_of_rules_within_a_document(spark):
    rows = extract_documents(files(spark, {"a.md": PAGE})).entities.orderBy("ord").select("type").collect()
    kinds = list(dict.fromkeys(r.type for r in rows))
    assert kinds == ["Document", "Framework", "Database", "Protocol", "API", "Command", "Module"]


def test_code_rules(spark):
    g = extract_code(files(spark, {"src/order.py": CODE}))
    assert bag(g.entities, "name", "type", "description") == sorted([
        ("order", "Module", "Order module."), ("Order", "Module", "An order."), ("Plain", "Module", "类: Plain"),
        ("Bare", "Module", "类: Bare"), ("total", "Feature", "Sum.")], key=repr)
    assert bag(g.relations, "source", "type", "target") == sorted([
        ("order", "contains", "Order"), ("order", "contains", "Plain"), ("order", "contains", "Bare"),
        ("Order", "extends", "Cart, Base"), ("order", "depends_on", "shop"), ("order", "depends_on", "Cart"),
        ("order", "depends_on", ""), ("order", "depends_on", "base")], key=repr)
    quiet = extract_code(files(spark, {"src/order.py": CODE}), drop_blank_targets=True)
    assert quiet.relations.where("target = ''").count() == 0


def test_a_text_is_searched_once_for_entities_and_relations(spark):
    plan = extract_facts(files(spark, {"a.md": "# A", "b.py": "x"}))._jdf.queryExecution().analyzed().toString()
    # Three endpoint patterns, two fences, three lists; classes, functions, imports. Lower case once, besides short names.
    assert plan.count("regexp_extract_all(content") == 11
    assert plan.count("lower(content") == 1


def test_files_of_no_kind_are_read_as_code(spark):
    rows = files(spark, {"a.py": "class A(B):\n    pass\n"}).withColumn("kind", F.lit(None).cast("string"))
    assert bag(extract_facts(rows), "side", "name", "source", "type") == sorted(
        [(0, "a", None, "Module"), (0, "A", None, "Module"), (1, None, "a", "contains"), (1, None, "A", "extends")], key=repr)


def test_what_is_asked_of_a_type_groups_that_type_only(spark):
    entities = graph(spark, [("a", "Module"), ("A", "Module"), ("b", "Tool")]).entities
    plan = dedupe_entities(entities).where("type = 'Tool'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter")


def test_long_fence_does_not_overflow(spark):
    text = "```bash\n" + "echo\n" * 40000 + "dataflow go\n```\n"
    g = extract_documents(files(spark, {"a.md": text}), rules=["command"])
    assert [r.name for r in g.entities.collect()] == ["dataflow go"]


def test_dedupe_keeps_first(spark):
    g = graph(spark, [("Foo", "Module", "one"), ("foo", "Module", "two"), ("Bar", "Module")],
              [("A", "uses", "B"), ("a", "uses", "b")])
    assert bag(dedupe_entities(g.entities), "name", "description") == [("Bar", None), ("Foo", "one")]
    assert bag(dedupe_relations(g.relations), "source", "target") == [("A", "B")]


def test_infer(spark):
    g = graph(spark, [("FastAPI", "Framework"), ("PostgreSQL", "Database"), ("Redis", "Database")],
              [("fastapi", "depends_on", "redis")])
    new = infer_relations(g).relations.where("source_file = 'inferred'")
    assert bag(new, "source", "type", "target") == [("FastAPI", "uses", "PostgreSQL")]


def test_extract_graph_across_files(spark):
    g = extract_graph(files(spark, {"a.md": PAGE, "b.md": PAGE.replace("Shop", "shop"), "src/order.py": CODE}))
    assert g.entities.where("lower(name) = 'shop'").select("name", "source_file").collect() == [("Shop", "a.md")]
    assert bag(g.relations.where("source_file = 'inferred'"), "source", "target") == [("fastapi", "redis")]
    assert g.entities.count() == g.entities.select(F.lower("name"), "type").distinct().count()


def test_mention_lookup_token_and_substring(spark):
    docs = parse_documents(files(spark, {"a.md": "# T\nan interesting rest api"}))
    lexicon = spark.createDataFrame([("rest", "Protocol", 0), ("api", "Tool", 1), ("interest", "Tool", 2)],
                                    "term string, type string, pos bigint")
    assert {r.name for r in mention_lookup(docs, lexicon).entities.collect()} == {"rest", "api", "interest"}
    assert {r.name for r in mention_lookup(docs, lexicon, "token").entities.collect()} == {"rest", "api"}


def test_scan_decode_and_titles(spark, folder):
    from pathlib import Path

    for project in ("one", "two", ".hidden"):
        root = Path(folder) / project
        (root / "src").mkdir(parents=True)
        (root / "node_modules").mkdir()
        (root / "read me+1.md").write_bytes("no title\r\n## H\r".encode("utf-8"))
        (root / "src" / "a.py").write_bytes("x = 'é'".encode("latin-1"))
        (root / "src" / "b.js").write_bytes("let x".encode("utf-16"))
        (root / "node_modules" / "c.md").write_text("# hidden")
    tree = scan_tree(spark, f"{folder}/one")
    got = {r.path: r.content for r in tree.collect()}
    assert got == {"read me+1.md": "no title\n## H\n", "src/a.py": "x = 'é'", "src/b.js": "let x"}
    assert [r.path for r in scan_tree(spark, f"{folder}/one", recursive=False).collect()] == ["read me+1.md"]
    docs = parse_documents(tree, "stem").collect()
    assert [(d.title, d.headings) for d in docs] == [("read me+1", ["## H"])]
    assert parse_documents(tree).first().title == "Untitled"
    both = scan_projects(spark, parent=folder)
    assert bag(both.groupBy("project").count(), "project", "count") == [("one", 3), ("two", 3)]
    listed = scan_projects(spark, [f"{folder}/one", f"{folder}/two"])
    assert bag(listed, "project", "path") == bag(both, "project", "path")
    raw = spark.createDataFrame([(bytearray("数".encode("gbk")),)], "b binary")
    assert raw.select(decode_content(F.col("b")).alias("t")).first().t is not None
