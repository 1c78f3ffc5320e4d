"""Lookups, search, answers, diff and edits on small graphs."""

from pyspark.sql import functions as F

from graphloom.operators import answers, diff, lookup, mutate, search, summary, views
from helpers import bag, graph, join

ENTITIES = [
    ("UserService", "Module", "handles users", "a.py"), ("OrderService", "Module", "orders", "b.py"),
    ("Database", "Database", None, "c.md"), ("Redis", "Tool", "cache for service", "c.md"),
    ("FastAPI", "Framework", None, "c.md"), ("README", "Document", "文档: README.md", "README.md"),
    ("database", "Module", "shadow", "d.py"),
]
RELATIONS = [
    ("UserService", "depends_on", "Database"), ("UserService", "uses", "FastAPI"), ("OrderService", "depends_on", "UserService"),
    ("README", "documents", "userservice"), ("UserService", "uses", "Ghost"), ("Redis", "uses", "Redis"),
]


def shop(spark):
    return graph(spark, ENTITIES, RELATIONS)


def names(spark, *wanted):
    return spark.createDataFrame([("p", n) for n in wanted], "project string, name string")


def test_lookups(spark):
    g = shop(spark)
    assert [r.type for r in lookup.find_entity(g, "DATABASE").collect()] == ["Database"]
    assert bag(lookup.find_dependencies(g, "userservice"), "entity") == [("Database",)]
    assert bag(lookup.find_documents(g, "UserService"), "entity") == [("README",)]
    assert bag(lookup.find_related(g, "UserService"), "entity") == [("Database",), ("FastAPI",), ("OrderService",), ("README",)]
    assert lookup.find_relations(g, "Redis").count() == 1
    assert bag(lookup.dependencies_both(g, "UserService"), "role", "other") == [
        ("dependency", "Database"), ("dependency", "FastAPI"), ("dependency", "Ghost"), ("dependent", "OrderService")]
    assert bag(lookup.search_keyword(g, "SERVICE"), "name") == [("OrderService",), ("Redis",), ("UserService",)]
    keywords = spark.createDataFrame([("p", "Service"), ("p", "zzz")], "project string, keyword string")
    assert bag(lookup.search_keywords(g, keywords), "name") == [("OrderService",), ("Redis",), ("UserService",)]
    tree = lookup.dependency_tree(g, "OrderService")
    assert bag(tree, "dependency", "child", "more") == [("UserService", "Database", 0)]
    near = lookup.relations_of(g, names(spark, "Redis", "serserv"))
    assert bag(near, "asked", "direction", "other")[:2] == [("Redis", "in", "Redis"), ("Redis", "out", "Redis")]
    assert near.where("asked = 'serserv'").count() == 5
    assert bag(lookup.list_projects(g), "entities", "relations") == [(7, 6)]
    assert bag(lookup.category(g, "Module", 1), "name", "total") == [("UserService", 3)]
    detail = lookup.entity_detail(g, names(spark, "FastAPI", "README", "nobody"))
    assert bag(detail, "name", "direction", "other") == [("FastAPI", "in", "UserService"), ("README", "out", "userservice")]


def test_dependency_tree(spark):
    g = graph(spark, [(n, "Module") for n in "abcdefghij"], [("a", "depends_on", "b")] + [("b", "depends_on", x) for x in "cdefghi"])
    rows = lookup.dependency_tree(g, "a", children=5).orderBy("child_ord").collect()
    assert [r.child for r in rows] == list("cdefg") and {r.more for r in rows} == {2}
    rows = lookup.dependency_tree(g, "a").orderBy("child_ord").collect()
    assert [r.child for r in rows] == list("cdefghi") and {r.more for r in rows} == {0}


def test_search(spark):
    g = shop(spark)
    assert [r.name for r in search.search(g, "Service").collect()] == ["UserService", "OrderService", "Redis"]
    assert search.search(g, "userservice", case_sensitive=True).count() == 0
    assert [r.name for r in search.search(g, "^User.*", use_regex=True).collect()] == ["UserService"]
    assert "UserService" in [r.name for r in search.search(g, "UsrService", fuzzy=True).collect()]
    assert [r.name for r in search.search(g, "service", entity_types=["Tool"]).collect()] == ["Redis"]
    assert [r.match_field for r in search.search(g, "users", search_fields=["description"]).collect()] == ["description"]
    assert search.search(g, "e", max_results=2).count() == 2
    best = search.search(g, "UserService").first()
    assert best.score == 1.2 and best.match_type == "exact"
    context = search.search_with_context(g, "UserService")
    assert bag(context.groupBy("direction").count(), "direction", "count") == [("in", 2), ("out", 2)]
    assert context.first().related_count == 4


def test_search_per_project(spark):
    both = join(shop(spark), graph(spark, [("Service", "Module"), ("x", "Module")], project="q"),
                graph(spark, [("none", "Module")], project="r"))
    rows = search.search_multi_project(both, "service", max_results=1)
    assert bag(rows, "project", "name") == [("p", "UserService"), ("q", "Service")]


def test_answers(spark):
    g = graph(spark, [("Pipeline", "Module", "moves data"), ("Transform", "Module"), ("Redis", "Database"),
                      ("FastAPI", "Framework"), ("a", "Module")],
              [("Pipeline", "depends_on", "Transform"), ("Pipeline", "uses", "Redis")])
    asked = ["技术栈是什么", "用了哪些数据库", "有哪些模块", "Pipeline依赖什么", "Pipeline是什么", "a 是什么", "redis", "nothing",
             "Transform 依赖什么", "有哪些工具"]
    questions = spark.createDataFrame([("p", i, q) for i, q in enumerate(asked)], "project string, question_id bigint, question string")
    got = {}
    for r in answers.answer(questions, g).orderBy("question_id", "line_no", "ord").collect():
        got.setdefault(asked[r.question_id], []).append(r.line)
    assert got["技术栈是什么"] == ["项目技术栈:", "", "框架:"]
    assert got["用了哪些数据库"] == ["项目使用的数据库:"]
    assert got["有哪些模块"] == ["项目包含以下模块:"]
    lists = [(r.intent, r.line) for r in answers.answer_lists(g).orderBy("intent", "ord").collect()]
    assert lists == [("databases", "  - Redis"), ("modules", "  - Pipeline"), ("modules", "  - Transform"), ("modules", "  - a"), ("tech", "  - FastAPI")]
    assert got["Pipeline依赖什么"] == ["Pipeline 依赖于:", "  - Transform"]
    assert got["Pipeline是什么"] == ["Pipeline 是项目中的 Module。", "描述: moves data", "相关实体: Transform", "相关实体: Redis"]
    assert got["a 是什么"] == [answers.UNKNOWN_ENTITY]  # one letter never links
    assert got["redis"] == ["找到相关实体:", "  - Redis (Database)"]
    assert got["nothing"] == [
        "抱歉，我无法回答这个问题。请尝试更具体的问题，例如:", "  - 有哪些模块?", "  - 技术栈是什么?", "  - 使用了哪些数据库?"]
    assert got["Transform 依赖什么"] == ["Transform 没有发现依赖关系。"]
    assert got["有哪些工具"] == ["项目中没有发现工具信息。"]


def test_summaries(spark):
    g = shop(spark)
    rows = summary.entity_type_summary(g).collect()
    assert (rows[0].type, rows[0]["count"], rows[0].percent) == ("Module", 3, 42.9)
    failures = spark.createDataFrame([("bad", "no folder")], "project string, error string")
    got = bag(summary.batch_summary(g, failures), "project", "entities", "relations", "error", "failed")
    assert got == sorted([("p", 7, 6, None, 0), ("bad", 0, 0, "no folder", 1), (None, 7, 6, None, 1)], key=repr)
    assert summary.stats(g).where("type = 'total'").count() == 2
    assert bag(summary.tech_groups(g), "type", "name") == [("Database", "Database"), ("Framework", "FastAPI"), ("Tool", "Redis")]


def test_diff(spark):
    old = graph(spark, [("UserService", "Module", "a"), ("Database", "Database"), ("FastAPI", "Framework")],
                [("UserService", "depends_on", "Database"), ("UserService", "uses", "FastAPI")])
    new = graph(spark, [("UserService", "Module", "b"), ("Database", "Database"), ("Redis", "Tool")],
                [("UserService", "depends_on", "Database"), ("UserService", "uses", "Redis")])
    assert bag(diff.diff_entities(old, new), "name", "change_type") == [
        ("FastAPI", "deleted"), ("Redis", "added"), ("UserService", "modified")]
    assert bag(diff.diff_relations(old, new), "target", "change_type") == [("FastAPI", "deleted"), ("Redis", "added")]
    stats = diff.diff_stats(old, new).first()
    assert [stats[c] for c in diff.STATS] == [3, 3, 2, 2, 1, 1, 1, 1, 1]
    lines = [r.line for r in diff.diff_report(old, new).orderBy("section", "ord").collect()]
    assert "  实体: +1 -1 ~1" in lines and lines[lines.index("  ~ UserService") + 1] == "    描述: a → b"
    assert "  + UserService --[uses]--> Redis" in lines
    same = [r.line for r in diff.diff_report(old, old).collect()]
    assert "✅ 没有发现差异" in same and diff.diff_entities(old, old).count() == 0


def test_diff_null_is_not_empty_and_last_duplicate_counts(spark):
    old = graph(spark, [("a", "Module", None), ("b", "Module", "x"), ("b", "Module", "y")])
    new = graph(spark, [("a", "Module", ""), ("b", "Module", "y")])
    assert bag(diff.diff_entities(old, new), "name", "change_type") == [("a", "modified")]


def status(edit):
    return {r.request_id: r.status for r in edit.results.collect()}


def test_entity_edits(spark):
    g = shop(spark)
    schema = "project string, request_id bigint, name string, type string, description string, source_file string"
    new = spark.createDataFrame([
        ("p", 1, "Cart", "Module", None, None), ("p", 2, "Redis", "Tool", None, None), ("p", 3, "Cart", "Module", None, None),
        ("p", 4, "X", "Nope", None, None), ("p", 5, "redis", "Tool", None, None)], schema)
    edit = mutate.create_entities(g, new)
    assert status(edit) == {1: 200, 2: 409, 3: 409, 4: 400, 5: 200} and edit.graph.entities.count() == 9
    change = spark.createDataFrame([
        ("p", 1, "Redis", "Database", None, None), ("p", 2, "Redis", None, "fast", None), ("p", 3, "redis", None, "x", None),
        ("p", 4, "Redis", "Nope", "never", None)], schema)
    edit = mutate.update_entities(g, change)
    assert status(edit) == {1: 200, 2: 200, 3: 404, 4: 400}
    assert bag(edit.graph.entities.where("name = 'Redis'"), "type", "description", "source_file") == [("Database", "fast", "c.md")]
    gone = spark.createDataFrame([("p", 1, "UserService"), ("p", 2, "Ghost"), ("p", 3, "UserService")],
                                 "project string, request_id bigint, name string")
    edit = mutate.delete_entities(g, gone)
    assert status(edit) == {1: 200, 2: 404, 3: 404}
    assert bag(edit.graph.relations, "source", "target") == [("README", "userservice"), ("Redis", "Redis")]


def test_relation_edits(spark):
    g = shop(spark)
    schema = "project string, request_id bigint, source string, target string, type string, description string"
    new = spark.createDataFrame([
        ("p", 1, "Redis", "FastAPI", "uses", None), ("p", 2, "Ghost", "Redis", "uses", None), ("p", 3, "Redis", "Ghost", "uses", None),
        ("p", 4, "UserService", "FastAPI", "uses", None), ("p", 5, "Redis", "FastAPI", "nope", None), ("p", 6, "Redis", "FastAPI", "uses", None)], schema)
    edit = mutate.create_relations(g, new)
    assert status(edit) == {1: 200, 2: 404, 3: 404, 4: 409, 5: 400, 6: 409} and edit.graph.relations.count() == 7
    gone = new.where("request_id in (4, 1, 5)").drop("description")
    edit = mutate.delete_relations(g, gone)
    assert status(edit) == {4: 200, 1: 404, 5: 400} and edit.graph.relations.count() == 5


def test_project_edits(spark):
    g = join(shop(spark), graph(spark, [("z", "Module")], project="q"))
    projects = spark.createDataFrame([("p",), ("q",)], "project string")
    made = mutate.create_projects(projects, spark.createDataFrame([(1, "r"), (2, "p"), (3, "r")], "request_id bigint, project string"))
    assert {r.request_id: r.status for r in made.results.collect()} == {1: 200, 2: 409, 3: 409}
    moves = spark.createDataFrame([(1, "p", "q"), (2, "x", "y"), (3, "p", "n")], "request_id bigint, project string, new_name string")
    moved = mutate.rename_projects(projects, g, moves)
    assert {r.request_id: r.status for r in moved.results.collect()} == {1: 409, 2: 404, 3: 200}
    assert bag(moved.projects, "project") == [("n",), ("q",)] and moved.graph.project("n").entities.count() == 7
    left = mutate.drop_projects(projects, g, spark.createDataFrame([(1, "p"), (2, "x")], "request_id bigint, project string"))
    assert {r.request_id: r.status for r in left.results.collect()} == {1: 200, 2: 404} and left.graph.entities.count() == 1
    assert mutate.valid_types(spark).count() == 24


def test_views(spark):
    g = shop(spark)
    view = views.graph_view(g)
    ids = {r.label: r.id for r in view.nodes.collect()}
    assert sorted(ids.values()) == list(range(7))
    # "Database" resolves to the last entity of that name, the lower-cased one.
    assert (ids["UserService"], ids["database"]) in bag(view.edges, "from", "to")
    assert view.edges.count() == 5
    records = views.database_view(g)
    assert sorted(r.id for r in records.edges.collect()) == list(range(5))
    lines = [r.line for r in views.ego_lines(g, "UserService").orderBy("section", "ord").collect()]
    assert lines[0] == "graph LR" and lines[1] == '    UserService["UserService"]:::main'
    assert "    UserService -->|depends_on| Database" in lines
    assert views.ego_lines(g, "FastAPI", 1).count() == 6
    assert g.entities.select(F.max("ord.pos")).first()[0] == 6
