"""Merging against a plain sequential fold."""

import random

import pytest

from graphloom.operators import merge
from helpers import bag, graph, join

SHOP = [("UserService", "Module", "users"), ("Database", "Database", "db"), ("FastAPI", "Framework")]
ORDERS = [("OrderService", "Module", "orders"), ("Database", "Database", "db"), ("Redis", "Tool")]


def two(spark):
    return join(
        graph(spark, SHOP, [("UserService", "depends_on", "Database"), ("UserService", "uses", "FastAPI")], "p1"),
        graph(spark, ORDERS, [("OrderService", "depends_on", "Database"), ("OrderService", "uses", "Redis")], "p2"),
    )


def stats(g, *args, **kw):
    return merge.merge_stats(g, *args, **kw).first().asDict()


def test_merge_pair(spark):
    g = two(spark)
    merged = merge.merge_graphs(g)
    assert merged.entities.count() == 5 and merged.relations.count() == 4
    assert stats(g) == {
        "entities_added": 5, "entities_skipped": 1, "relations_added": 4, "conflicts": 0, "source_projects": 2}
    prefixed = merge.merge_graphs(g, prefix=True)
    assert prefixed.entities.count() == 6 and prefixed.relations.count() == 4
    assert ("p1.UserService", "p1.Database") in bag(prefixed.relations, "source", "target")


def test_prefix_leaves_foreign_ends(spark):
    g = graph(spark, [("a", "Module")], [("a", "uses", "A"), ("x", "uses", "a")])
    assert bag(merge.prefix_project(g).relations, "source", "target") == [("p.a", "A"), ("x", "p.a")]


def fold(projects, strategy):
    """What a one-by-one merge gives: held rows by key, and the counts."""
    held, conflicts, added, skipped = {}, [], 0, 0
    for project, rows in projects:
        for name, type_, description, source in rows:
            key = (name, type_)
            if key not in held:
                held[key] = (description, source)
                added += 1
            elif held[key] == (description, source):
                skipped += 1
            else:
                conflicts.append((name, type_, held[key][1] or "", source or "", project))
                if strategy == "skip":
                    skipped += 1
                    continue
                added += 1
                place = key if strategy == "overwrite" else (f"{name} ({project})", type_)
                held[place] = (description, source)
    return held, conflicts, added, skipped


@pytest.mark.parametrize("strategy", merge.STRATEGIES)
def test_merge_equals_sequential_fold(spark, strategy, monkeypatch):
    # Blocks of four rows, so that the block-wise comparison is really exercised.
    monkeypatch.setattr(merge, "BLOCK", 4)
    rng = random.Random(7)
    projects = [
        (f"p{i}", [(rng.choice("abc"), rng.choice(["Module", "Tool"]), rng.choice([None, "", "x"]), rng.choice([None, "f"]))
                   for _ in range(12)])
        for i in range(20)
    ]
    order = [p for p, _ in projects]
    rng.shuffle(projects)
    projects.sort(key=lambda p: order.index(p[0]))
    g = join(*[graph(spark, rows, project=p) for p, rows in projects])
    held, conflicts, added, skipped = fold(projects, strategy)
    got = merge.merge_entities(g, strategy, order)
    assert bag(got, "name", "type", "description", "source_file") == sorted([(*k, *v) for k, v in held.items()], key=repr)
    found = merge.merge_conflicts(g, strategy, order)
    assert bag(found, "entity_name", "new_type", "old_source", "new_source", "project") == sorted(conflicts, key=repr)
    s = stats(g, strategy, order)
    assert (s["entities_added"], s["entities_skipped"], s["conflicts"]) == (added, skipped, len(conflicts))


def test_keep_both_collision_is_reported(spark):
    g = join(graph(spark, [("S", "Module", "1"), ("S (p2)", "Module", "real")], project="p1"),
             graph(spark, [("S", "Module", "2")], project="p2"))
    rows = bag(merge.merge_entities(g, "keep_both", ["p1", "p2"]), "name", "description")
    assert rows == [("S (p2)", "2"), ("S", "1")] or rows == [("S", "1"), ("S (p2)", "2")]
    assert merge.merge_conflicts(g, "keep_both", ["p1", "p2"]).count() == 2


def test_order_of_projects_matters(spark):
    g = join(graph(spark, [("S", "Module", "1")], project="a"), graph(spark, [("S", "Module", "2")], project="b"))
    assert merge.merge_entities(g, "skip", ["b", "a"]).first().description == "2"
    assert merge.merge_entities(g, "skip").first().description == "1"
    assert merge.merge_graphs(g, dedupe=False).relations.count() == 0


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        merge.merge_entities(two(spark), "guess")
