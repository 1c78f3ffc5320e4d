"""Differences between two graphs.

Keys are case-sensitive structs; of duplicate keys the last row counts. Null and
'' are different values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.graph import Graph
from graphloom.operators.dedupe import keep_one
from graphloom.schema import order_key
from graphloom.session import cut

_ENTITY_KEY = ["project", "name", "type"]
_RELATION_KEY = ["project", "source", "target", "type"]
STATS = [
    "old_entity_count", "new_entity_count", "old_relation_count", "new_relation_count",
    "entities_added", "entities_deleted", "entities_modified", "relations_added", "relations_deleted",
]


def _last(frame: DataFrame, keys: list[str]) -> DataFrame:
    return keep_one(frame, [F.col(k) for k in keys], last=True)


def _compare(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join of the two sides with ``change_type``; unchanged rows drop out."""
    def side(frame, name):
        return _last(frame, keys).select(*keys, F.struct(*values, "ord").alias(name))

    def content(name):
        return F.struct(*[F.col(f"{name}.{v}") for v in values])

    both = side(old, "old").join(side(new, "new"), keys, "full_outer")
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "deleted")
        .when(~content("old").eqNullSafe(content("new")), "modified")
    )
    return both.withColumn("change_type", change).where("change_type is not null")


def diff_entities(old: Graph, new: Graph) -> DataFrame:
    """Added, deleted and modified entities with old and new values."""
    rows = _compare(old.entities, new.entities, _ENTITY_KEY, ["description", "source_file"])
    present = {s: F.col(s).isNotNull() for s in ("old", "new")}
    return rows.select(
        "project", "name", "change_type",
        F.when(present["old"], F.col("type")).alias("old_type"),
        F.when(present["new"], F.col("type")).alias("new_type"),
        F.col("old.description").alias("old_description"), F.col("new.description").alias("new_description"),
        F.col("old.source_file").alias("old_source_file"), F.col("new.source_file").alias("new_source_file"),
        F.coalesce("new.ord", "old.ord").alias("ord"),
    )


def diff_relations(old: Graph, new: Graph) -> DataFrame:
    """Added and deleted relations; relations are never modified."""
    rows = _compare(old.relations, new.relations, _RELATION_KEY, ["description"])
    return rows.where("change_type <> 'modified'").select(
        "project", "source", "target", F.col("type").alias("relation_type"), "change_type",
        F.coalesce("new.description", "old.description").alias("description"),
        F.coalesce("new.ord", "old.ord").alias("ord"),
    )


def diff_stats(old: Graph, new: Graph) -> DataFrame:
    """Change counts, and raw sizes before duplicates are dropped, per project."""
    return _stats(old, new, diff_entities(old, new), diff_relations(old, new))


def _stats(old: Graph, new: Graph, entities: DataFrame, relations: DataFrame) -> DataFrame:
    def counted(frame, metric):
        return frame.groupBy("project").agg(F.count("*").alias("n")).withColumn("metric", metric)

    def changes(frame, prefix):
        counts = frame.groupBy("project", "change_type").agg(F.count("*").alias("n"))
        return counts.select("project", "n", F.concat(F.lit(prefix), "change_type").alias("metric"))

    rows = changes(entities, "entities_").unionByName(changes(relations, "relations_"))
    for side, graph in (("old", old), ("new", new)):
        rows = rows.unionByName(counted(graph.entities, F.lit(f"{side}_entity_count")))
        rows = rows.unionByName(counted(graph.relations, F.lit(f"{side}_relation_count")))
    return rows.groupBy("project").pivot("metric", STATS).agg(F.sum("n")).na.fill(0)


def diff_report(old: Graph, new: Graph) -> DataFrame:
    """The differences as line rows (project, section, ord, line)."""
    # Many sections read the changes, so they are computed once.
    entities, relations = cut(diff_entities(old, new)), cut(diff_relations(old, new))

    def empty(col):
        return F.when(F.coalesce(F.col(col), F.lit("")) != "", F.col(col)).otherwise("(空)")

    numbers = _stats(old, new, entities, relations)
    head = F.array(
        F.lit("📊 图谱对比摘要"), F.lit("=" * 40),
        F.format_string("实体: %d → %d", "old_entity_count", "new_entity_count"),
        F.format_string("关系: %d → %d", "old_relation_count", "new_relation_count"),
        F.lit(""), F.lit("变更统计:"),
        F.format_string("  实体: +%d -%d ~%d", "entities_added", "entities_deleted", "entities_modified"),
        F.format_string("  关系: +%d -%d", "relations_added", "relations_deleted"),
    )
    changed = (
        F.col("entities_added") + F.col("entities_deleted") + F.col("entities_modified")
        + F.col("relations_added") + F.col("relations_deleted")
    )

    def fixed(condition, section, *texts):
        items = F.array(*[F.lit(t) for t in texts]) if texts else head
        return numbers.where(condition).select("project", F.posexplode(items).alias("i", "line")).select(
            "project", F.lit(section).alias("section"), order_key(pos=F.col("i")).alias("ord"), "line"
        )

    def body(frame, section, lines):
        # Lines of one change follow each other.
        items = F.posexplode(F.array_compact(F.array(*lines))).alias("i", "line")
        ord_ = F.col("ord").withField("pos", F.col("ord.pos") * len(lines) + F.col("i"))
        return frame.select("project", "ord", items).select(
            "project", F.lit(section).alias("section"), ord_.alias("ord"), "line"
        )

    added = entities.where("change_type = 'added'")
    deleted = entities.where("change_type = 'deleted'")
    modified = entities.where("change_type = 'modified'")
    edge = F.format_string(" %s --[%s]--> %s", "source", "relation_type", "target")
    differs = {c: ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in ("description", "source_file")}
    change_lines = [
        F.when(
            differs[c],
            F.concat(F.lit(f"    {label}: "), empty(f"old_{c}"), F.lit(" → "), empty(f"new_{c}")),
        )
        for c, label in (("description", "描述"), ("source_file", "来源"))
    ]
    parts = [
        fixed(F.lit(True), 0),
        fixed("entities_added + entities_deleted + entities_modified > 0", 1, "", "📦 实体变更", "-" * 40),
        fixed("entities_added > 0", 2, "", "✅ 新增:"),
        body(added, 3, [
            F.format_string("  + %s (%s)", "name", "new_type"),
            F.when(F.coalesce("new_description", F.lit("")) != "", F.concat(F.lit("    描述: "), "new_description")),
        ]),
        fixed("entities_deleted > 0", 4, "", "❌ 删除:"),
        body(deleted, 5, [F.format_string("  - %s (%s)", "name", "old_type")]),
        fixed("entities_modified > 0", 6, "", "🔄 修改:"),
        body(modified, 7, [F.concat(F.lit("  ~ "), "name"), *change_lines]),
        fixed("relations_added + relations_deleted > 0", 8, "", "🔗 关系变更", "-" * 40),
        fixed("relations_added > 0", 9, "", "✅ 新增:"),
        body(relations.where("change_type = 'added'"), 10, [F.concat(F.lit("  +"), edge)]),
        fixed("relations_deleted > 0", 11, "", "❌ 删除:"),
        body(relations.where("change_type = 'deleted'"), 12, [F.concat(F.lit("  -"), edge)]),
        fixed(changed == 0, 13, "", "✅ 没有发现差异"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
