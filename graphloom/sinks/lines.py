"""Text outputs as ordered line rows (project, section, ord, line).

A rendering is never built as one string: its lines are rows, sorted by range on
write, so the text parts of a project read in order give the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.graph import Graph
from graphloom.schema import order_key
from graphloom.session import cut


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write line rows as text, one folder per project, parts in reading order."""
    (
        lines.repartitionByRange("project", "section", "ord")
        .sortWithinPartitions("project", "section", "ord")
        .select("project", F.col("line").alias("value"))
        .write.mode(mode).partitionBy("project").text(path)
    )


def _projects(graph: Graph) -> DataFrame:
    return graph.entities.select("project").union(graph.relations.select("project")).distinct()


def fixed_lines(projects: DataFrame, section: int, texts: list[str | Column]) -> DataFrame:
    """The same few lines for every project."""
    items = F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts])
    return projects.select("*", F.posexplode(items).alias("_i", "line")).select(
        "project", F.lit(section).alias("section"), order_key(pos=F.col("_i")).alias("ord"), "line"
    )


def _row_lines(frame: DataFrame, section: int, line: Column) -> DataFrame:
    return frame.select("project", F.lit(section).alias("section"), "ord", line.alias("line"))


def _stack(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _or(col: str, default: str) -> Column:
    """Null or empty values replaced."""
    return F.when(F.coalesce(F.col(col), F.lit("")) != "", F.col(col)).otherwise(F.lit(default))


def report_lines(graph: Graph) -> DataFrame:
    """Markdown report: counts table, entity rows, relation rows."""
    projects = _projects(graph)
    counts = (
        projects.join(graph.entities.groupBy("project").agg(F.count("*").alias("e")), "project", "left")
        .join(graph.relations.groupBy("project").agg(F.count("*").alias("r")), "project", "left")
        .na.fill(0)
    )
    head = [
        F.concat(F.lit("# "), "project", F.lit(" 知识图谱报告")), "", "## 统计概览", "",
        "| 指标 | 数量 |", "|------|------|",
        F.format_string("| 实体 | %d |", "e"), F.format_string("| 关系 | %d |", "r"), "",
        "## 实体列表", "", "| 名称 | 类型 | 描述 | 来源 |", "|------|------|------|------|",
    ]
    return _stack(
        fixed_lines(counts, 0, head),
        _row_lines(
            graph.entities, 1,
            F.format_string("| %s | %s | %s | %s |", "name", "type", _or("description", "-"), _or("source_file", "-")),
        ),
        fixed_lines(projects, 2, ["", "## 关系列表", "", "| 源 | 关系 | 目标 |", "|-----|------|------|"]),
        _row_lines(graph.relations, 3, F.format_string("| %s | %s | %s |", "source", "type", "target")),
    )


def _cypher(col: Column | str) -> Column:
    return F.replace(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), F.lit("'"), F.lit("\\'"))


def cypher_lines(graph: Graph) -> DataFrame:
    """Cypher script: two indexes, a CREATE per entity, a MATCH ... CREATE per relation."""
    projects = _projects(graph)
    entity = F.format_string(
        "CREATE (n:%s:Entity {name: '%s', type: '%s', description: '%s', source_file: '%s'});",
        "type", _cypher("name"), "type", _cypher("description"), _cypher("source_file"),
    )
    relation = F.format_string(
        "MATCH (a:Entity {name: '%s'}), (b:Entity {name: '%s'}) CREATE (a)-[r:%s]->(b);",
        _cypher("source"), _cypher("target"), F.upper("type"),
    )
    head = [
        "// Neo4j Cypher 导入脚本", "", "// 创建索引",
        "CREATE INDEX IF NOT EXISTS FOR (n:Entity) ON (n.name);",
        "CREATE INDEX IF NOT EXISTS FOR (n:Entity) ON (n.type);",
        "", "// 创建实体",
    ]
    return _stack(
        fixed_lines(projects, 0, head),
        _row_lines(graph.entities, 1, entity),
        fixed_lines(projects, 2, ["", "// 创建关系"]),
        _row_lines(graph.relations, 3, relation),
    )


def _items(frame: DataFrame, section: int, fields: list[str]) -> DataFrame:
    """JSON array elements, a comma before every element but a project's first."""
    # Written, so that the planner sees how few rows it has and does not deal out all elements by project.
    first = cut(frame.groupBy("project").agg(F.min("ord").alias("_first")))
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    line = F.concat(F.when(F.col("ord") == F.col("_first"), "").otherwise(","), body)
    return _row_lines(frame.join(first, "project"), section, line)


def graph_json_lines(graph: Graph) -> DataFrame:
    """One JSON object per project: ``{"entities": [...], "relations": [...]}``.

    Rows of a project must have distinct ``ord`` values, as extraction gives.
    """
    # Read for the projects, the first places, the ranges and the lines themselves.
    graph = Graph(cut(graph.entities), cut(graph.relations))
    projects = _projects(graph)
    return _stack(
        fixed_lines(projects, 0, ['{"entities": [']),
        _items(graph.entities, 1, ["name", "type", "description", "source_file"]),
        fixed_lines(projects, 2, ['], "relations": [']),
        _items(graph.relations, 3, ["source", "target", "type", "description", "source_file"]),
        fixed_lines(projects, 4, ["]}"]),
    )


def export_markdown(graph: Graph, path: str) -> None:
    write_lines(report_lines(graph), path)


def export_cypher(graph: Graph, path: str) -> None:
    write_lines(cypher_lines(graph), path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Written lines with their project, for checking a sink."""
    return spark.read.text(path)
