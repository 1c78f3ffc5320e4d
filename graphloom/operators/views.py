"""Graphs numbered for viewers and graph databases."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from graphloom.functions.ordered import dense_index, top_per
from graphloom.graph import Graph
from graphloom.operators.lookup import _asked, _touching, first_entity
from graphloom.schema import order_key


class View(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def _numbered(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Entities with a dense id per project, and relations with both ends resolved.

    A name that several entities share resolves to the last of them; relations with
    an unknown end drop out.
    """
    nodes = dense_index(graph.entities, ["project", "ord"], "id", within="project")
    ids = nodes.groupBy("project", F.lower("name").alias("key")).agg(F.max("id").alias("id"))

    def end(column, into):
        return ids.select("project", F.col("key").alias(f"_{column}"), F.col("id").alias(into))

    edges = (
        graph.relations.withColumns({"_source": F.lower("source"), "_target": F.lower("target")})
        .join(end("source", "start_id"), ["project", "_source"])
        .join(end("target", "end_id"), ["project", "_target"])
        .drop("_source", "_target")
    )
    return nodes, edges


def graph_view(graph: Graph) -> View:
    """Node and edge rows for a network viewer."""
    nodes, edges = _numbered(graph)
    return View(
        nodes.select(
            "project", "id", F.col("name").alias("label"), F.col("type").alias("group"),
            F.format_string("%s: %s", "type", "name").alias("title"),
        ),
        edges.select(
            "project", F.col("start_id").alias("from"), F.col("end_id").alias("to"),
            F.col("type").alias("label"), F.lit("to").alias("arrows"),
        ),
    )


def database_view(graph: Graph) -> View:
    """Node and relationship records for a graph database, both with dense ids."""
    nodes, edges = _numbered(graph)
    edges = dense_index(edges, ["project", "ord", "start_id", "end_id"], "id", within="project")
    return View(
        nodes.select(
            "project", "id", F.array("type", F.lit("Entity")).alias("labels"),
            F.struct(
                "name", "type", F.coalesce("description", F.lit("")).alias("description"),
                F.coalesce("source_file", F.lit("")).alias("source_file"),
            ).alias("properties"),
        ),
        edges.select(
            "project", "id", F.upper("type").alias("type"), F.col("start_id").alias("startNode"),
            F.col("end_id").alias("endNode"),
            F.struct(F.coalesce("description", F.lit("")).alias("description")).alias("properties"),
        ),
    )


def write_database_json(graph: Graph, path: str, mode: str = "overwrite") -> None:
    """The records of database_view as JSON, nodes/ and relationships/."""
    view = database_view(graph)
    view.nodes.write.mode(mode).partitionBy("project").json(f"{path}/nodes")
    view.edges.write.mode(mode).partitionBy("project").json(f"{path}/relationships")


def ego_lines(graph: Graph, names: DataFrame | str, shown: int | None = None) -> DataFrame:
    """Mermaid diagram around each name: (project, asked, section, ord, line)."""
    entity = _asked(graph, names).join(first_entity(graph), ["project", "key"]).select(
        "project", "asked", "key", "name"
    )
    touching = _touching(graph, names)
    around = top_per(touching, ["project", "asked"], ["ord"], shown).join(
        entity.select("project", "asked", "name"), ["project", "asked"]
    )
    drawn = entity.join(touching.select("project", "asked").distinct(), ["project", "asked"], "left_semi")

    def node(col):
        return F.replace(F.col(col), F.lit("."), F.lit("_"))

    head = F.array(F.lit("graph LR"), F.format_string('    %s["%s"]:::main', node("name"), "name"))
    tail = F.array(
        F.lit("    classDef main fill:#4CAF50,stroke:#388E3C,color:white"),
        F.lit("    classDef related fill:#2196F3,stroke:#1565C0,color:white"),
    )
    pair = F.array(
        F.format_string('    %s["%s"]:::related', node("other"), "other"),
        F.format_string("    %s -->|%s| %s", node("name"), "type", node("other")),
    )

    def rows(frame, section, items, ord_=None):
        exploded = frame.select("*", F.posexplode(items).alias("_i", "line"))
        place = order_key(pos=F.col("_i")) if ord_ is None else F.col("ord").withField(
            "pos", F.col("ord.pos") * 2 + F.col("_i")
        )
        return exploded.select(
            "project", "asked", F.lit(section).alias("section"), place.alias("ord"), "line"
        )

    return (
        rows(drawn, 0, head).unionByName(rows(around, 1, pair, True)).unionByName(rows(drawn, 2, tail))
    )
