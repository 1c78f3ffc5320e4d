"""Batches of edit requests against a graph.

Each function returns the changed frames and one status row per request, with the
codes of a web service: 200 done, 400 bad type, 404 not found, 409 exists already.
Requests carry ``request_id``; where two requests of a batch compete, the lower id
wins. Names compare case-sensitively.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.graph import Graph
from graphloom.schema import ENTITY, ENTITY_TYPES, RELATION, RELATION_TYPES, order_key


class Edit(NamedTuple):
    graph: Graph
    results: DataFrame


def valid_types(spark: SparkSession) -> DataFrame:
    """(kind, type) of every permitted entity and relation type."""
    return spark.createDataFrame(
        [("entity", t) for t in ENTITY_TYPES] + [("relation", t) for t in RELATION_TYPES],
        "kind string, type string",
    )


def validate_types(requests: DataFrame, kind: str, column: str = "type") -> DataFrame:
    """Requests with ``valid``: whether their type is in the domain."""
    domain = ENTITY_TYPES if kind == "entity" else RELATION_TYPES
    return requests.withColumn("valid", F.coalesce(F.col(column).isin(domain), F.lit(False)))


def _mark(requests: DataFrame, known: DataFrame, keys: list[str], into: str) -> DataFrame:
    """Flag requests whose key occurs in the known rows."""
    flags = known.select(*keys).distinct().withColumn(into, F.lit(True))
    return requests.join(flags, keys, "left").withColumn(into, F.coalesce(into, F.lit(False)))


def _first_of(requests: DataFrame, keys: list[str], into: str = "_first") -> DataFrame:
    """Flag the lowest request id of each key."""
    first = requests.groupBy(*keys).agg(F.min("request_id").alias("_lowest"))
    return (
        requests.join(first, keys)
        .withColumn(into, F.col("request_id") == F.col("_lowest")).drop("_lowest")
    )


def _results(rows: DataFrame, status: Column) -> DataFrame:
    return rows.select("project", "request_id", status.alias("status"))


def create_entities(graph: Graph, requests: DataFrame, generation: int = 1) -> Edit:
    """Requests: (project, request_id, name, type, description, source_file)."""
    key = ["project", "name", "type"]
    rows = validate_types(_mark(requests, graph.entities, key, "_exists"), "entity")
    rows = _first_of(rows, key)
    status = (
        F.when(F.col("_exists"), 409).when(~F.col("valid"), 400).when(~F.col("_first"), 409).otherwise(200)
    )
    rows = rows.withColumn("status", status)
    new = rows.where("status = 200").select(
        *key, "description", "source_file", order_key(gen=generation, pos=F.col("request_id")).alias("ord")
    )
    entities = graph.entities.unionByName(new.select(*graph.entities.columns))
    return Edit(Graph(entities, graph.relations), _results(rows, F.col("status")))


def update_entities(graph: Graph, requests: DataFrame) -> Edit:
    """Change the first entity of a name; null fields of a request leave the value alone.

    Requests: (project, request_id, name, type, description, source_file).
    """
    key = ["project", "name"]
    rows = _mark(requests, graph.entities, key, "_exists").withColumn(
        "valid", F.col("type").isNull() | F.col("type").isin(ENTITY_TYPES)
    )
    rows = rows.withColumn(
        "status", F.when(~F.col("_exists"), 404).when(~F.col("valid"), 400).otherwise(200)
    )
    fields = ["type", "description", "source_file"]
    # Later requests of a batch go over earlier ones, field by field.
    changes = rows.where("status = 200").groupBy(*key).agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col("request_id"))).alias(f"_{f}") for f in fields
    ])
    target = graph.entities.groupBy(*key).agg(F.min("ord").alias("_at"))
    plan = changes.join(target, key)
    chosen = F.col("ord") == F.col("_at")
    entities = graph.entities.join(plan, key, "left").select(
        *[
            F.when(chosen, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
            for c in ENTITY.fieldNames()
        ]
    )
    return Edit(Graph(entities, graph.relations), _results(rows, F.col("status")))


def delete_entities(graph: Graph, requests: DataFrame) -> Edit:
    """Delete all entities of a name and every relation that touches it.

    Requests: (project, request_id, name).
    """
    key = ["project", "name"]
    rows = _first_of(_mark(requests, graph.entities, key, "_exists"), key)
    rows = rows.withColumn("status", F.when(F.col("_exists") & F.col("_first"), 200).otherwise(404))
    gone = rows.where("status = 200").select(*key)
    relations = graph.relations
    for end in ("source", "target"):
        relations = relations.join(gone.withColumnRenamed("name", end), ["project", end], "left_anti")
    entities = graph.entities.join(gone, key, "left_anti")
    return Edit(Graph.of(entities, relations), _results(rows, F.col("status")))


def create_relations(graph: Graph, requests: DataFrame, generation: int = 1) -> Edit:
    """Requests: (project, request_id, source, target, type, description)."""
    key = ["project", "source", "target", "type"]
    names = graph.entities.select("project", "name").distinct()
    rows = validate_types(requests, "relation")
    for end in ("source", "target"):
        rows = _mark(rows, names.withColumnRenamed("name", end), ["project", end], f"_{end}")
    rows = _first_of(_mark(rows, graph.relations, key, "_exists"), key)
    status = (
        F.when(~F.col("valid"), 400)
        .when(~F.col("_source") | ~F.col("_target"), 404)
        .when(F.col("_exists") | ~F.col("_first"), 409)
        .otherwise(200)
    )
    rows = rows.withColumn("status", status)
    new = rows.where("status = 200").select(
        *key, "description", F.lit(None).cast("string").alias("source_file"),
        order_key(gen=generation, pos=F.col("request_id")).alias("ord"),
    )
    relations = graph.relations.unionByName(new.select(*RELATION.fieldNames()))
    return Edit(Graph(graph.entities, relations), _results(rows, F.col("status")))


def delete_relations(graph: Graph, requests: DataFrame) -> Edit:
    """Requests: (project, request_id, source, target, type)."""
    key = ["project", "source", "target", "type"]
    rows = _first_of(_mark(validate_types(requests, "relation"), graph.relations, key, "_exists"), key)
    status = F.when(~F.col("valid"), 400).when(~F.col("_exists") | ~F.col("_first"), 404).otherwise(200)
    rows = rows.withColumn("status", status)
    gone = rows.where("status = 200").select(*key)
    relations = graph.relations.join(gone, key, "left_anti").select(*RELATION.fieldNames())
    return Edit(Graph(graph.entities, relations), _results(rows, F.col("status")))


class Projects(NamedTuple):
    projects: DataFrame
    graph: Graph | None
    results: DataFrame


def _project_results(rows: DataFrame) -> DataFrame:
    return rows.select("request_id", "status")


def create_projects(projects: DataFrame, requests: DataFrame) -> Projects:
    """Add empty projects. Projects: (project); requests: (request_id, project)."""
    rows = _first_of(_mark(requests, projects, ["project"], "_exists"), ["project"])
    rows = rows.withColumn("status", F.when(F.col("_exists") | ~F.col("_first"), 409).otherwise(200))
    new = rows.where("status = 200").select("project")
    return Projects(projects.select("project").unionByName(new), None, _project_results(rows))


def rename_projects(projects: DataFrame, graph: Graph, requests: DataFrame) -> Projects:
    """Rename projects. Requests: (request_id, project, new_name), all against the state before."""
    rows = _mark(requests, projects, ["project"], "_exists")
    taken = projects.select(F.col("project").alias("new_name"))
    rows = _mark(rows, taken, ["new_name"], "_taken")
    open_ = rows.where(F.col("_exists") & ~F.col("_taken"))
    # Of competing requests for one source or one target the lowest id goes through.
    won = _first_of(_first_of(open_, ["project"], "_a"), ["new_name"], "_b").where("_a and _b")
    rows = _mark(rows, won, ["request_id"], "_won")
    rows = rows.withColumn(
        "status", F.when(~F.col("_exists"), 404).when(F.col("_won"), 200).otherwise(409)
    )
    moves = rows.where("status = 200").select("project", "new_name")

    def moved(frame):
        columns = frame.columns
        return frame.join(moves, "project", "left").withColumn(
            "project", F.coalesce("new_name", "project")
        ).select(*columns)

    return Projects(
        moved(projects.select("project")),
        Graph(moved(graph.entities), moved(graph.relations)), _project_results(rows),
    )


def drop_projects(projects: DataFrame, graph: Graph, requests: DataFrame) -> Projects:
    """Delete projects with all their rows. Requests: (request_id, project)."""
    rows = _first_of(_mark(requests, projects, ["project"], "_exists"), ["project"])
    rows = rows.withColumn("status", F.when(F.col("_exists") & F.col("_first"), 200).otherwise(404))
    gone = rows.where("status = 200").select("project")
    return Projects(
        projects.select("project").join(gone, "project", "left_anti"),
        Graph.of(
            graph.entities.join(gone, "project", "left_anti"),
            graph.relations.join(gone, "project", "left_anti"),
        ),
        _project_results(rows),
    )
