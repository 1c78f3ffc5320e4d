"""Counts over graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from graphloom.functions.ordered import top_per
from graphloom.graph import Graph
from graphloom.operators.lookup import list_projects

GROUPED_TYPES = ["Framework", "Database", "Tool", "Protocol"]


def entity_type_summary(graph: Graph) -> DataFrame:
    """Entities and percent of the project's total per type."""
    counts = graph.entities.groupBy("project", "type").agg(F.count("*").alias("count"))
    # The window sees one row per type, not per entity.
    total = F.sum("count").over(Window.partitionBy("project"))
    return counts.withColumn("percent", F.round(F.col("count") / total * 100, 1)).orderBy(
        "project", F.desc("count"), "type"
    )


def relation_type_summary(graph: Graph) -> DataFrame:
    counts = graph.relations.groupBy("project", "type").agg(F.count("*").alias("count"))
    return counts.orderBy("project", F.desc("count"), "type")


def stats(graph: Graph) -> DataFrame:
    """Totals and both type breakdowns as rows (project, kind, type, count)."""
    def side(frame, kind):
        return (
            frame.groupBy("project", "type").agg(F.count("*").alias("count"))
            .withColumn("kind", F.lit(kind))
        )

    types = side(graph.entities, "entity").unionByName(side(graph.relations, "relation"))
    totals = types.groupBy("project", "kind").agg(F.sum("count").alias("count"))
    return types.unionByName(totals.withColumn("type", F.lit("total"))).select("project", "kind", "type", "count")


def tech_groups(graph: Graph) -> DataFrame:
    """Names per technology type, in graph order."""
    rows = graph.entities.where(F.col("type").isin(GROUPED_TYPES))
    return rows.select("project", "type", "name", "ord")


def top_modules(graph: Graph, k: int | None = None) -> DataFrame:
    """Modules with their description, all or the first ``k`` per project."""
    rows = graph.entities.where("type = 'Module'").select("project", "name", "description", "ord")
    return top_per(rows, ["project"], ["ord"], k)


def batch_summary(graph: Graph, failures: DataFrame | None = None) -> DataFrame:
    """Counts per project and a grand total (project null); failed projects with their error.

    ``failures`` is (project, error).
    """
    rows = list_projects(graph)
    if failures is not None:
        errors = failures.groupBy("project").agg(F.min("error").alias("error"))
        rows = rows.join(errors, "project", "full_outer").na.fill(0, ["entities", "relations"])
    else:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    return rows.rollup("project").agg(
        F.sum("entities").alias("entities"), F.sum("relations").alias("relations"),
        F.when(F.grouping("project") == 0, F.min("error")).alias("error"),
        F.count(F.when(F.col("error").isNull(), 1)).alias("succeeded"),
        F.count("error").alias("failed"),
    )
