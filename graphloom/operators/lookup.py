"""Lookups in a graph, for one name or a DataFrame of names at once.

Names are (project, name) and compare case-insensitively. A name that several
entities carry stands for the first of them. Results are flat rows: what belongs
to a busy entity is never gathered into one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.grams import substring_join
from graphloom.functions.ordered import top_per
from graphloom.graph import Graph
from graphloom.operators.dedupe import keep_one
from graphloom.session import cut


def first_entity(graph: Graph, names: DataFrame | str | None = None) -> DataFrame:
    """First entity per project and lower-cased name, with that name as ``key``.

    Given one name as a string, only its entities are read into the aggregation.
    """
    entities = graph.entities
    if isinstance(names, str):
        entities = entities.where(F.lower("name") == names.lower())
    return keep_one(entities, [F.col("project"), F.lower("name")]).withColumn("key", F.lower("name"))


def _asked(graph: Graph, names: DataFrame | str) -> DataFrame:
    """Distinct (project, asked, key); a plain string is asked of every project."""
    if isinstance(names, str):
        return graph.entities.select("project").distinct().select(
            "project", F.lit(names).alias("asked"), F.lit(names.lower()).alias("key")
        )
    return names.select("project", F.col("name").alias("asked"), F.lower("name").alias("key")).distinct()


def _touching(graph: Graph, names: DataFrame | str, types: Sequence[str] | None = None) -> DataFrame:
    """Relations with an asked end; ``direction`` is out when the source matches.

    One equi-join: each relation offers its ends as keys, a self loop only one.
    """
    relations = graph.relations
    if types is not None:
        relations = relations.where(F.col("type").isin(list(types)))
    ends = F.array_distinct(F.array(F.lower("source"), F.lower("target")))
    if isinstance(names, str):
        # One name needs no join.
        key = names.lower()
        found = relations.where((F.lower("source") == key) | (F.lower("target") == key)).withColumns(
            {"key": F.lit(key), "asked": F.lit(names)}
        )
    else:
        found = relations.withColumn("key", F.explode(ends)).join(_asked(graph, names), ["project", "key"])
    return (
        found.withColumn("direction", F.when(F.lower("source") == F.col("key"), "out").otherwise("in"))
        .withColumn("other", F.when(F.col("direction") == "out", F.col("target")).otherwise(F.col("source")))
    )


def _partner(rows: DataFrame, graph: Graph, end: str = "other", few: bool = False) -> DataFrame:
    """Join the entity at one end; ends without an entity drop out.

    With ``few`` rows, only the entities of their ends are deduplicated.
    """
    if few:
        wanted = rows.select("project", F.lower(end).alias("_end")).distinct()
        named = graph.entities.withColumn("_end", F.lower("name")).join(wanted, ["project", "_end"], "left_semi")
        graph = Graph(named.drop("_end"), graph.relations)
    partner = first_entity(graph).select(
        "project", F.col("key").alias("_end"), F.col("name").alias("entity"),
        F.col("type").alias("entity_type"), F.col("description").alias("entity_description"),
    )
    return rows.withColumn("_end", F.lower(end)).join(partner, ["project", "_end"]).drop("_end")


def find_entity(graph: Graph, names: DataFrame | str) -> DataFrame:
    """The entity of each asked name."""
    if isinstance(names, str):
        return first_entity(graph, names).withColumn("asked", F.lit(names)).drop("key")
    return _asked(graph, names).join(first_entity(graph), ["project", "key"]).drop("key")


def find_entities_by_type(graph: Graph, type_: str) -> DataFrame:
    return graph.entities.where(F.col("type") == type_)


def find_relations(graph: Graph, names: DataFrame | str) -> DataFrame:
    """Relations that touch each asked name, a self loop once."""
    return _touching(graph, names).drop("key", "other")


def find_dependencies(graph: Graph, names: DataFrame | str) -> DataFrame:
    """Entities that outgoing ``depends_on`` relations lead to; repeats are kept."""
    rows = _touching(graph, names, ["depends_on"]).where("direction = 'out'").select(
        "project", "asked", "target", "ord"
    )
    return _partner(rows, graph, "target", isinstance(names, str)).drop("target")


def find_documents(graph: Graph, names: DataFrame | str) -> DataFrame:
    """Documents that incoming ``documents`` relations come from."""
    rows = _touching(graph, names, ["documents"]).where(F.lower("target") == F.col("key")).select(
        "project", "asked", "source", "ord"
    )
    found = _partner(rows, graph, "source", isinstance(names, str)).where("entity_type = 'Document'")
    return found.drop("source")


def find_related(graph: Graph, names: DataFrame | str) -> DataFrame:
    """The entity at the other end of every touching relation."""
    rows = _touching(graph, names).select(
        "project", "asked", "direction", F.col("type").alias("relation"), "other", "ord"
    )
    return _partner(rows, graph, few=isinstance(names, str)).drop("other")


def _mentions(keyword: Column) -> Column:
    lowered = F.lower(keyword)
    return F.contains(F.lower("name"), lowered) | F.coalesce(
        F.contains(F.lower("description"), lowered), F.lit(False)
    )


def search_keyword(graph: Graph, keyword: str, limit: int | None = None) -> DataFrame:
    """Entities whose name or description contains the keyword, in graph order."""
    hits = graph.entities.where(_mentions(F.lit(keyword)))
    return hits if limit is None else hits.orderBy("project", "ord").limit(limit)


def search_keywords(graph: Graph, keywords: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """The same for a DataFrame of keywords: columns ``keyword`` and ``keys``.

    With the default keys a keyword is asked of its project; with none, of all.
    """
    # Both fields as one text; a needle that spans them holds the character between, so hits are checked.
    between = F.lit("\u0000")
    entities = graph.entities.select(*graph.entities.columns, F.lower(F.concat_ws("\u0000", "name", "description")).alias("_text"))
    asked = keywords.select(*keys, F.lower("keyword").alias("_needle"), "keyword").distinct()
    # Graphs put together by hand may use a place twice; with name and type it is one entity.
    pairs = substring_join(entities, "_text", asked, "_needle", ["project", "ord", "name", "type"], on=list(keys))
    true = ~F.contains("_needle", between) | _mentions(F.col("keyword"))
    return pairs.where(true).select("project", "ord", "name", "type", "keyword", "description", "source_file")


def dependencies_both(graph: Graph, names: DataFrame | str) -> DataFrame:
    """Names on the other end of ``depends_on`` and ``uses``, by direction."""
    rows = _touching(graph, names, ["depends_on", "uses"])
    return rows.select(
        "project", "asked", F.when(F.col("direction") == "out", "dependency").otherwise("dependent").alias("role"),
        F.col("type").alias("relation"), "other", "ord",
    )


def dependency_tree(graph: Graph, names: DataFrame | str, children: int | None = None) -> DataFrame:
    """Dependencies of each name and, under each, its dependencies, all or the first ``children``.

    ``more`` counts the dependencies of a dependency beyond those shown.
    """
    entities = first_entity(graph)
    edges = graph.relations.where("type = 'depends_on'").select(
        "project", F.lower("source").alias("key"), "target", "ord"
    )
    # The asked level and the one below read it.
    resolved = cut(_partner(edges, graph, "target").select(
        "project", "key", "ord", "entity", "entity_type", F.lower("entity").alias("entity_key")
    ))
    asked = _asked(graph, names).join(entities.select("project", "key"), ["project", "key"], "left_semi")
    level1 = resolved.join(asked, ["project", "key"]).drop("key").withColumnRenamed("entity_key", "key")
    below = resolved.join(level1.select("project", "key").distinct(), ["project", "key"], "left_semi")
    totals = below.groupBy("project", "key").agg(F.count("*").alias("_total"))
    shown = top_per(below, ["project", "key"], ["ord"], children).select(
        "project", "key", F.col("entity").alias("child"), F.col("entity_type").alias("child_type"),
        F.col("ord").alias("child_ord"),
    )
    return (
        level1.join(shown, ["project", "key"], "left")
        .join(totals, ["project", "key"], "left")
        .select(
            "project", "asked", F.col("entity").alias("dependency"), F.col("entity_type").alias("dependency_type"),
            "ord", "child", "child_type", "child_ord",
            F.greatest(F.coalesce("_total", F.lit(0)) - children, F.lit(0)).alias("more")
            if children is not None else F.lit(0).cast("bigint").alias("more"),
        )
    )


def relations_of(graph: Graph, names: DataFrame) -> DataFrame:
    """Outgoing and incoming relations of each name; a self loop counts both ways.

    A name without an entity falls back to the first entity that mentions it.
    """
    entities = first_entity(graph)
    asked = _asked(graph, names)
    exact = asked.join(entities, ["project", "key"], "left_semi").select("project", "asked", "key")
    missing = asked.join(entities, ["project", "key"], "left_anti")
    hits = search_keywords(graph, missing.select("project", F.col("asked").alias("keyword")))
    first = hits.groupBy("project", "keyword").agg(F.min_by("name", "ord").alias("name"))
    near = first.select("project", F.col("keyword").alias("asked"), F.lower("name").alias("key"))
    ends = F.array(
        F.struct(F.lit("out").alias("direction"), F.lower("source").alias("key")),
        F.struct(F.lit("in").alias("direction"), F.lower("target").alias("key")),
    )
    return (
        graph.relations.withColumn("end", F.explode(ends))
        .select("*", "end.direction", "end.key").drop("end")
        .join(exact.unionByName(near), ["project", "key"])
        .select(
            "project", "asked", F.col("key").alias("entity"), "direction", F.col("type").alias("relation"),
            F.when(F.col("direction") == "out", F.col("target")).otherwise(F.col("source")).alias("other"),
            "description", "ord",
        )
    )


def entity_detail(graph: Graph, names: DataFrame | str) -> DataFrame:
    """The entity with one row per touching relation; one row of nulls if it has none."""
    entity = find_entity(graph, names).select(
        "project", "asked", "name", "type", "description", "source_file"
    )
    rows = _touching(graph, names).select(
        "project", "asked", "direction", F.col("type").alias("relation"), "other", "ord"
    )
    return entity.join(rows, ["project", "asked"], "left")


def category(graph: Graph, type_: str, limit: int | None = None) -> DataFrame:
    """Entities of a type, or the first of each project, with the type's total."""
    return list_entities(graph, type_, limit)


def _first_rows(rows: DataFrame, limit: int | None) -> DataFrame:
    totals = rows.groupBy("project").agg(F.count("*").alias("total"))
    return top_per(rows, ["project"], ["ord"], limit).join(totals, "project")


def list_entities(graph: Graph, type_: str | None = None, limit: int | None = None) -> DataFrame:
    """Entities, or the first per project, optionally of one type, with the total."""
    rows = graph.entities if type_ is None else find_entities_by_type(graph, type_)
    return _first_rows(rows, limit)


def list_relations(graph: Graph, limit: int | None = None) -> DataFrame:
    """Relations, or the first per project, with the total."""
    return _first_rows(graph.relations, limit)


def list_projects(graph: Graph) -> DataFrame:
    """Entity and relation counts per project."""
    entities = graph.entities.groupBy("project").agg(F.count("*").alias("entities"))
    relations = graph.relations.groupBy("project").agg(F.count("*").alias("relations"))
    return entities.join(relations, "project", "full_outer").na.fill(0, ["entities", "relations"])
