"""Merging the graphs of several projects into one.

Projects are folded in a given order, entities in graph order. Keys are
(name, type) and (source, target, type), case-sensitive. Strategies for an entity
that differs from the one held: ``skip`` keeps the first, ``overwrite`` the last,
``keep_both`` adds the later one as ``name (project)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.ordered import dense_index, last_known
from graphloom.graph import Graph

STRATEGIES = ("skip", "overwrite", "keep_both")
_KEY = ["name", "type"]
# Rows of a key per window when conflicts are compared with the row before.
BLOCK = 1 << 16


def _order(graph: Graph, projects: DataFrame | Sequence[str] | None) -> DataFrame:
    """(project, project_no): a given order, or alphabetical."""
    if projects is None:
        names = graph.entities.select("project").union(graph.relations.select("project")).distinct()
        return dense_index(names, ["project"], "project_no")
    if isinstance(projects, DataFrame):
        return projects.select("project", "project_no")
    return graph.spark.createDataFrame(
        [(p, i) for i, p in enumerate(projects)], "project string, project_no bigint"
    )


def prefix_project(graph: Graph) -> Graph:
    """Names become ``project.name``; an end is renamed only if its project has that entity."""
    names = graph.entities.select("project", "name").distinct()

    def end(column):
        return names.select("project", F.col("name").alias(column), F.lit(True).alias(f"_{column}"))

    def renamed(column) -> Column:
        return F.when(
            F.col(f"_{column}"), F.concat_ws(".", "project", column)
        ).otherwise(F.col(column)).alias(column)

    columns = graph.relations.columns
    relations = graph.relations.join(end("source"), ["project", "source"], "left").join(
        end("target"), ["project", "target"], "left"
    )
    return Graph(
        graph.entities.withColumn("name", F.concat_ws(".", "project", "name")),
        relations.select(*[renamed(c) if c in ("source", "target") else F.col(c) for c in columns]),
    )


def _placed(frame: DataFrame, order: DataFrame) -> DataFrame:
    """Rows with ``seq``, their place in the fold."""
    return frame.join(order, "project").withColumn("seq", F.struct("project_no", "ord")).drop("project_no")


def _against_first(entities: DataFrame) -> DataFrame:
    """Every row with the first row of its key as ``held``."""
    first = entities.groupBy(*_KEY).agg(
        F.min_by(F.struct("description", "source_file", "seq"), "seq").alias("held")
    )
    return entities.join(first, _KEY)


def _differs(held: str) -> Column:
    return ~(
        F.col("description").eqNullSafe(F.col(f"{held}.description"))
        & F.col("source_file").eqNullSafe(F.col(f"{held}.source_file"))
    )


def _later_conflicts(entities: DataFrame) -> DataFrame:
    compared = _against_first(entities)
    return compared.where((F.col("seq") != F.col("held.seq")) & _differs("held"))


def merge_entities(
    graph: Graph, strategy: str = "skip", projects=None, prefix: bool = False
) -> DataFrame:
    """Merged entities; ``seq`` is the place of the row in the merged list."""
    return _merge_entities(*_prepared(graph, strategy, projects, prefix), strategy)


def _prepared(graph: Graph, strategy: str, projects, prefix: bool) -> tuple[DataFrame, DataFrame]:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    order = _order(graph, projects)
    graph = prefix_project(graph) if prefix else graph
    return _placed(graph.entities, order), _placed(graph.relations, order)


def _merge_entities(entities: DataFrame, _relations: DataFrame, strategy: str) -> DataFrame:
    values = F.struct("description", "source_file", "project")
    if strategy == "overwrite":
        return entities.groupBy(*_KEY).agg(
            F.max_by(values, "seq").alias("v"), F.min("seq").alias("seq")
        ).select(*_KEY, "v.*", "seq")
    first = entities.groupBy(*_KEY).agg(
        F.min_by(values, "seq").alias("v"), F.min("seq").alias("seq")
    ).select(*_KEY, "v.*", "seq")
    if strategy == "skip":
        return first
    renamed = (
        _later_conflicts(entities)
        .withColumn("name", F.format_string("%s (%s)", "name", "project"))
        .groupBy(*_KEY)
        .agg(F.max_by(values, "seq").alias("v"), F.min("seq").alias("seq"))
        .select(*_KEY, "v.*", "seq")
    )
    return first.join(renamed, _KEY, "left_anti").unionByName(renamed)


def merge_conflicts(
    graph: Graph, strategy: str = "skip", projects=None, prefix: bool = False
) -> DataFrame:
    """One row per later entity whose description or source file differs from the value held."""
    entities, _ = _prepared(graph, strategy, projects, prefix)
    return _conflicts(entities, strategy)


def _conflicts(entities: DataFrame, strategy: str) -> DataFrame:
    if strategy == "overwrite":
        # The held value is always the row before. Only repeated keys take part;
        # they are numbered in fold order and compared block by block, so a key
        # found in every project is never one window.
        repeated = entities.groupBy(*_KEY).agg(F.count("*").alias("_n")).where("_n > 1").select(*_KEY)
        rows = dense_index(entities.join(repeated, _KEY, "left_semi"), ["seq"], "_i")
        rows = rows.withColumns({
            "_b0": F.floor(F.col("_i") / BLOCK), "_b1": F.floor(F.col("_i") / (BLOCK << 12)),
            "_value": F.struct("description", "source_file"),
        })
        rows = last_known(rows, _KEY, "_i", "_value", "held", ["_b0", "_b1"], inclusive=False)
        found = rows.where(F.col("held").isNotNull() & _differs("held"))
    else:
        found = _later_conflicts(entities)
    rows = found.select(
        F.col("name").alias("entity_name"), F.col("type").alias("old_type"), F.col("type").alias("new_type"),
        F.coalesce("held.source_file", F.lit("")).alias("old_source"),
        F.coalesce("source_file", F.lit("")).alias("new_source"),
        F.lit(strategy).alias("resolution"), "project", "seq",
    )
    if strategy != "keep_both":
        return rows
    # A renamed entity that meets a real one of that name replaces it; that is a conflict too.
    renamed = _later_conflicts(entities).select(
        F.format_string("%s (%s)", "name", "project").alias("name"), "type",
        F.col("source_file").alias("_new"), F.col("project").alias("_project"), F.col("seq").alias("_seq"),
    )
    real = entities.groupBy(*_KEY).agg(F.min_by(F.struct("source_file"), "seq").alias("_real"))
    collisions = renamed.join(real, _KEY).select(
        F.col("name").alias("entity_name"), F.col("type").alias("old_type"), F.col("type").alias("new_type"),
        F.coalesce("_real.source_file", F.lit("")).alias("old_source"),
        F.coalesce("_new", F.lit("")).alias("new_source"),
        F.lit(strategy).alias("resolution"), F.col("_project").alias("project"), F.col("_seq").alias("seq"),
    )
    return rows.unionByName(collisions)


def merge_relations(graph: Graph, projects=None, prefix: bool = False, dedupe: bool = True) -> DataFrame:
    """Relations of all projects; the first per (source, target, type) when deduplicating."""
    _, relations = _prepared(graph, "skip", projects, prefix)
    return _merge_relations(relations, dedupe)


def _merge_relations(relations: DataFrame, dedupe: bool) -> DataFrame:
    if not dedupe:
        return relations
    keys = ["source", "target", "type"]
    return relations.groupBy(*keys).agg(
        F.min_by(F.struct("description", "source_file", "project"), "seq").alias("v"), F.min("seq").alias("seq")
    ).select(*keys, "v.*", "seq")


def merge_graphs(
    graph: Graph,
    strategy: str = "skip",
    projects=None,
    prefix: bool = False,
    dedupe: bool = True,
    into: str = "merged",
) -> Graph:
    """All projects of a graph merged into the project ``into``."""
    entities, relations = _prepared(graph, strategy, projects, prefix)
    # Fold order as one ord: pairs of project and generation, numbered, take the generation's place.
    pair = ["_project", "_gen"]

    def split(frame):
        return frame.withColumns({"_project": F.col("seq.project_no"), "_gen": F.col("seq.ord.gen")})

    pairs = split(entities).select(*pair).union(split(relations).select(*pair)).distinct()
    pairs = dense_index(pairs, pair, "_n")

    def finish(frame):
        place = F.col("seq.ord").withField("gen", F.col("_n").cast("int"))
        return split(frame).join(pairs, pair).withColumn("project", F.lit(into)).withColumn("ord", place)

    return Graph.of(
        finish(_merge_entities(entities, relations, strategy)), finish(_merge_relations(relations, dedupe))
    )


def merge_stats(
    graph: Graph, strategy: str = "skip", projects=None, prefix: bool = False, dedupe: bool = True
) -> DataFrame:
    """One row: entities added and skipped, relations added, conflicts, projects."""
    entities, relations = _prepared(graph, strategy, projects, prefix)
    fights = _conflicts(entities, strategy) if strategy == "overwrite" else _later_conflicts(entities)
    kept = _merge_relations(relations, dedupe)
    sources = entities.select("project").union(relations.select("project")).distinct()

    def count_of(frame, metric):
        return frame.agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), "n")

    counts = (
        count_of(entities, "rows").unionByName(count_of(entities.select(*_KEY).distinct(), "firsts"))
        .unionByName(count_of(fights, "conflicts")).unionByName(count_of(kept, "relations_added"))
        .unionByName(count_of(sources, "source_projects"))
    )
    names = ["rows", "firsts", "conflicts", "relations_added", "source_projects"]
    row = counts.agg(*[F.sum(F.when(F.col("metric") == m, F.col("n"))).alias(m) for m in names])
    same = F.col("rows") - F.col("firsts") - F.col("conflicts")
    if strategy == "skip":
        added, skipped = F.col("firsts"), same + F.col("conflicts")
    else:
        added, skipped = F.col("firsts") + F.col("conflicts"), same
    return row.select(
        added.alias("entities_added"), skipped.alias("entities_skipped"), "relations_added", "conflicts",
        "source_projects",
    )
