"""Updating a stored graph from changed files only."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.graph import Graph
from graphloom.operators.extract import extract_facts, graph_of_facts
from graphloom.schema import ENTITY, RELATION
from graphloom.session import cut
from graphloom.sinks.store import GraphStore, upsert_delta
from graphloom.sources.tree import as_files


class Update(NamedTuple):
    graph: Graph
    manifest: DataFrame
    changes: DataFrame


def content_hash(content: Column) -> Column:
    return F.md5(content)


def current_manifest(files: DataFrame) -> DataFrame:
    """(project, path, content_hash) of the files as they are."""
    return files.select("project", "path", content_hash(F.col("content")).alias("content_hash"))


def detect_changes(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(project, path, change_type): added, modified or deleted paths."""
    now = current.select("project", "path", F.col("content_hash").alias("now"))
    before = manifest.select("project", "path", F.col("content_hash").alias("before"))
    change = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("now").isNull(), "deleted")
        .when(F.col("now") != F.col("before"), "modified")
    )
    both = now.join(before, ["project", "path"], "full_outer").withColumn("change_type", change)
    return both.where("change_type is not null").select("project", "path", "change_type")


def remove_files(graph: Graph, paths: DataFrame) -> Graph:
    """Drop what came from the given (project, path)s; rows without a source file stay."""
    gone = paths.select("project", F.col("path").alias("source_file")).distinct()
    on = ["project", "source_file"]
    return Graph.of(
        graph.entities.join(gone, on, "left_anti"), graph.relations.join(gone, on, "left_anti")
    )


def _upsert(old: DataFrame, new: DataFrame, keys: Mapping[str, Column], generation: int) -> DataFrame:
    """New rows replace the last old row of their key in place, or are appended.

    Of several new rows with one key the last is kept, at the place of the first.
    """
    columns = [c for c in old.columns if c != "ord"]
    names = list(keys)
    fresh = new.withColumns(dict(keys)).groupBy(*names).agg(
        F.max_by(F.struct(*columns), "ord").alias("_new"), F.min("ord").alias("_at")
    )
    keyed = old.withColumns(dict(keys))
    last = keyed.groupBy(*names).agg(F.max("ord").alias("_last"))
    match = fresh.join(last, names, "left")
    kept = keyed.join(match, names, "left")
    replaced = F.col("_new").isNotNull() & (F.col("ord") == F.col("_last"))
    appended = match.where("_last is null").select(
        *[F.col(f"_new.{c}").alias(c) for c in columns],
        F.col("_at").withField("gen", F.lit(generation)).alias("ord"),
    )
    return kept.select(
        *[F.when(replaced, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in columns], "ord"
    ).unionByName(appended)


def upsert(graph: Graph, new: Graph, generation: int = 1) -> Graph:
    """Merge freshly extracted rows into a graph on lower-cased keys.

    ``generation`` must grow from update to update; it puts appended rows last.
    """
    project = {"_project": F.col("project")}
    return Graph.of(
        _upsert(
            graph.entities.select(*ENTITY.fieldNames()), new.entities.select(*ENTITY.fieldNames()),
            {**project, "_name": F.lower("name"), "_type": F.col("type")}, generation,
        ),
        _upsert(
            graph.relations.select(*RELATION.fieldNames()), new.relations.select(*RELATION.fieldNames()),
            {
                **project, "_source": F.lower("source"), "_target": F.lower("target"),
                "_type": F.col("type"),
            },
            generation,
        ),
    )


def extract_changed(files: DataFrame, changes: DataFrame, title_fallback: str = "stem", **options) -> Graph:
    """Rules over added and modified files only."""
    touched = changes.where("change_type in ('added', 'modified')").select("project", "path")
    changed = files.join(touched, ["project", "path"], "left_semi")
    return graph_of_facts(cut(extract_facts(changed, title_fallback, **options)))


class _Changed(NamedTuple):
    """What a listing brings: new rows, files whose rows go, the manifest and the changes."""

    new: Graph
    gone: DataFrame
    manifest: DataFrame
    changes: DataFrame


def _changed(files: DataFrame, manifest: DataFrame, purge_modified: bool, title_fallback: str, options: Mapping) -> _Changed:
    # The files may change while they are read. What is extracted is written first and has to have
    # the listed hash; a file that no longer has it is left out of the manifest, for the next update.
    current = cut(current_manifest(files))
    changes = cut(detect_changes(current, manifest))
    on = ["project", "path"]
    wanted = current.join(changes.where("change_type in ('added', 'modified')").select(*on), on, "left_semi")
    files = files.withColumn("content_hash", content_hash(F.col("content")))
    files = cut(files.join(wanted.select(*on, "content_hash"), [*on, "content_hash"], "left_semi"))
    missed = wanted.join(files, on, "left_anti").select(*on)
    current = cut(current.join(missed, on, "left_anti"))
    changes = cut(changes.join(missed, on, "left_anti"))
    files = files.drop("content_hash")
    gone = changes.where("change_type in ('deleted', 'modified')" if purge_modified else "change_type = 'deleted'")
    return _Changed(extract_changed(files, changes, title_fallback, **options), gone, current, changes)


def apply_incremental(
    files: DataFrame,
    manifest: DataFrame,
    graph: Graph,
    *,
    generation: int = 1,
    purge_modified: bool = False,
    title_fallback: str = "stem",
    **options,
) -> Update:
    """Bring a graph up to date with its files.

    Deleted files lose their rows, changed files are extracted and upserted. Rows
    that vanished from a modified file stay unless ``purge_modified``. Nothing is
    deduplicated across files or inferred; extract_graph does that.
    """
    found = _changed(files, manifest, purge_modified, title_fallback, options)
    return Update(upsert(remove_files(graph, found.gone), found.new, generation), found.manifest, found.changes)


def update_store(
    store: GraphStore, files: DataFrame, manifest: DataFrame, *, purge_modified: bool = False, title_fallback: str = "stem", **options,
) -> Update:
    """The same for a stored graph: a generation with the changed rows is committed; returned is the snapshot after it."""
    commits = store.commits()
    if not commits:
        store.create(Graph.empty(files.sparkSession))
    generation = max((c.generation for c in commits), default=0) + 1
    found = _changed(files, manifest, purge_modified, title_fallback, options)
    store.commit(upsert_delta(store.snapshot(), found.new, found.gone, generation))
    return Update(store.snapshot(), found.manifest, found.changes)


def update_changed(
    store: GraphStore, changed: DataFrame, *, purge_modified: bool = False, title_fallback: str = "stem", **options,
) -> int:
    """Commit what changed files (project, path, content; null content: gone) bring; the generation."""
    if not store.commits():
        store.create(Graph.empty(changed.sparkSession))
    generation = store.commits()[-1].generation + 1
    gone = changed if purge_modified else changed.where("content is null")
    files = as_files(changed.where("content is not null"))
    new = graph_of_facts(cut(extract_facts(files, title_fallback, **options)))
    return store.commit(upsert_delta(store.snapshot(), new, gone.select("project", "path"), generation))


def update_manifest(manifest: DataFrame, current: DataFrame, changes: DataFrame) -> DataFrame:
    """The old manifest with current hashes put in and deleted paths taken out."""
    on = ["project", "path"]
    stale = changes.where("change_type = 'deleted'").select(*on)
    return (
        manifest.select(*on, "content_hash")
        .join(current.select(*on), on, "left_anti")
        .join(stale, on, "left_anti")
        .unionByName(current.select(*on, "content_hash"))
    )
