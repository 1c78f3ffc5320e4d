"""User-defined extractors, exporters and renderers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphloom.graph import Graph
from graphloom.schema import order_key
from graphloom.session import cut

# fn(path, content) -> (entities, relations); rows are dicts with the graph's fields.
Extract = Callable[[str, str], tuple[Iterable[dict], Iterable[dict]]]

FACT = (
    "project string, path string, extractor string, side string, pos bigint, name string, source string, "
    "target string, type string, description string, error string"
)


@dataclass(frozen=True)
class Extractor:
    name: str
    extensions: tuple[str, ...]
    extract: Extract


@dataclass
class Registry:
    """Plugins by name. Extractors run on executors; the others get the DataFrames."""

    extractors: dict[str, Extractor] = field(default_factory=dict)
    exporters: dict[str, Callable[[Graph, str], object]] = field(default_factory=dict)
    renderers: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def register_extractor(self, name: str, extensions: Iterable[str], extract: Extract) -> None:
        suffixes = tuple("." + e.lower().lstrip(".") for e in extensions)
        self.extractors[name] = Extractor(name, suffixes, extract)

    def register_exporter(self, name: str, export: Callable[[Graph, str], object]) -> None:
        self.exporters[name] = export

    def register_renderer(self, name: str, render: Callable[..., DataFrame]) -> None:
        self.renderers[name] = render

    def export(self, name: str, graph: Graph, path: str):
        return self.exporters[name](graph, path)

    def render(self, name: str, graph: Graph, **options) -> DataFrame:
        return self.renderers[name](graph, **options)

    def facts(self, files: DataFrame) -> DataFrame:
        """Rows of every extractor over the files it is for, one ``done`` row per run.

        A failing extractor yields its error and does not stop the others.
        """
        plugins = list(self.extractors.values())
        wanted = sorted({e for p in plugins for e in p.extensions})

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for project, path, suffix, content in frame.itertuples(index=False):
                    for plugin in plugins:
                        if suffix in plugin.extensions:
                            rows.extend(_run(plugin, project, path, content))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACT.split(", ")])

        suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
        return (
            files.select("project", "path", suffix.alias("suffix"), "content")
            .where(F.col("suffix").isin(wanted))
            .mapInPandas(run, FACT)
        )

    def extract(self, files: DataFrame) -> Graph:
        """Entities and relations of all extractors, duplicates kept."""
        return self.graph_of(cut(self.facts(files)))

    def graph_of(self, facts: DataFrame) -> Graph:
        """The graph of what ``facts`` gave, which should be stored: both sides read it."""
        # After the built-in rules, in registration order.
        rank = F.lit(None)
        for i, name in enumerate(self.extractors):
            rank = F.when(F.col("extractor") == name, i).otherwise(rank)
        ord_ = order_key(5, F.col("path"), rank, 0, F.col("pos")).alias("ord")
        source = F.col("path").alias("source_file")
        return Graph.of(
            facts.where("side = 'entity'").select("project", "name", "type", "description", source, ord_),
            facts.where("side = 'relation'").select(
                "project", "source", "target", "type", "description", source, ord_
            ),
        )


def _run(plugin: Extractor, project: str, path: str, content: str) -> list[tuple]:
    head = (project, path, plugin.name)
    try:
        entities, relations = plugin.extract(path, content)
        rows = [
            (*head, "entity", i, e["name"], None, None, e["type"], e.get("description"), None)
            for i, e in enumerate(entities)
        ]
        rows += [
            (*head, "relation", i, None, r["source"], r["target"], r["type"], r.get("description"), None)
            for i, r in enumerate(relations)
        ]
        return [*rows, (*head, "done", len(rows), None, None, None, None, None, None)]
    except Exception as failure:  # user code: any error belongs to its file
        return [(*head, "done", 0, None, None, None, None, None, f"{type(failure).__name__}: {failure}")]


def file_outcomes(facts: DataFrame) -> DataFrame:
    """Per file: success, row counts and error texts of the extractors run on it."""
    return facts.groupBy("project", "path").agg(
        (F.count("error") == 0).alias("success"),
        F.count(F.when(F.col("side") == "entity", 1)).alias("entities"),
        F.count(F.when(F.col("side") == "relation", 1)).alias("relations"),
        F.min("error").alias("error"),
    )


def extraction_totals(outcomes: DataFrame) -> DataFrame:
    """Per project: files run, succeeded and failed, and rows found."""
    return outcomes.groupBy("project").agg(
        F.count("*").alias("total"),
        F.count(F.when(F.col("success"), 1)).alias("success"),
        F.count(F.when(~F.col("success"), 1)).alias("failed"),
        F.sum("entities").alias("entities"),
        F.sum("relations").alias("relations"),
    )


def extract_with_errors(files: DataFrame, registry: Registry) -> tuple[Graph, DataFrame]:
    """The extractors' graph and the outcome per file."""
    facts = cut(registry.facts(files))
    return registry.graph_of(facts), file_outcomes(facts)
