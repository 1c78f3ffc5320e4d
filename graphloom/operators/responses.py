"""Prompts for a language model, and reading its answers. The calls are the user's."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.graph import Graph
from graphloom.operators.dedupe import dedupe_entities, dedupe_relations
from graphloom.schema import RELATION_TYPES, RESPONSE_ENTITY_TYPES, order_key

# How much text a prompt holds, and the shape of an answer.
PROMPT_CHARACTERS = 8000
RESPONSE = (
    "entities array<struct<name:string,type:string,description:string>>, "
    "relations array<struct<source:string,target:string,type:string>>"
)


def prompt_requests(files: DataFrame, size: int = PROMPT_CHARACTERS) -> DataFrame:
    """Messages of each file, ``part`` of ``parts`` from 0: its kind, its path and the next piece of its text."""
    kind = F.when(F.col("kind") == "md", "document").otherwise("code")
    pieces = F.greatest(F.ceil(F.length("content") / size).cast("int"), F.lit(1))
    parts = files.select("project", "path", kind.alias("kind"), "content", pieces.alias("parts")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    return parts.select(
        "project", "path", "part", "parts",
        F.concat(
            F.lit("Analyze this "), "kind", F.lit(" file ("), "path", F.lit("):\n\n"),
            F.substring("content", F.col("part") * size + 1, F.lit(size)),
        ).alias("message"),
    )


def parse_responses(responses: DataFrame, dedupe: bool = True) -> Graph:
    """Graph from (project, path, response) rows of JSON text.

    Unknown types and nameless entities are dropped, and so are relations with an
    end that is no entity of the same response. Text that is not JSON gives nothing.
    """
    parsed = responses.select(
        "project", "path", F.from_json("response", RESPONSE).alias("r")
    ).select(
        "project", "path",
        F.filter(
            "r.entities", lambda e: e["type"].isin(RESPONSE_ENTITY_TYPES) & e["name"].isNotNull()
        ).alias("entities"),
        F.col("r.relations").alias("relations"),
    ).withColumn("names", F.transform("entities", lambda e: F.lower(e["name"])))
    found = parsed.select(
        "project", "path",
        "entities",
        F.filter(
            "relations",
            lambda r: r["type"].isin(RELATION_TYPES)
            & F.array_contains("names", F.lower(r["source"]))
            & F.array_contains("names", F.lower(r["target"])),
        ).alias("relations"),
    )
    ord_ = order_key(path=F.col("path"), pos=F.col("pos")).alias("ord")
    entities = found.select("project", "path", F.posexplode("entities").alias("pos", "e")).select(
        "project", "e.name", "e.type", "e.description", F.col("path").alias("source_file"), ord_
    )
    relations = found.select("project", "path", F.posexplode("relations").alias("pos", "r")).select(
        "project", "r.source", "r.target", "r.type", F.lit(None).cast("string").alias("description"),
        F.col("path").alias("source_file"), ord_,
    )
    graph = Graph.of(entities, relations)
    if not dedupe:
        return graph
    return Graph(dedupe_entities(graph.entities), dedupe_relations(graph.relations))
