"""First row per key, and inferred relations.

``min_by`` reduces every partition before the shuffle, so a key that holds a large
share of all rows sends one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.skew import split_join
from graphloom.graph import Graph
from graphloom.session import cut


def keep_one(
    df: DataFrame, keys: Sequence[Column], last: bool = False, order: str = "ord", same: Sequence[str] = (),
) -> DataFrame:
    """One whole row per key: the first (or last) by ``order``.

    Keys named in ``same`` are columns as they are. They are taken from the key, so that what is asked of them later
    is asked of the rows before they are grouped.
    """
    pick = F.max_by if last else F.min_by
    named = [*[F.col(c).alias(f"_own_{c}") for c in same], *[k.alias(f"_k{i}") for i, k in enumerate(keys)]]
    row = F.struct(*[F.col(c) for c in df.columns if c not in same])
    kept = df.groupBy(*named).agg(pick(row, order).alias("_row"))
    return kept.select(*[F.col(f"_own_{c}" if c in same else f"_row.{c}").alias(c) for c in df.columns])


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """First entity per (lower(name), type) and project."""
    return keep_one(entities, [F.lower("name")], same=["project", "type"])


def dedupe_relations(relations: DataFrame) -> DataFrame:
    """First relation per (lower(source), lower(target), type) and project."""
    return keep_one(relations, [F.lower("source"), F.lower("target")], same=["project", "type"])


def infer_relations(
    graph: Graph, source_type: str = "Framework", target_type: str = "Database", type_: str = "uses"
) -> Graph:
    """Add a relation from every entity of one type to every one of another, per project,
    unless a relation of any type already leads there.

    The pairs are the operator's result. Entities must be deduplicated; names that
    differ only in case still give one pair.
    """
    def side(kind, out):
        rows = graph.entities.where(F.col("type") == kind)
        return keep_one(rows, [F.col("project"), F.lower("name")]).select(
            "project", F.col("name").alias(out), F.col("ord").alias(f"_{out}")
        )

    # All of a project's pairs come of one key; the targets of a large project are dealt out.
    pairs = split_join(cut(side(target_type, "target")), side(source_type, "source"), ["project"])
    known = graph.relations.select(
        "project", F.lower("source").alias("_s"), F.lower("target").alias("_t")
    )
    new = (
        pairs.withColumns({"_s": F.lower("source"), "_t": F.lower("target")})
        .join(known, ["project", "_s", "_t"], "left_anti")
        .select(
            "project", "source", "target", F.lit(type_).alias("type"),
            F.lit(None).cast("string").alias("description"), F.lit("inferred").alias("source_file"),
            # After every extracted relation; targets in order, then sources.
            F.struct(
                F.col("_target.gen").alias("gen"), F.lit(9).alias("kind"),
                F.concat_ws(
                    "\u0001", "_target.path",
                    F.format_string("%06d:%06d:%012d", "_target.rule", "_target.pat", "_target.pos"),
                    "_source.path",
                ).alias("path"),
                F.col("_source.rule").alias("rule"), F.col("_source.pat").alias("pat"),
                F.col("_source.pos").alias("pos"),
            ).alias("ord"),
        )
    )
    return Graph(graph.entities, graph.relations.unionByName(new))
