"""Graphs kept as a log: an update writes the rows it changes, readers see whole generations.

``generation=N`` folders hold the rows that a commit put in or took out, by project. A commit counts once its line stands in
``commits``, so a write that broke off is not seen and its number is used again. A snapshot is the last base up
to a generation, without the rows that later deltas name, and the latest state of these. ``compact``
writes a snapshot as a new base; ``vacuum`` deletes what no snapshot from the last base on needs.

A row is known by its project, place (``ord``) and the key it is upserted by; a row that is replaced keeps all of them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from graphloom.graph import Graph
from graphloom.schema import ENTITY, RELATION
from graphloom.session import cut

_SIDES = {"entities": (ENTITY, ["name"], ["type"]), "relations": (RELATION, ["source", "target"], ["type"])}


class Delta(NamedTuple):
    """Rows of both sides with ``gone``: false puts a row in, true takes it out."""

    entities: DataFrame
    relations: DataFrame


class Commit(NamedTuple):
    generation: int
    base: bool


def _identity(side: str) -> list:
    _, folded, plain = _SIDES[side]
    return [F.col("project"), F.col("ord"), *[F.lower(c).alias(f"_{c}") for c in folded], *[F.col(c).alias(f"_{c}") for c in plain]]


def _keyed(rows: DataFrame, side: str) -> DataFrame:
    _, folded, plain = _SIDES[side]
    return rows.withColumns({f"_{c}": F.lower(c) for c in folded} | {f"_{c}": F.col(c) for c in plain})


def _keys(side: str) -> list[str]:
    _, folded, plain = _SIDES[side]
    return ["project", "ord", *[f"_{c}" for c in [*folded, *plain]]]


class GraphStore:
    """A graph under a path, with its history."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # A line per commit; compaction and vacuum keep them few.
    def commits(self) -> list[Commit]:
        """Committed generations, oldest first."""
        if not self._exists(f"{self.path}/commits"):
            return []
        lines = self.spark.read.schema("generation int, base boolean").json(f"{self.path}/commits")
        return [Commit(*r) for r in lines.orderBy("generation").collect()]

    def create(self, graph: Graph) -> int:
        """Begin with a whole graph."""
        return self._write(Delta(*(f.withColumn("gone", F.lit(False)) for f in (graph.entities, graph.relations))), True)

    def commit(self, delta: Delta) -> int:
        """Add a generation with the rows of an update."""
        return self._write(delta, False)

    def compact(self) -> int:
        """Write the present state as a base."""
        return self.create(self.snapshot())

    def vacuum(self) -> None:
        """Delete generations before the last base; snapshots of them can no longer be read."""
        found = self.commits()
        last = max((c.generation for c in found if c.base), default=0)
        for c in found:
            if c.generation < last:
                for side in _SIDES:
                    self._delete(f"{self.path}/{side}/generation={c.generation}")

    def snapshot(self, generation: int | None = None) -> Graph:
        """The graph as of a generation, by default the last one."""
        found = [c for c in self.commits() if generation is None or c.generation <= generation]
        base = max((c.generation for c in found if c.base), default=None)
        if base is None:
            if generation is not None and not found:
                raise ValueError(f"no generation up to {generation}")
            return Graph.empty(self.spark)
        later = [c.generation for c in found if c.generation > base]
        return Graph.of(*(self._side(side, base, later) for side in _SIDES))

    def changed(self, generation: int) -> Delta:
        """The rows that one generation put in or took out."""
        return Delta(*(self._read(side, [generation]).drop("generation") for side in _SIDES))

    def _side(self, side: str, base: int, later: list[int]) -> DataFrame:
        rows = self._read(side, [base]).drop("generation", "gone")
        if not later:
            return rows
        names = _SIDES[side][0].fieldNames()
        keys = _keys(side)
        delta = _keyed(self._read(side, later), side)
        latest = delta.groupBy(*keys).agg(F.max_by(F.struct(*names, "gone"), "generation").alias("row"))
        kept = _keyed(rows, side).join(delta.select(*keys).distinct(), keys, "left_anti").select(*names)
        return kept.unionByName(latest.where("not row.gone").select("row.*").drop("gone"))

    def _read(self, side: str, generations: list[int]) -> DataFrame:
        schema = T.StructType([*_SIDES[side][0].fields, T.StructField("gone", T.BooleanType()), T.StructField("generation", T.IntegerType())])
        folders = [f"{self.path}/{side}/generation={g}" for g in generations]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{side}").parquet(*folders)

    def _write(self, delta: Delta, base: bool) -> int:
        generation = max((c.generation for c in self.commits()), default=-1) + 1
        for side, rows in zip(_SIDES, delta):
            names = [*_SIDES[side][0].fieldNames(), "gone"]
            rows.select(*names).hint("rebalance", "project").write.mode("overwrite").partitionBy("project").parquet(
                f"{self.path}/{side}/generation={generation}")
        line = self.spark.range(1).select(F.lit(generation).alias("generation"), F.lit(base).alias("base"))
        line.coalesce(1).write.mode("append").json(f"{self.path}/commits")
        return generation

    def _exists(self, path: str) -> bool:
        return self._files(path)[0].exists(self._files(path)[1])

    def _delete(self, path: str) -> None:
        files, at = self._files(path)
        files.delete(at, True)

    def _files(self, path: str):
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def upsert_delta(graph: Graph, new: Graph, gone: DataFrame | None = None, generation: int = 1) -> Delta:
    """What removing the rows of the files in ``gone`` (project, path) and then upserting ``new`` changes in a graph.

    Old rows are read for the projects concerned only; the rest of the graph takes no part.
    """
    out = []
    for side, old, fresh in (("entities", graph.entities, new.entities), ("relations", graph.relations, new.relations)):
        schema, folded, plain = _SIDES[side]
        names = [c for c in schema.fieldNames() if c != "ord"]
        keys = ["project", *[f"_{c}" for c in [*folded, *plain]]]
        removed = None
        if gone is not None:
            files = gone.select("project", F.col("path").alias("source_file")).distinct()
            removed = old.join(files, ["project", "source_file"], "left_semi").withColumn("gone", F.lit(True))
            old = old.join(files, ["project", "source_file"], "left_anti")
        # Of several new rows of a key the last one counts, at the place of the first.
        wanted = _keyed(fresh, side).groupBy(*keys).agg(F.max_by(F.struct(*names), "ord").alias("_new"), F.min("ord").alias("_at"))
        wanted = cut(wanted)
        touched = _keyed(old.join(wanted.select("project").distinct(), "project", "left_semi"), side)
        last = touched.join(wanted.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.max("ord").alias("ord"))
        put = wanted.join(last, keys, "left").select(
            *[F.col(f"_new.{c}").alias(c) for c in names],
            F.coalesce("ord", F.col("_at").withField("gen", F.lit(generation))).alias("ord"), F.lit(False).alias("gone"))
        put = put.select(*schema.fieldNames(), "gone")
        out.append(put if removed is None else put.unionByName(removed.select(*schema.fieldNames(), "gone")))
    return Delta(*out)
