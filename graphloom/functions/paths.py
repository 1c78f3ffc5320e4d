"""Shortest ways through a graph of calls, from many starts at once.

Rounds are semi-naive: only what the round before found is followed. What is known is a table in buckets
by its key, and new rows are added to it where they belong, so a round moves its candidates and
never what was found before. Edges are in buckets by caller, so no round moves them either.

Long chains would take a round per call. So, unless a depth is given, what is left after PLAIN rounds goes on without the
nodes with one way in and one way out: pointer doubling finds in a logarithm of rounds how far each lies behind the last node
with a choice, and an edge with that many calls stands for the chain. Depths stay the fewest calls, which condensing
whole cycles would lose. Graphs that are no deeper never pay for it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.session import CODEC, FREED, checkpoint_dir, cut, settings

# Rounds before chains are taken out.
PLAIN = 8
# A task writes one bucket or a few, which need no sort before.
_IN_BUCKETS = FREED | {"spark.sql.maxConcurrentOutputFileWriters": "8"}


class Buckets:
    """A growing table of rows in buckets by key; every round's rows are a partition of it."""

    def __init__(self, spark: SparkSession, keys: Sequence[str]):
        self.spark, self.keys = spark, list(keys)
        self.name = f"graphloom_{uuid.uuid4().hex}"
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/{self.name}"
        self.number = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, rows: DataFrame, round_: int) -> None:
        """Rows that come from a join on the keys are in the right partitions already."""
        with settings(self.spark, _IN_BUCKETS):
            rows.withColumn("_round", F.lit(round_)).write.mode("append").option("compression", CODEC).partitionBy("_round").bucketBy(
                self.number, *self.keys).option("path", self.path).saveAsTable(self.name)

    def all(self) -> DataFrame:
        return self.spark.table(self.name)

    def round(self, round_: int) -> DataFrame:
        return self.all().where(F.col("_round") == round_).drop("_round")

    def close(self) -> DataFrame:
        """The rows as a plain table; the name is free again."""
        schema = self.all().schema
        self.spark.sql(f"drop table {self.name}")
        return self.spark.read.schema(schema).parquet(self.path)


def by_caller(edges: DataFrame) -> Buckets:
    """Distinct edges (project, caller, callee), written where every round looks them up."""
    out = Buckets(edges.sparkSession, ["project", "caller"])
    out.add(edges.select("project", "caller", "callee").repartition(out.number, *out.keys), 0)
    return out


def chains(edges: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (project, caller, callee, calls) between the nodes that stay, and (project, head, node, calls) of the others.

    Nodes with one caller and one callee that are not among ``ends`` (project, node) are taken out; they lie
    ``calls`` behind their head. Cycles that nothing leads into are left out.
    """
    edges = cut(edges.where("caller <> callee"))
    single = edges.groupBy("project", F.col("callee").alias("node")).agg(F.count("*").alias("ways"), F.min("caller").alias("before")).where(
        "ways = 1").join(
        edges.groupBy("project", F.col("caller").alias("node")).agg(F.count("*").alias("ways"), F.min("callee").alias("after")).where(
            "ways = 1"), ["project", "node"]).select("project", "node", "before", "after")
    inner = cut(single.join(ends.select("project", "node"), ["project", "node"], "left_anti"))
    names = inner.select("project", "node")
    known = inner.join(names.select("project", F.col("node").alias("before"), F.lit(True).alias("on")), ["project", "before"], "left")
    known = cut(known.select("project", "node", "after", F.col("before").alias("head"), F.lit(1).cast("long").alias("calls"), F.col("on").isNull().alias("done")))
    for _ in range(known.count().bit_length()):
        step = known.where("done").unionByName(
            known.where("not done").alias("a").join(
                known.select("project", F.col("node").alias("head"), F.col("head").alias("_head"), F.col("calls").alias("_calls"), F.col("done").alias("_done")),
                ["project", "head"],
            ).select("project", "node", "after", F.col("_head").alias("head"), (F.col("calls") + F.col("_calls")).alias("calls"), F.col("_done").alias("done")))
        known = cut(step)
        if known.where("not done").isEmpty():
            break
    known = known.where("done")
    gone = names.withColumnRenamed("node", "callee")
    # An edge into a chain goes on as an edge out of its last node.
    kept = edges.join(gone, ["project", "callee"], "left_anti").join(names.withColumnRenamed("node", "caller"), ["project", "caller"], "left_anti")
    last = known.join(names.withColumnRenamed("node", "after"), ["project", "after"], "left_anti")
    short = kept.select("project", "caller", "callee", F.lit(1).cast("long").alias("calls")).unionByName(
        last.select("project", F.col("head").alias("caller"), F.col("after").alias("callee"), (F.col("calls") + 1).alias("calls")))
    short = short.where("caller <> callee").groupBy("project", "caller", "callee").agg(F.min("calls").alias("calls"))
    return cut(short), known.select("project", "head", "node", "calls")


def distances(starts: DataFrame, edges: DataFrame | Buckets, max_depth: int | None = None) -> DataFrame:
    """(project, start, node, depth): nodes that each start leads to, itself included, and the fewest calls to them; a table.

    Starts are distinct (project, start, node), edges distinct (project, caller, callee), or these ``by_caller``.
    """
    keys = ["project", "start", "node"]
    own = None if isinstance(edges, Buckets) else by_caller(edges)
    edges = (own or edges).all().drop("_round")
    out = edges.withColumn("calls", F.lit(1).cast("long"))
    known, behind = Buckets(starts.sparkSession, keys), None
    known.add(starts.select(*keys).withColumn("depth", F.lit(0).cast("long")).repartition(known.number, *keys), 0)
    for turn in count():
        newest = known.round(turn)
        if turn == max_depth or newest.isEmpty():
            break
        if turn == PLAIN and max_depth is None:
            # Whoever goes on does so from here; a start that is found again must be seen to be one.
            ends = newest.select("project", "node").union(known.round(0).select("project", "node")).distinct()
            out, behind = chains(edges, ends)
        found = newest.withColumnRenamed("node", "caller").join(out, ["project", "caller"]).select(
            "project", "start", F.col("callee").alias("node"), (F.col("depth") + F.col("calls")).alias("depth"))
        found = found.groupBy(*keys).agg(F.min("depth").alias("depth"))
        old = known.all().select(*keys, F.col("depth").alias("_known"))
        # With chains of different lengths a way with more edges may be shorter; then the node is found once more.
        better = found.join(old, [*[found[k] == old[k] for k in keys], old["_known"] <= found["depth"]], "left_anti")
        known.add(better, turn + 1)
    rows = known.close()
    if own is not None:
        own.close()
    if behind is None:
        return rows.drop("_round")
    late = cut(rows.where(F.col("_round") >= PLAIN).groupBy(*keys).agg(F.min("depth").alias("depth")))
    inner = late.withColumnRenamed("node", "head").join(behind, ["project", "head"])
    early = rows.where(F.col("_round") < PLAIN).drop("_round")
    return cut(early.unionByName(late).unionByName(
        inner.select("project", "start", "node", (F.col("depth") + F.col("calls")).alias("depth"))))
