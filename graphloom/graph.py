"""The graph: two DataFrames that travel together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.schema import ENTITY, RELATION


@dataclass(frozen=True)
class Graph:
    """Entities and relations of any number of projects."""

    entities: DataFrame
    relations: DataFrame

    @classmethod
    def of(cls, entities: DataFrame, relations: DataFrame) -> Graph:
        """Graph from frames holding at least the schema's columns."""
        return cls(
            entities.select(*ENTITY.fieldNames()), relations.select(*RELATION.fieldNames())
        )

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(spark.createDataFrame([], ENTITY), spark.createDataFrame([], RELATION))

    @property
    def spark(self) -> SparkSession:
        return self.entities.sparkSession

    def where(self, condition: Column | str) -> Graph:
        """Both frames filtered on a condition over shared columns such as ``project``."""
        return Graph(self.entities.where(condition), self.relations.where(condition))

    def project(self, name: str) -> Graph:
        return self.where(F.col("project") == name)

    def with_entities(self, change: Callable[[DataFrame], DataFrame]) -> Graph:
        return Graph(change(self.entities), self.relations)

    def with_relations(self, change: Callable[[DataFrame], DataFrame]) -> Graph:
        return Graph(self.entities, change(self.relations))
