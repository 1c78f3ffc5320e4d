"""Knowledge graphs over source trees, as Spark DataFrames."""

from graphloom.graph import Graph

__all__ = ["Graph"]
