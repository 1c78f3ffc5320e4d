"""Commit logs as ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The command whose output is read (fixed format).
LOG_COMMAND = "git log --format=%H|%s|%ae|%ad --date=short --numstat"


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of saved logs, one file per repository: (repo, block, line_no, line).

    The scan stays splittable. A split of a file is a block: blocks are ordered by
    their byte offset, and lines inside a block by their row number in its task, so
    (block, line_no) is the order of the file without one task reading it whole.
    """
    return spark.read.text(path).select(
        F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("repo"),
        F.col("_metadata.file_block_start").alias("block"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_no"),
        F.col("value").alias("line"),
    )
