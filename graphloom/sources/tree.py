"""Source trees as a ``files`` DataFrame, and Markdown files as documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.functions.text import file_stem, has_component, lines, strip
from graphloom.schema import CODE_EXTENSIONS, IGNORED_DIRECTORIES


def decode_content(raw: Column) -> Column:
    """Bytes to text: UTF-8, UTF-16 when a byte order mark says so, else Latin-1.

    Line ends become ``\\n`` as in any text-mode read.
    """
    head = F.hex(F.substring(raw, 1, 2))
    text = (
        F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
        .when(head.isin("FFFE", "FEFF"), F.decode(raw, "UTF-16"))
        .otherwise(F.decode(raw, "ISO-8859-1"))
    )
    return F.regexp_replace(text, "\r\n?", "\n")


def _clean(uri: Column) -> Column:
    """Plain path of a file URI."""
    return F.url_decode(F.regexp_replace(F.replace(uri, F.lit("+"), F.lit("%2B")), "^file:/*", "/"))


def _read(spark: SparkSession, paths, extensions: Sequence[str], recursive: bool) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .load(paths)
        .select(_clean(F.col("path")).alias("full"), "content")
    )


def as_files(located: DataFrame) -> DataFrame:
    """FILE rows from (project, path, content): extension, kind and hash added."""
    ext = F.regexp_extract("path", r"\.([^./\\]+)$", 1)
    return located.select(
        "project", "path", ext.alias("ext"),
        F.when(ext == "md", "md").otherwise("code").alias("kind"),
        "content", F.md5("content").alias("content_hash"),
    )


def scan_tree(
    spark: SparkSession,
    root: str,
    *,
    project: str | None = None,
    recursive: bool = True,
    extensions: Sequence[str] = ("md", *CODE_EXTENSIONS),
    ignore: Sequence[str] = tuple(IGNORED_DIRECTORIES),
) -> DataFrame:
    """Files under one root; directories named in ``ignore`` are left out."""
    base = root.rstrip("/")
    relative = F.substring_index(F.col("full"), base.split("://")[-1] + "/", -1)
    return as_files(
        _read(spark, base, extensions, recursive)
        .withColumn("path", relative)
        .where(~has_component(F.col("path"), list(ignore)))
        .select(
            F.lit(project or base.rsplit("/", 1)[-1]).alias("project"), "path",
            decode_content(F.col("content")).alias("content"),
        )
    )


def scan_projects(
    spark: SparkSession,
    roots: Sequence[str] | None = None,
    *,
    parent: str | None = None,
    recursive: bool = True,
    extensions: Sequence[str] = ("md", *CODE_EXTENSIONS),
    ignore: Sequence[str] = tuple(IGNORED_DIRECTORIES),
) -> DataFrame:
    """Files of many projects in one scan.

    Either a list of roots, or every visible subdirectory of ``parent``; the
    project is the directory's name.
    """
    if (roots is None) == (parent is None):
        raise ValueError("give either roots or parent")
    if parent is not None:
        base = parent.rstrip("/")
        glob = [base + "/[!.]*"] if recursive else [base + "/[!.]*/*"]
        rest = F.substring_index(F.col("full"), base.split("://")[-1] + "/", -1)
        project = F.substring_index(rest, "/", 1)
        path = F.substring(rest, F.length(project) + 2, F.length(rest))
        located = _read(spark, glob, extensions, recursive).select(
            project.alias("project"), path.alias("path"), "content"
        ).where(F.col("path") != "")
    else:
        bases = [r.rstrip("/") for r in roots]
        plain = [b.split("://")[-1] for b in bases]
        root = F.coalesce(
            *[F.when(F.startswith("full", F.lit(b + "/")), F.lit(b)) for b in plain]
        )
        located = (
            _read(spark, bases, extensions, recursive)
            .withColumn("root", root)
            .select(
                F.substring_index("root", "/", -1).alias("project"),
                F.substring(F.col("full"), F.length("root") + 2, F.length("full")).alias("path"),
                "content",
            )
        )
    return as_files(
        located.where(~has_component(F.col("path"), list(ignore))).select(
            "project", "path", decode_content(F.col("content")).alias("content")
        )
    )


def document_title(content: Column, path: Column, title_fallback: str = "Untitled") -> Column:
    """First line starting ``# ``; without one, a fixed word or (``stem``) the file stem."""
    first = F.try_element_at(
        F.filter(lines(content), lambda line: F.startswith(line, F.lit("# "))), F.lit(1)
    )
    fallback = file_stem(path) if title_fallback == "stem" else F.lit(title_fallback)
    return F.coalesce(strip(F.substring(first, 3, 1 << 30)), fallback)


def document_headings(content: Column) -> Column:
    """Every line starting ``#``, stripped."""
    return F.transform(
        F.filter(lines(content), lambda line: F.startswith(line, F.lit("#"))), strip
    )


def parse_documents(files: DataFrame, title_fallback: str = "Untitled") -> DataFrame:
    """(project, path, title, content, headings) of the Markdown files."""
    content = F.col("content")
    return files.where("kind = 'md'").select(
        "project", "path",
        document_title(content, F.col("path"), title_fallback).alias("title"),
        "content", document_headings(content).alias("headings"),
    )
