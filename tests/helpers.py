"""Small literal graphs and files."""

from pyspark.sql import Row

from graphloom.graph import Graph
from graphloom.schema import ENTITY, FILE, RELATION


def entities(spark, rows, project="p"):
    """Rows of (name, type[, description[, source_file]]), optionally led by a project."""
    out = []
    for i, row in enumerate(rows):
        row = tuple(row) + (None,) * (4 - len(row))
        out.append((project, *row, Row(gen=0, kind=0, path="", rule=0, pat=0, pos=i)))
    return spark.createDataFrame(out, ENTITY)


def relations(spark, rows, project="p"):
    """Rows of (source, type, target[, source_file])."""
    out = []
    for i, row in enumerate(rows):
        source, type_, target, *rest = row
        out.append((
            project, source, target, type_, None, rest[0] if rest else None,
            Row(gen=0, kind=0, path="", rule=0, pat=0, pos=i),
        ))
    return spark.createDataFrame(out, RELATION)


def graph(spark, ents, rels=(), project="p"):
    return Graph(entities(spark, ents, project), relations(spark, rels, project))


def join(*graphs):
    first, *rest = graphs
    e, r = first.entities, first.relations
    for g in rest:
        e, r = e.unionByName(g.entities), r.unionByName(g.relations)
    return Graph(e, r)


def files(spark, texts, project="p"):
    rows = []
    for path, content in texts.items():
        ext = path.rsplit(".", 1)[-1]
        rows.append((project, path, ext, "md" if ext == "md" else "code", content, None))
    return spark.createDataFrame(rows, FILE)


def bag(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)
