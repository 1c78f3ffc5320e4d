"""Approximate nearest neighbours by largest inner product: a k-means tree searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` vectors): k-means with ``BRANCH`` centres, again
within each centre's vectors, until a node has at most ``LEAF`` of them. It has at most
SAMPLE / LEAF * BRANCH nodes and is sent to every task. Every vector of the table is put
into a leaf. A query walks the tree with a priority queue, always into the node whose centre has
the largest inner product with it plus a quarter of what the node's mean radius allows, and
visits leaves in that order, until they hold enough rows, and k besides its own at least.

How many vectors a query visits is calibrated: ``PROBES`` queries are also answered exactly over all
rows, and the visited share of the table is widened until ``RECALL`` of their neighbours
are found (all leaves in the last resort).

Neighbouring leaves form a shard of about ``CHUNK`` rows. A query travels once to each shard it has
leaves in, with their numbers. A larger shard, such as a leaf with a third of all rows, is cut into chunks,
and the queries of a shard into blocks of about ``QUERY_BLOCK``, so groups stay small. A
group returns its best for each query only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.llm.common import stage

SAMPLE = 16_384
BRANCH = 8
LEAF = 64
PROBES = 96
RECALL = 0.94
CHUNK = 4096
QUERY_BLOCK = 2048
_SLACK = 1e-9
# Pairs of vectors multiplied at a time.
_PAIRS = 1 << 15


def usable(vector: str = "embedding") -> Column:
    """A vector with finite components, not all zero."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0)


def common_width(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The vectors of the most frequent length, of ties the shortest; others cannot be compared with them."""
    sizes = vectors.groupBy(F.size(vector).alias("width")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), "width").first()
    return vectors.where(F.size(vector) == (first["width"] if first else 0))


def matrix(column: pa.Array | pa.ChunkedArray | pd.Series, dtype: type = np.float64) -> np.ndarray:
    """Rows of a list column without nulls."""
    if isinstance(column, pd.Series):
        return np.array(column.tolist(), dtype).reshape(len(column), -1)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


# --- the tree ---------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """Centres and mean radii of all nodes, the children of inner ones, and the leaves' numbers."""

    centres: np.ndarray
    radii: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf each vector falls into, by nearest centres from the root."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf[node]
                continue
            nearest = _nearest(x[rows], self.centres[below])
            todo += [(child, rows[nearest == k]) for k, child in enumerate(below) if (nearest == k).any()]
        return out

    def visits(self, query: np.ndarray, sizes: np.ndarray, share: float, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order until they hold ``share`` of all rows, and ``least`` rows."""
        bound = self.centres @ query + self.radii * np.sqrt(query @ query) / 4
        wanted, held, out = max(share * sizes.sum(), least), 0, []
        queue = [(-bound[0], 0)]
        while queue and held < wanted:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                leaf = int(self.leaf[node])
                if sizes[leaf]:
                    out.append(leaf)
                    held += sizes[leaf]
            for child in self.children[node]:
                heapq.heappush(queue, (-bound[child], child))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = _nearest(x, centres)
        centres = np.stack([x[label == i].mean(0) if (label == i).any() else centres[i] for i in range(k)])
    return centres


def grow(x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 11) -> Tree:
    """Tree over a sample of vectors."""
    rng = np.random.default_rng(seed)
    centres, radii, children, leaf_of, leaves = [], [], [], [], 0
    todo: list[tuple[np.ndarray, int]] = [(np.arange(len(x)), -1)]
    for rows, parent in todo:
        node, own = len(centres), x[rows]
        centre = own.mean(0) if len(own) else np.zeros(x.shape[1])
        centres.append(centre)
        radii.append(np.sqrt(((own - centre) ** 2).sum(1)).mean() if len(own) else 0.0)
        children.append([])
        if parent >= 0:
            children[parent].append(node)
        parts = []
        if len(rows) > leaf:
            label = _nearest(own, _k_means(own, branch, rng))
            parts = [rows[label == i] for i in range(branch) if (label == i).any()]
        if len(parts) > 1:
            leaf_of.append(-1)
            todo += [(part, node) for part in parts]
        else:
            leaf_of.append(leaves)
            leaves += 1
    return Tree(np.array(centres), np.array(radii), children, np.array(leaf_of), leaves)


# --- answering -----------------------------------------------------------------------


_FOUND = {"query_id": "int64", "vec_id": "int64", "score": "float64"}


def _top(scores: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best per row of ``scores`` (minus infinity: no candidate) but the query itself, ties to smaller ids."""
    scores[query_ids[:, None] == ids] = -np.inf
    n = min(k, len(x))
    least = np.partition(scores, len(x) - n, axis=1)[:, len(x) - n]
    least = np.where(np.isfinite(least), least - _SLACK * np.maximum(1, np.abs(least)), -np.inf)
    q, v = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    # Products of one pair come out the same wherever it is met: the last digits decide ties.
    exact = np.empty(len(q))
    for i in range(0, len(q), _PAIRS):
        exact[i : i + _PAIRS] = (queries[q[i : i + _PAIRS]] * x[v[i : i + _PAIRS]]).sum(1)
    order = np.lexsort((ids[v], -exact, q))
    q, v, exact = q[order], v[order], exact[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return pd.DataFrame({"query_id": query_ids[q[keep]], "vec_id": ids[v[keep]], "score": exact[keep]})


def best(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of all of ``x`` for each query."""
    parts = [_top(queries[i : i + 512] @ x.T, queries[i : i + 512], query_ids[i : i + 512], x, ids, k)
             for i in range(0, len(queries), 512)]
    return pd.concat(parts)


def _exact(queries: np.ndarray, ids: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            found = best(queries, ids, matrix(batch.column("embedding")), np.asarray(batch.column("vec_id")), k)
            leaf = pd.Series(np.asarray(batch.column("leaf")), index=np.asarray(batch.column("vec_id")))
            found["leaf"] = leaf[~leaf.index.duplicated()].loc[found["vec_id"]].to_numpy()
            held = found if held is None else pd.concat([held, found])
            held = held.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
            held = held[held.groupby("query_id").cumcount() < k]
        if held is not None:
            yield pa.RecordBatch.from_pandas(held, preserve_index=False)

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, numbered from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrate(placed: DataFrame, queries: DataFrame, tree: Tree, sizes: np.ndarray, k: int,
              recall: float = RECALL, probes: int = PROBES) -> float:
    """The least share of the table, of a widening series, whose visits find ``recall`` of the exact neighbours."""
    chosen = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(probes).collect()
    if not chosen:
        return 1.0
    ids = np.array([r["vec_id"] for r in chosen])
    x = np.array([r["embedding"] for r in chosen], np.float64)
    found = placed.mapInArrow(_exact(x, ids, k), "query_id long, vec_id long, score double, leaf long")
    truth = ranked(found, k).groupBy("query_id").agg(F.collect_list("leaf").alias("leaves")).collect()
    at = {int(i): q for i, q in zip(ids, x, strict=True)}
    share = max(k / max(int(sizes.sum()), 1), 1 / 256)
    while share < 1:
        hits = total = 0
        for r in truth:
            seen = set(tree.visits(at[r["query_id"]], sizes, share, k + 1))
            hits += sum(leaf in seen for leaf in r["leaves"])
            total += len(r["leaves"])
        if hits >= recall * total:
            return share
        share *= 1.1
    return 1.0


def _assign(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield batch.append_column("leaf", pa.array(tree.assign(matrix(batch.column("embedding"))), pa.int64()))

    return run


def _walk(tree: Tree, sizes: np.ndarray, share: float, shard: np.ndarray, k: int):
    """Each query once for every shard it visits leaves of, with these leaves; they hold k rows besides its ``own``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"))
            row, shards, leaves = [], [], []
            for i, (q, own) in enumerate(zip(x, batch.column("own").to_pylist(), strict=True)):
                visits = np.sort(np.array(tree.visits(q, sizes, share, k + own), np.int64))
                for part in np.split(visits, np.flatnonzero(np.diff(shard[visits])) + 1):
                    if len(part):
                        row.append(i)
                        shards.append(int(shard[part[0]]))
                        leaves.append(part)
            taken = pa.array(row, pa.int64())
            yield pa.record_batch({
                "query_id": batch.column("vec_id").take(taken), "query": batch.column("embedding").take(taken),
                "shard": pa.array(shards, pa.int64()), "leaves": pa.array(leaves, pa.list_(pa.int64())),
            })

    return run


def _answer(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({c: pd.Series(dtype=t) for c, t in _FOUND.items()})]
        vectors = vectors.sort_values("leaf", kind="stable")
        leaf, ids = vectors["leaf"].to_numpy(), vectors["vec_id"].to_numpy()
        x = matrix(vectors["embedding"]) if len(vectors) else np.zeros((0, 0))
        here = np.unique(leaf)
        bounds = np.append(np.searchsorted(leaf, here), len(leaf))
        for low in range(0, len(queries) if len(vectors) else 0, 512):
            block = queries.iloc[low : low + 512]
            q = matrix(block["query"])
            visited = np.concatenate([np.asarray(v, np.int64) for v in block["leaves"]])
            by = np.repeat(np.arange(len(block)), [len(v) for v in block["leaves"]])
            order = np.argsort(visited, kind="stable")
            visited, by = visited[order], by[order]
            scores = np.full((len(block), len(x)), -np.inf)
            for i, number in enumerate(here):
                rows = by[np.searchsorted(visited, number) : np.searchsorted(visited, number, side="right")]
                span = slice(bounds[i], bounds[i + 1])
                scores[rows, span] = q[rows] @ x[span].T
            parts.append(_top(scores, q, block["query_id"].to_numpy(), x, ids, k))
        return pd.concat(parts).astype(_FOUND)

    return run


@dataclass(frozen=True)
class Index:
    """Every vector with its leaf, the tree, and rows per leaf."""

    placed: DataFrame
    tree: Tree
    sizes: np.ndarray


def build(vectors: DataFrame, sample: int = SAMPLE) -> Index:
    """Index of all usable rows of ``vectors`` (vec_id, embedding)."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    vectors = common_width(vectors.where("vec_id is not null").where(usable()))
    chosen = vectors.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    rows = vectors.join(F.broadcast(chosen.distinct()), "vec_id").select("vec_id", "embedding").collect()
    rows.sort(key=lambda r: r["vec_id"])
    x = np.array([r["embedding"] for r in rows], np.float64)[:sample] if rows else np.zeros((0, 1))
    tree = grow(x)
    placed = stage(vectors.mapInArrow(_assign(tree), "vec_id long, embedding array<double>, leaf long"))
    sizes = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    return Index(placed, tree, sizes)


def search(index: Index, queries: DataFrame, k: int = 20, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of ``queries`` (vec_id, embedding), itself left out.

    Nearness is the inner product in double precision, ties go to the smaller vec_id. ``share`` of the
    table is visited; None calibrates it. Vectors that are null, empty, all zero, hold a null
    or non-finite component, lack an id or have not the usual length take no part. Rows with
    equal vec_id are candidates each, but none for a query of that id. Empty tables give none.
    """
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    queries = queries.where("vec_id is not null").where(usable()).where(F.size("embedding") == index.tree.centres.shape[1])
    queries = queries.dropDuplicates(["vec_id"])
    share = calibrate(index.placed, queries, index.tree, index.sizes, k) if share is None else share
    shard = np.cumsum(index.sizes) // CHUNK
    _, shard = np.unique(shard, return_inverse=True)
    rows = np.bincount(shard, weights=index.sizes).astype(np.int64)
    walk = _walk(index.tree, index.sizes, share, shard, k)
    # Rows of a query's own id are no candidates, so they do not count among those visited.
    own = index.placed.groupBy("vec_id").agg(F.count("*").alias("own"))
    queries = queries.join(own, "vec_id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    asked = stage(queries.mapInArrow(walk, "query_id long, query array<double>, shard long, leaves array<long>"))
    visitors = np.zeros(len(rows), np.int64)
    for r in asked.groupBy("shard").agg(F.count("*").alias("n")).collect():
        visitors[r["shard"]] = r["n"]

    def at(numbers: np.ndarray, column: str) -> Column:
        return F.element_at(F.lit(numbers.tolist()), (F.col(column) + 1).cast("int"))

    def upto(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1))

    chunks, blocks = np.maximum(-(-rows // CHUNK), 1), np.maximum(-(-visitors // QUERY_BLOCK), 1)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), at(blocks, "shard")).cast("long"))
    asked = asked.withColumn("chunk", upto(at(chunks, "shard")))
    held = index.placed.withColumn("shard", at(shard, "leaf").cast("long"))
    held = held.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), at(chunks, "shard")).cast("long"))
    held = held.withColumn("block", upto(at(blocks, "shard")))
    key = ["shard", "chunk", "block"]
    found = held.groupBy(*key).cogroup(asked.groupBy(*key))
    found = found.applyInPandas(_answer(k), "query_id long, vec_id long, score double")
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")
