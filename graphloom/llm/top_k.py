"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by falling length and cut into buckets; queries are cut into blocks. Against a
bounded sample of the longest vectors every query gets a threshold its k-th best score cannot be
under. In a bucket this becomes a local cosine threshold: threshold / (query length x longest
length in the bucket). Over 1, the bucket holds nothing for the query; where it is high, vectors are
pruned by the query's strongest coordinates (a unit vector near enough to the query must have
coordinates in a known range), else by length alone. What is left is verified by its exact integer
product.

Buckets and blocks are rows of about a megabyte. They meet by length class (an eighth of an octave) and a
salt within the class, so one class with all vectors is still many tasks; blocks only
enter classes long enough for one of their queries. A pair of bucket and block returns its
k best per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.common import stage
from graphloom.llm.neighbours import common_width, matrix, ranked

BUCKET = 2048
BLOCK = 512
SAMPLE = 4096
# Buckets of a class that share a salt.
PER_SALT = 2
# From this local cosine on, coordinates prune more than they cost.
COORDINATE_FROM = 0.3
FOCUS = 3
_SLACK = 1e-9
_EXACT = 2.0**53


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v, norm): components floor(scale x), of the usable rows."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    vectors = common_width(vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    return vectors.select("vec_id", v.alias("v")).withColumn("norm", length)


def _class(norm: np.ndarray) -> np.ndarray:
    """Length class: eighths of octaves; the lowest for length 0."""
    out = np.full(len(norm), -(1 << 14), np.int64)
    some = norm > 0
    out[some] = np.floor(8 * np.log2(norm[some])).astype(np.int64)
    return out


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All inner products as exact integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if bound < _EXACT:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q @ v.T


def _k_best(q: np.ndarray, v: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Of pairs (query number, row, score), the places of the k best per query, ties to smaller ids."""
    order = np.lexsort((ids[v], -scores, q))
    q = q[order]
    within = np.arange(len(q)) - np.searchsorted(q, q)
    return order[within < k]


def thresholds(q: np.ndarray, q_ids: np.ndarray, sample: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """A score that k sample rows other than the query's own reach; minus infinity if there are not so many."""
    if len(ids) < k:
        return np.full(len(q), -np.inf)
    scores = products(q, sample).astype(np.float64)
    scores[q_ids[:, None] == ids] = -np.inf
    return np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]


def candidates(q: np.ndarray, theta: np.ndarray, v: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Pairs (query x row) of a bucket that no pruning excludes."""
    q_norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where((q_norm > 0) & (theta > 0), theta / q_norm, -np.inf)
        local = need / max(float(norms.max(initial=0)), 1e-300)
        unit_q = np.where(q_norm[:, None] > 0, q / q_norm[:, None], 0)
        unit_v = np.where(norms[:, None] > 0, v / norms[:, None], 0)
    out = norms >= need[:, None] * (1 - _SLACK)
    out[local > 1 + _SLACK] = False
    by_coordinate = np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1 + _SLACK))
    if len(by_coordinate):
        t = np.minimum(local[by_coordinate], 1)
        strongest = np.argsort(-np.abs(unit_q[by_coordinate]), axis=1, kind="stable")[:, :FOCUS]
        for f in strongest.T:
            x = unit_q[by_coordinate, f]
            reach = np.sqrt(1 - t * t) * np.sqrt(np.maximum(1 - x * x, 0)) + _SLACK
            # The range of a coordinate over unit vectors with cosine t or more to the query.
            low = np.where(-x >= t, -1.0, t * x - reach)
            high = np.where(x >= t, 1.0, t * x + reach)
            column = unit_v[:, f].T
            out[by_coordinate] &= (column >= low[:, None] - _SLACK) & (column <= high[:, None] + _SLACK)
    return out


def _buckets(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, count = TaskContext.get().partitionId(), 0, [], 0

        def pack(table: pa.Table) -> pa.RecordBatch:
            nonlocal number
            norms = np.asarray(table.column("norm"))
            number += 1
            return pa.RecordBatch.from_pylist([{
                "bucket": part << 32 | number, "class": int(_class(norms[:1])[0]),
                "ids": np.asarray(table.column("vec_id"), "<i8").tobytes(),
                "v": matrix(table.column("v"), np.int64).astype("<i8").tobytes(), "norms": norms.astype("<f8").tobytes(),
            }], _BUCKET)

        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= rows:
                table = pa.Table.from_batches(held).combine_chunks()
                while len(table) >= rows:
                    yield pack(table.slice(0, rows).combine_chunks())
                    table = table.slice(rows)
                held, count = table.combine_chunks().to_batches(), len(table)
        if count:
            yield pack(pa.Table.from_batches(held).combine_chunks())

    return run


_BUCKET = pa.schema([("bucket", pa.int64()), ("class", pa.int64()), ("ids", pa.binary()), ("v", pa.binary()), ("norms", pa.binary())])


def _blocks(sample: np.ndarray, sample_ids: np.ndarray, classes: dict[int, int], k: int, rows: int):
    """Blocks of queries with thresholds, once for each class and salt they have to enter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), rows):
                part = batch.slice(low, rows)
                ids, q = np.asarray(part.column("vec_id")), matrix(part.column("v"), np.int64)
                theta = thresholds(q, ids, sample, sample_ids, k)
                norm = np.asarray(part.column("norm"))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where((norm > 0) & (theta > 0), theta / norm * (1 - _SLACK), 0).min()
                least = int(_class(np.array([need]))[0]) - 1
                row = {"q_ids": ids.astype("<i8").tobytes(), "q": q.astype("<i8").tobytes(), "theta": theta.astype("<f8").tobytes()}
                for c, salts in classes.items():
                    if c >= least:
                        for salt in range(salts):
                            yield pa.RecordBatch.from_pylist([row | {"class": c, "salt": salt}], _BLOCK)

    return run


_BLOCK = pa.schema([("class", pa.int64()), ("salt", pa.int64()), ("q_ids", pa.binary()), ("q", pa.binary()), ("theta", pa.binary())])


def _verify(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                v = np.frombuffer(row["v"], "<i8").reshape(len(ids), -1)
                q = np.frombuffer(row["q"], "<i8").reshape(len(q_ids), -1)
                theta = np.frombuffer(row["theta"], "<f8")
                left = candidates(q, theta, v, np.frombuffer(row["norms"], "<f8")) & (q_ids[:, None] != ids)
                at, to = np.nonzero(left)
                if len(at) * 20 < left.size:
                    scores = np.concatenate([(q[at[i : i + 65536]] * v[to[i : i + 65536]]).sum(1) for i in range(0, len(at), 65536)]
                                            or [np.zeros(0, np.int64)])
                else:
                    scores = products(q, v)[at, to]
                good = scores >= theta[at]
                at, to, scores = at[good], to[good], scores[good]
                keep = _k_best(at, to, ids, scores, k)
                yield pa.record_batch({
                    "query_id": pa.array(q_ids[at[keep]]), "vec_id": pa.array(ids[to[keep]]), "score": pa.array(scores[keep], pa.int64()),
                })

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer products of each query with the other rows, exactly.

    Both frames have vec_id and embedding; components become floor(scale x). Ties go to the smaller
    vec_id; a query's own id is no candidate of it. Rows that are null or empty, hold a null or
    non-finite component, lack an id or have not the usual length take no part; zero vectors do.
    Rows with equal vec_id are candidates each and one query. Empty tables give none. Products
    of components beyond 2**26 are taken in 64-bit integers, as Spark's own are.
    """
    spark = vectors.sparkSession
    rows = stage(quantized(vectors, scale))
    longest = rows.orderBy(F.desc("norm"), "vec_id").limit(SAMPLE).collect()
    sample_ids = np.array([r["vec_id"] for r in longest], np.int64)
    width = len(longest[0]["v"]) if longest else 0
    sample = np.array([r["v"] for r in longest], np.int64).reshape(len(longest), width)
    ranged = rows.repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    buckets = stage(ranged.mapInArrow(_buckets(BUCKET), "bucket long, class long, ids binary, v binary, norms binary"))
    classes = {r["class"]: -(-r["n"] // PER_SALT) for r in buckets.groupBy("class").agg(F.count("*").alias("n")).collect()}
    asked = quantized(queries, scale).where(F.size("v") == width).dropDuplicates(["vec_id"])
    blocks = asked.mapInArrow(
        _blocks(sample, sample_ids, classes, k, BLOCK), "class long, salt long, q_ids binary, q binary, theta binary")
    salts = spark.createDataFrame([(c, n) for c, n in classes.items()] or [(0, 1)], "class long, salts long")
    salted = buckets.join(F.broadcast(salts), "class").withColumn("salt", F.pmod(F.xxhash64("bucket"), F.col("salts")).cast("long"))
    met = salted.join(blocks, ["class", "salt"]).select("ids", "v", "norms", "q_ids", "q", "theta")
    found = met.mapInArrow(_verify(k), "query_id long, vec_id long, score long")
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")
