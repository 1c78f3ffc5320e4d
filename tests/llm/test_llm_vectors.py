"""Nearest neighbours and exact top-k against brute force."""

import numpy as np
import pytest

from graphloom.llm import neighbours, top_k
from graphloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, score string"


def odd_vectors():
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist(), "x") for i in range(300)]
    same = rows[0][1]
    rows += [(300 + i, same, "x") for i in range(40)] + [(20, same, "x"), (21, rows[21][1], "x")]
    rows += [(400, None, "x"), (401, [], "x"), (402, [0.0] * 6, "x"), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"),
             (404, [float("nan")] + [0.0] * 5, "x"), (405, [float("inf")] + [0.0] * 5, "x"), (406, [1.0, 2.0], "x"), (None, same, "x")]
    return rows


def plain(rows, k, value, zero):
    """Every query's k best by (score, id), from plain sums."""
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows
            if i is not None and v and len(v) == 6 and None not in v and np.isfinite(v).all() and (zero or any(v))]
    out = {}
    for i in sorted({i for i, _ in good if i % 20 == 0}):
        q = next(v for j, v in good if j == i)
        scores = sorted((-value(q, v), j) for j, v in good if j != i)[:k]
        out[i] = [(j, -s) for s, j in scores]
    return out


def by_query(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_top_k_is_exact(spark):
    rows = [(i, v, s) for i, v, s in odd_vectors() if (i, v) != (20, odd_vectors()[0][1])]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = by_query(top_k.top_k(frame, frame.where("vec_id % 20 = 0"), 7))
    assert got == plain(rows, 7, lambda a, b: int(np.floor(64 * a) @ np.floor(64 * b)), zero=True)


def test_top_k_of_unlike_lengths(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BUCKET", 50)
    monkeypatch.setattr(top_k, "BLOCK", 7)
    monkeypatch.setattr(top_k, "SAMPLE", 40)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * rng.lognormal(0, 1.5)).astype(np.float32).tolist(), "x") for i in range(1000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = by_query(top_k.top_k(frame, frame.where("vec_id % 20 = 0"), 10))
    assert got == plain(rows, 10, lambda a, b: int(np.floor(64 * a) @ np.floor(64 * b)), zero=True)


def test_pruning_excludes_no_answer():
    rng = np.random.default_rng(6)
    for spread in (0.0, 1.0):
        v = np.floor(64 * rng.normal(size=(400, 5)) * np.exp(spread * rng.normal(size=(400, 1)))).astype(np.int64)
        q = v[rng.choice(400, 60)]
        norms = np.sqrt((v.astype(float) ** 2).sum(1))
        scores = q @ v.T
        theta = np.sort(scores, axis=1)[:, -5].astype(float)
        left = top_k.candidates(q, theta, v, norms)
        assert left[scores >= theta[:, None]].all() and left.mean() < 0.5


def test_all_leaves_are_exact(spark):
    rows = [r for r in odd_vectors() if r[0] != 20 or r[1] != odd_vectors()[0][1]]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = neighbours.build(frame, sample=200)
    got = by_query(neighbours.search(index, frame.where("vec_id % 20 = 0"), 7, share=1.0))
    want = plain(rows, 7, lambda a, b: float((a * b).sum()), zero=False)
    assert got.keys() == want.keys()
    for q, found in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in found]
        assert np.allclose([s for _, s in got[q]], [s for _, s in found], rtol=0, atol=1e-12)


def test_recall(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = by_query(QUERIES["op3_nearest_neighbours"](spark, SF))
    hits = 0
    for q, found in got.items():
        scores = x @ x[ids == q][0]
        scores[ids == q] = -np.inf
        hits += len({i for i, _ in found} & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
    assert len(got) == (ids % 20 == 0).sum() and hits >= 0.9 * 20 * len(got)


def test_visits_widen(spark):
    x = np.random.default_rng(1).normal(size=(2000, 8))
    tree = neighbours.grow(x)
    sizes = np.bincount(tree.assign(x), minlength=tree.leaves)
    few, more = tree.visits(x[0], sizes, 0.1), tree.visits(x[0], sizes, 0.5)
    assert more[: len(few)] == few and sizes[few].sum() >= 0.1 * 2000
    assert sorted(tree.visits(x[0], sizes, 1.0)) == np.flatnonzero(sizes).tolist()


@pytest.mark.parametrize("where", ["false", "vec_id in (400, 402)", "vec_id = 0"])
def test_empty_and_single(spark, where):
    frame = spark.createDataFrame(odd_vectors(), SCHEMA).where(where)
    assert neighbours.search(neighbours.build(frame), frame, 5).count() == 0
    assert top_k.top_k(frame, frame, 5).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_tight_clusters_give_all_neighbours(spark, seed):
    """Clusters of 20: the nearest leaf may hold a query and 19 others, which is one too few."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, 16)) * 8
    x = np.repeat(centres, 20, 0) + rng.normal(size=(1200, 16)) * 0.01
    rows = [(i, [float(v) for v in row], "more") for i, row in enumerate(x)] + [(40, [float(v) for v in x[40]], "again")] * 3
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, own string")
    index = neighbours.build(vectors)
    for share in (None, 1e-9):
        got = neighbours.search(index, vectors.where("vec_id % 20 = 0"), 20, share).groupBy("query_id").count().collect()
        assert len(got) == 60 and {r["count"] for r in got} == {20}
