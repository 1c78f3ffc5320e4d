"""Merkle manifest against a plain tree of whole lists."""

from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F, types as T

from graphloom.llm import merkle
from graphloom.llm.places import placed

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("text", T.StringType())])
COLUMNS = ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def plain_tree(nodes, fan=16):
    """Root, and for each node its siblings as (left, right) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            low = k - k % fan
            paths[i].append((nodes[low:k], nodes[k + 1 : low + fan]))
        nodes = [h(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        at = [k // fan for k in at]
    return nodes[0], paths


def plain_proofs(rows):
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(sources[s])]) for s in order}
    root, tops = plain_tree([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, tops, strict=True):
        for (_, _, leaf, row), path in zip(sorted(sources[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            path = path + above
            doc_id, text = row[0], row[4]
            at = leaf
            if doc_id is not None and text is not None and crc32(str(doc_id).encode()) % 5 == 0:
                at = plain_leaf((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))
            for left, right in path:
                at = h(*left, at, *right)
            out.append((doc_id, s, leaf, trees[s][0], root, h(*(x for left, right in path for x in left + right)), at, at == root))
    return sorted(out, key=repr)


def found(frame):
    return sorted(map(tuple, frame.select(*COLUMNS).collect()), key=repr)


def test_frontier_is_the_tree_of_the_list():
    for n in [1, 2, 15, 16, 17, 32, 255, 256, 257, 300, 4096]:
        nodes = [h(str(i)) for i in range(n)]
        frontier = merkle.Frontier()
        for node in nodes:
            frontier.append(node)
        root, paths = plain_tree(nodes)
        assert frontier.close() == root
        levels = ["".join(x).encode() for x in frontier.levels]
        for i in {0, n // 2, n - 1}:
            steps = list(merkle.witness(levels, i))
            assert steps == [("".join(a).encode(), "".join(b).encode()) for a, b in paths[i]]
            assert merkle.fold(nodes[i].encode(), steps).decode() == root


def test_frontier_closes_at_a_given_height():
    frontier = merkle.Frontier()
    frontier.append(h("only"))
    assert frontier.close(3) == h(h(h(h("only"))))


ODD = [
    (1, "a", "en", 3, "ABC"), (2, "a", None, None, None), (3, None, "en", 0, ""), (None, None, None, None, None), (4, "", "en", 1, "x"),
    (5, "a", "en", 3, "-"), (5, "a", "en", 3, "-"), (5, "a", "de", 3, "other"), (6, "é", "en", 9, "Ünïcode ABC \U0001f600"),
    (7, "Z", "en", 9, "LONG text " * 20_000), (None, "a", "en", 1, "A"), (-15, "b", "en", 4, "Neg A"),
]


def test_odd_rows(spark):
    rows = ODD + [(100 + i, "many", "en", i, f"Text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "'extra' as pos", "1 as node", "2 as block", "3 as altered")
    got = found(merkle.proofs(docs))
    assert got == plain_proofs(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, "Lone")], [(i, "s", "en", 1, "X") for i in range(17)], [(1, "same", "en", 1, "Q")] * 40])
def test_small_tables(spark, rows):
    assert found(merkle.proofs(spark.createDataFrame(rows, SCHEMA))) == (plain_proofs(rows) if rows else [])


def test_blocks_of_blocks(spark):
    """With blocks of 16 leaves a source of 5,000 takes four tiers; another has a last block of one leaf."""
    rows = [(i, "hot", "en", 1, f"T{i}") for i in range(5000)] + [(i, "b", "en", 1, f"U{i}") for i in range(17)]
    rows += [(i, f"s{i % 40:02}", "en", 1, f"V{i}") for i in range(80)]
    assert found(merkle.proofs(spark.createDataFrame(rows, SCHEMA).repartition(7), depth=1)) == plain_proofs(rows)


def test_full_blocks(spark):
    """4,096 leaves are one block, 4,097 two; the second is raised to the height of the first."""
    rows = [(i, "a", "en", 1, f"T{i}") for i in range(4096)] + [(i, "b", "en", 1, f"U{i}") for i in range(4097)]
    assert found(merkle.proofs(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain_proofs(rows)


def test_witnesses_fold(spark):
    rows = [(i, f"s{i % 3}", "en", 1, f"Text {i}") for i in range(100)]
    for row in merkle.proofs(spark.createDataFrame(rows, SCHEMA), steps=True).collect():
        at = row["leaf"]
        for before, after in zip(row["before"], row["after"], strict=True):
            at = h(before, at, after)
        assert at == row["root"] and h(*(b + a for b, a in zip(row["before"], row["after"], strict=True))) == row["proof_sha256"]


def test_places(spark):
    """Groups that span partitions, null groups, ties."""
    rows = [(None if i % 5 == 0 else "hot" if i % 2 else f"g{i % 40}", i % 97) for i in range(6000)]
    got = placed(spark.createDataFrame(rows, "g string, v long").repartition(9), ["g"], ["v"], "at").collect()
    groups = defaultdict(list)
    for r in got:
        groups[r["g"]].append((r["at"], r["v"]))
    assert len(got) == 6000
    for items in groups.values():
        items.sort()
        assert [a for a, _ in items] == list(range(len(items)))
        assert [v for _, v in items] == sorted(v for _, v in items)
    empty = spark.createDataFrame([], "g string, v long")
    assert placed(empty, ["g"], ["v"], "at").where(F.lit(True)).collect() == []
