"""Conversation trie against a plain walk over lists."""

from collections import defaultdict
from hashlib import sha256
from random import Random
from zlib import crc32

import pytest
from pyspark.sql import types as T

from graphloom.llm import prefixes

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType())])


def turn_hash(role, text):
    return sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain_nodes(rows, run=100, heads=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, turn_hash(role, text), (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % heads
        base = c - (abs(c) % run) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in children[s]) or 1
        saved[s] = sum(saved[k] for k in children[s]) + ((len(members[s]) - 1) * len(s[-1][1]) if s else 0)
    return sorted(
        ((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s],
          sha256(",".join(map(str, sorted(c for c in m if built[c] == s))).encode()).hexdigest()) for s, m in members.items()),
        key=repr)


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "'extra' as depth", "1 as name", "2 as k1", "3 as pos", "4 as weight")
    return sorted(map(tuple, prefixes.nodes(frame, **options).collect()), key=repr)


ODD = [
    (0, 0, "user", "hello"), (0, 1, "bot", "hi there"), (0, 2, "user", "é\U0001f600 code points"), (0, None, None, None),
    (1, 0, "user", "own"), (1, 1, "bot", None), (1, 1, "bot", ""), (2, None, None, "x"), (2, None, "", "x"), (3, 5, "user", "short"),
    (None, 0, "user", "no id"), (150, 0, "user", "base is absent"), (150, 1, "bot", "so the first turns go"), (151, 0, "a", "b"),
    (-5, 0, "user", "negative"), (-105, 0, "user", "negative too"), (-100, 0, "user", "its base"), (-5, 0, "user", "negative"),
]


def test_odd_rows(spark):
    assert found(spark, ODD) == plain_nodes(ODD)


@pytest.mark.parametrize("rows", [[], [(None, 0, "u", "t")], [(7, 0, "user", "one")], [(123, 0, "u", "gone")]])
def test_small_tables(spark, rows):
    assert found(spark, rows) == plain_nodes(rows)


def test_random_trees(spark):
    """Few texts, so that sequences repeat, branch and end inside others."""
    rng = Random(5)
    rows = [(c, t, rng.choice("ub"), rng.choice(["x", "yy", "zzz"])) for c in range(700) for t in range(rng.choice([0, 1, 2, 2, 3, 6, 9]))]
    assert found(spark, rows) == plain_nodes(rows)
    assert found(spark, rows, run=10, heads=3) == plain_nodes(rows, 10, 3)


def test_hot_groups(spark):
    """A third of all conversations are copies, most share their first turn, one is very long."""
    rows = [(c, t, "u", f"copy {t}") for c in range(1000, 3000) for t in range(3)]
    rows += [(c, t, "u", "copy 0" if t == 0 else f"{c} {t}") for c in range(3000, 3400) for t in range(4)]
    rows += [(99_999, t, "u", f"turn {t}") for t in range(4500)]
    assert found(spark, rows) == plain_nodes(rows)


def test_long_end_lists_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 4)
    rows = [(c, t, "u", f"t{t % 3}") for c in range(0, 400) for t in range(5 + c % 11)]
    assert found(spark, rows) == plain_nodes(rows)
