"""Automata against plain search, and the joins on them on both of their ways."""

import re
from random import Random

import numpy as np
import pytest
from helpers import bag, entities, graph

from graphloom.functions import automaton, grams
from graphloom.functions.automaton import Automaton, blocks_of
from graphloom.operators.lookup import search_keywords

ODD = ["", "a", "aa", "aaa" * 400, "ab" * 3000 + "abc", "数据库 and 数据", "é\U0001f600", "x\x00y", "needle", "NEEDLE needles", "a_needle needle.", None]


def texts_of(n, seed, letters="ab_ 数é."):
    rng = Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 20, 200, 2500]))) for _ in range(n)]


def needles_of(n, seed, letters="ab_ 数é."):
    rng = Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n)} | {"aaa", "needle", "数据", "\x00", "b" * 1500})


def stands(needle, text):
    return re.search(r"(?<![a-zA-Z0-9_])" + re.escape(needle) + r"(?![a-zA-Z0-9_])", text) is not None


def arrays(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("whole", [False, True])
def test_all_occurrences(whole):
    texts, needles = texts_of(40, 1) + ODD, needles_of(60, 2)
    row, found = Automaton([x.encode() for x in needles]).rows_and_needles(*arrays(texts), whole)
    got = set(zip(row.tolist(), found.tolist()))
    assert len(got) == len(row)
    assert got == {
        (i, j) for i, t in enumerate(texts) for j, x in enumerate(needles) if t and (stands(x, t) if whole else x in t)}


def test_nothing_to_find():
    for needles, texts in ([], ["a"]), (["a"], []), (["a"], [None, ""]), (["zz"], ["a" * 5000]):
        row, found = Automaton([x.encode() for x in needles]).rows_and_needles(*arrays(texts), False)
        assert len(row) == len(found) == 0


def test_long_text_in_lanes():
    """Needles across the bounds of lanes, in one text of a million bytes."""
    rng = Random(3)
    text = "".join(rng.choice("abcdefgh") for _ in range(1_000_000))
    needles = sorted({text[i : i + rng.randint(4, 40)] for i in range(0, 1_000_000, 4999)} | {"zzzz"})
    row, found = Automaton([x.encode() for x in needles]).rows_and_needles(*arrays([text]), False)
    assert set(found.tolist()) == set(range(len(needles))) - {needles.index("zzzz")}


def test_blocks(spark):
    words = [f"word{i:04}" for i in range(1000)]
    frame = spark.createDataFrame([(w,) for w in [*words, *words, "", None]], "w string")
    blocks = blocks_of(frame, "w", entries=20_000, blocks=8)
    assert 1 < len(blocks) <= 8 and [w for b in blocks for w in b] == words
    assert blocks_of(frame, "w", entries=20_000, blocks=2) is None
    assert blocks_of(frame, "w", entries=100, blocks=8) is None
    assert blocks_of(frame.where("false"), "w") == []
    assert blocks_of(spark.createDataFrame([("x" * 5000,)], "w string"), "w", entries=6000) == [["x" * 5000]]


@pytest.mark.parametrize("way", ["one block", "many blocks", "joined"])
def test_joins(spark, monkeypatch, way):
    texts, names = texts_of(30, 4) + ODD, [x for x in needles_of(50, 5) if len(x) > 1]
    keys = [f"k{i % 3}" for i in range(len(texts))]
    t = spark.createDataFrame([(i, k, x, "more") for i, (k, x) in enumerate(zip(keys, texts))], "id int, k string, text string, other string").repartition(3)
    n = spark.createDataFrame([(f"k{i % 2}", x, i) for i, x in enumerate([*names, *names])], "k string, needle string, n int")
    blocks = {"one block": None, "many blocks": [names[:20], names[20:21], names[21:]], "joined": None}[way]
    if way != "one block":
        monkeypatch.setattr(automaton, "blocks_of", lambda *a: blocks)
    for join, holds in (grams.substring_join, lambda x, t: x in t), (grams.phrase_join, stands):
        got = join(t, "text", n, "needle", ["id"], on=["k"])
        assert got.columns == ["id", "k", "other", "needle", "n"]
        want = [(i, k, x, j) for i, (k, t_) in enumerate(zip(keys, texts)) if t_
                for j, x in enumerate([*names, *names]) if f"k{j % 2}" == k and holds(x, t_)]
        assert bag(got, "id", "k", "needle", "n") == sorted(want, key=repr)


def test_texts_do_not_move(spark):
    """The automaton stands over the texts themselves; only hits are exchanged."""
    t = spark.range(100).selectExpr("id", "concat('text ', id) as text")
    n = spark.createDataFrame([("text 7",)], "needle string")
    plan = grams.substring_join(t, "text", n, "needle", ["id"])._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("MapInArrow", 1)
    assert "Exchange" not in below.split("Range")[0] and "text#" not in above


def test_keywords_do_not_span_fields(spark):
    g = graph(spark, [("ab", "Module", "cd"), ("b\x00c", "Module", None), ("x", "Tool", "B and C")])
    asked = spark.createDataFrame([("p", k) for k in ["b", "bc", "b\x00c", "CD", "", "and"]], "project string, keyword string")
    got = {(r["keyword"], r["name"]) for r in search_keywords(g, asked).collect()}
    assert got == {("b", "ab"), ("b", "b\x00c"), ("b", "x"), ("b\x00c", "b\x00c"), ("CD", "ab"), ("and", "x")}


def test_keyword_of_a_repeated_entity(spark):
    g = graph(spark, [("same", "Module", "d")])
    twice = g.with_entities(lambda e: e.unionByName(entities(spark, [("other", "Module", "same same")], "q")))
    asked = spark.createDataFrame([("p", "same"), ("q", "same")], "project string, keyword string")
    assert bag(search_keywords(twice, asked), "project", "name") == [("p", "same"), ("q", "other")]
