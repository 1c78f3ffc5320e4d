"""Substring dedup: windows of words seen before are removed, by compacting their de Bruijn graph.

A window of ``WINDOW`` words is an edge between its first and its last ``WINDOW - 1`` words.
Edges are named by the least hash among their ``GRAM``-word grams, so neighbouring edges
of a document mostly share a name: such a run of edges is a path of the graph, and two
occurrences of an edge always carry the same name. The steps are

1. names that occur in two documents (a hash aggregate over names only);
2. the documents holding such names (a join on the name);
3. one row per path with such a name: two independent 64-bit digests of its words. If all
   paths of a name agree, none branches, and the whole path is judged at once: it is
   repeated in every document but the first, its source;
4. the edges of the paths that branch, each judged by the first document it starts in.

Names only choose candidates. What is removed rests on 128-bit digests that agree between a
document and its source. Only steps 3, 4 and the last read move texts, once each, by id;
what is shuffled before is a name and an id. Hot names are reduced in each task before the
shuffle and split by AQE in the joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from graphloom.llm.common import rolling, sliding_min, stage, steps, utf8, word_hashes, words

WINDOW = 13
GRAM = 6
_SEEDS = (0x51ED27, 0x2F6B91)
# Columns of decisions that travel beside a document's own.
_NAMES, _PATHS, _EDGES = "__repeat_names", "__repeat_paths", "__repeat_edges"


class _Block:
    """Words and windows of some rows of a batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        self.data, self.offsets, self.window = data, offsets, window
        self.starts, self.ends, self.rows = words(data, offsets)
        self.first = np.searchsorted(self.rows, np.arange(len(offsets)))
        h = word_hashes(data, self.starts, self.ends, _SEEDS[0])
        size = len(h) - window + 1
        if size > 0:
            names = sliding_min(rolling(h, gram), window - gram + 1)
            valid = self.rows[:size] == self.rows[window - 1 :]
            self.at = np.flatnonzero(valid)
            self.names = names[self.at].view(np.int64)
            self.h = h
        else:
            self.at, self.names, self.h = np.empty(0, np.int64), np.empty(0, np.int64), h

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last window (as numbers into ``at``) of every path of one name."""
        if not len(self.at):
            return self.at, self.at
        new = np.ones(len(self.at), bool)
        new[1:] = (self.names[1:] != self.names[:-1]) | (np.diff(self.at) != 1)
        new[1:] |= np.diff(self.rows[self.at]) != 0
        first = np.flatnonzero(new)
        return first, np.append(first[1:], len(self.at)) - 1

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Two digests of every window."""
        other = word_hashes(self.data, self.starts, self.ends, _SEEDS[1])
        out = rolling(self.h, self.window), rolling(other, self.window, 0x165667B19E3779F9)
        return out[0][self.at].view(np.int64), out[1][self.at].view(np.int64)

    @staticmethod
    def paths(edges: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Digest of each path from those of its edges, in order."""
        n = last - first
        x = edges.view(np.uint64)
        out = (n.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        k, todo = 0, np.arange(len(first))
        while len(todo):
            h = (out[todo] ^ x[first[todo] + k]) * np.uint64(0xD6E8FEB86659FD93)
            out[todo] = h ^ (h >> np.uint64(29))
            k += 1
            todo = todo[n[todo] >= k]
        return out.view(np.int64)


def _blocks(batch: pa.RecordBatch, window: int, gram: int) -> Iterator[tuple[int, _Block]]:
    data, offsets = utf8(batch.column("text"))
    for low, high in steps(offsets):
        part = offsets[low : high + 1]
        yield low, _Block(data[part[0] : part[-1]], part - part[0], window, gram)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every element of a list column; null counts as empty."""
    values = np.asarray(column.flatten(), np.int64)
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    return np.repeat(np.arange(len(column)), lengths), values


def _held(rows: np.ndarray, values: np.ndarray, wanted_rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which (row, value) pairs are among the wanted ones."""
    pair = np.dtype([("r", np.int64), ("v", np.int64)])

    def pairs(r: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.empty(len(r), pair)
        out["r"], out["v"] = r, v
        return out

    if not len(wanted) or not len(values):
        return np.zeros(len(values), bool)
    wanted_pairs = np.unique(pairs(wanted_rows, wanted))
    have = pairs(rows, values)
    # Values are hashes: few outside the list pass the first test, the second is exact.
    out = np.isin(values, wanted)
    some = np.flatnonzero(out)
    at = np.searchsorted(wanted_pairs, have[some])
    out[some] = wanted_pairs[np.minimum(at, len(wanted_pairs) - 1)] == have[some]
    return out


def _names(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for low, block in _blocks(batch, window, gram):
                first, _ = block.runs()
                rows = block.rows[block.at[first]] + low
                yield pa.record_batch({"name": block.names[first], "doc_id": ids[rows]})

    return run


def _paths(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            rows_of, wanted = _lists(batch.column(_NAMES))
            for low, block in _blocks(batch, window, gram):
                first, last = block.runs()
                rows = block.rows[block.at[first]] + low
                keep = _held(rows, block.names[first], rows_of, wanted)
                first, last, rows = first[keep], last[keep], rows[keep]
                a, b = block.edges()
                yield pa.record_batch({
                    "name": block.names[first], "doc_id": ids[rows],
                    "a": block.paths(a, first, last), "b": block.paths(b, first, last),
                })

    return run


def _edges(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            rows_of, wanted = _lists(batch.column(_NAMES))
            for low, block in _blocks(batch, window, gram):
                rows = block.rows[block.at] + low
                keep = _held(rows, block.names, rows_of, wanted)
                a, b = block.edges()
                yield pa.record_batch({"doc_id": ids[rows[keep]], "a": a[keep], "b": b[keep]})

    return run


def _kept(window: int, gram: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path_rows, paths = _lists(batch.column(_PATHS))
            edge_rows, edges = _lists(batch.column(_EDGES))
            n_words, n_removed, texts = [], [], []
            for low, block in _blocks(batch, window, gram):
                gone = np.zeros(len(block.starts) + 1, np.int64)
                first, last = block.runs()
                rows = block.rows[block.at] + low
                if len(paths) or len(edges):
                    a, _ = block.edges()
                    hit = np.flatnonzero(_held(rows[first], block.paths(a, first, last), path_rows, paths))
                    at = np.flatnonzero(_held(rows, a, edge_rows, edges))
                    for begin, end in ((block.at[first[hit]], block.at[last[hit]]), (block.at[at], block.at[at])):
                        np.add.at(gone, begin, 1)
                        np.add.at(gone, end + window, -1)
                stays = np.cumsum(gone[:-1]) == 0
                for i in range(len(block.first) - 1):
                    here = stays[block.first[i] : block.first[i + 1]]
                    found = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
                    n_words.append(len(here))
                    n_removed.append(len(here) - int(here.sum()))
                    texts.append(b" ".join(compress(found, here.tolist()) if n_removed[-1] else found))
            out = {name: batch.column(name) for name in names}
            out |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
            yield pa.record_batch(out | {"kept": pa.array(texts, pa.binary()).cast(pa.string())})

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` (doc_id long, text string, any other columns) with n_words, n_removed and kept.

    A word goes if a window covering it also starts in a document with a smaller doc_id; kept
    are the others, joined by one space. Null text has no words. A row without doc_id keeps
    all its words and is no source. Rows with equal doc_id are one document as far as sources
    go: neither is smaller. Other columns are returned as they are, under the names n_words,
    n_removed and kept those of this operator. An empty table gives an empty one.
    """
    made = ("n_words", "n_removed", "kept")
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in made])
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = docs.where("doc_id is not null").select("doc_id", "text")

    seen = texts.mapInArrow(_names(window, gram), "name long, doc_id long")
    shared = seen.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = stage(shared.where("low < high").select("name"))
    held = seen.join(shared, "name").groupBy("doc_id").agg(F.collect_set("name").alias(_NAMES))
    held = stage(held)

    paths = stage(texts.join(held, "doc_id").mapInArrow(_paths(window, gram), "name long, doc_id long, a long, b long"))
    per_name = paths.groupBy("name").agg(
        F.min("doc_id").alias("source"),
        ((F.min("a") != F.max("a")) | (F.min("b") != F.max("b"))).alias("branches"),
    )
    judged = stage(paths.join(per_name, "name").where("branches or doc_id > source"))
    repeated = judged.where("not branches").groupBy("doc_id").agg(F.collect_set("a").alias(_PATHS))
    branching = judged.where("branches").groupBy("doc_id").agg(F.collect_set("name").alias(_NAMES))

    edges = stage(texts.join(branching, "doc_id").mapInArrow(_edges(window, gram), "doc_id long, a long, b long"))
    sources = edges.groupBy("a", "b").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
    # Written, so that the join shuffles both sides itself and can split a hot window.
    sources = stage(sources.where("source < last").drop("last"))
    later = edges.join(sources, ["a", "b"]).where("doc_id > source")
    later = later.groupBy("doc_id").agg(F.collect_set("a").alias(_EDGES))
    decided = stage(repeated.join(later, "doc_id", "full"))

    schema = T.StructType([
        *docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
    ])
    return docs.join(decided, "doc_id", "left").mapInArrow(_kept(window, gram, docs.columns), schema)
