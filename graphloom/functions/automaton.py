"""Many needles in many texts: Aho-Corasick automata in arrays, run beside the texts.

The needles of a block become one table of transitions, built in the workers from the needles themselves,
which are all that is sent. Texts are cut into lanes of equal size that overlap by the longest needle, and
all lanes of a batch go through the table in step, one byte at a time, so the work is on arrays as long as there are
lanes. UTF-8 texts are searched as bytes, which finds the same places.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

# Entries of a block's table, four bytes each; a needle that needs more by itself is a block of its own.
ENTRIES = 1 << 25
# Texts are read once per block; with more needles than that, a join on equality is the better way.
BLOCKS = 8
# Bytes that go through a table in one go, and the shortest lane.
STEP_BYTES = 1 << 21
LANE = 512

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), ord("_")]] = True


class Automaton:
    """All occurrences of distinct, non-empty needles; ``flat[state * width + class]`` is the next state."""

    def __init__(self, needles: Sequence[bytes]):
        data = np.frombuffer(b"".join(needles), np.uint8)
        self.lengths = np.array([len(x) for x in needles], np.int64)
        self.longest = int(self.lengths.max(initial=1))
        used = np.unique(data)
        self.width = len(used) + 1
        self.classes = np.zeros(256, np.int64)
        self.classes[used] = np.arange(1, self.width)
        starts = np.cumsum(self.lengths) - self.lengths
        levels, at, states = [], np.zeros(len(needles), np.int64), 1
        alive = np.arange(len(needles))
        for depth in range(self.longest if len(needles) else 0):
            alive = alive[self.lengths[alive] > depth]
            key = at[alive] * self.width + self.classes[data[starts[alive] + depth]]
            edges, child = np.unique(key, return_inverse=True)
            at[alive] = states + child
            levels.append(edges)
            states += len(edges)
        table = np.zeros((states, self.width), np.int32)
        failure, self.link = np.zeros(states, np.int64), np.zeros(states, np.int64)
        self.own = np.full(states, -1, np.int64)
        self.own[at] = np.arange(len(needles))
        base = 1
        for depth, edges in enumerate(levels):
            parent, by = edges // self.width, edges % self.width
            new = np.arange(base, base + len(edges))
            # Levels above are complete but for the edges into this one.
            failure[new] = table[failure[parent], by] if depth else 0
            table[parent, by] = new
            base += len(edges)
            if depth + 1 <= len(levels):
                table[new] = table[failure[new]]
                back = failure[new]
                self.link[new] = np.where(self.own[back] >= 0, back, self.link[back])
        self.flat = table.reshape(-1)
        self.hits = (self.own >= 0) | (self.link > 0)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, position of the last byte and state of every place where a needle ends in the texts."""
        lane = max(LANE, 8 * self.longest)
        sizes = np.diff(offsets)
        count = -(-sizes // lane)
        row = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        first = offsets[row] + nth * lane
        begin = np.maximum(first - self.longest + 1, offsets[row])
        length = np.minimum(first + lane, offsets[row + 1]) - begin
        order = np.argsort(-length, kind="stable")
        row, begin, length, first = row[order], begin[order], length[order], first[order]
        classes = self.classes[data]
        state, found = np.zeros(len(row), np.int64), []
        # Lanes still running at each step are the first ones.
        running = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), side="right")
        for step, n in enumerate(running.tolist()):
            now = self.flat[state[:n] * self.width + classes[begin[:n] + step]]
            state[:n] = now
            ends = np.flatnonzero(self.hits[now])
            if len(ends):
                # What ends in the overlap was found by the lane before.
                ends = ends[begin[ends] + step >= first[ends]]
                found.append((row[ends], begin[ends] + step, now[ends].astype(np.int64)))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def rows_and_needles(self, data: np.ndarray, offsets: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, needle) pairs. ``whole``: no ASCII word character may touch the needle."""
        row, end, state = self.scan(data, offsets)
        if not whole and len(row):
            row, state = np.unique(np.stack([row, state]), axis=1)
        pairs = []
        while len(row):
            own = self.own[state]
            keep = own >= 0
            if whole:
                start = end + 1 - self.lengths[own]
                before = (start > offsets[row]) & _WORD[data[np.maximum(start - 1, 0)]]
                after = (end + 1 < offsets[row + 1]) & _WORD[data[np.minimum(end + 1, len(data) - 1)]]
                keep &= ~before & ~after
            pairs.append(np.stack([row[keep], own[keep]]))
            state = self.link[state]
            left = state > 0
            row, state = row[left], state[left]
            end = end[left] if whole else end
        if not pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        row, needle = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return row, needle


@lru_cache(maxsize=1)
def _built(block: Broadcast) -> Automaton:
    return Automaton([x.encode() for x in block.value])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _steps(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most STEP_BYTES, one row at least."""
    low = 0
    while low < len(offsets) - 1:
        high = max(int(np.searchsorted(offsets, offsets[low] + STEP_BYTES, side="right")) - 1, low + 1)
        yield low, high
        low = high


def _search(block: Broadcast, text: str, keep: list[str], needle: str, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, needles = _built(block), pa.array(block.value, pa.string())
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            kept = batch.select(keep)
            for low, high in _steps(offsets):
                part = offsets[low : high + 1] - offsets[low]
                row, found = automaton.rows_and_needles(data[offsets[low] : offsets[high]], part, whole)
                if len(row):
                    rows = kept.take(pa.array(row + low))
                    yield pa.RecordBatch.from_arrays([*rows.columns, needles.take(pa.array(found))], names=[*keep, needle])

    return run


def blocks_of(needles: DataFrame, needle: str, entries: int = ENTRIES, blocks: int = BLOCKS) -> list[list[str]] | None:
    """The distinct non-empty needles in blocks whose tables have at most ``entries``, or None if these are too many.

    Their size is known before they are collected: no more than blocks * entries / 2 bytes.
    """
    distinct = needles.where(F.length(needle) > 0).select(needle).distinct()
    size = distinct.agg(F.sum(F.octet_length(needle)).alias("bytes")).first()["bytes"] or 0
    if size * 2 > entries * blocks:  # a table has at least two classes
        return None
    # Sorted, so that a block's needles share states.
    words = sorted(r[0] for r in distinct.collect())
    width = len(set("".join(words).encode())) + 1
    out, states = [], entries
    for word in words:
        more = len(word.encode()) * width
        if states + more > entries:
            out.append([])
            states = 0
        out[-1].append(word)
        states += more
    return out if len(out) <= blocks else None


def search(texts: DataFrame, text: str, blocks: list[list[str]], needle: str, keep: Sequence[str], whole: bool = False) -> DataFrame:
    """(keep, needle) for each row and each needle of the blocks that its text holds. Texts are not moved."""
    fields = [f for name in keep for f in texts.schema.fields if f.name == name]
    schema = T.StructType([*fields, T.StructField(needle, T.StringType())])
    found = None
    for block in blocks or [[]]:
        sent = texts.sparkSession.sparkContext.broadcast(block)
        rows = texts.select(*dict.fromkeys([*keep, text])).mapInArrow(_search(sent, text, list(keep), needle, whole), schema)
        found = rows if found is None else found.union(rows)
    return found
