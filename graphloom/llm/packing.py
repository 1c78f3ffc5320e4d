"""Best-fit packing: pieces of documents into as few sequences of fixed length as the search finds.

Pieces of one length are interchangeable, so packing needs only how many there are of each
length: at most ``size`` numbers, whatever the corpus. From them a plan is made: kinds of bins
(lengths held) and how often each occurs. Best fit with falling lengths fills bins; then a
local search takes the emptiest kind of bin and moves its items to others, one for
nothing, one for one, two for one or one for two, each time the change that adds most to the sum of
squared fills, for as many bins at once as both kinds have, until bins are empty. It ends
when no change helps, at the bound total / size, or after ``MOVES`` changes.

Spark then numbers the pieces of each length (counts per shard, sums before, a row number within the
shard, so a length that a third of all pieces share is split) and every piece looks up its place.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from graphloom.llm.chunks import library
from graphloom.llm.common import stage, steps, utf8
from graphloom.llm.token_files import append_id

SIZE = 2048
MOVES = 1500
SHARD_ROWS = 1 << 12

# A kind of bin: its lengths, longest first. Bins: how many there are of each kind.
Kind = tuple[int, ...]
Bins = dict[Kind, int]


def best_fit(counts: dict[int, int], size: int) -> Bins:
    """Bins by best fit, longest pieces first, all pieces of a length at once."""
    rooms: list[int] = []
    by_room: dict[int, list[tuple[Kind, int]]] = defaultdict(list)

    def put(kind: Kind, n: int) -> None:
        if n:
            room = size - sum(kind)
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append((kind, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = size // length
                put((length,) * each, left // each)
                put((length,) * (left % each), 1 if left % each else 0)
                break
            room = rooms[at]
            kind, n = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            each = min(room // length, left)
            used = min(n, left // each)
            put(kind + (length,) * each, used)
            put(kind, n - used)
            left -= used * each
    out: Bins = defaultdict(int)
    for kinds in by_room.values():
        for kind, n in kinds:
            out[kind] += n
    return dict(out)


@dataclass
class _Offers:
    """What the other bins could give: sums of one, two or no items, with their bin's fill."""

    kinds: list[Kind]
    kind: np.ndarray
    total: np.ndarray
    items: list[tuple[int, ...]]
    fill: np.ndarray


def _offers(bins: Bins, size: int) -> _Offers:
    kinds = [k for k in bins if sum(k) < size]
    of, total, items = [], [], []
    for i, kind in enumerate(kinds):
        given = {(): None} | {(a,): None for a in kind} | dict.fromkeys(combinations(kind, 2))
        for x in given:
            of.append(i)
            total.append(sum(x))
            items.append(x)
    fill = np.array([sum(k) for k in kinds], np.int64)
    of = np.array(of, np.int64)
    return _Offers(kinds, of, np.array(total, np.int64), items, fill[of] if len(of) else fill)


def _without(kind: Kind, items: tuple[int, ...]) -> list[int]:
    out = list(kind)
    for x in items:
        out.remove(x)
    return out


def local_search(bins: Bins, size: int, moves: int = MOVES) -> Bins:
    """Bins after changes that each add to the sum of squared fills."""
    bins = dict(bins)
    total = sum(sum(k) * n for k, n in bins.items())
    least = -(-total // size)
    stuck: set[Kind] = set()
    offers, done = _offers(bins, size), 0
    while done < moves and sum(bins.values()) > least:
        donor = min((k for k in bins if sum(k) < size and k not in stuck), key=lambda k: (sum(k), k), default=None)
        if donor is None:
            break
        own = sum(donor)
        index = {k: i for i, k in enumerate(offers.kinds)}
        live = np.array([bins.get(k, 0) > (k == donor) for k in offers.kinds], bool)[offers.kind]
        single = np.array([len(x) for x in offers.items])
        best = (0, None, None)
        for take in dict.fromkeys([*((b,) for b in donor), *combinations(donor, 2)]):
            gain = sum(take) - offers.total
            fits = live & (gain > 0) & (offers.fill + gain <= size) & (offers.fill + gain > own) & (single + len(take) <= 3)
            value = np.where(fits, gain * (offers.fill - own + gain), 0)
            at = int(value.argmax()) if len(value) else 0
            if len(value) and value[at] > best[0]:
                best = (int(value[at]), take, at)
        if best[1] is None:
            stuck.add(donor)
            continue
        take, at = best[1], best[2]
        other, give = offers.kinds[offers.kind[at]], offers.items[at]
        n = bins[donor] // 2 if other == donor else min(bins[donor], bins[other])
        fuller = tuple(sorted([*_without(other, give), *take], reverse=True))
        emptier = tuple(sorted([*_without(donor, take), *give], reverse=True))
        fresh = False
        for kind, change in ((donor, -n), (other, -n), (fuller, n), (emptier, n)):
            if kind:
                bins[kind] = bins.get(kind, 0) + change
                fresh |= kind not in index and sum(kind) < size
                if not bins[kind]:
                    del bins[kind]
                stuck.discard(kind)
        if fresh:
            more = _offers({k: 1 for k in (fuller, emptier) if k and k not in index}, size)
            if more.kinds:
                offers = _Offers(
                    offers.kinds + more.kinds, np.append(offers.kind, more.kind + len(offers.kinds)),
                    np.append(offers.total, more.total), offers.items + more.items, np.append(offers.fill, more.fill))
        done += 1
    return bins


@dataclass(frozen=True)
class Plan:
    """Where the pieces of each length go: ranges of their numbers, sorted by (length, number)."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these numbers among those of their length."""
        start = np.searchsorted(self.length, length, side="left")
        stop = np.searchsorted(self.length, length, side="right")
        while (wide := stop - start > 1).any():  # by halves, for all pieces at once
            middle = (start + stop) // 2
            up = wide & (self.first[middle] <= number)
            start, stop = np.where(up, middle, start), np.where(wide & ~up, middle, stop)
        within = number - self.first[start]
        sequence = self.sequence[start] + within // self.each[start]
        return sequence, self.offset[start] + within % self.each[start] * length


def plan(counts: dict[int, int], size: int = SIZE, moves: int = MOVES) -> Plan:
    """A plan for ``counts`` pieces of each length, 1 to ``size``."""
    bins = best_fit({k: n for k, n in counts.items() if n}, size)
    bins = local_search(bins, size, moves)
    rows, used, sequence = [], defaultdict(int), 0
    for kind, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length in sorted(set(kind), reverse=True):
            each = kind.count(length)
            rows.append((length, used[length], each, sequence, offset))
            used[length] += n * each
            offset += each * length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T.copy(), sequence)


def _pieces(path: str, end: int, size: int, led: bool, ids_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = library(path, led)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for low, high in steps(offsets):
                part = offsets[low : high + 1]
                ids, lengths = append_id(*tokens.encode(data[part[0] : part[-1]], part - part[0]), end)
                count = -(-lengths // size)
                row = np.repeat(np.arange(len(lengths)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                short = (lengths - 1) % size + 1  # the first piece; the others are full
                start = np.where(piece > 0, short[row] + (piece - 1) * size, 0)
                length = np.where(piece > 0, size, short[row])
                at = (np.cumsum(lengths) - lengths)[row] + start
                raw = ids.astype("<u4")
                out = {
                    "doc_id": batch.column("doc_id").slice(low, high - low).take(pa.array(row)),
                    "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array([crc32(raw[s : s + n]) for s, n in zip(at, length, strict=True)], pa.int64()),
                }
                if ids_too:
                    out["ids"] = pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.record_batch(out)

    return run


def token_pieces(docs: DataFrame, path: str, end: int, size: int = SIZE, led: bool = True, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the ids of every text and ``end``, cut where over ``size``.

    The first piece of a longer document is what is over, the others are full. Null texts count as
    empty: one piece, the end id. Other columns than doc_id and text are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return docs.mapInArrow(_pieces(path, end, size, led, ids), ddl)


def _place(made: Plan, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = made.place(np.asarray(batch.column("length")), np.asarray(batch.column(_NUMBER)))
            out = {name: batch.column(name) for name in names}
            yield pa.record_batch(out | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return run


_NUMBER, _SHARD, _BASE = "__pack_number", "__pack_shard", "__pack_base"


def pack(pieces: DataFrame, size: int = SIZE, moves: int = MOVES) -> DataFrame:
    """``pieces`` (length long from 1 to ``size``, any others of simple types) with sequence_id and offset.

    Every piece gets a place; a sequence's pieces follow each other from 0 without gaps. Equal
    lengths are numbered by the other columns, so repeated rows only trade places. Columns of
    the two names are replaced. An empty table gives an empty one.
    """
    pieces = stage(pieces.drop("sequence_id", "offset").withColumn("length", F.col("length").cast("long")))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(k is None or not 1 <= k <= size for k in counts):
        raise ValueError(f"lengths must be 1 to {size}")
    made = plan(counts, size, moves)
    names = pieces.columns
    shards = max(1, -(-sum(counts.values()) // SHARD_ROWS))
    rest = [f"`{c}`" for c in names if c != "length"]
    keyed = pieces.withColumn(_SHARD, F.pmod(F.xxhash64(*rest), F.lit(shards)).cast("int"))
    sizes = keyed.groupBy("length", _SHARD).agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy(_SHARD).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", _SHARD, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(_BASE))
    order = Window.partitionBy("length", _SHARD).orderBy(*rest)
    numbered = keyed.withColumn(_NUMBER, F.row_number().over(order)).join(bases, ["length", _SHARD])
    numbered = numbered.withColumn(_NUMBER, F.col(_NUMBER) - 1 + F.col(_BASE)).select(*[f"`{c}`" for c in names], _NUMBER)
    schema = T.StructType([
        *pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(_place(made, names), schema)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of every sequence, from placed pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
