"""SimHash near-dedup: fingerprints, links by a byte-position index, connected components.

Two 64-bit fingerprints that differ in at most three bits agree in at least five of their
eight bytes. Single bytes would make lists of a 256th of all fingerprints, so the inverted
index is over groups of four byte positions: the 14 groups whose numbers xor to zero. Any
three positions lie in exactly one group, so the bytes outside it, another group, agree for every
linked pair. A pair that meets in a list has its shared positional bytes tallied, must
reach the guaranteed five, and is then verified bit by bit; of all lists two fingerprints
share, only the first reports them.

Copies share a fingerprint and are one node. Lists are joined by Spark, split where hot.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from graphloom.llm.common import stage, utf8
from graphloom.session import discard

SHINGLE = 3
MAX_BITS = 3
SEED = 42
_BYTES = 8
# Shingles hashed at a time within one text.
_STEP = 1 << 18

GROUPS = [g for g in combinations(range(_BYTES), _BYTES // 2) if g[0] ^ g[1] ^ g[2] ^ g[3] == 0]


def majority(parts: Iterable[np.ndarray], total: int) -> int:
    """The bits that are set in over half of ``total`` 64-bit hashes, which come in parts, as an unsigned number."""
    counts = np.zeros(64, np.int64)
    for h in parts:
        counts += np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def of_hashes(hashes: np.ndarray) -> int:
    """SimHash of the hashes of a text's shingles; 0 for none."""
    return majority((hashes[low : low + _STEP] for low in range(0, len(hashes), _STEP)), len(hashes))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, as an unsigned number; 0 without words."""
    normal = b" ".join(text.lower().split())
    if not normal:
        return 0
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 0x20)
    starts = np.concatenate(([0], spaces + 1))
    ends = np.append(spaces, len(normal))
    if len(starts) >= size:
        starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest

    def hashes() -> Iterator[np.ndarray]:
        for low in range(0, len(starts), _STEP):
            pairs = zip(starts[low : low + _STEP].tolist(), ends[low : low + _STEP].tolist(), strict=True)
            yield np.array([digest(normal[s:e], SEED) for s, e in pairs], "<u8")

    return majority(hashes(), len(starts))


def _fingerprints(names: list[str], column: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            found = [fingerprint(data[s:e].tobytes(), size) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            out = {name: batch.column(name) for name in names}
            yield pa.record_batch(out | {column: pa.array(np.array(found, np.uint64).view(np.int64))})

    return run


def fingerprints(docs: DataFrame, keep: list[str], column: str = "fp", size: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the fingerprint of its ``text`` as a signed long."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    frame = docs.select(*[F.col(f"`{f.name}`") for f in fields if f.name != "text"], "text")
    schema = T.StructType([*[f for f in fields if f.name != column], T.StructField(column, T.LongType())])
    return frame.mapInArrow(_fingerprints(schema.fieldNames()[:-1], column, size), schema)


def _mask(group: tuple[int, ...]) -> int:
    mask = sum(0xFF << 8 * k for k in group)
    return mask - (1 << 64) if mask >> 63 else mask


def _agrees(difference: Column, group: tuple[int, ...]) -> Column:
    return difference.bitwiseAND(F.lit(_mask(group))) == 0


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (low, high) of the distinct values of ``fp`` at most ``max_bits`` (3 or fewer) apart."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the index guarantees up to three differing bits")
    lists = F.explode(F.array(*[
        F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("key")) for i, g in enumerate(GROUPS)
    ]))
    index = nodes.select("fp", lists.alias("x")).select("fp", "x.list", "x.key")
    a, b = index.alias("a"), index.alias("b")
    difference = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    tally = sum((_agrees(difference, (k,)).cast("int") for k in range(_BYTES)), F.lit(0))
    first = F.coalesce(*[F.when(_agrees(difference, g), F.lit(i)) for i, g in enumerate(GROUPS)])
    pairs = a.join(b, (F.col("a.list") == F.col("b.list")) & (F.col("a.key") == F.col("b.key"))
                   & (F.col("a.fp") < F.col("b.fp")) & (tally >= _BYTES - max_bits)
                   & (F.bit_count(difference) <= max_bits) & (first == F.col("a.list")))
    return pairs.select(F.col("a.fp").alias("low"), F.col("b.fp").alias("high"))


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("low", "high"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of ``edges`` (low, high) the smallest it is connected to.

    Large and small stars in turn: each round links a node's larger neighbours, then its
    smaller ones, to the smallest, until nothing changes, in about the logarithm of the
    longest path rounds. Every round is a written table.
    """
    edges = stage(edges)
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = both.groupBy("low").agg(F.min("high").alias("m")).withColumn("m", F.least("low", "m"))
        star = both.where("high > low").join(least, "low").select(F.col("m").alias("low"), "high").distinct()
        star = stage(star.where("low < high"))
        discard(edges)
        least = star.groupBy("high").agg(F.min("low").alias("m"))
        small = star.join(least, "high").select(F.col("m").alias("low"), F.col("low").alias("high"))
        edges = stage(small.union(least.select(F.col("m").alias("low"), "high")).where("low < high").distinct())
        discard(star)
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("low").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id long, text string).

    Fingerprints link at ``max_bits`` or fewer differing bits; a component is everything
    linked directly or by others, named by its smallest doc_id. Null and empty texts have
    fingerprint zero, linked like any other. A row without doc_id gets a component but
    names none (null if all its rows lack one). Repeated rows are returned as often as
    they come. Other columns are not read; an empty table gives an empty one.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    marked = stage(fingerprints(docs, ["doc_id"], size=size))
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, max_bits)).withColumnRenamed("node", "fp")
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(nodes.join(names, "root").select("fp", "component_id"))
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.join(named, "fp").select("doc_id", text.alias("fingerprint"), "component_id")
