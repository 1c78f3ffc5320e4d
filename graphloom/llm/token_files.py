"""Token ids in binary files: fixed-width bit packing with block offsets.

A record is a run of whole documents of one part of the doc_id order: about ``RECORD_IDS``
ids, more only if one document has more. Its payload is a header, the documents' ids and
first positions, the byte offset of every block of ``BLOCK_IDS`` ids, and the blocks, each id in
as many bits as the vocabulary needs, least first. Any block unpacks by itself with numpy, so
``RecordReader.ids(start, stop)`` reads a range without the rest.

Records are rows of a Parquet table, so Spark's writers and readers carry them to any
store: part (place in the doc_id order), record (place in the part), first (ids of the part
before it), ids, docs, payload. Documents are cut into parts by range, texts shuffled once, and
encoded where they are written.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from graphloom.llm.chunks import gather, library
from graphloom.llm.common import stage, steps, utf8

MAGIC = b"IDPACK1\0"
RECORD_IDS = 1 << 18
BLOCK_IDS = 1 << 12
_HEADER = struct.Struct("<8sHHIQQQ")


def bits_for(vocabulary: int) -> int:
    """Least width that holds the ids 0 to vocabulary - 1."""
    return max(int(vocabulary - 1).bit_length(), 1)


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, ``bits`` each, least significant first, the last byte filled up."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(spread.reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: np.ndarray, count: int, bits: int) -> np.ndarray:
    if bits == 16:
        return data[: 2 * count].view("<u2").astype(np.uint32)
    spread = np.unpackbits(data, count=count * bits, bitorder="little").reshape(count, bits)
    out = np.zeros((count, 32), np.uint8)
    out[:, :bits] = spread
    return np.packbits(out, axis=1, bitorder="little").view("<u4").reshape(-1)


def write_record(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """Payload of some whole documents."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    known = np.array([d is not None for d in doc_ids], bool)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    blocks = [pack_bits(ids[i : i + BLOCK_IDS], bits) for i in range(0, len(ids), BLOCK_IDS)]
    at = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    starts = np.cumsum([0, *lengths]).astype("<u8")
    header = _HEADER.pack(MAGIC, bits, 0, BLOCK_IDS, len(doc_ids), len(ids), len(blocks))
    return b"".join([header, names.tobytes(), known.astype("u1").tobytes(), starts.tobytes(), at.tobytes(), *blocks])


class RecordReader:
    """Documents and ids of a payload, by range."""

    def __init__(self, payload: bytes):
        data = np.frombuffer(payload, np.uint8)
        magic, self.bits, _, self.block, docs, self.n_ids, blocks = _HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a record of token ids")
        at = _HEADER.size

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        names, known = part("<i8", docs), part("u1", docs)
        self.doc_ids = [d if k else None for d, k in zip(names.tolist(), known.tolist(), strict=True)]
        self.starts = part("<u8", docs + 1).astype(np.int64)
        self._at = part("<u8", blocks + 1).astype(np.int64) + at
        self._data = data

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at positions start to stop of the record, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            count = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack_bits(self._data[self._at[b] : self._at[b + 1]], count, self.bits))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def append_id(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by ``end``."""
    out = np.full(len(ids) + len(lengths), end, np.uint32)
    after = np.cumsum(lengths + 1) - (lengths + 1)
    out[gather(after, lengths)] = ids
    return out, lengths + 1


def _records(path: str, led: bool, end: int, bits: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = library(path, led)
        width = bits or bits_for(tokens.size)
        place, record, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal record, first, held, count
            names = [d for h in held for d in h[0]]
            lengths, ids = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            row = {"part": place, "record": record, "first": first, "ids": len(ids), "docs": len(names),
                   "payload": write_record(names, lengths, ids, width)}
            record, first, held, count = record + 1, first + len(ids), [], 0
            return pa.RecordBatch.from_pylist([row], _RECORD)

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for low, high in steps(offsets, RECORD_IDS * 2):
                part = offsets[low : high + 1]
                ids, lengths = append_id(*tokens.encode(data[part[0] : part[-1]], part - part[0]), end)
                held.append((names[low:high], lengths, ids))
                count += len(ids)
                if count >= RECORD_IDS:
                    yield flush()
        if held:
            yield flush()

    return run


_RECORD = pa.schema([
    ("part", pa.int64()), ("record", pa.int64()), ("first", pa.int64()), ("ids", pa.int64()), ("docs", pa.int64()),
    ("payload", pa.binary()),
])
_RECORD_DDL = "part long, record long, first long, ids long, docs long, payload binary"


def token_records(docs: DataFrame, path: str, end: int, led: bool = False, bits: int | None = None) -> DataFrame:
    """Records of the ids of all texts, in ascending doc_id order, ``end`` after each document.

    ``docs`` has doc_id (long) and text (string); other columns are not read. Null texts count as
    empty, which have the end id alone. Rows without doc_id come first; rows with equal
    doc_id come in the order of their texts. An empty table has no records.
    """
    order = ["doc_id", "text"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = docs.repartitionByRange("doc_id").sortWithinPartitions(*order)
    return ranged.mapInArrow(_records(path, led, end, bits), _RECORD_DDL)


def write(records: DataFrame, path: str) -> None:
    """Store records; payloads are as dense as they get, so they are not compressed again."""
    records.write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            reader = RecordReader(row["payload"])
            sums = [crc32(reader.document(i).astype("<u4")) for i in range(len(reader.doc_ids))]
            yield pa.record_batch({
                "doc_id": pa.array(reader.doc_ids, pa.int64()),
                "part": pa.array([row["part"]] * len(sums), pa.int64()),
                "start": pa.array(reader.starts[:-1] + row["first"], pa.int64()),
                "n_tokens": pa.array(np.diff(reader.starts), pa.int64()),
                "ids_crc32": pa.array(sums, pa.int64()),
            })


def read_documents(records: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in stored records.

    start counts the ids of all documents before it: those of its part, and of the parts before.
    """
    sizes = records.groupBy("part").agg(F.sum("ids").alias("size"))
    # One row per part, so as many as there are files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    found = records.mapInArrow(_documents, "doc_id long, part long, start long, n_tokens long, ids_crc32 long")
    found = found.join(F.broadcast(bases), "part")
    return found.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def written(records: DataFrame) -> DataFrame:
    """The records, stored in the shared checkpoint folder and read again."""
    spark = records.sparkSession
    before = spark.conf.get("spark.sql.parquet.compression.codec")
    spark.conf.set("spark.sql.parquet.compression.codec", "uncompressed")
    try:
        return stage(records)
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", before)
