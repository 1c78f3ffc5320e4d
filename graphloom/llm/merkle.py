"""Merkle manifest of a dataset: a witness for every document, kept up while documents are appended.

Leaves of a source are appended in order. A frontier holds the open runs of siblings of every level;
a leaf's witness is partial until a run is full, and each run that completes extends the witnesses of
everything below its members by the siblings beside them. Witnesses share their upper parts, so a run is kept
once and not once per leaf.

Appends are dealt out in aligned blocks of ``FAN`` ** depth leaves, which are whole subtrees, each appended in one task in
bounded memory. The roots of a source's blocks are then appended in the same way, as often as it takes to leave one
node per source, and the sources' roots once more. On the way back the siblings that block roots met
extend the witnesses of their blocks, down to the leaves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.llm.common import stage
from graphloom.llm.places import begins, placed

FAN = 16
DEPTH = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Step = tuple[bytes, bytes]


def digest(text: str | bytes) -> str:
    return sha256(text.encode() if isinstance(text, str) else text).hexdigest()


class Frontier:
    """Aligned append: nodes of every level, as hex digests, the last run of each still open."""

    def __init__(self, fan: int = FAN):
        self.fan, self.levels = fan, [[]]

    def append(self, node: str) -> None:
        for level in range(len(self.levels) + 1):
            if level == len(self.levels):
                self.levels.append([])
            nodes = self.levels[level]
            nodes.append(node)
            if len(nodes) % self.fan:
                return
            node = digest("".join(nodes[-self.fan :]))

    def close(self, depth: int | None = None) -> str:
        """Complete the open runs: ``depth`` levels of them, or until one node is left; the root."""
        level = 0
        while len(self.levels[level]) > 1 if depth is None else level < depth:
            if level + 1 == len(self.levels):
                self.levels.append([])
            nodes, above = self.levels[level : level + 2]
            while len(above) * self.fan < len(nodes):
                above.append(digest("".join(nodes[len(above) * self.fan : (len(above) + 1) * self.fan])))
            level += 1
        del self.levels[level + 1 :]
        return self.levels[level][0]


def witness(levels: Sequence[bytes], i: int, fan: int = FAN) -> Iterator[Step]:
    """Hex text of the siblings before and after the ancestors of node ``i``, from the bottom up.

    ``levels`` are the hex digests of each level in a row.
    """
    for nodes in levels[:-1]:
        run = i - i % fan
        yield nodes[64 * run : 64 * i], nodes[64 * (i + 1) : 64 * (run + fan)]
        i //= fan


def fold(leaf: bytes, steps: Sequence[Step]) -> bytes:
    """The root that a leaf and its witness lead to."""
    for before, after in steps:
        leaf = sha256(before + leaf + after).hexdigest().encode()
    return leaf


def leaf(columns: Sequence[Column]) -> Column:
    """Raw SHA-256 of the fields: ``-`` if null, else byte count, colon, value."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


_BLOCK = "source string, block long, root binary, levels array<binary>, doc_ids array<long>, altered array<binary>"
_BLOCK_ARROW = pa.schema([
    ("source", pa.string()), ("block", pa.int64()), ("root", pa.binary()), ("levels", pa.list_(pa.binary())),
    ("doc_ids", pa.list_(pa.int64())), ("altered", pa.list_(pa.binary()))])


def _appended(depth: int):
    """A row per block from its nodes in order; a block holds at most FAN ** depth of them."""

    def closed(held: Frontier, source: str | None, block: int, doc_ids: list, altered: list) -> pa.RecordBatch:
        # The first block is its source's only one or full; either way it closes at its natural height.
        root = held.close(depth if block else None)
        levels = [bytes.fromhex("".join(nodes)) for nodes in held.levels]
        row = {"source": source, "block": block, "root": bytes.fromhex(root), "levels": levels, "doc_ids": doc_ids, "altered": altered}
        return pa.RecordBatch.from_pylist([row], _BLOCK_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_block, last = None, None
        for batch in batches:
            if not len(batch):
                continue
            new = begins(batch, ["source", "block"], last)
            last = batch.slice(len(batch) - 1)
            rows = zip(new, *(batch.column(c).to_pylist() for c in ("source", "block", "node", "doc_id", "altered")), strict=True)
            for first, source, block, node, doc_id, other in rows:
                if first:
                    if open_block:
                        yield closed(*open_block)
                    open_block = (Frontier(), source, block, [], [])
                open_block[0].append(node.hex())
                open_block[3].append(doc_id)
                open_block[4].append(other)
        if open_block:
            yield closed(*open_block)

    return run


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by key to as many tasks as the session shuffles to, though they be few bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    """Blocks of the rows (source, pos, node, doc_id, altered), as a written table."""
    keyed = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(FAN**depth)).cast("long"))
    return stage(_spread(keyed, "source", "block").sortWithinPartitions("source", "block", "pos").mapInArrow(_appended(depth), _BLOCK))


def _tiers(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """Blocks of the nodes, blocks of their roots, and so on until every source has one block."""
    tiers = [_blocks(nodes, depth)]
    while (tiers[-1].agg(F.max("block")).first()[0] or 0) > 0:
        above = tiers[-1].select(
            "source", F.col("block").alias("pos"), F.col("root").alias("node"), F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("binary").alias("altered"))
        tiers.append(_blocks(above, depth))
    return tiers


def _steps(depth: int):
    """A row per node of each block: its place and witness, those of its block added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = [x.hex().encode() for x in row["levels"]]
                n = len(row["doc_ids"])
                for low in range(0, n, FAN):
                    some = range(low, min(low + FAN, n))
                    found = [list(witness(levels, i)) for i in some]
                    yield pa.record_batch({
                        "source": pa.array([row["source"]] * len(some), pa.string()),
                        "pos": pa.array([row["block"] * FAN**depth + i for i in some], pa.int64()),
                        "before": pa.array([[s[0] for s in f] + row["before"] for f in found], pa.list_(pa.binary())),
                        "after": pa.array([[s[1] for s in f] + row["after"] for f in found], pa.list_(pa.binary())),
                        "subroot": pa.array([row["subroot"]] * len(some), pa.string()),
                        "top": pa.array([row["top"]] * len(some), pa.string())})

    return run


_STEP_DDL = "source string, pos long, before array<binary>, after array<binary>, subroot string, top string"


def _with_above(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks and the witnesses of their roots."""
    above = above.select(F.col("source").alias("s"), F.col("pos").alias("p"), "before", "after", "subroot", "top")
    return blocks.join(above, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("p"))).drop("s", "p")


def _proofs(full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = [x.hex().encode() for x in row["levels"]]
                above = list(zip(row["before"], row["after"], strict=True))
                for low in range(0, len(row["doc_ids"]), FAN):
                    leaves, hashes, folded, befores, afters = [], [], [], [], []
                    shared, upper = None, []
                    for i in range(low, min(low + FAN, len(row["doc_ids"]))):
                        if shared is None:  # what lies above a run is the same for all of it
                            upper = [*witness(levels[1:], i // FAN), *above] if len(levels) > 1 else above
                            shared = b"".join(x for step in upper for x in step)
                        own = next(witness(levels, i), None)
                        steps = upper if own is None else [own, *upper]
                        at = levels[0][64 * i : 64 * (i + 1)]
                        other = row["altered"][i]
                        leaves.append(at.decode())
                        hashes.append(digest(b"".join(own or ()) + shared))
                        folded.append(fold(at if other is None else other.hex().encode(), steps).decode())
                        if full:
                            befores.append([s[0].decode() for s in steps])
                            afters.append([s[1].decode() for s in steps])
                    n = len(leaves)
                    out = {
                        "doc_id": pa.array(row["doc_ids"][low : low + n], pa.int64()), "source": pa.array([row["source"]] * n, pa.string()),
                        "leaf": pa.array(leaves), "subroot": pa.array([row["subroot"]] * n), "root": pa.array([row["top"]] * n),
                        "proof_sha256": pa.array(hashes), "folded_root": pa.array(folded),
                        "verified": pa.array([f == row["top"] for f in folded])}
                    if full:
                        out |= {"before": pa.array(befores, pa.list_(pa.string())), "after": pa.array(afters, pa.list_(pa.string()))}
                    yield pa.record_batch(out)

    return run


_PROOF_DDL = (
    "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered(doc_id: Column) -> Column:
    """Whether a document is to be checked in another state: 5 divides the crc32 of its id in decimal digits."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def proofs(docs: DataFrame, steps: bool = False, depth: int = DEPTH) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified[, before, after]) of every row of ``docs``.

    ``docs`` has doc_id and n_chars (integers), source, lang, text (strings); other columns are not read. ``before`` and
    ``after`` hold, level by level, the hex digests left and right of the path: the witness itself.
    folded_root is what the witness makes of the leaf, or of the leaf of the lower-cased text where the id
    is to be ``tampered`` with; then it differs from root if that text has an A-Z.

    Null fields are ``-``, unlike empty ones. Rows without source form one source, sorted first. In a source rows
    without doc_id come first, rows of equal doc_id in the order of their leaves; repeated rows are leaves of
    their own. A lone row's leaf is its subroot, a lone source's subroot the root; neither has siblings, and the
    hash of none is that of the empty text. An empty table has no rows.
    """
    docs = docs.select(*[F.col(c).cast("string" if c in ("source", "lang", "text") else "long").alias(c) for c in FIELDS])
    as_is = [F.col(c) for c in FIELDS]
    other = F.when(tampered(F.col("doc_id")) & F.col("text").isNotNull(), leaf([*as_is[:-1], lowered(F.col("text"))]))
    nodes = docs.select("source", "doc_id", leaf(as_is).alias("node"), other.alias("altered"))
    # Written, so that texts are read and hashed once, though ranges are found by a pass of their own.
    tiers = _tiers(placed(stage(nodes), ["source"], ["doc_id", "node"], "pos"), depth)

    one = F.lit(None).cast("string").alias("source")
    tops = placed(tiers[-1].select(F.col("source").alias("name"), F.col("root").alias("node")).withColumn("all", F.lit(0)), ["all"], ["name"], "pos")
    above = _tiers(tops.select(one, "pos", "node", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("altered")), depth)
    root = above[-1].select("root").first()

    none = F.array().cast("array<binary>")
    # The block at the very top has no witness.
    last = {"before": none, "after": none, "subroot": F.lit(""), "top": F.lit(bytes(root[0]).hex() if root else "")}
    top = above[-1].withColumns(last).mapInArrow(_steps(depth), _STEP_DDL)
    for blocks in reversed(above[:-1]):
        top = _with_above(blocks, top).mapInArrow(_steps(depth), _STEP_DDL)
    known = tops.select("pos", F.col("name"), F.lower(F.hex("node")).alias("own"))
    top = top.drop("source", "subroot").join(known, "pos").select(
        F.col("name").alias("source"), F.lit(0).cast("long").alias("pos"), "before", "after", F.col("own").alias("subroot"), "top")
    for blocks in reversed(tiers[1:]):
        top = _with_above(blocks, top).mapInArrow(_steps(depth), _STEP_DDL)
    ready = _spread(_with_above(tiers[0], top), "source", "block")
    return ready.mapInArrow(_proofs(steps), _PROOF_DDL + (", before array<string>, after array<string>" if steps else ""))
