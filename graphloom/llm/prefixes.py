"""Prefix trie of conversations, by collapsing whole sequences.

Conversations with the same turns are one weighted sequence with a list of those that end there, so a
conversation copied a million times is one sequence of weight a million. Sequences that are proper prefixes of others are
dropped by an anti-join; what is left are the leaves. Every node is a prefix of some sequence, so its
counts are sums over the weighted prefixes of the sequences, one row per turn of a distinct sequence.

A prefix is known by its depth and two 64-bit words: the exclusive or of hashes of (place, SHA-256 of the turn). Equality
of prefixes rests on these 128 bits. As the words combine in any order, long conversations are summed in blocks of
``BLOCK`` turns.

Sums over subtrees take no walk: the tokens of a subtree's members are a weighted sum over their sequences' remaining
turns; of the nodes themselves each belongs to the sequence with the smallest conv_id through it, whose own
nodes are its deepest ones, so their tokens are sums over remaining turns as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.llm.common import stage
from graphloom.llm.places import begins, placed

# A conversation shares the beginning of the first of its run of so many ids, by a number of turns below HEADS.
RUN, HEADS = 100, 6
BLOCK = 4096
_EMPTY = sha256().hexdigest()
_KEY = ["depth", "k1", "k2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_hash, chars) of every turn, pos from 0; texts stay behind."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("turn_hash"),
        F.length(text).cast("long").alias("chars"))
    return placed(stage(rows), ["conv_id"], ["turn", "turn_hash"], "pos").drop("turn")


def rebuild(rows: DataFrame, run: int = RUN, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id), and their rebuilt turns (conv_id, depth from 1, turn_hash, chars).

    A conversation c has the first h turns of c - c % run, if there are so many, and its own after its first h; h is
    the crc32 of c in decimal digits modulo ``heads``.
    """
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % run
    info = sizes.select("conv_id", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    firsts = sizes.where(F.col("conv_id") % run == 0).select(F.col("conv_id").alias("base"), F.least("n", F.lit(heads)).alias("there"))
    info = info.join(firsts, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    info = stage(info.select("conv_id", "base", "h", "taken"))
    own = rows.join(info, "conv_id").where("pos >= h").withColumn("depth", F.col("pos") - F.col("h") + F.col("taken") + 1)
    first = rows.where((F.col("conv_id") % run == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    shared = first.join(info, "base").where("pos < taken").withColumn("depth", F.col("pos") + 1)
    columns = ["conv_id", "depth", "turn_hash", "chars"]
    return info.select("conv_id"), stage(own.select(*columns).union(shared.select(*columns)))


def _word(k: int) -> Column:
    return F.xxhash64(F.lit(k), F.col("depth"), F.col("turn_hash"))


@dataclass(frozen=True)
class Sequences:
    """Distinct sequences (name, depth, k1, k2, weight, tokens), the conversations ending in each (name, conv_id), their turns."""

    distinct: DataFrame
    ends: DataFrame
    turns: DataFrame


def collapse(conversations: DataFrame, rebuilt: DataFrame) -> Sequences:
    """Group identical conversations; a sequence is named by the smallest of them and keeps the turns of that one."""
    whole = rebuilt.groupBy("conv_id").agg(
        F.count("*").alias("depth"), F.bit_xor(_word(1)).alias("k1"), F.bit_xor(_word(2)).alias("k2"), F.sum("chars").alias("tokens"))
    whole = conversations.join(whole, "conv_id", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in [*_KEY, "tokens"]])
    whole = stage(whole)
    distinct = stage(whole.groupBy(*_KEY).agg(
        F.min("conv_id").alias("name"), F.count("*").alias("weight"), F.min("tokens").alias("tokens")))
    ends = whole.join(distinct.select(*_KEY, "name"), _KEY).select("name", "conv_id")
    kept = rebuilt.join(distinct.select(F.col("name").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "name")
    return Sequences(distinct, ends, kept)


def prefixes(sequences: Sequences) -> DataFrame:
    """(name, weight, length, depth, k1, k2, p1, p2, chars, left) of every prefix of a sequence, as a table.

    p1 and p2 are the words of the prefix one turn shorter, left the tokens from its last turn on.
    """
    rows = sequences.turns.select(
        "name", "depth", "chars", _word(1).alias("w1"), _word(2).alias("w2"), F.floor((F.col("depth") - 1) / BLOCK).alias("block"))
    inside = Window.partitionBy("name", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.select(
        "*", F.bit_xor("w1").over(inside).alias("i1"), F.bit_xor("w2").over(inside).alias("i2"), F.sum("chars").over(inside).alias("so_far"))
    # One row per block of a sequence.
    sums = rows.groupBy("name", "block").agg(F.bit_xor("w1").alias("s1"), F.bit_xor("w2").alias("s2"), F.sum("chars").alias("s"))
    before = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select("name", "block", *[
        F.coalesce(f.over(before), zero).alias(c)
        for c, f in (("b1", F.bit_xor("s1")), ("b2", F.bit_xor("s2")), ("b", F.sum("s")))])
    info = sequences.distinct.select("name", "weight", "tokens", F.col("depth").alias("length"))
    found = within.join(sums, ["name", "block"])
    k1, k2 = F.col("i1").bitwiseXOR(F.col("b1")), F.col("i2").bitwiseXOR(F.col("b2"))
    found = found.select(
        "name", "depth", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("w1")).alias("p1"), k2.bitwiseXOR(F.col("w2")).alias("p2"),
        "chars", (F.col("so_far") + F.col("b") - F.col("chars")).alias("passed"))
    found = found.join(info, "name").withColumn("left", F.col("tokens") - F.col("passed"))
    columns = ["name", "weight", "length", *_KEY, "p1", "p2", "chars", "left"]
    null = F.lit(None).cast("long")
    roots = info.select(
        "name", "weight", "length", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), null.alias("p1"), null.alias("p2"),
        zero.alias("chars"), F.col("tokens").alias("left"))
    return stage(found.select(*columns).union(roots.select(*columns)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each name's texts in order, joined by commas, one text at a time."""
    name, state, last = None, None, None
    for batch in batches:
        if not len(batch):
            continue
        new = begins(batch, ["name"], last)
        last = batch.slice(len(batch) - 1)
        for first, own, text in zip(new, batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if first:
                if state:
                    yield pa.record_batch({"name": pa.array([name], pa.int64()), "ends_sha256": [state.hexdigest()]})
                name, state = own, sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if state:
        yield pa.record_batch({"name": pa.array([name], pa.int64()), "ends_sha256": [state.hexdigest()]})


def end_hashes(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): the hash of each sequence's conversations, ascending and joined by commas.

    Ids become texts block by block; only these texts, one per ``BLOCK`` ids, run through a hash in order.
    """
    rows = placed(ends, ["name"], ["conv_id"], "pos").withColumn("block", F.floor(F.col("pos") / BLOCK))
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    texts = rows.groupBy("name", "block").agg(F.array_join(ids, ",").alias("text"))
    return texts.repartition("name").sortWithinPartitions("name", "block").mapInArrow(_hashed, "name long, ends_sha256 string")


def nodes(conversations: DataFrame, run: int = RUN, heads: int = HEADS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie.

    ``conversations`` has conv_id and turn (long), role and text (string). Turns are ordered by turn, nulls first, those of one
    turn by their hash; repeated rows are turns of their own. Null roles and texts are empty. Rows without conv_id take no
    part. A node is named by its smallest conversation and its depth; the root has depth 0, all conversations and no
    parent. A conversation left without turns ends at the root. Other columns are not read; an empty table has no nodes.
    """
    sequences = collapse(*rebuild(turns(conversations), run, heads))
    rows = prefixes(sequences)
    found = stage(rows.groupBy(*_KEY).agg(
        F.min("name").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("length").alias("deepest"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars")))
    proper = found.where("deepest > depth").select(*_KEY)
    leaves = sequences.distinct.join(proper, _KEY, "left_anti").select("name", F.lit(1).alias("leaf"))
    owned = found.groupBy(F.col("conv_id").alias("name")).agg(F.min("depth").alias("from"), F.sum("chars").alias("own"))
    info = sequences.distinct.select("name").join(leaves, "name", "left").join(owned, "name", "left")
    once = F.when(F.col("depth") >= F.col("from"), F.col("left")).otherwise(F.coalesce("own", F.lit(0)))
    below = rows.join(info, "name").groupBy(*_KEY).agg(
        F.count("leaf").alias("n_leaves"), F.sum(F.col("weight") * F.col("left") - once).alias("saved_tokens"))
    up = found.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = up.groupBy(*_KEY).agg(F.count("*").alias("n_children"))
    ends = sequences.distinct.select("name", *_KEY).join(end_hashes(sequences.ends), "name").drop("name")
    parents = found.select((F.col("depth") + 1).alias("d"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = found.join(below, _KEY).join(children, _KEY, "left").join(ends, _KEY, "left")
    out = out.join(parents, (F.col("depth") == F.col("d")) & (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
