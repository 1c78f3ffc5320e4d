"""Large JSON objects as rows: the elements of the arrays of one object, read in many tasks.

A file is cut at closing braces, which Spark's text reader splits anywhere. The pieces of a split stay in the task that reads
them and become chunks of about CHUNK bytes, with what each does to quotes, braces and brackets if it begins
outside a string or inside one. Whether it does, how deep it stands and how many elements ended before it are sums over the
chunks before; texts take no part in them. Elements within a chunk are then taken out where it is; only what
crosses an edge of chunks is put together from its parts.

An object may span several text files of a folder, in the order of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from graphloom.session import cut

# Bytes of a chunk; a longer piece is a chunk of its own.
CHUNK = 1 << 20
_SPLIT = ["unit", "file", "block"]
# What stands before the first brace outside a string.
_LEAD = r'''(?s)\A((?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+)\{'''
_NAME = r'(?s).*"([^"]*)"\s*:\s*\[\s*\z'
_WAY = "struct<more:bigint,wider:bigint,ends:array<struct<level:bigint,n:bigint>>>"
_CHUNKS = f"file string, block bigint, size bigint, at bigint, bytes bigint, quotes bigint, ways array<{_WAY}>, text string"
_PARTS = "unit string, file string, block bigint, at bigint, number bigint, part boolean, whole boolean, lead string, text string"
_MARKED = np.zeros(256, bool)
_MARKED[list(b'"{}[]')] = True


class _Marks:
    """Braces and brackets outside strings, for a text that begins outside one (``odd`` 0) or inside (1)."""

    def __init__(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        marked = _MARKED[data]
        slashes = np.flatnonzero(data == ord("\\"))
        if len(slashes):
            first = slashes[np.diff(slashes, prepend=-2) > 1]
            last = slashes[np.diff(slashes, append=len(data) + 1) > 1]
            # What follows an odd run of backslashes is escaped; a piece's own brace is none of its text.
            after = last[(last - first) % 2 == 0] + 1
            after = after[after < len(data)]
            marked[after[data[after] != ord("}")]] = False
        at = np.flatnonzero(marked)
        kinds = data[at]
        quote = kinds == ord('"')
        self.quotes = int(quote.sum())
        self._inside = np.cumsum(quote)[~quote] % 2
        self._at, self._kinds = at[~quote], kinds[~quote]

    def of(self, odd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and characters, and the depth in braces and in brackets after each."""
        own = self._inside == odd
        at, kinds = self._at[own], self._kinds[own]
        braces = np.cumsum((kinds == ord("{")).astype(np.int64) - (kinds == ord("}")))
        brackets = np.cumsum((kinds == ord("[")).astype(np.int64) - (kinds == ord("]")))
        return at, kinds, braces, brackets


def _way(marks: _Marks, odd: int, end: int) -> dict:
    """What the text up to ``end`` does: braces and brackets left open, closing braces by the depth they lead to."""
    at, kinds, braces, brackets = marks.of(odd)
    n = int(np.searchsorted(at, end))
    # Depths begin at zero or more, so only those up to one can be the object's own.
    levels, counts = np.unique(braces[:n][(kinds[:n] == ord("}")) & (braces[:n] <= 1)], return_counts=True)
    ends = [{"level": level, "n": count} for level, count in zip(levels.tolist(), counts.tolist())]
    return {"more": int(braces[n - 1]) if n else 0, "wider": int(brackets[n - 1]) if n else 0, "ends": ends}


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Pieces (file, block, size, value) in the order of their splits as chunks, braces put back."""
    way = pa.struct([("more", pa.int64()), ("wider", pa.int64()), ("ends", pa.list_(pa.struct([("level", pa.int64()), ("n", pa.int64())])))])
    at = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file"), batch.column("block")
        value = batch.column("value").cast(pa.string())
        filled = np.cumsum(pc.binary_length(value).to_numpy(zero_copy_only=False) + 1) // chunk
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(new | (np.diff(filled) > 0)) + 1, [batch.num_rows]])
        pieces = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), value)
        for i, low in enumerate(starts[:-1].tolist()):
            text = pc.binary_join(pieces[i : i + 1], "}")[0].as_buffer().to_pybytes() + b"}"
            marks = _Marks(text)
            # The last two are for a file that does not end with a brace.
            ways = [_way(marks, odd, end) for end in (len(text), len(text) - 1) for odd in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [file[low : low + 1], block[low : low + 1], batch.column("size")[low : low + 1], *(pa.array([x], pa.int64()) for x in (at, len(text), marks.quotes)),
                 pa.array([ways], pa.list_(way)), _texts(text, np.array([0, len(text)]))],
                names=["file", "block", "size", "at", "bytes", "quotes", "ways", "text"])
            at += 1


def _texts(text: bytes, edges: np.ndarray) -> pa.Array:
    """The text in pieces between the edges."""
    return pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(text))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their place in the object as elements with what stands before each, and as parts of those that cross an edge."""
    for batch in batches:
        places = batch.drop_columns(["text"]).to_pylist()
        for place, value in zip(places, batch.column("text")):
            text = value.as_buffer().to_pybytes()
            text = text[:-1] if place["open"] else text
            at, kinds, braces, brackets = _Marks(text).of(place["odd"])
            # Only the object itself is open after these; an element of one of its arrays ends there if an array is, too.
            last = np.flatnonzero((kinds == ord("}")) & (braces + place["braces"] == 1))
            whole = brackets[last] + place["brackets"] == 1
            edges = np.concatenate([[0], at[last] + 1])
            number = place["number"]
            # The first may have begun before, what is left ends later.
            sides = [(number, 0, edges[1] if len(last) else len(text), bool(len(last)) and bool(whole[0]))]
            if len(last) and edges[-1] < len(text):
                sides.append((number + len(last), edges[-1], len(text), False))
            n = len(sides)
            yield pa.RecordBatch.from_arrays(
                [*(pa.repeat(pa.scalar(place[c], t), n) for c, t in (("unit", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()))),
                 pa.array([s[0] for s in sides], pa.int64()), pa.repeat(True, n), pa.array([s[3] for s in sides]), pa.repeat(pa.scalar("", pa.string()), n),
                 pa.array([text[s[1] : s[2]] for s in sides], pa.binary()).view(pa.string())],
                names=_names(_PARTS))
            inner = np.flatnonzero(whole[1:]) + 1
            if len(inner):
                opening = np.append(at[kinds == ord("{")], len(text))
                first = opening[np.searchsorted(opening, edges[:-1])]
                # Without a brace of its own nothing is before it.
                first = np.where(first < edges[1:], first, edges[:-1])
                both = _texts(text, np.append(np.stack([edges[:-1], first], axis=1).reshape(-1), edges[-1]))
                n = len(inner)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(place["unit"], pa.string()), n), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                     pa.array(number + inner, pa.int64()), pa.repeat(False, n), pa.repeat(True, n), both.take(pa.array(2 * inner)), both.take(pa.array(2 * inner + 1))],
                    names=_names(_PARTS))


def _names(layout: str) -> list[str]:
    return [field.split()[0] for field in layout.split(", ")]


def _running(rows: DataFrame, **values: Column) -> DataFrame:
    """Each name as a column: the sum of its value over the chunks before, in the order of files, splits and places."""
    rows = rows.withColumns({f"_v_{n}": v.cast("long") for n, v in values.items()})
    inside = Window.partitionBy(*_SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # One row per split of a file.
    sums = rows.groupBy(*_SPLIT).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = Window.partitionBy("unit").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*_SPLIT, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    within = rows.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values})
    out = within.join(bases, _SPLIT).withColumns({n: F.col(f"_i_{n}") + F.col(f"_b_{n}") for n in values})
    return out.drop(*[f"{k}{n}" for k in ("_v_", "_i_", "_b_") for n in values])


def _placed(chunks: DataFrame) -> DataFrame:
    """Where each chunk stands: inside a string or not, how deep, after how many ended objects."""
    files = chunks.groupBy("unit", "file").agg(
        F.max(F.struct("block", "at")).alias("last"), (F.sum("bytes") > F.max("size")).alias("open"))
    # The reader drops the braces; a file that does not end with one has a last piece without.
    ends = files.where("open").select("unit", "file", F.col("last.block").alias("block"), F.col("last.at").alias("at"), F.lit(True).alias("open"))
    rows = chunks.join(ends, [*_SPLIT, "at"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    rows = _running(rows, _quotes=F.col("quotes")).withColumn("odd", F.col("_quotes") % 2)
    way = F.element_at("ways", (F.col("odd") + F.when(F.col("open"), 3).otherwise(1)).cast("int"))
    rows = _running(rows.withColumn("_way", way), braces=F.col("_way.more"), brackets=F.col("_way.wider"))
    ended = F.filter("_way.ends", lambda e: e["level"] + F.col("braces") == 1)
    rows = _running(rows, number=F.aggregate(ended, F.lit(0).cast("long"), lambda total, e: total + e["n"]))
    return rows.select(*_SPLIT, "at", "open", "odd", "braces", "brackets", "number")


def read_elements(spark: SparkSession, path: str, unit: Column, glob: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(unit, name, pos, element): the objects in the arrays of each unit's one JSON object, as JSON texts.

    ``unit`` says from ``_metadata`` (file_path, file_name, file_size) which object a file belongs to; ``name`` is the key of the
    array, ``pos`` the place in it. Elements of other kinds than objects are left out.
    """
    reader = spark.read.option("lineSep", "}")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    pieces = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")
    about = F.struct(F.col("file").alias("file_path"), F.substring_index("file", "/", -1).alias("file_name"), F.col("size").alias("file_size"))
    # Written, as its places must stay the same for all that follows.
    chunks = cut(pieces.mapInArrow(lambda batches: _chunks(batches, chunk), _CHUNKS).withColumn("_metadata", about).withColumn("unit", unit).drop("_metadata"))
    # Written, so that the planner knows how small it is and does not move the texts.
    placed = cut(_placed(chunks.drop("text")))
    parts = cut(chunks.select(*_SPLIT, "at", "text").join(placed, [*_SPLIT, "at"]).mapInArrow(_elements, _PARTS))

    pieces = F.array_sort(F.collect_list(F.struct("file", "block", "at", "text")))
    joined = parts.where("part").groupBy("unit", "number").agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"), F.max("whole").alias("whole")).where("whole")
    # The first one comes with the object's own brace.
    joined = joined.withColumn("text", F.when(F.col("number") == 0, F.regexp_replace("text", r"\A[^{]*\{", "")).otherwise(F.col("text")))
    joined = joined.withColumn("lead", F.regexp_extract("text", _LEAD, 1))
    columns = ["unit", "number", "lead"]
    whole = parts.where("not part").select(*columns, F.col("text").alias("element")).unionByName(
        joined.select(*columns, F.expr("substring(text, length(lead) + 1)").alias("element")))
    # As many as the object has arrays; written for its size, as above.
    name = F.when(F.contains("lead", F.lit("[")), F.regexp_extract("lead", _NAME, 1)).otherwise("")
    named = whole.select("unit", "number", name.alias("name")).where("name <> ''")
    starts = cut(named.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("number", "name"))).alias("starts")))
    own = F.try_element_at(F.filter("starts", lambda s: s["number"] <= F.col("number")), F.lit(-1))
    found = whole.join(starts, "unit").withColumn("_own", own)
    return found.select("unit", "_own.name", (F.col("number") - F.col("_own.number")).alias("pos"), "element")
