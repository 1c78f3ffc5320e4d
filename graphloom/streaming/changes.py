"""File changes as they happen.

Batch and streaming forms of the same rules. The streaming ones keep one small
value per path; deletions need snapshot rows, as a file source never reports them.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from graphloom.functions.text import base_name, has_component
from graphloom.operators.incremental import Update, apply_incremental, update_changed
from graphloom.schema import WATCH_IGNORED, WATCHED_EXTENSIONS
from graphloom.session import cut
from graphloom.sinks.store import GraphStore

# --- fixed values: defaults in seconds --------------------------------------
DEBOUNCE_SECONDS = 1.0
POLL_SECONDS = 2.0
COOLDOWN_SECONDS = 5.0
# --- end of fixed values ----------------------------------------------------

# Length of the time blocks of a debounce, in multiples of its gap.
BLOCK_GAPS = 64
# Length of the time blocks of streamed snapshots, in which late rows wait.
WATCH_BLOCK_SECONDS = 60.0

# Rows of a key that are put in order at once, and that an entry of its state may hold over several blocks.
AT_ONCE = 1 << 12

# The state store that transformWithState needs.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def watch_filter(
    path: Column,
    patterns: Sequence[str] = tuple(f"*.{e}" for e in WATCHED_EXTENSIONS),
    ignore: Sequence[str] = tuple(WATCH_IGNORED),
) -> Column:
    """Whether a path is watched: its base name fits a glob and no component is ignored."""
    globs = [
        "".join({"*": ".*", "?": "."}.get(ch, rf"\Q{ch}\E") for ch in pattern) for pattern in patterns
    ]
    name = base_name(path)
    ignored = has_component(path, list(ignore)) | name.isin(list(ignore))
    return name.rlike("(?s)^(?:" + "|".join(globs) + ")$") & ~ignored


class InOrder(StatefulProcessor):
    """Rows of a key in the order of their times, however they arrive.

    ``late`` keeps rows in state until the watermark has passed the end of their block of time, by an event-time timer; else
    everything is released with the micro-batch that brought it. ``step`` sees sorted rows, those of some blocks at a time.
    State and steps cost by the entry, so up to AT_ONCE rows make one, over any blocks; a key with more has one entry per
    block and batch, never all rows at once.
    """

    def __init__(self, width: int, late: bool, columns: Sequence[str]):
        self._width, self._late, self._columns = width, late, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._parts = handle.getMapState("parts", "block bigint, part bigint", "rows binary")
        self._count = handle.getValueState("count", "n bigint")
        self._alarm = handle.getValueState("alarm", "ms bigint")
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, size, part, first = [], 0, None, None
        for frame in rows:
            if frame.empty:
                continue
            least = int(_micros(frame).min()) // self._width
            first = least if first is None else min(first, least)
            held.append(frame[self._columns])
            size += len(frame)
            if size > AT_ONCE:
                part = self._put(held, part, True)
                held, size = [], 0
        if first is None:
            return
        if not self._late and part is None:
            yield self.step(key, _sorted(held))
            return
        if held:
            part = self._put(held, part, False)
        self._count.update((part,))
        if not self._late:
            yield from self._release(key, None)
        else:
            self._wake(first)

    def _put(self, held: list[pd.DataFrame], part: int | None, by_block: bool) -> int:
        """Rows into state, as one entry by their first block or as one for each; the number of the next entry."""
        if part is None:
            part = self._count.get()[0] if self._count.exists() else 0
        rows = pd.concat(held, ignore_index=True)
        blocks = _micros(rows) // self._width
        for block, some in rows.groupby(blocks, sort=False) if by_block else [(blocks.min(), rows)]:
            # Rows of one time stay in the order they came in, also when entries are put together anew.
            some = some if "_came" in some.columns else some.assign(_came=part)
            self._parts.updateValue((int(block), part), (_packed(some),))
            part += 1
        return part

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._alarm.clear()
        left = yield from self._release(key, timerValues.getCurrentWatermarkInMs() * 1000)
        if left is not None:
            self._wake(left)

    def _wake(self, block: int) -> None:
        end = -(-(block + 1) * self._width // 1000)
        if not self._alarm.exists() or end < self._alarm.get()[0]:
            self._handle.registerTimer(end)
            self._alarm.update((end,))

    def _release(self, key: tuple, now: int | None):
        """Pass on the rows of the blocks that ended by ``now``, all for None; the first block that stays."""
        places = sorted(tuple(k) for k in self._parts.keys())
        left, at = [], 0  # rows of entries that are open, in pieces
        while at < len(places) or left:
            # Open entries may hold rows of any later block, so blocks are taken in order, as many as make up AT_ONCE rows.
            ahead = min(b for b in [places[at][0] if at < len(places) else None, _least(left, self._width)] if b is not None)
            if now is not None and (ahead + 1) * self._width > now:
                break
            size = sum(map(len, left))
            while at < len(places) and (now is None or (places[at][0] + 1) * self._width <= now) and (
                    size < AT_ONCE or places[at][0] == ahead):
                left.append(_unpacked(self._parts.getValue(places[at])[0]))
                self._parts.removeKey(places[at])
                size += len(left[-1])
                at += 1
            # Rows before the next entry's block are all here.
            bound = places[at][0] * self._width if at < len(places) else None
            if now is not None:
                ended = now // self._width * self._width
                bound = ended if bound is None else min(bound, ended)
            rows = pd.concat(left, ignore_index=True)
            ready = np.ones(len(rows), bool) if bound is None else _micros(rows) < bound
            if ready.any():
                yield self.step(key, _sorted([rows[ready]]))
            left = [rows[~ready]] if not ready.all() else []
        if left:
            # One entry holds what its blocks leave; its number is free, as it was taken out.
            rows = pd.concat(left, ignore_index=True)
            self._count.update((self._put([rows], None, len(rows) > AT_ONCE),))
        stay = [b for b in [places[at][0] if at < len(places) else None, _least(left, self._width)] if b is not None]
        return min(stay) if stay else None

    def close(self) -> None:
        pass


def _micros(frame: pd.DataFrame) -> np.ndarray:
    return frame["ts"].astype("datetime64[us]").astype("int64").to_numpy()


def _least(frames: list[pd.DataFrame], width: int) -> int | None:
    """The first block of some rows."""
    return min((int(_micros(frame).min()) // width for frame in frames), default=None)


def _sorted(frames: list[pd.DataFrame]) -> pd.DataFrame:
    rows = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    return rows.sort_values(["ts", "_came"] if "_came" in rows.columns else "ts", kind="stable", ignore_index=True)


def _packed(frame: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def _in_order(rows: DataFrame, keys: Sequence[str], processor: InOrder, schema, delay: str | None) -> DataFrame:
    """Run a processor over a stream with ``ts`` (timestamp_ntz); rows without a time take no part."""
    _by_value()
    rows.sparkSession.conf.set(*STATE_STORE)
    rows = rows.where("ts is not null")
    if delay is not None:
        rows = rows.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", delay)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None" if delay is None else "EventTime")


class _Changes(InOrder):
    """Last hash per path; a snapshot row without a hash says the file is gone."""

    def start(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "hash string")

    def step(self, key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        before = self._last.get()[0] if self._last.exists() else None
        column = frame["content_hash"]
        now = column.to_numpy(dtype=object, copy=True)
        now[column.isna().to_numpy()] = None
        was = np.append(np.array([before], dtype=object), now[:-1])
        changed = now != was
        last = now[-1]
        if last is None:
            self._last.clear()
        elif last != before:
            self._last.update((last,))
        kind = np.where(np.equal(was, None), "created", np.where(np.equal(now, None), "deleted", "modified"))
        out = {"project": key[0], "path": key[1], "change_type": kind[changed], "ts": frame["ts"].to_numpy()[changed]}
        return pd.DataFrame(out)


def _by_value() -> None:
    """Send the processors themselves: the process that prepares them has no shipped packages."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def watch_changes(snapshots: DataFrame, delay: str | None = None, seconds: float = WATCH_BLOCK_SECONDS) -> DataFrame:
    """Change events of a stream of (project, path, content_hash, ts) snapshot rows.

    Without ``delay`` rows arrive in time order from batch to batch, and events are given at once. With one, such as
    "10 minutes", rows may be that late: they are put in order, and events come once the watermark has passed the
    end of their block of ``seconds``. Rows later than that are dropped.
    """
    processor = _Changes(int(seconds * 1_000_000), delay is not None, ["content_hash", "ts"])
    schema = "project string, path string, change_type string, ts timestamp_ntz"
    return _in_order(snapshots, ["project", "path"], processor, schema, delay)


def _followed(after: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Everything that following ``after`` from the marked places leads to; pointers are doubled, so in a logarithm of steps."""
    n = len(after)
    jump, marked = np.append(after, n), np.append(marked, False)
    for _ in range(n.bit_length() + 1):
        marked[jump[marked]] = True
        jump = jump[jump]
    return marked[:n]


def _keep(ts: np.ndarray, gap: int, last: int | None) -> np.ndarray:
    """Which sorted times are kept when each must be ``gap`` after the last kept one."""
    first = 0 if last is None else int(np.searchsorted(ts, last + gap))
    marked = np.zeros(len(ts), dtype=bool)
    marked[first : first + 1] = True
    return _followed(np.searchsorted(ts, ts + gap), marked)


class _Debounce(InOrder):
    """Time of the last emitted event per key, in microseconds."""

    def __init__(self, gap: int, late: bool, columns: Sequence[str]):
        super().__init__(gap * BLOCK_GAPS, late, columns)
        self._gap = gap

    def start(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "us bigint")

    def step(self, key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        times = _micros(frame)
        kept = _keep(times, self._gap, self._last.get()[0] if self._last.exists() else None)
        if kept.any():
            self._last.update((int(times[kept][-1]),))
        return frame.loc[kept, self._columns]


def debounce_stream(events: DataFrame, keys: Sequence[str], seconds: float = DEBOUNCE_SECONDS, delay: str | None = None) -> DataFrame:
    """Events of a stream at least ``seconds`` after the last emitted one of their key.

    Events carry ``ts`` (timestamp_ntz). Without ``delay`` they arrive in time order from batch to batch. With one they may be
    that late, and what is emitted is what ``debounce`` keeps of the whole; an event comes once the watermark has
    passed the end of its block of BLOCK_GAPS gaps. Later ones are dropped.
    """
    processor = _Debounce(int(seconds * 1_000_000), delay is not None, events.columns)
    return _in_order(events, keys, processor, events.schema, delay)


def _chunks(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list]]:
    """Sorted batches cut so that no run of equal keys is split, with the runs' bounds."""
    held: list[pd.DataFrame] = []  # the run that may go on, in pieces
    for frame in frames:
        if frame.empty:
            continue
        runs = _runs(frame, keys)
        if held and not (len(runs) == 1 and _same(held[-1], frame, keys)):
            # The held run ends within this batch or before it.
            cut = runs[0][1] if _same(held[-1], frame, keys) else 0
            whole = pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
            yield whole, [(0, len(whole))]
            held, frame = [], frame.iloc[cut:]
            runs = [(start - cut, end - cut) for start, end in runs if end > cut]
        if not held and len(runs) > 1:
            yield frame.iloc[: runs[-1][0]], runs[:-1]
            frame = frame.iloc[runs[-1][0] :]
        held.append(frame)
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, [(0, len(whole))]


def _same(before: pd.DataFrame, after: pd.DataFrame, keys: list[str]) -> bool:
    """Whether the last row of one batch and the first of the next have one key."""
    return all(before[k].iloc[-1] == after[k].iloc[0] for k in keys)


def _runs(frame: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    changed = np.zeros(len(frame), dtype=bool)
    changed[0] = True
    for key in keys:
        values = frame[key].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(changed).tolist()
    return list(zip(starts, [*starts[1:], len(frame)]))


def debounce(events: DataFrame, keys: Sequence[str], seconds: float = DEBOUNCE_SECONDS) -> DataFrame:
    """The same for a table of (keys, ts) rows, exact and without one task per key.

    A key's time is cut into blocks of BLOCK_GAPS gaps. What a block keeps depends
    on the time kept before it only through the first event it can keep, and that
    lies within one gap of its start (or is the first one after). So each block
    reports, for those few events, the last time it would keep, equal neighbours
    merged; a scan over these small tables finds from when on every block may keep;
    the blocks are then resolved independently. Null is a key like any other.
    """
    gap = int(seconds * 1_000_000)
    width = gap * BLOCK_GAPS
    columns = events.columns
    # One text per key, so that nulls compare equal.
    key, keys = F.to_json(F.struct(*keys)), ["_key"]
    keyed = [*keys, "_block"]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.withColumns({"_key": key, "_us": us, "_block": F.floor(us / width)})
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in keyed)

    def exits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, runs in _chunks(frames, keyed):
            times, blocks, parts = frame["_us"].to_numpy(), frame["_block"].to_numpy(), []
            for start, end in runs:
                ts = np.unique(times[start:end])
                # Where following the gaps ends, by doubled pointers.
                jump = np.searchsorted(ts, ts + gap)
                jump = np.where(jump < len(ts), jump, np.arange(len(ts)))
                for _ in range(len(ts).bit_length()):
                    jump = jump[jump]
                last = ts[jump]
                n = int(np.searchsorted(ts, blocks[start] * width + gap)) + 1
                first, last = ts[:n], last[:n]
                run_end = np.append(last[1:] != last[:-1], True)
                parts.append((np.full(int(run_end.sum()), start), first[run_end], last[run_end]))
            rows_at, first, last = (np.concatenate(p) for p in zip(*parts))
            yield frame[keyed].iloc[rows_at].assign(_first=first, _last=last)

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, None
        for frame, runs in _chunks(frames, keyed):
            firsts, lasts = frame["_first"].to_numpy(), frame["_last"].to_numpy()
            blocks, owners = frame["_block"].to_numpy(), list(zip(*[frame[k] for k in keys]))
            found = []
            for start, end in runs:
                if owners[start] != current:
                    current, kept = owners[start], None
                entry = int(blocks[start]) * width if kept is None else kept + gap
                found.append((start, entry))
                i = start + int(np.searchsorted(firsts[start:end], entry))
                if i < end:
                    kept = int(lasts[i])
            rows_at, entry = zip(*found)
            yield frame[keyed].iloc[list(rows_at)].assign(_entry=np.array(entry, dtype="int64"))

    def resolve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, runs in _chunks(frames, keyed):
            times, entry = frame["_us"].to_numpy(), frame["_entry"].to_numpy()
            kept = np.concatenate([_keep(times[s:e], gap, int(entry[s]) - gap) for s, e in runs])
            yield frame.loc[kept, columns]

    def sorted_by(frame, partition, *order):
        return frame.repartition(*partition).sortWithinPartitions(*order)

    tables = sorted_by(rows.select(*keyed, "_us"), keyed, *keyed, "_us").mapInPandas(
        exits, f"{key_schema}, _first bigint, _last bigint"
    )
    found = sorted_by(tables, keys, *keyed, "_first").mapInPandas(entries, f"{key_schema}, _entry bigint")
    joined = sorted_by(rows.join(found, keyed), keyed, *keyed, "_us")
    return joined.mapInPandas(resolve, events.schema)


def watch_and_update(
    snapshots: DataFrame,
    load: Callable[[], tuple],
    store: Callable[[Update, int], None],
    checkpoint: str,
    cooldown: float = COOLDOWN_SECONDS,
    **options,
) -> DataStreamWriter:
    """Update a stored graph from a stream of file rows, at most once per ``cooldown``.

    ``load()`` returns (files now, manifest, graph); every batch that brings rows
    compares the listing with the manifest, so deletions are seen too, and hands
    the update to ``store``. Call ``.start()`` on the result.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        files, manifest, graph = load()
        store(apply_incremental(files, manifest, graph, generation=batch_id + 1, **options), batch_id)

    return (
        snapshots.writeStream.foreachBatch(update)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{cooldown} seconds")
    )


def update_from_tree(changed: DataFrame, store: GraphStore, checkpoint: str, **options) -> DataStreamWriter:
    """Update a graph store from a stream of changed files (see watch_tree), one generation per batch.

    Rows without content take a file's rows out, others are extracted and upserted. A batch that is run again leaves
    the store as it was. Call ``.start()`` on the result, with a trigger of at least the cooldown.
    """
    def update(batch: DataFrame, batch_id: int) -> None:
        batch = cut(batch)
        if not batch.isEmpty():
            update_changed(store, batch, **options)

    return changed.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(
        processingTime=f"{COOLDOWN_SECONDS} seconds")
