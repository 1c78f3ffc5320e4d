"""A source tree as a stream: every batch brings the files that changed since the one before.

The driver lists the tree and stores each listing that differs from the last; the number of the listing is the
offset, so a restarted stream plans the same batches. Files are read where the work is, some in each task.
Paths are addresses that pyarrow knows: local or shared folders, hdfs, s3, gs.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from graphloom.schema import CODE_EXTENSIONS, IGNORED_DIRECTORIES

SCHEMA = "project string, path string, content string, content_hash string, ts timestamp_ntz"
FILES_PER_TASK = 256
# Bytes of the files of one task, and of the texts that leave it at a time; a larger file goes by itself.
BYTES_PER_TASK, BYTES_PER_BATCH = 32 << 20, 4 << 20
_ARROW = pa.schema([*((name, pa.string()) for name in ("project", "path", "content", "content_hash")), ("ts", pa.timestamp("us"))])


@dataclass
class _Files(InputPartition):
    """Some files of a batch: (path, time in microseconds, whether it is there)."""

    files: list[tuple[str, int, bool]]


def _text(raw: bytes) -> str:
    """As decode_content of the batch source."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "latin-1")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), _ARROW.types)], schema=_ARROW) if rows \
        else pa.RecordBatch.from_pylist([], schema=_ARROW)


def _at(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("file:") else f"file://{address}")


class _TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self._root, self._listings = options["path"].rstrip("/"), options["listings"].rstrip("/")
        self._extensions, self._ignore = set(json.loads(options["extensions"])), set(json.loads(options["ignore"]))
        self._project = options["project"]
        self._per_task = int(options["files_per_task"])

    def _files(self) -> dict[str, list[int]]:
        """Size and time of every file of the tree."""
        system, base = _at(self._root)
        found = {}
        for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            path = info.path[len(base) :].lstrip("/")
            folders = path.split("/")[:-1]
            if info.is_file and path.rsplit(".", 1)[-1] in self._extensions and not self._ignore & set(folders):
                found[path] = [info.size, info.mtime_ns // 1000]
        return found

    def _listing(self, tick: int) -> dict:
        if tick < 0:
            return {"at": 0, "files": {}}
        system, base = _at(self._listings)
        with system.open_input_stream(f"{base}/{tick}.json") as stream:
            return json.loads(stream.read())

    def _last(self) -> int:
        system, base = _at(self._listings)
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return max((int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json")), default=-1)

    def initialOffset(self) -> dict:
        return {"tick": -1}

    def latestOffset(self) -> dict:
        tick, files = self._last(), self._files()
        if files != self._listing(tick)["files"]:
            tick += 1
            system, base = _at(self._listings)
            system.create_dir(base, recursive=True)
            # Moved into place, so that no half a listing is ever read.
            with system.open_output_stream(f"{base}/{tick}.new") as stream:
                stream.write(json.dumps({"at": time.time_ns() // 1000, "files": files}).encode())
            system.move(f"{base}/{tick}.new", f"{base}/{tick}.json")
        return {"tick": tick}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        before, now = self._listing(start["tick"])["files"], self._listing(end["tick"])
        files = [(p, v[1], True) for p, v in sorted(now["files"].items()) if before.get(p) != v]
        files += [(p, now["at"], False) for p in sorted(before.keys() - now["files"].keys())]
        parts, size = [[]], 0
        for file in files:
            more = now["files"][file[0]][0] if file[2] else 0
            if parts[-1] and (len(parts[-1]) == self._per_task or size + more > BYTES_PER_TASK):
                parts.append([])
                size = 0
            parts[-1].append(file)
            size += more
        return [_Files(part) for part in parts]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, base = _at(self._root)
        rows, size = [], 0
        for path, micros, there in partition.files:
            text = None
            if there:
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        text = _text(stream.read())
                except FileNotFoundError:
                    continue  # gone since it was listed: the next listing says so
            # What goes to Spark at once is held three times over, so it is measured in bytes, not in rows.
            if rows and size + len(text or "") > BYTES_PER_BATCH:
                yield _batch(rows)
                rows, size = [], 0
            rows.append((self._project, path, text, None if text is None else hashlib.md5(text.encode()).hexdigest(), micros))
            size += len(text or "")
        yield _batch(rows)

    def commit(self, end: dict) -> None:
        """Listings before the one that the next batch starts from are no longer needed."""
        system, base = _at(self._listings)
        for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if info.base_name.endswith(".json") and int(info.base_name[:-5]) < end["tick"] - 1:
                system.delete_file(info.path)


class TreeSource(DataSource):
    """The data source ``source_tree``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TreeReader(dict(self.options))


def watch_tree(
    spark: SparkSession,
    root: str,
    listings: str,
    *,
    project: str | None = None,
    extensions: Sequence[str] = ("md", *CODE_EXTENSIONS),
    ignore: Sequence[str] = tuple(IGNORED_DIRECTORIES),
    files_per_task: int = FILES_PER_TASK,
) -> DataFrame:
    """Stream of (project, path, content, content_hash, ts): files that are new or changed, and without content those gone.

    ``listings`` is a folder of this stream's own. A file that changes while it is read comes again with the next batch.
    """
    spark.dataSource.register(TreeSource)
    options = {
        "path": root, "listings": listings, "project": project or root.rstrip("/").rsplit("/", 1)[-1],
        "extensions": json.dumps(list(extensions)), "ignore": json.dumps(list(ignore)), "files_per_task": str(files_per_task)}
    return spark.readStream.format("source_tree").options(**options).load()
