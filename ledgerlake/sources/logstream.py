"""A streaming source of session logs: files that are new or changed, as splits of lines.

An offset is the number of a listing, and a listing holds what is known of each file: size, time of change and
parser version. A look at the folders that finds a difference to the newest listing writes the next one, so offsets
stay small however many files there are, and a restarted query compares with what it saw before. Between
two listings the files whose entries differ are read whole, in splits, up to the size that the listing has.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, block bigint, seq bigint, text string, size bigint, modified timestamp_ntz"
#: Folders below a root that are searched; bytes of a split.
DEPTH, SPLIT_BYTES = 12, 64 << 20
#: Lines of a batch, bytes of a read.
_LINES, _PIECE = 8192, 1 << 20


def _opened(root: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a folder, its path there, and what stands before the path in names."""
    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/"), root.rstrip("/").removesuffix(path.rstrip("/"))


def look(roots: list[str], pattern: str, parser: int) -> dict[str, list[int]]:
    """name: [size, microseconds of change, parser] of the files of a pattern, whatever their case."""
    found = {}
    for root in roots:
        system, path, prefix = _opened(root)
        for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True)):
            deep = info.path.removeprefix(path).count("/") > DEPTH
            if info.type == fs.FileType.File and not deep and fnmatch(info.base_name.lower(), pattern.lower()):
                found[f"{prefix}{info.path}"] = [info.size, (info.mtime_ns or 0) // 1000, parser]
    return found


class Split(InputPartition):
    def __init__(self, name: str, size: int, modified: int, start: int, stop: int):
        self.name, self.size, self.modified, self.start, self.stop = name, size, modified, start, stop


class Listings:
    """The numbered listings of a source, in a folder that driver restarts share."""

    def __init__(self, folder: str):
        self.system, self.path, _ = _opened(folder)

    def newest(self) -> int:
        files = self.system.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return max((int(f.base_name[:-5]) for f in files if f.base_name.endswith(".json")), default=0)

    def get(self, number: int) -> dict[str, list[int]]:
        if number <= 0:
            return {}
        with self.system.open_input_stream(f"{self.path}/{number}.json") as f:
            return json.loads(f.read())

    def put(self, number: int, listing: dict[str, list[int]]) -> None:
        self.system.create_dir(self.path)
        with self.system.open_output_stream(f"{self.path}/{number}.part") as f:
            f.write(json.dumps(listing).encode())
        self.system.move(f"{self.path}/{number}.part", f"{self.path}/{number}.json")

    def drop_before(self, number: int) -> None:
        for f in self.system.get_file_info(fs.FileSelector(self.path, allow_not_found=True)):
            if f.base_name.endswith(".json") and int(f.base_name[:-5]) < number:
                self.system.delete_file(f.path)


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.roots, self.pattern = json.loads(options["roots"]), options.get("pattern", "*.jsonl")
        self.parser, self.split = int(options.get("parser", 1)), int(options.get("splitBytes", SPLIT_BYTES))
        self.folder = options["listings"]

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        listings = Listings(self.folder)
        newest, now = listings.newest(), look(self.roots, self.pattern, self.parser)
        if now != listings.get(newest):
            newest += 1
            listings.put(newest, now)
        return {"listing": newest}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        listings = Listings(self.folder)
        before, after = listings.get(start["listing"]), listings.get(end["listing"])
        changed = [(name, x[0], x[1]) for name, x in sorted(after.items()) if before.get(name) != x]
        return [Split(name, size, modified, at, min(at + self.split, size)) for name, size, modified in changed for at in range(0, size, self.split)]

    def commit(self, end: dict) -> None:
        Listings(self.folder).drop_before(end["listing"])

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str]] = []
        for number, line in enumerate(_lines(partition)):
            rows.append((number, line.decode("utf-8", "replace")))
            if len(rows) == _LINES:
                yield _batch(partition, rows)
                rows = []
        if rows:
            yield _batch(partition, rows)


def _lines(split: Split) -> Iterator[bytes]:
    """Lines that begin in a split, without line breaks; bytes after the listed size are left for the next listing."""
    system, path, _ = _opened(split.name)
    with system.open_input_file(path) as f:
        at = max(0, split.start - 1)
        f.seek(at)
        pending, ending, begun = b"", split.start > 0, split.start  # ending: reading the end of a line of the split before
        while at < split.size and (ending or begun < split.stop):
            piece = f.read(min(_PIECE, split.size - at))
            if not piece:
                break
            at += len(piece)
            *whole, pending = (pending + piece).split(b"\n")
            for line in whole:
                if ending:
                    ending, begun = False, split.start + len(line)
                elif begun < split.stop:
                    yield line
                    begun += len(line) + 1
        if pending and not ending and begun < split.stop:
            yield pending


def _batch(split: Split, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([split.name] * n), pa.array([split.start] * n), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([split.size] * n), pa.array([split.modified] * n, pa.timestamp("us"))],
        names=["path", "block", "seq", "text", "size", "modified"],
    )


class LogSource(DataSource):
    """Options: roots (a JSON list of folders), listings (a folder), pattern, parser, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "session_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))
