"""Progress files that grow: a stream of whole lines, with the bytes read of each file as its offset."""

from __future__ import annotations

import json
from datetime import datetime

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads at most, but for the end of its last line.
PIECE = 64 << 20
_BLOCK = 1 << 16


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def whole_lines(system: fs.FileSystem, path: str, size: int, known: int) -> int:
    """Where the last whole line within the first `size` bytes ends; `known` if there is none after it. Read from the end, block by block."""
    with system.open_input_file(path) as f:
        at = size
        while at > known:
            start = max(known, at - _BLOCK)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return known


class Piece(InputPartition):
    def __init__(self, path: str, start: int, stop: int, first: bool):
        self.path, self.start, self.stop, self.first = path, start, stop, first


class ProgressReader(DataSourceStreamReader):
    """Offsets are {path: bytes of whole lines}: what follows the last newline stays for a later batch, and a file that grows is read on."""

    def __init__(self, path: str, schema):
        self.path, self.schema, self.seen = path, schema, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, base = _open(self.path)
        files = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        now = dict(self.seen)
        for f in files:
            if f.is_file and not f.base_name.startswith((".", "_")):
                # A file that has shrunk is not read again; it goes on where it was when it is longer.
                now[f.path] = whole_lines(system, f.path, f.size, now.get(f.path, 0)) if f.size > now.get(f.path, 0) else now[f.path] if f.path in now else 0
        self.seen = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, stop in sorted(end.items()):
            first = start.get(path, 0)
            out += [Piece(path, at, min(at + PIECE, stop), at == first) for at in range(first, stop, PIECE)]
        return out or [Piece("", 0, 0, True)]

    def read(self, piece: Piece):
        """The lines that begin within the piece."""
        if piece.start >= piece.stop:
            return
        system, _ = _open(self.path)
        with system.open_input_file(piece.path) as f:
            at = piece.start
            f.seek(at if piece.first else at - 1)
            rest = b"" if piece.first else None  # a line that began before belongs to the piece before
            if rest is None:
                at -= 1
            while at < piece.stop or rest:
                block = f.read(_BLOCK)
                if not block:
                    break
                if rest is None:
                    cut = block.find(b"\n") + 1
                    at += cut or len(block)
                    if not cut:
                        continue
                    block, rest = block[cut:], b""
                lines = (rest + block).split(b"\n")
                begin = at
                rest = lines.pop()
                for line in lines:
                    if begin >= piece.stop:
                        return
                    begin += len(line) + 1
                    yield self.row(line)
                at = begin
        return

    def row(self, line: bytes) -> tuple:
        """job, done, total, page, status and ts; all null where the line is no JSON object."""
        try:
            values = json.loads(line)
            values = values if isinstance(values, dict) else {}
        except ValueError:
            values = {}
        number = lambda name: int(values[name]) if isinstance(values.get(name), int) else None
        text = lambda name: None if values.get(name) is None else str(values[name])
        try:
            ts = datetime.fromisoformat(values["ts"])
        except (KeyError, TypeError, ValueError):
            ts = None
        return text("job"), number("done"), number("total"), number("page"), text("status"), ts

    def commit(self, end: dict) -> None:
        return


class ProgressSource(DataSource):
    """spark.readStream.format("progress_lines").load(folder): JSON-lines progress of files that may be written to meanwhile."""

    @classmethod
    def name(cls) -> str:
        return "progress_lines"

    def schema(self) -> str:
        return "job string, done bigint, total bigint, page bigint, status string, ts timestamp"

    def streamReader(self, schema) -> ProgressReader:
        return ProgressReader(self.options["path"], schema)
