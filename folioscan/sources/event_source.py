"""A streaming source of server-sent events that are logged to files, and its offsets.

Logs grow while they are read. An offset has a position in bytes for each file. It may lie anywhere in an event, by a
limit on bytes or because a range is dealt over tasks: a reader of [start, stop) gives the events that begin there, looks
for the first such beginning itself, and reads beyond `stop` to the end of the last one. So each event is given once,
whatever the limits. What follows a log's last blank line isn't complete, and no offset goes beyond that line.

    spark.dataSource.register(EventLogs)
    spark.readStream.format("event_logs").option("path", ...).load()      # file, position, body

Paths are what pyarrow's file systems open (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, position long, body string"
#: Bytes that are read at once, and bytes of a task's range unless the option split_bytes says other.
CHUNK, SPLIT = 1 << 20, 16 << 20
#: One or more blank lines end an event. The longest that a search must look back from an event's beginning is two CR LF.
_END, _BACK = re.compile(rb"(?:\r?\n){2,}"), 4


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+://?", path) else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    """The events of a file that begin at `start` or later and before `stop`."""

    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


def events_between(read, start: int, stop: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) of the events that begin in [start, stop); read(position, n) gives up to n bytes. An event's end must be there."""
    at = max(0, start - _BACK)  # of the buffer's first byte
    buffer, begins = b"", 0 if start == 0 else None
    more = True
    while True:
        ends = _END.search(buffer, 0 if begins is None else begins - at)
        while ends and (buffer[ends.end() :][:2] not in (b"", b"\r") or not more):  # a run of blank lines may go on in the next chunk
            next_ = at + ends.end()
            if begins is not None:
                body = buffer[begins - at : ends.start()]
                if body.strip():
                    yield begins, body
            begins = next_ if next_ >= start else None
            if begins is not None and begins >= stop:
                return
            ends = _END.search(buffer, ends.end())
        if not more:
            return
        keep = max(0, len(buffer) - _BACK) if begins is None else begins - at
        if begins is None and ends:
            keep = min(keep, ends.start())
        at, buffer = at + keep, buffer[keep:]
        got = read(at + len(buffer), chunk)
        more = bool(got)
        buffer += got


class EventReader(DataSourceStreamReader):
    """Options: path; split_bytes; max_bytes (for each batch) with progress (a folder for what has been planned).

    Spark doesn't tell a source where a batch begins when it asks how far one may go. With max_bytes the answer is kept
    in `progress` before it is given, so that after a restart no offset is smaller than one that Spark knows; if that file is
    lost, or belongs to another query, a batch is larger or smaller, and no event is lost or repeated as long as offsets grow."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT))
        self.limit, self.progress = int(options.get("max_bytes", 0)), options.get("progress")
        if self.limit and not self.progress:
            raise ValueError("max_bytes needs a folder in the option progress")
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def _planned(self) -> dict:
        files, folder = _file_system(self.progress)
        from pyarrow.fs import FileType

        if files.get_file_info(f"{folder}/planned.json").type == FileType.NotFound:
            return {}
        with files.open_input_stream(f"{folder}/planned.json") as f:
            return json.loads(f.read())

    def _plan(self, offset: dict) -> None:
        files, folder = _file_system(self.progress)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/planned.tmp") as f:
            f.write(json.dumps(offset).encode())
        files.move(f"{folder}/planned.tmp", f"{folder}/planned.json")

    def _complete(self, files, file: str, size: int) -> int:
        """Where the last complete event ends."""
        if file in self.known and self.known[file][0] == size:
            return self.known[file][1]
        with files.open_input_file(file) as f:
            stop, tail = size, b""
            while stop > 0:
                start = max(0, stop - (1 << 16))
                f.seek(start)
                tail = f.read(stop - start) + tail
                found = [m.end() for m in _END.finditer(tail)]
                if found:
                    self.known[file] = size, start + found[-1]
                    return start + found[-1]
                stop = start
        self.known[file] = size, 0
        return 0

    def latestOffset(self) -> dict:
        from pyarrow import fs

        files, folder = _file_system(self.path)
        out, left = (self._planned() if self.limit else {}), self.limit
        for info in sorted(files.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)), key=lambda i: i.path):
            if info.type != fs.FileType.File or info.base_name[0] in "._":
                continue
            start = out.get(info.path, 0)
            stop = self._complete(files, info.path, info.size) if info.size > start else start
            if self.limit:
                stop = min(stop, start + left)
                left -= max(0, stop - start)
            if stop > start:
                out[info.path] = stop
        if self.limit:
            self._plan(out)
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(file, s, min(s + self.split, stop)) for file, stop in sorted(end.items()) for s in range(start.get(file, 0), stop, self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        files, _ = _file_system(self.path)
        with files.open_input_file(partition.file) as f:

            def read(position: int, n: int) -> bytes:
                f.seek(position)
                return f.read(n)

            for position, body in events_between(read, partition.start, partition.stop):
                yield partition.file, position, body.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class EventLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> EventReader:
        return EventReader(dict(self.options))
