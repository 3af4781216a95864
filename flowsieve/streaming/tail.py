"""Growing log files as a stream: a Spark streaming source with byte offsets.

Each trigger reads, per file, the bytes between the offset of the last trigger
and the end of the last complete line. A file is known by its inode, so one
that is renamed when the sensor rotates goes on where it was; one that became
shorter is read from its start; ``.gz`` files are read once, when they appear.
Files are read by tasks, a piece of at most ``piece_bytes`` each (cut at line
ends); the folder must be mounted on the driver and the executors, as sensors
leave it. Nothing is dropped: a trigger takes all that has arrived.
"""

from __future__ import annotations

import glob
import gzip
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# the reader's code travels to the workers by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 16


@dataclass
class Piece(InputPartition):
    path: str
    inode: int
    start: int
    end: int


def last_line_end(path: str, start: int, size: int) -> int:
    """Offset after the last newline in [start, size), or ``start``."""
    with open(path, "rb") as f:
        end = size
        while end > start:
            begin = max(start, end - BLOCK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


def find_path(pattern: str, path: str, inode: int) -> str | None:
    """Where the file is now: its old path, or what the path was renamed to."""
    for p in [path, *glob.glob(pattern)]:
        try:
            if os.stat(p).st_ino == inode:
                return p
        except FileNotFoundError:
            continue
    return None


class TailReader(DataSourceStreamReader):
    """Offsets: {inode: [path, bytes]}, as JSON in the query's checkpoint."""

    def __init__(self, options: dict):
        path = options["path"]
        self.pattern = path if glob.has_magic(path) else os.path.join(path, "*")
        self.piece_bytes = int(options.get("piecebytes", options.get("pieceBytes", 64 << 20)))
        self.seen: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = dict(self.seen)
        for path in sorted(glob.glob(self.pattern)):
            try:
                st = os.stat(path)
                if not os.path.isfile(path):
                    continue
                key = str(st.st_ino)
                done = now.get(key, [path, 0])[1]
                if path.endswith(".gz"):
                    now[key] = [path, st.st_size]
                else:
                    # a file that shrank was truncated and written anew
                    now[key] = [path, last_line_end(path, done if st.st_size >= done else 0, st.st_size)]
            except FileNotFoundError:
                continue
        self.seen = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.seen = {**start, **self.seen}
        pieces = []
        for key, (path, stop) in end.items():
            done = start.get(key, [path, 0])[1]
            if stop == done:
                continue
            at = done if stop > done else 0
            if path.endswith(".gz"):
                pieces.append(Piece(path, int(key), 0, -1))
                continue
            while at < stop:
                cut = min(at + self.piece_bytes, stop)
                here = find_path(self.pattern, path, int(key))
                if here is None:
                    break
                cut = stop if cut == stop else last_line_end(here, at, cut)
                cut = cut if cut > at else stop          # one line longer than a piece
                pieces.append(Piece(path, int(key), at, cut))
                at = cut
        return pieces

    def read(self, partition: Piece) -> Iterator[tuple]:
        path = find_path(self.pattern, partition.path, partition.inode)
        if path is None:
            raise FileNotFoundError(f"{partition.path} (inode {partition.inode}) is gone before it was read")
        name = partition.path
        if partition.end < 0:
            with gzip.open(path, "rb") as f:
                for line in f:
                    yield line.rstrip(b"\r\n").decode("utf-8", "replace"), name
            return
        with open(path, "rb") as f:
            f.seek(partition.start)
            left = partition.end - partition.start
            while left > 0:
                line = f.readline(left)
                if not line:
                    return
                left -= len(line)
                yield line.rstrip(b"\r\n").decode("utf-8", "replace"), name

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "value string, path string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_lines(spark: SparkSession, path: str):
    """Lines of the growing files of a folder (or glob): value, path."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("log_tail").option("path", path).load()
