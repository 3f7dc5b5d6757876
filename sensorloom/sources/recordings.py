"""Recordings as arrays: a data source that reads sensor files in chunks and opens those of wanted participants only.

``sensors.read_signal`` has a row for each sample; here a row is a stretch of up to ``chunk`` samples as one array, which is
what filters and gathered windows work on.  Files are split into tasks by their sizes.  Filters on pid and sid are taken over
by the source: folders of other participants are neither listed nor opened.  Files are read through pyarrow's file
systems (local and shared folders, hdfs, s3, gs); a store that only Spark reads is for ``sensors``.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .sensors import FS

#: Samples of a row, and bytes of the files of a task (a larger file is a task of its own).
CHUNK, TASK_BYTES = 16_384, 32 << 20
KEYS = [("pid", pa.string()), ("sid", pa.string())]
ARRAY = pa.list_(pa.float64())
KINDS = {
    "signal": ("EDA.csv", [("t0", pa.float64()), ("fs", pa.float64()), ("start", pa.int64()), ("x", ARRAY)], "t0 double, fs double, start long, x array<double>"),
    "tags": ("tags.csv", [("tag_t", ARRAY)], "tag_t array<double>"),
    "beats": ("IBI.csv", [("bt", ARRAY), ("rr", ARRAY)], "bt array<double>, rr array<double>"),
}


@dataclass
class Files(InputPartition):
    """(path, pid, sid) of a task's files."""

    found: list[tuple[str, str, str]]


def number(field: str) -> float | None:
    """The number of a field; None for what is none, NaN included."""
    try:
        v = float(field)
    except ValueError:
        return None
    return v if v == v else None


def fields(line: str) -> list[str]:
    return [f.strip() for f in line.split(",")]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.kind = options["path"], options.get("kind", "signal")
        self.name = options.get("name") or KINDS[self.kind][0]
        self.rate = None if options.get("rate", str(FS)) == "any" else float(options.get("rate", FS))
        self.chunk, self.bytes = int(options.get("chunk", CHUNK)), int(options.get("taskbytes", TASK_BYTES))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over equality and membership in pid and sid; what else there is stays with Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column not in ("pid", "sid"):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[column] = self.wanted.get(column, values) & values

    def is_wanted(self, column: str, value: str) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def partitions(self) -> list[Files]:
        store, root = files.FileSystem.from_uri(self.uri)
        below = lambda path: sorted(store.get_file_info(files.FileSelector(path)), key=lambda i: i.path)
        tasks, size = [], self.bytes
        for person in below(root):
            pid = person.base_name.replace("Part ", "P")
            if person.type != files.FileType.Directory or not person.base_name.startswith("Part") or not self.is_wanted("pid", pid):
                continue
            sessions = [i.base_name for i in below(person.path) if i.type == files.FileType.Directory and self.is_wanted("sid", i.base_name)]
            for info, sid in zip(store.get_file_info([f"{person.path}/{s}/{self.name}" for s in sessions]), sessions, strict=True):
                if info.type != files.FileType.File:
                    continue
                if size + info.size > self.bytes or not tasks:
                    tasks.append(Files([]))
                    size = 0
                tasks[-1].found.append((info.path, pid, sid))
                size += info.size
        return tasks or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = files.FileSystem.from_uri(self.uri)
        schema = pa.schema(KEYS + KINDS[self.kind][1])
        for path, pid, sid in partition.found:
            with io.TextIOWrapper(io.BufferedReader(store.open_input_stream(path)), encoding="utf-8", errors="replace") as text:
                lines = (s for line in text if (s := line.strip()))
                for row in getattr(self, f"{self.kind}_rows")(lines, path):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((pid, sid, *row), schema, strict=True)], schema=schema)

    def signal_rows(self, lines: Iterator[str], path: str) -> Iterator[tuple]:
        head = [number(fields(s)[0]) for s in islice(lines, 2)]
        if len(head) < 2:
            return
        if self.rate is not None and head[1] != self.rate:
            raise ValueError(f"{path}: the sampling rate is {head[1]}, not {self.rate:g} Hz")
        start = 0
        while some := [number(fields(s)[0]) for s in islice(lines, self.chunk)]:
            yield head[0], head[1], start, some
            start += len(some)

    def tags_rows(self, lines: Iterator[str], path: str) -> Iterator[tuple]:
        while some := list(islice(lines, self.chunk)):
            yield ([t for s in some if (t := number(fields(s)[0])) is not None],)

    def beats_rows(self, lines: Iterator[str], path: str) -> Iterator[tuple]:
        t0 = number(fields(next(lines, ""))[0])
        while some := list(islice(lines, self.chunk)):
            pairs = [(number(f[0]), number(f[1])) for s in some if len(f := fields(s)) > 1]
            clean = [(None if t is None or t0 is None else t0 + t, rr) for t, rr in pairs if rr is not None and 0.3 < rr < 2.0]
            yield [t for t, _ in clean], [rr for _, rr in clean]


class Recordings(DataSource):
    """Options: path, kind (signal, tags, beats), name of the files, rate (Hz, or any), chunk, taskbytes."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return f"pid string, sid string, {KINDS[self.options.get('kind', 'signal')][2]}"

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(dict(self.options))


def recordings(spark: SparkSession, root: str, kind: str = "signal", name: str | None = None, rate: float | None = FS, chunk: int = CHUNK, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The files below ``root`` as arrays.

    signal: (pid, sid, t0, fs, start, x), ``start`` the number of the first sample of x; tags: (pid, sid, tag_t); beats: (pid, sid,
    bt, rr), clean ones.  Another rate than ``rate`` is an error, None takes any.  Missing and empty files have no rows; what is no number is
    null.  Filters on pid and sid choose files; for that, the session's setting of filters in Python sources is turned on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recordings)
    options = {"kind": kind, "rate": "any" if rate is None else rate, "chunk": chunk, "taskBytes": task_bytes} | ({"name": name} if name else {})
    return spark.read.format("recordings").options(**options).load(root)


def samples(signal: DataFrame) -> DataFrame:
    """(pid, sid, t0, i, t, x), a row for each sample of ``recordings``' arrays."""
    i = (F.col("start") + F.col("at")).cast("long")
    return signal.select("pid", "sid", "t0", "fs", "start", F.posexplode("x").alias("at", "x")).select("pid", "sid", "t0", i.alias("i"), (F.col("t0") + i / F.col("fs")).alias("t"), "x")


def ends(signal: DataFrame) -> DataFrame:
    """(pid, sid, t0, t1, n) of ``recordings``' arrays: the lengths of the chunks say it, values are not looked at."""
    n = F.sum(F.size("x")).cast("long")
    return signal.groupBy("pid", "sid").agg(F.first("t0").alias("t0"), (F.first("t0") + n / F.first("fs")).alias("t1"), n.alias("n"))
