"""Lines of files that grow in place, as a streaming data source (format name ``growing_lines``), and of chosen sessions' files.

An offset names a version of the source's log, a folder that a query owns. A version lists the files that changed since the one before:
their size, how far they are read, and a generation that rises when a file shrinks (it was replaced) and is then read from its start.
Every ``FULL_EVERY`` versions all files are listed, and what is older is deleted once Spark has committed it.

A line belongs to the batch in whose byte range its newline lies, wherever it began; a reader looks back for its start. So a line that is half
written is held back until it is whole, arrives once, and no file is opened to plan a batch. Ranges are split and grouped to about ``split_bytes``.

Options: ``path`` (a folder), ``log``, ``pattern`` (of paths below the folder, default ``[^/]+/[^/]+\\.jsonl``: sessions without their child files),
``existing`` (``read``, or ``skip`` what is there at the start), ``created`` (``read``, or ``hold``: a file's first content is delivered with its first
growth), ``split_bytes``.

Columns: path, start (the line's first byte, which orders a file's lines), value, is_new (the file was first seen in this batch).

Defined cases: an empty or missing folder has no lines; a file that goes is forgotten, and is new if it comes back; bytes that are no UTF-8 are
replaced; a carriage return before a newline is dropped; a last line without a newline waits.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, start long, value string, is_new boolean"
FULL_EVERY = 16
CHUNK = 1 << 20
SESSIONS = r"[^/]+/[^/]+\.jsonl"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


@dataclass
class Known:
    """What a version says of a file."""

    size: int
    read: int
    generation: int


@dataclass
class Ranges(InputPartition):
    """(path, first byte, end, is_new) of each stretch that a task reads."""

    stretches: list[tuple[str, int, int, bool]]


class Log:
    """Versions of what is known, 0 being nothing."""

    def __init__(self, uri: str):
        self.fs, self.at = open_store(uri)
        self.fs.create_dir(self.at, recursive=True)

    def _path(self, version: int) -> str:
        return f"{self.at}/{version}.json"

    def versions(self) -> list[int]:
        names = [i.base_name for i in self.fs.get_file_info(pafs.FileSelector(self.at))]
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def _load(self, version: int) -> dict:
        with self.fs.open_input_file(self._path(version)) as f:
            return json.loads(f.read())

    def state(self, version: int) -> dict[str, Known]:
        parts = []
        while version:
            parts.append(self._load(version))
            version = 0 if parts[-1]["full"] else version - 1
        known: dict[str, Known] = {}
        for part in reversed(parts):
            known.update({p: Known(*k) for p, k in part["files"].items()})
            for p in part["gone"]:
                known.pop(p, None)
        return known

    def add(self, version: int, before: dict[str, Known], now: dict[str, Known]) -> None:
        full = version % FULL_EVERY == 1
        said = {p: [k.size, k.read, k.generation] for p, k in now.items() if full or before.get(p) != k}
        with self.fs.open_output_stream(f"{self._path(version)}.new", compression=None) as out:
            out.write(json.dumps({"full": full, "files": said, "gone": sorted(before.keys() - now.keys())}).encode())
        self.fs.move(f"{self._path(version)}.new", self._path(version))

    def forget(self, version: int) -> None:
        """Deletes what no state from ``version`` on needs."""
        base = max((v for v in self.versions() if v <= version and v % FULL_EVERY == 1), default=0)
        for v in self.versions():
            if v < base:
                self.fs.delete_file(self._path(v))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.log = Log(options["log"])
        self.pattern = re.compile(options.get("pattern", SESSIONS))
        self.skip, self.hold = options.get("existing", "read") == "skip", options.get("created", "read") == "hold"
        self.split = int(options.get("split_bytes", 64 << 20))
        self.version = max(self.log.versions(), default=0)
        self.known = self.log.state(self.version)

    def _sizes(self) -> dict[str, int]:
        fs, at = open_store(self.root)
        infos = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
        below = {i.path[len(at.rstrip("/")) + 1 :]: i.size for i in infos if i.type == pafs.FileType.File}
        return {p: n for p, n in below.items() if self.pattern.fullmatch(p)}

    def _advance(self, now: dict[str, Known]) -> None:
        if now != self.known:
            self.log.add(self.version + 1, self.known, now)
            self.version, self.known = self.version + 1, now

    def initialOffset(self) -> dict:
        if self.skip and not self.version:
            self._advance({p: Known(n, 0 if self.hold else n, 0) for p, n in self._sizes().items()})
        return {"n": self.version if self.skip else 0}

    def latestOffset(self) -> dict:
        now = {}
        for path, size in self._sizes().items():
            old = self.known.get(path)
            if old is None:
                now[path] = Known(size, 0 if self.hold else size, 0)
            elif size == old.size:
                now[path] = old
            else:
                now[path] = Known(size, size, old.generation + (size < old.size))
        self._advance(now)
        return {"n": self.version}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = self.log.state(start["n"]), self.log.state(end["n"])
        out, held = [], 0
        for path, k in sorted(now.items()):
            old = before.get(path)
            first = old.read if old and old.generation == k.generation else 0
            for at in range(first, k.read, self.split):
                stretch = (path, at, min(at + self.split, k.read), old is None)
                if not out or held + stretch[2] - at > self.split:
                    out.append(Ranges([]))
                    held = 0
                out[-1].stretches.append(stretch)
                held += stretch[2] - at
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, at = open_store(self.root)
        for path, first, end, new in partition.stretches:
            try:
                with fs.open_input_file(f"{at}/{path}") as f:
                    for lines in lines_of(f, first, end):
                        n = len(lines)
                        yield pa.RecordBatch.from_arrays([pa.array([f"{self.root}/{path}"] * n), pa.array([s for s, _ in lines], pa.int64()), pa.array([v for _, v in lines], pa.string()), pa.array([new] * n)], names=["path", "start", "value", "is_new"])
            except FileNotFoundError:  # it went after the batch was planned
                continue

    def commit(self, end: dict) -> None:
        self.log.forget(end["n"])


def lines_of(f: pa.NativeFile, first: int, end: int, last: bool = False) -> Iterator[list[tuple[int, str]]]:
    """(start, text) of the lines whose newline is in [first, end), some at a time; with ``last`` also what follows the last newline."""
    text = lambda line: line.removesuffix(b"\r").decode("utf-8", "replace")
    start = line_start(f, first)
    rest, at = [], start
    f.seek(start)
    if first > start:  # the part of the first line that came before
        rest.append(f.read(first - start))
        at = first
    while at < end:
        chunk = f.read(min(CHUNK, end - at))
        if not chunk:
            break
        at += len(chunk)
        whole, newline, tail = chunk.rpartition(b"\n")
        if not newline:
            rest.append(chunk)
            continue
        out = []
        for line in (b"".join(rest) + whole).split(b"\n"):
            out.append((start, text(line)))
            start += len(line) + 1
        yield out
        rest = [tail]
    if last and any(rest):
        yield [(start, text(b"".join(rest)))]


def line_start(f: pa.NativeFile, first: int) -> int:
    """Where the line that ``first`` is in begins."""
    at = first
    while at > 0:
        begin = max(0, at - CHUNK)
        f.seek(begin)
        found = f.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(dict(self.options))


def stream(spark: SparkSession, root: str, log: str, **options: str) -> DataFrame:
    """(path, start, value, is_new) of the session files under ``root/projects`` as they grow; ``log`` belongs to one query, like its checkpoint."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("path", f"{root}/projects").option("log", log).options(**options).load()


LINES = "file_path string, project_id string, session_id string, agent_id string, line_no long, value string"


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt to as many tasks as the session's shuffles have; short rows that stand for whole files are not put together again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _visible(name: str) -> bool:
    """As Spark's own sources see it."""
    return not name.startswith(("_", "."))


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size) of the files ``*.jsonl`` of all projects under ``root/projects``, at any depth; names that begin with a dot or an underscore are left out.

    The driver sees the projects' names only. A task lists a project's folder, others the folders of its sessions.
    """
    fs, at = open_store(f"{root}/projects")
    names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if i.type == pafs.FileType.Directory and _visible(i.base_name)]
    projects = spark.createDataFrame([(n,) for n in sorted(names)], "project string")

    def rows(infos: list[pafs.FileInfo], at: str, project: str) -> Iterator[pa.RecordBatch]:
        for n in range(0, len(infos), 10_000):
            some = infos[n : n + 10_000]
            cells = [[project] * len(some), [i.path[len(at) + 1 :] for i in some], [i.type == pafs.FileType.Directory for i in some], [(i.mtime_ns or 0) // 1000 for i in some], [i.size or 0 for i in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["project", "name", "folder", "mtime", "size"])

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_store(f"{root}/projects")
        for batch in batches:
            for project in batch.column("project").to_pylist():
                yield from rows([i for i in fs.get_file_info(pafs.FileSelector(f"{at}/{project}", allow_not_found=True)) if _visible(i.base_name)], at, project)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_store(f"{root}/projects")
        for batch in batches:
            yield batch.filter(pc.invert(batch.column("folder")))
            infos = [i for f in batch.filter(batch.column("folder")).column("name").to_pylist() for i in fs.get_file_info(pafs.FileSelector(f"{at}/{f}", recursive=True, allow_not_found=True))]
            yield from rows([i for i in infos if i.type == pafs.FileType.File and all(map(_visible, i.path[len(at) + 1 :].split("/")))], at, "")

    shape = "project string, name string, folder boolean, mtime long, size long"
    found = _spread(projects.mapInArrow(top, shape), "name").mapInArrow(below, shape)
    return found.filter(F.col("name").endswith(".jsonl")).select(F.concat(F.lit(f"{root}/projects/"), "name").alias("path"), F.timestamp_micros("mtime").alias("mtime"), "size")


class _Rows:
    """Lines of many files, handed on some thousand at a time."""

    def __init__(self) -> None:
        self.cells: list[list] = [[] for _ in range(6)]
        self.held = 0

    def add(self, fs: pafs.FileSystem, at: str, same: tuple) -> Iterator[pa.RecordBatch]:
        """The lines of the file at ``at``, which may be gone; ``same`` is what they have in common."""
        try:
            f = fs.open_input_file(at)
        except FileNotFoundError:
            return
        with f:
            count = 0
            for some in lines_of(f, 0, f.size(), last=True):
                values = [v for _, v in some]
                if any("\r" in v for v in values):  # a carriage return alone ends a line too
                    values = [x for v in values for x in v.split("\r")]
                if not count and values[0].startswith("\ufeff"):
                    values[0] = values[0][1:]
                n = len(values)
                for cells, x in zip(self.cells, same, strict=False):
                    cells.extend([x] * n)
                self.cells[4].extend(range(count + 1, count + n + 1))
                self.cells[5].extend(values)
                count, self.held = count + n, self.held + sum(map(len, values))
                if self.held > CHUNK or len(self.cells[5]) > 8192:
                    yield self.batch()

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.cells, kinds, strict=True)], names=["file_path", "project_id", "session_id", "agent_id", "line_no", "value"])
        self.cells, self.held = [[] for _ in range(6)], 0
        return out


def all_lines(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, project_id, session_id, agent_id, line_no, value) of all transcript files; child files named *compact* are left out.

    Files are found as :func:`files` does, and opened by the tasks that have their paths.
    """
    part = re.compile(r"/projects/([^/]+)/(?:([^/]+)\.jsonl|([^/]+)/subagents/([^/]+)\.jsonl)$")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_store(root)
        out = _Rows()
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = part.search(path)
                if found and "compact" not in (found[4] or ""):
                    yield from out.add(fs, f"{at}{path[len(root):]}", (path, found[1], found[2] or found[3], found[4] and found[4].removeprefix("agent-")))
        yield out.batch()

    return _spread(files(spark, root).select("path"), "path").mapInArrow(task, LINES)


def session_lines(keys: DataFrame, root: str) -> DataFrame:
    """Lines, as :func:`all_lines` gives them, of the sessions ``keys`` (project_id, session_id) only.

    Each session's file and child files are opened by the task that has its key; no other file is listed or read. A session whose file
    is gone has no lines. The last line counts even without a newline.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_store(root)
        out = _Rows()
        for batch in batches:
            for project, session in zip(batch.column("project_id").to_pylist(), batch.column("session_id").to_pylist(), strict=True):
                folder = f"projects/{project}/{session}"
                children = fs.get_file_info(pafs.FileSelector(f"{at}/{folder}/subagents", allow_not_found=True))
                names = sorted(i.base_name[:-6] for i in children if i.type == pafs.FileType.File and i.base_name.endswith(".jsonl") and "compact" not in i.base_name)
                for path, agent in [(f"{folder}.jsonl", None)] + [(f"{folder}/subagents/{n}.jsonl", n.removeprefix("agent-")) for n in names]:
                    yield from out.add(fs, f"{at}/{path}", (f"{root}/{path}", project, session, agent))
        yield out.batch()

    return _spread(keys.select("project_id", "session_id"), "project_id", "session_id").mapInArrow(task, LINES)


def heads(spark: SparkSession, root: str, most: int = 4096, pattern: str = "*.jsonl") -> DataFrame:
    """(project_id, session_id, line_no, value): the lines in the first ``most`` bytes of each session file, the last of them perhaps cut off.

    Files are listed without being read; each is opened by the task that has its path, which reads ``most`` bytes once.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{root}/projects/*").select("path").repartition("path")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                fs, at = open_store(path)
                with fs.open_input_stream(at, compression=None, buffer_size=0) as f:
                    lines = f.read(most).decode("utf-8", "replace").split("\n")
                project, name = path.rsplit("/", 2)[1:]
                out.extend((project, name.rpartition(".")[0], i, line) for i, line in enumerate(lines, 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["project_id", "session_id", "line_no", "value"])

    return files.mapInArrow(task, "project_id string, session_id string, line_no long, value string")
