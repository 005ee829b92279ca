"""Git as Spark data sources, by its command line: history, changed paths, and the files of a revision.

``gitlog``: one row a commit and path, batch or stream. ``gitchanges``: the paths that differ from a revision.
``gitfiles``: the files of a revision with their texts. Each is read in partitions, each of which runs git for its own
range and streams what it says; the driver only counts. All machines must see the repository at the same path.
"""

import datetime
import itertools
import os
import re
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, StringStartsWith

COMMITS = "commit string, at timestamp, path string"
WHOLE_COMMITS = "commit string, at timestamp, paths array<string>"
FILES = "path string, oid string, source string"
#: Commits, or files, of a partition where the option ``perPartition`` doesn't say otherwise.
PER_PARTITION = 2000
_ROWS = 2000
_BYTES = 8 << 20
_HEADER = "\x1e"


class GitError(RuntimeError):
    pass


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    if done.returncode:
        raise GitError(f"git {' '.join(args)} failed: {done.stderr.strip()}")
    return done.stdout


def merge_base(root: str, ref: str) -> str:
    return _git(root, "merge-base", ref, "HEAD").strip()


def tip(root: str, rev: str = "HEAD") -> str:
    """The commit that a name stands for now."""
    return _git(root, "rev-parse", "--verify", f"{rev}^{{commit}}").strip()


def file_text(root: str, rev: str, path: str) -> str | None:
    """A file of a revision, by its path under root; None if it isn't there."""
    done = subprocess.run(["git", "-C", root, "show", f"{rev}:./{path}"], capture_output=True)
    return None if done.returncode else done.stdout.decode("utf-8", "replace")


def _told(root: str, *args: str) -> Iterator[str]:
    """What git says, cut at NUL, without holding it; ends git if the reader stops early."""
    with tempfile.TemporaryFile() as errors, subprocess.Popen(["git", "-C", root, *args], stdout=subprocess.PIPE, stderr=errors) as process:
        try:
            rest = b""
            while piece := process.stdout.read(1 << 16):
                *whole, rest = (rest + piece).split(b"\0")
                for x in whole:
                    yield x.decode("utf-8", "replace")
            if rest:
                yield rest.decode("utf-8", "replace")
            if process.wait():
                errors.seek(0)
                raise GitError(f"git {' '.join(args)} failed: {errors.read().decode(errors='replace').strip()}")
        finally:
            if process.poll() is None:
                process.kill()


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) if isinstance(x, str) else 50 * len(x) for x in row if isinstance(x, str | list))
        if len(held) >= _ROWS or size >= _BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


@dataclass
class _Range(InputPartition):
    """So many entries of a listing, from one on. What is listed goes along, fixed when the read was planned, so that
    a range means the same to each task that reads it."""

    skip: int
    count: int
    listing: object = None


def _ranges(total: int, options, listing=None) -> list[_Range]:
    """At least one partition, as Spark asks for."""
    each = max(1, int(options.get("perPartition", PER_PARTITION)))
    return [_Range(at, min(each, total - at), listing) for at in range(0, total, each)] or [_Range(0, 0, listing)]


_LOG = pa.schema([("commit", pa.string()), ("at", pa.timestamp("us", "UTC")), ("path", pa.string())])


class _History:
    """The commits of a revision range that are asked for, merges left out, newest first."""

    def __init__(self, root: str, revs: str, limits: list[str], paths: list[str]):
        # Without --full-history a path's history leaves out what a merge undid.
        self.root, self.args = root, ["--no-merges", "--full-history", *limits, revs, "--", *[f":(literal){p}" for p in paths]]

    def total(self) -> int:
        return int(_git(self.root, "rev-list", "--count", *self.args))

    def rows(self, part: _Range) -> Iterator[tuple]:
        if not part.count:
            return
        commit = at = None
        shape = f"--format={_HEADER}%H %ct"
        for word in _told(self.root, "log", "-z", "--name-only", "--relative", f"--skip={part.skip}", f"--max-count={part.count}", shape, *self.args):
            text = word.removeprefix("\n")
            if text.startswith(_HEADER):
                commit, seconds = text[1:].split(None, 1)
                seconds, _, path = seconds.partition("\n")  # the first path may follow its header
                at = datetime.datetime.fromtimestamp(int(seconds), datetime.UTC)
                text = path.lstrip("\n")
            if text:
                yield commit, at, text


    def whole(self, part: _Range) -> Iterator[tuple]:
        """A row a commit; its paths come one after another, and as many as it changes are held."""
        for (commit, at), rows in itertools.groupby(self.rows(part), lambda r: r[:2]):
            yield commit, at, [path for _, _, path in rows]


_WHOLE_LOG = pa.schema([_LOG.field("commit"), _LOG.field("at"), ("paths", pa.list_(pa.string()))])


def _read(history: _History, part: _Range, options) -> Iterator[pa.RecordBatch]:
    return _batches(history.whole(part), _WHOLE_LOG) if _by_commit(options) else _batches(history.rows(part), _LOG)


def _by_commit(options) -> bool:
    return options.get("byCommit", "false").lower() == "true"


class _LogReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.root = options, os.path.abspath(options.get("path", "."))
        self.limits = [f"--since={options['since']}"] if options.get("since") else []
        self.paths: list[str] = []

    def partitions(self):
        history = _History(self.root, tip(self.root, self.options.get("rev", "HEAD")), self.limits, self.paths)
        return _ranges(history.total(), self.options, history)

    def read(self, partition):
        yield from _read(partition.listing, partition, self.options)


class _FilteredLogReader(_LogReader):
    def pushFilters(self, filters: list[Filter]):
        """Dates and folders narrow what git walks; Spark still tests each row."""
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            if column == ("at",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.limits.append(f"--since-as-filter={int(f.value.timestamp())}")
            elif column == ("path",) and isinstance(f, EqualTo) and not self.paths:
                self.paths = [f.value]
            elif column == ("path",) and isinstance(f, StringStartsWith) and f.value.strip("/") and f.value.endswith("/") and not self.paths:
                self.paths = [f.value]
            yield f


class _LogStream(DataSourceStreamReader):
    """A stream's offset is a commit: a batch holds the commits that the new tip reaches and the last one doesn't."""

    def __init__(self, options):
        self.options, self.root = options, os.path.abspath(options.get("path", "."))

    def initialOffset(self):
        return {"commit": self.options.get("startingCommit", "")}

    def latestOffset(self):
        return {"commit": tip(self.root, self.options.get("rev", "HEAD"))}

    def partitions(self, start, end):
        if start["commit"] == end["commit"]:
            return []
        history = _History(self.root, f"{start['commit']}..{end['commit']}" if start["commit"] else end["commit"], [], [])
        return _ranges(history.total(), self.options, history)

    def read(self, partition):
        yield from _read(partition.listing, partition, self.options)

    def commit(self, end):
        pass


class GitLog(DataSource):
    """spark.read.format("gitlog").load(root): history up to ``rev`` (HEAD), with the options ``since`` (as git reads it) and
    ``perPartition``. With the option ``pushFilters`` filters on ``at`` and ``path`` narrow git's walk; Spark wants
    spark.sql.python.filterPushdown.enabled for that, and ``log`` sets the one by the other.
    spark.readStream takes ``startingCommit``, whose successors come first. With the option ``byCommit`` a row is a commit with
    its ``paths``."""

    @classmethod
    def name(cls):
        return "gitlog"

    def schema(self):
        return WHOLE_COMMITS if _by_commit(self.options) else COMMITS

    def reader(self, schema):
        return (_FilteredLogReader if self.options.get("pushFilters", "false") == "true" else _LogReader)(self.options)

    def streamReader(self, schema):
        return _LogStream(self.options)


class _ChangesReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.rev = os.path.abspath(options.get("path", ".")), options["rev"]

    def partitions(self):
        return [InputPartition("diff"), InputPartition("new")]

    def read(self, partition):
        if partition.value == "diff":
            told = _told(self.root, "diff", "--name-only", "-z", "--no-renames", "--relative", self.rev)
        else:
            told = _told(self.root, "ls-files", "-z", "--others", "--exclude-standard")
        yield from _batches(((p,) for p in told if p), pa.schema([("path", pa.string())]))


class GitChanges(DataSource):
    """spark.read.format("gitchanges").option("rev", rev).load(root): paths that differ from rev, and untracked ones."""

    @classmethod
    def name(cls):
        return "gitchanges"

    def schema(self):
        return "path string"

    def reader(self, schema):
        return _ChangesReader(self.options)


_TREE = pa.schema([("path", pa.string()), ("oid", pa.string()), ("source", pa.string())])


class _FilesReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.root = options, os.path.abspath(options.get("path", "."))
        self.rev, self.pattern = options["rev"], re.compile(options.get("pattern", ""))
        self.texts = options.get("texts", "true").lower() != "false"

    def _entries(self) -> Iterator[tuple[str, str]]:
        """(path under root, blob id) of the files whose path matches, in git's order."""
        for entry in _told(self.root, "ls-tree", "-r", "-z", self.rev):
            head, _, path = entry.partition("\t")
            _, kind, oid = head.split()
            if kind == "blob" and self.pattern.search(path):
                yield path, oid

    def partitions(self):
        return _ranges(sum(1 for _ in self._entries()), self.options)

    def _rows(self, part: _Range) -> Iterator[tuple]:
        if not part.count:
            return
        if not self.texts:
            for i, (path, oid) in enumerate(self._entries()):
                if part.skip <= i < part.skip + part.count:
                    yield path, oid, None
            return
        with subprocess.Popen(["git", "-C", self.root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as blobs:
            for i, (path, oid) in enumerate(self._entries()):
                if i >= part.skip + part.count:
                    break
                if i < part.skip:
                    continue
                blobs.stdin.write(f"{oid}\n".encode())
                blobs.stdin.flush()
                size = int(blobs.stdout.readline().split()[2])
                text = blobs.stdout.read(size)
                blobs.stdout.read(1)
                yield path, oid, text.decode("utf-8", "replace")
            blobs.stdin.close()

    def read(self, partition):
        yield from _batches(self._rows(partition), _TREE)


class GitFiles(DataSource):
    """spark.read.format("gitfiles").option("rev", rev).load(root): the files of a revision, in partitions of ``perPartition``
    files; ``pattern`` (a regular expression) picks paths, ``texts`` = false leaves texts out."""

    @classmethod
    def name(cls):
        return "gitfiles"

    def schema(self):
        return FILES

    def reader(self, schema):
        return _FilesReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    for source in (GitLog, GitChanges, GitFiles):
        spark.dataSource.register(source)
    return spark


def log(spark: SparkSession, root: str, since: str | None = None, rev: str = "HEAD", per_partition: int = PER_PARTITION) -> DataFrame:
    """The commits of root's history as of now; a GitError where there is none."""
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    read = register(spark).read.format("gitlog").options(rev=tip(root, rev), perPartition=str(per_partition), pushFilters=push)
    return (read.option("since", since) if since else read).load(os.path.abspath(root))


def changed_files(spark: SparkSession, root: str, rev: str) -> DataFrame:
    return register(spark).read.format("gitchanges").option("rev", rev).load(os.path.abspath(root)).distinct()


def files(spark: SparkSession, root: str, rev: str, pattern: str = "", texts: bool = True) -> DataFrame:
    return register(spark).read.format("gitfiles").options(rev=rev, pattern=pattern, texts=str(texts).lower()).load(os.path.abspath(root))
