"""Workspaces: bricks, their files, and settings, in any file system that Spark reads or in a revision of a git repository."""

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.sources import git
from brickyard.sources.reader import read_edn

KINDS = (("base", "bases"), ("component", "components"))
SETTINGS_FILE = "workspace.edn"
CONFIG_FILE = "brickyard.edn"
BRICKS = "ord int, brick string, type string, dir string"
FILES = "brick string, type string, dir string, file string, is_test boolean, ord int, oid string, source string"
_SOURCE = r"^(bases|components)/([^/]+)/(src|test)/.*\.clj[cs]?$"


@dataclass(frozen=True)
class Settings:
    top: str | None = None
    interface: str = "interface"


def _bricks(spark: SparkSession, names: dict[str, set[str]]) -> DataFrame:
    """(ord, brick, type, dir), bases first, then by name."""
    found = [(name, kind, f"{parent}/{name}") for kind, parent in KINDS for name in sorted(names.get(parent, ()))]
    return spark.createDataFrame([(i, *b) for i, b in enumerate(found)], BRICKS)


def _source_files(texts: DataFrame) -> DataFrame:
    """file, oid and source of a tree to FILES: only sources and tests of bricks."""
    piece = F.split("file", "/")
    return texts.filter(F.col("file").rlike(_SOURCE)).select(
        piece[1].alias("brick"), F.when(piece[0] == "bases", "base").otherwise("component").alias("type"), F.concat_ws("/", piece[0], piece[1]).alias("dir"), "file",
        (piece[2] == "test").alias("is_test"), F.lit(0).alias("ord"), "oid", "source",
    )


def blob_id(text: Column) -> Column:
    """What git names a file with this text."""
    raw = F.encode(text, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "UTF-8"), F.unhex(F.lit("00")), raw))


class Tree:
    """A workspace's folder, by a path or URI of any file system that Spark is set up for."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.spark, self._io, self._path = spark, jvm.org.apache.commons.io.IOUtils, jvm.org.apache.hadoop.fs.Path
        root = root if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", root) else f"file://{os.path.abspath(root)}"
        top = self._path(root)
        self._fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._top = self._fs.makeQualified(top)
        self.name = self._top.getName()

    @property
    def local(self) -> str:
        """The folder's path on this machine, for git."""
        uri = self._top.toUri()
        if uri.getScheme() != "file":
            raise git.GitError(f"There is no git history in {uri.getScheme()} storage")
        return uri.getPath()

    def _at(self, path: str):
        return self._path(self._top, path) if path else self._top

    def text(self, path: str) -> str | None:
        """A small file's text; None if there is no such file."""
        at = self._at(path)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _folders(self, path: str) -> set[str]:
        at = self._at(path)
        return {s.getPath().getName() for s in self._fs.listStatus(at) if s.isDirectory()} if self._fs.exists(at) else set()

    def bricks(self) -> DataFrame:
        """Also those without files."""
        return _bricks(self.spark, {parent: self._folders(parent) for _, parent in KINDS})

    def files(self) -> DataFrame:
        """Source and test files with their texts, read by Spark's own scan; ord follows the paths' order."""
        tops = [self._at(parent).toString() for _, parent in KINDS if self._folders(parent)]
        if not tops:
            return self.spark.createDataFrame([], FILES)
        plain = [re.sub(r"([\[\]{}*?\\])", r"\\\1", t) for t in tops]  # Spark takes paths for patterns
        found = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.clj*").text(plain, wholetext=True)
        same = lambda c: F.regexp_replace(c, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")  # noqa: E731  file:/// is file:/
        under = re.sub("^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", self._top.toUri().toASCIIString()).rstrip("/") + "/"
        rest = F.substring(same(F.col("_metadata.file_path")), len(under) + 1, 1_000_000)
        file = F.url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))
        return _source_files(found.select(file.alias("file"), blob_id(F.col("value")).alias("oid"), F.col("value").alias("source")))


class Revision:
    """A workspace as it was in a revision; its files are read from the repository in tasks, no folder is made."""

    def __init__(self, spark: SparkSession, root: str, rev: str):
        self.spark, self.root, self.rev, self.name = spark, root, rev, os.path.basename(root)

    def text(self, path: str) -> str | None:
        return git.file_text(self.root, self.rev, path)

    def bricks(self) -> DataFrame:
        pattern = r"^(bases|components)/([^/]+)/"
        found = git.files(self.spark, self.root, self.rev, pattern, texts=False)
        piece = F.split("path", "/")
        names: dict[str, set[str]] = {}
        for parent, name in found.select(piece[0], piece[1]).distinct().collect():  # as many rows as there are bricks
            names.setdefault(parent, set()).add(name)
        return _bricks(self.spark, names)

    def files(self) -> DataFrame:
        found = git.files(self.spark, self.root, self.rev, _SOURCE)
        return _source_files(found.select(F.col("path").alias("file"), "oid", "source"))


def is_workspace(tree: Tree | Revision) -> bool:
    return tree.text(SETTINGS_FILE) is not None


def read_settings(tree: Tree | Revision) -> Settings:
    data = read_edn(tree.text(SETTINGS_FILE) or "{}") or {}
    return Settings(data.get("top-namespace"), data.get("interface-ns", "interface"))


def read_config(tree: Tree, path: str | None = None) -> dict:
    """A configuration file that is named must exist; the workspace's own may be missing."""
    if path is None:
        text = tree.text(CONFIG_FILE)
    else:
        folder, _, name = path.rpartition("/")
        text = Tree(tree.spark, folder or ("/" if path.startswith("/") else ".")).text(name)
        if text is None:
            raise FileNotFoundError(f"Config file not found: {path}")
    return read_edn(text or "{}") or {}
