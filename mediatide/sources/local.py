"""Where files come from: lists of roots, folders, the first bytes of files."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.media import AUDIO_EXTENSIONS, HEADER_BYTES
from ..functions.text import extension

ROOT_KEYS = ("MUSIC_DIRS", "MUSIC_DIR", "SCAN_DIRS", "SCAN_DIR")
ALL_ROOTS = "__ALL__"


def path_list(raw: str | None) -> list[str]:
    """The absolute paths of a list parted by ``,`` ``;`` or ``:``; drive letters keep theirs; each path once, in order."""
    found: list[str] = []
    for piece in re.split("[;,]", raw or ""):
        parts = re.split(r"(?<![;,:])(?<!\b[A-Za-z]):|(?<=[^:;,]{2}):", piece.strip()) if ":" in piece else [piece]
        for part in parts:
            text = part.strip().strip("\"'").strip()
            if text:
                path = os.path.abspath(text) if not re.match(r"[A-Za-z]:", text) else text
                if path not in found:
                    found.append(path)
    return found


def path_list_column(raw: Column) -> Column:
    """The same for a column of lists parted by ``,`` or ``;``: trimmed, unquoted, each once, in order."""
    bare = F.transform(F.split(raw, "[;,]"), lambda p: F.regexp_replace(F.trim(p), "^[\"']+|[\"']+$", ""))
    return F.array_distinct(F.filter(bare, lambda p: p != ""))


@dataclass
class Settings:
    """Scan roots and limits, from the environment."""

    roots: list[str] = field(default_factory=lambda: ["/music"])
    workers: int = 4

    @classmethod
    def from_environment(cls, env: dict[str, str]) -> Settings:
        roots: list[str] = []
        for key in ROOT_KEYS:
            roots += [p for p in path_list(env.get(key)) if p not in roots]
        return cls(roots or ["/music"], int(env.get("MAX_WORKERS") or 4))

    def asked(self, text: str | None) -> list[str]:
        """The roots a request means: all for an empty text or ``__ALL__``, else its own list."""
        if not text or text == ALL_ROOTS:
            return self.roots
        return path_list(text) or [text]


def scan_folders(spark: SparkSession, roots: list[str], leave_out: str | None = None) -> DataFrame:
    """``(file_path, mtime, file_size)`` of the audio files below the roots that exist; contents are not read.

    Roots may lie in any file system the cluster knows; folders are listed by tasks. Missing roots give nothing.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    places = [jvm.org.apache.hadoop.fs.Path(r) for r in roots]
    there = [r for r, p in zip(roots, places, strict=True) if p.getFileSystem(conf).exists(p)]
    if not there:
        return spark.createDataFrame([], "file_path string, mtime double, file_size bigint")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there)
    f = f.select(F.regexp_replace("path", "^file:/*", "/").alias("file_path"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("file_size"))
    f = f.where(extension(F.col("file_path")).isin(*AUDIO_EXTENSIONS))
    if leave_out:
        f = f.where(~F.col("file_path").startswith(leave_out.rstrip("/") + "/"))
    return f.dropDuplicates(["file_path"])


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def _remote(address: str):
    """The file system of an address, and the path there; the library for it is only loaded for addresses."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address)


def _entries(root: str, folder: str) -> tuple[list[str], list[str]]:
    """The folders and the files of a folder below ``root``, as paths of its file system; a missing folder has none."""
    if "://" not in root:
        if not os.path.isdir(folder):
            return [], []
        with os.scandir(folder) as found:
            entries = sorted((e.path, e.is_dir(follow_symlinks=False)) for e in found)
        return [p for p, d in entries if d], [p for p, d in entries if not d]
    from pyarrow import fs

    infos = _remote(root)[0].get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return [i.path for i in infos if i.type == fs.FileType.Directory], [i.path for i in infos if i.type == fs.FileType.File]


def _head(root: str, path: str, size: int) -> bytes:
    if "://" not in root:
        with open(path, "rb") as f:
            return f.read(size)
    with _remote(root)[0].open_input_file(path) as f:
        return f.read(size)


class _HeaderReader(DataSourceReader):
    def __init__(self, root: str, size: int, tasks: int):
        self.root, self.size, self.tasks = root, size, tasks

    def partitions(self):
        """One task for each folder of the first level that has enough of them, and one for the files of each above those."""
        level, above = [self.root if "://" not in self.root else _remote(self.root)[1]], []
        while level and len(level) < self.tasks:
            above += level
            level = [d for folder in level for d in _entries(self.root, folder)[0]]
        return [_Folder(d, False) for d in above] + [_Folder(d, True) for d in level]

    def read(self, partition: _Folder):
        open_ = [partition.path]
        while open_:
            folders, files = _entries(self.root, open_.pop())
            open_ += folders if partition.deep else []
            for path in files:
                try:
                    yield (path, _head(self.root, path, self.size), "")
                except OSError as e:
                    yield (path, None, str(e))


class HeaderSource(DataSource):
    """``spark.read.format("file_headers").load(folder)``: only the first bytes of each file are read.

    The folder may be a path or an address of any file system that Arrow knows. Tasks list the folders below it and
    read what is there. Options: ``bytes`` (1024), ``tasks`` (64: folders are opened until there are so many). A file
    that can't be read has a null header and an error.
    """

    @classmethod
    def name(cls) -> str:
        return "file_headers"

    def schema(self) -> str:
        return "file_path string, header binary, error string"

    def reader(self, schema) -> _HeaderReader:
        return _HeaderReader(self.options["path"], int(self.options.get("bytes", HEADER_BYTES)), int(self.options.get("tasks", 64)))
