"""Repositories as a data source of Spark's: files of a mounted tree, dealt out by directories, beside what git knows of it."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "relative_path string, size_bytes bigint, content binary, error string, repository_root string, head_commit string, branch string, remote_url string"
_SHA = re.compile(r"[0-9a-f]{40}(?:[0-9a-f]{24})?$")


def git_root(path: str) -> str | None:
    """The nearest folder above a path, itself included, that git keeps a repository in."""
    here = os.path.abspath(path)
    while True:
        if os.path.exists(os.path.join(here, ".git")):
            return here
        if os.path.dirname(here) == here:
            return None
        here = os.path.dirname(here)


def _text(*path: str) -> str | None:
    try:
        with open(os.path.join(*path), encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


def git_metadata(root: str) -> dict[str, str | None]:
    """head_commit, branch and remote_url from the repository's own files; null for what it has none of.

    A worktree's `.git` is a file that names its folder, and its references are in the common one. A branch without a commit
    has a name only; of a detached head only the commit is known. The remote is origin, else the first.
    """
    own = os.path.join(root, ".git")
    if os.path.isfile(own):
        said = re.match(r"gitdir:\s*(.+)", _text(own) or "")
        own = os.path.normpath(os.path.join(root, said[1].strip())) if said else own
    common = _text(own, "commondir")
    shared = os.path.normpath(os.path.join(own, common.strip())) if common else own
    head = (_text(own, "HEAD") or "").strip()
    named = re.match(r"ref:\s*(\S+)", head)
    commit = head if _SHA.match(head) else None
    if named:
        loose = next((t.strip() for folder in (own, shared) if (t := _text(folder, *named[1].split("/")))), None)
        packed = re.search(rf"^([0-9a-f]{{40,64}}) {re.escape(named[1])}$", _text(shared, "packed-refs") or "", re.M)
        commit = loose or (packed[1] if packed else None)
    sections = re.split(r'^\s*\[([^\]]*)\]\s*$', _text(shared, "config") or "", flags=re.M)[1:]
    remotes = {n: u[1].strip() for n, body in zip(sections[::2], sections[1::2], strict=False) if n.startswith("remote ") and (u := re.search(r"^\s*url\s*=\s*(.+)$", body, re.M))}
    return {"head_commit": commit, "branch": named[1].removeprefix("refs/heads/") if named else None, "remote_url": remotes.get('remote "origin"', next(iter(remotes.values()), None))}


class _Folder(InputPartition):
    """The files of one folder, with all below it or without."""

    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("the option path is missing")
        asked = os.path.abspath(options["path"])
        if not os.path.exists(asked):
            raise FileNotFoundError(asked)
        if not os.path.isdir(asked):
            raise NotADirectoryError(asked)
        whole = str(options.get("whole", "true")).lower() == "true"
        self.git = git_root(asked)
        self.root = self.git if whole and self.git else asked
        self.pruned = {x for x in options.get("prune", "").split(",") if x}
        self.most = int(options.get("folders", "256"))

    def partitions(self) -> Sequence[InputPartition]:
        """Folders are opened breadth first until there are `folders` parts; each of those left is one part with all below it."""
        deep, shallow = [self.root], []
        while deep and len(deep) + len(shallow) < self.most:
            here = deep.pop(0)
            below = sorted(e.path for e in os.scandir(here) if e.is_dir(follow_symlinks=False) and e.name not in self.pruned)
            shallow.append(here)
            deep += below
            if not below and not deep:
                break
        return [*(_Folder(p, False) for p in shallow), *(_Folder(p, True) for p in deep)]

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        known = [self.git, *(git_metadata(self.git).values() if self.git else (None, None, None))]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.binary(), *[pa.string()] * 5]
        todo = [partition.path]
        while todo:
            try:
                entries = sorted(os.scandir(todo.pop()), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                if e.is_symlink():
                    continue
                if e.is_dir():
                    if partition.deep and e.name not in self.pruned:
                        todo.append(e.path)
                    continue
                size = content = error = None
                try:
                    size = e.stat(follow_symlinks=False).st_size
                    with open(e.path, "rb") as f:
                        content = f.read()
                except OSError as problem:
                    error = type(problem).__name__
                row = [os.path.relpath(e.path, self.root).replace(os.sep, "/"), size, content, error, *known]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)


class RepositorySource(DataSource):
    """spark.read.format("repository").load(folder): a row for each file, hidden names included, links not followed.

    The folder is mounted on the driver and all executors. Options: whole (true: from the git root above the folder, if there
    is one), prune (names of folders that are not entered, separated by commas), folders (parts to plan, 256). The driver opens
    about as many folders as there are parts, never all. A file that cannot be read has an error and no content.
    """

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_repository(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The data source's rows, registered for the session. A missing folder raises, as does one that is a file."""
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repository").options(**options).load(path)


def local_snapshot(spark: SparkSession, path: str) -> tuple[dict[str, str | None], DataFrame]:
    """What git knows of the repository around a folder, and all its files but git's own. A folder outside any repository raises."""
    root = git_root(path)
    if root is None:
        raise ValueError(f"no repository around {path}")
    return {"repository_root": root, **git_metadata(root)}, read_repository(spark, root, prune=".git")
