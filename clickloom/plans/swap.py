"""Changes of stored tables that survive being broken off at any step.

A change is written beside the table, under ``_changes``, which readers of the table do not list. A list of the folders
and files it concerns, put in place by one rename, decides: before it the change never happened and is thrown away;
after it the change is carried through, by whoever opens the table for the next change. Old content is moved aside and
deleted only when all new content is in place. Between the first and the last move, readers may see both.

One change of a table runs at a time. The file system must rename folders as one step, as HDFS and local disks do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

CHANGES = "_changes"
_PLAN, _DONE = "plan", "done"


class TableFiles:
    """The few file operations a change needs, relative to the table's folder. A refused operation is an error."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._folder = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._folder(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._folder(f"{self.root}/{name}" if name else self.root)

    def make(self) -> None:
        """The table's folder, if it is not there yet."""
        self._files.mkdirs(self._at(""))

    def exists(self, name: str) -> bool:
        return self._files.exists(self._at(name))

    def names(self, name: str) -> list[str]:
        """Entries of a folder, none if there is no such folder."""
        if not self.exists(name):
            return []
        return sorted(status.getPath().getName() for status in self._files.listStatus(self._at(name)))

    def rename(self, old: str, new: str) -> None:
        if self.exists(new):
            raise OSError(f"{self.root}: {new} is in the way of {old}")
        self._files.mkdirs(self._at(new).getParent())
        if not self._files.rename(self._at(old), self._at(new)):
            raise OSError(f"{self.root}: {old} could not be renamed to {new}")

    def delete(self, name: str) -> None:
        if self.exists(name) and not self._files.delete(self._at(name), True):
            raise OSError(f"{self.root}: {name} could not be deleted")

    def write(self, name: str, text: str) -> None:
        out = self._files.create(self._at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        source = self._files.open(self._at(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()


def _visible(names: list[str]) -> list[str]:
    return [n for n in names if not n.startswith(("_", "."))]


def _carry_through(files: TableFiles, folder: str) -> None:
    """Move old content aside and new content in. Every step can be repeated: where it stands shows in the folders."""
    for line in files.read(f"{folder}/{_PLAN}").splitlines():
        kind, name = line.split(" ", 1)
        fresh, old = f"{folder}/new/{name}", f"{folder}/old/{name}"
        if kind == "replace":
            if files.exists(fresh):
                if files.exists(name):
                    files.rename(name, old)
                files.rename(fresh, name)
        elif files.exists(name) and not files.exists(old):
            files.rename(name, old)
    files.rename(f"{folder}/{_PLAN}", f"{folder}/{_DONE}")
    files.delete(folder)


def recover(spark: SparkSession, root: str, files: TableFiles | None = None) -> None:
    """Finish changes that were decided and throw away those that were not. Nothing happens to a table without any."""
    files = files or TableFiles(spark, root)
    for name in files.names(CHANGES):
        folder = f"{CHANGES}/{name}"
        if files.exists(f"{folder}/{_PLAN}"):
            _carry_through(files, folder)
        else:
            files.delete(folder)
    files.delete(CHANGES)
    spark.catalog.refreshByPath(root)


def replace(spark: SparkSession, root: str, write: Callable[[str], None], units: list[str] | None = None) -> None:
    """Make ``units`` of the table hold what ``write`` puts into the folder it is given, and nothing else.

    A unit is a partition's folder, relative to the table (``batch_id=a/dt=2024-01-01``); ``write`` lays the new ones
    out in the same way, and units it leaves out go. Without units the whole content is replaced.
    """
    files = TableFiles(spark, root)
    recover(spark, root, files)
    folder = f"{CHANGES}/{uuid.uuid4().hex[:12]}"
    write(f"{files.root}/{folder}/new")
    if units is None:
        fresh = set(_visible(files.names(f"{folder}/new")))
        old = _visible(files.names(""))
        plan = [f"remove {n}" for n in old if n not in fresh] + [f"replace {n}" for n in sorted(fresh)]
    else:
        plan = [f"{'replace' if files.exists(f'{folder}/new/{u}') else 'remove'} {u}" for u in units]
    files.write(f"{folder}/draft", "\n".join(plan))
    files.rename(f"{folder}/draft", f"{folder}/{_PLAN}")
    _carry_through(files, folder)
    files.delete(CHANGES)
    spark.catalog.refreshByPath(root)
