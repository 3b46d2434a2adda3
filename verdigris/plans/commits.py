"""Commits in a shared folder: numbered small files, each created once by one writer only.

What a commit names is written before; the commit itself is a rename that fails where the number is
taken, which the file systems of clusters do in one step. So readers see a state whole or not at all,
and of two writers that read the same state one gets the number and the other reads again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: States that readers may still hold, kept beside the last.
KEPT = 2


class LostRace(Exception):
    """Other writers took the next number, again and again."""


class Folder:
    """Files of one folder, through Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    @property
    def fs(self):
        return self.path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, *parts: str) -> list[str]:
        at = self.path(*parts)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def has(self, *parts: str) -> bool:
        return self.fs.exists(self.path(*parts))

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, text: str, *parts: str) -> bool:
        """Whether the file could be made; False where it is there already."""
        jvm, final = self.spark._jvm, self.path(*parts)
        if self.fs.exists(final):
            return False
        draft = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, none)
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True


class Commits:
    """Numbered states of one thing; a state is any JSON value."""

    def __init__(self, spark: SparkSession, root: str):
        self.folder = Folder(spark, root)

    def latest(self) -> tuple[int, object]:
        """Number and state of the last commit; (-1, None) before the first."""
        numbers = [n for n in self.folder.names() if n.isdigit()]
        return (int(numbers[-1]), json.loads(self.folder.read(numbers[-1]))) if numbers else (-1, None)

    def put(self, number: int, state: object) -> bool:
        return self.folder.put(json.dumps(state), f"{number:012d}")

    def change(self, update: Callable[[int, object], object], undo: Callable[[object], None] = lambda state: None, tries: int = 50) -> tuple[int, object]:
        """Commits ``update(number, state)`` of the last state, again from the start where another writer was
        faster; ``undo`` takes back what a lost try has made."""
        for _ in range(tries):
            number, state = self.latest()
            new = update(number + 1, state)
            if self.put(number + 1, new):
                return number + 1, new
            undo(new)
        raise LostRace(self.folder.root)

    def states(self, last: int) -> list[tuple[int, object]]:
        """The last ``last`` commits, newest last."""
        numbers = [n for n in self.folder.names() if n.isdigit()][-last:]
        return [(int(n), json.loads(self.folder.read(n))) for n in numbers]

    def forget(self, kept: int = KEPT + 1) -> list[object]:
        """Removes all commits but the last ``kept``; their states."""
        gone = [n for n in self.folder.names() if n.isdigit()][:-kept]
        states = [json.loads(self.folder.read(n)) for n in gone]
        for n in gone:
            self.folder.delete(n)
        return states
