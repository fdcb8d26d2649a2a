"""Numbered documents of which the newest counts: the pointer behind tables that are published whole.

A document is written under a name of its own first and then renamed to its number. The rename fails where
the number is taken, so of two writers that start from one state only one gets through, and a reader
meets whole documents only. Data goes into folders that no reader knows of before the commit names them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_DIGITS = 12


class CommitConflict(RuntimeError):
    """Another writer took the number."""


class CommitLog:
    """JSON documents ``<number>.json`` below a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def numbers(self) -> list[int]:
        """The numbers of all documents, ascending."""
        fs, path = self._fs(self.root)
        if not fs.exists(path):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(path)]
        return sorted(int(n[:_DIGITS]) for n in names if len(n) == _DIGITS + 5 and n[:_DIGITS].isdigit())

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(self._name(number), wholetext=True).first()[0])

    def newest(self) -> tuple[int, dict | None]:
        """(number, document) of the newest commit, (0, None) before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)

    def commit(self, number: int, document: dict) -> None:
        """Publish ``document`` under a free number; raises ``CommitConflict`` where it is not."""
        fs, folder = self._fs(self.root)
        fs.mkdirs(folder)
        draft = f"{self.root}/.draft-{uuid.uuid4().hex}"
        _, source = self._fs(draft)
        out = fs.create(source, True)
        try:
            out.write(bytearray(json.dumps(document).encode()))
        finally:
            out.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        rename = getattr(hadoop, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        context = hadoop.FileContext.getFileContext(source.toUri(), self.spark._jsc.hadoopConfiguration()) \
            if source.toUri().getScheme() else hadoop.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(source, hadoop.Path(self._name(number)), none)
        except Py4JJavaError as error:
            fs.delete(source, False)
            if error.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise CommitConflict(f"{self._name(number)} exists") from error
            raise

    def remove_all_but(self, data_root: str, keep: Iterable[str]) -> list[str]:
        """Delete folders directly below ``data_root`` other than those named; their names."""
        fs, path = self._fs(data_root)
        if not fs.exists(path):
            return []
        kept = set(keep)
        gone = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() not in kept]
        for folder in gone:
            fs.delete(folder, True)
        return sorted(p.getName() for p in gone)

    def _name(self, number: int) -> str:
        return f"{self.root}/{number:0{_DIGITS}d}.json"

    def _fs(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path
