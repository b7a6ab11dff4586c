"""Tables of a scope that change all at once: data under a fresh version, and one manifest that names it.

    <path>/<table>/<by>=<scope>/version=<v>/...     data of a version
    <path>/_manifests/<scope>/<n>                   what the n-th publication of the scope holds

A publication first writes all its tables, where no reader looks, and then its manifest, under the next
number, by a rename that fails if that number is taken.  The manifest of the highest number counts, so a
reader sees the former tables or the new ones, whatever fails on the way; data that no manifest names
are swept by the next publication.  The version before the current one stays for those who still read it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Published:
    """Tables by name in a folder, each with a column ``by`` for the scope, and published scope by scope."""

    def __init__(self, spark: SparkSession, path: str, by: str = "scope"):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self._folder = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._folder(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def replace(self, scope: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> None:
        """The scope holds these tables, by name, with the columns that they are partitioned by, and nothing else; no column ``by`` is needed."""
        version = uuid.uuid4().hex
        try:
            for name, (df, parts) in tables.items():
                self._write(df.drop(self.by), f"{self._scope(name, scope)}/version={version}", parts)
            self._publish(scope, {name: version for name in tables})
        except BaseException:
            for name in tables:
                self._fs.delete(self._folder(f"{self._scope(name, scope)}/version={version}"), True)
            raise
        self._sweep(scope)

    def drop(self, scope: str) -> None:
        """The scope holds nothing, and its data are gone."""
        self._publish(scope, {})
        self._sweep(scope, former=False)

    def read(self, name: str, schema: str, scopes: Iterable[str] | None = None) -> DataFrame:
        """The published rows of a table, of all scopes or of some; schema: its columns, without ``by``."""
        wanted = self.scopes() if scopes is None else scopes
        folders = [f"{self._scope(name, s)}/version={v}" for s in wanted if (v := self.current(s).get(name))]
        empty = self.spark.createDataFrame([], f"{schema}, {self.by} string")
        if not folders:
            return empty
        found = self.spark.read.schema(empty.schema).option("basePath", f"{self.path}/{name}").parquet(*folders)
        return found.select(*empty.columns)

    def current(self, scope: str) -> dict[str, str]:
        """Version of each table of the scope's last publication."""
        numbers = self._numbers(scope)
        return self._manifest(scope, numbers[-1]) if numbers else {}

    def folder(self, scope: str, name: str) -> str:
        """Where a table of the scope's last publication lies."""
        return f"{self._scope(name, scope)}/version={self.current(scope)[name]}"

    def scopes(self) -> list[str]:
        return [unquote(n) for n in self._names(f"{self.path}/_manifests")]

    def _scope(self, name: str, scope: str) -> str:
        return f"{self.path}/{name}/{self.by}={quote(scope, safe='')}"

    def _write(self, df: DataFrame, folder: str, parts: list[str]) -> None:
        df.write.partitionBy(*parts).parquet(folder) if parts else df.write.parquet(folder)

    def _names(self, folder: str) -> list[str]:
        place = self._folder(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def _numbers(self, scope: str) -> list[int]:
        return [int(n) for n in self._names(f"{self.path}/_manifests/{quote(scope, safe='')}") if n.isdigit()]

    def _manifest(self, scope: str, number: int) -> dict[str, str]:
        stream = self._fs.open(self._folder(f"{self.path}/_manifests/{quote(scope, safe='')}/{number:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, scope: str, versions: dict[str, str]) -> None:
        folder = f"{self.path}/_manifests/{quote(scope, safe='')}"
        number = (self._numbers(scope) or [0])[-1] + 1
        draft = self._folder(f"{folder}/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(versions).encode()))
        stream.close()
        place = self._folder(f"{folder}/{number:012d}")
        if self._fs.exists(place) or not self._fs.rename(draft, place):
            self._fs.delete(draft, False)
            raise RuntimeError(f"{scope!r} was published by another writer meanwhile")

    def _sweep(self, scope: str, former: bool = True) -> None:
        """Delete the versions that the last manifest, and the one before it, don't name."""
        numbers = self._numbers(scope)
        kept = numbers[-2:] if former else numbers[-1:]
        named = {(t, v) for n in kept for t, v in self._manifest(scope, n).items()}
        for name in self._names(self.path):
            if name != "_manifests":
                for version in self._names(self._scope(name, scope)):
                    if (name, version.removeprefix("version=")) not in named:
                        self._fs.delete(self._folder(f"{self._scope(name, scope)}/{version}"), True)
        for n in numbers[: -len(kept)]:
            self._fs.delete(self._folder(f"{self.path}/_manifests/{quote(scope, safe='')}/{n:012d}"), False)


def count_rows(df: DataFrame, by: str) -> dict[str, int]:
    """Rows by the names in a column: a row a name."""
    return {r[0]: r[1] for r in df.groupBy(by).agg(F.count(F.lit(1))).collect()}
