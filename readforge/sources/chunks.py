"""A tree of groups, datasets and attributes in a shared folder: datasets are Parquet tables, attributes one-row tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

DATASET, ATTRIBUTES = "_dataset", "_attributes"


class ChunkStore:
    """Paths of nodes are written like ``/group/dataset``. All of it lies in Hadoop's file system, so any executor sees it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, node: str, *more: str) -> str:
        names = [n for n in node.split("/") if n]
        if any(n in (DATASET, ATTRIBUTES, ".", "..") for n in names):
            raise ValueError(f"{node} holds a reserved name")
        return "/".join([self.root, *names, *more])

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def create_group(self, node: str) -> str:
        """Make a group and those above it, or open what is there."""
        self._fs.mkdirs(self._path(self._at(node)))
        return node

    def write_dataset(self, node: str, rows: DataFrame) -> None:
        """Store a table; one that is there already gets the rows added."""
        rows.write.mode("append").parquet(self._at(node, DATASET))

    def read_dataset(self, node: str) -> DataFrame | None:
        """The table, or None if there is none."""
        path = self._at(node, DATASET)
        return self.spark.read.parquet(path) if self._exists(path) else None

    def write_attribute(self, node: str, name: str, value: Any) -> None:
        """Store a number, text or list of these at a node that is there; an attribute of that name is replaced."""
        if not self._exists(self._at(node)):
            raise ValueError(f"no node {node}")
        self.spark.createDataFrame([(value,)], ["value"]).coalesce(1).write.mode("overwrite").parquet(self._at(node, ATTRIBUTES, name))

    def write_string_array(self, node: str, name: str, strings: list[str | None]) -> int:
        """Store texts of one width and return that width: the longest text and a closing zero. A missing text is an empty one."""
        values = [s or "" for s in strings]
        rows = self.spark.createDataFrame([(values,)], "value array<string>")
        if not self._exists(self._at(node)):
            raise ValueError(f"no node {node}")
        rows.coalesce(1).write.mode("overwrite").parquet(self._at(node, ATTRIBUTES, name))
        return max((len(v) for v in values), default=0) + 1

    def read_attribute(self, node: str, name: str) -> Any:
        """The value, or None if there is none."""
        path = self._at(node, ATTRIBUTES, name)
        return self.spark.read.parquet(path).first()["value"] if self._exists(path) else None

    def delete_attribute(self, node: str, name: str) -> None:
        self._fs.delete(self._path(self._at(node, ATTRIBUTES, name)), True)

    def children(self, node: str = "/", kind: str | None = None) -> list[str]:
        """Names below a node in order, all or those that are a ``group`` or a ``dataset``."""
        path = self._at(node)
        if not self._exists(path):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory())
        names = [n for n in names if n not in (DATASET, ATTRIBUTES)]
        is_dataset = lambda n: self._exists(f"{path}/{n}/{DATASET}")
        return [n for n in names if kind is None or (kind == "dataset") == is_dataset(n)]
