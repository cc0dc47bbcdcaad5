"""Checkpoints of a training run: each written beside the others, one pointer to the best, resumption by step.

A checkpoint is a table.  It is written to a folder of its own name; only then is a small record of its step, its metric
and its folder renamed into place, which commits it.  The pointer to the best one is such a record, too, and replaced by
one atomic rename, so a run that ends anywhere leaves the last committed step and a best one that can be read.
Folders that no record names are left-overs and are deleted by the next commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Checkpoints:
    """The checkpoints below ``path``; the best has the largest metric, the first of equals."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def _names(self, below: str) -> list[str]:
        where = self._path(f"{self.path}/{below}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _read(self, name: str) -> dict | None:
        where = self._path(f"{self.path}/{name}")
        if not self._fs.exists(where):
            return None
        stream = self._fs.open(where)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _put(self, name: str, record: dict) -> None:
        """Write a record beside its place and rename it over what is there."""
        jvm = self.spark.sparkContext._jvm
        beside = self._path(f"{self.path}/_{uuid.uuid4().hex}")
        stream = self._fs.create(beside, True)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        target = self._path(f"{self.path}/{name}")
        self._fs.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getParent().toUri(), self._conf)
        context.rename(self._fs.makeQualified(beside), self._fs.makeQualified(target), options)

    def commit(self, table: DataFrame, step: int, metric: float) -> bool:
        """Write a checkpoint; whether it is the best so far."""
        folder = f"data/{step:012d}-{uuid.uuid4().hex}"
        table.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        record = {"step": step, "metric": metric, "folder": folder}
        self._put(f"steps/{step:012d}", record)
        best = self._read("best")
        better = best is None or metric > best["metric"]
        if better:
            self._put("best", record)
        self._tidy()
        return better

    def _tidy(self) -> None:
        """Keep the last committed steps and the best one."""
        for name in self._names("steps")[: -self.keep]:
            self._fs.delete(self._path(f"{self.path}/steps/{name}"), True)
        named = {self._read(f"steps/{n}")["folder"] for n in self._names("steps")} | {(self._read("best") or {}).get("folder")}
        for name in self._names("data"):
            if f"data/{name}" not in named:
                self._fs.delete(self._path(f"{self.path}/data/{name}"), True)

    def _table(self, record: dict | None) -> tuple[int, float, DataFrame] | None:
        return record and (record["step"], record["metric"], self.spark.read.parquet(f"{self.path}/{record['folder']}"))

    def last(self) -> tuple[int, float, DataFrame] | None:
        """(step, metric, table) of the last committed step."""
        names = self._names("steps")
        return self._table(self._read(f"steps/{names[-1]}")) if names else None

    def best(self) -> tuple[int, float, DataFrame] | None:
        """(step, metric, table) of the best checkpoint."""
        return self._table(self._read("best"))
