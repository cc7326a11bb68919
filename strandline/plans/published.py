"""Versioned tables: a manifest says which folder holds the rows, so that a reader finds a whole table at any time.

A version is a folder of Parquet and, once that is whole, a numbered manifest beside it that appears by one rename. Readers
take the highest number. The version before stays until the next is published, for those that are still reading it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Manifest:
    """``version``, the folder of its rows, their schema, and what the writer wants to say about them."""

    version: int
    data: str
    schema: T.StructType
    notes: dict


class Files:
    """The few file operations that publishing needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.root = spark._jvm, path.rstrip("/")
        self._fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self.at(name))] if self._fs.exists(self.at(name)) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file that is there whole or not at all; False where there is one of that name already."""
        beside = self.at(f"_writing-{uuid.uuid4().hex}")
        stream = self._fs.create(beside)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.mkdirs(self.at(name).getParent())
        done = not self._fs.exists(self.at(name)) and self._fs.rename(beside, self.at(name))
        if not done:
            self._fs.delete(beside, False)
        return bool(done)

    def remove(self, name: str) -> None:
        self._fs.delete(self.at(name), True)


MANIFESTS = "_manifest"


def current(spark: SparkSession, path: str) -> Manifest | None:
    """The newest published version of the table at ``path``; None where none is published."""
    files = Files(spark, path)
    numbers = sorted(n for n in files.names(MANIFESTS) if n.isdigit())
    if not numbers:
        return None
    told = json.loads(files.read(f"{MANIFESTS}/{numbers[-1]}"))
    return Manifest(int(numbers[-1]), told["data"], T.StructType.fromJson(told["schema"]), told["notes"])


def published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest version."""
    now = current(spark, path)
    if now is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.schema(now.schema).parquet(f"{path.rstrip('/')}/{now.data}")


class Conflict(RuntimeError):
    """Another writer has published this version."""


def stage(df: DataFrame, path: str) -> str:
    """Write ``df`` beside the versions, seen by no reader; returns the name of its folder."""
    name = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{name}")
    return name


def publish(spark: SparkSession, path: str, data: str, schema: T.StructType, version: int, notes: dict | None = None, keep: int = 2) -> None:
    """Make a staged folder the table's ``version`` and drop all but the last ``keep`` versions; raises ``Conflict`` if the version is taken."""
    files = Files(spark, path)
    if not files.create(f"{MANIFESTS}/{version:012d}", json.dumps({"data": data, "schema": schema.jsonValue(), "notes": notes or {}})):
        raise Conflict(f"version {version} of {path} is there")
    numbers = sorted(n for n in files.names(MANIFESTS) if n.isdigit())
    for number in numbers[: max(0, len(numbers) - keep)]:
        old = json.loads(files.read(f"{MANIFESTS}/{number}"))["data"]
        files.remove(f"{MANIFESTS}/{number}")
        files.remove(old)


def discard(spark: SparkSession, path: str, data: str) -> None:
    """Remove a staged folder that is not to be published."""
    Files(spark, path).remove(data)
