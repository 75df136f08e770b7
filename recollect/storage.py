"""Tables between jobs: written to the folder that the whole cluster shares, so that lineage ends there."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets one of its
    own; on a cluster a folder of one machine would lose data, so there it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="recollect-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/recollect/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **pairs: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for the writes inside, then as they were."""
    names = {k.replace("__", "."): v for k, v in pairs.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def writing(spark: SparkSession):
    """While this holds, Spark deletes a finished write's shuffle files at once and not when the driver collects garbage."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def smaller(spark: SparkSession, name: str, size: int):
    """While this holds, a setting of bytes is at most size."""
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    return settings(spark, **{name.replace(".", "__"): str(min(now, size))})


#: Folders of stored tables that are still referred to.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def finished(*tables: DataFrame) -> None:
    """Deletes the folders of stored tables that nothing reads any more."""
    for t in tables:
        path = _folders.pop(t, None)
        if path:
            delete(t.sparkSession, path)


def _at(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def state_of(spark: SparkSession, *paths: str) -> str:
    """A digest of names, sizes and times of all files under the paths: another one once a file has changed."""
    found = []
    for path in paths:
        at, fs = _at(spark, path)
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


class Versions:
    """Numbered small JSON files in a folder, of which the last is current.

    A commit writes a file aside and renames it, so readers see the state before or after it, never a part. There is one
    writer at a time: a number that is taken already is refused.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def names(self, path: str | None = None) -> list[str]:
        at, fs = _at(self.spark, path or self.path)
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.names() if n[0] != "." and n.endswith(".json")]

    def current(self) -> dict | None:
        numbers = self.numbers()
        self.number = numbers[-1] if numbers else 0
        return self.read(self.number) if numbers else None

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/{number:010d}.json").first()[0])

    def commit(self, state: dict) -> int:
        at, fs = _at(self.spark, f"{self.path}/{self.number + 1:010d}.json")
        aside, _ = _at(self.spark, f"{self.path}/.{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(aside, at):
            fs.delete(aside, False)
            raise RuntimeError(f"version {self.number + 1} of {self.path} was written by someone else")
        self.number += 1
        return self.number
