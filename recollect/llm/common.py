"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, finished, scratch, settings, shared_dir, stored, writing  # noqa: F401

#: White space of every contract: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Log:
    """What an index in a folder holds: (kind, number) of each change, in order, appended to one small JSON table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        try:
            rows = spark.read.schema("n bigint, kind string, number bigint").json(path).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        self.rows: list[tuple[str, int]] = [(r["kind"], r["number"]) for r in sorted(rows)]

    def add(self, *changes) -> None:
        """Notes (kind, number, kind, number, ...) at once."""
        pairs = [(k, int(x)) for k, x in zip(changes[::2], changes[1::2], strict=True)]
        rows = [(len(self.rows) + i, k, x) for i, (k, x) in enumerate(pairs)]
        self.spark.createDataFrame(rows, "n bigint, kind string, number bigint").coalesce(1).write.mode("append").json(self.path)
        self.rows += pairs

    def numbers(self, kind: str) -> list[int]:
        return [x for k, x in self.rows if k == kind]


def aligned(spark: SparkSession, buckets: int):
    """While this holds, shuffles go to as many partitions as a table has buckets, its buckets of one file count as sorted,
    and keys may be joined that only begin with the bucketed ones: joins with the table need no shuffle or sort of it."""
    return settings(
        spark,
        spark__sql__shuffle__partitions=str(buckets),
        spark__sql__legacy__bucketedTableScan__outputOrdering="true",
        spark__sql__sources__bucketing__autoBucketedScan__enabled="false",
        spark__sql__requireAllClusterKeysForCoPartition="false",
    )


def bucketed(spark: SparkSession, path: str, schema: str, keys: str, order: str, buckets: int) -> str:
    """The name of a table over the files at path, bucketed by keys and sorted by order. Only the catalog knows it."""
    name = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and (doc, twin), which names a row: its doc_id, or where that is null a hash of its text,
    and 32 bits more that tell rows of one doc_id apart by their texts. Rows equal in both columns share a name."""
    text = F.coalesce("text", F.lit(""))
    both = F.xxhash64("doc_id", text)
    return docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.xxhash64(text)).alias("doc"), F.shiftright(both, 32).cast("int").alias("twin"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about max_bytes of text at most (a longer text is a slice of its own)."""
    for batch in batches:
        offsets = text_offsets(batch.column("text"))
        at = 0
        while at < len(batch):
            to = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            to = min(max(to, at + 1), len(batch))
            yield batch.slice(at, to - at)
            at = to


def text_offsets(col: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if not len(col):
        return np.zeros(1, np.int64)
    return np.frombuffer(col.buffers()[1], width)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and where each starts (one more entry for the end). A null is empty."""
    offsets = text_offsets(col)
    buffer = col.buffers()[2] if len(col) else None
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(col: pa.Array) -> list[bytes]:
    """Each text as bytes; a null is empty."""
    data, at = text_bytes(col)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
