"""Exact dedup against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, delete, finished, scratch, settings, stored, writing

SCHEMA = "text_sha256 string, keep_id bigint"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of its normalised text (null: empty)."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")
    return docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"))


class DigestIndex:
    """One row per distinct text seen so far, in a table bucketed and sorted by digest.

    ``add`` finds a batch's new texts by a sort-merge anti-join and appends them. The batch is shuffled into the index's
    buckets; the index is read bucket by bucket without a shuffle, and while each bucket is one file without a sort.
    ``compact`` makes each bucket one file again, which ``add`` does by itself after `most_files` batches. The smallest
    doc_id of the batch that first brings a text owns it. An index at an existing path goes on where it ended, with
    the number of buckets it was made with. Null doc_ids count as rows and never own a text that another row
    has. An empty batch adds nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, most_files: int = 8):
        self.spark, self.most_files = spark, most_files
        self.path = path or scratch(spark, "digests")
        found = self._layouts()
        self.version, self.buckets, self.files = found or (0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), 0)
        if not found:
            self._note()
        self._open()

    def _layouts(self) -> tuple[int, int, int] | None:
        """version, buckets and files a bucket as last noted; each change appends one row."""
        try:
            rows = self.spark.read.schema("n bigint, version int, buckets int, files int").json(f"{self.path}/layout").orderBy(F.desc("n")).take(1)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return tuple(rows[0][1:]) if rows else None

    def _note(self) -> None:
        n = self.spark.range(1).select((F.unix_micros(F.current_timestamp())).alias("n"), F.lit(self.version).alias("version"), F.lit(self.buckets).alias("buckets"), F.lit(self.files).alias("files"))
        n.write.mode("append").json(f"{self.path}/layout")

    def _open(self) -> None:
        self.table = f"digest_index_{uuid.uuid4().hex}"
        self.files_at = f"{self.path}/digests-{self.version}"
        self.spark.sql(
            f"CREATE TABLE {self.table} ({SCHEMA}) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{self.files_at}'"
        )

    def _aligned(self):
        """Shuffles inside go to as many partitions as there are buckets, and buckets of one file count as sorted."""
        return settings(
            self.spark,
            spark__sql__shuffle__partitions=str(self.buckets),
            spark__sql__legacy__bucketedTableScan__outputOrdering="true",
            spark__sql__sources__bucketing__autoBucketedScan__enabled="false",
        )

    def new_texts(self, first: DataFrame) -> DataFrame:
        """Of text_sha256, keep_id the rows whose text the index lacks."""
        return first.join(self.spark.table(self.table).select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def add(self, batch: DataFrame) -> None:
        """batch: doc_id, text_sha256."""
        # Summed up and written out first: else Catalyst joins before it aggregates, and a hot text's rows meet in one task.
        first = stored(batch.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id")), "digest-batch")
        with self._aligned(), writing(self.spark):
            self.new_texts(first).write.insertInto(self.table)
        finished(first)
        self.spark.catalog.refreshTable(self.table)
        self.files += 1
        self._note()
        if self.files > self.most_files:
            self.compact()

    def compact(self) -> None:
        """Rewrites the index with one sorted file a bucket."""
        old, old_files = self.table, self.files_at
        self.version, self.files = self.version + 1, 1
        self._open()
        with self._aligned(), writing(self.spark):
            self.spark.table(old).write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        self._note()
        self.spark.sql(f"DROP TABLE {old}")
        delete(self.spark, old_files)

    def owners(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        """Forgets the table's name; its files stay at the path."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def buckets_for(rows: int, spark: SparkSession, bucket_rows: int = 1 << 20) -> int:
    """Buckets of about a million digests (80 MB) at most, and no fewer than there are shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // bucket_rows))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    The rows go to the index in batches by ascending doc_id, so the smallest doc_id of equal texts stays
    (unless the index already knew the text). Rows that repeat a doc_id count one each in group_size and
    share one decision. Null text is empty text. Texts of any length become a digest in the scan; equal texts are a tie
    that the smallest doc_id wins. Other columns are not read, so their names can't clash. An index made here is
    deleted once the owners are written out.
    """
    spark = docs.sparkSession
    d = stored(digests(docs), "digest-rows")
    own = index is None
    index = index or DigestIndex(spark, buckets=buckets_for(d.count(), spark))
    cuts = d.select("doc_id").dropna().approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = d
        if low is not None:
            part = part.where(F.col("doc_id").isNull() | (F.col("doc_id") >= low)) if high is None else part.where(F.col("doc_id") >= low)
        if high is not None:
            part = part.where(F.col("doc_id") < high)
        index.add(part)
    sizes = d.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"))
    # Written out, so that both sides of the last join are plain exchanges and a hot digest's rows can be split.
    with index._aligned():
        known = stored(sizes.join(index.owners().hint("merge"), "text_sha256"), "digest-owners")
    if own:
        index.drop()
        delete(spark, index.path)
    return d.join(known, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
