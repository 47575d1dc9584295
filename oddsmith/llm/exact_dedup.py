"""Exact deduplication against a persistent index of digests, bucketed and sorted by digest.

New rows are reduced to one per digest, joined against the index by a sort-merge anti-join that
moves only the new side (the index is already bucketed and sorted), and what is new is appended.
Every digest carries the batch that brought it, and a batch does not count its own digests as seen:
a job that fails after its digests were appended gives the same rows when the batch is run again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.llm._shared import free_names, fresh_path, join_groups, landed, shuffles_dropped

BUCKETS = 64
_COLUMNS = "text_sha256 string, keep_id bigint, group_size bigint, batch string"


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text_sha256`` of every row; a null text counts as an empty one."""
    plain = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.sha2(plain.cast("binary"), 256).alias("text_sha256"),
    )


def one_per_digest(rows: DataFrame) -> DataFrame:
    """The largest id and the number of rows of each digest; combined before the shuffle."""
    return rows.groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


@dataclass(frozen=True)
class DigestIndex:
    """Digests of all texts accepted so far, at ``path``; ``open`` finds them again later."""

    spark: SparkSession
    name: str
    path: str

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int = BUCKETS) -> DigestIndex:
        """The index at ``path``, created empty if there is none. ``buckets`` must stay the same."""
        name = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {name} ({_COLUMNS}) USING parquet CLUSTERED BY (text_sha256) "
            f"SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return cls(spark, name, path)

    def close(self) -> None:
        """Take the index out of the session's catalog; its files stay for the next ``open``."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def unseen(self, new: DataFrame, batch: str | None = None) -> DataFrame:
        """Rows of ``new``, one per digest, that the index does not hold from another batch."""
        held = self.table()
        if batch is not None:
            held = held.filter(F.col("batch") != batch)
        return new.hint("merge").join(held, "text_sha256", "left_anti")

    def append(self, new: DataFrame, batch: str) -> None:
        """Add those digests that the index does not hold yet, bucketed and sorted like the rest."""
        columns = [part.split(" ")[0] for part in _COLUMNS.split(", ")]
        named = self.unseen(new).withColumn("batch", F.lit(batch))
        with shuffles_dropped(self.spark):
            named.select(*columns).write.insertInto(self.name)


def deduplicate(
    docs: DataFrame, index: DigestIndex, batch: str, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Rows of ``docs`` that stay, with their columns; their digests join the index.

    A text that the index holds from another batch goes; of equal new texts the row with the largest
    id stays (a null id comes last, and of rows alike in text and id one stays). An empty table leaves
    the index as it is. The digests are appended under the name ``batch`` before the caller has
    written the rows. If that write fails, the same rows under the same name give the same result, and
    nothing is appended twice; ``docs`` must not change between the two. Until then the texts count
    as taken by that batch.
    """
    rows = landed(digests(docs, text, doc_id), "dedup-digests")
    new = landed(index.unseen(one_per_digest(rows), batch), "dedup-new")
    index.append(new, batch)
    winner = (F.col("text_sha256") == F.col("sha")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    winners = new.select(F.col("text_sha256").alias("sha"), "keep_id")
    gone = rows.join(winners, winner, "left_anti").distinct()
    of_id, of_sha = free_names(docs, "gone_id", "gone_sha")
    gone = landed(gone.toDF(of_id, of_sha), "dedup-gone")
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    same = (sha == F.col(of_sha)) & F.col(doc_id).cast("long").eqNullSafe(F.col(of_id))
    stay = docs.join(gone, same, "left_anti")
    repeated = rows.groupBy("text_sha256", "doc_id").count().filter("count > 1")
    if not repeated.isEmpty():
        key = {of_sha: sha, of_id: F.col(doc_id).cast("long")}
        stay = stay.withColumns(key).dropDuplicates(list(key)).drop(*key)
    return stay


def dedup_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The rows enter a new index as one batch. Null texts count as empty. Rows alike in text and id
    are all marked as kept, as they carry the id that stays; a null id never wins over another and
    is not kept. An empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = landed(digests(docs, text, doc_id), "dedup-digests")
    index = DigestIndex.open(spark, fresh_path(spark, "digest-index"))
    index.append(one_per_digest(rows), "documents")
    joined = join_groups(rows, index.table(), "text_sha256", "group_size")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
