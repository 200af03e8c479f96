"""Exact dedup on a persistent digest index [DataFrame operations only].

The index is a table bucketed and sorted by digest. New data comes in batches, each
in parts by descending doc_id: a part is reduced to one row per digest, anti-joined
with the index (a sort-merge join that reads the index without shuffling it) and
what is left is appended. So of equal texts the largest doc_id enters first.

Entries carry the id of their batch. A batch that failed half-way is run again under
its id: the anti-join skips what it had appended, and its documents still count as
its own, so nothing is lost or kept twice.

Cases: null text counts as empty, so null and empty texts are equal; of rows
with equal text and equal doc_id one (arbitrary but fixed) row stays; a null
doc_id ranks below any other; an empty table gives no rows; other columns, with
any names, are ignored by `decide` and kept by `dedup`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_path, spread

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> Column:
    """SHA-256 (hex) of the text's UTF-8 after lower-casing A-Z only."""
    return F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), 256)


class DigestIndex:
    """Digests seen so far, with the doc_id that stays for each and the batch that brought it.

    The table lies at `path`, in `buckets` buckets by digest, each sorted, so
    joins on the digest need neither exchange nor global sort of the index.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path, buckets or max(8, spread(spark))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.exists = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
        if self.exists:
            self.buckets = self._stored() or self.buckets
            spark.sql(
                f"CREATE TABLE {self.table} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
            )

    def _count_file(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_buckets")  # readers skip names with an underscore

    def _stored(self) -> int | None:
        """The bucket count the index was written with."""
        at = self._count_file()
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return None
        file = fs.open(at)
        try:
            return file.readInt()
        finally:
            file.close()

    def _store(self) -> None:
        at = self._count_file()
        file = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
        try:
            file.writeInt(self.buckets)
        finally:
            file.close()

    def read(self) -> DataFrame:
        return self.spark.table(self.table) if self.exists else self.spark.createDataFrame([], "digest string, keep_id long, batch string")

    def unseen(self, digests: DataFrame) -> DataFrame:
        """Rows whose digest the index lacks: a sort-merge anti-join by bucket."""
        if not self.exists:
            return digests
        return digests.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, entries: DataFrame, batch: str) -> None:
        """Append the (digest, keep_id) rows, distinct by digest, that the index lacks."""
        out = self.unseen(entries).select("digest", F.col("keep_id").cast("long").alias("keep_id"), F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
        writer = out.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        if self.exists:
            writer.mode("append").saveAsTable(self.table)
        else:
            writer.option("path", self.path).saveAsTable(self.table)
            self._store()
            self.exists = True
        self.spark.catalog.refreshTable(self.table)


def _descending(rows: DataFrame, rank: Column, parts: int) -> list[DataFrame]:
    """rows in up to `parts` ranges of about equal size, the highest ranks first."""
    found = rows.agg(F.percentile_approx(rank, [k / parts for k in range(1, parts)]).alias("q")).first()["q"] if parts > 1 else None
    bounds = sorted(set(found or []), reverse=True)
    return [rows.filter((rank < hi if hi is not None else F.lit(True)) & (rank >= lo if lo is not None else F.lit(True))) for hi, lo in zip([None, *bounds], [*bounds, None], strict=True)]


def decide(docs: DataFrame, index: DigestIndex, text: str = "text", doc_id: str = "doc_id", batch: str | None = None, parts: int = 2) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts in the batch the largest doc_id stays, unless the index
    already holds the digest from another batch: then none stays and keep_id is the
    index's. group_size counts the batch's rows. Survivors are added to the index
    under the name `batch` (by default a new one); a failed batch is repeated under
    the same name. Hot digests: rows meet their group's record in a shuffle join of
    two tables, whose large partitions adaptive execution splits.
    """
    batch = batch or uuid.uuid4().hex
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
    rank = F.coalesce("doc_id", F.lit(-(2**63)))
    for part in _descending(rows, rank, parts):
        index.add(part.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), batch)
    groups = rows.groupBy("digest").agg(F.max(F.struct(rank.alias("rank"), "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    entries = index.read().select("digest", "keep_id", (F.col("batch") == batch).alias("own"))
    groups = groups.join(entries.hint("merge"), "digest").select("digest", "keep_id", "group_size", F.when(F.col("own"), F.col("top.row")).alias("keep_row"))
    out = rows.join(cut(groups, "groups"), "digest")
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"))


def new_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, shared_path(spark, "digest-index"))


def dedup(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", doc_id: str = "doc_id", batch: str | None = None) -> DataFrame:
    """docs without the rows that `decide` drops; same columns."""
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    at = {c: k for k, c in names.items()}
    kept = decide(docs, index or new_index(docs.sparkSession), text, doc_id, batch).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_digest"))
    tagged = docs.toDF(*names).withColumn("own_digest", digest(at[text]))
    out = tagged.join(cut(kept, "kept").hint("merge"), F.col(at[doc_id]).eqNullSafe(F.col("kept_id")) & (F.col("own_digest") == F.col("kept_digest")), "left_semi")
    if not docs.groupBy(doc_id).count().filter("count > 1").isEmpty():  # only then can one key stand for several rows
        out = out.dropDuplicates([at[doc_id], "own_digest"])
    return out.select(*[F.col(k).alias(c) for k, c in names.items()])
