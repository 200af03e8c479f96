"""Token counts from the exact histogram of encoded lengths.

Documents are encoded where they lie; each task sends only its histogram, so the
shuffle carries one row per task and distinct length. Suffix sums over lengths
then answer, for every context limit, how many documents and tokens exceed it,
what a corpus cut at that limit would hold, and the quantile of each length.

Cases: null and empty texts have length 0 (plus any end token) and count as
documents; repeated rows count each; an empty table gives an empty histogram;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .tokens import default_path, encoder

#: Lengths per block of the two-level suffix sums.
BLOCK = 256


def length_histogram(docs: DataFrame, text: str = "text", path: str | None = None, end_token: bool = False) -> DataFrame:
    """(length, docs): documents by exact number of token ids."""
    path, extra = path or default_path(), int(end_token)

    def count(batches):
        import pyarrow as pa

        enc, seen = encoder(path), Counter()
        for batch in batches:
            for value in batch.column(0):
                seen[len(enc.encode(value.as_py())) + extra] += 1
        keys = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], ["length", "docs"])

    parts = map_arrow(docs.select(F.col(text).alias("text")), count, "length long, docs long")
    return parts.groupBy("length").agg(F.sum("docs").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """One row per distinct length, taken as a context limit.

    docs, tokens: of this length. docs_over, tokens_over: longer documents.
    truncated_total: tokens left when every document is cut at this length.
    total_docs, total_tokens: of all. quantile: share of documents no longer.
    """
    h = histogram.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    later, total = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing), Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    blocks = blocks.select(
        "block",
        zero(F.sum("bd").over(later)).alias("later_docs"),
        zero(F.sum("bt").over(later)).alias("later_tokens"),
        F.sum("bd").over(total).alias("total_docs"),
        F.sum("bt").over(total).alias("total_tokens"),
    )
    after = Window.partitionBy("block").orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    h = h.withColumn("d", zero(F.sum("docs").over(after))).withColumn("t", zero(F.sum("tokens").over(after)))
    h = h.join(blocks, "block").withColumn("docs_over", F.col("later_docs") + F.col("d")).withColumn("tokens_over", F.col("later_tokens") + F.col("t"))
    return h.select(
        "length",
        "docs",
        "tokens",
        "docs_over",
        "tokens_over",
        (F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("length")).alias("truncated_total"),
        "total_docs",
        "total_tokens",
        (1 - F.col("docs_over") / F.col("total_docs")).alias("quantile"),
    )


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None, end_token: bool = False) -> DataFrame:
    return suffix_sums(cut(length_histogram(docs, text, path, end_token), "lengths"))


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row: docs_over, tokens_over, truncated_total for any limit, present as a length or not."""
    over = sums.filter(F.col("length") > limit)
    some = over.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs_over"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_over"))
    total = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total"))
    return some.crossJoin(total).select("docs_over", "tokens_over", (F.col("total") - F.col("tokens_over") + F.col("docs_over") * limit).alias("truncated_total"))
