"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from doclake.session import scratch_dir

#: A side with at most so many rows of a few numbers each is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
#: The same for keys that are strings.
BROADCAST_KEYS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a compact table in the shared scratch folder, and read back."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are at most ``most``, else as it is."""
    return F.broadcast(df) if rows <= most else df


def text_key(doc_id: Column, text: Column) -> Column:
    """What a row without id is known by, the digest of its text; null if it has an id."""
    return F.when(doc_id.isNull(), F.sha2(F.coalesce(text, F.lit("")), 256))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not in ``dropped(doc_id, text_key)``, columns unchanged.

    The list of what goes is written and counted: up to ``BROADCAST_KEYS`` rows travel to the documents, so
    that no text is shuffled; a longer list meets them by a shuffle.
    """

    def key(doc_id: Column, text_key: Column) -> Column:
        return F.coalesce(doc_id.cast("long").cast("string"), text_key)

    gone = staged(dropped.select(key(F.col("doc_id"), F.col("text_key")).alias("gone_key")).distinct(), "gone")
    gone = bounded_broadcast(gone, gone.count(), BROADCAST_KEYS)
    own = key(docs["doc_id"], text_key(docs["doc_id"], docs["text"]))
    return docs.join(gone, own == gone["gone_key"], "left_anti")


def keyed_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows (all, if there are no more), chosen by a hash of ``key``; repeatable."""
    total = df.count()
    if total <= most:
        return df
    share = int(most / total * 2**31)
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(2**31)) < share)


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Enough partitions for ``rows``, and no fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_partition))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)
