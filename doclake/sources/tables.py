"""Sinks and scans of the document and chunk tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from doclake.operators.embedding import memo_bucket
from doclake.operators.ranking import BLOCK, block_of
from doclake.operators.retrieval import document_bucket
from doclake.schemas import CHUNKS, DOCUMENTS, MEMO, TOMBSTONES


def write_documents(documents: DataFrame, path: str, mode: str = "append") -> None:
    documents.write.mode(mode).parquet(path)


def write_chunks(chunks: DataFrame, path: str, mode: str = "append", bucketed: bool = False) -> None:
    """Partition by tenant and keep a document's chunks together.

    Rows are laid out by document, so row-group statistics serve document filters; a long document
    is cut into blocks. The number of files follows the data: partitions are rebalanced to the advisory
    size, small ones joined and large ones split. ``bucketed`` parts a tenant further by ``document_bucket``,
    which retrieval prunes by: for tenants with many files. ``generation`` counts the deletions before the write.
    """
    parts = ["tenant_id"]
    if bucketed:
        chunks = chunks.withColumn("document_bucket", document_bucket(F.col("document_id")))
        parts.append("document_bucket")
    chunks = chunks.withColumn("generation", F.lit(_generation(chunks.sparkSession, path)))
    block = block_of(F.coalesce("chunk_index", F.lit(0)), BLOCK)
    (
        chunks.withColumn("_block", block)
        .hint("rebalance", *map(F.col, parts), F.col("document_id"), F.col("_block"))
        .drop("_block")
        .sortWithinPartitions(*parts, "document_id", "chunk_index")
        .write.mode(mode)
        .partitionBy(*parts, "generation")
        .parquet(path)
    )


def _tombstones(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of deletions beside a chunk table; None before the first."""
    try:
        return spark.read.schema(TOMBSTONES).parquet(f"{path.rstrip('/')}.deleted")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _generation(spark: SparkSession, path: str) -> int:
    dead = _tombstones(spark, path)
    last = dead.agg(F.max("generation")).first()[0] if dead is not None else None
    return 0 if last is None else last + 1


def delete_documents(doomed: DataFrame, path: str) -> None:
    """Delete the (document_id, tenant_id) pairs of ``doomed`` from the chunk table at ``path``.

    Only their keys are written: a pair's chunks of this generation and before are dead to every later read, while
    chunks written after it live. No file of the table is touched; ``compact_chunks`` leaves the dead out.
    """
    number = F.lit(_generation(doomed.sparkSession, path)).alias("generation")
    keys = doomed.select("document_id", "tenant_id").distinct()
    keys.select("*", number).write.mode("append").parquet(f"{path.rstrip('/')}.deleted")


def compact_chunks(spark: SparkSession, path: str, to: str) -> None:
    """Write the living chunks to a table of their own."""
    live = read_chunks(spark, path)
    write_chunks(live.drop("document_bucket"), to, bucketed="document_bucket" in live.columns)


def write_memo(memo: DataFrame, path: str, mode: str = "append") -> None:
    """(memo_key, embedding) rows by bucket of the key."""
    rows = memo.select("memo_key", "embedding", memo_bucket(F.col("memo_key")).alias("bucket"))
    rows.hint("rebalance", F.col("bucket")).write.mode(mode).partitionBy("bucket").parquet(path)


def read_memo(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEMO).parquet(path)


def compact_memo(spark: SparkSession, path: str, to: str) -> None:
    """Write a memo's rows to a table of their own, each key once: batches at the same time may have added a key
    twice."""
    write_memo(read_memo(spark, path).dropDuplicates(["memo_key"]), to)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All versions; ``identity.latest`` gives the table as it stands."""
    return spark.read.schema(DOCUMENTS).parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The living chunks; a table that was written ``bucketed`` also has its ``document_bucket``.

    There is one row per deleted pair to compare with; while nothing was deleted the table is read as it is.
    """
    rows = spark.read.schema(CHUNKS).parquet(path)
    dead = _tombstones(spark, path)
    if dead is None:
        return rows.drop("generation")
    last = dead.groupBy("document_id", "tenant_id").agg(F.max("generation").alias("_dead"))
    rows = rows.join(last, ["document_id", "tenant_id"], "left")
    alive = F.col("_dead").isNull() | (F.col("generation") > F.col("_dead"))
    return rows.where(alive).select(*[c for c in rows.columns if c not in ("_dead", "generation")])
