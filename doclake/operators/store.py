"""The chunk and document tables: upsert, delete, migration steps and checks.

Operators return DataFrames and the caller writes them: append new rows, or write a rewritten
table to a new path. Parquet has no MERGE and no unique index, so one writer per tenant is assumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from doclake.operators.identity import KEY, document_id
from doclake.operators.membership import may_hold
from doclake.operators.ranking import BLOCK, dense_position
from doclake.schemas import DEFAULT_CHUNK_TYPE, DEFAULT_SOURCE_TYPE, DEFAULT_TENANT
from doclake.session import stage

CHUNK_KEY = ["document_id", "text_hash"]


def _first_rows(chunks: DataFrame, at_rest: bool) -> tuple[DataFrame, DataFrame]:
    """(``chunks`` with a number ``_row``, the key and ``_row`` of the first occurrence of every key).

    The choice is made on keys and numbers alone, by a hash aggregate that combines copies before the shuffle: a
    text that makes up a third of the rows never lands in one task, and texts are not sorted.
    """
    rows = (chunks if at_rest else stage(chunks, "arrived")).withColumn("_row", F.monotonically_increasing_id())
    place = F.coalesce(F.col("chunk_index").cast("int"), F.lit(2**31 - 1))
    return rows, rows.groupBy(*CHUNK_KEY).agg(F.min_by("_row", place).alias("_row"))


def _taken(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows chosen by number. Chosen numbers are written, so that few of them are broadcast to the rows."""
    return rows.join(stage(chosen.select("_row"), "chosen"), "_row", "left_semi").drop("_row")


def first_occurrences(chunks: DataFrame, at_rest: bool = False) -> DataFrame:
    """One row per (document, text hash): the one with the lowest chunk index; rows without one come last.

    ``at_rest``: ``chunks`` is a table, or a projection of one, which gives the same rows in the same order
    whenever it is read; otherwise it is written first.
    """
    return _taken(*_first_rows(chunks, at_rest))


def new_chunks(chunks: DataFrame, store: DataFrame, at_rest: bool = False) -> DataFrame:
    """Rows to append: first occurrences that the store does not hold yet. Stored rows win."""
    rows, first = _first_rows(chunks, at_rest)
    return _taken(rows, first.join(stored_near(store, first), CHUNK_KEY, "left_anti"))


def stored_near(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The keys of ``store`` that a batch may collide with: a filter of the batch's keys cuts the store's scan down
    before anything of it is shuffled."""
    return may_hold(store.select(*CHUNK_KEY), batch, CHUNK_KEY)


def store_traffic(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """(stored, shuffled, held): chunks of the store, those that an upsert of ``chunks`` shuffles, and those of
    them that the batch really holds."""
    keys = chunks.select(*CHUNK_KEY).distinct()
    near = stored_near(store, keys)
    held = near.join(keys, CHUNK_KEY, "left_semi")
    counts = [frame.agg(F.count("*").alias(name)) for frame, name in ((store, "stored"), (near, "shuffled"), (held, "held"))]
    return counts[0].join(counts[1]).join(counts[2])  # one row each


def upsert_counts(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Parsed, inserted and skipped chunks per document."""
    keys = chunks.groupBy(*CHUNK_KEY).agg(F.count("*").alias("_copies"))
    known = store.select(*CHUNK_KEY).distinct().withColumn("_stored", F.lit(1))
    inserted = F.sum(F.when(F.col("_stored").isNull(), 1).otherwise(0))
    return (
        keys.join(known, CHUNK_KEY, "left")
        .groupBy("document_id")
        .agg(F.sum("_copies").alias("parsed"), inserted.alias("inserted"))
        .withColumn("skipped", F.col("parsed") - F.col("inserted"))
    )


def chunks_stored(chunks: DataFrame) -> DataFrame:
    """What ingestion reports per document: chunks parsed, before deduplication."""
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunks_stored"))


def without_documents(table: DataFrame, doomed: DataFrame) -> DataFrame:
    """``table`` (chunks or documents) without the (document, tenant) pairs in ``doomed``."""
    return table.join(doomed.select("document_id", "tenant_id"), ["document_id", "tenant_id"], "left_anti")


def total_chunks(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("total_chunks"))


def cleared(table: DataFrame) -> DataFrame:
    """An empty table of the same shape, to be written over the old one."""
    return table.limit(0)


def in_scope(table: DataFrame, tenant: str = DEFAULT_TENANT, document: str | None = None) -> DataFrame:
    """Rows of one tenant, and of one document if given; both filters reach the scan."""
    scoped = table.where(F.col("tenant_id") == tenant)
    return scoped.where(F.col("document_id") == document) if document else scoped


def evolve(legacy: DataFrame, schema: str) -> DataFrame:
    """``legacy`` with every column of ``schema``; tenant and chunk type get their defaults."""
    target = legacy.sparkSession.createDataFrame([], schema)
    defaults = {"tenant_id": DEFAULT_TENANT, "chunk_type": DEFAULT_CHUNK_TYPE}
    merged = target.unionByName(legacy, allowMissingColumns=True)
    return merged.select(
        *[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in merged.columns]
    )


def _legacy_id(name: Column) -> Column:
    return document_id(F.lit(DEFAULT_TENANT), name)


def backfilled_documents(legacy: DataFrame, documents: DataFrame) -> DataFrame:
    """Document rows to add for legacy names without an id, unless the key exists already."""
    return (
        legacy.where(F.col("document_id").isNull() & F.col("document_name").isNotNull())
        .select(F.col("document_name").alias("source_uri"))
        .distinct()
        .select(
            _legacy_id(F.col("source_uri")).alias("document_id"),
            F.lit(DEFAULT_TENANT).alias("tenant_id"),
            F.lit(DEFAULT_SOURCE_TYPE).alias("source_type"),
            "source_uri",
        )
        .join(documents.select(*KEY), KEY, "left_anti")
    )


def with_document_id(legacy: DataFrame) -> DataFrame:
    return legacy.withColumn("document_id", F.coalesce("document_id", _legacy_id(F.col("document_name"))))


def with_chunk_index(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Number the rows that lack a chunk index, per document by ``id``; the others keep theirs.

    Numbering counts only the rows it fills in. ``id`` is a unique integer, so blocks of ids keep
    every ranked group small whatever a document's size.
    """
    missing = F.col("chunk_index").isNull() & F.col("document_id").isNotNull()
    keyed = chunks.where(missing).select("id", "document_id")
    ranked = dense_position(keyed, ["document_id"], ["id"], "_rank", block).select("id", "_rank")
    filled = chunks.where(missing).join(ranked, "id", "left").withColumn("chunk_index", F.col("_rank"))
    return chunks.where(~missing).unionByName(filled.select(*chunks.columns))


def duplicate_keys(store: DataFrame) -> DataFrame:
    return store.groupBy(*CHUNK_KEY).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def orphan_chunks(store: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document is not registered."""
    return store.join(documents.select("document_id"), "document_id", "left_anti")
