"""Document identity: deterministic ids, get-or-create, checksum refresh, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from doclake.schemas import DEFAULT_SOURCE_TYPE

KEY = ["tenant_id", "source_uri"]


def document_id(tenant: Column, source_uri: Column) -> Column:
    return F.md5(F.concat(tenant, F.lit(":"), source_uri))


def bytes_checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def upload_uri(name: Column, content: Column) -> Column:
    """The file name, or ``upload-`` and 12 hex digits of the checksum when there is none."""
    return F.coalesce(
        F.nullif(name, F.lit("")), F.concat(F.lit("upload-"), F.substring(bytes_checksum(content), 1, 12))
    )


def _arrivals(incoming: DataFrame) -> DataFrame:
    """One row per key: the first arrival's fields and the last checksum given.

    ``seq`` is the order of arrival. The aggregate combines copies before the shuffle, so a key
    that arrives very often costs one row per task.
    """
    given = F.when(F.col("checksum") != "", F.col("checksum"))
    return incoming.groupBy(*KEY).agg(
        F.min_by("source_type", "seq").alias("source_type"),
        F.max_by(given, F.when(given.isNotNull(), F.col("seq"))).alias("checksum"),
    )


def _versioned(documents: DataFrame) -> DataFrame:
    """Rows without a version are the first of their key."""
    if "version" in documents.columns:
        return documents.withColumn("version", F.coalesce("version", F.lit(0)))
    return documents.withColumn("version", F.lit(0))


def _resolved(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per key of ``incoming``, with ``is_new``, and ``_checksum`` and ``_version`` of what is known."""
    old = _versioned(existing).select(
        *KEY,
        F.col("document_id").alias("_id"),
        F.col("source_type").alias("_type"),
        F.col("checksum").alias("_checksum"),
        F.col("created_at").alias("_created"),
        F.col("version").alias("_version"),
    )
    return (
        _arrivals(incoming)
        .join(old, KEY, "left")
        .select(
            F.coalesce("_id", document_id(F.col("tenant_id"), F.col("source_uri"))).alias("document_id"),
            "tenant_id",
            F.coalesce("_type", "source_type", F.lit(DEFAULT_SOURCE_TYPE)).alias("source_type"),
            "source_uri",
            F.coalesce("checksum", "_checksum").alias("checksum"),
            F.when(F.col("_id").isNull(), F.current_timestamp()).otherwise(F.col("_created")).alias("created_at"),
            F.col("_id").isNull().alias("is_new"),
            "_checksum",
            "_version",
        )
    )


def get_or_create(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Resolve every (tenant, uri) of ``incoming``: ``is_new`` tells created from found.

    Found documents keep their id, source type and creation time; a checksum that comes with the
    request replaces the stored one. ``existing``: one row per key (``latest``); ``incoming``: tenant_id,
    source_uri, source_type, checksum, seq.
    """
    return _resolved(existing, incoming).drop("_checksum", "_version")


def register(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The rows that ``incoming`` adds to the documents table: new documents, and known ones with another checksum
    as their next version. Nothing else of the table is written again.

    A batch that is registered twice against the same table gives the same rows; appended twice, they count once.
    """
    rows = _resolved(existing, incoming)
    changed = F.col("is_new") | ~F.col("checksum").eqNullSafe(F.col("_checksum"))
    version = F.when(F.col("is_new"), 0).otherwise(F.col("_version") + 1).cast("int").alias("version")
    columns = ["document_id", *KEY[:1], "source_type", "source_uri", "checksum", "created_at"]
    return rows.where(changed).select(*columns, version)


def latest(versions: DataFrame) -> DataFrame:
    """The documents table as it stands: per key the row of the highest version. Copies of a row are combined before
    the shuffle. Written to a new place this is the table's compaction."""
    versions = _versioned(versions)
    rest = [c for c in versions.columns if c not in (*KEY, "version")]
    row = F.max_by(F.struct(*rest), F.struct("version", "checksum", "document_id")).alias("_row")
    found = versions.groupBy(*KEY).agg(row, F.max("version").alias("version"))
    return found.select(*[F.col(c) if c in (*KEY, "version") else F.col(f"_row.{c}").alias(c) for c in versions.columns])


def refresh_checksums(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``existing`` with the checksums that ``incoming`` supplies for known keys."""
    fresh = _arrivals(incoming).select(*KEY, F.col("checksum").alias("_fresh"))
    return (
        existing.join(fresh, KEY, "left")
        .withColumn("checksum", F.coalesce("_fresh", "checksum"))
        .select(*existing.columns)
    )


def document_changes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``new``, ``changed``, ``same`` or ``absent`` per key, by checksum (an extension)."""
    old = existing.select(*KEY, F.col("checksum").alias("_old"), F.lit(True).alias("_known"))
    new = _arrivals(incoming).select(*KEY, F.col("checksum").alias("_new"), F.lit(True).alias("_seen"))
    change = (
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("_seen").isNull(), "absent")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "same")
        .otherwise("changed")
    )
    return old.join(new, KEY, "full").select(*KEY, change.alias("change"))
