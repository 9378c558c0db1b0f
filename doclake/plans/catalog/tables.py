"""Queries on document identity and the chunk store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from doclake.operators import identity, store
from doclake.plans.catalog.base import (
    LEGACY_CHUNKS,
    REGISTRY,
    REVIEWED,
    SOURCE_CHUNKS,
    STORED_CHUNKS,
    legacy_chunks,
    query,
    registry,
    reviewed,
    source_chunks,
    stored_chunks,
    table,
)
from doclake.schemas import CHUNKS
from doclake.session import scratch_dir, stage
from doclake.sources import tables as sinks

TABLE = ["document_id", "tenant_id", "source_type", "source_uri", "checksum"]

# Incoming requests: every document twice over by source and language, in order of doc_id, so that
# keys repeat and the last checksum wins.
INCOMING = "SELECT lang AS tenant_id, source AS source_uri, 'upload' AS source_type, sha256(text) AS checksum, doc_id AS seq FROM documents"
# Stored before: the same keys as far as a labelled document used them, with an empty checksum.
EXISTING = """
    SELECT DISTINCT md5(lang || ':' || source) AS document_id, lang AS tenant_id, 'url' AS source_type,
           source AS source_uri, md5(source) AS checksum
    FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
LAST = f"SELECT tenant_id, source_uri, arg_max(checksum, seq) AS checksum FROM ({INCOMING}) GROUP BY ALL"


def _incoming(spark, sf):
    from doclake.functions.text import sha256_text

    return table(spark, sf, "documents").select(
        F.col("lang").alias("tenant_id"),
        F.col("source").alias("source_uri"),
        F.lit("upload").alias("source_type"),
        sha256_text(F.col("text")).alias("checksum"),
        F.col("doc_id").alias("seq"),
    )


def _existing(spark, sf):
    toxic = table(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id")
    rows = table(spark, sf, "documents").join(toxic, "doc_id", "left_semi").select("lang", "source").distinct()
    return rows.select(
        identity.document_id(F.col("lang"), F.col("source")).alias("document_id"),
        F.col("lang").alias("tenant_id"),
        F.lit("url").alias("source_type"),
        F.col("source").alias("source_uri"),
        F.md5("source").alias("checksum"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )


@query(f"SELECT doc_id, document_id, tenant_id, source_uri, checksum FROM ({REGISTRY})")
def doc_identity(spark, sf):
    return registry(spark, sf).select("doc_id", "document_id", "tenant_id", "source_uri", "checksum")


@query(
    f"""SELECT md5(n.tenant_id || ':' || n.source_uri) AS document_id, n.tenant_id, coalesce(e.source_type, 'upload') AS source_type,
           n.source_uri, n.checksum, e.document_id IS NULL AS is_new
    FROM ({LAST}) n LEFT JOIN ({EXISTING}) e ON n.tenant_id = e.tenant_id AND n.source_uri = e.source_uri"""
)
def get_or_create_docs(spark, sf):
    return identity.get_or_create(_existing(spark, sf), _incoming(spark, sf)).drop("created_at")


GOOD_LAST = f"""SELECT tenant_id, source_uri, arg_max(checksum, seq) AS checksum FROM ({INCOMING})
    WHERE seq IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL"""


@query(
    f"""WITH e AS ({EXISTING}),
    first AS (
        SELECT n.tenant_id, n.source_uri, n.checksum, CASE WHEN e.document_id IS NULL THEN 0 ELSE 1 END AS version
        FROM ({GOOD_LAST}) n LEFT JOIN e ON n.tenant_id = e.tenant_id AND n.source_uri = e.source_uri
        WHERE e.document_id IS NULL OR e.checksum <> n.checksum),
    after AS (SELECT tenant_id, source_uri, checksum, version FROM first
        UNION ALL SELECT tenant_id, source_uri, checksum, 0 FROM e ANTI JOIN first USING (tenant_id, source_uri)),
    second AS (
        SELECT n.tenant_id, n.source_uri, n.checksum, coalesce(a.version + 1, 0) AS version
        FROM ({LAST}) n LEFT JOIN after a ON n.tenant_id = a.tenant_id AND n.source_uri = a.source_uri
        WHERE a.version IS NULL OR a.checksum <> n.checksum)
    SELECT 'first' AS step, * FROM first UNION ALL SELECT 'second', * FROM second
    UNION ALL SELECT 'table', * FROM second
    UNION ALL SELECT 'table', a.* FROM after a ANTI JOIN second USING (tenant_id, source_uri)"""
)
def register_delta(spark, sf):
    """Two batches appended to the versions of documents, the second one twice as after a replay, and the table as it
    then stands."""
    key = ["tenant_id", "source_uri", "checksum", "version"]
    good = table(spark, sf, "labels").where(F.col("quality") == 1).select(F.col("doc_id").alias("seq"))
    before = identity.latest(_existing(spark, sf))
    first = stage(identity.register(before, _incoming(spark, sf).join(good, "seq", "left_semi")), "versions")
    versions = before.unionByName(first)
    second = stage(identity.register(identity.latest(versions), _incoming(spark, sf)), "versions")
    table_ = identity.latest(versions.unionByName(second).unionByName(second))
    steps = (("first", first), ("second", second), ("table", table_))
    parts = [rows.select(F.lit(step).alias("step"), *key) for step, rows in steps]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""SELECT e.document_id, e.tenant_id, e.source_type, e.source_uri, coalesce(n.checksum, e.checksum) AS checksum
    FROM ({EXISTING}) e LEFT JOIN (SELECT tenant_id, source_uri, arg_max(checksum, seq) AS checksum FROM ({INCOMING})
        WHERE seq IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL) n
      ON n.tenant_id = e.tenant_id AND n.source_uri = e.source_uri"""
)
def checksum_refresh(spark, sf):
    good = table(spark, sf, "labels").where(F.col("quality") == 1).select(F.col("doc_id").alias("seq"))
    incoming = _incoming(spark, sf).join(good, "seq", "left_semi")
    return identity.refresh_checksums(_existing(spark, sf), incoming).drop("created_at")


@query(
    f"""SELECT coalesce(n.tenant_id, e.tenant_id) AS tenant_id, coalesce(n.source_uri, e.source_uri) AS source_uri,
           CASE WHEN e.tenant_id IS NULL THEN 'new' WHEN n.tenant_id IS NULL THEN 'absent'
                WHEN e.checksum = n.checksum THEN 'same' ELSE 'changed' END AS change
    FROM (SELECT tenant_id, source_uri, checksum FROM ({REVIEWED})) e
    FULL JOIN (SELECT tenant_id, source_uri, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
                      THEN sha256(text || '.') ELSE checksum END AS checksum FROM ({REGISTRY})) n
      ON n.tenant_id = e.tenant_id AND n.source_uri = e.source_uri"""
)
def doc_changes(spark, sf):
    from doclake.functions.text import sha256_text

    toxic = table(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id", F.lit(True).alias("_toxic"))
    edited = F.when(F.col("_toxic"), sha256_text(F.concat("text", F.lit(".")))).otherwise(F.col("checksum"))
    now = registry(spark, sf).join(toxic, "doc_id", "left").withColumn("checksum", edited)
    return identity.document_changes(reviewed(spark, sf), now.withColumn("seq", F.col("doc_id")))


NEW_CHUNKS = f"""
    SELECT document_id, tenant_id, chunk_index, chunk_text, text_hash FROM ({SOURCE_CHUNKS})
    QUALIFY row_number() OVER (PARTITION BY document_id, text_hash ORDER BY chunk_index) = 1"""
APPENDED = f"""
    SELECT n.* FROM ({NEW_CHUNKS}) n
    ANTI JOIN (SELECT document_id, text_hash FROM ({STORED_CHUNKS})) s USING (document_id, text_hash)"""


@query(APPENDED)
def upsert_chunks(spark, sf):
    return store.new_chunks(source_chunks(spark, sf).drop("doc_id"), stored_chunks(spark, sf), at_rest=True)


@query(
    f"""SELECT document_id, text_hash, coalesce(i, -1) AS chunk_index, chunk_text FROM (
        SELECT *, CASE WHEN doc_id % 2 = 0 THEN chunk_index END AS i FROM ({SOURCE_CHUNKS}))
    QUALIFY row_number() OVER (PARTITION BY document_id, text_hash ORDER BY i NULLS LAST) = 1"""
)
def upsert_null_index(spark, sf):
    """Every second chunk has no index; its row is kept all the same."""
    chunks = source_chunks(spark, sf)
    chunks = chunks.withColumn("chunk_index", F.when(F.col("doc_id") % 2 == 0, F.col("chunk_index")))
    kept = store.first_occurrences(chunks, at_rest=True)
    return kept.select("document_id", "text_hash", F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"), "chunk_text")


@query(
    f"""SELECT c.document_id, c.parsed, coalesce(n.inserted, 0)::BIGINT AS inserted, (c.parsed - coalesce(n.inserted, 0))::BIGINT AS skipped
    FROM (SELECT document_id, count(*) AS parsed FROM ({SOURCE_CHUNKS}) GROUP BY 1) c
    LEFT JOIN (SELECT document_id, count(*) AS inserted FROM ({APPENDED}) GROUP BY 1) n USING (document_id)"""
)
def upsert_counts(spark, sf):
    return store.upsert_counts(source_chunks(spark, sf), stored_chunks(spark, sf))


@query(f"SELECT document_id, count(*) AS chunks_stored FROM ({SOURCE_CHUNKS}) GROUP BY 1")
def chunks_stored(spark, sf):
    return store.chunks_stored(source_chunks(spark, sf))


def _registered_chunks(spark, sf):
    """Whole texts as one chunk of their own registered document."""
    return registry(spark, sf).select("document_id", "tenant_id", "source_uri", "doc_id")


DOOMED = f"SELECT document_id, tenant_id FROM ({REVIEWED})"


@query(
    f"""SELECT 'chunk' AS kind, document_id, tenant_id FROM ({REGISTRY}) WHERE document_id NOT IN (SELECT document_id FROM ({DOOMED}))
    UNION ALL
    SELECT 'document', document_id, tenant_id FROM ({REGISTRY}) WHERE document_id NOT IN (SELECT document_id FROM ({DOOMED}))
    UNION ALL
    SELECT 'written again', document_id, tenant_id FROM ({REVIEWED}) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"""
)
def delete_document(spark, sf):
    """Labelled documents deleted from the written chunk table, and some of them written again; and from the
    document table."""
    doomed = reviewed(spark, sf).select("document_id", "tenant_id")
    chunks = registry(spark, sf).select(
        "document_id", "tenant_id", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"), F.col("checksum").alias("text_hash")
    )
    path = f"{scratch_dir(spark)}/living-{uuid.uuid4().hex}"
    sinks.write_chunks(store.evolve(chunks.withColumn("chunk_type", F.lit("first")), CHUNKS), path)
    sinks.delete_documents(doomed, path)
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    again = registry(spark, sf).join(good, "doc_id", "left_semi").select("document_id", "tenant_id")
    sinks.write_chunks(store.evolve(again.withColumn("chunk_type", F.lit("again")), CHUNKS), path)
    keys = ["document_id", "tenant_id"]
    kind = F.when(F.col("chunk_type") == "again", "written again").otherwise("chunk").alias("kind")
    documents = store.without_documents(registry(spark, sf), doomed)
    living = sinks.read_chunks(spark, path).select(kind, *keys)
    return living.unionByName(documents.select(F.lit("document").alias("kind"), *keys))


@query(f"SELECT count(*) AS total_chunks FROM ({STORED_CHUNKS})")
def total_chunks(spark, sf):
    return store.total_chunks(stored_chunks(spark, sf))


@query(f"SELECT document_id, tenant_id, chunk_index, chunk_text, text_hash FROM ({SOURCE_CHUNKS}) LIMIT 0")
def clear_store(spark, sf):
    return store.cleared(source_chunks(spark, sf).drop("doc_id"))


@query(
    f"""SELECT document_id, 'default' AS tenant_id, coalesce(chunk_index, -1) AS chunk_index, chunk_text, text_hash, true AS no_page,
           'paragraph' AS chunk_type, NULL::VARCHAR AS sheet_name, document_name FROM ({LEGACY_CHUNKS})"""
)
def evolve_columns(spark, sf):
    evolved = store.evolve(legacy_chunks(spark, sf).drop("id"), CHUNKS).drop("embedding")
    return (
        evolved.withColumn("chunk_index", F.coalesce("chunk_index", F.lit(-1)))
        .withColumn("no_page", F.col("page_number").isNull())
        .drop("page_number")
    )


@query(
    """SELECT DISTINCT md5('default:' || source) AS document_id, 'default' AS tenant_id, 'url' AS source_type, source AS source_uri
    FROM documents WHERE source NOT IN (SELECT 'src' || r_regionkey FROM region)"""
)
def backfill_documents(spark, sf):
    """Documents for legacy names, where the sources numbered like a region exist already."""
    known = table(spark, sf, "region").select(
        F.lit("default").alias("tenant_id"),
        F.concat(F.lit("src"), F.col("r_regionkey").cast("string")).alias("source_uri"),
    )
    return store.backfilled_documents(legacy_chunks(spark, sf), known)


@query(f"SELECT id, md5('default:' || document_name) AS document_id, document_name FROM ({LEGACY_CHUNKS})")
def backfill_doc_id(spark, sf):
    return store.with_document_id(legacy_chunks(spark, sf)).select("id", "document_id", "document_name")


@query(
    f"""SELECT id, md5('default:' || document_name) AS document_id,
           coalesce(chunk_index, (sum(CASE WHEN chunk_index IS NULL THEN 1 ELSE 0 END)
               OVER (PARTITION BY document_name ORDER BY id) - 1)::INT) AS chunk_index
    FROM ({LEGACY_CHUNKS})"""
)
def backfill_chunk_index(spark, sf):
    keyed = store.with_document_id(legacy_chunks(spark, sf))
    return store.with_chunk_index(keyed, block=64).select("id", "document_id", "chunk_index")


@query(
    f"SELECT document_id, text_hash, count(*) AS copies FROM ({SOURCE_CHUNKS}) GROUP BY ALL HAVING count(*) > 1"
)
def dup_key_check(spark, sf):
    return store.duplicate_keys(source_chunks(spark, sf))


@query(f"SELECT doc_id, document_id, tenant_id FROM ({REGISTRY}) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_chunks(spark, sf):
    chunks = registry(spark, sf).select("doc_id", "document_id", "tenant_id")
    return store.orphan_chunks(chunks, reviewed(spark, sf)).select("doc_id", "document_id", "tenant_id")


@query(
    f"""SELECT b.lang AS tenant_id, c.document_id, c.chunk_index FROM ({SOURCE_CHUNKS}) c
    JOIN (SELECT DISTINCT lang FROM documents WHERE lang = 'en') b ON c.tenant_id = b.lang WHERE c.document_id = 'src7'"""
)
def scoped_scan(spark, sf):
    return store.in_scope(source_chunks(spark, sf), "en", "src7").select("tenant_id", "document_id", "chunk_index")


@query(
    f"""SELECT s.tenant_id, s.document_id, s.chunk_index, sha256(s.chunk_text) AS text_hash, NULL::VARCHAR AS sheet_name,
           'paragraph' AS chunk_type FROM ({STORED_CHUNKS}) s"""
)
def write_read_roundtrip(spark, sf):
    """The chunk table written by tenant and read back."""
    chunks = store.evolve(stored_chunks(spark, sf).drop("doc_id"), CHUNKS)
    path = f"{scratch_dir(spark)}/chunks-{uuid.uuid4().hex}"
    sinks.write_chunks(chunks, path)
    return sinks.read_chunks(spark, path).select(
        "tenant_id", "document_id", "chunk_index", "text_hash", "sheet_name", "chunk_type"
    )
