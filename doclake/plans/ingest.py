"""Files to stored chunks: size cap, type, identity, sections, chunks, upsert, embeddings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from doclake.operators import chunking, embedding, identity, store
from doclake.operators.hotjoin import join_unique
from doclake.schemas import DEFAULT_TENANT, MAX_FILE_BYTES
from doclake.session import stage
from doclake.sources import detect, files as fs
from doclake.sources.csv_splits import SPLIT_BYTES

# How documents get registered. ``url``: before parsing, so a file that cannot be parsed still has
# a record. ``upload``: the same, but files of unknown type are turned away first. ``folder``: only
# if chunks came out, without a checksum and without a size cap.
MODES = {"url": "url", "upload": "upload", "folder": "file"}


@dataclass
class Ingested:
    documents: DataFrame  # rows to append to the documents table: new documents and new versions
    chunks: DataFrame  # rows to append to the chunk table
    memo: DataFrame  # (memo_key, embedding) rows to append to the embedding memo
    rejects: DataFrame
    report: DataFrame  # (document_id, chunks_stored): parsed chunks, before deduplication


def identified(files: DataFrame, tenant: str) -> DataFrame:
    """Add checksum, source_uri where there is none, tenant_id and document_id."""
    uri = identity.upload_uri(F.col("file_name"), F.col("content"))
    if "source_uri" in files.columns:
        uri = F.coalesce("source_uri", uri)
    return (
        files.withColumn("checksum", identity.bytes_checksum(F.col("content")))
        .withColumn("source_uri", uri)
        .withColumn("tenant_id", F.lit(tenant))
        .withColumn("document_id", identity.document_id(F.col("tenant_id"), F.col("source_uri")))
    )


def _typed(files: DataFrame, tenant: str, base: int = 0) -> DataFrame:
    """Files with content, named and typed.

    Every file is decoded, sectioned and chunked by itself, also if another has its name: until then its key is
    the document and a number of its own, fixed when the units are staged.
    """
    number = (F.monotonically_increasing_id() + base).cast("string")
    typed = detect.detect_types(identified(files, tenant))
    return typed.withColumn("document_id", F.concat_ws("#", "document_id", number))


def _units(files: DataFrame, tenant: str, decoders: dict[str, Callable] | None, split_bytes: int) -> DataFrame:
    """Staged raw units of files with ``content`` or, where that is missing, ``path``."""
    if "content" in files.columns:
        return fs.decode_staged(_typed(files, tenant), decoders)
    short = fs.read_files(files.where(F.col("length") <= split_bytes))
    long_ = files.where(F.col("length") > split_bytes)
    heads = fs.read_files(long_, split_bytes, detect.SNIFFED_BYTES, (detect.PDF_SIGNATURE, detect.ZIP_SIGNATURE))
    # a base of their own keeps the numbers of long files apart from those of short ones
    typed = _typed(heads, tenant, 1 << 62).withColumn("checksum", F.when(~F.col("cut"), F.col("checksum")))
    split = F.col("cut") & (F.col("file_type") == "csv")
    large = stage(typed.where(split).select("document_id", "source_uri", "file_type", "path", "length"), "large")
    units = fs.decode(_typed(short, tenant), decoders).unionByName(fs.decode(typed.where(~split), decoders))
    return stage(units.unionByName(fs.csv_split_units(large, split_bytes)), "units", partition_by=["kind"])


def ingest(
    files: DataFrame,
    documents: DataFrame,
    chunks: DataFrame,
    memo: DataFrame,
    mode: str = "upload",
    tenant: str = DEFAULT_TENANT,
    max_bytes: int = MAX_FILE_BYTES,
    decoders: dict[str, Callable] | None = None,
    load=embedding.HashEncoder,
    split_bytes: int = SPLIT_BYTES,
    **packing,
) -> Ingested:
    """Run a batch of files (file_name, length, content or path, optionally source_uri) against the store:
    ``documents``, the table's ``identity.latest`` rows, ``chunks`` and ``memo``.

    Files that come by ``path``, as ``scan_folder`` lists them, are read after the size cap; CSV files of more
    than ``split_bytes`` among them are read in splits and have no checksum. Bytes are read once: everything
    after decoding works on the staged units. Chunks and fresh
    vectors are staged too, since each is used more than once.
    """
    source_type = MODES[mode]
    rejects = None
    if mode != "folder":
        # rejects are named without their bytes, which are not read
        name = F.nullif(F.col("file_name"), F.lit(""))
        name = F.coalesce("source_uri", name) if "source_uri" in files.columns else name
        _, rejects = fs.split_by_size(files.withColumn("source_uri", name), max_bytes)
        files = files.where(F.col("length") <= max_bytes)
    units = _units(files, tenant, decoders, split_bytes)
    errors = fs.unit_rejects(units)
    rejects = errors if rejects is None else rejects.unionByName(errors)

    seen = units.where(F.col("kind") == "file")
    if mode == "upload":
        seen = seen.where(F.col("file_type") != "unknown")
    arrivals = seen.select(
        F.substring_index("document_id", "#", 1).alias("document_id"),
        F.lit(tenant).alias("tenant_id"),
        "source_uri",
        F.lit(source_type).alias("source_type"),
        (F.lit(None).cast("string") if mode == "folder" else F.col("text")).alias("checksum"),
        F.substring_index("document_id", "#", -1).cast("long").alias("seq"),
    )

    # Documents registered under another id (an older scheme) keep it; usually there are none.
    known = documents.where(F.col("tenant_id") == tenant).select("source_uri", F.col("document_id").alias("_known"))
    other = (
        arrivals.select("document_id", "source_uri")
        .distinct()
        .join(known, "source_uri")
        .where(F.col("_known") != F.col("document_id"))
        .select("document_id", "_known")
    )
    sections = fs.unit_sections(units).withColumn("tenant_id", F.lit(tenant))
    parsed = chunking.chunk_sections(sections, **packing)
    parsed = stage(parsed.withColumn("document_id", F.substring_index("document_id", "#", 1)), "parsed")
    renamed = bool(other.take(1))
    if renamed:
        parsed = join_unique(parsed, other, "document_id", ["document_id", "chunk_index"])
        parsed = parsed.withColumn("document_id", F.coalesce("_known", "document_id")).drop("_known")
    if mode == "folder":
        kept = parsed.select("document_id").distinct()
        arrivals = (
            arrivals.join(known, "source_uri", "left")
            .withColumn("document_id", F.coalesce("_known", "document_id"))
            .join(kept, "document_id", "left_semi")
        )
    own = chunks.where(F.col("tenant_id") == tenant)
    fresh = stage(store.new_chunks(parsed, own, at_rest=not renamed), "fresh")
    keyed = embedding.memo_keys(fresh, "chunk_text", "passage")
    encoded = stage(embedding.encode_misses(keyed, memo, "chunk_text", "passage", load), "encoded")
    vectors = embedding.memo_near(memo, keyed.select("memo_key")).unionByName(encoded)
    embedded = join_unique(keyed, vectors, "memo_key", store.CHUNK_KEY).drop("memo_key")
    return Ingested(
        documents=identity.register(documents, arrivals.drop("document_id")),
        chunks=embedded,
        memo=encoded,
        rejects=rejects,
        report=store.chunks_stored(parsed),
    )
