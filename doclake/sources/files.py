"""Files to sections and rejects: folder scan, size cap, type routing, decoder hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from doclake.functions import network as net
from doclake.schemas import (
    MAX_FILE_BYTES,
    REASON_NO_DECODER,
    REASON_PASSWORD,
    REASON_SIZE,
    REASON_UNKNOWN,
    REASON_UNREADABLE,
    TOO_LARGE,
    UNKNOWN_FORMAT,
    UNREADABLE,
)
from doclake.session import stage
from doclake.sources import sections as sx
from doclake.sources.csv_splits import RECORDS, SPLIT_BYTES, read_splits, record_columns, whole_records
from doclake.sources.decoders import DECODERS, PasswordProtected
from doclake.sources.folder import list_folder, read_files  # noqa: F401

REJECT_COLUMNS = ["source_uri", "file_type", "reason", "message"]

# One row per page, paragraph, table cell or sheet row of a file; the columns a kind lacks are null.
UNITS = (
    "document_id string, source_uri string, file_type string, kind string, i int, j int, k int, "
    "name string, text string, cells array<string>, header array<string>"
)
UNIT_SCHEMA = pa.schema(
    [(c, pa.string()) for c in ("document_id", "source_uri", "file_type", "kind")]
    + [(c, pa.int32()) for c in "ijk"]
    + [("name", pa.string()), ("text", pa.string()), ("cells", pa.list_(pa.string())), ("header", pa.list_(pa.string()))]
)
UNIT_BATCH = 4096


def scan_folder(spark: SparkSession, folder: str, partitions: int | None = None) -> DataFrame:
    """Regular files of one folder, not of its subfolders: file_name, path, length, modificationTime.

    ``read_files`` adds their bytes; ``ingest`` does so itself, after its size cap.
    """
    return list_folder(spark, folder, partitions)


def split_by_size(files: DataFrame, limit: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files up to ``limit`` bytes, rejects); decided on ``length`` without touching the content."""
    rejects = files.where(F.col("length") > limit).select(
        "source_uri",
        F.lit(None).cast("string").alias("file_type"),
        F.lit(REASON_SIZE).alias("reason"),
        F.lit(TOO_LARGE.format(limit)).alias("message"),
    )
    return files.where(F.col("length") <= limit), rejects


def decode(typed: DataFrame, decoders: dict[str, Callable] | None = None) -> DataFrame:
    """One pass over the bytes of typed files: (document_id, source_uri, file_type, checksum, content).

    Yields for each file one ``file`` unit that carries its checksum, then the raw units of its
    decoder, or one ``error`` unit if it cannot be read. A decoder maps bytes to unit dicts; see
    ``decoders``.
    """
    table = {**DECODERS, **(decoders or {})}

    def error(reason: str, message: str) -> list[dict]:
        return [{"kind": "error", "name": reason, "text": message}]

    def units(file_type: str, content: bytes) -> list[dict]:
        if file_type == "unknown":
            return error(REASON_UNKNOWN, UNKNOWN_FORMAT)
        if file_type not in table:
            return error(REASON_NO_DECODER, f"No decoder for {file_type.upper()} was given")
        if content is None:
            return error(REASON_UNREADABLE, UNREADABLE.format(file_type.upper()))
        try:
            return list(table[file_type](bytes(content)))
        except PasswordProtected as problem:
            return error(REASON_PASSWORD, str(problem))
        except ImportError as problem:
            return error(REASON_NO_DECODER, f"No decoder for {file_type.upper()} on this worker: {problem}")
        except ValueError as problem:
            return error(REASON_UNREADABLE, str(problem))
        except Exception:
            return error(REASON_UNREADABLE, UNREADABLE.format(file_type.upper()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                content = row.pop("content")
                found = [{"kind": "file", "text": row.pop("checksum")}, *units(row["file_type"], content)]
                for begin in range(0, len(found), UNIT_BATCH):
                    part = [{**unit, **row} for unit in found[begin : begin + UNIT_BATCH]]
                    yield pa.RecordBatch.from_pylist(part, schema=UNIT_SCHEMA)

    content = F.when(F.col("file_type") != "unknown", F.col("content")).alias("content")
    return typed.select("document_id", "source_uri", "file_type", "checksum", content).mapInArrow(run, UNITS)


def unit_sections(units: DataFrame) -> DataFrame:
    """Sections of decoded units; each kind has its own builder."""
    pages = units.where(F.col("kind") == "page").select("document_id", F.col("i").alias("page_idx"), "text")
    prose = units.where(F.col("kind") == "paragraph").select(
        "document_id", F.col("i").alias("seq"), F.col("name").alias("style_name"), "text"
    )
    cells = units.where(F.col("kind") == "cell").select(
        "document_id",
        F.col("i").alias("table_idx"),
        F.col("j").alias("row_idx"),
        F.col("k").alias("col_idx"),
        "text",
    )
    rows = units.where(F.col("kind") == "row").select(
        "document_id",
        F.col("i").alias("sheet_idx"),
        F.col("name").alias("sheet_name"),
        F.col("j").alias("row_idx"),
        F.col("cells").alias("values"),
    )
    records = units.where(F.col("kind") == "record").select(
        "document_id", F.col("j").alias("position"), "header", F.col("cells").alias("values")
    )
    built = [sx.page_sections(pages), sx.block_sections(prose, cells), sx.row_sections(rows), sx.record_sections(records)]
    return reduce(DataFrame.unionByName, built)


def unit_rejects(units: DataFrame) -> DataFrame:
    return units.where(F.col("kind") == "error").select(
        "source_uri", "file_type", F.col("name").alias("reason"), F.col("text").alias("message")
    )


def decode_staged(typed: DataFrame, decoders: dict[str, Callable] | None = None) -> DataFrame:
    """``decode``, written once by kind: every later step reads its own kinds and no bytes."""
    return stage(decode(typed, decoders), "units", partition_by=["kind"])


def csv_rows(files: DataFrame) -> DataFrame:
    """(document_id, content) of CSV files to (document_id, position, header, values) of their records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for document, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for record in whole_records(content.as_py() or b""):
                    held.append((document, *record))
                    if len(held) >= UNIT_BATCH:
                        yield _record_batch(held)
                        held = []
            if held:
                yield _record_batch(held)

    return files.select("document_id", "content").mapInArrow(run, f"document_id string, {RECORDS}")


def _record_batch(held: list[tuple]) -> pa.RecordBatch:
    documents, *columns = zip(*held)
    return pa.RecordBatch.from_arrays(
        [pa.array(documents, pa.string()), *record_columns(*map(list, columns))], names=["document_id", "position", "header", "values"]
    )


def csv_sections(files: DataFrame) -> DataFrame:
    """Sections of CSV files at hand; one narrow pass, as a file's records come in order."""
    return sx.record_sections(csv_rows(files))


def csv_split_units(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``decode`` for CSV files by ``path`` (document_id, source_uri, file_type, path, length), read in splits.

    The same units as those of their bytes at hand, but that the checksum of a file is not known.
    """
    records, bad = read_splits(files, split_bytes, ("document_id", "source_uri", "file_type"))
    key = files.select("path", "document_id", "source_uri", "file_type")
    marked = key.join(bad.withColumn("bad", F.lit(True)), "path", "left")
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in files.sparkSession.createDataFrame([], UNITS).schema}

    def units(rows: DataFrame, **given: Column) -> DataFrame:
        return rows.select(*[given.get(c, F.col(c) if c in rows.columns else v).alias(c) for c, v in nothing.items()])

    message = F.lit(UNREADABLE.format("CSV"))
    parts = [
        units(key, kind=F.lit("file")),
        units(marked.where("bad"), kind=F.lit("error"), name=F.lit(REASON_UNREADABLE), text=message),
        units(records, kind=F.lit("record"), j=F.col("position"), cells=F.col("values")),
    ]
    return reduce(DataFrame.unionByName, parts)


def screen_urls(urls: DataFrame, dns: DataFrame) -> DataFrame:
    """``verdict`` per url: ok, bad_url, not_public or needs_dns.

    A host passes only if all its addresses are public. Address literals need no lookup; a host
    that ``dns`` (host, ip) does not know is held back, not admitted.
    """
    hosts = urls.withColumn("host", net.url_host(F.col("url")))
    known = dns.groupBy("host").agg(F.bool_and(F.coalesce(net.is_public_ip(F.col("ip")), F.lit(False))).alias("_all"))
    literal = net.is_public_ip(F.col("host"))
    public = F.coalesce(literal, F.col("_all"))
    return (
        hosts.join(known, "host", "left")
        .withColumn(
            "verdict",
            F.when(~net.url_admissible(F.col("url")), "bad_url")
            .when(public.isNull(), "needs_dns")
            .when(public, "ok")
            .otherwise("not_public"),
        )
        .drop("_all")
    )
