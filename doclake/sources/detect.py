"""File type from bytes; the name is only a hint."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from doclake.functions.parts import in_parts
from doclake.functions.text import LINE_END
from doclake.schemas import FILE_TYPES

# File signatures and the folders that tell office archives apart.
PDF_SIGNATURE = b"%PDF-"
ZIP_SIGNATURE = b"PK\x03\x04"
SNIFFED_BYTES = 4096
SNIFFED_LINES = 5


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot; null without a dot."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1)))


def looks_like_csv(content: Column) -> Column:
    """The first 4096 bytes are strict UTF-8 and one of their first five lines has a comma."""
    sample = F.try_validate_utf8(F.substring(content, 1, SNIFFED_BYTES).cast("string"))
    lines = F.slice(F.split(sample, LINE_END, SNIFFED_LINES + 1), 1, SNIFFED_LINES)
    return F.coalesce(F.exists(lines, lambda line: F.contains(line, F.lit(","))), F.lit(False))


def _list_members(data: bytes | None) -> list[str] | None:
    if data is None:
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return archive.namelist()
    except Exception:  # whatever is odd about one archive, it has no members and the job goes on
        return None


def _members_udf():
    @F.arrow_udf("array<string>")
    def listed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for contents in columns:
            yield from in_parts(_list_members, [contents], pa.list_(pa.string()))

    return listed


def zip_members(content: Column) -> Column:
    """Member names of an archive; null for bytes that only look like one.

    Declared nondeterministic so that a filter on the type does not open archives twice.
    """
    return _members_udf().asNondeterministic()(content)


def office_type(members: Column) -> Column:
    def has(folder: str) -> Column:
        return F.exists(members, lambda m: m.startswith(folder))

    return F.when(has("word/"), "docx").when(has("xl/"), "xlsx")


def _signature(content: Column, magic: bytes) -> Column:
    return F.substring(content, 1, len(magic)) == F.lit(bytearray(magic))


def _by_name_or_text(content: Column, name: Column) -> Column:
    ext = extension(name)
    return (
        F.when(F.length(content) == 0, "unknown")
        .when(_signature(content, PDF_SIGNATURE), "pdf")
        .when(ext.isin(*FILE_TYPES), ext)
        .when(looks_like_csv(content), "csv")
        .otherwise("unknown")
    )


def detect_types(files: DataFrame, content: str = "content", name: str = "file_name") -> DataFrame:
    """Add ``file_type``: pdf, docx, xlsx, csv or unknown.

    One pass over the bytes: only the content of archives is handed to Python, other rows send null.
    """
    archive = _signature(F.col(content), ZIP_SIGNATURE)
    plain = _by_name_or_text(F.coalesce(F.col(content), F.lit(bytearray())), F.col(name))
    return (
        files.withColumn("_members", zip_members(F.when(archive, F.col(content))))
        .withColumn("file_type", F.coalesce(office_type(F.col("_members")), plain))
        .drop("_members")
    )
