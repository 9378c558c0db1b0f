"""Decoded input to sections: pages, paragraph and table blocks, sheet rows.

Inputs are tables with one row per page, block or cell; ``SECTIONS`` in ``schemas`` is the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from doclake.functions import text as tx
from doclake.operators.ranking import BLOCK, block_of, block_offsets, dense_position


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def non_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~tx.is_blank(F.col(text)))


def page_sections(pages: DataFrame) -> DataFrame:
    """(document_id, page_idx, text) to one section per page; blank pages go, numbers stay."""
    return non_blank(pages).select(
        "document_id",
        F.col("page_idx").cast("int").alias("position"),
        "text",
        F.lit("paragraph").alias("section_type"),
        (F.col("page_idx") + 1).cast("int").alias("page_number"),
        _null("string").alias("sheet_name"),
    )


def heading_or_paragraph(style: Column) -> Column:
    return F.when(F.contains(F.lower(F.coalesce(style, F.lit(""))), F.lit("heading")), "heading").otherwise(
        "paragraph"
    )


def table_sections(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """(document_id, table_idx, row_idx, col_idx, text) to one text per table.

    Cells are trimmed and joined by ``|``, blank rows go, rows are joined by newlines. Rows are
    joined in blocks first, so that the last step sees a few long strings per table. The result is
    one string by definition and must fit a row.
    """
    table = ["document_id", "table_idx"]
    cell = F.struct("col_idx", tx.strip(F.col("text")).alias("t"))
    line = F.array_join(F.transform("_cells", lambda c: c["t"]), " | ")

    def joined(rows: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["line"]), "\n")

    return (
        cells.groupBy(*table, "row_idx")
        .agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
        .where(F.exists("_cells", lambda c: c["t"] != ""))
        .select(*table, block_of(F.col("row_idx"), block).alias("_block"), F.struct("row_idx", line.alias("line")).alias("_row"))
        .groupBy(*table, "_block")
        .agg(joined("_row").alias("line"))
        .select(*table, F.struct("_block", "line").alias("_part"))
        .groupBy(*table)
        .agg(joined("_part").alias("text"))
    )


def block_sections(paragraphs: DataFrame, cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Paragraphs (document_id, seq, style_name, text) first, then tables, numbered without gaps."""
    prose = non_blank(paragraphs).select(
        "document_id",
        F.lit(0).alias("_kind"),
        F.col("seq").cast("int").alias("_seq"),
        tx.strip(F.col("text")).alias("text"),
        heading_or_paragraph(F.col("style_name")).alias("section_type"),
    )
    tables = table_sections(cells, block).select(
        "document_id",
        F.lit(1).alias("_kind"),
        F.col("table_idx").cast("int").alias("_seq"),
        "text",
        F.lit("table").alias("section_type"),
    )
    return dense_position(
        prose.unionByName(tables), ["document_id"], ["_kind", "_seq"], "position", block
    ).select(
        "document_id",
        "position",
        "text",
        "section_type",
        _null("int").alias("page_number"),
        _null("string").alias("sheet_name"),
    )


def pair_row(header: Column, values: Column) -> Column:
    """``name: value`` pairs joined by ``; ``. Blank names are skipped; without any, values are joined.

    The longer side is cut to the shorter one; empty values stay.
    """
    width = F.least(F.size(header), F.size(values))
    zipped = F.arrays_zip(F.slice(header, 1, width).alias("h"), F.slice(values, 1, width).alias("v"))
    named = F.filter(zipped, lambda p: ~tx.is_blank(p["h"]))
    pairs = F.transform(named, lambda p: F.concat(p["h"], F.lit(": "), p["v"]))
    return F.when(F.size(pairs) > 0, F.array_join(pairs, "; ")).otherwise(F.array_join(values, "; "))


def has_value(values: Column) -> Column:
    return F.exists(values, lambda v: ~tx.is_blank(v))


def row_sections(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(document_id, sheet_idx, sheet_name, row_idx, values array) to one section per data row.

    Row 0 of a sheet is its header. Numbering and headers meet the rows by (sheet, block of rows),
    with one copy of the header per block, so a very long sheet spreads over tasks.
    """
    sheet = ["document_id", "sheet_idx"]
    part = block_of(F.col("row_idx"), block)
    data = rows.where((F.col("row_idx") > 0) & has_value(F.col("values")))
    last = rows.groupBy(*sheet).agg(
        block_of(F.max("row_idx"), block).alias("_last"),
        F.first(F.when(F.col("row_idx") == 0, F.col("values")), ignorenulls=True).alias("_header"),
    )
    headers = last.select(*sheet, "_header", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("_block"))
    offsets = block_offsets(data, ["document_id"], ["sheet_idx", "row_idx"], F.lit(1), block)
    group = [*sheet, "_block"]
    inside = Window.partitionBy(*group).orderBy("row_idx")
    return (
        data.withColumn("_block", part)
        .join(headers.join(offsets, group), group)
        .withColumn("position", (F.col("_offset") + F.row_number().over(inside) - 1).cast("int"))
        .withColumn("_header", F.coalesce("_header", F.array().cast("array<string>")))
        .select(
            "document_id",
            "position",
            pair_row(F.col("_header"), F.col("values")).alias("text"),
            F.lit("row").alias("section_type"),
            _null("int").alias("page_number"),
            "sheet_name",
        )
    )


def record_sections(records: DataFrame) -> DataFrame:
    """(document_id, position, header, values) of records in order, blank ones left out, to a section each."""
    return records.select(
        "document_id",
        "position",
        pair_row(F.coalesce("header", F.array().cast("array<string>")), F.col("values")).alias("text"),
        F.lit("row").alias("section_type"),
        _null("int").alias("page_number"),
        _null("string").alias("sheet_name"),
    )


def sheet_rows(cells: DataFrame) -> DataFrame:
    """(document_id, sheet_idx, sheet_name, row_idx, col_idx, value) to value arrays up to the row's last
    cell; null and absent cells are ``""``; of cells given twice the smaller value counts."""
    value = F.coalesce(F.col("value").cast("string"), F.lit("")).alias("v")
    return (
        cells.groupBy("document_id", "sheet_idx", "sheet_name", "row_idx")
        .agg(F.array_sort(F.collect_list(F.struct("col_idx", value))).alias("_sorted"))
        .withColumn(
            "_cells",
            F.map_from_entries(
                F.filter("_sorted", lambda c, i: (i == 0) | (c["col_idx"] != F.get("_sorted", i - 1)["col_idx"]))
            ),
        )
        .select(
            "document_id",
            "sheet_idx",
            "sheet_name",
            "row_idx",
            F.transform(
                F.sequence(F.lit(0), F.array_max(F.map_keys("_cells"))),
                lambda i: F.coalesce(F.col("_cells")[i], F.lit("")),
            ).alias("values"),
        )
    )


def sheet_sections(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    return row_sections(sheet_rows(cells), block)
