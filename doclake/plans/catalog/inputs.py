"""Queries on files, urls and sections. File bytes are built from the given tables."""

from __future__ import annotations

import io
import time
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from doclake.functions import network as net
from doclake.functions.parts import in_parts
from doclake.operators import identity
from doclake.plans.catalog.base import LINE_PAGES, line_pages, query, sql_strip, table, turns
from doclake.session import scratch_dir
from doclake.sources import detect, files as fs, sections as sx
from doclake.sources.folder import FolderStream, write_files

LAG_SECONDS = FolderStream.LAG / 1e6 + 0.1

# --- files made of documents: the language decides the disguise ---

FILES = """
    SELECT doc_id, CASE lang WHEN 'en' THEN 'report.' || source || '.PDF' WHEN 'fr' THEN 'notes' WHEN 'de' THEN 'table.csv' ELSE source || '.txt' END AS file_name,
           CASE WHEN lang = 'en' AND source = 'src1' THEN encode('%PDF-1.4' || chr(10) || text)
                WHEN source = 'src2' THEN 'PK\\x03\\x04'::BLOB || encode(text)
                WHEN source = 'src3' THEN ''::BLOB
                WHEN source = 'src4' THEN '\\xFF\\xFE'::BLOB || encode(text)
                ELSE encode(text) END AS content
    FROM documents"""


def _files(spark, sf):
    content = F.encode("text", "UTF-8")
    disguised = (
        F.when((F.col("lang") == "en") & (F.col("source") == "src1"), F.encode(F.concat(F.lit("%PDF-1.4\n"), "text"), "UTF-8"))
        .when(F.col("source") == "src2", F.concat(F.lit(bytearray(b"PK\x03\x04")), content))
        .when(F.col("source") == "src3", F.lit(bytearray()))
        .when(F.col("source") == "src4", F.concat(F.lit(bytearray(b"\xff\xfe")), content))
        .otherwise(content)
    )
    name = (
        F.when(F.col("lang") == "en", F.concat(F.lit("report."), "source", F.lit(".PDF")))
        .when(F.col("lang") == "fr", "notes")
        .when(F.col("lang") == "de", "table.csv")
        .otherwise(F.concat("source", F.lit(".txt")))
    )
    return table(spark, sf, "documents").select("doc_id", name.alias("file_name"), disguised.alias("content"))


EXTENSION = "CASE WHEN file_name LIKE '%.%' THEN lower(regexp_extract(file_name, '[^.]*$')) END"
SNIFF = r"coalesce(regexp_matches(try(decode(array_slice(content, 1, 4096))), '^(?:[^\n]*\n){0,4}[^\n]*,'), false)"
TYPE = f"""CASE WHEN octet_length(content) = 0 THEN 'unknown'
    WHEN array_slice(content, 1, 5) = '%PDF-'::BLOB THEN 'pdf'
    WHEN {EXTENSION} IN ('pdf', 'docx', 'xlsx', 'csv') THEN {EXTENSION}
    WHEN {SNIFF} THEN 'csv' ELSE 'unknown' END"""


@query(f"SELECT doc_id, file_name, {TYPE} AS file_type FROM ({FILES})")
def detect_type(spark, sf):
    return detect.detect_types(_files(spark, sf)).select("doc_id", "file_name", "file_type")


@query(f"SELECT doc_id, file_name, {EXTENSION} AS extension FROM ({FILES})")
def file_ext(spark, sf):
    return _files(spark, sf).select("doc_id", "file_name", detect.extension(F.col("file_name")).alias("extension"))


@query(
    f"""SELECT doc_id, {SNIFF} AS is_csv FROM ({FILES})"""
)
def csv_sniff(spark, sf):
    return _files(spark, sf).select("doc_id", detect.looks_like_csv(F.col("content")).alias("is_csv"))


@query(
    """SELECT doc_id, octet_length(encode(text)) AS length, octet_length(encode(text)) > 8000 AS rejected FROM documents"""
)
def size_cap(spark, sf):
    """Documents against a cap of 8,000 bytes."""
    files = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("source_uri"), F.octet_length("text").cast("bigint").alias("length")
    )
    kept, rejects = fs.split_by_size(files, 8000)
    lengths = files.select("source_uri", "length")
    marked = kept.select("source_uri", F.lit(False).alias("rejected")).unionByName(
        rejects.select("source_uri", F.lit(True).alias("rejected"))
    )
    return marked.join(lengths, "source_uri").select(F.col("source_uri").cast("bigint").alias("doc_id"), "length", "rejected")


HIDDEN_NAME = """CASE lang WHEN 'en' THEN '_' || doc_id WHEN 'fr' THEN '.' || doc_id WHEN 'de' THEN '.' || doc_id || '.crc'
    ELSE doc_id || '.txt' END"""


@query(f"SELECT {HIDDEN_NAME} AS file_name, octet_length(encode(text))::BIGINT AS length, sha256(text) AS checksum FROM documents")
def scan_folder(spark, sf):
    """Documents written as files, three languages under names that Spark's readers pass over, and scanned."""
    key = F.col("doc_id").cast("string")
    name = (
        F.when(F.col("lang") == "en", F.concat(F.lit("_"), key))
        .when(F.col("lang") == "fr", F.concat(F.lit("."), key))
        .when(F.col("lang") == "de", F.concat(F.lit("."), key, F.lit(".crc")))
        .otherwise(F.concat(key, F.lit(".txt")))
    )
    folder = f"{scratch_dir(spark)}/folder-{uuid.uuid4().hex}"
    write_files(table(spark, sf, "documents").select(name.alias("file_name"), F.encode("text", "UTF-8").alias("content")), folder)
    return fs.read_files(fs.scan_folder(spark, folder)).select(
        "file_name", "length", identity.bytes_checksum(F.col("content")).alias("checksum")
    )


@query(
    """SELECT doc_id || '.txt' AS file_name, 0 AS batch, sha256(text) AS checksum FROM documents
    UNION ALL
    SELECT doc_id || '.txt', 1, sha256(text || '.') FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
)
def stream_changes(spark, sf):
    """Documents written as files and streamed; then toxic ones edited, good ones written again as they were, and a
    second trigger that fails after its write and is run again. Every file comes once for each of its contents."""
    from doclake.streaming.ingest import each_batch, file_stream

    place = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    local = place.removeprefix("file://") if place.startswith("file://") else place
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), "text"
    )
    labels = table(spark, sf, "labels").select("doc_id", "toxic", "quality")
    again = docs.join(labels.where("toxic = 1 OR quality = 1"), "doc_id")
    edited = F.when(F.col("toxic") == 1, F.concat("text", F.lit("."))).otherwise(F.col("text"))

    def trigger(fails: bool) -> None:
        def save(batch, number):
            rows = batch.select("file_name", F.lit(number).alias("batch"), "checksum")
            rows.write.mode("overwrite").parquet(f"{place}/out/{number}")
            if fails and number == 1:
                raise RuntimeError("stopped after the write")

        each_batch(file_stream(spark, f"{place}/in"), save, f"{local}/state").awaitTermination()

    write_files(docs.select("file_name", F.encode("text", "UTF-8").alias("content")), f"{place}/in")
    time.sleep(LAG_SECONDS)
    trigger(False)
    write_files(again.select("file_name", F.encode(edited, "UTF-8").alias("content")), f"{place}/in")
    time.sleep(LAG_SECONDS)
    try:
        trigger(True)
    except StreamingQueryException:
        trigger(False)
    return spark.read.schema("file_name string, batch int, checksum string").parquet(f"{place}/out/*")


def _zipped(member: str, text: str) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(member, text)
        archive.writestr("[Content_Types].xml", "<Types/>")
    return buffer.getvalue()


def _zip_udf():
    @F.arrow_udf("binary")
    def zipped(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for members, texts in columns:
            yield from in_parts(_zipped, [members, texts], pa.binary())

    return zipped


@query(
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'docx' WHEN 'fr' THEN 'xlsx' ELSE 'csv' END AS file_type FROM documents"""
)
def detect_office(spark, sf):
    """Documents zipped under a member folder of their language; the file name always says csv."""
    member = (
        F.when(F.col("lang") == "en", "word/document.xml").when(F.col("lang") == "fr", "xl/workbook.xml").otherwise("ppt/slide.xml")
    )
    files = table(spark, sf, "documents").select(
        "doc_id", F.lit("claims.csv").alias("file_name"), _zip_udf()(member, "text").alias("content")
    )
    return detect.detect_types(files).select("doc_id", "file_type")


# --- CSV files, one per order ---

LINES = """
    SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line,
           l_partkey, l_suppkey, l_returnflag FROM lineitem"""


def _order_csv(spark, sf):
    """One CSV file per order: a handful of lines each. Quoted cells hold a comma and a quote."""
    line = F.concat_ws(
        ",",
        F.col("l_linenumber").cast("string"),
        F.concat(F.lit('"part '), F.col("l_partkey").cast("string"), F.lit(', ""'), "l_returnflag", F.lit('"""')),
        F.col("l_suppkey").cast("string"),
        F.lit(""),
    )
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))
    header = F.lit("line,item,,note\n")
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(entry)).alias("_lines"))
        .select(
            F.col("l_orderkey").cast("string").alias("document_id"),
            F.encode(F.concat(header, F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")), "UTF-8").alias("content"),
        )
    )


@query(
    f"""SELECT l_orderkey::VARCHAR AS document_id, (line - 1)::INT AS position, 'row' AS section_type,
           'line: ' || l_linenumber || '; item: part ' || l_partkey || ', "' || l_returnflag || '"; note: ' AS text
    FROM ({LINES})"""
)
def csv_rows(spark, sf):
    return fs.csv_sections(_order_csv(spark, sf)).select("document_id", "position", "section_type", "text")


LONG_LINES = """
    SELECT l_orderkey // 2000 AS file, row_number() OVER (PARTITION BY l_orderkey // 2000 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line,
           l_linenumber, l_partkey, l_returnflag FROM lineitem"""


@query(
    f"""SELECT file || '.csv' AS source_uri, (line - 1)::INT AS position,
           'line: ' || l_linenumber || '; item: part ' || l_partkey || ',' || chr(10) || chr(10) || 'flag "' || l_returnflag || '"; note: ' AS text
    FROM ({LONG_LINES})"""
)
def csv_splits(spark, sf):
    """Files of 2,000 orders each, with line breaks, commas and quotes in cells, and blank lines between records; read
    in splits of 64 KB."""
    line = F.concat(
        F.col("l_linenumber").cast("string"),
        F.lit(',"part '), F.col("l_partkey").cast("string"), F.lit(',\n\nflag ""'), F.col("l_returnflag"), F.lit('""",'),
        F.col("l_suppkey").cast("string"), F.lit(",\n,,\n"),
    )
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))
    contents = (
        table(spark, sf, "lineitem")
        .groupBy(F.call_function("div", F.col("l_orderkey"), F.lit(2000)).cast("string").alias("file"))
        .agg(F.array_sort(F.collect_list(order)).alias("lines"))
        .select(
            F.concat("file", F.lit(".csv")).alias("file_name"),
            F.encode(
                F.concat(F.lit("line,item,,note\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "")), "UTF-8"
            ).alias("content"),
        )
    )
    folder = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_files(contents, folder)
    name = F.col("file_name")
    listed = fs.scan_folder(spark, folder).select(
        "path", "length", name.alias("document_id"), name.alias("source_uri"), F.lit("csv").alias("file_type")
    )
    units = fs.csv_split_units(listed, 1 << 16).where("kind = 'record'")
    sections = sx.record_sections(units.select("document_id", F.col("j").alias("position"), "header", F.col("cells").alias("values")))
    return sections.select(F.col("document_id").alias("source_uri"), "position", "text")


# --- sheets made of customer, part and supplier ---


def _cells(df, document, sheet_idx, sheet, key, columns):
    """One cell per (row, column): row 0 holds the names, data rows follow by key."""
    names = F.array(*[F.struct(F.lit(i).alias("col_idx"), F.lit(n).alias("value")) for i, (n, _) in enumerate(columns)])
    values = F.array(
        *[F.struct(F.lit(i).alias("col_idx"), F.col(c).cast("string").alias("value")) for i, (_, c) in enumerate(columns)]
    )
    place = [F.lit(document).alias("document_id"), F.lit(sheet_idx).alias("sheet_idx"), F.lit(sheet).alias("sheet_name")]
    header = df.sparkSession.range(1).select(*place, F.lit(0).alias("row_idx"), F.inline(names))
    body = df.select(*place, (F.col(key) + 1).cast("int").alias("row_idx"), F.inline(values))
    return header.unionByName(body)


@query(
    """SELECT 'book' AS document_id, 'Customers' AS sheet_name, c_custkey::INT AS position, 'Name: ' || c_name || '; Segment: ' || c_mktsegment || '; Nation: ' || c_nationkey AS text FROM customer
    UNION ALL SELECT 'book', 'Parts', (p_partkey + (SELECT count(*) FROM customer))::INT, 'Part: ' || p_name || '; Size: ' || p_size FROM part
    UNION ALL SELECT 'stock', 'Suppliers', s_suppkey::INT, s_name || '; ' || s_nationkey FROM supplier"""
)
def sheet_rows(spark, sf):
    """Two workbooks; a part's brand has a blank header, and suppliers have no usable header at all."""
    customers = _cells(
        table(spark, sf, "customer"), "book", 0, "Customers", "c_custkey",
        [("Name", "c_name"), ("Segment", "c_mktsegment"), ("Nation", "c_nationkey")],
    )
    parts = _cells(
        table(spark, sf, "part"), "book", 1, "Parts", "p_partkey", [("Part", "p_name"), (" ", "p_brand"), ("Size", "p_size")]
    )
    suppliers = _cells(
        table(spark, sf, "supplier"), "stock", 0, "Suppliers", "s_suppkey", [("", "s_name"), (" ", "s_nationkey")]
    )
    cells = customers.unionByName(parts).unionByName(suppliers)
    return sx.sheet_sections(cells, block=256).select("document_id", "sheet_name", "position", "text")


@query(
    """SELECT c_custkey, 'Name: ' || c_name || '; Segment: ' || c_mktsegment AS full_row, c_name || '; ' || c_mktsegment AS no_header,
           'Name: ' || c_name AS short_header, 'Name: ' || c_name || '; Empty: ' AS empty_value FROM customer"""
)
def row_pairing(spark, sf):
    def header(*names):
        return F.array(*[F.lit(n) for n in names])

    pair = F.array("c_name", "c_mktsegment")
    return table(spark, sf, "customer").select(
        "c_custkey",
        sx.pair_row(header("Name", "Segment"), pair).alias("full_row"),
        sx.pair_row(header("", " "), pair).alias("no_header"),
        sx.pair_row(header("Name"), pair).alias("short_header"),
        sx.pair_row(header("Name", "Empty", "More"), F.array(F.col("c_name"), F.lit(""))).alias("empty_value"),
    )


# --- blocks made of conversations and orders ---


def _order_cells(spark, sf):
    """A table per customer, a row per order: key, status, priority."""
    cells = F.array(
        F.struct(F.lit(0).alias("col_idx"), F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("text")),
        F.struct(F.lit(1).alias("col_idx"), F.concat("o_orderstatus", F.lit("\n")).alias("text")),
        F.struct(F.lit(2).alias("col_idx"), F.col("o_orderpriority").alias("text")),
    )
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("document_id"),
        F.lit(0).alias("table_idx"),
        F.col("o_orderkey").alias("row_idx"),
        F.inline(cells),
    )


ORDER_TABLES = """
    SELECT o_custkey AS conv_id, string_agg(o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS text
    FROM orders GROUP BY o_custkey"""


@query(f"SELECT conv_id::VARCHAR AS document_id, 0 AS table_idx, text FROM ({ORDER_TABLES})")
def table_section(spark, sf):
    return sx.table_sections(_order_cells(spark, sf))


@query(
    f"""WITH blocks AS (
        SELECT conv_id, 0 AS kind, turn AS seq, {sql_strip('text')} AS text,
               CASE role WHEN 'system' THEN 'heading' ELSE 'paragraph' END AS section_type FROM conversations
        WHERE {sql_strip('text')} <> ''
        UNION ALL
        SELECT conv_id, 1, 0, text, 'table' FROM ({ORDER_TABLES}))
    SELECT conv_id::VARCHAR AS document_id, (row_number() OVER (PARTITION BY conv_id ORDER BY kind, seq) - 1)::INT AS position,
           text, section_type FROM blocks"""
)
def block_sections(spark, sf):
    """Conversations as prose, a system turn as heading; the tables of the same ids follow."""
    prose = turns(spark, sf).select(
        F.col("conv_id").cast("string").alias("document_id"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "system", "Heading 1").otherwise("Normal").alias("style_name"),
        "text",
    )
    return sx.block_sections(prose, _order_cells(spark, sf)).select("document_id", "position", "text", "section_type")


@query(
    f"""SELECT document_id, page_idx::INT AS position, text, (page_idx + 1)::INT AS page_number, 'paragraph' AS section_type
    FROM ({LINE_PAGES}) WHERE {sql_strip('text')} <> ''"""
)
def page_sections(spark, sf):
    return sx.page_sections(line_pages(spark, sf)).select("document_id", "position", "text", "page_number", "section_type")


PARTS_OF_HTML = r"SELECT page_id, i::INT AS i, p[i] AS text FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT page_id, regexp_split_to_array(html, '<[^>]*>') AS p FROM pages))"


@query(f"SELECT page_id, i, text FROM ({PARTS_OF_HTML}) WHERE {sql_strip('text')} <> ''")
def nonblank(spark, sf):
    """Text between tags of raw pages, where much is blank."""
    parts = table(spark, sf, "pages").select("page_id", F.posexplode(F.split("html", "<[^>]*>")).alias("i", "text"))
    return sx.non_blank(parts.withColumn("i", F.col("i") + 1))


# --- rejects ---


@query(
    f"""SELECT coalesce(t, 'unknown') AS file_type, coalesce(reason, 'ok') AS reason, count(*) AS files FROM (
        SELECT {TYPE} AS t, CASE {TYPE} WHEN 'unknown' THEN 'unknown_format' WHEN 'pdf' THEN CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'password_protected' END
               END AS reason FROM ({FILES})) GROUP BY ALL"""
)
def route_rejects(spark, sf):
    """Files through detection and decoding; PDFs of toxic documents are locked."""
    from doclake.sources.decoders import PasswordProtected

    def pdf(data: bytes):
        if data.startswith(b"LOCK"):
            raise PasswordProtected()
        return [{"kind": "page", "i": 0, "text": data.decode("utf-8", "replace")}]

    toxic = table(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id", F.lit(True).alias("_locked"))
    typed = detect.detect_types(_files(spark, sf)).join(toxic, "doc_id", "left")
    locked = F.coalesce("_locked", F.lit(False)) & (F.col("file_type") == "pdf")
    typed = typed.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("doc_id").cast("string").alias("source_uri"),
        "file_type",
        identity.bytes_checksum(F.col("content")).alias("checksum"),
        F.when(locked, F.encode(F.lit("LOCK"), "UTF-8")).otherwise(F.col("content")).alias("content"),
    )
    units = fs.decode_staged(typed, {"pdf": pdf})
    outcome = units.where(F.col("kind") == "file").join(
        fs.unit_rejects(units).select("source_uri", "reason"), "source_uri", "left"
    )
    return outcome.groupBy("file_type", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("files"))


# --- urls ---

HOST = r"nullif(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '')"


#: Urls that browsers accept and strict parsers refuse: pattern and replacement.
ODD_URLS = {
    "underscore": ("^(https?://)", r"\1a_b."),
    "umlaut": ("^(https?://)", r"\1bü."),
    "user": ("^(https?://)", r"\1me:secret@"),
    "port": ("^(https?://[^/?#]+)", r"\1:8080"),
    "space": ("^(https?://[^/?#]+)", r"\1/a b.pdf"),
    "bracket": ("^(https?://[^/?#]+)", r"\1/r[1].pdf"),
    "percent": ("^(https?://[^/?#]+)", r"\1/100%.pdf"),
}
SQL_ODD = " ".join(
    f"UNION ALL SELECT page_id, '{name}', regexp_replace(url, '{pattern}', '{new}') FROM pages"
    for name, (pattern, new) in ODD_URLS.items()
)


def _variants(spark, sf):
    """Page urls as they are, with other schemes, without a host, and with odd but valid parts."""
    url = F.col("url")

    def variant(name, changed):
        return F.struct(F.lit(name).alias("variant"), changed.alias("url"))

    made = F.array(
        variant("plain", url),
        variant("ftp", F.regexp_replace(url, "^https?", "ftp")),
        variant("upper", F.regexp_replace(url, "^https?", "HTTP")),
        variant("file", F.regexp_replace(url, "^https?://[^/]*", "file://")),
        variant("no_host", F.regexp_replace(url, "^(https?://)[^/]*", "$1")),
        *[variant(name, F.regexp_replace(url, pattern, new.replace("\\1", "$1"))) for name, (pattern, new) in ODD_URLS.items()],
    )
    return table(spark, sf, "pages").select("page_id", F.inline(made))


@query(
    rf"""SELECT page_id, variant, url, variant NOT IN ('ftp', 'upper', 'file', 'no_host') AS admissible FROM (
        SELECT page_id, 'plain' AS variant, url FROM pages
        UNION ALL SELECT page_id, 'ftp', regexp_replace(url, '^https?', 'ftp') FROM pages
        UNION ALL SELECT page_id, 'upper', regexp_replace(url, '^https?', 'HTTP') FROM pages
        UNION ALL SELECT page_id, 'file', regexp_replace(url, '^https?://[^/]*', 'file://') FROM pages
        UNION ALL SELECT page_id, 'no_host', regexp_replace(url, '^(https?://)[^/]*', '\1') FROM pages {SQL_ODD})"""
)
def url_admissible(spark, sf):
    return _variants(spark, sf).select("page_id", "variant", "url", net.url_admissible(F.col("url")).alias("admissible"))


@query(
    rf"""SELECT page_id, variant, nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(?:/[^/?#]*)*?/([^/?#]*)(?:[?#].*)?$', 1), '') AS file_name
    FROM (SELECT page_id, 'plain' AS variant, url FROM pages {SQL_ODD})"""
)
def url_basename(spark, sf):
    odd = _variants(spark, sf).where(F.col("variant").isin("plain", *ODD_URLS))
    return odd.select("page_id", "variant", net.url_basename(F.col("url")).alias("file_name"))


@query(
    """SELECT doc_id, CASE WHEN source IN ('src5', 'src6') THEN 'upload-' || substr(sha256(text), 1, 12) ELSE source || '.txt' END AS source_uri
    FROM documents"""
)
def upload_uri(spark, sf):
    """Uploads whose name is missing or empty for two of the sources."""
    name = F.when(F.col("source") == "src5", "").when(F.col("source") == "src6", F.lit(None)).otherwise(
        F.concat("source", F.lit(".txt"))
    )
    return table(spark, sf, "documents").select(
        "doc_id", identity.upload_uri(name, F.encode("text", "UTF-8")).alias("source_uri")
    )


def _dns(spark, sf):
    """Two addresses per host, taken from the hash of its name; hosts starting with ``m.`` are unknown."""
    hosts = table(spark, sf, "pages").select(net.url_host(F.col("url")).alias("host")).distinct()
    digest = F.md5("host")

    def address(begin):
        octets = [F.conv(F.substring(digest, begin + 2 * i, 2), 16, 10) for i in range(4)]
        return F.concat_ws(".", *octets)

    return hosts.where(~F.col("host").startswith("m.")).select("host", F.explode(F.array(address(1), address(9))).alias("ip"))


def _sql_blocked() -> str:
    ranges = " OR ".join(f"h BETWEEN '{low}' AND '{high}'" for low, high in net.BLOCKED_V4)
    return f"({ranges})"


@query(
    f"""WITH hosts AS (SELECT page_id, url, {HOST} AS host FROM pages),
    dns AS (SELECT host, unnest([substr(md5(host), 1, 8), substr(md5(host), 9, 8)]) AS h FROM (SELECT DISTINCT host FROM hosts) WHERE host NOT LIKE 'm.%'),
    known AS (SELECT host, bool_and(NOT {_sql_blocked()}) AS public FROM dns GROUP BY host)
    SELECT page_id, host, CASE WHEN public IS NULL THEN 'needs_dns' WHEN public THEN 'ok' ELSE 'not_public' END AS verdict
    FROM hosts LEFT JOIN known USING (host)"""
)
def url_public_ip(spark, sf):
    screened = fs.screen_urls(table(spark, sf, "pages").select("page_id", "url"), _dns(spark, sf))
    return screened.select("page_id", "host", "verdict")
