"""Registry of named queries, the tables they derive from the given ones, and SQL snippets.

Every query reads whole tables. The SQL text is for the checking engine and is built from the same
fixed values as the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from doclake.functions import text as tx
from doclake.functions.text import WHITESPACE
from doclake.operators import identity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register the function under its name, with the SQL that must give the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- derived tables ---


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as a document table: uri ``doc://<id>``, the language as tenant."""
    uri = F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(
        "doc_id",
        identity.document_id(F.col("lang"), uri).alias("document_id"),
        F.col("lang").alias("tenant_id"),
        F.lit("url").alias("source_type"),
        uri.alias("source_uri"),
        tx.sha256_text(F.col("text")).alias("checksum"),
        F.lit(None).cast("timestamp").alias("created_at"),
        "text",
        "source",
    )


REGISTRY = """
    SELECT doc_id, md5(lang || ':doc://' || doc_id) AS document_id, lang AS tenant_id, 'url' AS source_type,
           'doc://' || doc_id AS source_uri, sha256(text) AS checksum, text, source
    FROM documents"""


def reviewed(spark: SparkSession, sf: str) -> DataFrame:
    """Registry rows with a label: they play the part of what was stored before."""
    return registry(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


REVIEWED = f"SELECT * FROM ({REGISTRY}) WHERE doc_id IN (SELECT doc_id FROM labels)"


def line_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of a document as one decoded page."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.posexplode(F.split("text", "\n")).alias("page_idx", "text"),
    )


LINE_PAGES = """
    SELECT doc_id::VARCHAR AS document_id, i - 1 AS page_idx, lines[i] AS text
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
          FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"""


def line_sections(spark: SparkSession, sf: str) -> DataFrame:
    from doclake.sources.sections import page_sections

    return page_sections(line_pages(spark, sf)).withColumn("tenant_id", F.lit("default"))


def whole_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a single section on page 1."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.lit("default").alias("tenant_id"),
        F.lit(0).alias("position"),
        "text",
        F.lit("paragraph").alias("section_type"),
        F.lit(1).alias("page_number"),
        F.lit(None).cast("string").alias("sheet_name"),
    )


def source_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as chunks of 20 documents (their sources): repeats inside a source are duplicates."""
    return table(spark, sf, "documents").select(
        F.col("source").alias("document_id"),
        F.col("lang").alias("tenant_id"),
        F.col("doc_id").cast("int").alias("chunk_index"),
        F.col("text").alias("chunk_text"),
        tx.sha256_text(F.col("text")).alias("text_hash"),
        "doc_id",
    )


SOURCE_CHUNKS = """
    SELECT source AS document_id, lang AS tenant_id, doc_id::INT AS chunk_index, text AS chunk_text,
           sha256(text) AS text_hash, doc_id
    FROM documents"""


def stored_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled part of ``source_chunks``, deduplicated: an existing store."""
    from doclake.operators.store import first_occurrences

    labelled = table(spark, sf, "labels").select("doc_id")
    return first_occurrences(source_chunks(spark, sf).join(labelled, "doc_id", "left_semi"))


STORED_CHUNKS = f"""
    SELECT * FROM ({SOURCE_CHUNKS}) WHERE doc_id IN (SELECT doc_id FROM labels)
    QUALIFY row_number() OVER (PARTITION BY document_id, text_hash ORDER BY chunk_index) = 1"""


def legacy_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A chunk table from before documents had ids: labelled rows carry a chunk index, others none."""
    labels = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("_labelled"))
    return (
        table(spark, sf, "documents")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("document_name"),
            F.col("text").alias("chunk_text"),
            tx.sha256_text(F.col("text")).alias("text_hash"),
            F.lit(None).cast("string").alias("document_id"),
            F.when(F.col("_labelled"), F.col("doc_id").cast("int")).alias("chunk_index"),
        )
    )


LEGACY_CHUNKS = """
    SELECT d.doc_id AS id, d.source AS document_name, d.text AS chunk_text, sha256(d.text) AS text_hash,
           NULL::VARCHAR AS document_id, CASE WHEN l.doc_id IS NOT NULL THEN d.doc_id::INT END AS chunk_index
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns with all turns before them, in order, as context; those that open a conversation have none
    and are left out. A context is as long as its conversation so far by definition."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns(spark, sf).withColumn("before", F.collect_list("text").over(before))
    rows = rows.where((F.col("role") == "assistant") & (F.size("before") > 0))
    return rows.withColumn("context", F.array_join("before", "\n")).drop("before")


REPLIES = """
    SELECT * FROM (
        SELECT *, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context
        FROM conversations)
    WHERE role = 'assistant' AND context IS NOT NULL"""

# --- SQL snippets ---

TOKEN_SQL = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def sql_strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def sql_raw_tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOKEN_SQL}'))"


def sql_tokens(x: str) -> str:
    return f"({sql_raw_tokens(x)} + 2)"


def sql_pieces(x: str, name: str) -> str:
    return f"list_filter(list_transform({x}, lambda {name}: {sql_strip(name)}), lambda {name}: {name} <> '')"


def sql_paragraphs(x: str) -> str:
    return sql_pieces(rf"regexp_split_to_array({x}, '\n{{2,}}')", "p")


def sql_sentences(x: str) -> str:
    marked = r"string_split(regexp_replace(q, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"flatten(list_transform({sql_paragraphs(x)}, lambda q: {sql_pieces(marked, 's')}))"


def sql_units(x: str, budget: int) -> str:
    words = r"list_filter(regexp_split_to_array(u, '\s+'), lambda w: w <> '')"
    return (
        f"flatten(list_transform({sql_sentences(x)}, "
        f"lambda u: CASE WHEN {sql_tokens('u')} > {budget} THEN {words} ELSE [u] END))"
    )


def sql_tail(x: str, overlap: int) -> str:
    pieces = rf"regexp_extract_all({x}, '({TOKEN_SQL})\s*')"
    return f"rtrim(array_to_string(list_slice({pieces}, -{overlap}, -1), ''), ' ' || chr(10))"


def sql_pack(units: str, budget: int, overlap: int) -> str:
    """Chunks of a list of units, as a fold over (done, open chunk, its tokens)."""
    tail = sql_tail("a.cur", overlap)
    restart = f"concat_ws(' ', {tail}, x.cur)" if overlap else "x.cur"
    restart_n = f"({sql_raw_tokens(tail)} + x.n)" if overlap else "x.n"
    fold = f"""list_reduce(
        list_prepend({{'o': []::VARCHAR[], 'cur': '', 'n': 0::BIGINT}},
            list_transform({units}, lambda v: {{'o': []::VARCHAR[], 'cur': v, 'n': {sql_tokens('v')}::BIGINT}})),
        lambda a, x: CASE WHEN a.n + x.n > {budget}
            THEN {{'o': CASE WHEN a.cur = '' THEN a.o ELSE list_append(a.o, a.cur) END,
                   'cur': CASE WHEN a.cur = '' THEN x.cur ELSE {restart} END,
                   'n': CASE WHEN a.cur = '' THEN x.n ELSE {restart_n} END}}
            ELSE {{'o': a.o, 'cur': CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || ' ' || x.cur END,
                   'n': a.n + x.n}} END)"""
    return fold


def sql_chunks(source: str, key: str, budget: int, overlap: int, least: int = 10, text: str = "text") -> str:
    """``key`` columns and ``chunks`` of every row of ``source``."""
    return f"""
    SELECT {key}, CASE WHEN len(c) > 1 AND len(list_filter(c, lambda k: {sql_tokens('k')} >= {least})) > 0
                       THEN list_filter(c, lambda k: {sql_tokens('k')} >= {least}) ELSE c END AS chunks
    FROM (SELECT {key}, CASE WHEN f.cur = '' THEN f.o ELSE list_append(f.o, f.cur) END AS c
          FROM (SELECT {key}, {sql_pack(sql_units(text, budget), budget, overlap)} AS f FROM ({source})))"""


def sql_exploded(chunked: str, key: str) -> str:
    """``key``, ``pos`` (from 0) and ``chunk_text`` of a table with ``chunks``."""
    return f"""
    SELECT {key}, i - 1 AS pos, chunks[i] AS chunk_text
    FROM (SELECT {key}, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM ({chunked}))"""


def sql_hash_vectors(source: str, key: str, text: str) -> str:
    """Non-zero (dim, value) of the hashed bag of tokens of ``text``, stored in single precision."""
    return f"""
    SELECT {key}, dim, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS value
    FROM (SELECT {key}, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 384 AS dim, count(*)::DOUBLE AS n
          FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '{TOKEN_SQL}')) AS tok FROM ({source}))
          GROUP BY ALL)"""


