"""Queries on splitting, chunking, hashing and embedding."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from doclake.functions import text as tx, vectors as vec
from doclake.operators import chunking, embedding
from doclake.plans.catalog.base import (
    LINE_PAGES,
    SOURCE_CHUNKS,
    line_sections,
    query,
    source_chunks,
    sql_chunks,
    sql_exploded,
    sql_hash_vectors,
    sql_paragraphs,
    sql_sentences,
    sql_strip,
    sql_tail,
    sql_tokens,
    table,
    whole_sections,
)
from doclake.schemas import MEMO
from doclake.session import scratch_dir, spread
from doclake.sources import tables

SECTION_BUDGET, SECTION_OVERLAP = 60, 12
DOUBLED = "SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents"
WHOLE = "SELECT doc_id::VARCHAR AS document_id, text FROM documents"
SECTIONS = f"SELECT document_id, page_idx::INT AS position, text FROM ({LINE_PAGES}) WHERE {sql_strip('text')} <> ''"
SECTION_CHUNKS = sql_exploded(
    sql_chunks(SECTIONS, "document_id, position", SECTION_BUDGET, SECTION_OVERLAP), "document_id, position"
)
INDEXED = f"""
    SELECT document_id, position, chunk_text,
           (row_number() OVER (PARTITION BY document_id ORDER BY position, pos) - 1)::INT AS chunk_index
    FROM ({SECTION_CHUNKS})"""


def _doubled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def _chunked_lines(spark, sf):
    return chunking.chunk_sections(line_sections(spark, sf), budget=SECTION_BUDGET, overlap=SECTION_OVERLAP)


def _exploded(df, key, array):
    return df.select(key, F.posexplode(array).alias("pos", "piece"))


def _sql_list(source: str, key: str, expression: str) -> str:
    return f"""SELECT {key}, (i - 1)::INT AS pos, l[i] AS piece
    FROM (SELECT {key}, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT {key}, {expression} AS l FROM ({source})))"""


@query(_sql_list(DOUBLED, "doc_id", sql_paragraphs("text")))
def paragraphs(spark, sf):
    return _exploded(_doubled(spark, sf), "doc_id", tx.paragraphs(F.col("text")))


@query(_sql_list(DOUBLED, "doc_id", sql_sentences("text")))
def sentences(spark, sf):
    return _exploded(_doubled(spark, sf), "doc_id", tx.sentences(F.col("text")))


@query(f"SELECT doc_id, {sql_tokens('text')}::INT AS tokens FROM documents")
def token_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.token_count(F.col("text")).alias("tokens"))


@query(
    f"SELECT document_id, pos::INT AS pos, chunk_text FROM ({sql_exploded(sql_chunks(WHOLE, 'document_id', 462, 50), 'document_id')})"
)
def chunk_text(spark, sf):
    chunks = chunking.chunk_udf()("text")
    return spread(whole_sections(spark, sf)).select("document_id", F.posexplode(chunks).alias("pos", "chunk_text"))


@query(f"SELECT doc_id, {sql_tail('text', 50)} AS tail FROM documents")
def chunk_overlap(spark, sf):
    tail = F.rtrim(F.regexp_replace(tx.last_tokens(F.col("text"), 50), r"\n+$", ""))
    return table(spark, sf, "documents").select("doc_id", tail.alias("tail"))


@query(
    f"""SELECT doc_id, (i - 1)::INT AS pos, k[i] AS piece FROM (SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS i FROM (
    SELECT doc_id, CASE WHEN len(l) > 1 AND len(list_filter(l, lambda c: {sql_tokens('c')} >= 10)) > 0
                        THEN list_filter(l, lambda c: {sql_tokens('c')} >= 10) ELSE l END AS k
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""
)
def min_chunk_filter(spark, sf):
    kept = chunking.drop_fragments(F.split("text", "\n"))
    return _exploded(table(spark, sf, "documents"), "doc_id", kept)


@query(
    f"""SELECT document_id, (position + 1)::INT AS page_number, 'paragraph' AS chunk_type, NULL::VARCHAR AS sheet_name,
    chunk_text, sha256(chunk_text) AS text_hash FROM ({INDEXED})"""
)
def chunk_documents(spark, sf):
    return _chunked_lines(spark, sf).select(
        "document_id", "page_number", "chunk_type", "sheet_name", "chunk_text", "text_hash"
    )


@query(f"SELECT document_id, chunk_index, (position + 1)::INT AS page_number, chunk_text FROM ({INDEXED})")
def chunk_index(spark, sf):
    return _chunked_lines(spark, sf).select("document_id", "chunk_index", "page_number", "chunk_text")


@query(
    f"""SELECT document_id, count(*) AS chunks, round(avg({sql_tokens('chunk_text')}), 6) AS mean_tokens
    FROM ({INDEXED}) GROUP BY document_id"""
)
def chunk_stats(spark, sf):
    stats = chunking.chunk_stats(_chunked_lines(spark, sf))
    return stats.withColumn("mean_tokens", F.round("mean_tokens", 6))


@query("SELECT doc_id, sha256(text) AS text_hash FROM documents")
def text_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.sha256_text(F.col("text")).alias("text_hash"))


@query("SELECT page_id, sha256(encode(html)) AS checksum FROM pages")
def bytes_hash(spark, sf):
    from doclake.operators.identity import bytes_checksum

    return table(spark, sf, "pages").select("page_id", bytes_checksum(F.encode("html", "UTF-8")).alias("checksum"))


@query(
    f"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'query: ' ELSE 'passage: ' END || {sql_strip('text')} AS prefixed
    FROM conversations"""
)
def prefix_text(spark, sf):
    asked = F.when(F.col("role") == "user", tx.prefixed(F.col("text"), "query"))
    prefixed = F.coalesce(asked, tx.prefixed(F.col("text"), "passage"))
    return table(spark, sf, "conversations").select("conv_id", "turn", prefixed.alias("prefixed"))


def _components(df, key, vector):
    return df.select(key, F.posexplode(vector).alias("dim", "value")).where(F.col("value") != 0)


@query(
    f"SELECT doc_id, dim::INT AS dim, value FROM ({sql_hash_vectors('SELECT * FROM documents', 'doc_id', sql_strip(chr(39) + 'passage: ' + chr(39) + ' || ' + sql_strip('text')))})"
)
def hash_embed(spark, sf):
    vectors = embedding.embed(table(spark, sf, "documents").select("doc_id", "text"), "text", "passage")
    return _components(vectors, "doc_id", "embedding").withColumn("value", F.col("value").cast("double"))


@query(
    """SELECT vec_id, (i - 1)::INT AS dim, round(v[i] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS value
    FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i
          FROM (SELECT vec_id, list_transform(embedding, lambda x: 3 * x::DOUBLE) AS v FROM embeddings))"""
)
def l2_normalize(spark, sf):
    scaled = F.transform("embedding", lambda x: 3 * x.cast("double"))
    unit = table(spark, sf, "embeddings").select("vec_id", vec.l2_normalize(scaled).alias("unit"))
    return unit.select("vec_id", F.posexplode("unit").alias("dim", "value")).withColumn("value", F.round("value", 6))


def _passages(spark, sf):
    return source_chunks(spark, sf).select("doc_id", "document_id", "chunk_index", "chunk_text")


def _memo(spark, sf):
    """Vectors of the labelled documents: an existing memo, written by bucket."""
    labelled = _passages(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    keyed = embedding.memo_keys(labelled, "chunk_text", "passage")
    path = f"{scratch_dir(spark)}/memo-{uuid.uuid4().hex}"
    nothing = spark.createDataFrame([], MEMO)
    tables.write_memo(embedding.encode_misses(keyed, nothing, "chunk_text", "passage"), path)
    return tables.read_memo(spark, path)


@query(
    f"SELECT doc_id, dim::INT AS dim, value FROM ({sql_hash_vectors('SELECT * FROM documents', 'doc_id', chr(39) + 'passage: ' + chr(39) + ' || ' + sql_strip('text'))})"
)
def embed_memo(spark, sf):
    vectors, _ = embedding.embed_with_memo(
        _passages(spark, sf), _memo(spark, sf), "chunk_text", "passage", ["document_id", "chunk_index"], at_rest=True
    )
    return _components(vectors, "doc_id", "embedding").withColumn("value", F.col("value").cast("double"))


@query(
    f"""SELECT hits, misses, printf('%.2f%%', hits / (hits + misses) * 100) AS hit_rate
    FROM (SELECT count(m.k)::BIGINT AS hits, (count(*) - count(m.k))::BIGINT AS misses
          FROM (SELECT {sql_strip('chunk_text')} AS k FROM ({SOURCE_CHUNKS})) a
          LEFT JOIN (SELECT DISTINCT {sql_strip('text')} AS k FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) m
          ON a.k = m.k)"""
)
def memo_stats(spark, sf):
    keyed = embedding.memo_keys(_passages(spark, sf), "chunk_text", "passage")
    labelled = keyed.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return embedding.memo_stats(keyed, labelled.select("memo_key"))


@query(f"SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens FROM documents")
def approx_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.approx_tokens(F.col("text")).alias("tokens"))
