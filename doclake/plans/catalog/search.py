"""Queries on retrieval and context assembly."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from doclake.functions import vectors as vec
from doclake.operators import chunking, context as ctx, embedding, retrieval, store
from doclake.plans.ask import rag_contexts
from doclake.plans.catalog.base import (
    query,
    sql_chunks,
    sql_exploded,
    sql_hash_vectors,
    sql_strip,
    table,
    whole_sections,
)
from doclake.session import scratch_dir, stage
from doclake.sources import tables

SEPARATOR_SQL = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


def vector_chunks(spark, sf):
    """``embeddings`` as chunks: the label is the document, two halves of the labels are tenants."""
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("document_id"),
        F.when(F.col("label") < 5, "north").otherwise("south").alias("tenant_id"),
        F.col("vec_id").cast("int").alias("chunk_index"),
        "embedding",
    )


def vector_questions(spark, sf, scoped):
    """Every vector asks, within its tenant or within its document."""
    rows = vector_chunks(spark, sf)
    document = F.col("document_id") if scoped else F.lit(None).cast("string")
    return rows.select(
        F.col("chunk_index").cast("string").alias("query_id"), "tenant_id", document.alias("document_id"), "embedding"
    )


VECTORS = """
    SELECT vec_id, label::VARCHAR AS document_id, CASE WHEN label < 5 THEN 'north' ELSE 'south' END AS tenant_id,
           vec_id::INT AS chunk_index, embedding::DOUBLE[] AS v FROM embeddings"""


def _sql_top_k(scope: str, k: int = 5) -> str:
    return f"""
    SELECT query_id, document_id, chunk_index, distance, rank FROM (
        SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, document_id, chunk_index))::INT AS rank
        FROM (SELECT q.vec_id::VARCHAR AS query_id, c.document_id, c.chunk_index, round(list_distance(q.v, c.v), 9) AS distance
              FROM ({VECTORS}) q JOIN ({VECTORS}) c ON q.{scope} = c.{scope}))
    WHERE rank <= {k}"""


SHORT = "SELECT query_id, document_id, chunk_index, round(distance, 6) AS distance, rank FROM ({})"


def _rounded(hits):
    return hits.select("query_id", "document_id", "chunk_index", F.round("distance", 6).alias("distance"), "rank")


#: Small blocks, none of them broadcast.
SHUFFLED = {"question_block": 64, "chunk_block": 256, "broadcast_bytes": 0}


@query(SHORT.format(_sql_top_k("tenant_id")))
def topk_global(spark, sf):
    return _rounded(retrieval.top_k(vector_questions(spark, sf, False), vector_chunks(spark, sf)))


@query(SHORT.format(_sql_top_k("document_id")))
def topk_scoped(spark, sf):
    return _rounded(retrieval.top_k(vector_questions(spark, sf, True), vector_chunks(spark, sf)))


@query(SHORT.format(_sql_top_k("document_id")))
def topk_scoped_shuffled(spark, sf):
    """The same by the path for question sets that exceed one block."""
    hits = retrieval.top_k(vector_questions(spark, sf, True), vector_chunks(spark, sf), **SHUFFLED)
    return _rounded(hits)


@query(SHORT.format(_sql_top_k("tenant_id")))
def topk_global_shuffled(spark, sf):
    """Tenant-wide questions in blocks of 64, met with blocks of chunks by a shuffle."""
    return _rounded(retrieval.top_k(vector_questions(spark, sf, False), vector_chunks(spark, sf), **SHUFFLED))


PAIRS = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _neighbours(spark, sf):
    a = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = table(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id")


@query(f"SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance {PAIRS}")
def l2_distance(spark, sf):
    return _neighbours(spark, sf).select("vec_id", F.round(vec.l2_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query(f"SELECT a.vec_id, round(1 - list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2 / 2, 6) AS cosine {PAIRS}")
def cosine_from_l2(spark, sf):
    cosine = vec.cosine_from_l2(vec.l2_distance(F.col("a"), F.col("b")))
    return _neighbours(spark, sf).select("vec_id", F.round(cosine, 6).alias("cosine"))


@query(
    f"""WITH v AS (SELECT * FROM ({VECTORS}) WHERE vec_id % 7 <> 0),
    hits AS (
        SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, document_id, chunk_index))::INT AS rank
        FROM (SELECT q.vec_id::VARCHAR AS query_id, c.document_id, c.chunk_index, round(list_distance(q.v, c.v), 9) AS distance
              FROM ({VECTORS}) q JOIN v c ON q.document_id = c.document_id))
    SELECT path, query_id, document_id, chunk_index, round(distance, 6) AS distance, rank
    FROM hits, (VALUES ('broadcast'), ('shuffled')) p(path) WHERE rank <= 5"""
)
def topk_null_vectors(spark, sf):
    """Chunks without a vector take no part, whichever way the questions go."""
    chunks = vector_chunks(spark, sf).withColumn("embedding", F.when(F.col("chunk_index") % 7 != 0, F.col("embedding")))
    asked = vector_questions(spark, sf, True)
    paths = {"broadcast": {}, "shuffled": SHUFFLED}
    found = [_rounded(retrieval.top_k(asked, chunks, **b)).withColumn("path", F.lit(p)) for p, b in paths.items()]
    return reduce(DataFrame.unionByName, found)


def _versions(spark, sf):
    """Vectors as chunks of two versions of each label: numbers restart with the edited version."""
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("document_id"),
        F.lit("default").alias("tenant_id"),
        F.floor(F.col("vec_id") / 2).cast("int").alias("chunk_index"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("chunk_text"),
        F.sha2(F.concat(F.lit("vector "), F.col("vec_id").cast("string")), 256).alias("text_hash"),
        F.lit(None).cast("int").alias("page_number"),
        F.lit(None).cast("string").alias("sheet_name"),
        F.lit(None).cast("string").alias("chunk_type"),
        "embedding",
        (F.col("vec_id") % 2).alias("_version"),
    )


@query(
    """WITH v AS (SELECT vec_id, label::VARCHAR AS document_id, 'vector ' || vec_id AS chunk_text, vec_id // 2 AS n, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT query_id, rank, document_id, chunk_text, source_uri, chunk_type FROM (
        SELECT q.vec_id::VARCHAR AS query_id, c.document_id, c.chunk_text, 'doc://' || c.document_id AS source_uri, 'paragraph' AS chunk_type,
               (row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.v, c.v), 9), c.n, sha256(c.chunk_text)))::INT AS rank
        FROM v q JOIN v c ON q.document_id = c.document_id)
    WHERE rank <= 4"""
)
def reingest_retrieve(spark, sf):
    """A first version of every document, an edited one upserted after it, and retrieval over both from a table
    parted by tenant and bucket of documents."""
    rows = _versions(spark, sf)
    first = store.new_chunks(rows.where("_version = 0").drop("_version"), rows.limit(0))
    both = first.unionByName(store.new_chunks(rows.where("_version = 1").drop("_version"), first))
    documents = rows.select("document_id", F.concat(F.lit("doc://"), "document_id").alias("source_uri")).distinct()
    path = f"{scratch_dir(spark)}/versions-{uuid.uuid4().hex}"
    tables.write_chunks(both, path, bucketed=True)
    both = tables.read_chunks(spark, path)
    hits = retrieval.retrieve(vector_questions(spark, sf, True).withColumn("tenant_id", F.lit("default")), both, documents, 4)
    return hits.select("query_id", "rank", "document_id", "chunk_text", "source_uri", "chunk_type")


LISTS, PROBES, FACTOR = 20, 2, 5.5


def _cells(spark, sf):
    chunks = vector_chunks(spark, sf)
    cells = retrieval.train_cells(chunks, LISTS)
    indexed = stage(retrieval.assign_cells(chunks, cells), "indexed")
    return retrieval.measured(cells, indexed), indexed


def _label_cells(spark, sf):
    """Cells around the mean vector of each label: centroids that SQL can compute, too."""
    cells = retrieval.mean_cells(table(spark, sf, "embeddings").select("label", "embedding"))
    indexed = stage(retrieval.assign_cells(vector_chunks(spark, sf), cells), "indexed")
    return retrieval.measured(cells, indexed), indexed


# ``read``: the lists that a question probes, in two rounds; ``hits``: the five nearest in them.
SQL_CELLS = f"""
    WITH v AS ({VECTORS}),
    c AS (SELECT label, list(m ORDER BY dim) AS m FROM (
              SELECT label, dim, avg(x) AS m FROM (
                  SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
              GROUP BY label, dim) GROUP BY label),
    near AS (SELECT vec_id, tenant_id, document_id, chunk_index, v, label, list_distance(v.v, c.m) AS far, c.m,
                    row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v.v, c.m), label) AS place FROM v, c),
    members AS MATERIALIZED (SELECT * FROM near WHERE place = 1),
    radii AS (SELECT label, max(far) AS radius FROM members GROUP BY label),
    pairs AS MATERIALIZED (
        SELECT q.vec_id AS query, x.label, x.document_id, x.chunk_index, round(list_distance(q.v, x.v), 9) AS distance
        FROM v q JOIN members x ON q.tenant_id = x.tenant_id),
    reach AS (
        SELECT query, max(distance) AS reach FROM (
            SELECT p.query, p.distance FROM pairs p JOIN near q ON q.vec_id = p.query AND q.label = p.label AND q.place <= {PROBES}
            QUALIFY row_number() OVER (PARTITION BY p.query ORDER BY p.distance, p.document_id, p.chunk_index) <= 5)
        GROUP BY query HAVING count(*) = 5),
    read AS (
        SELECT q.vec_id AS query, q.label FROM near q JOIN radii USING (label) JOIN members o ON o.vec_id = q.vec_id
        LEFT JOIN reach ON reach.query = q.vec_id
        WHERE q.place <= {PROBES}
           OR greatest(q.far - radius, (q.far ** 2 - o.far ** 2) / (2 * list_distance(q.m, o.m))) * {FACTOR}
              <= coalesce(reach, 'inf'::DOUBLE) + 1e-9),
    hits AS (
        SELECT query::VARCHAR AS query_id, document_id, chunk_index, distance,
               (row_number() OVER (PARTITION BY query ORDER BY distance, document_id, chunk_index))::INT AS rank
        FROM pairs JOIN read USING (query, label))"""


@query(f"{SQL_CELLS} SELECT query_id, document_id, chunk_index, round(distance, 6) AS distance, rank FROM hits WHERE rank <= 5")
def topk_ivf(spark, sf):
    """Two cells first, then those whose bound, relaxed by a factor, the fifth distance does not exclude."""
    cells, indexed = _label_cells(spark, sf)
    return _rounded(retrieval.top_k_cells(vector_questions(spark, sf, False), indexed, cells, PROBES, factor=FACTOR))


@query(SHORT.format(_sql_top_k("tenant_id")))
def topk_ivf_all_cells(spark, sf):
    """Probing every cell must give the exact result."""
    cells, indexed = _cells(spark, sf)
    return _rounded(retrieval.top_k_cells(vector_questions(spark, sf, False), indexed, cells, LISTS))


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS scope, * FROM ({SHORT.format(_sql_top_k(column))})"
        for name, column in (("tenant", "tenant_id"), ("document", "document_id"))
    )
)
def topk_ivf_exact(spark, sf):
    """A factor of 1 gives the exact result, over a tenant and within a document, many questions as well."""
    cells, indexed = _cells(spark, sf)
    found = [
        _rounded(
            retrieval.top_k_cells(
                vector_questions(spark, sf, scoped), indexed, cells, 1, factor=1.0, question_block=64, broadcast_bytes=small
            )
        ).withColumn("scope", F.lit(name))
        for name, scoped, small in (("tenant", False, 1 << 26), ("document", True, 0))
    ]
    return found[0].unionByName(found[1])


@query(
    f"""{SQL_CELLS},
    found AS (SELECT query_id, document_id, chunk_index FROM hits WHERE rank <= 5)
    SELECT *, found / expected AS recall FROM (
        SELECT count(*) AS expected, count(a.query_id) AS found
        FROM ({_sql_top_k('tenant_id')}) e LEFT JOIN found a USING (query_id, document_id, chunk_index)),
    (SELECT (SELECT count(*) FROM pairs JOIN read USING (query, label)) / (SELECT count(*) FROM pairs) AS read)"""
)
def ivf_recall(spark, sf):
    """Recall against the exact search, and the share of the tenants' vectors that was compared."""
    cells, indexed = _label_cells(spark, sf)
    questions = vector_questions(spark, sf, False)
    hits, probes = retrieval.probe_cells(questions, indexed, cells, PROBES, 5, FACTOR)
    found = retrieval.recall(hits, retrieval.top_k(questions, vector_chunks(spark, sf)))
    return found.join(retrieval.share_read(probes, questions, indexed))  # one row each


# --- contexts of the hits above: texts from documents by id ---


def text_hits(spark, sf):
    """Scoped hits with the text of the document of the same number; the language decides which have no uri, an empty one, or a sheet."""
    texts = table(spark, sf, "documents").select(
        F.col("doc_id").cast("int").alias("chunk_index"), F.col("text").alias("chunk_text"), "lang", "source"
    )
    hits = retrieval.top_k(vector_questions(spark, sf, True), vector_chunks(spark, sf)).join(texts, "chunk_index")
    return hits.select(
        "query_id",
        "rank",
        "document_id",
        "chunk_text",
        F.when(F.col("lang") == "fr", "").when(F.col("lang") != "de", F.concat(F.lit("doc://"), "source")).alias("source_uri"),
        F.length("lang").cast("int").alias("page_number"),
        F.when(F.col("lang") == "es", F.col("source")).when(F.col("lang") == "en", "").alias("sheet_name"),
    )


TEXT_HITS = f"""
    SELECT h.query_id, h.rank, h.document_id, d.text AS chunk_text,
           CASE WHEN d.lang = 'fr' THEN '' WHEN d.lang <> 'de' THEN 'doc://' || d.source END AS source_uri,
           length(d.lang)::INT AS page_number, CASE WHEN d.lang = 'es' THEN d.source WHEN d.lang = 'en' THEN '' END AS sheet_name
    FROM ({_sql_top_k('document_id')}) h JOIN documents d ON d.doc_id = h.chunk_index"""


def _sql_label(hits: str) -> str:
    return f"""
    SELECT *, '[Source ' || rank || ' — ' || coalesce(nullif(source_uri, ''), document_id)
           || CASE WHEN page_number <> 0 THEN ', page ' || page_number ELSE '' END
           || CASE WHEN sheet_name <> '' THEN ', sheet ''' || sheet_name || '''' ELSE '' END || ']' AS label
    FROM ({hits})"""


def sql_budget(hits: str, budget: int) -> str:
    return f"""
    SELECT * FROM (
        SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS running FROM (
            SELECT *, label || chr(10) || chunk_text AS block,
                   greatest(1, length(label || chr(10) || chunk_text) // 4)::INT AS tokens FROM ({_sql_label(hits)})))
    WHERE rank = 1 OR running <= {budget}"""


@query(f"SELECT query_id, rank, label FROM ({_sql_label(TEXT_HITS)})")
def source_label(spark, sf):
    hits = text_hits(spark, sf)
    columns = [F.col(c) for c in ("rank", "source_uri", "document_id", "page_number", "sheet_name")]
    return hits.select("query_id", "rank", ctx.source_label(*columns).alias("label"))


BUDGETS = (50, 300, 3000)


@query(
    " UNION ALL ".join(
        f"SELECT {b} AS budget, query_id, rank, tokens, running FROM ({sql_budget(TEXT_HITS, b)})" for b in BUDGETS
    )
)
def context_budget(spark, sf):
    hits = text_hits(spark, sf)
    cut = [
        ctx.within_budget(hits, b).select(F.lit(b).alias("budget"), "query_id", "rank", "tokens", "running") for b in BUDGETS
    ]
    return reduce(DataFrame.unionByName, cut)


def _sql_context(hits: str, budget: int, questions: str) -> str:
    return f"""
    SELECT q.query_id, coalesce(string_agg(b.block, {SEPARATOR_SQL} ORDER BY b.rank), '') AS context, count(b.rank) AS n_sources
    FROM ({questions}) q LEFT JOIN ({sql_budget(hits, budget)}) b ON q.query_id = b.query_id GROUP BY q.query_id"""


VECTOR_IDS = "SELECT vec_id::VARCHAR AS query_id FROM embeddings"


@query(_sql_context(TEXT_HITS, 1000, VECTOR_IDS))
def build_context(spark, sf):
    questions = vector_questions(spark, sf, True).select("query_id")
    built = ctx.build_context(questions, text_hits(spark, sf), 1000)
    return built.select("query_id", "context", F.size("sources").cast("bigint").alias("n_sources"))


@query(
    f"""SELECT query_id, rank AS source, document_id, source_uri, page_number, sheet_name
    FROM ({sql_budget(TEXT_HITS, 1000)})"""
)
def context_sources(spark, sf):
    questions = vector_questions(spark, sf, True).select("query_id")
    return ctx.context_sources(ctx.build_context(questions, text_hits(spark, sf), 1000))


@query(
    f"""SELECT h.query_id, h.document_id, h.chunk_index, h.rank, r.name AS source_uri
    FROM ({_sql_top_k('tenant_id')}) h LEFT JOIN (SELECT r_regionkey::VARCHAR AS document_id, r_name AS name FROM region) r USING (document_id)"""
)
def cite_sources(spark, sf):
    """Hits cited by the regions' names; labels above the last region have no source."""
    names = table(spark, sf, "region").select(
        F.col("r_regionkey").cast("string").alias("document_id"), F.col("r_name").alias("source_uri")
    )
    hits = retrieval.top_k(vector_questions(spark, sf, False), vector_chunks(spark, sf))
    return retrieval.cite_sources(hits, names).select("query_id", "document_id", "chunk_index", "rank", "source_uri")


# --- flagship: documents to contexts for the benchmark's questions ---


def corpus(spark, sf):
    """All documents, chunked, embedded and stored, with their registry."""
    chunks = embedding.embed(chunking.chunk_sections(whole_sections(spark, sf)), "chunk_text", "passage")
    chunks = stage(chunks, "corpus")
    documents = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("source_uri"),
    )
    return chunks, documents


def benchmark_questions(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"),
        F.lit("default").alias("tenant_id"),
        F.lit(None).cast("string").alias("document_id"),
        F.col("text").alias("question"),
    )


CHUNKS = f"""
    SELECT document_id, pos::INT AS chunk_index, chunk_text
    FROM ({sql_exploded(sql_chunks('SELECT doc_id::VARCHAR AS document_id, text FROM documents', 'document_id', 462, 50), 'document_id')})"""
BENCHMARK = "SELECT item_id::VARCHAR AS query_id, text AS question FROM benchmark"


def sql_retrieved(questions: str, k: int = 5) -> str:
    """Top-k chunks per question (query_id, question) with text; distances from sparse hashed vectors."""
    passage = "'passage: ' || " + sql_strip("chunk_text")
    asked = "'query: ' || " + sql_strip("question")
    keyed = f"SELECT document_id || '#' || chunk_index AS ck, * FROM ({CHUNKS})"
    return f"""
    WITH chunk_rows AS MATERIALIZED ({keyed}),
    question_rows AS MATERIALIZED ({questions}),
    cv AS MATERIALIZED ({sql_hash_vectors('SELECT * FROM chunk_rows', 'ck', passage)}),
    qv AS MATERIALIZED ({sql_hash_vectors('SELECT * FROM question_rows', 'query_id', asked)}),
    cn AS (SELECT ck, sum(value * value) AS s FROM cv GROUP BY ck),
    qn AS (SELECT query_id, sum(value * value) AS s FROM qv GROUP BY query_id),
    dots AS (SELECT query_id, ck, sum(cv.value * qv.value) AS d FROM cv JOIN qv USING (dim) GROUP BY query_id, ck),
    ranked AS (
        SELECT q.query_id, c.ck, round(sqrt(greatest(0, qn.s + cn.s - 2 * coalesce(d.d, 0))), 9) AS distance
        FROM question_rows q CROSS JOIN chunk_rows c JOIN qn ON qn.query_id = q.query_id JOIN cn ON cn.ck = c.ck
        LEFT JOIN dots d ON d.query_id = q.query_id AND d.ck = c.ck)
    SELECT query_id, rank, document_id, chunk_text, distance, 'doc://' || document_id AS source_uri, 1 AS page_number, NULL::VARCHAR AS sheet_name
    FROM (SELECT r.query_id, r.distance, c.document_id, c.chunk_text,
                 (row_number() OVER (PARTITION BY r.query_id ORDER BY distance, c.document_id, c.chunk_index))::INT AS rank
          FROM ranked r JOIN chunk_rows c USING (ck))
    WHERE rank <= {k}"""


@query(_sql_context(sql_retrieved(BENCHMARK), 3000, BENCHMARK))
def rag_context(spark, sf):
    """Chunk and embed every document, find the five nearest chunks per question, build the context."""
    chunks, documents = corpus(spark, sf)
    built = rag_contexts(benchmark_questions(spark, sf), chunks, documents)
    return built.select("query_id", "context", F.size("sources").cast("bigint").alias("n_sources"))


@query("SELECT item_id::VARCHAR AS query_id, item_id % 2 = 0 AS from_memo FROM benchmark")
def question_memo(spark, sf):
    """The memo holds marked vectors for every second question: those must be taken, the others encoded."""
    asked = benchmark_questions(spark, sf)
    marked = F.array_repeat(F.lit(9.0).cast("float"), 384).alias("embedding")
    memo = embedding.memo_keys(asked.where(F.col("query_id") % 2 == 0), "question", "query").select("memo_key", marked)
    rows, _ = embedding.embed_with_memo(asked, memo.distinct(), "question", "query", ["query_id"])
    return rows.select("query_id", (F.col("embedding")[0] == 9.0).alias("from_memo"))
