"""Queries on prompts, grading, the answer memo and totals, over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclake.functions import text as tx
from doclake.operators import answers as ans, embedding, retrieval
from doclake.plans.ask import ask
from doclake.plans.catalog.base import (
    REPLIES,
    SOURCE_CHUNKS,
    STORED_CHUNKS,
    query,
    replies,
    source_chunks,
    sql_strip,
    stored_chunks,
    table,
    turns,
)
from doclake.plans.catalog.search import corpus, sql_budget, sql_retrieved
from doclake.schemas import BLANK_ANSWER, CONTEXT_SEPARATOR, ERROR_ANSWER, REFUSAL
from doclake.session import stage


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_words(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({x}, '[a-zA-Z]{{4,}}'), lambda w: lower(w)))"


def sql_overlap(answer: str, context: str) -> str:
    said = sql_words(answer)
    return f"CASE WHEN len({said}) > 0 THEN len(list_intersect({said}, {sql_words(context)})) / len({said}) END"


def sql_grounded(answer: str, context: str) -> str:
    return f"({sql_strip(answer)} = {_quoted(REFUSAL)} OR coalesce({sql_overlap(answer, context)} >= 0.15, true))"


_HEAD, _BETWEEN, _TAIL = map(_quoted, ans.prompt_parts())


@query(
    f"SELECT conv_id, turn, {sql_strip(f'{_HEAD} || context || {_BETWEEN} || text || {_TAIL}')} AS prompt FROM ({REPLIES})"
)
def render_prompt(spark, sf):
    return replies(spark, sf).select("conv_id", "turn", ans.render_prompt(F.col("context"), F.col("text")).alias("prompt"))


# Short turns play the refusals.
MAYBE_REFUSED = f"CASE WHEN length(text) < 200 THEN {_quoted(REFUSAL)} || chr(10) ELSE text END"


def _maybe_refused():
    return F.when(F.length("text") < 200, F.lit(REFUSAL + "\n")).otherwise(F.col("text"))


@query(f"SELECT conv_id, turn, {sql_strip(MAYBE_REFUSED)} = {_quoted(REFUSAL)} AS refusal FROM conversations")
def is_refusal(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", ans.is_refusal(_maybe_refused()).alias("refusal"))


@query(
    f"""SELECT conv_id, turn, round({sql_overlap('text', 'context')}, 6) AS overlap, {sql_grounded(MAYBE_REFUSED, 'context')} AS grounded
    FROM ({REPLIES})"""
)
def groundedness(spark, sf):
    """Each reply against all turns before it; the overlap of a reply without words of four letters is null."""
    return replies(spark, sf).select(
        "conv_id",
        "turn",
        F.round(ans.overlap(F.col("text"), F.col("context")), 6).alias("overlap"),
        ans.looks_grounded(_maybe_refused(), F.col("context")).alias("grounded"),
    )


@query(
    f"""SELECT turn, count(*) AS answers, round(avg(CASE WHEN {sql_grounded('text', 'context')} THEN 0 ELSE 1 END), 6) AS low_confidence_rate
    FROM ({REPLIES}) GROUP BY turn"""
)
def low_confidence_rate(spark, sf):
    graded = replies(spark, sf).withColumn("low", ~ans.looks_grounded(F.col("text"), F.col("context")))
    return graded.groupBy("turn").agg(
        F.count("*").alias("answers"), F.round(F.avg(F.col("low").cast("int")), 6).alias("low_confidence_rate")
    )


# --- questions: user turns, the shortest made blank ---

BLANKED = "CASE WHEN length(text) < 60 THEN chr(10) || ' ' ELSE text END"
QUESTIONS = f"""
    SELECT conv_id || '-' || turn AS query_id, turn::INT AS pos, conv_id::VARCHAR AS namespace, {BLANKED} AS question
    FROM conversations WHERE role = 'user'"""


def user_questions(spark, sf):
    """User turns as questions; very short ones become blank."""
    question = F.when(F.length("text") < 60, "\n ").otherwise(F.col("text"))
    return (
        turns(spark, sf)
        .where(F.col("role") == "user")
        .select(
            F.concat_ws("-", "conv_id", "turn").alias("query_id"),
            F.col("turn").cast("int").alias("pos"),
            F.lit("default").alias("tenant_id"),
            F.lit(None).cast("string").alias("document_id"),
            F.col("conv_id").cast("string").alias("namespace"),
            question.alias("question"),
        )
    )


@query(f"SELECT query_id, {_quoted(BLANK_ANSWER)} AS answer, false AS low_confidence, 'blank' AS status FROM ({QUESTIONS}) WHERE {sql_strip('question')} = ''")
def blank_question(spark, sf):
    return ans.blank_answers(user_questions(spark, sf)).drop("sources")


def _fake_answerer(question, context, prompt):
    """Answers with the context; fails on questions that hold a comma."""
    if "," in question:
        raise RuntimeError("no answer")
    return context


@query(
    f"""SELECT conv_id, turn, CASE WHEN context LIKE '%,%' THEN {_quoted(ERROR_ANSWER)} ELSE {sql_strip('text')} END AS answer,
           CASE WHEN context LIKE '%,%' THEN 'error' ELSE 'ok' END AS status FROM ({REPLIES})"""
)
def answer_status(spark, sf):
    """The hook on every reply: the turns before it ask, the reply is their context."""
    asked = replies(spark, sf).select("conv_id", "turn", F.col("context").alias("question"), F.col("text").alias("context"))
    return ans.generate(asked, _fake_answerer).select("conv_id", "turn", "answer", "status")


# Stored answers: those of first questions, by the reply that follows.
MEMO = """
    SELECT q.conv_id::VARCHAR AS namespace, q.text AS question, a.text AS answer
    FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
    WHERE q.role = 'user' AND q.turn = 0 AND a.role = 'assistant'"""


def stored_answers(spark, sf):
    first = turns(spark, sf).where((F.col("role") == "user") & (F.col("turn") == 0)).select("conv_id", F.col("text").alias("question"))
    reply = turns(spark, sf).where((F.col("role") == "assistant") & (F.col("turn") == 1)).select("conv_id", F.col("text").alias("answer"))
    return first.join(reply, "conv_id").select(
        ans.memo_key(F.col("conv_id").cast("string"), F.col("question")).alias("memo_key"),
        "answer",
        ans.no_sources().alias("sources"),
        F.lit(False).alias("low_confidence"),
    )


@query(
    f"""SELECT q.query_id, sha256(q.namespace || ':' || q.question) AS memo_key, m.answer, m.answer IS NOT NULL AS hit
    FROM ({QUESTIONS}) q LEFT JOIN ({MEMO}) m ON m.namespace = q.namespace AND m.question = q.question
    WHERE {sql_strip('q.question')} <> ''"""
)
def answer_memo(spark, sf):
    keyed = ans.with_answer_key(user_questions(spark, sf).where(~tx.is_blank(F.col("question"))))
    memo = stored_answers(spark, sf).select("memo_key", "answer")
    missing = ans.unanswered(keyed, memo).select("memo_key", F.lit(True).alias("_new"))
    return (
        keyed.join(memo, "memo_key", "left")
        .join(missing, "memo_key", "left")
        .select("query_id", "memo_key", "answer", F.col("_new").isNull().alias("hit"))
    )


@query(
    f"""SELECT q.query_id, q.namespace, q.pos, coalesce(r.text, {_quoted(ERROR_ANSWER)}) AS answer, CASE WHEN r.text IS NULL THEN 'error' ELSE 'ok' END AS status
    FROM ({QUESTIONS}) q LEFT JOIN (SELECT conv_id || '-' || (turn - 1) AS query_id, text FROM conversations WHERE role = 'assistant') r USING (query_id)"""
)
def response_rows(spark, sf):
    """User turns with the reply that follows; where there is none, the error text."""
    answers = (
        turns(spark, sf)
        .where(F.col("role") == "assistant")
        .select(
            F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("query_id"),
            F.col("text").alias("answer"),
            ans.no_sources().alias("sources"),
            F.lit(False).alias("low_confidence"),
            F.lit("ok").alias("status"),
        )
    )
    rows = ans.response_rows(user_questions(spark, sf), answers)
    return rows.select("query_id", "namespace", "pos", "answer", "status")


USAGE_SQL = """
    SELECT sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, sum(p + c)::BIGINT AS total_tokens, count(*) AS calls
    FROM (SELECT CASE role WHEN 'user' THEN greatest(1, length(text) // 4) ELSE 0 END AS p,
                 CASE role WHEN 'assistant' THEN greatest(1, length(text) // 4) ELSE 0 END AS c
          FROM conversations WHERE role <> 'system')"""


def _usage(spark, sf):
    """Sizes of user turns as prompt tokens and of replies as completion tokens; system turns are no calls."""
    size = tx.approx_tokens(F.col("text"))
    usage = F.struct(
        F.when(F.col("role") == "user", size).alias("prompt_tokens"),
        F.when(F.col("role") == "assistant", size).alias("completion_tokens"),
        size.alias("total_tokens"),
    )
    return turns(spark, sf).select(F.when(F.col("role") != "system", usage).alias("usage"))


@query(USAGE_SQL)
def usage_totals(spark, sf):
    return ans.usage_totals(_usage(spark, sf))


def _sql_rate(asked: str, known: str, prefix: str) -> str:
    return f"""SELECT hits AS {prefix}_hits, misses AS {prefix}_misses, printf('%.2f%%', hits / (hits + misses) * 100) AS {prefix}_hit_rate
    FROM (SELECT count(m.k)::BIGINT AS hits, (count(*) - count(m.k))::BIGINT AS misses
          FROM ({asked}) a LEFT JOIN (SELECT DISTINCT k FROM ({known})) m ON a.k = m.k)"""


_STRIPPED = f"SELECT {sql_strip('chunk_text')} AS k FROM ({SOURCE_CHUNKS})"
_LABELLED = f"SELECT {sql_strip('text')} AS k FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"


@query(
    f"""SELECT * FROM (SELECT count(*) AS total_chunks FROM ({STORED_CHUNKS})),
    ({_sql_rate(_STRIPPED, _LABELLED, 'embedding')}),
    ({_sql_rate(f"SELECT namespace || ':' || question AS k FROM ({QUESTIONS})", f"SELECT namespace || ':' || question AS k FROM ({MEMO})", 'answer')}),
    ({USAGE_SQL})"""
)
def corpus_stats(spark, sf):
    passages = embedding.memo_keys(source_chunks(spark, sf), "chunk_text", "passage")
    labelled = passages.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    embedding_stats = embedding.memo_stats(passages.select("memo_key"), labelled.select("memo_key"))
    answer_stats = embedding.memo_stats(
        ans.with_answer_key(user_questions(spark, sf)).select("memo_key"), stored_answers(spark, sf).select("memo_key")
    )
    return ans.corpus_stats(stored_chunks(spark, sf), embedding_stats, answer_stats, ans.usage_totals(_usage(spark, sf)))


# --- end to end: user turns against all documents ---


def _first_source(question, context, prompt):
    """Stand-in for a model: quotes the first source; fails on questions that hold "oui"."""
    if "oui" in question.lower():
        raise RuntimeError("no answer")
    return context.split(CONTEXT_SEPARATOR)[0]


ASKED = f"""
    SELECT min(query_id) AS query_id, namespace, question FROM ({QUESTIONS}) q
    WHERE {sql_strip('question')} <> '' AND NOT EXISTS (SELECT 1 FROM ({MEMO}) m WHERE m.namespace = q.namespace AND m.question = q.question)
    GROUP BY namespace, question"""


ANSWERED = f"""WITH fresh AS (SELECT a.namespace, a.question, b.block, lower(a.question) LIKE '%oui%' AS bad
        FROM ({ASKED}) a JOIN ({sql_budget(sql_retrieved(f'SELECT query_id, question FROM ({ASKED})'), 3000)}) b ON a.query_id = b.query_id AND b.rank = 1)
    SELECT q.query_id, q.pos, CASE WHEN {sql_strip('q.question')} = '' THEN {_quoted(BLANK_ANSWER)} WHEN m.answer IS NOT NULL THEN m.answer
                WHEN f.bad THEN {_quoted(ERROR_ANSWER)} ELSE {sql_strip('f.block')} END AS answer,
           false AS low_confidence,
           CASE WHEN {sql_strip('q.question')} = '' THEN 'blank' WHEN m.answer IS NOT NULL THEN 'memo' WHEN f.bad THEN 'error' ELSE 'ok' END AS status
    FROM ({QUESTIONS}) q LEFT JOIN ({MEMO}) m ON m.namespace = q.namespace AND m.question = q.question
    LEFT JOIN fresh f ON f.namespace = q.namespace AND f.question = q.question"""


@query(ANSWERED)
def ask_documents(spark, sf):
    """Memo, retrieval, context, hook, grading and response rows in one plan."""
    chunks, documents = corpus(spark, sf)
    done = ask(user_questions(spark, sf), chunks, documents, stored_answers(spark, sf), _first_source)
    return done.responses.select("query_id", "pos", "answer", "low_confidence", "status")


@query(ANSWERED)
def ask_cells(spark, sf):
    """The same with the search over cells, whose bounds make it exact."""
    chunks, documents = corpus(spark, sf)
    cells = retrieval.train_cells(chunks, 16, rounds=3)
    indexed = stage(retrieval.assign_cells(chunks, cells), "indexed")
    done = ask(
        user_questions(spark, sf), indexed, documents, stored_answers(spark, sf), _first_source,
        cells=retrieval.measured(cells, indexed), probes=2, factor=1.0,
    )
    return done.responses.select("query_id", "pos", "answer", "low_confidence", "status")
