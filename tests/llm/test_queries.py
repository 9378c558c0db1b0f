"""Registered queries against their SQL, and the pipeline stage by stage."""

import os
import zlib
from array import array

import numpy as np
import pytest

import corpus_pipeline
from doclake.llm import decontaminate, neardup, packing, pieces, surrogates
from doclake.llm.common import table
from doclake.llm.queries import ORACLES, QUERIES, VOCABULARY
from tests import oracle
from tests.llm import test_neardup, test_substrings

SF = f"{oracle.DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    assert oracle.compare(oracle.frame_of(QUERIES[name](spark, SF)), con.sql(ORACLES[name]).df()) is None


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def rows(spark, con):
    """The rows of every registered query without SQL."""
    return {name: QUERIES[name](spark, SF).collect() for name in QUERIES if name not in ORACLES}


@pytest.fixture(scope="module")
def documents(con):
    return con.sql("SELECT doc_id, text FROM documents").fetchall()


def library_ids(text):
    return pieces.vocabulary(VOCABULARY).library.encode(text or "", add_special_tokens=False).ids


def test_op1(rows, documents):
    ids, sequences = {}, {}
    for r in rows["op1_packing"]:
        ids.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.doc_tokens >= r.start + r.length
    assert set(ids) == {d for d, _ in documents}
    for doc_id, text in documents:
        want, at = array("I", library_ids(text) + [1]), 0
        for start, length, crc in sorted(ids[doc_id]):
            assert start == at and crc == zlib.crc32(want[start : start + length].tobytes())
            at += length
        assert at == len(want)
    assert sorted(sequences) == list(range(len(sequences)))
    for number, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or (at < 2048 and number == len(sequences) - 1)


def test_op3_and_op5(rows, documents):
    for name in ("op3_quality", "op5_toxicity"):
        assert sorted(r.doc_id for r in rows[name]) == sorted(d for d, _ in documents)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows[name])
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows["op3_quality"])


def test_op4(rows, documents):
    fps = [test_neardup.brute_fingerprint(t) for _, t in documents]
    label = test_neardup.brute_components(fps, 4)
    groups = {}
    for (doc_id, _), group in zip(documents, label):
        groups.setdefault(group, []).append(doc_id)
    want = {(d, f"{fp:016x}", min(groups[g])) for (d, _), fp, g in zip(documents, fps, label)}
    assert {tuple(r) for r in rows["op4_near_duplicates"]} == want


def test_op6(spark, rows, documents):
    assert sorted(r.doc_id for r in rows["op6_surrogates"]) == sorted(d for d, _ in documents)
    before = {(r.kind, r.canon) for r in surrogates.occurrences(table(spark, SF, "documents")).collect()}
    after = spark.createDataFrame([(r.doc_id, r.text) for r in rows["op6_surrogates"]], "doc_id long, text string")
    assert before and not before & {(r.kind, r.canon) for r in surrogates.occurrences(after).collect()}


def test_op8(rows, con):
    vectors = {i: np.array(v, float) for i, v in con.sql("SELECT vec_id, embedding FROM embeddings").fetchall()}
    ids = np.array(sorted(vectors))
    matrix = np.array([vectors[i] for i in ids])
    got = {}
    for r in rows["op8_nearest_vectors"]:
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    hits = total = 0
    for query, ranked in got.items():
        scores = matrix @ vectors[query]
        order = [ids[k] for k in np.lexsort((ids, -scores)) if ids[k] != query][:20]
        assert sorted(ranked) == list(range(1, len(order) + 1)) and query not in [v for v, _ in ranked.values()]
        assert all(abs(s - vectors[v] @ vectors[query]) < 1e-12 for v, s in ranked.values())
        hits, total = hits + len({v for v, _ in ranked.values()} & set(order)), total + len(order)
    assert hits / total >= 0.9


def test_op9(rows, documents):
    assert sorted(map(tuple, rows["op9_repeated_windows"]), key=str) == test_substrings.brute(documents)


def test_op10(rows, documents):
    want = {(d, len((t or "").encode()), n := len(library_ids(t)), n > 2048) for d, t in documents}
    assert {tuple(r) for r in rows["op10_token_counts"]} == want


def test_pipeline_stages(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    docs = table(spark, SF, "documents")
    columns, before = docs.dtypes, docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, before, SF).cache()
        assert after.dtypes == columns, name
        ids, kept = {r.doc_id for r in before.collect()}, {r.doc_id for r in after.collect()}
        assert kept <= ids
        if name == "near duplicates":
            groups = {r.doc_id: r.component_id for r in neardup.near_duplicates(before).collect()}
            assert kept == {i for i, c in groups.items() if i == c}
        if name == "benchmark decontamination":
            leaked = decontaminate.contaminated(before, table(spark, SF, "benchmark")).collect()
            assert kept == ids - {r.doc_id for r in leaked}
        if name == "personal data":
            assert kept == ids and surrogates.occurrences(before).count() == surrogates.occurrences(after).count()
        before = after
    whole = function_of_last()(spark, before, SF)
    assert whole.agg({"length": "sum"}).first()[0] == packing.pack(before, corpus_pipeline.VOCABULARY).agg({"length": "sum"}).first()[0]
    assert {r.doc_id for r in whole.select("doc_id").collect()} == {r.doc_id for r in before.collect()}
    assert corpus_pipeline.run(spark, SF).count() > 0


def function_of_last():
    return corpus_pipeline.STAGES[-1][1]
