import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from doclake.operators import answers as ans, embedding, identity, retrieval, store
from doclake.operators.embedding import HashEncoder
from doclake.plans.ask import ask
from doclake.plans.ingest import ingest
from doclake.schemas import CHUNKS, DOCUMENTS
from doclake.sources import files as fs, tables
from doclake.sources.decoders import PasswordProtected
from doclake.streaming.ingest import each_batch, file_stream, ingest_stream

FILES = {
    "trees.csv": b"tree,height\noak,21\nelm,17\noak,21\n",
    "other.csv": b"tree,height\noak,21\n",
    "locked.pdf": b"%PDF-1.4 LOCKED",
    "pages.pdf": b"%PDF-1.4 one page about storks in spring",
    "broken.pdf": b"%PDF-1.4 BROKEN",
    "empty.pdf": b"%PDF-1.4 EMPTY",
    "junk.xyz": b"no commas here",
    "nothing.csv": b"",
}


def pdf(data):
    if b"LOCKED" in data:
        raise PasswordProtected()
    if b"BROKEN" in data:
        raise KeyError("xref")
    if b"EMPTY" in data:
        return
    yield {"kind": "page", "i": 0, "text": data.decode()[9:]}


def files(spark, content):
    rows = [(n, len(c), bytearray(c)) for n, c in content.items()]
    return spark.createDataFrame(rows, "file_name string, length long, content binary")


@pytest.fixture(scope="module")
def empty(spark):
    memo = spark.createDataFrame([], "memo_key string, embedding array<float>")
    return spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], CHUNKS), memo


@pytest.mark.parametrize("mode", ["url", "upload", "folder"])
def test_ingest(spark, empty, mode):
    done = ingest(files(spark, FILES), *empty, mode=mode, max_bytes=60, decoders={"pdf": pdf})
    documents = {r.source_uri: r for r in done.documents.collect()}
    rejects = {r.source_uri: r.reason for r in done.rejects.collect()}
    with_chunks = {"trees.csv", "other.csv", "pages.pdf"}
    registered = {
        "folder": with_chunks,
        "upload": set(FILES) - {"junk.xyz", "nothing.csv"},
        "url": set(FILES),
    }[mode]
    assert set(documents) == registered
    assert all((r.checksum is None) == (mode == "folder") for r in documents.values())
    assert rejects == {"locked.pdf": "password_protected", "broken.pdf": "unreadable", "junk.xyz": "unknown_format", "nothing.csv": "unknown_format"}
    names = {r.document_id: r.source_uri for r in documents.values()}
    chunks = {(names[r.document_id], r.chunk_index): r for r in done.chunks.collect()}
    assert {k: r.chunk_text for k, r in chunks.items()} == {
        ("trees.csv", 0): "tree: oak; height: 21",
        ("trees.csv", 1): "tree: elm; height: 17",
        ("other.csv", 0): "tree: oak; height: 21",
        ("pages.pdf", 0): "one page about storks in spring",
    }
    assert chunks["trees.csv", 0].chunk_type == "row" and chunks["pages.pdf", 0].page_number == 1
    assert all(len(r.embedding) == 384 for r in chunks.values())
    assert {names[r.document_id]: r.chunks_stored for r in done.report.collect()} == {"trees.csv": 3, "other.csv": 1, "pages.pdf": 1}
    assert done.memo.count() == 3

    known = identity.latest(done.documents)
    again = ingest(files(spark, FILES), known, done.chunks, done.memo, mode=mode, max_bytes=60, decoders={"pdf": pdf})
    assert again.chunks.count() == 0 and again.memo.count() == 0 and again.documents.count() == 0


def test_two_files_of_one_name_are_kept_apart(spark, empty):
    contents = [b"tree,height\noak,21\n", b"bird,nest\nstork,chimney\nswift,roof\n", b"tree,height\noak,21\n"]
    rows = [("list.csv", len(c), bytearray(c)) for c in contents]
    done = ingest(spark.createDataFrame(rows, "file_name string, length long, content binary").repartition(2), *empty)
    texts = sorted(r.chunk_text for r in done.chunks.collect())
    assert texts == ["bird: stork; nest: chimney", "bird: swift; nest: roof", "tree: oak; height: 21"]
    assert done.documents.count() == 1 and done.report.first().chunks_stored == 4


def test_an_edited_document_is_retrieved_by_version(spark, empty):
    first = ingest(files(spark, {"list.csv": b"tree,height\noak,21\nelm,17\n"}), *empty)
    edited = files(spark, {"list.csv": b"tree,height\noak,22\nelm,18\n"})
    stored = first.chunks.cache()
    second = ingest(edited, first.documents, stored, first.memo)
    chunks = stored.unionByName(second.chunks).cache()
    assert chunks.count() == 4
    asked = embedding.embed(spark.createDataFrame([("q", "default", None, "How high is the oak?")], "query_id string, tenant_id string, document_id string, question string"), "question", "query")
    hits = retrieval.retrieve(asked, chunks, second.documents, 4).collect()
    assert sorted(r["rank"] for r in hits) == [1, 2, 3, 4] and len({r.chunk_text for r in hits}) == 4


def test_rejects_by_size_do_not_read_bytes(spark, empty, tmp_path):
    (tmp_path / "big.csv").write_bytes(b"a,b\n" + b"1,2\n" * 100)
    (tmp_path / "small.csv").write_bytes(b"a,b\n1,2\n")
    done = ingest(fs.scan_folder(spark, str(tmp_path)), *empty, max_bytes=100)
    sized = done.rejects.where("reason = 'too_large'")
    assert [r.source_uri for r in sized.collect()] == ["big.csv"] and done.chunks.count() == 1
    # bytes are read by a step of their own, which is above the filter on the length
    plan = done.rejects._jdf.queryExecution().optimizedPlan().toString()
    named = plan.split("Union")[1].split("LogicalRDD")[0]
    assert "MapInArrow" not in plan.splitlines()[1] and "too_large" in named


def test_large_csv_through_ingest(spark, empty, tmp_path):
    """A folder read in tiny splits gives what its files give at hand, quoted line breaks and hidden names included."""
    rows = "".join(f'{i},"oak {i},\nwith ""leaves""",{i % 7}\n' for i in range(200))
    contents = {"big.csv": b"id,tree,n\n" + rows.encode(), "_hidden.csv": b"a,b\n1,2\n", "bad.csv": b"a,b\n" + b"1,2\n" * 50 + b"x\ry\n" + b"1,2\n" * 50, **FILES}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    at_hand = ingest(files(spark, contents), *empty, mode="folder", decoders={"pdf": pdf})
    split = ingest(fs.scan_folder(spark, str(tmp_path)), *empty, mode="folder", decoders={"pdf": pdf}, split_bytes=100)
    key = ["document_id", "chunk_index", "chunk_text", "chunk_type"]
    want = sorted(map(tuple, at_hand.chunks.select(key).collect()))
    assert sorted(map(tuple, split.chunks.select(key).collect())) == want and len(want) > 200
    assert sorted(map(tuple, split.rejects.collect())) == sorted(map(tuple, at_hand.rejects.collect()))
    columns = ["document_id", "source_uri", "checksum"]
    assert sorted(map(str, split.documents.select(columns).collect())) == sorted(map(str, at_hand.documents.select(columns).collect()))


def test_size_cap_applies_to_uploads_only(spark, empty):
    big = {"big.csv": b"a,b\n" + b"1,2\n" * 50}
    done = ingest(files(spark, big), *empty, mode="upload", max_bytes=100)
    assert [r.reason for r in done.rejects.collect()] == ["too_large"] and done.documents.count() == 0
    assert ingest(files(spark, big), *empty, mode="folder", max_bytes=100).report.first().chunks_stored == 50


def test_known_documents_keep_their_id(spark, empty):
    known = spark.createDataFrame([("legacy-id", "default", "url", "trees.csv", "old", None, 0)], DOCUMENTS)
    done = ingest(files(spark, {"trees.csv": FILES["trees.csv"]}), known, *empty[1:])
    assert {r.document_id for r in done.chunks.collect()} == {"legacy-id"}
    row = done.documents.first()
    assert row.document_id == "legacy-id" and row.checksum != "old" and row.version == 1


def test_ask(spark, empty):
    done = ingest(files(spark, FILES), *empty, decoders={"pdf": pdf})
    chunks, documents = done.chunks.cache(), done.documents.cache()
    document = {r.source_uri: r.document_id for r in documents.collect()}
    questions = spark.createDataFrame(
        [
            ("1", 0, "default", document["trees.csv"], "n", "How high is the elm?"),
            ("2", 1, "default", document["trees.csv"], "n", "boom"),
            ("3", 2, "default", document["trees.csv"], "n", "   "),
            ("4", 3, "default", "unknown-document", "n", "Anything?"),
            ("5", 4, "default", None, "n", "one page about storks in spring"),
            ("6", 5, "default", None, "n", "stored question"),
            ("7", 6, "default", document["trees.csv"], "n", "How high is the elm?"),
        ],
        "query_id string, pos int, tenant_id string, document_id string, namespace string, question string",
    )
    stored = spark.createDataFrame([("n", "stored question")], "n string, q string").select(
        ans.memo_key(F.col("n"), F.col("q")).alias("memo_key"),
        F.lit("from memo").alias("answer"),
        ans.no_sources().alias("sources"),
        F.lit(True).alias("low_confidence"),
    )

    def answerer(question, context, prompt):
        if question == "boom":
            raise RuntimeError()
        return (context or "invented words everywhere", 7, 3)

    result = ask(questions, chunks, documents, stored, answerer, load=HashEncoder)
    rows = {r.query_id: r for r in result.responses.collect()}
    assert {q: r.status for q, r in rows.items()} == {
        "1": "ok", "2": "error", "3": "blank", "4": "no_context", "5": "ok", "6": "memo", "7": "ok"
    }
    assert [r.pos for r in sorted(rows.values(), key=lambda r: r.query_id)] == list(range(7))
    assert rows["1"].answer == rows["7"].answer and len(rows["1"].sources) == 2
    assert {s.document_id for s in rows["1"].sources} == {document["trees.csv"]}
    assert rows["5"].sources[0].source_uri == "pages.pdf"
    assert rows["2"].sources == [] and rows["4"].low_confidence and rows["6"].answer == "from memo"
    assert result.memo.count() == 3
    assert tuple(result.usage.first()) == (21, 9, 30, 3)


def test_write_and_read_tables(spark, empty, tmp_path):
    done = ingest(files(spark, FILES), *empty, decoders={"pdf": pdf})
    tables.write_chunks(done.chunks, str(tmp_path / "chunks"))
    tables.write_documents(done.documents, str(tmp_path / "documents"))
    back = tables.read_chunks(spark, str(tmp_path / "chunks"))
    columns = ["document_id", "tenant_id", "chunk_index", "chunk_text", "text_hash", "embedding"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, done.chunks.select(columns).collect()))
    assert os.path.isdir(tmp_path / "chunks" / "tenant_id=default")
    assert tables.read_documents(spark, str(tmp_path / "documents")).count() == done.documents.count()


def test_deletions_apply_to_what_was_written_before(spark, tmp_path):
    def rows(text):
        made = [(f"d{i}", "tu"[i % 2], 0, f"{text} {i}") for i in range(6)]
        frame = spark.createDataFrame(made, "document_id string, tenant_id string, chunk_index int, chunk_text string")
        return store.evolve(frame.withColumn("text_hash", F.sha2("chunk_text", 256)).withColumn("chunk_type", F.lit("x")), CHUNKS)

    def live(path=None):
        return sorted((r.document_id, r.chunk_text) for r in tables.read_chunks(spark, path or str(tmp_path / "c")).collect())

    path, pairs = str(tmp_path / "c"), "document_id string, tenant_id string"
    tables.write_chunks(rows("old"), path, bucketed=True)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}
    tables.delete_documents(spark.createDataFrame([("d0", "t"), ("d1", "t"), ("d2", "t"), ("d0", "t")], pairs), path)
    assert live() == [("d1", "old 1"), ("d3", "old 3"), ("d4", "old 4"), ("d5", "old 5")]  # d1 is another tenant's
    tables.write_chunks(rows("new").where("document_id IN ('d0', 'd4')"), path, bucketed=True)
    assert ("d0", "new 0") in live() and ("d0", "old 0") not in live() and ("d4", "old 4") in live()
    tables.delete_documents(spark.createDataFrame([("d4", "t"), ("d0", "t")], pairs), path)
    tables.write_chunks(rows("third").where("document_id = 'd0'"), path, bucketed=True)
    want = [("d0", "third 0"), ("d1", "old 1"), ("d3", "old 3"), ("d5", "old 5")]
    assert live() == want
    assert {f: os.stat(f).st_mtime_ns for f in before} == before  # nothing was written again
    tables.compact_chunks(spark, path, str(tmp_path / "compact"))
    assert live(str(tmp_path / "compact")) == want and not os.path.exists(tmp_path / "compact.deleted")
    assert len(spark.read.parquet(str(tmp_path / "compact")).collect()) == 4


def test_stream_equals_batch(spark, empty, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    path = str(tmp_path / "store")
    seen = []

    def read_store():
        if not os.path.exists(path):
            return empty
        read = [spark.read.parquet(f"{path}/{name}/*") for name in ("documents", "chunks", "memo")]
        return identity.latest(read[0]), *read[1:]

    def save(done, number):
        seen.append(number)
        for name in ("documents", "chunks", "memo"):
            getattr(done, name).write.mode("overwrite").parquet(f"{path}/{name}/{number:05d}")

    def trigger():
        stream = file_stream(spark, str(folder), 3)
        ingest_stream(stream, read_store, save, str(tmp_path / "state"), mode="upload", decoders={"pdf": pdf}).awaitTermination(240)

    def put(content):
        for name, data in content.items():
            (folder / name).write_bytes(data)
        time.sleep(1.2)

    names = list(FILES)
    put({n: FILES[n] for n in names[:4]})
    trigger()
    edited = {"trees.csv": b"tree,height\noak,22\nelm,17\n", "_hidden.csv": b"a,b\n1,2\n"}
    put({**{n: FILES[n] for n in names[3:]}, **edited, "other.csv": FILES["other.csv"]})  # the last one only touched
    trigger()
    trigger()  # nothing changed
    assert seen == [0, 1] or seen == [0, 1, 2]
    first = ingest(files(spark, FILES), *empty, decoders={"pdf": pdf})
    stored = first.chunks.cache()
    second = ingest(files(spark, edited), identity.latest(first.documents), stored, first.memo)
    key = ["document_id", "chunk_index", "chunk_text"]
    documents, chunks, _ = read_store()
    batch = stored.unionByName(second.chunks)
    assert sorted(map(tuple, chunks.select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))
    want = identity.latest(first.documents.unionByName(second.documents)).select("source_uri", "checksum", "version")
    assert sorted(map(str, documents.select("source_uri", "checksum", "version").collect())) == sorted(map(str, want.collect()))
    assert documents.where("source_uri = 'trees.csv'").first().version == 1


def test_state_lets_edits_through_only(spark, tmp_path):
    folder, got = tmp_path / "in", []
    folder.mkdir()

    def trigger(content):
        for name, data in content.items():
            (folder / name).write_bytes(data)
        time.sleep(1.2)
        stream = file_stream(spark, str(folder), 2)
        each_batch(stream, lambda batch, number: got.append(sorted(r.file_name for r in batch.collect())), str(tmp_path / "s")).awaitTermination(120)

    trigger({"a": b"1", ".b": b"2", "c": b""})
    trigger({"a": b"1", ".b": b"3"})
    trigger({"a": b"4", ".b": b"3", "c": b""})
    assert [b for b in got if b] == [[".b", "a", "c"], [".b"], ["a"]]
