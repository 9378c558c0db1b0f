from pyspark.sql import functions as F

from doclake.operators import identity, membership, store
from doclake.operators.hotjoin import hot_keys, join_unique
from doclake.operators.ranking import dense_position
from doclake.schemas import CHUNKS

DOCS = "document_id string, tenant_id string, source_type string, source_uri string, checksum string, created_at timestamp"
INCOMING = "tenant_id string, source_uri string, source_type string, checksum string, seq int"


def test_get_or_create(spark):
    existing = spark.createDataFrame([("old", "t", "url", "a", "c0", None, None), ("kept", "t", "url", "z", "cz", None, 0)], f"{DOCS}, version int")
    incoming = spark.createDataFrame(
        [("t", "a", "upload", "c1", 1), ("t", "a", "upload", "c2", 2), ("t", "a", "upload", None, 3), ("t", "b", "upload", None, 4), ("u", "a", "file", "x", 5)],
        INCOMING,
    )
    rows = {(r.tenant_id, r.source_uri): r for r in identity.get_or_create(existing, incoming).collect()}
    assert rows["t", "a"].document_id == "old" and rows["t", "a"].checksum == "c2" and not rows["t", "a"].is_new
    assert rows["t", "a"].source_type == "url"
    assert rows["t", "b"].checksum is None and rows["t", "b"].is_new and rows["t", "b"].created_at is not None
    assert rows["u", "a"].document_id not in ("old", rows["t", "b"].document_id)
    delta = identity.register(existing, incoming).cache()
    key = ["document_id", "tenant_id", "source_uri", "checksum", "version"]
    # "a" of "t" is known and changed, the others are new; "z" is not written again
    assert sorted((r.tenant_id, r.source_uri, r.version) for r in delta.collect()) == [("t", "a", 1), ("t", "b", 0), ("u", "a", 0)]
    versions = existing.unionByName(delta)
    after = identity.latest(versions)
    assert sorted((r.source_uri, r.checksum) for r in after.collect() if r.tenant_id == "t") == [("a", "c2"), ("b", None), ("z", "cz")]
    assert identity.register(after, incoming).count() == 0  # nothing new
    replayed = identity.latest(versions.unionByName(delta))
    assert sorted(map(str, replayed.select(key).collect())) == sorted(map(str, after.select(key).collect()))
    third = identity.register(after, spark.createDataFrame([("t", "a", "url", "c9", 1), ("t", "b", "url", "", 1)], INCOMING))
    assert [(r.document_id, r.checksum, r.version, r.source_type) for r in third.collect()] == [("old", "c9", 2, "url")]


def test_empty_checksum_does_not_replace(spark):
    existing = spark.createDataFrame([("old", "t", "url", "a", "c0", None)], DOCS)
    incoming = spark.createDataFrame([("t", "a", "url", "", 1)], INCOMING)
    assert identity.get_or_create(existing, incoming).first().checksum == "c0"
    assert identity.refresh_checksums(existing, incoming).first().checksum == "c0"


def chunk_rows(spark, rows):
    df = spark.createDataFrame(rows, "document_id string, chunk_index int, chunk_text string")
    return df.withColumn("text_hash", F.sha2("chunk_text", 256)).withColumn("tenant_id", F.lit("t"))


def test_upsert_is_per_document_and_idempotent(spark):
    clause = "Section 12: Force majeure clause applies to natural disasters."
    chunks = chunk_rows(spark, [("a", 0, clause), ("a", 1, "x"), ("a", 2, clause), ("b", 0, clause)])
    empty = chunks.limit(0)
    first = store.new_chunks(chunks, empty)
    assert sorted((r.document_id, r.chunk_index) for r in first.collect()) == [("a", 0), ("a", 1), ("b", 0)]
    assert store.new_chunks(chunks, first).count() == 0
    counts = {r.document_id: (r.parsed, r.inserted, r.skipped) for r in store.upsert_counts(chunks, empty).collect()}
    assert counts == {"a": (3, 2, 1), "b": (1, 1, 0)}
    counts = {r.document_id: (r.parsed, r.inserted, r.skipped) for r in store.upsert_counts(chunks, first).collect()}
    assert counts == {"a": (3, 0, 3), "b": (1, 0, 1)}
    assert store.duplicate_keys(first).count() == 0 and store.duplicate_keys(chunks).first().copies == 2
    stored = {r.document_id: r.chunks_stored for r in store.chunks_stored(chunks).collect()}
    assert stored == {"a": 3, "b": 1}


def test_ties_and_missing_indexes(spark):
    chunks = chunk_rows(spark, [("a", 3, "x"), ("a", 3, "x"), ("a", None, "y"), ("a", None, "y"), ("a", 5, "y"), ("b", None, "x")])
    got = store.first_occurrences(chunks.repartition(3))
    assert sorted(map(str, got.select("document_id", "chunk_text", "chunk_index").collect())) == sorted(
        f"Row(document_id={d!r}, chunk_text={t!r}, chunk_index={i})" for d, t, i in [("a", "x", 3), ("a", "y", 5), ("b", "x", None)]
    )
    assert got.columns == chunks.columns
    assert store.first_occurrences(chunks.limit(0)).count() == 0


def test_the_store_is_cut_down_before_the_shuffle(spark, tmp_path):
    stored = spark.range(40_000).selectExpr("concat('d', id % 500) AS document_id", "sha2(cast(id AS string), 256) AS text_hash", "'t' AS tenant_id")
    stored.write.partitionBy("tenant_id").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    batch = chunk_rows(spark, [(f"d{i % 500}", i, str(i)) for i in range(0, 40_000, 400)] + [(f"n{i}", 0, "new") for i in range(50)])
    traffic = store.store_traffic(batch, stored).first()
    assert (traffic.stored, traffic.held) == (40_000, 100) and 100 <= traffic.shuffled < 120
    added = store.new_chunks(batch, stored)
    assert sorted(r.document_id for r in added.collect()) == sorted(f"n{i}" for i in range(50))


def test_hash_aggregates_only(spark, tmp_path):
    chunk_rows(spark, [("a", 0, "x"), ("b", 0, "x"), ("c", 0, "y")]).write.parquet(str(tmp_path / "b"))
    batch = spark.read.parquet(str(tmp_path / "b"))
    rows, first = store._first_rows(batch, True)
    near = store.stored_near(batch, first)
    for frame in (first.join(near, store.CHUNK_KEY, "left_anti"), store.new_chunks(batch, batch.limit(0), at_rest=True)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan
        exchanges = [line for line in plan.splitlines() if "Exchange" in line]
        assert "chunk_text" not in "".join(exchanges)


def test_filter_has_no_false_negatives_and_a_bounded_size(spark):
    keys = spark.range(5000).selectExpr("cast(id * 7 AS string) AS k")
    table = spark.range(100_000).selectExpr("cast(id AS string) AS k", "id")
    for words in (64, 1 << 12, 1 << 18):
        assert membership.filter_of(keys, ["k"], words).count() <= words
        passed = membership.may_hold(table, keys, ["k"], words)
        assert passed.columns == table.columns
        assert passed.join(keys, "k", "left_semi").count() == 5000
    assert passed.count() < 5600
    assert membership.may_hold(table, keys.limit(0), ["k"]).count() == 0


def test_delete_checks_the_tenant(spark):
    table = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "u")], "document_id string, tenant_id string")
    doomed = spark.createDataFrame([("a", "t"), ("c", "t")], "document_id string, tenant_id string")
    assert sorted(r.document_id for r in store.without_documents(table, doomed).collect()) == ["b", "c"]


def test_migration(spark):
    legacy = spark.createDataFrame(
        [(i, "n" if i % 2 else "m", f"t{i}", None, 7 if i in (3, 8) else None) for i in range(40)] + [(99, None, "t", None, None)],
        "id long, document_name string, chunk_text string, document_id string, chunk_index int",
    )
    evolved = store.evolve(legacy, CHUNKS)
    assert evolved.where("tenant_id <> 'default' OR chunk_type <> 'paragraph'").count() == 0
    documents = spark.createDataFrame([("default", "m")], "tenant_id string, source_uri string")
    assert [r.source_uri for r in store.backfilled_documents(legacy, documents).collect()] == ["n"]
    rows = store.with_chunk_index(store.with_document_id(legacy), block=4).collect()
    assert {r.id: r.chunk_index for r in rows if r.id in (3, 8, 99)} == {3: 7, 8: 7, 99: None}
    for name, filled in (("n", [i for i in range(1, 40, 2) if i != 3]), ("m", [i for i in range(0, 40, 2) if i != 8])):
        assert {r.id: r.chunk_index for r in rows if r.document_name == name and r.id in filled} == {i: n for n, i in enumerate(filled)}
    orphans = spark.createDataFrame([("x",), ("y",)], "document_id string")
    assert [r[0] for r in store.orphan_chunks(orphans, orphans.where("document_id = 'x'")).collect()] == ["y"]
    assert store.cleared(legacy).count() == 0 and store.total_chunks(legacy).first()[0] == 41


def test_dense_position_with_one_key_holding_most_rows(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 7)) AS k", "cast(id AS int) AS o")
    got = {(r.k, r.o): r.p for r in dense_position(rows, ["k"], ["o"], "p", block=50).collect()}
    seen = {}
    for k, o in sorted(got, key=lambda x: x[1]):
        assert got[k, o] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1
    assert len(got) == 3000


def test_hot_keys_are_bounded_and_joined_once(spark):
    left = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id)) AS k")
    right = left.groupBy("k").agg(F.min("id").alias("first"))
    assert [(r.k, r._salts) for r in hot_keys(left, "k", 500).collect()] == [("hot", 4)]
    rows = join_unique(left, right.where("k <> 'k1'"), "k", ["id"], 500).collect()
    assert len(rows) == 5000
    assert all(r.first == (0 if r.k == "hot" else None if r.k == "k1" else r.id) for r in rows)
