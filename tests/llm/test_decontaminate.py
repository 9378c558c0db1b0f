"""Contaminated documents against brute force over all windows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from doclake.llm import decontaminate as dc


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def brute(docs, items, least=0.8):
    best = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not v or not w:
                continue
            for s in range(max(0, len(w) - len(v)) + 1):
                a, b = grams(w[s : s + len(v)]), grams(v)
                share = sum((a & b).values()) / sum((a | b).values())
                if share >= least and (d, i) not in best or share > best.get((d, i), (9,))[0]:
                    best[d, i] = (share, s)
    return best


def cases():
    rng = random.Random(8)
    draw = lambda n: [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(n)]
    items = [(k, " ".join(draw(n))) for k, n in enumerate([40, 25, 60, 12, 5])]
    items += [(5, "one two"), (6, "Solo"), (7, ""), (8, None), (9, "ha " * 30), (10, items[0][1]), (11, " ".join(draw(200)))]
    docs = []
    for k, text in items:
        w = (text or "").split()
        docs.append((100 + k, " ".join(draw(50) + w + draw(30))))
        docs.append((200 + k, " ".join(w)))
        docs.append((300 + k, ", ".join(w[1:] + ["END"]).upper()))
        docs.append((400 + k, " ".join(draw(9) + w[: len(w) // 2] + ["x"] + w[len(w) // 2 :] + draw(3))))
        docs.append((500 + k, " ".join(draw(4) + w[: len(w) * 2 // 3] + draw(40))))
        docs.append((600 + k, " ".join(w[:-1])))
    docs += [(1, None), (2, ""), (3, " .,!"), (4, " ".join(draw(400))), (5, "ha " * 29), (6, "solo"), (100, "again")]
    return docs, items


def test_against_all_windows(spark):
    docs, items = cases()
    frame = spark.createDataFrame([(*r, 1, 1) for r in docs], "doc_id long, text string, item_id int, start int").repartition(3)
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, words int")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in dc.contaminated(frame, bench).collect()}
    want = brute(docs, items)
    assert {k: round(v[0], 9) for k, v in got.items()} == {k: round(v[0], 9) for k, v in want.items()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    kept = dc.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    leaked = {d for d, _ in want}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in leaked)


def test_parts_of_the_benchmark(spark, monkeypatch):
    docs, items = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items[:5], "item_id long, text string")
    whole = sorted(map(tuple, dc.contaminated(frame, bench).collect()))
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 1000)
    assert sorted(map(tuple, dc.contaminated(frame, bench).collect())) == whole


def test_one_part_of_the_benchmark_is_held(spark, monkeypatch):
    docs, items = cases()
    copies = [(100 + k, text) for k, text in items[:5]]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items[:5] + copies, "item_id long, text string")
    assert dc.prepare_items(bench)[0].count() == 5
    want = {(*key, round(v[0], 9), v[1]) for key, v in brute(docs, items[:5] + copies).items()}
    for rows in (1000, 50):
        monkeypatch.setattr(dc, "BROADCAST_ROWS", rows)
        found = dc.contaminated(frame, bench)
        assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") < 3
        got = [(r.doc_id, r.item_id, round(r.similarity, 9), r.start) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("most", [100, 1000])
def test_fingerprint(spark, most):
    rng = random.Random(1)
    rows = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 26, 55, 100)]
    frame = spark.createDataFrame([(r,) for r in rows], "marks array<long>")
    for row in frame.select("marks", dc.fingerprint(F.col("marks"), most).alias("fp")).collect():
        want = sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in row.marks) > len(row.marks))
        assert row.fp & (2**64 - 1) == want


def test_empty(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert dc.contaminated(docs.where("false"), bench).count() == 0
    assert dc.contaminated(docs, bench.where("false")).count() == 0
    assert dc.drop_contaminated(docs, bench.where("false")).count() == 1


def test_rows_and_items_without_ids(spark):
    draw = lambda seed: " ".join(f"w{(seed * 7 + i) % 61}" for i in range(30))
    items = [(None, draw(1), "x"), (None, draw(3), "x"), (7, draw(5), "x"), (7, draw(9), "x")]
    docs = [(None, f"a b {draw(1)} c", "x"), (None, draw(9), "x"), (None, "clean words", "x"), (None, None, "x"), (1, draw(3), "x"), (2, "so so", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, gone_key string").selectExpr("*", "text AS text_key", "text AS fp")
    bench = spark.createDataFrame(items, "item_id long, text string, item string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in dc.contaminated(frame, bench).collect())
    assert got == [("1", "None"), ("None", "7"), ("None", "None")]
    kept = dc.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(
        f"Row(doc_id={i}, text={t!r})" for i, t in [(None, "clean words"), (None, None), (2, "so so")]
    )


def test_no_python_in_the_plan(spark):
    docs, items = cases()
    found = dc.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
