"""Removal of repeated windows against brute force."""

import hashlib
import random
import re

import pytest

from doclake.llm import substrings

WIDTH = 50


def brute(rows):
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - WIDTH + 1):
            key = tuple(words[k : k + WIDTH])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - WIDTH + 1):
            if i is not None and first[tuple(words[k : k + WIDTH])] < i:
                gone.update(range(k, k + WIDTH))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    draw = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(n))
    passage, hot = draw(73), draw(50)
    rows = [(i, draw(rng.randint(0, 160))) for i in range(100, 130)]
    rows += [(i, draw(20) + "\n" + hot + "\t" + draw(9)) for i in range(200, 230)]
    rows += [(3, draw(60) + " " + passage), (7, passage + " " + draw(70)), (5, passage[3:]), (8, passage + " " + passage)]
    rows += [(11, passage), (12, passage.replace(" ", "\n")), (12, passage), (13, draw(49)), (14, rows[0][1])]
    rows += [(20, "x " * 300), (21, "x " * 120), (22, "x " * 49), (23, None), (24, ""), (25, " \n"), (None, passage)]
    rows += [(30, hot[: len(hot) // 2]), (31, rows[2][1]), (31, draw(80)), (40, "É\x1cb c\x85d " * 40), (41, "É\x1cb c\x85d " * 40)]
    # rows of one id are judged each by its own text, whatever the other one loses
    rows += [(50, passage), (51, draw(60) + " " + passage), (51, draw(121)), (51, draw(30) + " " + hot), (51, draw(121))]
    return rows


@pytest.mark.parametrize("slice_bytes", [1 << 20, 150])
def test_against_brute_force(spark, monkeypatch, slice_bytes):
    rows = corpus()
    if slice_bytes < 1000:  # long texts are read in slices: the walk over windows must not notice
        from doclake.llm import pieces

        monkeypatch.setattr(pieces, "SLICE_BYTES", slice_bytes)
        for _, text in rows:
            words = (text or "").encode().split()
            seen = [(at + k, tuple(w[k : k + 50])) for at, w in substrings.overlapping(text, 50) for k in range(len(w) - 49)]
            assert seen == [(k, tuple(words[k : k + 50])) for k in range(len(words) - 49)]
        return
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, digest int")
    docs = docs.selectExpr("*", "digest AS row", "digest AS _owner", "digest AS marks").repartition(4)
    got = sorted((tuple(r) for r in substrings.remove_repeats(docs).collect()), key=str)
    assert got == brute(rows)


def test_lengths():
    assert substrings.lengths(50) == [13, 25, 50]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(docs).count() == 0
