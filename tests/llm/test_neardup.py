"""Fingerprints, links and components against brute force."""

import numpy as np
import pytest
import xxhash

from doclake.llm import components, neardup


def brute_fingerprint(text):
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    marks = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in marks) > len(marks))


def brute_components(fps, radius):
    """Smallest index reachable from each."""
    fps = np.asarray(fps, np.uint64)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    while True:
        new = np.array([label[row].min() for row in near])
        if np.array_equal(new, label):
            return label
        label = new


def clouds(n, seed):
    """Random fingerprints, chains of close ones and a dense ball."""
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 2**64, n, dtype=np.uint64)
    for i in range(0, n - 1, 3):
        fps[i + 1] = fps[i]
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            fps[i + 1] ^= np.uint64(1) << np.uint64(b)
    ball = np.repeat(fps[:1], n // 4)
    for i in range(len(ball)):
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            ball[i] ^= np.uint64(1) << np.uint64(b)
    return np.unique(np.concatenate([fps, ball]))


TEXTS = [
    None,
    "",
    " \n\t",
    "One",
    "one",
    "ONE two",
    "a b c d",
    "a b c d e",
    "Äpfel É \x1c x\x85y",
    "the same words again " * 40,
    "The SAME words again " * 40 + "end",
    "lone text with quite other words in it for once",
    "long " * 20000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(10 + i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(10, None, 1, "x"), (None, "One", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string").repartition(3)


def test_fingerprints():
    for text in TEXTS:
        assert neardup.simhash(text) & (2**64 - 1) == brute_fingerprint(text), text


@pytest.mark.parametrize("groups", [1, 2, 3, 5, None])
@pytest.mark.parametrize("levels", [0, 2, 5, 9, 14])
def test_close_pairs_meet_in_a_shard(levels, groups):
    """One of the two is at home there."""
    fps = clouds(300, levels)
    seen, near = np.zeros((len(fps), len(fps)), bool), np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    for ladder in neardup.ladders(levels, 4, groups):
        which, shard, spent = neardup.visits(fps, *neardup.upper_tree(fps[::3], ladder.masks, levels), ladder)
        assert sorted(which[spent == 0]) == list(range(len(fps)))
        for at in np.unique(shard):
            here = shard == at
            seen[np.ix_(which[here & (spent == 0)], which[here])] = True
    assert not (near & ~(seen | seen.T)).any()


@pytest.mark.parametrize("levels", [4, 8, 12])
def test_visits_do_not_grow_with_the_shards(levels):
    fps = np.random.default_rng(levels).integers(0, 2**64, 60_000, dtype=np.uint64)
    visits = 0
    for ladder in neardup.ladders(levels, 4):
        which, shard, spent = neardup.visits(fps, *neardup.upper_tree(fps, ladder.masks, levels), ladder)
        visits += len(which)
        assert np.bincount(shard[spent == 0]).max() < 4 * len(fps) / 2**levels
    assert visits == 5 * len(fps)


@pytest.mark.parametrize("rows", [3, 100, 700, 4000])
def test_link_shard(rows):
    fps = np.random.default_rng(rows).permutation(clouds(rows, rows))
    home = np.arange(len(fps)) % 4 > 0
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4) & (home[:, None] | home[None, :])
    label = np.arange(len(fps))
    while not np.array_equal(label, new := np.where(near, label[None, :], len(fps)).min(1).clip(max=label)):
        label = new
    got = neardup.link_shard(fps, home, 4)
    assert len(set(zip(got, label))) == len(set(got)) == len(set(label))


@pytest.mark.parametrize("rows,shard", [(90, 8), (300, 100), (900, 40), (900, 5000)])
def test_links_against_all_pairs(spark, rows, shard):
    fps = clouds(rows, rows + shard)
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = components.components(neardup.links(frame, 4, shard)).collect()
    label = {r.node: r.label for r in got}
    want = brute_components(fps, 4)
    groups = {}
    for f, w in zip(fps.view(np.int64).tolist(), want):
        groups.setdefault(w, set()).add(label.get(f, f))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_near_duplicates(docs):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for t in TEXTS]
    label = brute_components(fps, 4)
    want = {(10 + i, f"{f:016x}", 10 + int(w)) for i, (f, w) in enumerate(zip(fps, label))}
    want.add((None, f"{fps[3]:016x}", 10 + int(label[3])))
    assert got == want


def test_keep_one(docs):
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    label = brute_components([brute_fingerprint(t) for t in TEXTS], 4)
    firsts = sorted({10 + int(w) for w in label})
    assert sorted(i for i in ids if i is not None) == sorted([*firsts, 10]) and None not in ids


def test_keep_one_without_ids(spark):
    """Rows without id go with a document that has one, and stay if none has."""
    rows = [(None, "One", "x"), (None, "a row of its own", "x"), (None, "a row of its own", "x"), (4, "one", "x"), (9, "ONE", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_key string").selectExpr("*", "text AS text_key", "1 AS fp")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("4", "one")] + [("None", "a row of its own")] * 2


def test_long_list_of_what_goes(spark, docs, monkeypatch):
    from doclake.llm import common

    short = sorted(map(str, neardup.keep_one(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert sorted(map(str, neardup.keep_one(docs).collect())) == short


def test_empty(docs):
    assert neardup.near_duplicates(docs.where("false")).count() == 0
    assert neardup.keep_one(docs.where("false")).count() == 0


def test_components_of_path_and_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 200)] + [(7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(path, "node long, near long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 200)}}
