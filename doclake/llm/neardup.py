"""Near-duplicate documents: SimHash fingerprints, linked exactly through vantage-point trees.

A tree parts fingerprints by their Hamming distance from a vantage point. Level ``i`` measures that
distance on its own slice of the bits. For a fingerprint to be within the radius of something on the
other side of a split, it must at least make up its distance from the split; as slices share no bits,
these shortfalls add up along the path, and a branch is pruned once their sum exceeds the radius (the
triangle inequality, summed over the slices). The upper levels, built from a bounded sample, part the
corpus into shards: a fingerprint is at home in one and asks those shards that its ball overlaps. Each
shard then searches a tree of its own. What depends on the sample is the balance, not the result.

The more levels, the narrower their slices and the more shards a ball overlaps. So beyond a few levels there
is a tree for each of ``radius + 1`` groups of bits: two fingerprints within the radius agree on one group, and
the tree of that group need not look beyond a split at all. A fingerprint then visits ``radius + 1`` shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from doclake.llm.common import keyed_sample, staged, text_key, without
from doclake.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints that choose the vantage points of the upper levels.
SAMPLE = 20_000
#: Fingerprints at home in one task: a 64th of all within these bounds; a shard with more than twice as
#: many is parted again.
SHARD_LEAST, SHARD_MOST = 1 << 15, 1 << 20
LEAF = 64
#: Up to so many levels one tree over all bits costs least, beyond them one for each group of bits; the links
#: are the same.
SINGLE_LEVELS = 3
_ALL = (1 << 64) - 1
#: Cells of one comparison of fingerprints.
_CELLS = 1 << 21


# --- fingerprints ---


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text, as a signed number."""
    from functools import partial

    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    hashed = partial(xxhash.xxh64_intdigest, seed=seed)
    if len(words) < shingle:
        grams, n = iter([b" ".join(words)]), 1
    else:
        grams, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for begin in range(0, n, 1 << 14):
        some = min(1 << 14, n - begin)
        marks = np.fromiter(map(hashed, grams) if n == some else _take(map(hashed, grams), some), np.uint64, some)
        counts += np.unpackbits(marks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def _take(items: Iterator, n: int) -> Iterator:
    from itertools import islice

    return islice(items, n)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``text_key`` and ``fp`` of every row; a null or wordless text has fingerprint 0."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            marks = pa.array([simhash(text.as_py(), shingle, seed) for text in batch.column(1)], pa.int64())
            columns = [batch.column(0), batch.column(2), marks]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "fp"])

    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("doc_id"), F.col("text")).alias("text_key")
    )
    return read.mapInArrow(run, "doc_id long, text_key string, fp long")


# --- trees ---


class Ladder(NamedTuple):
    """What each level of a tree measures on, and the bits that may be spent down to it."""

    masks: np.ndarray
    budgets: np.ndarray


def ladders(levels: int, radius: int, groups: int | None = None) -> list[Ladder]:
    """The trees, one for each of ``groups`` groups of bits, that together meet all pairs within ``radius``.

    Such a pair differs in at most ``radius // groups`` bits of one group. The tree of that group measures on
    it first, allowing so many bits, and on the other bits below, allowing the whole radius. With more groups
    than ``radius`` the first levels allow none: each tree is visited in one place, however many there are.
    """
    if groups is None:
        groups = 1 if levels <= SINGLE_LEVELS else min(64, radius + 1)
    trees = []
    for begin, end in ((64 * i // groups, 64 * (i + 1) // groups) for i in range(groups)):
        first = min(levels, end - begin)
        order = np.roll(np.arange(64), -begin).tolist()
        own, others = order[: end - begin], order[end - begin :]
        rest = min(levels - first, len(others))
        masks = _slices(own, first) + _slices(others, rest)
        trees.append(Ladder(np.array(masks, np.uint64), np.array([radius // groups] * first + [radius] * rest)))
    return trees


def _slices(bits: list[int], levels: int) -> list[int]:
    """A slice for each level, the wider the better it prunes; an odd number of bits parts evenly."""
    width = min(31, len(bits) // max(1, levels) - 1 | 1)
    return [sum(1 << b for b in bits[width * i : width * (i + 1)]) for i in range(levels)]


def _distance(marks: np.ndarray, point, mask) -> np.ndarray:
    return np.bitwise_count((marks ^ point) & mask).astype(np.int16)


def _split(marks: np.ndarray, mask) -> tuple[np.uint64, int] | None:
    """A vantage point and the distance that parts ``marks`` most evenly; None if none does."""
    point = marks[len(marks) // 2]
    sizes = np.cumsum(np.bincount(_distance(marks, point, mask)))
    at = int(np.argmin(np.abs(2 * sizes - len(marks))))
    return (point, at) if sizes[at] < len(marks) else None


def upper_tree(sample: np.ndarray, masks: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and splits of a complete tree in heap order."""
    points, cuts = np.zeros(2**levels - 1, np.uint64), np.zeros(2**levels - 1, np.int16)
    inside = {0: sample}
    for node in range(2**levels - 1):
        marks, mask = inside.pop(node), masks[int(math.log2(node + 1))]
        points[node], cuts[node] = (len(marks) and _split(marks, mask)) or (0, int(mask).bit_count() // 2)
        left = _distance(marks, points[node], mask) <= cuts[node]
        inside[2 * node + 1], inside[2 * node + 2] = marks[left], marks[~left]
    return points, cuts


def visits(marks: np.ndarray, points, cuts, ladder: Ladder):
    """Shards to visit: (index into ``marks``, shard, bits spent on the way); spent 0 is the home.

    Of two shards that overlap each other's balls only the lower-numbered one is visited from the other.
    """
    levels = int(math.log2(len(points) + 1))
    which, node, spent = np.arange(len(marks)), np.zeros(len(marks), np.int64), np.zeros(len(marks), np.int16)
    for level in range(levels):
        distance = np.bitwise_count((marks[which] ^ points[node]) & ladder.masks[level]).astype(np.int16)
        left = distance <= cuts[node]
        short = np.where(left, cuts[node] + 1 - distance, distance - cuts[node])
        over = spent + short <= ladder.budgets[level]
        which, node, spent = (
            np.concatenate([which, which[over]]),
            np.concatenate([2 * node + 1 + ~left, (2 * node + 1 + left)[over]]),
            np.concatenate([spent, (spent + short)[over]]),
        )
    shard = node - (2**levels - 1)
    home = np.zeros(len(marks), np.int64)
    home[which[spent == 0]] = shard[spent == 0]
    kept = (spent == 0) | (shard < home[which])
    return which[kept], shard[kept], spent[kept]


class Forest:
    """Classes of numbered members, merged edge by edge; the smallest member leads."""

    def __init__(self, n: int):
        self.lead = np.arange(n)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self._waiting.append((a, b))
        self._n += len(a)
        if self._n > 1 << 20:
            self.settle()

    def settle(self) -> np.ndarray:
        if self._waiting:
            a, b = (np.concatenate(x) for x in zip(*self._waiting))
            self._waiting, self._n = [], 0
            while len(a):
                low, high = self.lead[a], self.lead[b]
                open_ = low != high
                a, b, low, high = a[open_], b[open_], low[open_], high[open_]
                np.minimum.at(self.lead, np.maximum(low, high), np.minimum(low, high))
                while not np.array_equal(self.lead, up := self.lead[self.lead]):
                    self.lead = up
        return self.lead


def link_shard(marks: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """For members of a shard, ``home`` or asking, the leader of each one's class.

    Classes are those of the links between a member at home and any other member.
    """
    order = np.argsort(marks)
    marks, home = marks[order], home[order]
    forest = Forest(len(marks))
    levels = min(64, math.ceil(math.log2(max(2, home.sum() / LEAF))))
    for ladder in ladders(levels, radius):
        _descend(marks, np.flatnonzero(home), np.flatnonzero(~home), ladder, radius, forest)
    lead = np.empty(len(marks), np.int64)
    lead[order] = order[forest.settle()]
    return lead


def _descend(marks: np.ndarray, home: np.ndarray, asks: np.ndarray, ladder: Ladder, radius: int, forest: Forest) -> None:
    todo = [(home, asks, np.zeros(len(asks), np.int16), 0)]
    while todo:
        home, asks, used, level = todo.pop()
        parted = None
        while len(home) > LEAF and level < len(ladder.masks) and parted is None:
            parted = _split(marks[home], ladder.masks[level])
            level += parted is None
        if parted is None:
            _compare(marks, home, np.concatenate([asks, home]), radius, forest)
            continue
        point, cut = parted
        mask, budget = ladder.masks[level], ladder.budgets[level]
        at_home, at_asks = (_distance(marks[x], point, mask) for x in (home, asks))
        left = at_home <= cut
        near = cut + 1 - at_home[left]
        go_left, go_right = used + np.maximum(0, at_asks - cut), used + np.maximum(0, cut + 1 - at_asks)
        todo.append((home[left], asks[go_left <= budget], go_left[go_left <= budget], level + 1))
        across = near <= budget
        todo.append((
            home[~left],
            np.concatenate([asks[go_right <= budget], home[left][across]]),
            np.concatenate([go_right[go_right <= budget], near[across]]),
            level + 1,
        ))


def _compare(marks: np.ndarray, home: np.ndarray, asks: np.ndarray, radius: int, forest: Forest) -> None:
    if not len(home):
        return
    step = max(1, _CELLS // len(home))
    for begin in range(0, len(asks), step):
        some = asks[begin : begin + step]
        a, b = np.nonzero(np.bitwise_count(marks[some][:, None] ^ marks[home][None, :]) <= radius)
        forest.link(some[a], home[b])


# --- links and classes of the corpus ---


def links(marks: DataFrame, radius: int = RADIUS, shard_rows: int | None = None) -> DataFrame:
    """Edges ``(node, near)`` that connect all fingerprints of ``marks(fp)``, which are distinct, as far
    as chains of links at ``radius`` do; a shard gives one edge per member, never all pairs."""
    total = marks.count()
    if total == 0:
        return marks.select(F.col("fp").alias("node"), F.col("fp").alias("near"))
    shard_rows = shard_rows or min(SHARD_MOST, max(SHARD_LEAST, total // 64))
    levels = min(32, max(0, math.ceil(math.log2(total / shard_rows))))
    rows = keyed_sample(marks.select("fp"), "fp", SAMPLE).orderBy(F.xxhash64("fp")).collect()
    sample = np.array([r.fp for r in rows], np.int64).view(np.uint64)
    trees = [(*upper_tree(sample, ladder.masks, levels), ladder) for ladder in ladders(levels, radius)]

    def route(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            own = batch.column(0).to_numpy()
            for number, tree in enumerate(trees):
                which, shard, spent = visits(own.view(np.uint64), *tree)
                columns = [shard + (number << levels), own[which], spent.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "fp", "spent"])

    routed = staged(marks.select("fp").mapInArrow(route, "shard long, fp long, spent int"), "routed")
    sizes = routed.where("spent = 0").groupBy("shard").count()
    sizes = sizes.select("shard", F.ceil(F.col("count") / (2 * shard_rows)).cast("int").alias("_blocks"))
    own = F.when(F.col("spent") == 0, F.pmod(F.xxhash64("fp"), "_blocks")).otherwise(F.col("_blocks") - 1)
    blocked = (
        routed.join(F.broadcast(sizes), "shard")  # a row per shard
        .withColumn("_own", own.cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), "_own")))
        .withColumn("home", (F.col("spent") == 0) & (F.col("block") == F.col("_own")))
        .select("shard", "block", "fp", "home")
    )

    def within(frame):
        import pandas as pd

        fps = frame["fp"].to_numpy()
        lead = link_shard(fps.view(np.uint64), frame["home"].to_numpy(), radius)
        apart = lead != np.arange(len(lead))
        return pd.DataFrame({"node": fps[apart], "near": fps[lead[apart]]})

    return blocked.groupBy("shard", "block").applyInPandas(within, "node long, near long")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard_rows: int | None = None
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest ``doc_id`` reachable
    over links of at most ``radius`` differing bits, of every row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like others. Repeated rows give a row each.
    A null id takes part, but is never a ``component_id`` unless its whole component has none. Other
    columns are ignored; an empty table gives no rows.
    """
    return _components(docs, shingle, radius, shard_rows).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _components(docs: DataFrame, shingle: int, radius: int, shard_rows: int | None) -> DataFrame:
    """``doc_id``, ``text_key``, ``fp`` and ``component_id`` of every row."""
    marked = staged(fingerprints(docs, shingle), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("_first")), "distinct")
    label = components(links(distinct, radius, shard_rows)).select(F.col("node").alias("fp"), "label")
    linked = staged(distinct.join(label, "fp"), "linked")
    whole = linked.groupBy("label").agg(F.min("_first").alias("_whole"))
    of_linked = linked.join(whole, "label").select("fp", "_whole")
    named = distinct.join(of_linked, "fp", "left")
    # a table of its own, so that both sides of the join are dealt anew and a fingerprint that very many
    # documents have can be split
    named = staged(named.select("fp", F.coalesce("_whole", "_first").alias("component_id")), "named")
    return marked.join(named, "fp")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard_rows: int | None = None) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component, columns unchanged.

    Of repeated rows with the first id all stay. Rows without an id go if their component has a document with
    one, and stay otherwise. Columns may have any names; an empty table stays empty.
    """
    known = _components(docs, shingle, radius, shard_rows).where("component_id IS NOT NULL")
    return without(docs, known.where("doc_id IS NULL OR doc_id <> component_id").select("doc_id", "text_key"))
