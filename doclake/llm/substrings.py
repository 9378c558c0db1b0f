"""Removal of word windows that repeat across documents, by level-wise doubling.

Windows of the full width are found through shorter ones, each level about twice as long as the one
before. At a level below the last, a full window is represented by the smallest hash among the level's
windows inside it: equal full windows have the same representative, so one whose representative occurs in
no other document cannot repeat and is given up. Only what is left is extended to the next length, and at
full width all windows left are compared by 128-bit hashes. Nothing else is dropped, and what is shuffled
at the first level is one number for some twenty words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from doclake.llm.common import BROADCAST_KEYS, bounded_broadcast, staged
from doclake.llm.pieces import slices

WIDTH = 50
LEVELS = 3
#: Odd multipliers of the two rolling hashes, and their inverses modulo 2**64.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(f, -1, 1 << 64) for f in FACTORS)

#: ``row`` tells rows of one id apart by their text.
BASE = "doc_id long, row long, n_words long, digest binary, marks array<long>"


def lengths(width: int, levels: int = LEVELS) -> list[int]:
    """Window lengths from the first level to the last; each at most twice the one before."""
    found = [width]
    while len(found) < levels and found[0] > 1:
        found.insert(0, (found[0] + 1) // 2)
    return found


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers per word."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def window_hashes(values: np.ndarray, length: int, lane: int) -> np.ndarray:
    """A rolling hash of every ``length`` consecutive values."""
    n = len(values)
    ones = np.ones(n, np.uint64)
    ones[0] = 0
    up = np.where(ones, np.uint64(FACTORS[lane]), np.uint64(1)).cumprod()
    down = np.where(ones, np.uint64(INVERSES[lane]), np.uint64(1)).cumprod()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return (sums[length:] - sums[:-length]) * down[: n - length + 1]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def representatives(hashes: np.ndarray, length: int, width: int) -> np.ndarray:
    """For every full window, the smallest hash of the windows of ``length`` inside it."""
    return sliding_min(window_hashes(hashes[:, 0], length, 0), width - length + 1)


def overlapping(text: str | None, width: int) -> Iterator[tuple[int, list[bytes]]]:
    """Parts of a text's words with the index of their first; every window lies in exactly one part."""
    carried: list[bytes] = []
    at = 0
    for some in slices(text):
        words = carried + some
        if len(words) >= width:
            yield at, words
        carried = words[max(0, len(words) - width + 1) :]
        at += len(words) - len(carried)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """Distinct values, runs of equal ones being folded first."""
    folded = [p[np.r_[True, p[1:] != p[:-1]]] for p in parts if len(p)]
    return np.unique(np.concatenate(folded)) if folded else np.zeros(0, np.uint64)


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _candidates(hashes: np.ndarray, width: int, known: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Full windows whose representative is among the repeated ones at every level so far."""
    open_ = np.ones(len(hashes) - width + 1, bool)
    for length, repeated in known:
        open_ &= _member(representatives(hashes, length, width), repeated)
    return open_


def _lists(pa, columns: list[list[np.ndarray]], kind):
    """Arrow list columns from lists of number arrays."""
    out = []
    for rows in columns:
        ends = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
        flat = np.concatenate(rows) if rows else np.zeros(0)
        out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind))))
    return out


def digest_documents(docs: DataFrame, width: int, length: int) -> DataFrame:
    """``doc_id``, ``row``, ``n_words``, the digest of the joined words and the distinct representatives."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts, digests, marks = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                sha, n = hashlib.sha256(), 0
                for words in slices(text):
                    sha.update((b" " if n and words else b"") + b" ".join(words))
                    n += len(words)
                counts.append(n)
                digests.append(sha.digest())
                marks.append(_distinct([
                    representatives(word_hashes(words), length, width) for _, words in overlapping(text, width)
                ]).view(np.int64))
            columns = [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*columns, *_lists(pa, [marks], np.int64)], names=["doc_id", "row", "n_words", "digest", "marks"]
            )

    return _rows(docs).mapInArrow(run, BASE)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))


def repeated_marks(marks: DataFrame, name: str) -> DataFrame:
    """For each row its marks that another document has, too: ``doc_id``, ``row`` and the list."""
    rows = marks.select("doc_id", "row", F.explode("marks").alias("mark"))
    both = rows.groupBy("mark").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"))
    # a table of its own, so that the join deals both sides anew and a frequent mark can be split
    repeated = staged(both.where("_low < _high").select("mark"), "repeated")
    shared = rows.join(repeated, "mark")
    return shared.groupBy("doc_id", "row").agg(F.collect_list("mark").alias(name))


def _known(batch, row: int, lengths_: list[int]) -> list[tuple[int, np.ndarray]]:
    """The repeated representatives that a row carries, level by level."""
    return [
        (length, np.unique(batch.column(3 + k)[row].values.to_numpy(zero_copy_only=False).view(np.uint64)))
        for k, length in enumerate(lengths_)
    ]


def extend(survivors: DataFrame, width: int, known: list[int], length: int) -> DataFrame:
    """The distinct representatives of the next ``length`` among windows left: ``doc_id``, ``row``, ``marks``.

    ``survivors``: ``doc_id``, ``text``, ``row`` and a list of repeated representatives per length of ``known``.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            marks = []
            for row, text in enumerate(batch.column(1)):
                levels, parts = _known(batch, row, known), []
                for _, words in overlapping(text.as_py(), width):
                    hashes = word_hashes(words)
                    parts.append(representatives(hashes, length, width)[_candidates(hashes, width, levels)])
                marks.append(_distinct(parts).view(np.int64))
            columns = [batch.column(0), batch.column(2), *_lists(pa, [marks], np.int64)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "marks"])

    return survivors.mapInArrow(run, "doc_id long, row long, marks array<long>")


def full_windows(survivors: DataFrame, width: int, known: list[int]) -> DataFrame:
    """All windows of full width that are left: ``doc_id``, ``row``, ``at``, ``high``, ``low``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at_row, (doc_id, text, row) in enumerate(
                zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist())
            ):
                levels = _known(batch, at_row, known)
                for at, words in overlapping(text.as_py(), width):
                    hashes = word_hashes(words)
                    open_ = _candidates(hashes, width, levels)
                    if open_.any():
                        lanes = [window_hashes(hashes[:, k], width, k)[open_].view(np.int64) for k in (0, 1)]
                        places = (np.flatnonzero(open_) + at).astype(np.int32)
                        ids, rows = np.full(len(places), doc_id, np.int64), np.full(len(places), row, np.int64)
                        columns = [pa.array(c) for c in (ids, rows, places, *lanes)]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "at", "high", "low"])

    return survivors.mapInArrow(run, "doc_id long, row long, at int, high long, low long")


def remove(covered: DataFrame, width: int) -> DataFrame:
    """``doc_id``, digest before, ``n_removed``, digest after, of rows with ``text`` and window places."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            before, removed, after = [], [], []
            for row, text in enumerate(batch.column(1)):
                text, places = text.as_py(), batch.column(2)[row].values.to_numpy(zero_copy_only=False)
                step = np.zeros(int(places.max()) + width + 1, np.int32)
                np.add.at(step, places, 1)
                np.add.at(step, places + width, -1)
                gone = np.cumsum(step) > 0
                whole, kept = hashlib.sha256(), hashlib.sha256()
                at = n = n_kept = 0
                for words in slices(text):
                    whole.update((b" " if at and words else b"") + b" ".join(words))
                    mask = np.zeros(len(words), bool)
                    part = gone[at : at + len(words)]
                    mask[: len(part)] = part
                    left = [w for w, m in zip(words, mask.tolist()) if not m]
                    kept.update((b" " if n_kept and left else b"") + b" ".join(left))
                    at, n, n_kept = at + len(words), n + int(mask.sum()), n_kept + len(left)
                before.append(whole.digest())
                removed.append(n)
                after.append(kept.digest())
            columns = [batch.column(0), pa.array(before, pa.binary()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(after, pa.binary())], names=["doc_id", "digest", "n_removed", "kept"]
            )

    return covered.mapInArrow(run, "doc_id long, digest binary, n_removed long, kept binary")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of every row of ``docs``.

    Words are runs between ASCII white space. A word goes if it is covered by a window of ``width`` words
    whose sequence also starts in a document with a smaller id. Null and empty texts have no words. Of
    rows with the same id none is smaller, and each is judged by its own text; rows without an id are neither
    compared nor changed. Other columns are ignored; an empty table gives no rows.

    Documents with the same words as a smaller one are settled by their digest; the rest go through the
    levels of ``lengths(width)``.
    """
    first, second, _ = levels = lengths(width)
    base = staged(digest_documents(docs, width, first), "digests")
    long_ = base.where(f"n_words >= {width} and doc_id is not null")
    # only digests that several documents share go to the others; a table of its own, so that the join deals both
    # sides anew where it is not broadcast, and a frequent digest can be split
    ends = long_.groupBy("digest").agg(F.min("doc_id").alias("_owner"), F.max("doc_id").alias("_last"))
    owners = staged(ends.where("_owner < _last").select("digest", "_owner"), "owners")
    owners = bounded_broadcast(owners, owners.count(), BROADCAST_KEYS)
    copy = F.col("_owner").isNotNull() & (F.col("doc_id") > F.col("_owner"))
    owned = long_.join(owners, "digest", "left")
    copies = owned.where(copy).select("doc_id", "digest").distinct()

    level_one = repeated_marks(owned.where(~copy).select("doc_id", "row", "marks"), "_one")
    survivors = staged(_rows(docs).join(level_one, ["doc_id", "row"]).select("doc_id", "text", "row", "_one"), "survivors")
    level_two = repeated_marks(staged(extend(survivors, width, levels[:1], second), "marks"), "_two")
    left = survivors.join(level_two, ["doc_id", "row"]).select("doc_id", "text", "row", "_one", "_two")
    windows = staged(full_windows(left, width, levels[:2]), "windows")

    lowest = windows.groupBy("high", "low").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"))
    lowest = staged(lowest.where("_low < _high").drop("_high"), "lowest")
    later = windows.join(lowest, ["high", "low"]).where("doc_id > _low")
    places = later.groupBy("doc_id", "row").agg(F.collect_set("at").alias("_places"))
    covered = survivors.select("doc_id", "text", "row").join(places, ["doc_id", "row"])
    cut = remove(covered.select("doc_id", "text", "_places"), width).distinct()

    empty = F.lit(hashlib.sha256().digest())
    whole_copies = copies.select("doc_id", "digest", F.lit(None).cast("long").alias("n_removed"), empty.alias("kept"))
    changed = cut.join(copies, ["doc_id", "digest"], "left_anti").unionByName(whole_copies)
    changed = changed.withColumn("_changed", F.lit(True))
    joined = base.select("doc_id", "n_words", "digest").join(changed, ["doc_id", "digest"], "left")
    gone = F.when(F.col("_changed"), F.coalesce("n_removed", "n_words")).otherwise(F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "n_words",
        gone.alias("n_removed"),
        F.lower(F.hex(F.coalesce("kept", "digest"))).alias("kept_sha256"),
    )
