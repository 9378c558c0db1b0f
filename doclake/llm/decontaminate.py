"""Benchmark passages in documents: SimHash over item-sized windows, in built-in functions only.

For a benchmark item of L words, windows of L words of a document are compared with it. A window of the
wanted similarity must share all but a few of its shingles with the item, so one of its first few is a
shingle of some item of that length; only windows that start within that reach before such a shingle are
looked at, and none that could qualify is missed. Their 64-bit fingerprints are cut into blocks: two
fingerprints within the radius agree in one block up to its share of the radius, so looking up each block
with all its neighbours finds every pair within the radius. What is found is verified by the exact
weighted similarity of the shingles, counted with repeats.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from doclake.llm.common import BROADCAST_ROWS, bounded_broadcast, partitions_for, staged, text_key, without

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 8
#: Bits that may differ. At similarity 0.8 the expected number is 10 with a deviation of 3.
RADIUS = 23
#: Of a benchmark in several parts, about so many windows are compared by one task.
WINDOWS_PER_TASK = 20_000

_BITS = 64 // BLOCKS


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashes_of(text: Column) -> Column:
    return F.transform(words_of(text), lambda word: F.xxhash64(word))


def shingles(hashes: Column, size: int) -> Column:
    """A hash of every ``size`` consecutive word hashes; none if there are fewer."""
    places = F.sequence(F.lit(0), F.size(hashes) - size)
    each = F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))
    return F.when(F.size(hashes) >= size, each).otherwise(F.array().cast("array<bigint>"))


def window_shingles(hashes: Column) -> Column:
    """Shingles of a window; the whole window if it has fewer words than a shingle."""
    whole = shingles(hashes, SHINGLE)
    for size in range(SHINGLE - 1, 0, -1):
        whole = F.when(F.size(hashes) == size, shingles(hashes, size)).otherwise(whole)
    return whole


def fingerprint(marks: Column, most: int) -> Column:
    """SimHash of up to ``most`` marks: a bit is set if it is in more than half of them.

    Bits are counted in lanes of a few long integers at once. Adding a constant to each lane carries into
    its last bit but one just where the count is over half; the last stays free, so that sums never overflow.
    """
    lane = next(bits for bits in (8, 16, 32) if most < 1 << (bits - 2))
    ones = sum(1 << at for at in range(0, 64, lane))
    start = F.struct(*[F.lit(0).cast("bigint").alias(f"c{j}") for j in range(lane)])

    def count(held: Column, mark: Column) -> Column:
        bit = [F.shiftrightunsigned(mark, j).bitwiseAND(F.lit(ones)) for j in range(lane)]
        return F.struct(*[(held[f"c{j}"] + bit[j]).alias(f"c{j}") for j in range(lane)])

    def finish(held: Column) -> Column:
        half = F.floor(F.size(marks) / 2)
        carry = (F.lit((1 << (lane - 2)) - 1) - half) * F.lit(ones)
        top = F.lit(ones << (lane - 2))
        over = [(held[f"c{j}"] + carry).bitwiseAND(top) for j in range(lane)]
        parts = [
            F.shiftright(x, lane - 2 - j) if j <= lane - 2 else F.shiftleft(x, j - lane + 2) for j, x in enumerate(over)
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.bitwiseOR(part)
        return out

    return F.aggregate(marks, start, count, finish)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def block_of(mark: Column, block: int) -> Column:
    return F.shiftrightunsigned(mark, _BITS * block).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")


def neighbour_masks(radius: int) -> list[int]:
    """All changes to a block by up to its share of the radius."""
    share = radius // BLOCKS
    return [sum(1 << b for b in bits) for n in range(share + 1) for bits in combinations(range(_BITS), n)]


def similarity(ours: Column, theirs: Column) -> Column:
    """Weighted Jaccard similarity of two lists of shingles, the weight being the number of repeats."""

    def times(marks: Column, mark: Column) -> Column:
        return F.size(F.filter(marks, lambda other: other == mark))

    once = (F.size(F.array_distinct(ours)) == F.size(ours)) & (F.size(F.array_distinct(theirs)) == F.size(theirs))
    repeated = F.aggregate(
        F.array_distinct(theirs), F.lit(0), lambda n, mark: n + F.least(times(ours, mark), times(theirs, mark))
    )
    shared = F.when(once, F.size(F.array_intersect(ours, theirs))).otherwise(repeated)
    return shared / (F.size(ours) + F.size(theirs) - shared)


def reach(words: Column, least: float) -> Column:
    """How many shingles of a window may precede the first that it shares with an item of ``words`` words.

    At a similarity of ``least`` two lists of n share at least ``2 n least / (1 + least)``.
    """
    n = F.greatest(words - SHINGLE + 1, F.lit(1))
    return (n - F.ceil(n * (2 * least / (1 + least)) - 1e-9)).cast("int")


def prepare_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``items``, ``owners``): the different texts with words as ``item`` (a number), ``words``, ``marks``, and the
    ``item_id`` of each. Items are told apart by number, so that null and repeated ids are items, too; copies of a
    text are compared once."""
    both = _let(hashes_of(F.col("text")), lambda h: F.struct(F.size(h).alias("words"), window_shingles(h).alias("marks")))
    named = benchmark.select("item_id", both.alias("of")).distinct().select("item_id", "of.*").where("words > 0")
    named = staged(named, "named")
    items = staged(named.select("words", "marks").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    owners = named.join(items, ["words", "marks"]).select("item", "item_id")
    return items, bounded_broadcast(owners, named.count())


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity``, ``start`` (word) and ``distance`` (bits) of the best window of
    every document and item that has one of similarity ``least`` or more.

    Words are compared in lower case without punctuation. A text shorter than an item is one window.
    Null and empty texts and items match nothing; repeated rows, rows with the same id and items with the
    same id are taken together. A row without id is a document of its own for each text, an item without id
    one for all such items; both are kept with null ids. Other columns are ignored; empty tables give no rows.

    Shingles and fingerprints of items are broadcast, at most ``BROADCAST_ROWS`` rows at a time. Of a benchmark with
    more, each part of the shingles finds its windows in a scan of its own, and each part of the fingerprints goes
    over the windows found, which are written; one part is done before the next begins. Documents are not shuffled,
    only what was found is.
    """
    items, owners = prepare_items(benchmark)
    best = _best(_found(docs, items, least, radius), "item")
    return _best(best.join(owners, "item"), "item_id").drop("text_key")


def _best(found: DataFrame, item: str) -> DataFrame:
    """The best window of every document and ``item``."""
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), (-F.col("distance")).alias("distance")))
    return (
        found.groupBy("doc_id", "text_key", item)
        .agg(best.alias("best"))
        .select(
            "doc_id",
            "text_key",
            item,
            F.col("best.similarity").alias("similarity"),
            (-F.col("best.start")).alias("start"),
            (-F.col("best.distance")).alias("distance"),
        )
    )


def _part(items: DataFrame, parts: int, part: int) -> DataFrame:
    return items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part) if parts > 1 else items


def _found(docs: DataFrame, items: DataFrame, least: float, radius: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``item``, ``similarity``, ``start`` and ``distance`` of all windows that qualify."""
    n, most, marks = items.agg(F.count("*"), F.max("words"), F.sum(F.size("marks"))).first()
    size = F.least("words", F.lit(SHINGLE))
    sizes = sorted(r.size for r in items.select(size.alias("size")).distinct().collect()) or [SHINGLE]
    marks, looked_up = marks or 0, n * BLOCKS * len(neighbour_masks(radius))
    scans, passes = (max(1, -(-rows // BROADCAST_ROWS)) for rows in (marks, max(marks, looked_up)))
    most = max(1, most or 0)
    if scans == passes == 1:
        each = [(items.where(size == s), s) for s in sizes]
        return reduce(
            DataFrame.unionByName,
            [_compared(_windows(docs, some, s, most, least), some, most, least, radius) for some, s in each],
        )
    # one after the other, so that executors and driver never hold more than one part of the benchmark
    scanned = [
        staged(_windows(docs, _part(items, scans, part).where(size == s), s, most, least), "windows")
        for part in range(scans)
        for s in sizes
    ]
    windows = reduce(DataFrame.unionByName, scanned)
    # dealt by number, since few bytes make much work
    wide = partitions_for(docs.sparkSession, windows.count(), WINDOWS_PER_TASK)
    windows = staged(windows.repartition(wide, "doc_id", "text_key", "words", "start").distinct(), "windows")
    return reduce(
        DataFrame.unionByName,
        [staged(_compared(windows, _part(items, passes, part), most, least, radius), "found") for part in range(passes)],
    )


def _windows(docs: DataFrame, items: DataFrame, size: int, most: int, least: float) -> DataFrame:
    """``doc_id``, ``text_key``, ``words``, ``start``, ``ours`` (shingles) and ``fp`` of the windows near shared shingles."""
    # Outer generators and values bound once by ``_let``: a plain generator makes the optimizer test for
    # emptiness below it, where the expressions above the text would be copied into each other.
    anchors = F.broadcast(items.select(F.explode("marks").alias("mark"), "words").distinct())
    both = _let(hashes_of(F.col("text")), lambda h: F.struct(h.alias("hashes"), shingles(h, size).alias("marks")))
    key = ["doc_id", "text_key"]
    marked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("doc_id"), F.col("text")).alias("text_key"), both.alias("of")
    )
    marked = marked.select(*key, F.col("of.hashes").alias("hashes"), F.col("of.marks").alias("marks"))
    at = marked.select(*key, "hashes", F.posexplode_outer("marks").alias("place", "mark")).join(anchors, "mark")
    first = F.greatest(F.lit(0), F.col("place") - reach(F.col("words"), least))
    last = F.least(F.col("place"), F.size("hashes") - F.col("words"))
    starts = F.when(F.size("hashes") <= F.col("words"), F.array(F.lit(0))).when(
        first <= last, F.sequence(first, last)
    )
    printed = _let(
        F.slice("hashes", F.col("start") + 1, F.col("words")),
        lambda window: _let(
            window_shingles(window), lambda ours: F.struct(ours.alias("ours"), fingerprint(ours, most).alias("fp"))
        ),
    )
    return (
        at.select(*key, "words", "hashes", F.explode_outer(starts).alias("start"))
        .where(F.col("start").isNotNull())
        .select(*key, "words", "start", printed.alias("of"))
        .select(*key, "words", "start", F.col("of.ours").alias("ours"), F.col("of.fp").alias("fp"))
    )


def _compared(windows: DataFrame, items: DataFrame, most: int, least: float, radius: int) -> DataFrame:
    """Windows with the items of their length within ``radius`` bits whose similarity is ``least`` or more."""
    key = ["doc_id", "text_key"]

    def place(value: Column) -> Column:
        """Length, block and value as one number: half the memory of a broadcast by three columns."""
        return F.col("words").cast("long") * (BLOCKS << _BITS) + F.col("block") * (1 << _BITS) + value

    blocks = F.array(*[block_of(F.col("fp"), b) for b in range(BLOCKS)])
    windows = windows.select("*", F.posexplode_outer(blocks).alias("block", "value"))
    windows = windows.withColumn("place", place(F.col("value")))
    prints = items.select("item", "words", fingerprint(F.col("marks"), most).alias("item_fp"))
    masks = F.array(*[F.lit(m) for m in neighbour_masks(radius)])
    looked_up = (
        prints.select("*", F.posexplode(F.array(*[block_of(F.col("item_fp"), b) for b in range(BLOCKS)])).alias("block", "_value"))
        .select("*", F.explode(masks).alias("_mask"))
        .select("item", "item_fp", place(F.col("_value").bitwiseXOR(F.col("_mask"))).alias("place"))
    )
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # several blocks may find a pair: the first of them keeps it
    earliest = F.coalesce(*[F.when(F.bit_count(block_of(differ, b)) <= radius // BLOCKS, F.lit(b)) for b in range(BLOCKS)])
    pairs = (
        windows.join(F.broadcast(looked_up), "place")
        .where((F.bit_count(differ) <= radius) & (earliest == F.col("block")))
        .select(*key, "item", "start", "ours", F.bit_count(differ).alias("distance"))
    )
    verified = pairs.join(F.broadcast(items.select("item", "marks")), "item")
    return verified.select(
        *key, "item", similarity(F.col("ours"), F.col("marks")).alias("similarity"), "start", "distance"
    ).where(F.col("similarity") >= least)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs`` whose document holds no benchmark item, columns unchanged and of any names.

    Rows with the same id go together; a row without an id goes if its own text holds an item.
    """
    items, _ = prepare_items(benchmark)
    return without(docs, _found(docs, items, least, radius).select("doc_id", "text_key"))


def oracle(least: float = SIMILARITY) -> str:
    """SQL for ``doc_id``, ``item_id``, ``similarity`` and ``start`` over ``documents`` and ``benchmark``."""
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    grams = (
        f"CASE WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), "
        f"lambda i: array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ')) END"
    )
    count = "len(list_filter({0}, lambda y: y = x))"
    shared = f"""list_sum(list_transform(list_distinct(i.g), lambda x: least({count.format('i.g')}, {count.format('v.g')})))"""
    return f"""
    WITH d AS (SELECT doc_id, w FROM (SELECT doc_id, {words} AS w FROM documents) WHERE len(w) > 0),
    i AS (SELECT item_id, w, {grams} AS g FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
    lengths AS (SELECT DISTINCT least(len(w), {SHINGLE}) AS n FROM i),
    near AS (
        SELECT DISTINCT a.doc_id, b.item_id
        FROM (SELECT doc_id, array_to_string(list_slice(w, k, k + n - 1), ' ') AS x
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths)) a
        JOIN (SELECT item_id, unnest(g) AS x FROM i) b ON a.x = b.x),
    v AS (
        SELECT doc_id, item_id, start, {grams} AS g
        FROM (SELECT doc_id, item_id, s AS start, list_slice(dw, s + 1, s + n) AS w
              FROM (SELECT near.doc_id, near.item_id, d.w AS dw, len(i.w) AS n,
                           unnest(range(0, greatest(len(d.w) - len(i.w), 0) + 1)) AS s
                    FROM near JOIN d USING (doc_id) JOIN i USING (item_id)))),
    scored AS (
        SELECT doc_id, item_id, start, shared / (len(vg) + len(ig) - shared)::DOUBLE AS similarity
        FROM (SELECT v.doc_id, v.item_id, v.start, v.g AS vg, i.g AS ig, {shared} AS shared
              FROM v JOIN i USING (item_id)))
    SELECT doc_id, item_id, similarity, start::INT AS start FROM scored WHERE similarity >= {least}
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""
