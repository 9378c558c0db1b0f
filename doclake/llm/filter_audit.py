"""Filter interaction audit: what five filters remove in each of their 120 orders.

A document enters only as a cell: the part it belongs to, the five-bit mask of the filters it fails, and
its two labels. Each cell is folded over the array of all orders with ``aggregate`` and ``transform``,
which gives 600 structs (order, step) weighted by the cell's count, and the cells of a part are merged by
elementwise sums. A part has at most 128 cells, so nothing after the count depends on the corpus.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from doclake.llm.common import staged

FILTERS = "ABCDE"
#: Every order of the filters, in alphabetical order; five steps each.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]

MIN_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5
SYMBOLS = "[#$%&*|]"
#: A run of the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def _any(**fails: Column) -> Column:
    """The bits of the filters that fail."""
    bits = [F.when(fail, F.lit(_bit(letter))).otherwise(0) for letter, fail in fails.items()]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask + bit
    return mask


def text_masks(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, the SHA-256 of the text and the mask of filters A to D, of every row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    words = F.size("words")
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    mask = _any(
        A=words < MIN_WORDS,
        B=100 * F.size(F.array_distinct("words")).cast("long") < DISTINCT_PERCENT * words.cast("long"),
        C=100 * upper.cast("long") > UPPER_PERCENT * F.length("text").cast("long"),
        D=F.rlike("text", F.lit(SYMBOLS)),
    )
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, filters failed and labels.

    Rows alike in id, part and text are counted before anything else, so neither a repeated row nor a text
    with many copies meets in one task: the first document of a text is a minimum, combined before the
    shuffle, and is found again by (text, id). Only digests and ids are shuffled, never texts.
    """
    rows = text_masks(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = staged(rows, "audit")
    named = rows.where(F.col("doc_id").isNotNull())
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    copy = F.when(F.col("first").isNull(), F.lit(_bit("E"))).otherwise(0)
    named = (
        named.join(firsts, ["digest", "doc_id"], "left")
        .withColumn("mask", F.col("mask") + copy)
        .join(marked, "doc_id", "left")
        .select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")
    )
    # a document without id has no smaller one and no label
    nameless = rows.where(F.col("doc_id").isNull())
    nameless = nameless.select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    return named.unionByName(nameless).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def fold(cell: Column, orders: Column) -> Column:
    """600 structs of ``MEASURES``, order by order and step by step, weighted by the cell's count."""
    mask, n = cell["mask"], cell["n"]

    def counted(condition: Column, weight: Column = n) -> Column:
        return F.when(condition, weight).otherwise(F.lit(0).cast("long"))

    def step(state: Column, bit: Column) -> Column:
        fails, alive = mask.bitwiseAND(bit) != 0, state["alive"]
        out = alive & fails
        values = [
            counted(alive & ~fails),
            counted(out),
            counted(~alive & fails),
            counted(mask == bit),
            counted(out, n * cell["good"]),
            counted(out, n * cell["toxic"]),
        ]
        taken = F.struct(*[v.alias(m) for v, m in zip(values, MEASURES)])
        return F.struct(F.concat(state["steps"], F.array(taken)).alias("steps"), (alive & ~fails).alias("alive"))

    none = F.array().cast(f"array<struct<{','.join(m + ':bigint' for m in MEASURES)}>>")
    start = F.struct(none.alias("steps"), F.lit(True).alias("alive"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["steps"])))


def _plus(a: Column, b: Column) -> Column:
    return F.struct(*[(a[m] + b[m]).alias(m) for m in MEASURES])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per ``part``, ``filter_order`` and ``step`` (1 to 5; its filter is that letter of the order).

    ``docs``: doc_id, source (the part; null: empty), text (null: empty); ``labels``: doc_id, quality, toxic.
    Other columns are ignored, whatever their names. Filters fail a text: A under 50 words, B too few
    distinct words, C too many capitals, D a symbol, E the text of any smaller ``doc_id``. Counts are of
    rows, so repeated rows count each; a row without id has no copy before it and no label. A label given
    twice holds if any of its rows says so. An empty table gives no rows.

    ``kept``: left after the step; ``removed``: by it; ``redundant``: failing its filter, but removed
    earlier; ``unique_fails``: failing its filter alone; ``good_lost``, ``toxic_lost``: removed by it, by
    label; ``shapley``: what its filter removes, summed over all orders.
    """
    orders = F.lit([[_bit(letter) for letter in order] for order in ORDERS])
    steps = len(FILTERS)
    zero = F.struct(*[F.lit(0).cast("long").alias(m) for m in MEASURES])
    zeros = F.array_repeat(zero, len(ORDERS) * steps)
    # at most 128 cells a part: 32 masks with two labels of two values
    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    totals = F.aggregate("cells", zeros, lambda sums, cell: F.zip_with(sums, fold(cell, orders), _plus))
    parts = parts.select("part", totals.alias("totals"))
    bits = F.flatten(orders)

    def removed_by(bit: int) -> Column:
        own = F.zip_with("totals", bits, lambda t, b: F.when(b == bit, t["removed"]).otherwise(F.lit(0).cast("long")))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + b)

    shapley = F.create_map(*[x for letter in FILTERS for x in (F.lit(letter), removed_by(_bit(letter)))])
    rows = parts.select("part", shapley.alias("shapley"), F.posexplode("totals").alias("at", "total"))
    order = F.lit(ORDERS)[F.call_function("div", F.col("at"), F.lit(steps)).cast("int")]
    step = F.col("at") % steps + 1
    return rows.select(
        "part",
        order.alias("filter_order"),
        step.cast("int").alias("step"),
        *[F.col(f"total.{m}").alias(m) for m in MEASURES],
        F.col("shapley")[F.substring(order, step, F.lit(1))].alias("shapley"),
    )


def oracle() -> str:
    """The same by one pass over all documents for every order and step."""
    return r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY text) AS first
  FROM texts),
marked AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT w.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM worded w LEFT JOIN marked m ON w.doc_id = m.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INT AS step FROM orders),
judged AS (
  SELECT part, filter_order, step, good, toxic, fails, filter_order[step] AS letter,
         contains(fails, filter_order[step]) AS own,
         fails <> '' AND regexp_matches(fails, '[' || filter_order[:step - 1] || '_]') AS before
  FROM failing, steps),
counted AS (
  SELECT part, filter_order, step, letter,
         count(*) FILTER (NOT own AND NOT before) AS kept,
         count(*) FILTER (own AND NOT before) AS removed,
         count(*) FILTER (own AND before) AS redundant,
         count(*) FILTER (fails = letter) AS unique_fails,
         count(*) FILTER (own AND NOT before AND good = 1) AS good_lost,
         count(*) FILTER (own AND NOT before AND toxic = 1) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""
