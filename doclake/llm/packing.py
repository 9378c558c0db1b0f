"""Concatenate and cut: documents packed end to end into sequences of a fixed length.

First pass: every partition encodes its documents and notes where each begins in the partition. A
prefix sum over the partitions' totals turns that into offsets in the whole corpus. Second pass, without
a shuffle: each document is cut where its ids cross a multiple of the length; the pieces are the records
of what lies on either side of a boundary. Only the last sequence is not full.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from doclake.llm import pieces
from doclake.llm.common import staged

LENGTH = 2048
END_ID = 1
#: Ids per row of the staged table: long documents take several rows.
BLOCK_IDS = 32 * LENGTH
#: Partitions whose totals are summed by one task.
RUN = 1024
ENCODED = "doc_id long, part int, doc_at long, doc_tokens long, start long, ids binary"


def encode_partitions(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Rows of at most ``BLOCK_IDS`` ids: their document, its first id's place in the partition
    (``doc_at``), and their place in the document (``start``)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        vocabulary = pieces.vocabulary(path)
        memo = pieces.id_memo(vocabulary) if vocabulary.by_pieces else None
        end, part, at = pieces.packed([end_id]), TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if memo is None:
                    ids = pieces.packed(vocabulary.encoded(text or "")) + end
                else:
                    ids = b"".join([b"".join(memo.of(some)) for some in pieces.slices(text)] + [end])
                n = len(ids) // 4
                for start in range(0, n, BLOCK_IDS):
                    rows.append((doc_id, part, at, n, start, ids[4 * start : 4 * (start + BLOCK_IDS)]))
                at, held = at + n, held + len(ids)
                if held > 1 << 24:
                    yield _record_batch(pa, rows)
                    rows, held = [], 0
        if rows:
            yield _record_batch(pa, rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)


def _record_batch(pa, rows: list[tuple]):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "part", "doc_at", "doc_tokens", "start", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def partition_offsets(encoded: DataFrame) -> DataFrame:
    """``part`` and the number of ids in all partitions before it: a row per partition.

    Totals are summed in runs of ``RUN`` partitions, then over the runs.
    """
    totals = encoded.where("start = 0").groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    run = F.floor(F.col("part") / RUN).alias("run")
    inside = Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = totals.select("part", "n", run).withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    across = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = totals.groupBy(run).agg(F.sum("n").alias("n"))
    before = runs.select("run", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("_before"))
    return within.join(before, "run").select("part", (F.col("_before") + F.col("_inside")).alias("part_at"))


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of all rows of ``docs``: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian unsigned
    32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    Every row is encoded and ended by ``end_id``; a null or empty text is that id alone, repeated rows
    are packed again, a null id is kept, an empty table gives no pieces. Other columns are ignored.
    Sequences are gapless from offset 0; all but the last hold exactly ``length`` ids.

    The table of partition offsets is broadcast: it has one row of two numbers per input partition.
    """
    encoded = staged(encode_partitions(docs, path, end_id), "encoded")
    offsets = F.broadcast(partition_offsets(encoded))
    size = F.octet_length("ids").cast("long") / 4
    placed = encoded.join(offsets, "part").select(
        "doc_id",
        "doc_tokens",
        "start",
        "ids",
        (F.col("part_at") + F.col("doc_at") + F.col("start")).alias("_from"),
        (F.col("part_at") + F.col("doc_at") + F.col("start") + size.cast("long")).alias("_to"),
    )

    def piece(k):
        begin = F.greatest("_from", k * length)
        end = F.least("_to", (k + 1) * length)
        skip = begin - F.col("_from")
        return F.struct(
            (F.col("start") + skip).alias("start"),
            (end - begin).alias("length"),
            F.substring("ids", (skip * 4 + 1).cast("int"), ((end - begin) * 4).cast("int")).alias("ids"),
            k.alias("sequence_id"),
            (begin - k * length).alias("offset"),
        )

    first, last = F.floor(F.col("_from") / length), F.floor((F.col("_to") - 1) / length)
    cut = placed.select("doc_id", "doc_tokens", F.inline(F.transform(F.sequence(first, last), piece)))
    return cut.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def sequences(pieces_of: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``ids``, ``n_ids``; a group holds one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda done, part: F.concat(done, part["ids"]))
    return pieces_of.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_ids"))


def digests(pieces_of: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces_of.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
