"""Token counts of whole texts by a whole-token shortcut.

Once per worker, every string of the vocabulary is merged by itself; those that come out as one token
are proved to count one wherever they stand as a word. Words of a text found among them are counted
without tokenizing; the rest are merged by the library, each distinct one once per memo.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from doclake.llm import pieces

LIMIT = 2048
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row; no shuffle.

    Null and empty texts have no bytes and no tokens. Repeated rows and null ids give a row each;
    other columns of ``docs`` are ignored. Texts of any length are cut at white space as they are read.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vocabulary = pieces.vocabulary(path)
        memo = pieces.count_memo(vocabulary) if vocabulary.by_pieces else None
        for batch in batches:
            counts = []
            for text in batch.column(1):
                text = text.as_py()
                if memo is None:
                    counts.append(len(vocabulary.encoded(text or "")))
                else:
                    counts.append(sum(sum(memo.of(some)) for some in pieces.slices(text)))
            over = [n > limit for n in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(over, pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    read = docs.select(
        F.col("doc_id").cast("long"),
        "text",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return read.mapInArrow(run, SCHEMA)
