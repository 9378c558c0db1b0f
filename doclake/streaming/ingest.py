"""The batch ingestion as a stream over a folder (an extension): each trigger takes the files that changed.

A file is known by its name. The state of the stream holds one checksum for each, so that a file that was
written again with the same bytes, or only touched, goes no further; an edited one does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from doclake.plans.ingest import Ingested, ingest
from doclake.sources.folder import LISTED, FolderSource, with_checksum

CHANGED = f"{LISTED}, checksum string"


def file_stream(spark: SparkSession, folder: str, partitions: int | None = None) -> DataFrame:
    """The files of a folder as they appear and change, whatever their names: file_name, path, length,
    modificationTime."""
    spark.dataSource.register(FolderSource)
    parts = partitions or spark.sparkContext.defaultParallelism
    return spark.readStream.format("folder").option("partitions", parts).load(folder)


def changed_files(files: DataFrame) -> DataFrame:
    """The files of a stream whose bytes are new under their name, with their ``checksum``.

    Names and checksums are shuffled, never bytes; the state is one checksum per name.
    """

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found = list(frames)
        row = found[0] if len(found) == 1 else pd.concat(found)
        if len(row) > 1:  # most names come once
            row = row.sort_values(["modificationTime", "checksum"]).tail(1)
        checksum = row["checksum"].iat[0]
        if not state.exists or state.get[0] != checksum:
            state.update((checksum,))
            yield row

    return with_checksum(files).groupBy("file_name").applyInPandasWithState(
        keep, CHANGED, "checksum string", "update", GroupStateTimeout.NoTimeout
    )


def each_batch(files: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``run`` on the changed files of every micro-batch, with its number, until the folder holds no more."""
    return (
        changed_files(files)
        .writeStream.outputMode("update")
        .foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_stream(
    files: DataFrame,
    read_store: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
    save: Callable[[Ingested, int], None],
    checkpoint: str,
    **options,
) -> StreamingQuery:
    """Ingest the changed files of every micro-batch against the current (documents, chunks, memo) and save the result.

    Upserting is idempotent, so a batch that is replayed after a failure adds nothing twice; ``save``
    gets the batch number to make its writes replaceable.
    """

    def run(batch: DataFrame, number: int) -> None:
        listed = batch.select("file_name", "path", "length")
        save(ingest(listed, *read_store(), **options), number)

    return each_batch(files, run, checkpoint)
