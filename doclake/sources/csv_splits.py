"""CSV files of any size, read in splits that end at record borders.

A split holds the lines that begin in its range of bytes. A line begins either a record or the inside of a
quoted cell, so a split maps these two states to the state after it. The first pass finds this map, with the
records counted, for both states; composing the maps over a file's splits gives each its true state and the
records before it. In the second pass every split reads the records that begin in it, past its end if the
last one goes on. Lines are given to the standard library's reader, so that any size has one semantics.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from doclake.session import stage
from doclake.sources.folder import open_bytes

SPLIT_BYTES = 64 << 20
#: Bytes of splits that a task reads, about.
TASK_BYTES = 64 << 20
MOST_TASKS = 100_000
#: Rows in an Arrow batch that is sent on, and the characters in it, at most by one row.
ROWS, CHARACTERS = 4096, 1 << 24

RECORDS = "position int, header array<string>, values array<string>"
_RECORDS = [("position", pa.int32()), ("header", pa.list_(pa.string())), ("values", pa.list_(pa.string()))]
_FIELD_LIMIT = 2**31 - 1


def reader(lines: Iterator[str]):
    if csv.field_size_limit() < _FIELD_LIMIT:
        csv.field_size_limit(_FIELD_LIMIT)
    return csv.reader(lines)


def kept(cells: list[str]) -> bool:
    """Rows with nothing but blanks are no records."""
    return any(cell.strip() for cell in cells)


class _Lines:
    """The lines of a file from the first that begins at or after a byte, with the place of the next."""

    def __init__(self, file, begin: int) -> None:
        file.seek(max(0, begin - 1))
        if begin:
            file.readline()  # to the end of a line that begins before
        self.file, self.at = file, file.tell()
        self.opened = False

    def before(self, end: int | None, quoted: bool) -> Iterator[str]:
        """Lines that begin before ``end``, all if that is None; the first one with a quote before it if it begins
        inside a cell. ``opened`` tells that more was asked for than there was."""
        while end is None or self.at < end:
            line = self.file.readline()
            if not line:
                break
            self.at += len(line)
            text = line.decode("utf-8", errors="replace")
            yield '"' + text if quoted else text
            quoted = False
        self.opened = True


def scan_split(file, begin: int, end: int, quoted: bool) -> dict:
    """What the lines that begin in a range do, if the first begins inside a quoted cell or not.

    ``closed``: that cell's record ends here, with ``tail`` telling whether there is more than blanks in the rest of
    it; ``kept``: records that begin and end here and are kept; ``open``: another goes on, ``partial`` telling
    whether there is more than blanks in it so far; ``bad``: the reader refuses it. Nothing beyond the range is
    read, as the wrong state may well find no end.
    """
    lines = _Lines(file, begin)
    does = {"tail": False, "closed": not quoted, "kept": 0, "open": False, "partial": False, "bad": False}
    if lines.at >= end:
        return does
    rows = reader(lines.before(end, quoted))

    def cut_off() -> bool:
        """The last record asked for a line past the range, and the file has one."""
        return lines.opened and _more(file, lines.at)

    try:
        if quoted:
            does["tail"] = kept(next(rows, []))
            does["closed"] = not cut_off()
        first = begin == 0
        while lines.at < end and not lines.opened:
            cells = next(rows, None)
            if cells is None:
                break
            if cut_off():
                does |= {"open": True, "partial": kept(cells)}
            elif not first:
                does["kept"] += kept(cells)
            does["header"] = first and does["open"]
            first = False
    except csv.Error:
        does["bad"] = True
    return does


def _more(file, at: int) -> bool:
    file.seek(at)
    return bool(file.read(1))


def header_of(file) -> list[str] | None:
    try:
        return next(reader(_Lines(file, 0).before(None, False)), None)
    except csv.Error:
        return None  # the scan of the split says so, too


def splits_of(files: DataFrame, split_bytes: int) -> DataFrame:
    """``files`` (path, length, ...) with a row per split: ``split``, ``begin``, ``end``."""
    last = F.greatest(F.lit(0), F.call_function("div", F.col("length") - 1, F.lit(split_bytes)))
    rows = files.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    begin = F.col("split") * split_bytes
    return rows.withColumn("begin", begin).withColumn("end", begin + split_bytes)


_STATE = ["tail", "closed", "kept", "open", "partial", "bad", "header"]
_STATE_DDL = "struct<tail:boolean,closed:boolean,kept:bigint,open:boolean,partial:boolean,bad:boolean,header:boolean>"


def _scanned(splits: DataFrame) -> DataFrame:
    """What each split does to either state; the first one carries the file's header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = pa.struct([(f, pa.int64() if f == "kept" else pa.bool_()) for f in _STATE])
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), state, state, pa.list_(pa.string())]
        for batch in batches:
            rows = []
            for path, split, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                with open_bytes(path) as file:
                    does = [{"header": False, **scan_split(file, begin, end, quoted)} for quoted in (False, True)[: 2 if split else 1]]
                    header = header_of(file) if split == 0 else None
                rows.append((path, split, begin, end, does[0], does[-1], header))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "split", "begin", "end", "plain", "quoted", "header"])

    shape = f"path string, split long, begin long, end long, plain {_STATE_DDL}, quoted {_STATE_DDL}, header array<string>"
    return splits.select("path", "split", "begin", "end").mapInArrow(run, shape)


#: The state between splits: no record goes on, or one of blanks so far, of more than that, or the header.
_SHUT, _BLANK, _SAID, _HEADER = 0, 1, 2, 3


def _composed(scanned: DataFrame) -> DataFrame:
    """Per file its header, whether it cannot be read, and its splits with their state and the records kept before
    those that begin in them.

    A file has one row of a few numbers per split, so its splits fit an array.
    """
    row = F.struct("split", "begin", "end", "plain", "quoted")
    files = scanned.groupBy("path").agg(
        F.array_sort(F.collect_list(row)).alias("splits"), F.first("header", ignorenulls=True).alias("header")
    )
    kind = "array<struct<begin:bigint,end:bigint,open:boolean,kept:bigint>>"
    start = F.struct(
        F.array().cast(kind).alias("splits"),
        F.lit(_SHUT).alias("state"),
        F.lit(0).cast("long").alias("kept"),
        F.lit(False).alias("bad"),
    )

    def step(so_far: Column, split: Column) -> Column:
        state = so_far["state"]
        shut = state == _SHUT
        does = F.when(shut, split["plain"]).otherwise(split["quoted"])
        said = (state == _SAID) | does["tail"]
        # a record that goes on from before counts where it ends
        ended = F.when(~shut & does["closed"] & (state != _HEADER) & said, 1).otherwise(0).cast("long")
        left = F.when(does["header"], _HEADER).when(does["partial"], _SAID).otherwise(_BLANK)
        after = (
            F.when(~does["closed"], F.when(state == _HEADER, _HEADER).when(said, _SAID).otherwise(_BLANK))
            .when(does["open"], left)
            .otherwise(_SHUT)
        )
        before = so_far["kept"] + ended
        here = F.struct(split["begin"].alias("begin"), split["end"].alias("end"), (~shut).alias("open"), before.alias("kept"))
        return F.struct(
            F.concat(so_far["splits"], F.array(here)).alias("splits"),
            after.alias("state"),
            (before + does["kept"]).alias("kept"),
            (so_far["bad"] | does["bad"]).alias("bad"),
        )

    files = files.withColumn("all", F.aggregate("splits", start, step))
    return files.select("path", "header", F.col("all.bad").alias("bad"), F.col("all.splits").alias("splits"))


def read_splits(
    files: DataFrame, split_bytes: int = SPLIT_BYTES, carried: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(records, unreadable) of CSV ``files`` (path, length): ``path``, ``position`` among the records kept,
    ``header`` and ``values``; and the paths that the reader refuses, which give no records. Columns of ``files``
    that are ``carried`` meet the splits: a join with the records would take these, by the size of their plan, for
    a table to broadcast.

    The first record of a file is its header, rows with blanks alone go. The plan of the splits is staged, so
    that the first pass runs once; records are not shuffled.
    """
    splits = stage(splits_of(files.select("path", "length"), split_bytes), "splits")
    # small splits share a task, as each task costs the driver memory; there are enough for the cores
    size = splits.agg(F.count("*").alias("n"), F.sum(F.least(F.col("end"), F.col("length")) - F.col("begin")).alias("bytes")).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(size.n, max(4 * cores, -(-(size.bytes or 0) // TASK_BYTES)), MOST_TASKS))
    plan = stage(_composed(_scanned(splits.repartition(tasks, "path", "split"))), "plan")
    parts = plan.where(~F.col("bad") & F.col("header").isNotNull()).select("path", "header", F.inline("splits"))
    if carried:
        parts = parts.join(files.select("path", *carried), "path")
    parts = parts.repartition(tasks, "path", "begin")
    kinds = {name: parts.schema[name].dataType for name in ("path", *carried)}
    schema = pa.schema([*to_arrow_schema(T.StructType([T.StructField(n, k) for n, k in kinds.items()])), *_RECORDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_bytes(row["path"]) as file:
                    yield from _records(file, row, schema)

    shape = ", ".join(f"`{n}` {k.simpleString()}" for n, k in kinds.items())
    records = parts.mapInArrow(run, f"{shape}, {RECORDS}")
    return records, plan.where("bad").select("path")


def _records(file, row: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    lines = _Lines(file, row["begin"])
    if lines.at >= row["end"]:
        return
    rows = reader(lines.before(None, row["open"]))
    if row["open"]:
        next(rows, None)
    position, header_due = row["kept"], row["begin"] == 0
    held: list[tuple[int, list[str]]] = []
    size = 0
    while lines.at < row["end"]:
        cells = next(rows, None)
        if cells is None:
            break
        if header_due:
            header_due = False
            continue
        if kept(cells):
            held.append((position, cells))
            size += sum(map(len, cells))
            position += 1
        if len(held) >= ROWS or size >= CHARACTERS:
            yield _batch(held, row, schema)
            held, size = [], 0
    if held:
        yield _batch(held, row, schema)


def _batch(held: list[tuple[int, list[str]]], row: dict, schema: pa.Schema) -> pa.RecordBatch:
    n = len(held)
    same = [pa.array([row[name]] * n, kind) for name, kind in zip(schema.names, schema.types[: -len(_RECORDS)])]
    columns = [*same, *record_columns([h[0] for h in held], [row["header"]] * n, [h[1] for h in held])]
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def record_columns(positions: list[int], headers: list[list[str]], values: list[list[str]]) -> list[pa.Array]:
    return [pa.array(c, t) for c, (_, t) in zip((positions, headers, values), _RECORDS)]


def whole_records(data: bytes) -> Iterator[tuple[int, list[str], list[str]]]:
    """(position, header, values) of the records of a file at hand."""
    import io

    rows = reader(io.StringIO(data.decode("utf-8", errors="replace")))
    header = next(rows, None)
    position = 0
    for cells in rows:
        if kept(cells):
            yield position, header, cells
            position += 1
