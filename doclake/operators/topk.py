"""The per-task part of nearest-neighbour search: a block of questions against blocks of chunks.

Two blocks are compared by one matrix product in single precision, and all rows that can still enter a
question's best ``k``, allowing for what that loses, get an exact distance. What a task sends on is ``k``
rows per question, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from doclake.functions.vectors import DISTANCE_DECIMALS

PARTIAL = pa.schema(
    [
        ("query_id", pa.string()),
        ("document_id", pa.string()),
        ("chunk_index", pa.int32()),
        ("text_hash", pa.string()),
        ("distance", pa.float64()),
    ]
)
PARTIAL_DDL = "query_id string, document_id string, chunk_index int, text_hash string, distance double"
_ORDER = [(name, "ascending") for name in ("query", "distance", "document_id", "chunk_index", "text_hash")]
_PAIRS = 1 << 21
_EXACT = 1 << 22
#: Pairs that get an exact distance at once, and the squares up to which single precision is used.
_FOUND = 1 << 18
_SINGLE = 1e30


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """An ``array<float>`` Arrow column as a (rows, dim) matrix, a copy of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class Questions:
    """A bounded block of questions: ids, vectors and the scopes each of them searches.

    Vectors stay in the precision they come in, and are widened only while a block is compared.
    """

    def __init__(self, ids: list[str], vectors: np.ndarray, scopes: list[list[str]]) -> None:
        self.ids = ids
        self.vectors = vectors
        self.squares = np.einsum("ij,ij->i", *[np.asarray(vectors, dtype=np.float64)] * 2)
        self.by_scope: dict[str, np.ndarray] = {}
        members: dict[str, list[int]] = {}
        for position, searched in enumerate(scopes):
            for scope in searched:
                members.setdefault(scope, []).append(position)
        for scope, positions in members.items():
            self.by_scope[scope] = np.array(positions)
        self.scopes = pa.array(sorted(members), type=pa.string())


class Best:
    """Running best ``k`` per question, ordered by distance, document and chunk index."""

    def __init__(self, questions: Questions, k: int) -> None:
        self.questions, self.k = questions, k
        self.limit = np.full(len(questions.ids), np.inf)
        self.rows: pa.Table | None = None

    def offer(self, members: np.ndarray, rows: np.ndarray, x: np.ndarray, batch: pa.RecordBatch) -> None:
        """Compare the batch rows ``rows`` with the questions ``members``."""
        step = max(1, _PAIRS // len(members))
        for begin in range(0, len(rows), step):
            self._offer(members, rows[begin : begin + step], x, batch)

    def _offer(self, members, rows, x, batch) -> None:
        q, part = self.questions.vectors[members].astype(np.float64), x[rows]
        squares, asked = np.einsum("ij,ij->i", part, part), self.questions.squares[members]
        # Single precision tells which pairs may matter, and all of these get an exact distance. ``lost`` is the most
        # that the product and the rounding of distances lose, as a share of 1 and both squares.
        single = bool(squares.max() + asked.max() < _SINGLE)
        kind, lost = (np.float32, (x.shape[1] + 16) * 2.0**-23 + 1e-8) if single else (np.float64, 1e-8)
        near = part.astype(kind) @ (-2.0 * q.T).astype(kind)
        near += ((1.0 - lost) * squares).astype(kind)[:, None]
        near += ((1.0 - lost) * asked - lost).astype(kind)[None, :]
        bound = self.limit[members]
        close = near <= bound.astype(kind)[None, :]
        if np.count_nonzero(close) > self.k * len(members) and len(rows) > self.k:
            least = np.partition(near, self.k - 1, axis=0)[self.k - 1]
            bound = np.minimum(bound, least + 2.0 * lost * (1.0 + squares.max() + asked))
            close = near <= bound.astype(kind)[None, :]
        found = np.count_nonzero(close)
        if found > _FOUND and len(rows) > 1:  # many copies: fewer rows at once
            half = len(rows) // 2
            self._offer(members, rows[:half], x, batch)
            self._offer(members, rows[half:], x, batch)
            return
        if not found:
            return
        row, member = np.divmod(np.flatnonzero(close), len(members))
        distance = np.empty(len(row))
        width = max(1, _EXACT // max(1, x.shape[1]))
        for begin in range(0, len(row), width):
            cut = slice(begin, begin + width)
            gap = part[row[cut]] - q[member[cut]]
            distance[cut] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        taken = pa.array(rows[row])
        found = pa.table(
            {
                "query": pa.array(members[member]),
                "distance": pa.array(np.round(distance, DISTANCE_DECIMALS)),
                "document_id": batch.column("document_id").take(taken),
                "chunk_index": batch.column("chunk_index").take(taken),
                "text_hash": batch.column("text_hash").take(taken),
            }
        )
        self._keep(found if self.rows is None else pa.concat_tables([self.rows, found]))

    def _keep(self, rows: pa.Table) -> None:
        rows = rows.take(pc.sort_indices(rows, sort_keys=_ORDER))
        query = rows.column("query").to_numpy()
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        lengths = np.diff(np.r_[first, len(query)])
        rank = np.arange(len(query)) - np.repeat(first, lengths)
        self.rows = rows.filter(pa.array(rank < self.k)).combine_chunks()
        full = lengths >= self.k
        last = rows.column("distance").to_numpy()[first[full] + self.k - 1]
        self.limit[query[first[full]]] = np.square(last)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.rows is None:
            return
        names = pa.array(self.questions.ids, type=pa.string())
        out = pa.table(
            {
                "query_id": names.take(self.rows.column("query")),
                "document_id": self.rows.column("document_id"),
                "chunk_index": self.rows.column("chunk_index"),
                "text_hash": self.rows.column("text_hash"),
                "distance": self.rows.column("distance"),
            }
        ).cast(PARTIAL)
        yield from out.to_batches()
