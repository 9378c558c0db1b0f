"""Fill-in-the-middle: documents rearranged so that a model learns to fill a gap.

A document is a piece table: descriptors ``(buffer, begin, length)`` over two immutable buffers, its own
text and the sentinels. Cutting splits descriptors, an arrangement permutes them, the inverse permutation
restores them; bytes are copied once, when a table is written out, and hashes stream its descriptors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Percent of documents that are rearranged, and of these of the form that begins with the suffix.
RATE, SUFFIX_FIRST = 50, 80
#: Order of the slots (<P> prefix <S> suffix <M> middle) in each form.
FORMS = {"psm": (0, 1, 2, 3, 4, 5), "spm": (2, 3, 0, 1, 4, 5)}
#: Slots that hold text, in the order of the text.
READING = (1, 5, 3)
#: Bytes of texts in an Arrow batch that is sent on.
BATCH_BYTES = 1 << 24

TEXT, SENTINELS = 0, 1
_MARKS = (PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode())
_SENTINEL_BUFFER = b"".join(_MARKS)
Piece = tuple[int, int, int]


# --- piece tables ---


def cut(pieces: list[Piece], at: int) -> list[Piece]:
    """The same table with a border at byte ``at``; a border at either end makes an empty piece."""
    out, place = [], 0
    for i, (buffer, begin, length) in enumerate(pieces):
        if at <= place + length:
            left = at - place
            return [*out, (buffer, begin, left), (buffer, begin + left, length - left), *pieces[i + 1 :]]
        out.append((buffer, begin, length))
        place += length
    raise ValueError("the border lies beyond the text")


def views(pieces: Iterable[Piece], *buffers: bytes) -> Iterator[memoryview]:
    held = [memoryview(b) for b in buffers]
    return (held[buffer][begin : begin + length] for buffer, begin, length in pieces)


def sha256(pieces: Iterable[Piece], *buffers: bytes) -> str:
    digest = hashlib.sha256()
    for view in views(pieces, *buffers):
        digest.update(view)
    return digest.hexdigest()


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(sorted(range(len(order)), key=order.__getitem__))


def arrange(prefix: Piece, middle: Piece, suffix: Piece, form: str) -> list[Piece]:
    marks = [(SENTINELS, sum(map(len, _MARKS[:i])), len(_MARKS[i])) for i in range(3)]
    slots = [marks[0], prefix, marks[1], suffix, marks[2], middle]
    return [slots[i] for i in FORMS[form]]


def restored(output: bytes, form: str) -> list[Piece]:
    """The text as pieces of ``output``, found from the output and its form alone.

    A rearranged text holds no sentinel and sentinels do not overlap, so the first of each kind is it.
    """
    if form not in FORMS:
        return [(TEXT, 0, len(output))]
    order, found, at = FORMS[form], [], 0
    for slot in order[::2]:
        begin = output.index(_MARKS[slot // 2], at)
        if found:
            found.append((TEXT, at, begin - at))
        at = begin + len(_MARKS[slot // 2])
        found.append((TEXT, begin, at - begin))
    found.append((TEXT, at, len(output) - at))
    slots = [found[i] for i in inverse(order)]
    return [slots[i] for i in READING]


# --- one document ---


def unit_ends(text: bytes) -> np.ndarray:
    """Where each unit ends: a word with the white space before it, or white space at the end of the text."""
    marks = np.frombuffer(text, np.uint8)
    space = (marks == 32) | ((marks >= 9) & (marks <= 13))
    last = ~space
    last[:-1] &= space[1:]
    ends = np.flatnonzero(last) + 1
    return np.append(ends, len(text)) if len(text) and space[-1] else ends


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers below 2**32 that the document's id decides."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def piece_table(doc_id: int | None, text: bytes, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST):
    """(units, form, pieces, prefix piece or None, middle piece or None) of a document."""
    ends = unit_ends(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    whole = [(TEXT, 0, len(text))]
    if not text or h3 % 100 >= rate or any(mark in text for mark in _MARKS):
        return len(ends), "plain", whole, None, None
    form = "spm" if h4 % 100 < suffix_first else "psm"
    low, high = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    first, second = (int(ends[i - 1]) if i else 0 for i in (low, high))
    prefix, rest = cut(whole, first)
    middle, suffix = cut([rest], second - first)
    return len(ends), form, arrange(prefix, middle, suffix, form), prefix, middle


def code_points(piece: Piece | None, text: bytes) -> int | None:
    """Characters of a piece of UTF-8: its bytes that do not continue one."""
    if piece is None:
        return None
    _, begin, length = piece
    return int(np.count_nonzero(np.frombuffer(text, np.uint8, length, begin) & 0xC0 != 0x80)) if length else 0


# --- documents ---

_SHAPE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, "


def _texts(batch) -> Iterator[tuple[int | None, bytes]]:
    import pyarrow as pa

    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
        yield doc_id, text.as_py() or b""


def _batches(rows: Iterable[tuple[tuple, int]], names: list[str], types: list) -> Iterator:
    """Record batches of ``rows``, each given with its bytes of text."""
    import pyarrow as pa

    held, size = [], 0
    for row, bytes_ in rows:
        held.append(row)
        size += bytes_
        if size > BATCH_BYTES or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def rearrange(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` (doc_id, text) as training texts: doc_id, n (units), form (plain, psm, spm), prefix_chars,
    middle_chars (null if plain), output. One narrow pass.

    What happens to a document depends on its id, its text and the parameters alone, so a task run again
    repeats it; rows without id share the draws of an empty id. Null and empty texts, and texts that hold a
    sentinel, stay plain. Repeated rows give a row each; other columns are ignored; an empty table gives no
    rows.
    """

    def rows(batches: Iterator) -> Iterator:
        for batch in batches:
            for doc_id, text in _texts(batch):
                n, form, pieces, prefix, middle = piece_table(doc_id, text, seed, rate, suffix_first)
                output = b"".join(views(pieces, text, _SENTINEL_BUFFER)).decode("utf-8", "replace")
                yield (doc_id, n, form, code_points(prefix, text), code_points(middle, text), output), len(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield from _batches(rows(batches), ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"], types)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SHAPE + "output string")


def restore(rearranged: DataFrame) -> DataFrame:
    """doc_id and the exact ``text`` of rows with ``output`` and ``form``; null texts come back empty."""

    def rows(batches: Iterator) -> Iterator:
        for batch in batches:
            for (doc_id, output), form in zip(_texts(batch), batch.column(2).to_pylist()):
                text = b"".join(views(restored(output, form), output)).decode("utf-8", "replace")
                yield (doc_id, text), len(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from _batches(rows(batches), ["doc_id", "text"], [pa.int64(), pa.string()])

    return rearranged.select("doc_id", "output", "form").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``rearrange`` with the SHA-256 of the output, and of the text rebuilt from output and form, in place of
    the output itself; nothing but digests leaves the task."""

    def rows(batches: Iterator) -> Iterator:
        for batch in batches:
            for doc_id, text in _texts(batch):
                n, form, pieces, prefix, middle = piece_table(doc_id, text, seed, rate, suffix_first)
                output = b"".join(views(pieces, text, _SENTINEL_BUFFER))
                sums = sha256(pieces, text, _SENTINEL_BUFFER), sha256(restored(output, form), output)
                yield (doc_id, n, form, code_points(prefix, text), code_points(middle, text), *sums), 0

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
        yield from _batches(rows(batches), names, types)

    shape = _SHAPE + "output_sha256 string, restored_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, shape)


def oracle() -> str:
    return r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || doc_id) AS h
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n,
         ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
         ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d
  FROM units),
cuts AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR c >= 50 THEN 'plain'
              WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(a, b)], '') AS prefix,
         array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(u[greatest(a, b) + 1:], '') AS suffix
  FROM drawn)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cuts
"""
