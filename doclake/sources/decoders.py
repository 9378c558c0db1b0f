"""Decoder hooks: bytes of one file to its pages, paragraphs, cells or rows.

A decoder yields dicts with ``kind`` and

- page: i (index from 0), text
- paragraph: i (order), name (style), text
- cell: i (table), j (row), k (column), text
- row: i (sheet), j (row), name (sheet name), cells (list of str)
- record: j (position among the records of the file), header and cells (lists of str)

It raises ``PasswordProtected`` or ``ValueError`` for a rejection with its own message. Only light
per-file work belongs here; splitting, pairing and numbering are DataFrame operators.
"""

from __future__ import annotations

from collections.abc import Iterator

from doclake.schemas import PASSWORD_PROTECTED
from doclake.sources.csv_splits import whole_records


class PasswordProtected(ValueError):
    def __init__(self) -> None:
        super().__init__(PASSWORD_PROTECTED)


def decode_csv(data: bytes) -> Iterator[dict]:
    """Records of a CSV file; undecodable bytes are replaced."""
    for position, header, cells in whole_records(data):
        yield {"kind": "record", "j": position, "header": header, "cells": cells}


# Other kinds have no built-in decoder: callers bring theirs, and without one such files become
# "no_decoder" rejects.
DECODERS = {"csv": decode_csv}
