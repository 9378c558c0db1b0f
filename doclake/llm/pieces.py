"""Token ids of texts, one white-space-free piece at a time, with a memo per worker process.

The word-level vocabularies used here never join tokens across ASCII white space, and their special
strings hold none, so the ids of a text are the ids of its pieces in order. Pieces of printable ASCII
and Latin-1 letters are parted into words here and merged by the library's own model; every other
piece, and any that could hold a special string, is encoded by the library as it stands. A tokenizer
of another kind encodes whole texts.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

#: Entries each memo of a worker may hold before it is emptied: some 120 MB.
MEMO_ENTRIES = 600_000
#: Bytes of text cut into pieces at a time, so that a very long text never becomes one list.
SLICE_BYTES = 1 << 20

_ASCII_SPACE = b" \t\n\r\x0b\x0c"
_WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
_loaded: dict[str, "Vocabulary"] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once per process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


class Vocabulary:
    """A ``tokenizers`` file without truncation or padding."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            declared = json.load(file)
        self.by_pieces = self._splits_at_spaces(declared)
        self.model = self.library.model
        self.letter = _byte_letters()

    @staticmethod
    def _splits_at_spaces(declared: dict) -> bool:
        """Whether the file declares the normalisation and word rule that this module relies on."""
        steps = (declared.get("normalizer") or {}).get("normalizers", [])
        splits = (declared.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"] == {"Regex": _WORD_RULE}
            and splits[0]["behavior"] == "Removed"
            and splits[0]["invert"]
            and not splits[1]["add_prefix_space"]
            and not splits[1]["use_regex"]
            and declared["model"]["end_of_word_suffix"] == "</w>"
            and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["normalized"])
                    for t in declared["added_tokens"])
        )

    def spelled(self, word: str) -> str:
        """A lower-case word as the model's letters, one for each byte."""
        return word if word.isascii() else "".join(map(self.letter.__getitem__, word.encode()))

    def merged(self, word: str) -> list[int]:
        return [token.id for token in self.model.tokenize(self.spelled(word))]

    def encoded(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def whole_words(self) -> list[str]:
        """Vocabulary strings that are proved, by merging them, to be one token when alone."""
        byte = {letter: number for number, letter in enumerate(self.letter)}
        proved = []
        for token, number in self.library.get_vocab(with_added_tokens=False).items():
            try:
                word = bytes(byte[c] for c in token.removesuffix("</w>")).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if _SIMPLE(word) and _WORDS(word) == [word] and self.merged(word) == [number]:
                proved.append(word)
        return proved


def _byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable, else the next free one from U+0100."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(spare)) for b in range(256)]


def slices(text: str | None) -> Iterator[list[bytes]]:
    """Lists of the pieces of a text, each list from about a megabyte of it."""
    data = (text or "").encode("utf-8", "replace")
    start, size = 0, len(data)
    while start < size:
        end = min(start + SLICE_BYTES, size)
        while end < size and data[end] not in _ASCII_SPACE:
            end += 1
        yield data[start:end].split()
        start = end


class Memo(dict):
    """Piece to its value: ``of_word`` gives that of a word, ``of_text`` that of any text, ``total`` adds.

    ``known`` holds values of words that need no merging; they are never dropped.
    """

    def __init__(self, of_word, of_text, total, known: dict | None = None):
        super().__init__()
        self._of_word, self._of_text, self._total = of_word, of_text, total
        self._known = known or {}
        self._words = dict(self._known)

    def of(self, pieces: list[bytes]) -> Iterator:
        """The values of ``pieces``, in order."""
        if len(self) > MEMO_ENTRIES:
            self.clear()
        if len(self._words) > MEMO_ENTRIES + len(self._known):
            self._words = dict(self._known)
        return map(self.__getitem__, pieces)

    def __missing__(self, piece: bytes):
        text = piece.decode("utf-8", "replace")
        if "<|" in text or not _SIMPLE(text):
            value = self._of_text(text)
        else:
            words, found = self._words, []
            for word in _WORDS(text.lower()):
                one = words.get(word)
                if one is None:
                    one = words[word] = self._of_word(word)
                found.append(one)
            value = found[0] if len(found) == 1 else self._total(found)
        self[piece] = value
        return value


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    numbers = array("I", ids)
    if numbers.itemsize != 4:
        numbers = array("L", ids)
    return numbers.tobytes()


def id_memo(vocabulary: Vocabulary) -> Memo:
    return Memo(
        lambda word: packed(vocabulary.merged(word)),
        lambda text: packed(vocabulary.encoded(text)),
        b"".join,
    )


def count_memo(vocabulary: Vocabulary) -> Memo:
    return Memo(
        lambda word: len(vocabulary.merged(word)),
        lambda text: len(vocabulary.encoded(text)),
        sum,
        dict.fromkeys(vocabulary.whole_words(), 1),
    )
