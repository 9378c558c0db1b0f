"""Fill-in-the-middle: the contract by plain strings, piece tables, and exact round trips."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from doclake.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    None,
    "",
    " ",
    "\n\t  ",
    "word",
    " lead and trail \n",
    "no  break\xa0space\x1cor\x85line",
    "Äpfel 漢字 😀 ünï " * 7,
    "has <P> in it",
    "ends in <S>",
    "<M>",
    "< P> <p> <PP> S> <",
    "<P <S <M P> S> M> " * 9,
    "a b c d e f g h",
    "long text " * 50_000,
]


def plain(doc_id, text, rate=50):
    """Contract by string operations."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(b"42:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def rows():
    cases = [(100 * i + j, t) for i, t in enumerate(TEXTS) for j in range(12 if len(t or "") < 1000 else 3)]
    return [*cases, (None, "a row without an id"), (7, "twice"), (7, "twice"), (7, "the same id"), (-3, "a b c")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, output string, form int")
    return frame.selectExpr("*", "form AS n", "output AS output_sha256").repartition(3)


def key(row):
    return str(row)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_rearrange(docs, rows):
    got = fim.rearrange(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = [plain(*r) for r in rows]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}


def test_restore(docs, rows):
    back = fim.restore(fim.rearrange(docs, rate=100)).collect()
    assert sorted(map(tuple, back), key=key) == sorted([(i, t or "") for i, t in rows], key=key)


def test_digests(docs, rows):
    want = [(*p[:5], sha(p[5]), sha(r[1] or "")) for r, p in zip(rows, (plain(*r) for r in rows))]
    assert sorted(map(tuple, fim.digests(docs).collect()), key=key) == sorted(want, key=key)


def test_empty_table(docs):
    assert fim.rearrange(docs.where("false")).count() == fim.digests(docs.where("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("ab <>PSM\n\té\U0001f600", max_size=60), st.integers(-(2**63), 2**63 - 1))
def test_any_text_comes_back(text, doc_id):
    data = text.encode()
    n, form, pieces, prefix, middle = fim.piece_table(doc_id, data, rate=100)
    output = b"".join(fim.views(pieces, data, b"<P><S><M>"))
    want = plain(doc_id, text, rate=100)
    assert (doc_id, n, form, fim.code_points(prefix, data), fim.code_points(middle, data), output.decode()) == want
    assert b"".join(fim.views(fim.restored(output, form), output)) == data
    assert fim.sha256(pieces, data, b"<P><S><M>") == hashlib.sha256(output).hexdigest()


@given(st.lists(st.integers(0, 40), max_size=6))
def test_cuts_keep_the_text(places):
    text = bytes(range(65, 105))
    pieces = [(fim.TEXT, 0, len(text))]
    for at in places:
        pieces = fim.cut(pieces, at)
        assert b"".join(fim.views(pieces, text)) == text
    assert len(pieces) == len(places) + 1


def test_permutations():
    for order in fim.FORMS.values():
        assert [order[i] for i in fim.inverse(order)] == list(range(6))
    with pytest.raises(ValueError):
        fim.cut([(0, 0, 3)], 4)
