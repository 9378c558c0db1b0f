"""Packing and token counts against the tokenizer library on whole texts."""

import zlib
from array import array

import public_tokenizers
import pytest

from doclake.llm import packing, pieces, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "",
    "  \n ",
    None,
    "don't<|endoftext|>A ΑΣ Σ x\x1cy\x85z é ﬁ 12 a1b2 _x_ 😀",
    "x" * 3000,
    "İstanbul <|startoftext|> <|STARTOFTEXT|>",
    "'S 'tis they'LL ''d 's's ÀÉÎõü×÷ªºµß naïve-cóop 1½ ²",
    "word " * 9000,
    "word " * 9000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(ODD)] + [(None, "no id", "x", "y"), (0, "", "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start string").repartition(3)


def library_ids(text):
    return pieces.vocabulary(PATH).library.encode(text or "", add_special_tokens=False).ids


def test_counts(docs):
    got = token_counts.count_tokens(docs, PATH).collect()
    assert len(got) == len(ODD) + 2
    for row in got:
        text = ODD[row.doc_id] if row.doc_id is not None else "no id"
        n = len(library_ids(text))
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (n, len((text or "").encode()), n > 2048)


def test_counts_by_whole_texts(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = pieces.vocabulary(path).library
    assert not pieces.vocabulary(path).by_pieces
    for row in token_counts.count_tokens(docs.where("doc_id < 7"), path).collect():
        assert row.n_tokens == len(library.encode(ODD[row.doc_id] or "", add_special_tokens=False).ids)


def test_packing_round_trip(docs):
    got = packing.pack(docs, PATH).orderBy("sequence_id", "offset").collect()
    place, texts = 0, {}
    for row in got:
        assert (row.sequence_id, row.offset) == divmod(place, packing.LENGTH)
        assert row.length > 0 and len(row.ids) == 4 * row.length
        place += row.length
        texts.setdefault((row.doc_id, row.doc_tokens), []).append((row.start, row.ids))
    for (doc_id, n), parts in texts.items():
        if doc_id == 0:
            continue  # two rows with this id
        ids = array("I", b"".join(ids for _, ids in sorted(parts)))
        text = ODD[doc_id] if doc_id is not None else "no id"
        assert list(ids) == library_ids(text) + [1] and len(ids) == n
    assert place == sum(len(library_ids(t)) + 1 for t in [*ODD, "no id", ""])


def test_sequences_and_digests(docs):
    cut = packing.pack(docs, PATH)
    whole = packing.sequences(cut).orderBy("sequence_id").collect()
    assert all(row.n_ids == packing.LENGTH for row in whole[:-1])
    sums = packing.digests(cut).where("doc_id = 3").collect()
    want = array("I", library_ids(ODD[3]) + [1]).tobytes()
    assert sorted((s.start, s.ids_crc32) for s in sums) == [
        (s.start, zlib.crc32(want[4 * s.start : 4 * (s.start + s.length)])) for s in sorted(sums, key=lambda s: s.start)
    ]
    assert sum(s.length for s in sums) * 4 == len(want)


def test_partition_offsets_over_runs(spark):
    parts = spark.createDataFrame(
        [(p, i, i + 1) for p in range(0, 2600, 3) for i in (0, 1)], "part int, start long, doc_tokens long"
    ).where("start = 0")
    got = {r.part: r.part_at for r in packing.partition_offsets(parts).collect()}
    assert got == {p: i for i, p in enumerate(range(0, 2600, 3))}


def test_empty(docs):
    none = docs.where("doc_id = -1")
    assert packing.pack(none, PATH).count() == 0 and token_counts.count_tokens(none, PATH).count() == 0
