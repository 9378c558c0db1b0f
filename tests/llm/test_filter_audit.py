"""Filter interaction audit against a count document by document."""

import re
from itertools import permutations

import pytest

from doclake.llm import filter_audit as fa

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi".split()
LONG = " ".join(f"{a}{b}" for a in WORDS for b in WORDS)  # 441 words, all different
DOCS = [
    (1, "a", LONG, 1),
    (2, "a", LONG, 1),  # a copy
    (2, "a", LONG, 1),  # the same row again
    (3, "a", "short", 1),
    (4, "b", "short", 1),  # a copy from another part
    (5, "b", "SHOUT " * 60, 1),
    (6, "b", LONG + " 5 %", 1),
    (7, None, None, 1),
    (8, None, "", 1),
    (9, "", " \n\t ", 1),
    (None, "a", "short", 1),  # no id: no copy before it, and before nothing
    (None, "c", "#", 1),
    (10, "b", "same same " * 30, 1),
    (11, "b", "w " * 17 + "\x0b\x0cÄÖÜ ÀÉ \x1cone", 1),
    (0, "z", "AB" + "x" * 38, 1),  # 5 % capitals are not too many
    (-4, "z", "ABC" + "x" * 37, 1),
]
LABELS = [(1, 1, 0, "x"), (2, 1, 1, "x"), (3, 0, 1, "x"), (3, 1, 0, "x"), (4, None, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x"), (8, 1, None, "x")]


def fails_of(rows):
    firsts = {}
    for doc_id, _, text, *_ in rows:
        if doc_id is not None:
            firsts[text or ""] = min(firsts.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, _, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append({
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and firsts[text] < doc_id,
        })
    return out


def brute(rows, labels):
    good = {d for d, q, _, *_ in labels if d is not None and q == 1}
    toxic = {d for d, _, t, *_ in labels if d is not None and t == 1}
    out = {}
    for part in {r[1] or "" for r in rows}:
        own = [(r, f) for r, f in zip(rows, fails_of(rows)) if (r[1] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(range(len(own)))
            for step, letter in enumerate(order, 1):
                gone = [i for i in left if own[i][1][letter]]
                failing = [i for i in range(len(own)) if own[i][1][letter]]
                before = len(failing) - len(gone)
                left = [i for i in left if i not in gone]
                alone = sum(sum(own[i][1].values()) == 1 for i in failing)
                lost = [sum(own[i][0][0] in some for i in gone) for some in (good, toxic)]
                shapley[letter] += len(gone)
                out[part, order, step] = (len(left), len(gone), before, alone, *lost)
        for (p, order, step), values in list(out.items()):
            if p == part:
                out[p, order, step] = (*values[:6], shapley[order[step - 1]])
    return out


def frames(spark, rows, labels):
    # columns named like those that the operator makes
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mask int").repartition(3)
    docs = docs.selectExpr("*", "mask as part", "mask as words", "mask as digest", "mask as n", "mask as first", "mask as good")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string")


def audited(df):
    assert df.columns == ["part", "filter_order", "step", *fa.MEASURES, "shapley"]
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_against_brute_force(spark):
    assert audited(fa.audit(*frames(spark, DOCS, LABELS))) == brute(DOCS, LABELS)


def test_every_order_and_types(spark):
    assert len(fa.ORDERS) == len(set(fa.ORDERS)) == 120 and fa.ORDERS == sorted(fa.ORDERS)
    types = dict(fa.audit(*frames(spark, DOCS, LABELS)).dtypes)
    assert types["step"] == "int" and {types[m] for m in [*fa.MEASURES, "shapley"]} == {"bigint"}


def test_empty_tables(spark):
    docs, labels = frames(spark, DOCS, LABELS)
    assert fa.audit(docs.where("false"), labels).count() == 0
    assert audited(fa.audit(docs, labels.where("false"))) == brute(DOCS, [])


def test_hot_text_and_part(spark):
    rows = [(i, "hot" if i % 3 else None, LONG if i % 2 else f"{LONG} {i}", 1) for i in range(60)] + [(5, "hot", LONG, 1)] * 40
    assert audited(fa.audit(*frames(spark, rows, LABELS))) == brute(rows, LABELS)


@pytest.mark.parametrize("text", ["word " * 200_000, "#" * 1_000_000])
def test_very_long_text(spark, text):
    rows = [(1, "a", text, 1)]
    assert audited(fa.audit(*frames(spark, rows, []))) == brute(rows, [])
