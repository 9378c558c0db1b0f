"""Surrogates: what is found, how it is replaced, and that entities stay apart and together."""

import random
import re

import pytest
from pyspark.sql import functions as F

from doclake.llm import surrogates as su

TEXTS = {
    1: "Write to Anna.Lee42@mail7.example.com or anna.lee42@mail7.example.com, not to bob@mail7.example.com.",
    2: "Call +1 (555) 123-4567, +1 555-123-4567 or (555) 765-4321; card 4111111111111111 and 4111 1111 1111 1111.",
    3: 'Host 192.168.10.7 has token = "f9ab19ba9a9d9df9b9dbc9ec9" and 123-45-6789',
    4: "Mr. John Smith met Mrs Mary Smith. Later Mr. Smith and John Smith left; Иван Петров stayed with Frau Müller.",
    5: "Nothing here, 12 apples and version 1.2 at 10:30, a=b, 5551234.",
    6: None,
    7: "",
    8: "anna.lee42@mail7.example.com" * 1,
    9: "x " * 50000 + "bob@mail7.example.com",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, v, 3, "x") for k, v in TEXTS.items()] + [(8, TEXTS[8], 3, "x"), (None, TEXTS[8], 3, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars int, kind string").repartition(2)


@pytest.fixture(scope="module")
def replaced(docs):
    return {r.doc_id: r for r in su.replace_entities(docs, "key").collect()}


def found(text):
    return re.findall(r"[\w.]+@[\w.]+", text)


def test_columns_and_untouched_rows(docs, replaced):
    out = su.replace_entities(docs, "key")
    assert out.dtypes == docs.dtypes and out.count() == docs.count()
    for k in (5, 6, 7):
        assert replaced[k].text == TEXTS[k]
    assert replaced[1].n_chars == len(replaced[1].text)
    assert replaced[9].text.startswith("x " * 50000) and "bob@" not in replaced[9].text


def test_clashing_columns(spark):
    """Columns named like the operator's own come back as they were, and no entity stays in any of them."""
    names = ["row", "redrawn", "entities", "text_key", "of_id", "of_text", "attempt", "key", "entity", "canon", "drawn", "_entities", "_doc", "a.b"]
    rows = [(i, f"{i}.{i + 1}.1.{k} and so on", 1, *names) for i in range(5) for k in range(9)] + [(None, "0.1.1.2", 1, *names), (None, "4.5.1.8", 1, *names)]
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema).repartition(3)
    assert su.assign(docs, "k").where("attempt > 0").count() > 0  # some had to draw again
    out = su.replace_entities(docs, "k")
    assert out.dtypes == docs.dtypes
    by_canon = {r.canon: r.drawn for r in su.assign(docs, "k").collect()}
    got = out.collect()
    assert len(got) == len(rows) and all(list(r)[3:] == names and r.n_chars == len(r.text) for r in got)
    want = sorted((str(i), t.replace(t.split()[0], by_canon[t.split()[0]])) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.text) for r in got) == want


def test_many_redraws_meet_by_a_shuffle(spark, monkeypatch):
    rows = [(i, f"{i}.{k}.1.1 x") for i in range(6) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(map(str, su.replace_entities(docs, "k").collect()))
    monkeypatch.setattr(su, "BROADCAST_KEYS", 0)
    assert sorted(map(str, su.replace_entities(docs, "k").collect())) == few


def brute_corpus():
    rng = random.Random(4)
    mails = [f"{rng.choice('abc')}{rng.choice('de')}@x{n}.org" for n in range(4)] * 5
    hosts = [f"{a}.{b}.1.1" for a in range(3) for b in range(4)]
    cards = ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004"]
    people = ["Mr Li", "Mr Lu", "Mrs Li", "Dr. Anna Lee", "Mr. John Smith", "Mrs. Smith"]
    pool = mails + hosts + cards + people
    return [(i, ", ".join(rng.sample(pool, 4)) + f" and words {i}") for i in range(60)]


def test_corpus_against_brute_force(spark):
    """Over a corpus: everything found goes, no two of a kind share a surrogate, none is an entity of the corpus, and
    one entity has one surrogate in all documents."""
    rows = brute_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = [(r.doc_id, r.entity, r.kind, r.canon) for r in su.occurrences(docs).collect()]
    after = su.replace_entities(docs, "k")
    new = [(r.doc_id, r.entity, r.kind, r.canon) for r in su.occurrences(after).collect()]
    assert sorted((i, k) for i, _, k, _ in found) == sorted((i, k) for i, _, k, _ in new)
    real, given = {(k, c) for _, _, k, c in found}, {}
    assert not real & {(k, c) for _, _, k, c in new}
    texts = {r.doc_id: r.text for r in after.collect()}
    for doc_id, text in rows:
        olds = sorted((text.index(e), e, k, c) for i, e, k, c in found if i == doc_id)
        news = sorted((texts[doc_id].index(e), e, k, c) for i, e, k, c in new if i == doc_id)
        rest, left = text, texts[doc_id]
        for (_, e, kind, canon), (_, n, _, drawn) in zip(olds, news):
            assert given.setdefault((kind, canon), drawn) == drawn
            rest, left = rest.replace(e, "\0", 1), left.replace(n, "\0", 1)
        assert rest == left  # all but the entities is as it was
    assert len({(k, d) for (k, _), d in given.items()}) == len(given) == len(real)


def test_emails(replaced):
    first, same, other = found(replaced[1].text.replace(".com.", ".com"))
    assert first.lower() == same and first != same and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{2}\d\d@[a-z]{4}\d\.[a-z]{7}\.com", first)
    assert other != same and other.split("@")[1] == same.split("@")[1]
    assert replaced[8].text == same == replaced[None].text and other in replaced[9].text
    assert same not in TEXTS[1] and other not in TEXTS[1]


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(digits)) % 10


def test_numbers(replaced):
    text = replaced[2].text
    a, b = re.findall(r"\+1 [(]?\d{3}[)]?[ -]\d{3}-\d{4}", text)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "15551234567"
    c, d = re.search(r"card (\d{16}) and (\d{4} \d{4} \d{4} \d{4})", text).groups()
    assert c == d.replace(" ", "") != "4111111111111111" and luhn(c) == luhn("4111111111111111") == 0
    assert "765-4321" not in text and re.search(r"\(\d{3}\) \d{3}-\d{4};", text)


def test_addresses_and_secrets(replaced):
    host, token, social = re.fullmatch(r'Host (\S+) has token = "(\w+)" and (\S+)', replaced[3].text).groups()
    assert re.fullmatch(r"\d{3}\.\d{3}\.\d\d\.\d", host) and all(int(p) < 256 for p in host.split("."))
    assert host != "192.168.10.7" and token != "f9ab19ba9a9d9df9b9dbc9ec9" and len(token) == 25
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", social) and social != "123-45-6789"


def test_persons(replaced):
    text = replaced[4].text
    m = re.fullmatch(
        r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+)\. Later Mr\. (\w+) and (\w+) (\w+) left; (\w+) (\w+) stayed with Frau (\w+)\.", text
    ).groups()
    assert m[0] in su.POOLS["latin male"] and m[2] in su.POOLS["latin female"] and m[7] in su.POOLS["cyrillic male"]
    assert m[1] == m[3] == m[4] == m[6] != "Smith" and m[0] == m[5]
    assert re.fullmatch(r"[А-ЯЁ][а-яё]+", m[8]) and m[8] != "Петров" and m[9] != "Müller"


def test_distinct_and_fresh(spark):
    rows = [(i, f"{a}.{b}.1.{c} u{i % 7}@m.example.com") for i, (a, b, c) in enumerate((x, y, z) for x in range(5) for y in range(9) for z in range(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    drawn = su.assign(docs, "k").collect()
    assert max(r.attempt for r in drawn) > 0  # small ranges do collide
    for kind in ("address", "email"):
        mine = [r for r in drawn if r.kind == kind]
        real = {r.canon for r in mine}
        assert len({r.drawn for r in mine}) == len(mine) == len(real) and not real & {r.drawn for r in mine}
    by_canon = {r.canon: r.drawn for r in drawn}
    for row in su.replace_entities(docs, "k").collect():
        assert row.text.split() == [by_canon[e] for e in rows[row.doc_id][1].split()]


def test_keys_and_repeats(docs):
    one = {r.doc_id: r.text for r in su.replace_entities(docs, "key").collect()}
    two = {r.doc_id: r.text for r in su.replace_entities(docs, "other").collect()}
    assert one[1] != two[1]
    assert su.replace_entities(docs.where("false")).count() == 0


def test_no_python_in_the_plan(docs):
    plan = su.replace_entities(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas", plan)
    assert su.entities(F.col("text")) is not None


def test_full_classes_are_widened(spark):
    """Of about a hundred two-letter surnames 80 are taken, so that no assignment among them exists."""
    people = [f"Mr {a}{b}" for a in "BCDFGHJKLMNPQRSTVWXYZ" for b in "aeiou"][:80]
    docs = spark.createDataFrame(list(enumerate(people)), "doc_id long, text string").coalesce(1)
    drawn = su.assign(docs, "k").collect()
    real = {r.canon for r in drawn}
    assert max(r.attempt for r in drawn) >= su.WIDEN
    assert len({r.drawn for r in drawn}) == len(drawn) == len(real) == 80 and not real & {r.drawn for r in drawn}


def test_wide_surrogates_are_of_their_kind(spark):
    texts = ["1.2.3.4", "Mr Li", "Herr Ли", "Mr Λι", "a@b.io", "token=aaaaaaaa", "+49 1-22-33", "(555) 123-4567"]
    entity = F.col("text")
    made = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", su.kind_of(entity).alias("kind"), su.surrogate(entity, su.kind_of(entity), F.lit(su.WIDEN), "k").alias("new")
    )
    for r in made.select("*", su.entities(F.col("new")).alias("found"), su.kind_of(F.col("new")).alias("again")).collect():
        assert r.found == [r.new] and r.again == r.kind and r.new != r.text, r
