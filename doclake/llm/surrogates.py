"""Personal data replaced by keyed surrogates, in built-in functions only.

An entity is found by its pattern and brought to a canonical form (lower case; digits alone for numbers), so
that all its spellings are one entity. Its surrogate is drawn from a keyed hash of kind and canonical form:
letters become letters of the same case, script and sort (vowel or consonant), digits digits, punctuation
stays; first names become first names of the same gender and script; addresses stay valid, and card numbers
keep whether their check digit holds. All entities of the corpus are then checked: where two would share a
surrogate, or a surrogate is itself an entity, the later ones draw again. Draws keep length and sorts of
letters, so a class of short values can run full; from the ``WIDEN``-th attempt on, entities draw from a wider
class: any octets, longer names, local parts and secrets, telephone numbers of 23 digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from doclake.llm.common import BROADCAST_KEYS, bounded_broadcast, staged, text_key

KEY = "change me"
ROUNDS = 40
#: The attempt from which an entity may leave its class.
WIDEN = 6

# Titles by gender, first names by gender and script.
MALE_TITLES = ["Mr", "Mister", "Herr", "Señor", "Sr", "Monsieur", "Sir"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Lady"]
TITLES = [*MALE_TITLES, *FEMALE_TITLES, "Dr", "Prof"]
NAMES = {
    "latin male": "James John Robert Michael William David Richard Thomas Charles Daniel Peter Paul Mark George "
    "Hans Klaus Jürgen Pierre Jacques Carlos Juan Miguel Pedro Antonio",
    "latin female": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Emma Julia Laura "
    "Helga Ursula Monika Camille Sophie Carmen Lucía Isabel Pilar Teresa",
    "cyrillic male": "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Олег Павел",
    "cyrillic female": "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана Юлия Вера",
}
POOLS = {sort: names.split() for sort, names in NAMES.items()}

#: Letters of one sort: a letter is replaced by another of its row.
ROWS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
DIGITS = "0123456789"

_NAME = r"\p{Lu}\p{Ll}+(?:[-']\p{Lu}\p{Ll}+)?"
_FIRST = "|".join(name for pool in POOLS.values() for name in pool)
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}"
SECRET = r"""(?i:\b(?:token|secret|password|passwd|api[_-]?key))\s{0,3}[=:]\s{0,3}["']?[A-Za-z0-9_/+-]{8,}"""
ADDRESS = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-])"
PHONE = (
    r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
)
PERSON = (
    rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\b\.?[ ]{_NAME}(?:[ ]{_NAME})?|(?:{_FIRST})[ ]{_NAME})(?!\p{{L}})"
)
PATTERN = "|".join([EMAIL, SECRET, ADDRESS, SOCIAL, CARD, PHONE, PERSON])
#: What every entity holds: texts without it are not searched.
#: The look at the next letter spares most places the long list of names.
HINT = rf"[@\d=:]|(?<!\p{{L}})(?=\p{{Lu}})(?:{'|'.join(TITLES)}|{_FIRST})\.?[ ]"


def entities(text: Column) -> Column:
    """All entities of a text in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def kind_of(entity: Column) -> Column:
    """The kind of something that ``entities`` found."""
    kinds = [("secret", SECRET), ("email", EMAIL), ("address", ADDRESS), ("social", SOCIAL), ("card", CARD), ("phone", PHONE)]
    out = F.lit("person")
    for name, pattern in reversed(kinds):
        out = F.when(entity.rlike(rf"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _value(entity: Column) -> Column:
    """The part of a secret after its label and quotation mark."""
    return F.regexp_extract(entity, r"[A-Za-z0-9_/+-]{8,}$", 0)


def _names(entity: Column) -> Column:
    """A person without the title."""
    return F.regexp_replace(entity, rf"^(?:{'|'.join(TITLES)})\b\.? ", "")


def canonical(entity: Column, kind: Column) -> Column:
    digits = F.regexp_replace(entity, r"\D", "")
    return (
        F.when(kind.isin("card", "phone", "social"), digits)
        .when(kind == "secret", _value(entity))
        .when(kind == "person", F.lower(_names(entity)))
        .otherwise(F.lower(entity))
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _draw(stream: Column, at: Column) -> Column:
    """The ``at``-th byte of a hash written in hexadecimal, round and round."""
    return F.conv(F.substring(stream, F.pmod(at, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _stream(key: str, kind: str, name: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), name, attempt.cast("string")), 512)


def scrambled(text: Column, stream: Column, skip: Column | None = None) -> Column:
    """``text`` with letters and digits moved within their rows; the n-th letter or digit takes the n-th
    byte, so that separators and case make no difference. The first ``skip`` characters stay."""
    rows = [*ROWS, *(row.upper() for row in ROWS), DIGITS]
    letters = F.lit("".join(rows))
    # for each letter in a row: where its row begins and how long it is
    begins = [sum(map(len, rows[:k])) for k, row in enumerate(rows) for _ in row]
    begins, sizes = (F.expr(f"array({','.join(map(str, v))})") for v in (begins, [len(row) for row in rows for _ in row]))

    def one(i: Column) -> Column:
        letter = F.substring(text, i, F.lit(1))
        at = F.length(F.regexp_replace(F.substring(text, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        place = F.instr(letters, letter) - 1
        begin, size = F.get(begins, place), F.get(sizes, place)
        step = 1 + F.pmod(_draw(stream, at), size - 1)  # never to itself
        moved = F.substring(letters, begin + F.pmod(place - begin + step, size) + 1, F.lit(1))
        kept = (place < 0) if skip is None else (place < 0) | (i <= skip)
        return F.when(kept, letter).otherwise(moved)

    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, one), "")


#: Letters that stand for hexadecimal digits in a longer name.
_LONGER = {"latin": "aeioubdfgklmnprt", "cyrillic": "аеиоубдгклмнпрст", "greek": "αειουβδγκλμνπρστ"}


def _more(key: str, kind: str, name: Column, attempt: Column) -> Column:
    """Hexadecimal digits to add to a value that left its class, none before; more with every attempt."""
    digits = F.substring(_stream(key, f"more {kind}", name, attempt), F.lit(1), 8 + 2 * (attempt - WIDEN))
    return F.when(attempt >= WIDEN, digits).otherwise(F.lit(""))


def _email(entity: Column, key: str, attempt: Column) -> Column:
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    ending = F.regexp_extract(domain, r"\.[A-Za-z]+$", 0)
    name = F.substring(domain, F.lit(1), F.length(domain) - F.length(ending))
    ours = _let(_stream(key, "email", F.lower(entity), attempt), lambda s: scrambled(local, s))
    theirs = _let(_stream(key, "domain", F.lower(domain), F.lit(0)), lambda s: scrambled(name, s))
    return F.concat(ours, _more(key, "email", F.lower(entity), attempt), F.lit("@"), theirs, ending)


def _address(entity: Column, key: str, attempt: Column) -> Column:
    def octet(part: Column, i: Column, stream: Column) -> Column:
        n, k = part.cast("int"), _draw(stream, i * 3) * 256 + _draw(stream, i * 3 + 1)
        low = F.when((n < 10) | (attempt >= WIDEN), 0).when(n < 100, 10).otherwise(100)
        size = F.when(attempt >= WIDEN, 256).when(n < 10, 10).when(n < 100, 90).otherwise(156)
        return (low + F.pmod(n - low + k, size)).cast("string")

    stream = _stream(key, "address", entity, attempt)
    return _let(stream, lambda s: F.array_join(F.transform(F.split(entity, r"\."), lambda p, i: octet(p, i, s)), "."))


def _check_sum(digits: Column) -> Column:
    """The sum of a number's digits, every second from the right doubled, as for card numbers."""
    def term(letter: Column, i: Column) -> Column:
        n = letter.cast("int") * (1 + F.pmod(i, F.lit(2)))
        return F.when(n > 9, n - 9).otherwise(n)

    letters = F.split(F.reverse(digits), "")
    return F.aggregate(F.transform(letters, term), F.lit(0), lambda total, n: total + n)


def _card(entity: Column, key: str, attempt: Column) -> Column:
    number = F.regexp_replace(entity, r"\D", "")

    def finish(moved: Column) -> Column:
        wanted, got = _check_sum(number), _check_sum(F.regexp_replace(moved, r"\D", ""))
        last = F.substring(moved, F.length(moved), F.lit(1)).cast("int")
        digit = F.pmod(last + wanted - got, F.lit(10)).cast("string")
        return F.concat(F.substring(moved, F.lit(1), F.length(moved) - 1), digit)

    return _let(_let(_stream(key, "card", number, attempt), lambda s: scrambled(entity, s)), finish)


def _phone(entity: Column, kind: str, key: str, attempt: Column) -> Column:
    """The country code stays, unless a telephone number leaves its class."""
    code = F.length(F.regexp_extract(entity, r"^\+\d{1,3}(?=[ .(-])", 0))
    stream = _stream(key, kind, F.regexp_replace(entity, r"\D", ""), attempt)
    near = _let(stream, lambda s: scrambled(entity, s, code))
    if kind == "social":
        return near  # a thousand million of one form
    digits = F.translate(F.substring(stream, F.lit(1), F.lit(23)), "abcdef", "012345")
    wide = F.regexp_replace(digits, r"^(\d{3})(\d{4})(\d{4})(\d{4})(\d{4})(\d{4})$", "+$1 $2 $3 $4 $5 $6")
    return F.when(attempt >= WIDEN, wide).otherwise(near)


def _person(entity: Column, key: str, attempt: Column) -> Column:
    """Title kept, first name drawn from its gender and script, surname scrambled by itself, so that one
    family name stays one."""
    names = _names(entity)
    title = F.substring(entity, F.lit(1), F.length(entity) - F.length(names))
    first, surname = F.regexp_extract(names, r"^(.*?) ", 1), F.regexp_extract(names, r"([^ ]*)$", 1)
    bare = F.regexp_replace(title, r"[. ]", "")
    script = F.when(names.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    listed = lambda names: F.split(F.lit(" ".join(names)), " ")
    women = [n for s, pool in POOLS.items() if s.endswith(" female") for n in pool]
    female = F.array_contains(listed(FEMALE_TITLES), bare) | (
        ~F.array_contains(listed(MALE_TITLES), bare) & F.array_contains(listed(women), first)
    )
    sort = F.concat_ws(" ", script, F.when(female, F.lit("female")).otherwise(F.lit("male")))

    def drawn(stream: Column) -> Column:
        number = _draw(stream, F.lit(0)) * 256 + _draw(stream, F.lit(1))
        out = F.lit("")
        for name, pool in POOLS.items():
            out = F.when(sort == name, F.get(listed(pool), F.pmod(number, F.lit(len(pool))))).otherwise(out)
        return out

    given = F.when(first == "", F.lit("")).otherwise(
        F.concat(_let(_stream(key, "first", F.lower(first), attempt), drawn), F.lit(" "))
    )
    # drawing again changes the surname of this person alone
    family = _let(_stream(key, "surname", F.when(attempt > 0, F.lower(names)).otherwise(F.lower(surname)), attempt), lambda s: scrambled(surname, s))
    more = _more(key, "surname", F.lower(names), attempt)
    letters = F.when(script == "cyrillic", F.translate(more, "0123456789abcdef", _LONGER["cyrillic"])).when(
        names.rlike(r"\p{IsGreek}"), F.translate(more, "0123456789abcdef", _LONGER["greek"])
    )
    more = F.coalesce(letters, F.translate(more, "0123456789abcdef", _LONGER["latin"]))
    return F.concat(title, given, family, more)


def surrogate(entity: Column, kind: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a spelling of an entity."""
    value = _value(entity)
    secret = F.concat(
        F.substring(entity, F.lit(1), F.length(entity) - F.length(value)),
        _let(_stream(key, "secret", value, attempt), lambda s: scrambled(value, s)),
        _more(key, "secret", value, attempt),
    )
    return (
        F.when(kind == "email", _email(entity, key, attempt))
        .when(kind == "secret", secret)
        .when(kind == "address", _address(entity, key, attempt))
        .when(kind == "card", _card(entity, key, attempt))
        .when(kind == "social", _phone(entity, "social", key, attempt))
        .when(kind == "phone", _phone(entity, "phone", key, attempt))
        .otherwise(_person(entity, key, attempt))
    )


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``entity``, ``kind`` and ``canon`` of every entity found."""
    # the outer form, as the plain one would search every text twice: once to see whether anything comes out
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key(F.col("doc_id"), F.col("text")).alias("text_key"),
        F.explode_outer(entities(F.col("text"))).alias("entity"),
    )
    found = found.where(F.col("entity").isNotNull()).select("*", kind_of(F.col("entity")).alias("kind"))
    return found.select("*", canonical(F.col("entity"), F.col("kind")).alias("canon"))


def assign(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``kind``, ``canon``, ``attempt`` and ``drawn`` of all entities of ``docs``: no two entities of a kind
    have the same ``drawn``, and none is an entity of ``docs``."""
    found = occurrences(docs).groupBy("kind", "canon").agg(F.min("entity").alias("entity"))
    current = staged(found, "entities").withColumn("attempt", F.lit(0))

    def with_draw(frame: DataFrame) -> DataFrame:
        made = surrogate(F.col("entity"), F.col("kind"), F.col("attempt"), key)
        return frame.withColumn("drawn", canonical(made, F.col("kind")))

    current = staged(with_draw(current), "drawn")
    for _ in range(ROUNDS):
        first = current.groupBy("kind", "drawn").agg(F.min("canon").alias("_first"))
        real = current.select("kind", F.col("canon").alias("drawn"), F.lit(True).alias("_real"))
        marked = current.join(first, ["kind", "drawn"]).join(real, ["kind", "drawn"], "left")
        again = F.col("_real").isNotNull() | (F.col("canon") != F.col("_first"))
        marked = staged(marked.withColumn("_again", again).drop("_first", "_real"), "marked")
        if marked.where("_again").isEmpty():
            return marked.drop("_again")
        retried = with_draw(marked.where("_again").withColumn("attempt", F.col("attempt") + 1).drop("drawn"))
        kept = marked.where("not _again")
        current = staged(kept.unionByName(retried).select(current.columns), "drawn")
    raise RuntimeError("surrogates still collide")


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced; ``n_chars``, if there, is that of the new text.

    Null and empty texts and texts without entities stay as they are. Repeated rows get the same
    surrogates, rows without an id too; other columns are kept whatever their names; an empty table stays
    empty. Which entities had to draw again is brought to their documents by a join: of up to
    ``BROADCAST_KEYS`` entries without a shuffle of documents. A row without id is known by its text.
    """
    redrawn = assign(docs, key).where("attempt > 0").select("kind", "canon", "attempt")
    columns = docs.columns
    # the caller's columns travel in one struct, so that no name of theirs meets one of ours
    others = [c for c in columns if c not in ("text", "n_chars")]
    work = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key(F.col("doc_id"), F.col("text")).alias("text_key"),
        F.col("text"),
    )
    redraws = redrawn.count()
    if redraws == 0:
        work = work.withColumn("redrawn", F.lit(None).cast("map<string,int>"))
    else:
        entry = F.struct(F.concat_ws("\x1f", "kind", "canon").alias("key"), "attempt").alias("entry")
        entries = occurrences(docs).join(bounded_broadcast(redrawn, redraws, BROADCAST_KEYS), ["kind", "canon"])
        entries = staged(entries.select("doc_id", "text_key", entry).distinct(), "redrawn")
        ids, texts = F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_text")
        maps = entries.groupBy(ids, texts).agg(F.map_from_entries(F.collect_list("entry")).alias("redrawn"))
        maps = bounded_broadcast(maps, entries.count(), BROADCAST_KEYS)
        own = F.col("doc_id").eqNullSafe(F.col("of_id")) & F.col("text_key").eqNullSafe(F.col("of_text"))
        work = work.join(maps, own, "left")
    work = work.withColumn("entities", entities(F.col("text")))

    def new(entity: Column) -> Column:
        kind = kind_of(entity)

        def made(kind: Column) -> Column:
            attempt = F.coalesce(F.col("redrawn")[F.concat_ws("\x1f", kind, canonical(entity, kind))], F.lit(0))
            return surrogate(entity, kind, attempt, key)

        return _let(kind, made)

    between = F.split("text", PATTERN, -1)
    mixed = F.zip_with(between, F.transform("entities", new), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    text = F.when(F.size("entities") > 0, F.array_join(mixed, "")).otherwise(F.col("text"))
    work = work.withColumn("text", text)
    made = {"text": F.col("text")}
    if "n_chars" in columns:
        made["n_chars"] = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return work.select(*[made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in columns])
