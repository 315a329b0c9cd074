"""Personal data replaced by surrogates, with column expressions alone.

One pattern finds all entities of a text. A surrogate is a keyed function of the entity's kind and value: the
same entity has the same surrogate in every document, and it keeps the kind's form. Numbers go through a
keyed permutation of all numbers with as many digits (a Feistel network), so different ones stay different;
addresses, secrets and names are written character by character or from tables of names by gender and
script. All surrogates are checked against each other and against all real entities; one that collides is
made again with another attempt number, and only documents with such an entity are joined with these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderframe.llm.common import Query, fresh, table
from girderframe.session import stored, stored_if_any

KEY = "surrogates"

# Titles with the gender they show, and common given names by gender and script.
MALE_TITLES = "Mr|Herr|Monsieur|Señor|Sr|Don|Г-н|Господин"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Doña|Г-жа|Госпожа"
OTHER_TITLES = "Dr|Prof|Mx"
GIVEN = {
    ("latin", "m"): ["Adam", "Ben", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Niklas", "Oscar", "Paul"],
    ("latin", "f"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Frida", "Greta", "Helena", "Ida", "Julia", "Klara", "Lena", "Maria", "Nora", "Olga", "Paula"],
    ("latin", "x"): ["Alex", "Chris", "Jamie", "Kim", "Luca", "Morgan", "Robin", "Sam"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Олег", "Павел", "Антон", "Борис", "Виктор", "Игорь"],
    ("cyrillic", "f"): ["Анна", "Ольга", "Мария", "Елена", "Ирина", "Вера", "Нина", "Дарья"],
    ("cyrillic", "x"): ["Саша", "Женя", "Валя", "Слава"],
}
SYLLABLES = {"latin": ["ba", "dor", "fel", "gan", "hol", "jen", "kas", "lin", "mer", "nov", "pel", "ros", "sten", "tal", "vin", "wes"], "cyrillic": ["ба", "дор", "фел", "ган", "кас", "лин", "мер", "нов"]}

_SECRET = r"(?i:password|passwd|pwd|secret|token|api[_\-]?key)"
_TITLE = rf"(?=[MHSDFPГ])(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})"
#: Patterns by kind, in order of precedence.
KINDS = {
    "email": r"(?<![\p{L}0-9._%+\-])[\p{L}0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "secret": rf"(?<=[=:\s\"'])(?<=[=:][\s\"']{{0,4}})(?<={_SECRET}\s{{0,3}}[=:]\s{{0,3}}[\"']{{0,1}})[A-Za-z0-9_\-./+]{{8,}}",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    # Ahead of account numbers: none of 32 characters or more has hexadecimal ones alone.
    "hex": r"\b(?=[A-Fa-f]*\d)[0-9A-Fa-f]{32,64}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\w)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w\-])",
    "name": rf"\b{_TITLE}\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every entity contains; other texts are not searched.
QUICK = rf"[0-9@]|[=:](?<={_SECRET}\s{{0,3}}[=:])|{_TITLE}\.? \p{{Lu}}"


def entities(text: Column) -> Column:
    """All entities of a text in order."""
    return F.when(text.rlike(QUICK), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(value: Column) -> Column:
    kind = F.lit("secret")
    for name, pattern in reversed([(k, p) for k, p in KINDS.items() if k != "secret"]):
        kind = F.when(value.rlike(rf"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _number(*parts: Column | str) -> Column:
    """A keyed number below 2^60."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _permuted(digits: Column, key: str, attempt: Column) -> Column:
    """Another number with as many digits; different numbers stay different."""
    size = F.length(digits)
    left_size = F.floor(size / 2)
    a, b = F.pow(F.lit(10), left_size).cast("long"), F.pow(F.lit(10), size - left_size).cast("long")
    half = lambda text: F.coalesce(text.cast("long"), F.lit(0))
    state = F.struct(half(F.substr(digits, F.lit(1), left_size)).alias("l"), half(F.substr(digits, left_size + 1)).alias("r"))
    for turn in range(3):
        state = _let(state, lambda s, t=turn: F.struct(F.pmod(s.l + F.pmod(_number(key, f"l{t}", size, attempt, s.r), a), a).alias("l"), s.r.alias("r")))
        state = _let(state, lambda s, t=turn: F.struct(s.l.alias("l"), F.pmod(s.r + F.pmod(_number(key, f"r{t}", size, attempt, s.l), b), b).alias("r")))
    padded = lambda n, width: F.lpad(n.cast("string"), width, F.lit("0"))
    return _let(state, lambda s: F.concat(F.when(left_size > 0, padded(s.l, left_size)).otherwise(F.lit("")), padded(s.r, size - left_size)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced by ``digits`` in order."""
    at = lambda i: F.substr(form, i, F.lit(1))
    nth = lambda i: F.length(_digits(F.substr(form, F.lit(1), i)))
    places = F.sequence(F.lit(1), F.length(form))
    return _let(digits, lambda d: F.array_join(F.transform(places, lambda i: F.when(at(i).rlike(r"\d"), F.substr(d, nth(i), F.lit(1))).otherwise(at(i))), ""))


def _check_digit(payload: Column) -> Column:
    """Luhn's check digit of all digits but the last."""
    size = F.length(payload)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(payload, size - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(F.lit(10) - F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add) % 10, F.lit(10))


def _card(value: Column, key: str, attempt: Column) -> Column:
    """Keeps the first digit, and whether the check digit is right."""

    def made(d: Column) -> Column:
        size = F.length(d)
        off = F.pmod(F.substr(d, size).cast("int") - _check_digit(F.substr(d, F.lit(1), size - 1)), F.lit(10))
        payload = F.concat(F.substr(d, F.lit(1), F.lit(1)), _permuted(F.substr(d, F.lit(2), size - 2), key + "card", attempt))
        return _let(payload, lambda new: F.concat(new, F.pmod(_check_digit(new) + off, F.lit(10)).cast("string")))

    return _refilled(value, _let(_digits(value), made))


def _ip(value: Column, key: str, attempt: Column) -> Column:
    part = lambda k: F.element_at(F.split(value, r"\."), k).cast("long")
    state = F.struct((part(1) * 256 + part(2)).alias("l"), (part(3) * 256 + part(4)).alias("r"))
    for turn in range(3):
        state = _let(state, lambda s, t=turn: F.struct(F.pmod(s.l + _number(key, f"ipl{t}", attempt, s.r), F.lit(65536)).alias("l"), s.r.alias("r")))
        state = _let(state, lambda s, t=turn: F.struct(s.l.alias("l"), F.pmod(s.r + _number(key, f"ipr{t}", attempt, s.l), F.lit(65536)).alias("r")))
    return _let(state, lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s.l / 256), s.l % 256, F.floor(s.r / 256), s.r % 256)]))


def _rewritten(value: Column, key: str, attempt: Column) -> Column:
    """Letters become letters of the same case and digits digits; a-f stay hexadecimal in hexadecimal values."""
    digest = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(k)), attempt.cast("string"), value), 256) for k in range(2)])

    def one(i: Column, digest: Column, is_hex: Column) -> Column:
        c = F.substr(value, i, F.lit(1))
        n = F.conv(F.substr(digest, F.pmod(i * 3, F.lit(120)) + 1, F.lit(4)), 16, 10).cast("long") + F.floor(i / 40)
        letter = F.pmod(n, F.when(is_hex, 6).otherwise(26)).cast("int")
        low = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), letter + 1, F.lit(1))
        return F.when(c.rlike(r"\d"), F.pmod(n, F.lit(10)).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(low)).when(c.rlike(r"\p{L}"), low).otherwise(c)

    known = F.struct(digest.alias("digest"), value.rlike(r"^[0-9A-Fa-f]+$").alias("is_hex"))
    same_length = _let(known, lambda k: F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: one(i, k.digest, k.is_hex)), ""))
    # Short values may leave too few choices: from the fourth attempt on they grow.
    return F.concat(same_length, F.when(attempt > 3, attempt.cast("string")).otherwise(F.lit("")))


def _email(value: Column, key: str, attempt: Column) -> Column:
    """Local part and each label of the domain by themselves, so addresses of one domain keep sharing one; the last label stays."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    labels = F.split(domain, r"\.")
    shown = F.transform(labels, lambda x, i: F.when(i < F.size(labels) - 1, _rewritten(x, key + "domain", F.lit(0))).otherwise(x))
    # The whole address decides on the local part.
    mark = F.concat(F.lit(key), F.lit("local"))
    digest = F.substr(F.sha2(F.concat_ws("|", mark, attempt.cast("string"), value), 256), F.lit(1), F.lit(6))
    form = _rewritten(local, key + "local", attempt)
    return F.concat(form, F.when(attempt > 0, F.concat(F.lit("."), digest)).otherwise(F.lit("")), F.lit("@"), F.array_join(shown, "."))


def _name(value: Column, key: str, attempt: Column) -> Column:
    """Title as it was, given name of the title's gender and the name's script, family name of syllables.

    The family name depends on the family name alone, so a person is called by the same one with and without
    the given name.
    """
    title = F.regexp_extract(value, rf"^{_TITLE}\.? ", 0)
    words = F.split(F.substr(value, F.length(title) + 1), " ")
    gender = F.when(title.rlike(rf"^(?:{MALE_TITLES})\.? "), "m").when(title.rlike(rf"^(?:{FEMALE_TITLES})\.? "), "f").otherwise("x")
    last = F.element_at(words, -1)

    def written(script: str) -> Column:
        s = SYLLABLES[script]
        family = F.initcap(F.concat(*[_pick(s, _number(key, "family", str(k), attempt, last)) for k in range(4)]))
        family = F.when(attempt > 3, F.concat(family, F.lower(_pick(s, _number(key, "more", attempt, value))), F.lower(_pick(s, attempt)))).otherwise(family)
        given = F.lit(None).cast("string")
        for g in "xfm":
            given = F.when(gender == g, _pick(GIVEN[(script, g)], _number(key, "given", F.element_at(words, 1), F.floor(attempt / 2)))).otherwise(given)
        return F.when(F.size(words) > 1, F.concat_ws(" ", given, family)).otherwise(family)

    return F.concat(title, F.when(last.rlike(r"\p{IsCyrillic}"), written("cyrillic")).otherwise(written("latin")))


def surrogate(value: Column, attempt: Column | int = 0, key: str = KEY) -> Column:
    attempt = F.lit(attempt) if isinstance(attempt, int) else attempt
    country = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .\-(])", 0)
    rest = F.substr(value, F.length(country) + 1)
    after = lambda k: F.substr(value, F.lit(k + 1))
    start = lambda k: F.substr(value, F.lit(1), F.lit(k))
    return _let(
        kind_of(value),
        lambda kind: F.when(kind == "email", _email(value, key, attempt))
        .when(kind == "ip", _ip(value, key, attempt))
        .when(kind == "phone", F.concat(country, _let(rest, lambda r: _refilled(r, _permuted(_digits(r), key + "phone", attempt)))))
        .when(kind == "ssn", _refilled(value, _permuted(_digits(value), key + "ssn", attempt)))
        .when(kind == "card", _card(value, key, attempt))
        .when(kind == "key", F.concat(start(4), _rewritten(after(4), key + "key", attempt)))
        .when(kind == "iban", F.concat(start(2), _rewritten(after(2), key + "iban", attempt)))
        .when(kind == "name", _name(value, key, attempt))
        .otherwise(_rewritten(value, key + "secret", attempt)),
    )


def settled(values: DataFrame, key: str = KEY) -> DataFrame | None:
    """(value, changed): surrogates of those of the distinct values whose first surrogate collides; None without any.

    A surrogate collides if it belongs to several values (all but the smallest are made again) or is the text
    of a real entity.
    """
    first = stored(values.select("value", F.lit(0).alias("attempt"), surrogate(F.col("value"), 0, key).alias("changed")), "surrogates")
    real = first.select(F.col("value").alias("changed")).distinct()
    table_now, again = first, None
    for attempt in range(1, 100):
        groups = table_now.groupBy("changed").agg(F.min("value").alias("keeps"), F.count(F.lit(1)).alias("count")).filter("count > 1")
        shared = table_now.join(groups, "changed").filter("value <> keeps").select("value")
        taken = table_now.join(real, "changed", "left_semi").select("value")
        clash = stored_if_any(shared.unionByName(taken).distinct(), "clashes")
        if clash is None:
            return again
        made = clash.select("value", F.lit(attempt).alias("attempt"), surrogate(F.col("value"), attempt, key).alias("changed"))
        kept = table_now.join(clash, "value", "left_anti")
        table_now = stored(kept.unionByName(made), "surrogates")
        again = table_now.filter("attempt > 0").select("value", "changed")
    raise ValueError("surrogates of some values keep colliding")


def replace_entities(documents: DataFrame, key: str = KEY, count: str | None = "n_replaced") -> DataFrame:
    """All rows and columns of ``documents``, with the entities in ``text`` replaced and their number in ``count``.

    Null and empty texts stay as they are, with 0 entities. Repeated rows are changed alike. ``doc_id`` may be
    null; a column that is called as ``count`` is replaced, all others stay. The same key gives the same surrogates.
    Texts are searched whole, however long. An empty table gives none.
    """
    found = entities(F.col("text"))
    values = documents.select(F.explode(found).alias("value")).distinct()
    again = settled(values, key)
    rows = documents
    inside, again_name = fresh(documents.columns, "_found"), fresh(documents.columns, "_again")
    changed = lambda v: surrogate(v, 0, key)
    if again is not None:
        hits = documents.select("doc_id", F.explode(found).alias("value")).distinct().join(again, "value")
        maps = hits.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("value", "changed"))).alias(again_name))
        rows = rows.join(maps, rows.doc_id.eqNullSafe(maps.doc_id), "left").drop(maps.doc_id)
        changed = lambda v: F.coalesce(F.element_at(F.col(again_name), v), surrogate(v, 0, key))
    new = F.transform(F.col(inside), changed)
    between = F.split("text", PATTERN, -1)
    joined = F.array_join(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    n = F.coalesce(F.size(inside), F.lit(0))
    rows = rows.withColumn(inside, found).withColumn("text", F.when(F.size(inside) > 0, joined).otherwise(F.col("text")))
    if count:
        rows = rows.withColumn(count, F.greatest(n, F.lit(0)).cast("long"))
    return rows.drop(inside, again_name)


QUERIES = {"op10_pii_surrogates": Query(lambda spark, folder: replace_entities(table(spark, folder, "documents")).select("doc_id", "text", "n_replaced"))}
