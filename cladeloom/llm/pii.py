"""Surrogates for personal data and secrets, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

KEY = "change-me"  # the keyed hash makes surrogates repeatable for its holder only; production passes its own
PLAIN_ATTEMPTS = 8  # so many surrogates keep the exact format; an entity that still collides gets longer ones

# Titles and given names by gender and script, and the parts that surrogate surnames are made of.
TITLES_F = "Mrs Ms Miss Frau Mme Madame Sra Señora Госпожа".split()
TITLES_M = "Mr Herr Monsieur Sr Señor Господин".split()
TITLES_X = "Dr Prof".split()
GIVEN = {
    ("f", "latin"): "Anna Emma Maria Sofia Laura Julia Clara Alice Camille Chloé Lucía Carmen Elena Inés Katharina Sabine Heike Margaret Susan Emily Jessica Karen".split(),
    ("m", "latin"): "John James Robert Michael William Thomas Peter Hans Jürgen Klaus Stefan Pierre Jean Louis Antoine Carlos José Miguel Pablo Javier Andrew Kevin".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("m", "cyrillic"): "Иван Сергей Алексей Дмитрий Андрей Михаил Николай Владимир Павел Олег".split(),
}
SURNAME = {
    "latin": ["Al Bar Ber Cal Dal El Fer Gar Hal Kel Lan Mar Nor Or Par Ros Sal Tor Val Wil".split(), "den der do gen la len ma mer na ner ra ren sen ta ter vi".split(), "berg by dez feld ford ger ini man mont nd ner sen son stein ton ville".split()],
    "cyrillic": ["Ал Бар Вол Гор Дан Зай Кар Лаз Мор Нов Пав Рог Сем Тар".split(), "ба ва ди ка ли ма ни па ра си та".split(), "ев енко ин ко ов ский ук ых".split()],
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLED = r"(?:" + "|".join(TITLES_F + TITLES_M + TITLES_X) + r")\.?[  ]{1,2}\p{Lu}[\p{Ll}'’]+(?:[- ]\p{Lu}[\p{Ll}'’]+){0,2}"
_NAMED = r"(?:" + "|".join(n for g in GIVEN.values() for n in g) + r") \p{Lu}[\p{Ll}'’]+(?:-\p{Lu}[\p{Ll}'’]+)?"
# What is looked for, first match first. Every pattern starts where no letter or digit stands before it. Open quantifiers are
# possessive, and a mail name is tried at its start only, so a long run of characters is read once. A host name has at most 127 labels.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+'-])[\p{L}\p{N}._%+'-]++@(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,}+",
    "secret": r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|bearer)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[^\s\"',;]{6,}+",
    "aws": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "vendor": r"(?:sk-|ghp_|gho_|xox[abp]-)[0-9A-Za-z_-]{16,}+",
    "hex": r"(?=[a-f]*+\d)[0-9a-f]{32,}+(?![0-9A-Za-z])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?:\d{4}[ -]?){3}\d{4}(?!\d)|3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?!\d)",
    "ip": rf"(?<!\d\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    "person": rf"{_TITLED}|{_NAMED}",
}
ANY = r"(?<![\p{L}\p{N}_])(?:" + "|".join(PATTERNS.values()) + ")"
_PREFIX = r"^(?is)(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|bearer)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"


def kind_of(mention: Column) -> Column:
    """The first pattern that the whole mention fits."""
    out = None
    for k, p in PATTERNS.items():
        hit = mention.rlike(rf"^(?:{p})$")
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _stream(seed: Column, n: Column) -> Column:
    """Keyed hex digits, two for each of n characters."""
    seed = F.when(F.length(seed) > 300, F.sha2(seed, 256)).otherwise(seed)  # a long one is not hashed whole again for every 32 characters
    return F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(n / 32).cast("int")), lambda i: F.sha2(F.concat_ws("|", seed, i.cast("string")), 256)), "")


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(letters: Column, v: Column) -> Column:
    return F.substring(letters, (v % F.length(letters) + 1).cast("int"), F.lit(1))


def shaped(value: Column, stream: Column) -> Column:
    """Another text of the same shape: digits for digits, and letters of the same case and script; the rest stays."""
    low = F.when(value.rlike("^[0-9a-f]*$"), "abcdef").otherwise("abcdefghijklmnopqrstuvwxyz")
    rules = [
        ("[0-9]", F.lit("0123456789")), ("[a-z]", low), ("[A-Z]", F.upper(low)),
        (r"\p{Lu}", F.lit("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ")), (r"[\p{Ll}&&\p{IsCyrillic}]", F.lit("абвгдежзиклмнопрстуфхцчшэюя")),
        (r"[\p{Ll}&&\p{IsLatin}]", F.lit("àáâãäåæçèéêëìíîïñòóôõöùúûü")),
    ]
    rules[3] = (r"[\p{Lu}&&\p{IsCyrillic}]", rules[3][1])

    def letter(c: Column, two: Column) -> Column:
        out = None
        for p, letters in rules:
            v = F.conv(two, 16, 10).cast("int")
            out = F.when(c.rlike(p), _pick(letters, v)) if out is None else out.when(c.rlike(p), _pick(letters, v))
        return F.when(c.isNotNull(), out.otherwise(c))

    # each character meets its two digits once: cutting them out of the stream by position would take the square of the length
    return F.array_join(F.zip_with(F.split(value, ""), F.regexp_extract_all(stream, F.lit(".."), F.lit(0)), letter), "")


def _luhn(body: Column) -> Column:
    """The check digit that makes body + digit pass the Luhn test."""
    chars = F.reverse(F.split(F.reverse(F.reverse(body)), ""))
    kept = F.filter(chars, lambda c: c != "")
    doubled = F.transform(kept, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return ((10 - total % 10) % 10).cast("string")


def luhn_holds(digits: Column) -> Column:
    return _luhn(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, -1, 1)


def _octet(value: Column, v: Column) -> Column:
    n = F.length(value)
    return F.when(n == 1, 1 + v % 9).when(n == 2, 10 + v % 90).otherwise(100 + v % 155).cast("string")


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """A keyed surrogate of the same kind and format for a canonical value."""
    seed = F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"))
    stream = _stream(seed, F.length(value) + 8)
    v = lambda i: _byte(stream, F.lit(i))
    host = F.substring_index(value, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(host, ".", -1))
    name = F.substring(host, F.lit(1), F.length(host) - F.length(top))
    host_stream = _stream(F.concat_ws("|", F.lit(key), F.lit("host"), name), F.length(name))  # one host, one surrogate host
    email = F.concat(shaped(F.substring_index(value, "@", 1), stream), F.lit("@"), shaped(name, host_stream), top)
    card = F.concat(F.substring(value, 1, 1), shaped(F.substring(value, F.lit(2), F.length(value) - 2), stream))
    card = F.concat(card, F.when(luhn_holds(value), _luhn(card)).otherwise(_pick(F.lit("0123456789"), v(19))))
    ip = F.array_join(F.transform(F.split(value, r"\."), lambda o, i: _octet(o, _byte(stream, i))), ".")
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    # names: given names from the list of their gender and script, then more of them with a hyphen; surnames from parts
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card)
    out = out.when(kind == "aws", F.concat(F.substring(value, 1, 4), shaped(F.substring(value, F.lit(5), F.length(value)), stream)))
    out = out.when(kind == "vendor", F.concat(F.regexp_extract(value, r"^[a-z]+[_-]", 0), shaped(F.regexp_replace(value, r"^[a-z]+[_-]", ""), stream)))
    out = out.when(kind == "iban", F.concat(F.substring(value, 1, 2), shaped(F.substring(value, F.lit(3), F.length(value)), stream)))
    out = out.when(kind == "phone", F.concat(F.regexp_extract(value, r"^\+\d", 0), F.lit("2"), shaped(F.regexp_replace(F.regexp_replace(value, r"^\+\d", ""), r"^\d", ""), stream)))
    for (gender, where), names in GIVEN.items():
        pool = F.array(*map(F.lit, names))
        some = F.transform(F.sequence(F.lit(0), F.floor(attempt / 2).cast("int")), lambda i: F.element_at(pool, _byte(stream, i) % len(names) + 1))  # noqa: B023
        out = out.when((kind == f"given_{gender}") & (script == where), F.array_join(some, "-"))
    for where, (a, b, c) in SURNAME.items():
        one, end = (F.element_at(F.array(*map(F.lit, p)), v(i) % len(p) + 1) for i, p in ((0, a), (2, c)))
        mid = F.transform(F.sequence(F.lit(1), 1 + attempt), lambda i: F.element_at(F.array(*map(F.lit, b)), _byte(stream, i + 2) % len(b) + 1))  # noqa: B023
        out = out.when((kind == "surname") & (script == where), F.concat(one, F.array_join(mid, ""), end))
    out = out.otherwise(shaped(value, stream))
    # distinctness comes before format: where the format has no room left the surrogate grows
    longer = F.substring(stream, F.lit(1), (attempt - PLAIN_ATTEMPTS).cast("int"))
    grown = F.when(kind == "email", F.concat(longer, out)).when(kind.startswith("given") | (kind == "surname"), out).otherwise(F.concat(out, F.translate(longer, "abcdef", "012345")))
    return F.when(attempt > PLAIN_ATTEMPTS, grown).otherwise(out)


def _entities(kind: Column, mention: Column) -> Column:
    """The pieces of a mention that are replaced, as an array of (kind, value): a person is a given name and surnames, others are one.

    Values are canonical, so that other spellings of one entity get one surrogate: emails in lower case, numbers without their
    marks, secrets without their label, names as they stand with upper case at the start only.
    """
    value = (
        F.when(kind == "email", F.lower(mention)).when(kind.isin("card", "ssn"), _digits(mention))
        .when(kind == "phone", F.concat(F.when(mention.startswith("+"), "+").otherwise(""), _digits(mention)))
        .when(kind == "iban", F.regexp_replace(mention, " ", "")).when(kind == "secret", F.regexp_replace(mention, _PREFIX, "")).otherwise(mention)
    )
    one = F.array(F.struct(kind.alias("kind"), value.alias("value")))
    words = F.split(F.regexp_replace(mention, r"[  ]+", " "), " ")
    title = F.regexp_replace(F.element_at(words, 1), r"\.$", "")
    titled = title.isin(TITLES_F + TITLES_M + TITLES_X)
    names = F.when(titled, F.slice(words, 2, 9)).otherwise(words)
    female = [n for (g, _), ns in GIVEN.items() if g == "f" for n in ns]
    male = [n for (g, _), ns in GIVEN.items() if g == "m" for n in ns]
    last = F.size(names) - 1

    def part(n: Column, i: Column) -> Column:
        given = n.isin(female + male) | ((i < last) & (i == 0))
        woman = n.isin(female) | (~n.isin(male) & title.isin(TITLES_F))
        return F.struct(F.when(given & woman, "given_f").when(given, "given_m").otherwise("surname").alias("kind"), n.alias("value"))

    return F.when(kind == "person", F.transform(names, part)).otherwise(one)


def _render(kind: Column, mention: Column, values: Column) -> Column:
    """The mention with its pieces replaced, in its own spelling: digits into the same marks, label and title kept."""
    one = F.element_at(values, 1)
    marks = F.split(F.regexp_replace(mention, r"^\+", ""), "[0-9A-Z]", -1)
    own = F.filter(F.split(F.regexp_replace(one, r"^\+", ""), ""), lambda c: c != "")
    filled = F.concat(F.array_join(F.zip_with(marks, own, lambda m, c: F.concat(F.coalesce(m, F.lit("")), F.coalesce(c, F.lit("")))), ""))
    spaced = F.concat(F.when(mention.startswith("+"), "+").otherwise(""), filled)
    title = F.regexp_extract(mention, "^(?:" + "|".join(TITLES_F + TITLES_M + TITLES_X) + r")\.?[  ]+", 0)
    label = F.regexp_extract(mention, _PREFIX, 0)
    return (
        F.when(kind.isin("card", "ssn", "phone", "iban"), spaced).when(kind == "secret", F.concat(label, one))
        .when(kind == "person", F.concat(title, F.array_join(values, " ")))
        .when((kind == "email") & (mention == F.upper(mention)), F.upper(one)).otherwise(one)
    )


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value, surrogate): one for each distinct (kind, value), no two of a kind alike, and none that is itself a real value.

    Collisions are found by grouping, the smallest value keeps the surrogate and the others try again.
    """
    todo = written(entities.distinct().withColumn("attempt", F.lit(0)), "entities")
    real = todo.select("kind", F.col("value").alias("surrogate"))
    taken = None
    while True:
        tried = todo.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key))
        tried = written(tried, "surrogates")
        first = tried.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        good = first.join(real, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            good = good.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = written(good.select("kind", "value", "surrogate"), "surrogates-good")
        taken = good if taken is None else taken.union(good)
        todo = written(tried.join(good, ["kind", "value"], "left_anti").select("kind", "value", (F.col("attempt") + 1).alias("attempt")), "entities")
        if todo.isEmpty():
            return taken


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with every detected entity in `text` replaced, and n_replaced, the number of replaced mentions.

    One entity has one surrogate in all documents, different entities of a kind have different ones. All other columns stay;
    a null text stays null; repeated rows are treated alike. Texts without a mention are not shuffled.
    """
    text = F.col("text")
    th = F.xxhash64(text)
    found = docs.select(F.col("doc_id").cast("string").alias("_id"), th.alias("_th"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("mentions"))
    found = written(found.where(F.size("mentions") > 0).dropDuplicates(["_id", "_th"]), "mentions")
    each = found.select("_id", "_th", F.posexplode("mentions").alias("at", "mention")).withColumn("kind", kind_of(F.col("mention")))
    pieces = each.select("_id", "_th", "at", "kind", "mention", F.posexplode(_entities(F.col("kind"), F.col("mention"))).alias("part", "e"))
    pieces = written(pieces.select("_id", "_th", "at", "kind", "mention", "part", "e.*").toDF("_id", "_th", "at", "kind", "mention", "part", "ekind", "value"), "pieces")
    known = surrogates(pieces.select(F.col("ekind").alias("kind"), "value"), key)
    known = known.select(F.col("kind").alias("ekind"), "value", "surrogate")
    pieces = pieces.join(known, ["ekind", "value"])
    part = F.struct("at", "part", "kind", "mention", "surrogate")
    lists = pieces.groupBy("_id", "_th").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    own = F.transform(
        F.array_distinct(F.transform("parts", lambda p: p["at"])),
        lambda at: F.struct(F.filter("parts", lambda p: p["at"] == at)[0].alias("p"), F.transform(F.filter("parts", lambda p: p["at"] == at), lambda p: p["surrogate"]).alias("v")),
    )
    lists = lists.select("_id", "_th", F.transform(own, lambda m: _render(m["p"]["kind"], m["p"]["mention"], m["v"])).alias("new"))
    has = F.coalesce(text.rlike(ANY), F.lit(False))
    clean = docs.where(~has).withColumn("n_replaced", F.lit(0))
    dirty = docs.where(has).alias("d").join(lists.alias("l"), F.col("d.doc_id").cast("string").eqNullSafe(F.col("l._id")) & (F.xxhash64("d.text") == F.col("l._th")))
    gaps = F.split(F.col("d.text"), ANY, -1)
    whole = F.array_join(F.zip_with(gaps, F.col("l.new"), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    kept = [(whole if c == "text" else F.col(f"d.`{c}`")).alias(c) for c in docs.columns]
    return clean.union(dirty.select(*kept, F.size("l.new").alias("n_replaced")))
