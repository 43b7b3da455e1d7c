"""Operator 3: keyed surrogates for personal data, in DataFrame functions only.

Detected: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment card and account numbers (IBAN
included), social security numbers, access keys, assigned passwords and tokens, long hexadecimal strings, and persons named after a title.

A surrogate depends on a secret key, the type and the normal form of the entity, so each mention of an entity
gets the same one in every document, poured into the format of the mention: separators, letter case, the
country code of a phone number, the issuer digit and check digit of a card, the country and check digits of an
IBAN, the class of an IP address, the prefix of an access key; for persons the title's gender and the script.
Surname and given names are entities of their own, so "Mr. Ivor Hale" and "Mr. Hale" stay one person. Names that a
text has after a title are found without one in the same text as well. A given name after a neutral title is the
one that has a gendered title in the same text, or else in any (the female one if both are there). Forms of the
apostrophe are one, and a possessive is not part of a name. Phone numbers are one entity with and without country
code.

Two entities must not share a surrogate, and a surrogate must not be another entity that was detected. Both
are checked over the distinct entities of all documents; the losers try again with the next attempt until
none is left. Their attempts, and the genders of names after neutral titles, are joined to the documents that
mention them, which moves the documents unless there are few; all other surrogates are computed in place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from steadyrun.functions.codetext import let
from steadyrun.sources.scratch import stored

# Titles by gender, and letters of invented names by script.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sir", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Lady", "Госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Prof"]
CONSONANTS = "b d f g k l m n p r s t v z h j".split()
VOWELS = "a e i o u".split()
LATIN = "".join(CONSONANTS + VOWELS)
CYRILLIC = "бдфгклмнпрствзхжаеиоу"
GREEK = "βδφγκλμνπρστψζχξαειου"

ASSIGNED = r"(?i:(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))\s{0,3}[:=]\s{0,3}[\"']?"
SECRET = r"[A-Za-z0-9_/+~-]{6,}"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
#: Country codes; none is the beginning of another.
COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
TRUNK = r"\(0\)[ .-]?"
#: Groups of any number and size after the country code, unless it is 1; the second line has the other shapes.
INTERNATIONAL = (
    rf"(?<![\w+])\+(?:(?!1)(?=(?:[ .()-]{{0,3}}\d){{8}}){COUNTRY}[ .-]?(?:{TRUNK})?(?:\(\d{{1,4}}\)[ .-]?|\d{{1,4}}[ .-])?"
    r"\d{2,8}(?:[ .-]\d{2,8}){0,4}|\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4})(?!\d)"
)
#: Ten digits; five pairs; an area code with its 0 and a number in up to three groups; three digits and three pairs.
NATIONAL = (
    r"(?<![\w.+-])(?!\d{4}(?<four>[ -])\d{4}\k<four>\d{4}\k<four>\d)(?:(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|"
    r"0[1-9](?<pair>[ .-])\d{2}(?:\k<pair>\d{2}){3}|"
    r"(?:\(0[1-9]\d{1,4}\) ?|0[1-9]\d{1,4}[ /-])(?:\d{5,8}|\d{3,4}[ -]\d{2,4}(?:[ -]\d{2,4})?)|"
    r"[6-9]\d{2}(?: \d{2}){3})(?![\w-])"
)
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w)(?!\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<![\w+-])(?<!\d\.)(?:\d{13,19}|\d{4}(?<sep>[ -])\d{4}\k<sep>\d{4}\k<sep>\d{1,7})(?!\w)(?!\.\d)"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?!\w)|(?<!\w)[A-Z]{2}\d{2}(?=[A-Z]{0,8}\d{6})[A-Z0-9]{11,30}(?!\w)"
IP6 = (
    r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|"
    r"(?=[A-Fa-f:]{0,40}\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
)
KEY = r"(?<!\w)(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xoxb|xoxp)[_-][A-Za-z0-9_-]{16,})(?!\w)"
HEX = r"(?<!\w)(?=[A-Fa-f]{0,99}\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)"
NAME = r"\p{Lu}(?:\p{L}|-(?=\p{L})|['’](?=\p{L})(?![sS](?![\p{L}'’-])))+"
#: A word that one of these letters is next to is another word.
BARE = r"(?<![\p{L}\p{N}])(?:%s)(?![\p{L}\p{N}])"
PERSON = rf"(?<!\w)(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? {NAME}(?: {NAME}){{0,2}}"
# No entity begins within a word; looking at that first spares most places all the alternatives.
ANY = f"(?<![A-Za-z0-9])(?:{'|'.join([ASSIGNED + SECRET, EMAIL, INTERNATIONAL, IP, IP6, IBAN, NATIONAL, SSN, CARD, KEY, HEX, PERSON])})"
# Every entity has one of these; a text without any needs no closer look.
SIGNS = (
    r"[0-9@:=]|(?=[AsgpxMHFSLDPГΚ])(?<!\w)(?:AKIA|ASIA|(?:sk|pk|ghp|gho|xoxb|xoxp)[_-]|"
    rf"(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? )"
)
# Noncharacters put around mentions for a moment; texts that hold them are cut in another way.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
MOST_ATTEMPTS = 40


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _bound(values: list[Column], use: Callable[..., Column]) -> Column:
    """``use`` of several values, each computed once."""
    packed = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return let(packed, lambda s: use(*[s[f"v{i}"] for i in range(len(values))]))


def _stream(seed: Column, length: Column) -> Column:
    """At least ``length`` keyed bytes, as hexadecimal digits."""
    blocks = F.sequence(F.lit(0), F.floor(length / 64).cast("int"))
    return F.array_join(F.transform(blocks, lambda k: F.sha2(F.concat(seed, F.lit("#"), k.cast("string")), 512)), "")


def _byte(stream: Column, k: Column) -> Column:
    return F.conv(F.substr(stream, 2 * k + 1, F.lit(2)), 16, 10).cast("int")


def _letter(first: str, n: Column) -> Column:
    return F.char(F.lit(ord(first)) + n)


def _alike(value: Column, seed: Column) -> Column:
    """A keyed text of the same digits, small and capital letters; hexadecimal stays hexadecimal."""

    def each(stream: Column, letters: Column) -> Column:
        def one(c: Column, k: Column) -> Column:
            b = _byte(stream, k)
            return (
                F.when(c.rlike("^[0-9]$"), (b % 10).cast("string"))
                .when(c.rlike("^[a-z]$"), _letter("a", b % letters))
                .when(c.rlike("^[A-Z]$"), _letter("A", b % letters))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(value, ""), one), "")

    letters = F.when(value.rlike("^(?:[0-9a-f:]+|[0-9A-F:]+)$"), 6).otherwise(26)
    return _bound([_stream(seed, F.length(value)), letters], each)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _poured(mention: Column, digits: Column) -> Column:
    """``digits`` in place of the last digits of ``mention``, everything else as it is."""

    def fill(own: Column, new: Column) -> Column:
        skipped = F.length(own) - F.length(new)
        chars = F.split(mention, "")

        def one(c: Column, k: Column) -> Column:
            nth = F.length(_digits(F.substr(mention, F.lit(1), k + 1)))
            return F.when(c.rlike(r"^\d$") & (nth > skipped), F.substr(new, nth - skipped, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(chars, one), "")

    return _bound([_digits(mention), digits], fill)


def _luhn(digits: Column) -> Column:
    """The Luhn sum, with the last digit counted once."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, k: F.struct(c.cast("int").alias("d"), k.alias("k")))

    def add(total: Column, p: Column) -> Column:
        twice = F.when(p["d"] > 4, 2 * p["d"] - 9).otherwise(2 * p["d"])
        return total + F.coalesce(F.when(p["k"] % 2 == 1, twice).otherwise(p["d"]), F.lit(0))

    return F.aggregate(places, F.lit(0), add)


def _card(norm: Column, alike: Column, seed: Column) -> Column:
    """Same length and first digit; a valid check digit where there was one."""
    body = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(alike, F.lit(2), F.length(norm) - 2))

    def close(b: Column) -> Column:
        valid = F.pmod(10 - _luhn(F.concat(b, F.lit("0"))) % 10, F.lit(10))
        wrong = (valid + 1 + _byte(F.sha2(seed, 256), F.lit(0)) % 9) % 10
        return F.concat(b, F.when(_luhn(norm) % 10 == 0, valid).otherwise(wrong).cast("string"))

    return let(body, close)


def _mod97(text: Column) -> Column:
    """The number that digits and letters (A is 10) spell, modulo 97."""

    def add(total: Column, c: Column) -> Column:
        return (
            F.when(c.rlike("^[0-9]$"), (total * 10 + c.cast("int")) % 97)
            .when(c.rlike("^[A-Z]$"), (total * 100 + F.ascii(c) - 55) % 97)
            .otherwise(total)
        )

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(norm: Column, seed: Column) -> Column:
    """The same country, a like account, check digits that are right where they were."""
    country, check, account = (F.substr(norm, F.lit(a), F.lit(n)) for a, n in ((1, 2), (3, 2), (5, 30)))

    def close(made: Column) -> Column:
        right = 98 - _mod97(F.concat(made, country, F.lit("00")))
        digits = F.when(_mod97(F.concat(account, country, check)) == 1, right).otherwise((right + 1) % 97)
        return F.concat(country, F.lpad(digits.cast("string"), 2, "0"), made)

    return let(_alike(account, seed), close)


def _spaced(mention: Column, made: Column) -> Column:
    """``made`` with the spaces of ``mention``."""

    def one(c: Column, k: Column) -> Column:
        nth = F.length(F.replace(F.substr(mention, F.lit(1), k + 1), F.lit(" "), F.lit("")))
        return F.when(c == " ", c).otherwise(F.substr(made, nth, F.lit(1)))

    return F.array_join(F.transform(F.split(mention, ""), one), "")


def _phone(digits: Column, attempt: Column) -> Column:
    """The fictional exchange 555 in ten-digit numbers, for the first attempts; others keep their length."""
    area = F.concat((F.substr(digits, F.lit(1), F.lit(1)).cast("int") % 8 + 2).cast("string"), F.substr(digits, F.lit(2), F.lit(2)))
    exchange = F.when(attempt < 4, F.lit("555")).otherwise(
        F.concat((F.substr(digits, F.lit(4), F.lit(1)).cast("int") % 8 + 2).cast("string"), F.substr(digits, F.lit(5), F.lit(2)))
    )
    return F.when(F.length(digits) == 10, F.concat(area, exchange, F.substr(digits, F.lit(7), F.lit(4)))).otherwise(digits)


def _ip(norm: Column, seed: Column, attempt: Column) -> Column:
    """Private networks keep their network, from attempt 4 on the small ones move to the wide one, 10.0.0.0, as
    they may be full; others stay in 11.0.0.0 to 120.255.255.254."""

    def join(stream: Column, parts: Column) -> Column:
        octets = [_byte(stream, F.lit(k)) for k in range(4)]
        first, second = parts[0].cast("int"), parts[1].cast("int")
        home = (first == 10) | (first == 127)
        wide = ((first == 192) & (second == 168)) | ((first == 172) & second.between(16, 31))
        return F.concat_ws(
            ".",
            F.when(wide & (attempt >= 4), "10").when(home | wide, parts[0]).otherwise((11 + octets[0] % 110).cast("string")),
            F.when(wide & (attempt < 4), parts[1]).otherwise(octets[1].cast("string")),
            octets[2].cast("string"),
            (1 + octets[3] % 254).cast("string"),
        )

    return _bound([F.sha2(seed, 512), F.split(norm, r"\.")], join)


def _email(norm: Column, key: Column, seed: Column, attempt: Column) -> Column:
    """A like local part, at a host of the reserved example domains that is the same for the same domain."""
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    host = F.regexp_replace(F.substr(domain, F.lit(1), F.length(domain) - F.length(tld) - 1), r"[.-]+", "-")
    more = F.when(attempt >= 3, F.substr(F.sha2(seed, 256), F.lit(1), attempt)).otherwise("")
    return F.concat(
        _alike(local, seed), more, F.lit("@"), _alike(host, F.concat(key, F.lit("|domain|"), domain)), F.lit(".example."),
        F.when(tld.isin("com", "net", "org"), tld).otherwise("com"),
    )


def _name(kind: Column, norm: Column, seed: Column, attempt: Column) -> Column:
    """An invented name in small letters, in the script of ``norm``, ending as its kind does."""

    def spelled(stream: Column) -> Column:
        syllables = F.when(kind == "surname", 3).otherwise(2) + attempt

        def one(k: Column) -> Column:
            consonant = F.get(F.array(*map(F.lit, CONSONANTS)), _byte(stream, 2 * k) % len(CONSONANTS))
            return F.concat(consonant, F.get(F.array(*map(F.lit, VOWELS)), _byte(stream, 2 * k + 1) % len(VOWELS)))

        body = F.array_join(F.transform(F.sequence(F.lit(0), syllables - 1), one), "")
        end = F.when(kind == "given_f", "na").when(kind == "given_m", "n").when(kind == "given_n", "l").otherwise("r")

        def scripted(latin: Column) -> Column:
            return (
                F.when(norm.rlike(r"\p{IsCyrillic}"), F.translate(latin, LATIN, CYRILLIC))
                .when(norm.rlike(r"\p{IsGreek}"), F.translate(latin, LATIN, GREEK))
                .otherwise(latin)
            )

        return let(F.concat(body, end), scripted)

    return let(_stream(seed, F.lit(200)), spelled)


def _surrogate(key: Column, kind: Column, norm: Column, attempt: Column) -> Column:
    """The normal form of the surrogate of an entity."""

    def numbered(seed: Column, prefix: Column, alike: Column) -> Column:
        return (
            F.when(kind == "phone", _phone(alike, attempt))
            .when(kind == "ssn", F.concat(F.lit("9"), F.substr(alike, F.lit(2), F.lit(8))))
            .when(kind == "card", _card(norm, alike, seed))
            .otherwise(F.concat(prefix, alike, F.when(attempt >= 4, F.substr(F.sha2(seed, 256), F.lit(1), attempt)).otherwise("")))
        )

    def chosen(seed: Column, prefix: Column) -> Column:
        alike = _alike(F.substr(norm, F.length(prefix) + 1, F.length(norm)), seed)
        return (
            F.when(kind == "email", _email(norm, key, seed, attempt))
            .when(kind == "ip", _ip(norm, seed, attempt))
            .when(kind == "ip6", _alike(norm, seed))
            .when(kind == "iban", _iban(norm, seed))
            .when(kind.isin("phone", "ssn", "card", "secret"), let(alike, lambda a: numbered(seed, prefix, a)))
            .otherwise(_name(kind, norm, seed, attempt))
        )

    own = F.regexp_extract(norm, r"^(?:AKIA|ASIA|(?:sk|pk|ghp|gho|xoxb|xoxp)[_-])", 0)
    seed = F.concat_ws("|", key, kind, norm, attempt.cast("string"))
    return _bound([seed, F.when(kind == "secret", own).otherwise("")], chosen)


def _kind(mention: Column) -> Column:
    return (
        F.when(mention.rlike(rf"^{ASSIGNED}{SECRET}$"), "secret")
        .when(mention.rlike(_whole(EMAIL)), "email")
        .when(mention.rlike(_whole(f"{INTERNATIONAL}|{NATIONAL}")), "phone")
        .when(mention.rlike(_whole(IP)), "ip")
        .when(mention.rlike(_whole(IP6)), "ip6")
        .when(mention.rlike(_whole(IBAN)), "iban")
        .when(mention.rlike(_whole(SSN)), "ssn")
        .when(mention.rlike(_whole(CARD)), "card")
        .when(mention.rlike(_whole(f"{KEY}|{HEX}")), "secret")
        .otherwise("person")
    )


def _subscriber(core: Column, digits: Column) -> Column:
    """The digits of a phone number without country code and the 0 before an area code."""
    abroad = _digits(F.regexp_replace(core, rf"^\+{COUNTRY}[ .-]?(?:{TRUNK})?", ""))
    return F.when(F.startswith(core, F.lit("+")), abroad).otherwise(F.regexp_replace(digits, "^0", ""))


def _folded(name: Column) -> Column:
    """A name in small letters with one form of the apostrophe."""
    return F.translate(F.lower(name), "’", "'")


def _parts(mention: Column) -> Column:
    """A mention as consecutive parts: kind (null: text to keep), norm and the text itself."""
    kept = F.lit(None).cast("string")

    def part(kind: Column, norm: Column, text: Column) -> Column:
        return F.struct(kind.alias("kind"), norm.alias("norm"), text.alias("text"))

    def split(kind: Column) -> Column:
        prefix = F.when(kind == "secret", F.regexp_extract(mention, rf"^{ASSIGNED}", 0)).otherwise("")

        def plain(before: Column) -> Column:
            core = F.substr(mention, F.length(before) + 1, F.length(mention))
            digits = _digits(core)
            norm = (
                F.when(kind == "email", F.lower(core))
                .when(kind == "phone", let(_subscriber(core, digits), lambda n: F.when(F.length(n) > 10, F.right(n, F.lit(10))).otherwise(n)))
                .when(kind.isin("card", "ssn"), digits)
                .when(kind == "ip6", F.lower(core))
                .when(kind == "iban", F.replace(core, F.lit(" "), F.lit("")))
                .otherwise(core)
            )
            return F.array(part(kept, kept, before), part(kind, norm, core))

        def person(words: Column) -> Column:
            title = F.regexp_replace(words[0], r"\.$", "")
            given = F.when(title.isin(*MALE), "given_m").when(title.isin(*FEMALE), "given_f").otherwise("given_n")

            def word(w: Column, k: Column) -> Column:
                kind = F.when(k == F.size(words) - 1, "surname").otherwise(given)
                lead = F.when(k == 0, "").otherwise(" ")
                name = part(F.when(k > 0, kind), F.when(k > 0, _folded(w)), w)
                return F.array(part(kept, kept, lead), name)

            return F.flatten(F.transform(words, word))

        return F.when(kind == "person", let(F.split(mention, " "), person)).otherwise(let(prefix, plain))

    return let(_kind(mention), split)


def _written(kind: Column, norm: Column, text: Column, made: Column) -> Column:
    """A surrogate's normal form in the format of the mention."""
    upper = (text == F.upper(text)) & (text != F.lower(text))
    cased = F.when(upper, F.upper(made)).otherwise(made)
    return (
        F.when(kind.isin("phone", "card", "ssn"), _poured(text, made))
        .when(kind.isin("ip", "secret"), made)
        .when(kind == "ip6", F.when(text == F.upper(text), F.upper(made)).otherwise(made))
        .when(kind == "iban", _spaced(text, made))
        .when(kind == "email", cased)
        .otherwise(F.when(upper, F.upper(made)).otherwise(F.initcap(made)))
    )


def _names(text: Column) -> Column:
    """The parts (kind, norm, text) of the names that ``text`` has after titles. A word that the text has in
    small letters too is no name where it stands alone."""
    parts = F.flatten(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0))), _parts))

    def told(p: Column) -> Column:
        small = F.concat(F.lit(r"(?<![\p{L}\p{N}@._-])"), F.replace(p["norm"], F.lit("'"), F.lit("['’]")), F.lit(r"(?![\p{L}\p{N}@_-]|[.]\p{L})"))
        return p["kind"].isNotNull() & ~F.regexp_like(text, small)

    return F.filter(parts, told)


def _sought(names: Column) -> Column:
    """The pattern of all mentions in a text with these names, bare names included."""
    words = F.flatten(F.transform(names, lambda p: F.array(p["text"], F.upper(p["text"]))))
    either = F.transform(words, lambda w: F.regexp_replace(w, "['’]", "['’]"))
    words = F.array_join(F.array_distinct(either), "|")
    before, after = (F.lit(x) for x in BARE.split("%s"))
    return F.when(F.size(names) > 0, F.concat(F.lit(f"{ANY}|"), before, words, after)).otherwise(ANY)


def _cut(text: Column, sought: Column) -> Column:
    """The text between mentions and the mentions in turn, beginning and ending with text."""
    marked = F.split(F.regexp_replace(text, sought, F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]", -1)
    mentions = F.regexp_extract_all(text, sought, F.lit(0))
    apart = _bound([mentions, F.split(text, sought, -1)], lambda m, gaps: F.filter(
        F.flatten(F.transform(gaps, lambda g, k: F.array(g, F.get(m, k)))), lambda x: x.isNotNull()
    ))
    return F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)), apart).otherwise(marked)


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text_md5, found): the distinct mentions of each text that has some."""
    body = F.col(text).cast("string")
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))
    rows = docs.where(body.rlike(SIGNS)).select(F.md5(body).alias("text_md5"), found.alias("found"))
    return rows.where(F.size("found") > 0)


def entities(found: DataFrame) -> DataFrame:
    """The distinct entities (kind, norm) of ``mentions``."""
    each = found.select(F.explode("found").alias("mention")).distinct()
    parts = each.select(F.explode(_parts(F.col("mention"))).alias("p"))
    return parts.where("p.kind is not null").select("p.kind", "p.norm").distinct()


def attempts(known: DataFrame, key: str) -> DataFrame:
    """The entities (kind, norm) that need an attempt above 0 for a surrogate of their own.

    The first entity in order of norm keeps a surrogate that several have; a surrogate that is itself a
    detected entity is kept by none.
    """
    def tried(rows: DataFrame) -> DataFrame:
        made = _surrogate(F.lit(key), F.col("kind"), F.col("norm"), F.col("attempt"))
        return stored(rows.select("kind", "norm", "attempt", made.alias("made")), "surrogates")

    now = tried(known.withColumn("attempt", F.lit(0)))
    originals = now.select("kind", F.col("norm").alias("made"))
    settled = False
    for _ in range(MOST_ATTEMPTS):
        shared = now.groupBy("kind", "made").agg(
            F.min(F.struct("attempt", "norm")).alias("first"), F.count(F.lit(1)).alias("n")
        )
        losers = now.join(shared.where("n > 1"), ["kind", "made"]).where("norm <> first.norm")
        real = now.join(originals, ["kind", "made"], "left_semi")
        again = stored(losers.select("kind", "norm").union(real.select("kind", "norm")).distinct(), "collisions")
        if again.isEmpty():
            settled = True
            break
        marked = now.drop("made").join(again.withColumn("again", F.lit(1)), ["kind", "norm"], "left")
        now = tried(marked.select("kind", "norm", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")))
    if not settled:
        raise RuntimeError("more entities of a type than it has surrogates")
    return stored(now.where("attempt > 0").select("kind", "norm", "attempt"), "attempts")


def genders(known: DataFrame, tries: DataFrame) -> DataFrame:
    """(kind, norm, code): given names after neutral titles that have a gendered one elsewhere; see ``_code``."""
    male, female = (known.where(F.col("kind") == k).select("norm", F.lit(k).alias("as")) for k in ("given_m", "given_f"))
    gendered = male.union(female).groupBy("norm").agg(F.min("as").alias("as"))
    both = known.where("kind = 'given_n'").join(gendered, "norm")
    own = tries.withColumnRenamed("kind", "as")
    told = both.join(own, ["as", "norm"], "left")
    return told.select("kind", "norm", _code(F.coalesce("attempt", F.lit(0)), F.col("as")).alias("code"))


def _code(attempt: Column, kind: Column) -> Column:
    """An attempt and the gender whose surrogate is used, as one number."""
    return attempt * 4 + F.when(kind == "given_m", 1).when(kind == "given_f", 2).otherwise(0)


def _rewritten(text: Column, key: str, tries: Column) -> Column:
    def piece(names: Column) -> Callable[[Column], Column]:
        def one(p: Column) -> Column:
            named = F.filter(names, lambda n: (n["norm"] == p["norm"]) & n["kind"].isin("given_m", "given_f"))
            here = F.when(p["kind"] == "given_n", F.array_min(F.transform(named, lambda n: n["kind"])))

            def made(kind: Column) -> Column:
                code = F.coalesce(F.try_element_at(tries, F.concat_ws("|", kind, p["norm"])), F.lit(0))

                def by(code: Column) -> Column:
                    other = F.when(code % 4 == 1, "given_m").when(code % 4 == 2, "given_f").otherwise(kind)
                    return _surrogate(F.lit(key), other, p["norm"], F.floor(code / 4).cast("int"))

                return let(code, by)

            written = let(let(F.coalesce(here, p["kind"]), made), lambda m: _written(p["kind"], p["norm"], p["text"], m))
            return F.when(p["kind"].isNull(), p["text"]).otherwise(written)

        return one

    def cut(names: Column) -> Column:
        def parts(mention: Column) -> Column:
            known = F.get(F.filter(names, lambda p: p["norm"] == _folded(mention)), F.lit(0))
            bare = F.struct(known["kind"].alias("kind"), known["norm"].alias("norm"), mention.alias("text"))
            return F.when(mention.rlike(_whole(BARE % NAME)) & known.isNotNull(), F.array(bare)).otherwise(_parts(mention))

        def one(part: Column, k: Column) -> Column:
            return F.when(k % 2 == 1, F.array_join(F.transform(parts(part), piece(names)), "")).otherwise(part)

        return let(_sought(names), lambda sought: F.array_join(F.transform(_cut(text, sought), one), ""))

    none = F.filter(_parts(F.lit("")), lambda p: F.lit(False))
    names = F.when(text.rlike(PERSON), _names(text)).otherwise(none)
    return F.when(text.rlike(SIGNS), let(names, cut)).otherwise(text)


def surrogated(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the personal data of column ``text`` replaced; all other columns stay.

    Null texts stay null, empty ones empty, and texts in which nothing is found as they are. Rows that repeat,
    or lack an id, are replaced like any other, since entities are known by their value, not by the row.
    """
    found = stored(mentions(docs, text), "mentions")
    known = stored(entities(found), "entities")
    later = attempts(known, key)
    coded = later.select("kind", "norm", _code(F.col("attempt"), F.lit("")).alias("code"))
    neutral = genders(known, later)
    rest = coded.join(neutral.select("kind", "norm"), ["kind", "norm"], "left_anti")
    tries = stored(rest.union(neutral), "attempts")
    body = F.col(text).cast("string")
    if tries.isEmpty():
        return docs.withColumn(text, _rewritten(body, key, F.create_map().cast("map<string,int>")))
    each = found.select("text_md5", F.explode("found").alias("mention")).distinct()
    parts = each.select("text_md5", F.explode(_parts(F.col("mention"))).alias("p"))
    hit = parts.select("text_md5", "p.kind", "p.norm").distinct().join(tries, ["kind", "norm"])
    entry = F.struct(F.concat_ws("|", "kind", "norm"), F.col("code"))
    by_text = hit.groupBy(F.col("text_md5").alias("__text")).agg(F.map_from_entries(F.collect_set(entry)).alias("__tries"))
    joined = docs.withColumn("__md5", F.md5(body)).join(stored(by_text, "attempts"), F.col("__md5") == F.col("__text"), "left")
    return joined.withColumn(text, _rewritten(body, key, F.col("__tries"))).select(*docs.columns)
