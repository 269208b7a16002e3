"""Personal data: keyed surrogates of detected entities, in DataFrame operations only.

Entities: e-mail addresses, IPv4 and IPv6 addresses, telephone numbers, social security numbers, card numbers that pass
the Luhn test, IBANs with right check digits, secrets (values after words such as token, password or api_key and an equals
sign or colon, and keys of well-known forms), and names after a title and one space (up to four words, initials stay as
they are). In a document with such a name its words are replaced wherever else they stand as whole words. Names that no
title introduces anywhere in their document, postal addresses and dates are not detected.

Each entity gives one or more identities (kind, canonical form): an e-mail address gives its domain and itself, a name its
given names and its surname. An identity's surrogate is a function of the key, the identity and an attempt number alone,
so an identity has one surrogate in all documents, however it is written and whatever title it has (coreference).

Surrogates keep the type and the format: letters stay letters of their case and digits digits, separators stay where
they are; a card passes the Luhn test and keeps its first digit, an IBAN keeps its country and has right check digits, a
telephone number keeps its country code, a private address stays private, a name keeps its title, its script (Latin or
Cyrillic) and, in given names, the gender: that of the name itself if it is a known one, else what its titles in the
corpus tell, if they agree.

Collision checks: the identities of all documents are gathered (distinct, so a hot one is one row). A surrogate is
refused if another identity of its kind has it, or if it is itself an identity of the corpus (given names and surnames
count as one kind there); the smallest identity keeps a contested surrogate, and the refused alone try again with the
next attempt number. Each attempt draws from a larger set where the format allows it (names and addresses grow by a
syllable or letter, private addresses move to a wider private range), so attempts end for any number of identities.
Where the format fixes the number of digits, surrogates that are identities are allowed from attempt `strict` on; that
format's own number of values is the one limit, and beyond it an error says so. The dictionary so made is joined to the
documents' entities, and what that gives to the documents, by tables whose sizes Spark knows.

Nulls and edges: a null text stays null and has no entity. Empty and very long texts are handled whole. Rows that agree
in doc_id and text get the same text. Other columns pass through. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import scratch, written

# Titles by the gender they tell.
MALE_TITLES = ["Mr", "Herr", "Sr", "Señor", "Monsieur", "г-н"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Mme", "Mlle", "Madame", "г-жа"]
OTHER_TITLES = ["Dr", "Prof"]

# Given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Albert Bruno Carl Daniel David Felix Frank Georg Henry Hugo Ivan Jakob James Karl Leon Louis Lukas Marco Martin Max Oscar Otto Paul Peter Ralph Simon Thomas Victor Walter".split(),
    ("latin", "f"): "Ada Alice Anna Berta Carla Clara Diana Elena Emma Eva Flora Frida Grace Hanna Helen Ida Irene Julia Laura Lena Lucia Maria Marta Nina Nora Olga Paula Rosa Sofia Vera".split(),
    ("latin", "n"): "Alex Andrea Ariel Casey Charlie Dana Eden Emery Finley Jamie Jean Jordan Kim Lee Logan Morgan Nico Noel Parker Quinn Reese Remy Riley Robin Rowan Sacha Sam Sidney Taylor Toni".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
    ("cyrillic", "f"): "Алла Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Софья".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава Шура".split(),
}

# Parts of which surnames are made, by script.
SURNAME = {
    "latin": ("Al Bar Ber Bran Cal Dal Der Dor El Fal Fer Gar Gil Hal Har Hol Kel Lam Lan Lor Mar Mel Mor Nor Pel Ral Ros Sal Sel Tal Ter Val Ver Wal Wel Win".split(), "ba be da de ga la le li lo ma me mi na ne ni ra re ri ro ta te va ve".split(), "berg bourne by croft dale dell field ford gate ham hart hurst land ley lin man mann mark mere mond ner ridge rick ser son stad stead sten ston ton tor vale well wick win wood worth".split()),
    "cyrillic": ("Ал Бар Вер Гор Дол Ер Зар Кал Лам Мар Нор Пел Рос Сал Тар Ур Фел Хар Чер Шел".split(), "ба ва га да ла ли ло ма ми на ра ро та".split(), "ев енко ин ко ов овский ский ук чук янов".split()),
}

_TITLE = "(?:" + "|".join(sorted(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES, key=lambda x: (-len(x), x))) + ")"
_OCTET = "(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)"
_NAME = f"\\b{_TITLE}\\.? \\p{{Lu}}(?:\\.(?= \\p{{Lu}})|[\\p{{L}}'-]+)(?: (?:\\p{{Lu}}\\.(?= \\p{{Lu}})|\\p{{Lu}}[\\p{{L}}'-]+)){{0,3}}"
_IP = f"(?<![\\d.]){_OCTET}(?:\\.{_OCTET}){{3}}(?![\\d]|\\.\\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_IP6 = f"(?<![\\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|[0-9A-Fa-f]{{2,4}}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\\w:]|\\.\\w)"
_MAIL = "(?<![\\w.%+-])[A-Za-z0-9_%+-]++(?:\\.[A-Za-z0-9_%+-]++)*+@(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{2,}"
_SSN = "(?<![\\d-])\\d{3}-\\d{2}-\\d{4}(?![\\d-])"
_PHONE = "(?<![\\w+])\\+\\d{1,3}[ .-]?\\(?\\d{2,4}\\)?[ .-]?\\d{3,4}[ .-]?\\d{3,4}(?!\\d)|(?<![\\w)])\\(\\d{3}\\) ?\\d{3}[ .-]\\d{4}(?!\\d)|(?<![\\d.-])\\d{3}[.-]\\d{3}[.-]\\d{4}(?![\\d-])"
_CARD = "(?<![\\d-])(?:\\d{4}[ -]){3}\\d{4}(?![\\d-])|(?<![\\w.])\\d{13,19}(?!\\w)"
_IBAN = "(?<!\\w)[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\\w)"
_BEFORE = "(?=[tTsSpPaA])(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?[ \\t]{0,3}[:=][ \\t]{0,3}[\"']?"
_VALUE = "(?=[A-Za-z0-9+/_=.-]{8})[A-Za-z0-9+/_=-]++(?:\\.[A-Za-z0-9+/_=-]++)*+(?!@)"
_KEY = "(?<!\\w)(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[\\w-]{10,}\\.eyJ[\\w-]{10,}\\.[\\w-]+)(?!\\w)"
_SECRET = f"{_BEFORE}{_VALUE}|{_KEY}"
ENTITY = "|".join([_SECRET, _MAIL, _IP, _IP6, _SSN, _IBAN, _CARD, _PHONE, _NAME])


def may_hold(text: Column) -> Column:
    """A quick test that every text with an entity passes: an @, signs as numbers and addresses have them, words that introduce secrets, the beginnings of keys, or a title."""
    out = text.rlike("\\d\\.\\d|\\d{3}|::|(?::[0-9A-Fa-f]{1,4}){6}") | text.rlike(_BEFORE)
    for t in ["@", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "eyJ", *MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES]:
        out = out | F.contains(text, F.lit(t))
    return out


@dataclass(frozen=True)
class PiiConfig:
    key: str = "loam"
    strict: int = 24
    most_attempts: int = 400
    identities_a_task: int = 4096


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "\\D", "")


def _number(hexes: Column, at: Column | int) -> Column:
    """A number below 2 ** 20 out of the hex digits, other for other places."""
    place = (F.lit(at) if isinstance(at, int) else at) * 5 % 55
    return F.conv(F.substring(hexes, 1, 60).substr((place + 1).cast("int"), F.lit(5)), 16, 10).cast("long")


def _secret(config: PiiConfig, kind: Column | str, canon: Column, attempt: Column, more: Column | str = "") -> Column:
    kind, more = (F.lit(x) if isinstance(x, str) else x for x in (kind, more))
    return F.sha2(F.concat_ws("\x1f", F.lit(config.key), kind, canon, attempt.cast("string"), more), 256)


def _pick(choices: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (n % len(choices) + 1).cast("int"))


def _hashed_digit(config: PiiConfig, kind: Column | str, canon: Column, attempt: Column, i: Column) -> Column:
    """The i-th digit of a stream of digits; a new hash after every ten."""
    block = (i / 10).cast("int").cast("string")
    return (_number(_secret(config, kind, canon, attempt, block), i % 10) % 10).cast("int")


def _stream(config: PiiConfig, kind: Column | str, canon: Column, attempt: Column, size: Column) -> Column:
    """`size` digits as a string; empty for size 0."""
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: _hashed_digit(config, kind, canon, attempt, i).cast("string")), "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum, where every second digit from the right is doubled, beginning with place `doubled` (0 is last)."""

    def add(total: Column, i: Column) -> Column:
        x = digits.substr(F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == doubled, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _mod97(text: Column) -> Column:
    """The number that letters (10 to 35) and digits spell, modulo 97."""

    def add(total: Column, i: Column) -> Column:
        c = text.substr(i + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(0), F.length(text) - 1), F.lit(0), add)


def _plain(e: Column) -> Column:
    return F.regexp_replace(e, " ", "")


def _value(e: Column) -> Column:
    """A secret without what introduces it."""
    return F.regexp_replace(e, f"^{_BEFORE}", "")


def _kind(e: Column) -> Column:
    """Kind of a matched entity; null for long numbers that aren't cards and what looks like an IBAN but isn't."""
    card = _luhn_sum(_digits(e), 1) % 10 == 0
    iban = _mod97(F.concat(_plain(e).substr(F.lit(5), F.length(e)), e.substr(F.lit(1), F.lit(4)))) == 1
    return (
        F.when(e.rlike(f"^{_BEFORE}"), "secret").when(F.instr(e, "@") > 0, "email").when(e.rlike(f"^{_TITLE}\\b\\.? "), "name").when(e.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$"), "ip")
        .when(e.rlike("^[0-9A-Fa-f]+:[0-9A-Fa-f:]*$"), "ipv6").when(e.rlike("^\\d{3}-\\d{2}-\\d{4}$"), "ssn").when(e.rlike("^(?:(?:\\d{4}[ -]){3}\\d{4}|\\d{13,19})$"), F.when(card, "card"))
        .when(e.rlike("^[A-Z]{2}\\d{2} ?[A-Z0-9]{4}(?: |[A-Z0-9])*$") & (F.length(_plain(e)) <= 34) & (e.contains(" ") | iban), F.when(iban, "iban")).when(e.rlike("^[+(\\d][\\d ().-]+$"), "phone").otherwise("secret")
    )


def _name_words(e: Column) -> Column:
    """(kind, canon, hint) of the words after the title; the kind of an initial is null. The hint is the title's gender."""
    words, title = F.slice(F.split(e, " "), 2, 9), F.rtrim(F.substring_index(e, " ", 1), F.lit("."))
    hint = F.when(title.isin(*MALE_TITLES), "m").when(title.isin(*FEMALE_TITLES), "f")
    kind = lambda w, i: F.when(~w.endswith("."), F.when(i == F.size(words) - 1, "surname").otherwise("given"))
    return F.transform(words, lambda w, i: F.struct(kind(w, i).alias("kind"), F.lower(w).alias("canon"), hint.alias("hint")))


def _one(kind: Column | str, canon: Column) -> Column:
    return F.array(F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), canon.alias("canon"), F.lit(None).cast("string").alias("hint")))


def identities(e: Column) -> Column:
    """Array of (kind, canon, hint) of an entity."""
    kind = _kind(e)
    mail = F.concat(_one("domain", F.lower(F.substring_index(e, "@", -1))), _one("email", F.lower(e)))
    none = F.array().cast("array<struct<kind:string,canon:string,hint:string>>")
    names = F.filter(_name_words(e), lambda x: x.kind.isNotNull())
    found = F.when(kind == "email", mail).when(kind == "name", names).when(kind == "ip", _one(kind, e)).when(kind == "secret", _one(kind, _value(e))).when(kind == "ipv6", _one(kind, F.lower(e))).when(kind == "iban", _one(kind, _plain(e)))
    return found.when(kind.isNotNull(), _one(kind, _digits(e))).otherwise(none)


def settled_gender(canon: Column, least: Column, most: Column) -> Column:
    """Gender of a given name: its own if it is a known name, else that of its titles' hints (least and most), if they agree."""
    known = [F.when(canon.isin(*[n.lower() for s in ("latin", "cyrillic") for n in GIVEN[s, g]]), g) for g in "mf"]
    return F.coalesce(*known, F.when(least == most, least), F.lit("n"))


def _letters(config: PiiConfig, kind: str, text: Column, canon: Column, attempt: Column) -> Column:
    """text with letters and digits replaced by others of their class; later attempts add letters at the end."""
    secret = lambda i: _secret(config, kind, canon, attempt, (i / 10).cast("int").cast("string"))
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def other(c: Column, i: Column) -> Column:
        n = _number(secret(i), i % 10)
        return (
            F.when(c.rlike("[a-z]"), F.lit(low).substr((n % 26 + 1).cast("int"), F.lit(1)))
            .when(c.rlike("[A-Z]"), F.lit(up).substr((n % 26 + 1).cast("int"), F.lit(1)))
            .when(c.rlike("[0-9]"), (n % 10).cast("string")).otherwise(c)
        )

    more = F.translate(F.substring(_secret(config, kind, canon, attempt, "extra"), 1, 60), "0123456789", "ghijklmnop")
    return F.concat(F.array_join(F.transform(F.split(text, "(?!^)(?<=.)"), other), ""), more.substr(F.lit(1), F.greatest(F.lit(0), attempt - 1)))


def _hexes(config: PiiConfig, kind: str, canon: Column, attempt: Column, size: Column) -> Column:
    """`size` hex digits."""
    blocks = F.transform(F.sequence(F.lit(0), (size / 64).cast("int")), lambda i: _secret(config, kind, canon, attempt, i.cast("string")))
    return F.array_join(blocks, "").substr(F.lit(1), size)


def surrogate(config: PiiConfig, kind: Column, canon: Column, attempt: Column, gender: Column) -> Column:
    """The canonical surrogate of an identity."""
    n, size = _number(_secret(config, kind, canon, attempt), 0), F.length(canon)
    stream = _stream(config, kind, canon, attempt, size)
    top = canon.substr(F.lit(1), F.lit(1))
    body = F.concat(top, stream.substr(F.lit(2), size - 2))
    card = F.concat(body, ((10 - _luhn_sum(body, 0) % 10) % 10).cast("string"))
    # 8 digits at the end are the subscriber's; what stands before the last ten is the country code.
    code = canon.substr(F.lit(1), size - 10)
    phone = F.when(size > 10, F.concat(code, stream.substr(F.lit(1), F.lit(10)))).otherwise(stream)
    ssn = F.concat((n % 8 + 1).cast("string"), stream.substr(F.lit(2), size - 1))
    # A private address stays in 192.168 or 10 for three attempts, in 10 up to the twelfth.
    fixed = F.when(canon.rlike("^192\\.168\\."), F.when(attempt < 3, 2).when(attempt < 12, 0).otherwise(-1)).when(canon.rlike("^10\\."), F.when(attempt < 12, 1).otherwise(-1)).otherwise(-1)
    own = lambda i: (_number(_secret(config, kind, canon, attempt), i) % 254 + 1).cast("string")
    private = lambda i: F.when((fixed == 0) & F.lit(i == 0), "10").when(F.lit(i) < fixed, F.get(F.split(canon, "\\."), F.lit(i))).otherwise(own(i))
    domain_head, domain_end = F.regexp_extract(canon, "^(.*)(\\.[^.]+)$", 1), F.regexp_extract(canon, "^(.*)(\\.[^.]+)$", 2)
    domain = F.concat(_letters(config, "domain", domain_head, canon, attempt), domain_end)
    mail = _letters(config, "email", F.substring_index(canon, "@", 1), canon, attempt)
    hexes = _hexes(config, "hex", canon, attempt, size)
    first = F.regexp_extract(canon, "^([0-9a-f]+):", 1)
    ipv6 = F.concat(first, _poured(canon.substr(F.length(first) + 1, size), hexes, "[0-9a-f]"))
    again = F.concat_ws("/", canon, attempt.cast("string"))
    key = F.regexp_extract(canon, "^(AKIA|gh[pousr]_|sk-|xox[abprs]-|eyJ)", 1)
    is_hex = canon.rlike("^[0-9a-f]+$") | canon.rlike("^[0-9A-F]+$")
    text = F.when(is_hex, F.when(canon == F.upper(canon), F.upper(hexes)).otherwise(hexes)).otherwise(F.concat(key, _letters(config, "secret", canon.substr(F.length(key) + 1, size), again, F.lit(0))))
    bban = _letters(config, "iban", canon.substr(F.lit(5), size), again, F.lit(0))
    check = 98 - _mod97(F.concat(bban, canon.substr(F.lit(1), F.lit(2)), F.lit("00")))
    iban = F.concat(canon.substr(F.lit(1), F.lit(2)), F.lpad(check.cast("string"), 2, "0"), bban)
    cyrillic = canon.rlike("\\p{IsCyrillic}")
    given = F.lit(None).cast("string")
    for g in "mfn":
        for script, is_script in (("cyrillic", cyrillic), ("latin", ~cyrillic)):
            given = F.when((gender == g) & is_script, _given(config, script, g, kind, canon, attempt)).otherwise(given)
    surname = F.when(cyrillic, _surname(config, "cyrillic", kind, canon, attempt)).otherwise(_surname(config, "latin", kind, canon, attempt))
    return (
        F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "ip", F.concat_ws(".", *map(private, range(4))))
        .when(kind == "domain", domain).when(kind == "email", mail).when(kind == "surname", surname).when(kind == "given", given)
        .when(kind == "ipv6", ipv6).when(kind == "iban", iban).otherwise(text)
    )


def _syllables(config: PiiConfig, script: str, kind: Column, canon: Column, attempt: Column, many: Column) -> Column:
    middle = SURNAME[script][1]
    places = F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: _pick(middle, _number(_secret(config, kind, canon, attempt, i.cast("string")), 5))), "")


def _given(config: PiiConfig, script: str, gender: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """A given name; at the second attempt a double name, from then on with more syllables each time."""
    first, second = (_pick(GIVEN[script, gender], _number(_secret(config, kind, canon, attempt), i)) for i in (0, 1))
    return F.when(attempt < 1, first).otherwise(F.concat(first, F.lit("-"), second, _syllables(config, script, kind, canon, attempt, attempt - 1)))


def _surname(config: PiiConfig, script: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """A surname of three parts, and of one more with each attempt."""
    start, middle, end = SURNAME[script]
    n = [_number(_secret(config, kind, canon, attempt), i) for i in range(3)]
    return F.concat(_pick(start, n[0]), _pick(middle, n[1]), _syllables(config, script, kind, canon, attempt, attempt), _pick(end, n[2]))


def _poured(e: Column, new: Column, kept: str = "[0-9]") -> Column:
    """e with its characters of a class replaced, in order, by those of new."""
    other = kept.replace("[", "[^")
    at = lambda i: F.length(F.regexp_replace(e.substr(F.lit(1), i + 1), other, ""))
    return F.array_join(F.transform(F.split(e, "(?!^)(?<=.)"), lambda c, i: F.when(c.rlike(kept), new.substr(at(i), F.lit(1))).otherwise(c)), "")


def _cased(old: Column, new: Column) -> Column:
    return F.when((old == F.upper(old)) & (F.length(old) > 1), F.upper(new)).otherwise(new)


def replaced(e: Column, look) -> Column:
    """What stands for an entity in the text; look(kind, canon) is an identity's surrogate."""
    kind = _kind(e)
    of = lambda k, canon: look(F.lit(k), canon)
    mail = F.concat(of("email", F.lower(e)), F.lit("@"), of("domain", F.lower(F.substring_index(e, "@", -1))))
    words = F.zip_with(F.slice(F.split(e, " "), 2, 9), _name_words(e), lambda w, x: F.when(x.kind.isNull(), w).otherwise(_cased(w, look(x.kind, x.canon))))
    name = F.concat_ws(" ", F.substring_index(e, " ", 1), words)
    secret = F.concat(e.substr(F.lit(1), F.length(e) - F.length(_value(e))), of("secret", _value(e)))
    chosen = F.when(kind == "email", mail).when(kind == "name", name).when(kind == "ip", look(kind, e)).when(kind == "secret", secret).when(kind == "ipv6", _cased(e, of("ipv6", F.lower(e))))
    return chosen.when(kind == "iban", _poured(e, of("iban", _plain(e)), "[0-9A-Z]")).when(kind.isNotNull(), _poured(e, look(kind, _digits(e)))).otherwise(e)


def name_pairs(entities: Column, look) -> Column:
    """(pattern, new) of each word of the entities that are names, as it is written and in capitals."""
    names = F.filter(entities, lambda e: _kind(e) == "name")

    def own(e: Column) -> Column:
        words = F.zip_with(F.slice(F.split(e, " "), 2, 9), _name_words(e), lambda w, x: F.struct(w.alias("w"), F.when(x.kind.isNotNull(), look(x.kind, x.canon)).alias("new")))
        both = F.flatten(F.transform(words, lambda x: F.array(F.struct(x.w.alias("w"), _cased(x.w, x.new).alias("new")), F.struct(F.upper(x.w).alias("w"), F.upper(x.new).alias("new")))))
        return F.filter(both, lambda x: x.new.isNotNull())

    found = F.array_distinct(F.flatten(F.transform(names, own)))
    return F.transform(found, lambda x: F.struct(F.concat(F.lit("(?U)\\b\\Q"), x.w, F.lit("\\E\\b")).alias("pattern"), x.new.alias("new")))


def _family(kind: Column) -> Column:
    """Kinds whose surrogates and identities must not meet."""
    return F.when(kind.isin("given", "surname"), "name").otherwise(kind)


def dictionary(found: DataFrame, config: PiiConfig) -> DataFrame:
    """kind, canon, new: each identity's surrogate, without collisions. found: distinct kind, canon, with gender."""
    tasks = 1 + found.count() // config.identities_a_task
    real = written(found.select(_family(F.col("kind")).alias("family"), F.lower("canon").alias("used")).distinct(), "pii-real")
    waiting, done = found, []
    for attempt in range(config.most_attempts):
        new = surrogate(config, F.col("kind"), F.col("canon"), F.lit(attempt), F.col("gender"))
        shown = F.when(F.col("kind") == "email", F.concat("new", F.lit("@"), F.substring_index("canon", "@", -1))).otherwise(F.col("new"))
        tried = waiting.repartition(tasks, "kind", "canon").withColumn("new", new)
        tried = written(tried.withColumns({"family": _family(F.col("kind")), "used": F.lower(shown)}), "pii-tried")
        first = tried.groupBy("family", "used").agg(F.min(F.struct("kind", "canon")).alias("first"))
        good = tried.join(first, ["family", "used"]).where(F.struct("kind", "canon") == F.col("first")).drop("first")
        for others in (real, *done)[attempt >= config.strict :]:
            good = good.join(others.select("family", "used"), ["family", "used"], "left_anti")
        done.append(written(good.select("kind", "canon", "new", "family", "used"), "pii-surrogates"))
        waiting = written(waiting.join(done[-1].select("kind", "canon"), ["kind", "canon"], "left_anti"), "pii-waiting")
        left = waiting.count()
        if not left:
            return written(reduce(DataFrame.unionByName, done).select("kind", "canon", "new"), "pii-dictionary")
        tasks = 1 + left // config.identities_a_task
    raise ValueError(f"after {config.most_attempts} attempts {left} identities have no surrogate: there are more of a format than the format has values")


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of id and text), entities of the documents that have any."""
    some = docs.where(may_hold(F.col("text")))
    rows = some.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)).alias("entities"))
    return rows.where(F.size("entities") > 0)


def pseudonymise(docs: DataFrame, config: PiiConfig | None = None) -> DataFrame:
    """docs with text replaced, n_pii (entities replaced) and pii_kinds (distinct, sorted, comma-joined)."""
    config = config or PiiConfig()
    with scratch(docs.sparkSession) as own_tables:
        held = written(entities(docs), "pii-entities")
        each = held.select("doc_id", "h", F.explode("entities").alias("e")).select("doc_id", "h", F.explode(identities(F.col("e"))).alias("i")).select("doc_id", "h", "i.kind", "i.canon", "i.hint")
        distinct = each.groupBy("kind", "canon").agg(settled_gender(F.col("canon"), F.min("hint"), F.max("hint")).alias("gender"))
        made = dictionary(written(distinct, "pii-distinct"), config)
        name = F.concat_ws("\x1f", "kind", "canon")
        own = each.drop("hint").distinct().join(made, ["kind", "canon"]).groupBy("doc_id", "h").agg(F.map_from_entries(F.collect_list(F.struct(name, "new"))).alias("made"))

        def look(kind: Column, canon: Column) -> Column:
            return F.element_at(F.col("made"), F.concat_ws("\x1f", kind, canon))

        # Only documents with entities are shuffled and taken apart; the others pass by. The merge join of both is the same
        # plan at every size, as the replacements grow with the input.
        kinds = F.filter(F.transform("entities", _kind), lambda k: k.isNotNull())
        once = held.dropDuplicates(["doc_id", "h"]).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "entities")
        told = once.join(own, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h")), "left")
        told = told.select("_id", "_h", F.transform("entities", lambda e: replaced(e, look)).alias("_new"), kinds.alias("_kinds"), name_pairs(F.col("entities"), look).alias("_names"))
        told = written(told, "pii-replacements")
        own_tables.keep(told)
    plain = docs.drop("n_pii", "pii_kinds")
    some = F.coalesce(may_hold(F.col("text")) & F.col("text").rlike(ENTITY), F.lit(False))
    joined = plain.where(some).join(told.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("doc_id", "text") == F.col("_h")), "left")
    between = F.transform(F.split("text", ENTITY, -1), lambda p: F.aggregate("_names", p, lambda text, x: F.regexp_replace(text, x.pattern, x.new)))
    between = F.when(F.size("_names") > 0, between).otherwise(F.split("text", ENTITY, -1))
    text = F.array_join(F.zip_with(between, "_new", lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), "")
    columns = [text.alias("text") if c == "text" else F.length(text).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in plain.dtypes]
    changed = joined.select(*columns, F.size("_kinds").cast("long").alias("n_pii"), F.array_join(F.array_sort(F.array_distinct("_kinds")), ",").alias("pii_kinds"))
    same = plain.where(~some).withColumns({"n_pii": F.lit(0).cast("long"), "pii_kinds": F.lit("")})
    return changed.unionByName(same)
