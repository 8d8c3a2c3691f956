"""PII surrogates: keyed, type-consistent replacements, in DataFrame functions alone."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

KEY = "engram surrogate key"
#: From this attempt on a surrogate is longer than its format by a digit or letter each time, so that no format runs out of values.
ROOMY = 10

#: Titles before a name, by gender.
MALE = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Signor", "Sir", "господин", "г-н", "κύριος", "Κύριος", "السيد", "מר"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Signora", "Lady", "госпожа", "г-жа", "κυρία", "Κυρία", "السيدة", "גברת"]
EITHER = ["Dr", "Doctor", "Doktor", "Prof", "Professor", "доктор", "профессор", "Δρ"]
#: Given names, by gender (n: either) and script (l: Latin, c: Cyrillic, g: Greek).
GIVEN = {
    "ml": ["Adam", "Boris", "Carl", "Daniel", "Emil", "Felix", "Georg", "Henri", "Ivan", "Jonas", "Karim", "Leon", "Martin", "Noel", "Oscar", "Pablo"],
    "fl": ["Alice", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helene", "Irene", "Julia", "Karla", "Laura", "Maria", "Nadia", "Olga", "Paula"],
    "nl": ["Alex", "Andrea", "Billie", "Chris", "Dana", "Eli", "Jamie", "Kim", "Lou", "Mika", "Nico", "Pat", "Robin", "Sam", "Sasha", "Toni"],
    "mc": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан", "Фёдор"],
    "fc": ["Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Юлия"],
    "nc": ["Саша", "Женя", "Валя", "Слава", "Тоня", "Шура", "Паша", "Мика", "Вася", "Лёня", "Стася", "Витя", "Гера", "Мира", "Рита", "Юра"],
    "mg": ["Άρης", "Γιώργος", "Δήμος", "Ηλίας", "Θάνος", "Κώστας", "Λεωνίδας", "Μάνος", "Νίκος", "Πάνος", "Ρήγας", "Σπύρος", "Στέλιος", "Τάσος", "Φώτης", "Χρήστος"],
    "fg": ["Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηρώ", "Ιωάννα", "Καλλιόπη", "Λυδία", "Μαρία", "Νεφέλη", "Ουρανία", "Ρέα", "Σοφία", "Χαρά"],
}
#: What family names, and given names in other scripts, are made of: script -> (pattern of a letter, parts, how many at first).
SYLLABLES = {
    "c": (r"\p{IsCyrillic}", ["ба", "де", "фи", "го", "ху", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "во", "ву", "зан"], 4),
    "g": (r"\p{IsGreek}", ["βα", "δε", "φι", "γο", "θυ", "κα", "λε", "μι", "νο", "πυ", "ρα", "σε", "τι", "βο", "λου", "ζαν"], 4),
    "a": (r"\p{IsArabic}", ["با", "دي", "فو", "كا", "لي", "مو", "نا", "را", "سي", "تو", "وا", "زي", "حا", "شو", "جي", "قا"], 3),
    "h": (r"\p{IsHebrew}", ["בא", "די", "פו", "גא", "הי", "כו", "לא", "מי", "נו", "רא", "סי", "טו", "וא", "זי", "חו", "שא"], 3),
    "z": (r"\p{IsHan}", ["安", "白", "成", "丹", "恩", "方", "光", "和", "嘉", "凯", "林", "明", "宁", "平", "荣", "文"], 2),
    "l": (None, ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wu", "zan"], 4),
}
#: Letters for letters in e-mail addresses: (pattern of a letter, alphabet); other scripts get Latin letters.
ALPHABETS = [
    (r"\p{IsLatin}", "abcdefghijklmnopqrstuvwxyz"),
    (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطعغفقكلمنهوي"),
    (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"\p{IsHan}", "安白成丹恩方光和嘉凯林明宁平荣文"),
    (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてと"),
    (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテト"),
    (r"\p{IsHangul}", "가나다라마바사아자차카타파하고노도로모보"),
]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]*[\p{L}\p{N}])+"
IP = rf"(?<![\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{N}}]|\.\p{{N}})"
_GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?={_GROUP}:)(?<![\p{{L}}\p{{N}}:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{2,6}}(?::{_GROUP}){{1,5}}|{_GROUP}:(?::{_GROUP}){{2,6}})(?![\p{{L}}\p{{N}}:])"
PHONE = r"(?<![\p{N}+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\p{N})|(?<![\p{N}])\(\d{3}\) ?\d{3}-\d{4}(?!\p{N})|(?<![\p{N}-])\d{3}-\d{3}-\d{4}(?![\p{N}-])"
SOCIAL = r"(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
NUMBER = r"(?<![\p{N}])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?!\p{N})"
#: Names: a title, particles, and up to three words with a capital (or capitals only), with apostrophes and hyphens; one word in scripts
#: without capitals. Han names stand before their title, with no other Han character before them.
_TITLES = "|".join(sorted({y for x in MALE + FEMALE + EITHER for y in (x, x.upper())}, key=lambda x: (-len(x), x)))
_INITIALS = "".join(sorted({y for x in MALE + FEMALE + EITHER for y in (x[0], x[0].upper())}))
PARTICLES = ["al", "bin", "da", "de", "del", "della", "den", "der", "di", "dos", "du", "ibn", "la", "le", "ter", "van", "von", "zu"]
_PARTICLE = f"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}"
_CAPITAL = r"\p{Lu}(?:\.|(?:['’]?[\p{L}\p{M}])+(?:-\p{L}(?:['’]?[\p{L}\p{M}])*)*)"
_UNCASED = r"[\p{IsArabic}\p{IsHebrew}&&\p{L}]{2,}"
TITLE = rf"(?=[{_INITIALS}])(?:{_TITLES})\.? "
HAN_NAME = r"(?<!\p{IsHan})\p{IsHan}{1,4}(?=先生|女士|小姐)"
NAME = rf"(?<!\p{{L}}){TITLE}(?:{_PARTICLE}{_CAPITAL}(?: {_PARTICLE}{_CAPITAL}){{0,2}}|{_UNCASED})(?!\p{{L}})|{HAN_NAME}"
#: In the order in which they are tried; the pattern of all has no group of its own but NUMBER's.
KINDS = [("email", EMAIL), ("ip", IP), ("ipv6", IPV6), ("phone", PHONE), ("social", SOCIAL), ("iban", IBAN), ("number", NUMBER), ("name", NAME)]
ANY = "|".join(p for _, p in KINDS)
#: The same for texts that can hold neither a name nor an IPv6 address.
PLAIN = "|".join(p for kind, p in KINDS if kind not in ("ipv6", "name"))
#: Texts without any of these have no entity of the kinds left out of PLAIN, and of the others.
RICH_HINT = rf"(?<!\p{{L}}){TITLE}|先生|女士|小姐|[0-9A-Fa-f]:[0-9A-Fa-f:]"
PLAIN_HINT = r"@|[0-9][0-9 .()+-]{5}|[A-Z]{2}[0-9]{2}"
#: Stands around what was found, in texts without it.
MARK = "\ue0f5"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _alone(pattern: str) -> str:
    """Without what stands around a value."""
    return re.sub(r"\(\?<?[!=](?:\[[^\]]*\]|\\p\{\w+\}|\\\.|\||[^()\[\]])*\)", "", pattern)


def _kind(value: Column) -> Column:
    """bare: a name without its title, which other mentions in the text have."""
    out = F
    for kind, pattern in KINDS:
        if kind != "name":
            out = out.when(value.rlike(f"^(?:{_alone(pattern)})$"), kind)
    return out.when(value.rlike(f"^{TITLE}"), "name").when(value.rlike(r"^\p{IsHan}+$"), "name").otherwise("bare")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _canonical(kind: Column, value: Column) -> Column:
    """What mentions of one entity have in common."""
    return (
        F.when(kind.isin("phone", "social", "number"), _digits(value))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .otherwise(F.lower(value))
    )


def _part(word: Column, kind: Column, canonical: Column, after: Column) -> Column:
    return F.struct(word.alias("word"), kind.alias("kind"), canonical.alias("canonical"), after.alias("after"))


def _name_parts(name: Column, given: Callable[[Column], Column]) -> Column:
    """The words of a name: the last one and its hyphened parts are family names, initials and particles are no names, and all
    before are given names, whose canonical form given() makes."""

    def of_chunk(chunks: Column) -> Callable[[Column, Column], Column]:
        def run(chunk: Column, i: Column) -> Column:
            last = i == F.size(chunks) - 1
            words = F.split(chunk, "-")

            def one(word: Column, j: Column) -> Column:
                kind = F.when(word.rlike(r"^.\.$"), "initial").when(last, "family").when(word.isin(PARTICLES), "keep").otherwise("given")
                canonical = F.when(kind == "given", given(F.lower(word))).otherwise(F.lower(word))
                return _part(word, kind, canonical, F.when(j < F.size(words) - 1, "-").when(last, "").otherwise(" "))

            return F.transform(words, one)

        return run

    return _let(F.split(name, " "), lambda chunks: F.flatten(F.transform(chunks, of_chunk(chunks))))


def _titled_parts(value: Column) -> Column:
    title = F.lower(F.regexp_extract(value, r"^[\p{L}-]+", 0))
    gender = F.when(title.isin([x.lower() for x in MALE]), "m").when(title.isin([x.lower() for x in FEMALE]), "f").otherwise("n")
    return _name_parts(F.regexp_replace(value, f"^{TITLE}", ""), lambda word: F.concat(gender, F.lit(" "), word))


def _byte(hexes: Column, i: Column | int) -> Column:
    """Byte i of a digest in hexadecimal, again from its start after 32."""
    place = (i if isinstance(i, Column) else F.lit(i)) % 32 * 2 + 1
    return F.conv(F.substring(hexes, place, F.lit(2)), 16, 10).cast("int")


def _letter(letters: Column, hexes: Column, i: Column) -> Column:
    return F.substring(letters, _byte(hexes, i) % F.length(letters) + 1, F.lit(1))


def _first_of(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """What stands beside the first pattern that c begins with; else beside the first of all."""
    out = F
    for pattern, what in patterns:
        out = out.when(c.rlike(f"^{pattern}"), what)
    return out.otherwise(patterns[0][1])


def _like(value: Column, hexes: Column) -> Column:
    """Digits for digits and letters for letters of the same script and case; all else stays."""

    def one(c: Column, i: Column) -> Column:
        lower = _let(_first_of(c, ALPHABETS), lambda letters: _letter(letters, hexes, i))
        return F.when(c.rlike("^[0-9]$"), (_byte(hexes, i) % 10).cast("string")).when(c.rlike(r"^\p{Lu}$"), F.upper(lower)).when(c.rlike(r"^\p{L}$"), lower).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _like_hex(value: Column, hexes: Column) -> Column:
    """Other hexadecimal digits from the first colon on; all else stays."""
    start = F.instr(value, ":")
    digit = lambda i: F.substring(F.lit("0123456789abcdef"), _byte(hexes, i) % 16 + 1, F.lit(1))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when((i >= start) & (c != ":"), digit(i)).otherwise(c)), "")


def _checksum(digits: Column) -> Column:
    """Sum of digits, every second doubled (less 9 from 10 on), the last one not doubled."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10)).cast("int"))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _number(canonical: Column, hexes: Column) -> Column:
    """As long, with the same first digit, and with a right check digit just if the original has."""
    body = F.concat(F.substring(canonical, 1, 1), _like(F.substring(canonical, F.lit(2), F.length(canonical) - 2), hexes))

    def closed(body: Column) -> Column:
        right = (10 - _checksum(F.concat(body, F.lit("0"))) % 10) % 10
        last = F.when(_checksum(canonical) % 10 == 0, right).otherwise((right + 1 + _byte(hexes, 31) % 9) % 10)
        return F.concat(body, last.cast("string"))

    return _let(body, closed)


def _script(word: Column) -> Column:
    return _first_of(word, [(r"\p{IsLatin}", "l"), *((pattern, name) for name, (pattern, _, _) in SYLLABLES.items() if pattern)])


def _parts(script: Column, hexes: Column, n: Column) -> Column:
    """n parts of a name in a script, which the digest chooses."""
    listed = F.create_map(*(x for name, (_, parts, _) in SYLLABLES.items() for x in (F.lit(name), F.array(*map(F.lit, parts)))))
    return _let(F.element_at(listed, script), lambda parts: F.array_join(
        F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), lambda i: F.element_at(parts, _byte(hexes, i) % F.size(parts) + 1)), ""))


def _family(word: Column, hexes: Column, attempt: Column) -> Column:
    """A name in the script of word, longer by one part for each further attempt."""
    sizes = F.create_map(*(F.lit(x) for name, (_, _, n) in SYLLABLES.items() for x in (name, n)))
    return _let(_script(word), lambda script: _parts(script, hexes, F.element_at(sizes, script) + attempt))


def _given(canonical: Column, hexes: Column, attempt: Column) -> Column:
    """gender, blank, a given name of that gender and the script; for each further attempt a syllable longer. In scripts without a
    list, a name as families have."""
    gender, word = F.substring(canonical, 1, 1), F.substring(canonical, F.lit(3), F.lit(200))
    listed = F.create_map(*(x for which, names in GIVEN.items() for x in (F.lit(which), F.array(*(F.lit(n.lower()) for n in names)))))

    def of(script: Column) -> Column:
        first = _let(F.try_element_at(listed, F.concat(gender, script)), lambda names: F.element_at(names, _byte(hexes, 0) % F.size(names) + 1))
        return F.coalesce(F.concat(first, _parts(script, hexes, attempt)), _family(word, hexes, attempt))

    return F.concat(gender, F.lit(" "), _let(_script(word), of))


def _surrogate(kind: Column, canonical: Column, hexes: Column, domain: Column, attempt: Column) -> Column:
    """The canonical form of the replacement."""
    local, host = F.regexp_extract(canonical, "^(.*)@", 1), F.regexp_extract(canonical, "@(.*)\\.[^.]*$", 1)
    longer = F.substring(F.translate(F.substring(hexes, 40, 20), "0123456789", "ghijklmnop"), F.lit(1), F.greatest(F.lit(0), attempt - 2))
    extra = F.greatest(F.lit(0), attempt - (ROOMY - 1))
    digits = F.array_join(F.transform(F.sequence(F.lit(0), extra), lambda i: F.when(i > 0, (_byte(hexes, i + 11) % 10).cast("string")).otherwise("")), "")
    country = F.when(F.length(canonical) > 10, F.length(canonical) - 10).otherwise(0)
    return (
        F.when(kind == "email", F.concat(_like(local, hexes), longer, F.lit("@"), _like(host, domain), F.regexp_extract(canonical, "\\.[^.]*$", 0)))
        .when(kind == "ip", F.concat(F.concat_ws(".", (_byte(hexes, 0) % 223 + 1).cast("string"), *(_byte(hexes, i).cast("string") for i in (1, 2, 3))), F.when(extra > 0, F.concat(F.lit("."), digits)).otherwise("")))
        .when(kind == "ipv6", F.concat(_like_hex(canonical, hexes), F.when(extra > 0, F.concat(F.lit(":"), digits)).otherwise("")))
        .when(kind == "phone", F.concat(F.substring(canonical, F.lit(1), country), _like(F.substring(canonical, country + 1, F.lit(40)), hexes), digits))
        .when(kind == "social", F.concat(_like(canonical, hexes), digits))
        .when(kind == "iban", F.concat(F.substring(canonical, 1, 2), _like(F.substring(canonical, F.lit(3), F.lit(40)), hexes), digits))
        .when(kind == "number", F.concat(_number(canonical, hexes), digits))
        .when(kind == "given", _given(canonical, hexes, attempt))
        .when(kind == "family", _family(canonical, hexes, attempt))
        .otherwise(_like(canonical, hexes))
    )


def _formatted(kind: Column, value: Column, surrogate: Column) -> Column:
    """The replacement as this mention writes it: the same separators, capitals and upper case."""

    def filled(keep: str) -> Column:
        before = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), keep, ""))
        own = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(keep), c).otherwise(F.substring(surrogate, before(i) + 1, F.lit(1)))), "")
        return F.concat(own, F.substring(surrogate, before(F.length(value)) + 1, F.lit(40)))

    word = F.when(kind == "given", F.substring(surrogate, F.lit(3), F.lit(400))).otherwise(surrogate)
    capitals = (value == F.upper(value)) & value.rlike(r"\p{Lu}.*\p{Lu}")
    return (
        F.when(kind == "keep", value)
        .when(kind.isin("phone", "social", "number"), filled(r"\D"))
        .when(kind == "iban", filled(" "))
        .when(kind.isin("given", "family", "initial"), F.when(capitals, F.upper(word)).when(value.rlike(r"^\p{Lu}"), F.initcap(word)).otherwise(word))
        .when(kind.isin("email", "ipv6") & (value == F.upper(value)) & value.rlike(r"\p{L}"), F.upper(surrogate))
        .otherwise(surrogate)
    )


def _pieces(text: Column, pattern: Column) -> Column:
    """What is between the matches, and the matches, in turn."""
    quick = F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), MARK)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    slow = F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda a, b: F.array_compact(F.array(a, b))))
    return F.when(text.contains(MARK), slow).otherwise(quick)


def mentions(text: Column) -> Column:
    """The text in pieces: between and found, of which found[i] stands after between[i]. A mention has its value, kind, the title
    before it, and its parts, each with word, kind, canonical and what stands after it. Once a text has a titled name, the same
    full name and the same family names are found in it without a title too."""
    odd = lambda pieces: F.filter(pieces, lambda x, i: i % 2 == 1)
    titled = lambda values: F.filter(values, lambda v: v.rlike(f"^{TITLE}"))

    def again(pieces: Column) -> Column:
        full = F.transform(titled(odd(pieces)), lambda v: F.regexp_replace(v, f"^{TITLE}", ""))
        families = F.transform(full, lambda v: F.regexp_extract(v, r"[^ ]+$", 0))

        def search(names: Column) -> Column:
            both = F.filter(F.array_distinct(F.concat(full, families, F.transform(full, F.initcap), F.transform(families, F.initcap))), lambda v: F.length(v) > 2)
            longest = F.array_sort(both, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
            more = F.array_join(F.transform(longest, lambda v: F.regexp_replace(v, r"\.", r"\\\\.")), "|")
            return _pieces(text, F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), more, F.lit(r")(?![\p{L}\p{N}'’])")))

        return F.when(F.size(F.filter(families, lambda v: F.length(v) > 2)) > 0, search(full)).otherwise(pieces)

    def described(values: Column) -> Column:
        known = F.filter(F.flatten(F.transform(titled(values), _titled_parts)), lambda p: p["kind"] == "given")

        def one(known: Column) -> Callable[[Column], Column]:
            def given(word: Column) -> Column:
                same = F.filter(known, lambda p: F.substring(p["canonical"], F.lit(3), F.lit(400)) == word)
                return F.coalesce(F.get(F.transform(same, lambda p: p["canonical"]), F.lit(0)), F.concat(F.lit("n "), word))

            def run(value: Column) -> Column:
                whole = lambda kind: F.array(_part(value, kind, _canonical(kind, value), F.lit("")))
                return _let(_kind(value), lambda kind: F.struct(
                    value.alias("value"),
                    F.when(kind == "bare", "name").otherwise(kind).alias("kind"),
                    F.when(kind == "name", F.regexp_extract(value, f"^{TITLE}", 0)).otherwise("").alias("title"),
                    F.when((kind == "name") & value.rlike(f"^{TITLE}"), _titled_parts(value)).when(kind.isin("name", "bare"), _name_parts(value, given)).otherwise(whole(kind)).alias("parts"),
                ))

            return run

        return _let(known, lambda k: F.transform(values, one(k)))

    none = F.when(F.lit(False), F.array(text))
    pieces = F.when(text.rlike(RICH_HINT), _let(_pieces(text, F.lit(ANY)), again)).when(text.rlike(PLAIN_HINT), _pieces(text, F.lit(PLAIN))).otherwise(none)
    return _let(pieces, lambda p: F.struct(F.filter(p, lambda x, i: i % 2 == 0).alias("between"), F.when(F.size(p) > 1, described(odd(p))).alias("found")))


def _hexes(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *parts).cast("binary"), 256)


def _candidate(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    both = F.struct(_hexes(key, kind, canonical, attempt.cast("string")).alias("own"), _hexes(key, F.lit("domain"), F.regexp_extract(canonical, "@(.*)$", 1)).alias("domain"))
    return _let(both, lambda h: _surrogate(kind, canonical, h["own"], h["domain"], attempt))


def attempts(entities: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """entities (kind, canonical), distinct -> those whose surrogate is not the first candidate: kind, canonical, attempt.

    Where several entities have one candidate, that with the earliest attempt (then the smallest) keeps it and the
    others try their next; so does every entity whose candidate is an entity of the corpus. From attempt ROOMY on candidates grow, so that a free one comes
    for any number of entities."""
    now, step = scratch.cut(entities.withColumn("attempt", F.lit(0)), "attempt-0"), 0
    while True:
        step += 1
        made = scratch.cut(now.withColumn("made", _candidate(key, F.col("kind"), F.col("canonical"), F.col("attempt"))), f"made-{step}")
        best = made.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canonical")).alias("best"), F.count("*").alias("n")).filter("n > 1")
        real = made.select("kind", F.col("canonical").alias("made"))
        twice = made.join(best, ["kind", "made"]).filter("canonical <> best.canonical").select("kind", "canonical")
        taken = made.join(real, ["kind", "made"], "left_semi").select("kind", "canonical")
        losers = scratch.cut(twice.unionByName(taken).distinct().withColumn("lost", F.lit(1)), f"losers-{step}")
        if losers.isEmpty():
            return now.filter("attempt > 0")
        now = scratch.cut(now.join(losers, ["kind", "canonical"], "left").select("kind", "canonical", (F.col("attempt") + F.coalesce("lost", F.lit(0))).alias("attempt")), f"attempt-{step}")
        scratch.drop(f"made-{step}")


def _free(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with the entities in text replaced, see replaced()."""
    out, found = replaced(docs, key)
    return out.drop(found)


def replaced(docs: DataFrame, key: str = KEY) -> tuple[DataFrame, str]:
    """docs with each entity in text replaced by its surrogate; n_chars, if there is such a column, is that of the new
    text. All other columns and rows stay, whatever their names; one column is added, with the mentions that were found, and its name returned.

    Kinds: e-mail, IPv4 and IPv6 address, phone, social security number, IBAN, number of 13 to 19 digits (payment cards), and names after a
    title, with the same names without it in the same text. One entity (letters' case and separators apart) has one surrogate
    in all texts, and different entities have different ones; no surrogate is an entity of the input. Given and family names are
    entities of their own: "Mr John Smith", "Mr Smith" and "Dr SMITH" have one family name, in all texts. A given name is one for each gender
    (m, f, or n after titles of either). Formats stay: length and separators, letters' case and script, a number's first digit and check digit, a phone's country
    code, an e-mail's domain as a group, an IPv6 address's first group, a name's title, gender, script, particles, hyphens and number of words. Only where a format
    has no free values left after ROOMY attempts is a surrogate longer. Initials get other letters, which are not distinct. Surrogates depend on the key and
    on the entities only.

    Null text stays null; texts without entities stay as they are; equal rows stay equal; null doc_id is fine. Empty table: no rows."""
    scratch = Scratch(docs.sparkSession)
    columns = docs.columns
    pii, attempt_of = _free("_pii", columns), _free("_pii_attempt", columns)
    # found once; a text with entities is kept in its pieces
    own = docs.withColumn(pii, mentions(F.col("text")))
    own = own.withColumn("text", F.when(F.col(pii)["found"].isNull(), F.col("text")))
    own = scratch.cut(own, "marked")
    parts = own.select(F.explode(F.col(pii)["found"]).alias("m")).select(F.explode("m.parts").alias("p"))
    entities = parts.filter("p.kind not in ('keep', 'initial')").select("p.kind", "p.canonical").distinct()
    changed = scratch.cut(attempts(scratch.cut(entities, "entities"), scratch, key), "changed")
    no_attempts = F.lit(None).cast("map<string,int>")
    if changed.isEmpty():
        own = own.withColumn(attempt_of, no_attempts)
    else:  # later attempts reach the rows that need them by a join on what was found there
        touched = F.col(pii)["found"].isNotNull()
        keys = [F.xxhash64(F.col(pii)["found"]).alias("_h"), F.hash(F.col(pii)["found"]).alias("_c")]
        named = own.filter(touched).select(*keys, F.explode(F.flatten(F.transform(F.col(pii)["found"], lambda m: m["parts"]))).alias("p")).select("_h", "_c", "p.kind", "p.canonical").distinct()
        maps = named.join(changed, ["kind", "canonical"]).groupBy("_h", "_c").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "canonical"), "attempt"))).alias("_a"))
        maps = scratch.cut(maps, "maps")
        some = own.filter(touched)
        some = some.join(maps, (keys[0] == maps["_h"]) & (keys[1] == maps["_c"]), "left").select(*(some[c] for c in own.columns), maps["_a"].alias(attempt_of))
        own = own.filter(~touched).withColumn(attempt_of, no_attempts).unionByName(some)

    def made(p: Column) -> Column:
        attempt = F.coalesce(F.col(attempt_of)[F.concat_ws(":", p["kind"], p["canonical"])], F.lit(0))
        surrogate = _let(attempt, lambda a: _candidate(key, p["kind"], p["canonical"], a))
        return F.struct(p["kind"].alias("kind"), p["word"].alias("word"), p["after"].alias("after"), surrogate.alias("surrogate"))

    def rewritten(m: Column) -> Column:
        parts = F.transform(F.transform(m["parts"], made), lambda p: F.concat(_formatted(p["kind"], p["word"], p["surrogate"]), p["after"]))
        return F.concat(m["title"], F.array_join(parts, ""))

    said = F.transform(F.col(pii)["found"], rewritten)
    text = F.array_join(F.flatten(F.zip_with(F.col(pii)["between"], said, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    out = own.withColumn("text", F.when(F.col(pii)["found"].isNotNull(), text).otherwise(F.col("text"))).drop(attempt_of)
    return (out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out), pii


def surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, text, and how many mentions of each kind were replaced: a row for each row."""
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out, found = replaced(two, key)
    count = lambda kind: F.coalesce(F.size(F.filter(F.col(found)["found"], lambda m: m["kind"] == kind)), F.lit(0)).cast("long")
    return out.select("doc_id", "text", *(count(kind).alias(f"n_{kind}") for kind, _ in KINDS))
