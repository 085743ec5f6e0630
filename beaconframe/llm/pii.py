"""PII: keyed, type-consistent surrogates, in built-in SQL functions only.

One alternation of patterns cuts a text into plain parts and entities; each
entity gets its surrogate and the parts are joined again. Numbers (phones,
cards, national ids, addresses of hosts) go through a keyed Feistel permutation
of their digits: it keeps the format and is one-to-one, so distinct numbers
stay distinct and equal ones stay equal, and it leaves no number as it was: one
step of a keyed cycle over all numbers of that length. Mail addresses and names
get keyed hashes spelled in the script, in capitals where the name is. A name
after a title has a family name, keyed by the family name alone, and where given
a given name of the title's gender, keyed by gender and given name: full and
short forms of one name agree. After a German title, where any noun is a capital
word, the first of two is the family name if the text has it alone after a title
too; the second is then a noun and stays. Where a text repeats a given and family name
without the title, it is replaced too.
Hashes are wide enough that no two entities of any real table share one; a check
over all distinct entities, family names and persons makes sure, and should two
do so all hashes are made longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconframe.operators.state import materialize

#: Patterns of each type, in the order in which they are tried.
EMAIL = r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
PHONE = r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7})(?!\d)"
MALE, FEMALE = r"(?:Mr|Herr|Señor|Sr|Monsieur|г-н)", r"(?:Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|г-жа)"
_WORD = r"\p{Lu}(?:\p{L}|['’\-](?=\p{L}))+"
#: Days and months, which no name ends in.
CALENDAR = (
    "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|May|June|July|August|September|October|November|December",
    "Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonnabend|Sonntag|Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember",
    "Lundi|Mardi|Mercredi|Jeudi|Vendredi|Samedi|Dimanche|Lunes|Martes|Miércoles|Jueves|Viernes|Sábado|Domingo",
)
NAME = rf"\b(?:{MALE}|{FEMALE})\.? {_WORD}(?: (?!(?:{'|'.join(CALENDAR)})(?!\p{{L}})){_WORD})?"
#: No name is found in a text without one of these.
TITLES = ("Mr", "Ms", "Miss", "Herr", "Frau", "Señor", "Sr", "Monsieur", "Madame", "Mme", "г-")
#: Country codes of one and of two digits; all others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"
ENTITY = "|".join((EMAIL, IPV4, PHONE, SSN, CARD, NAME))
#: Given names by script and gender, and syllables by script.
GIVEN = {
    ("latin", "male"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leo", "Marco", "Noel", "Oscar", "Paul", "Simon", "Victor"],
    ("latin", "female"): ["Alma", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Laura", "Maria", "Nora", "Olga", "Sara", "Vera"],
    ("cyrillic", "male"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Кирилл", "Лев", "Максим", "Олег", "Павел", "Роман", "Семён", "Тимур", "Фёдор", "Юрий"],
    ("cyrillic", "female"): ["Алла", "Белла", "Вера", "Галина", "Дарья", "Ева", "Жанна", "Зоя", "Инна", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "Софья", "Яна"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ha", "ki", "lo", "mu", "na", "pe", "ri", "so", "ta", "ve", "wi", "zu"],
    "cyrillic": ["ба", "ве", "ги", "до", "жа", "зе", "ки", "ло", "му", "на", "пе", "ри", "со", "ту", "фа", "хо"],
}
#: Hexadecimal digits of a keyed hash that a spelled surrogate carries at first, and those added when two entities share one.
WIDTH, WIDER = 16, 6
#: Hexadecimal digits of the second part of a given name.
GIVEN_WIDTH = 8
_ROUNDS = 6


def _keyed(key: str, *what: Column) -> Column:
    return F.sha2(F.concat(F.lit(key + "\x1f"), *what), 256)


def _number(digest: Column, modulus: Column) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("long")


def _rounds(key: str, kind: str, start: Column, a: Column, b: Column, back: bool) -> Column:
    """struct(l, r): the rounds of a keyed permutation of [0, a) x [0, b), or back."""
    sign = -1 if back else 1

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        mixed_l = F.pmod(acc["l"] + sign * _number(_keyed(key, F.lit(kind), i.cast("string"), F.lit("/"), acc["r"].cast("string")), a), a)
        mixed_r = F.pmod(acc["r"] + sign * _number(_keyed(key, F.lit(kind), i.cast("string"), F.lit("/"), acc["l"].cast("string")), b), b)
        return F.struct(F.when(odd, acc["l"]).otherwise(mixed_l).alias("l"), F.when(odd, mixed_r).otherwise(acc["r"]).alias("r"))

    order = range(_ROUNDS)
    return F.aggregate(F.array(*[F.lit(i) for i in (reversed(order) if back else order)]), start, step)


def _permuted(key: str, kind: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct(l, r): a keyed permutation of (left, right) in [0, a) x [0, b) that leaves none in place: forth, one on, and back."""
    forth = _rounds(key, kind, F.struct(left.alias("l"), right.alias("r")), a, b, False)
    carried = lambda p: F.struct(F.pmod(p["l"] + F.when(p["r"] == b - 1, 1).otherwise(0), a).alias("l"), F.pmod(p["r"] + 1, b).alias("r"))
    return _let(_let(forth, carried), lambda p: _rounds(key, kind, p, a, b, True))


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _digits_permuted(key: str, kind: str, digits: Column) -> Column:
    """The digits, 36 at most, under a keyed permutation of all strings of their number."""
    def half(d: Column, at: Column, n: Column) -> Column:
        return F.coalesce(F.substring(d, at, n).try_cast("long"), F.lit(0).cast("long"))

    def halves(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        return _let(
            _permuted(key, kind, half(d, F.lit(1), a), half(d, a + 1, n - a), _power(a), _power(n - a)),
            lambda p: F.concat(F.when(a > 0, F.lpad(p["l"].cast("string"), a, "0")).otherwise(""), F.lpad(p["r"].cast("string"), n - a, "0")),
        )

    return _let(digits, halves)


def _luhn(body: Column) -> Column:
    """The check digit that completes `body`."""
    place = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(place, F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0))), F.lit(10)), F.lit(10))


def _shaped(entity: Column, digits: Column) -> Column:
    """`entity` with its digits replaced in turn by those of `digits`."""
    return F.aggregate(
        F.split(entity, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda acc, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(acc["s"], F.substring(digits, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i"))),
        lambda acc: acc["s"],
    )


def _spelled(digest: Column, at: int, n: int, syllables: list[str]) -> Column:
    table = F.array(*[F.lit(s) for s in syllables])
    return F.array_join(F.transform(F.split(F.substring(digest, at, n), ""), lambda c: F.element_at(table, (F.conv(F.when(c == "", "0").otherwise(c), 16, 10).cast("int") + 1))), "")


def _mail(key: str, e: Column, width: int) -> Column:
    local, host = F.lower(F.substring_index(e, "@", 1)), F.lower(F.substring_index(e, "@", -1))
    return F.concat(_spelled(_keyed(key, F.lit("mail"), local, F.lit("@"), host), 1, width, SYLLABLES["latin"]), F.lit("@h"), F.substring(_keyed(key, F.lit("host"), host), 1, 8), F.lit(".example."), F.substring_index(host, ".", -1))


def _named(e: Column) -> tuple[Column, Column, Column, Column]:
    """(title, gender, given name or '', family name) of a name: one word after a title is a family name, of two the first is a given name."""
    rest = F.regexp_replace(e, rf"^({MALE}|{FEMALE})\.? ", "")
    return F.regexp_extract(e, rf"^({MALE}|{FEMALE})\.? ", 0), F.when(e.rlike(rf"^{MALE}\.? "), "male").otherwise("female"), F.when(rest.contains(" "), F.substring_index(rest, " ", 1)).otherwise(""), F.substring_index(rest, " ", -1)


def _by_script(word: Column, of) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def _family(key: str, family: Column, width: int) -> Column:
    """Of the family name alone, so full and short forms of a name agree."""
    digest = _keyed(key, F.lit("family"), F.lower(family))
    return _as_written(family, _by_script(family, lambda script: F.initcap(_spelled(digest, 1, width // 2, SYLLABLES[script]))))


def _as_written(word: Column, new: Column) -> Column:
    """`new`, in capitals if the word is."""
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(new)).otherwise(new)


def _given(key: str, gender: Column, given: Column, width: int) -> Column:
    """A given name of the gender with a second part, so that any number of names stays distinct."""
    digest = _keyed(key, F.lit("given"), gender, F.lit("/"), F.lower(given))
    pick = (F.conv(F.substring(digest, 60, 1), 16, 10).cast("int") + 1)

    def of(script: str) -> Column:
        first = {g: F.element_at(F.array(*[F.lit(x) for x in GIVEN[script, g]]), pick) for g in ("male", "female")}
        one = F.when(gender == "male", first["male"]).otherwise(first["female"])
        return F.concat(one, F.lit("-"), F.initcap(_spelled(digest, 1, GIVEN_WIDTH + width - WIDTH, SYLLABLES[script])))

    return _as_written(given, _by_script(given, of))


def alone(entities: Column) -> Column:
    """The words, in lower case, that stand alone after a title of this text."""
    single = F.filter(entities, lambda e: (kind_of(e) == "name") & (_named(e)[2] == ""))
    return F.array_distinct(F.transform(single, lambda e: F.lower(_named(e)[3])))


def _noun_follows(e: Column, families: Column) -> Column:
    """Whether the second word of a name is a noun: after a German title, the first being a family name of the text and the second none."""
    return e.rlike(r"^(?:Herr|Frau)\b") & (_named(e)[2] != "") & F.array_contains(families, F.lower(_named(e)[2])) & ~F.array_contains(families, F.lower(_named(e)[3]))


def _name(key: str, e: Column, width: int, families: Column | None = None) -> Column:
    title, gender, given, family = _named(e)
    whole = F.concat(title, F.when(given != "", F.concat(_given(key, gender, given, width), F.lit(" "))).otherwise(""), _family(key, family, width))
    return whole if families is None else F.when(_noun_follows(e, families), F.concat(title, _family(key, given, width), F.lit(" "), family)).otherwise(whole)


def _untitled(key: str, entities: Column, width: int, families: Column) -> Column:
    """Array of struct(pattern, by): each given and family name found after a title, and what stands for it where the title lacks."""
    full = F.filter(entities, lambda e: (kind_of(e) == "name") & (_named(e)[2] != "") & ~_noun_follows(e, families))

    def pair(e: Column) -> Column:
        _, gender, given, family = _named(e)
        return F.struct(F.concat(F.lit(r"(?<![\p{L}\-])"), given, F.lit(" "), family, F.lit(r"(?![\p{L}\-])")).alias("pattern"), F.concat(_given(key, gender, given, width), F.lit(" "), _family(key, family, width)).alias("by"))

    return F.array_distinct(F.transform(full, pair))


def kind_of(e: Column) -> Column:
    """Type of an entity that ENTITY has matched."""
    return (
        F.when(e.contains("@"), "mail").when(e.rlike(r"^\p{L}"), "name").when(e.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "host")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(e.rlike(r"^(?:\+|\(|\d{3}[.\-]\d{3}[.\-]\d{4}$)"), "phone").otherwise("card")
    )


def surrogate(e: Column, key: str, width: int = WIDTH, families: Column | None = None) -> Column:
    """The surrogate of an entity, of the same type and format; `families` are the words that stand alone after a title in its text (see `alone`)."""
    kind, digits = kind_of(e), F.regexp_replace(e, r"\D", "")
    octet = F.split(e, r"\.")
    pair = lambda i: octet[i].cast("long") * 256 + octet[i + 1].cast("long")
    host = _let(_permuted(key, "host", pair(0), pair(2), F.lit(65536), F.lit(65536)), lambda p: F.concat_ws(".", F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256))
    # A country code stays: the permutation begins after it, also where no separator does. No code begins another, so the numbers stay distinct.
    code = F.regexp_extract(e, COUNTRY, 0)
    phone = F.concat(code, _let(F.substring(e, F.length(code) + 1, F.length(e)), lambda x: _shaped(x, _digits_permuted(key, "phone", F.regexp_replace(x, r"\D", "")))))
    # Cards keep the distance of their last digit from the right check digit.
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    off = F.pmod(F.substring(digits, -1, 1).cast("int") - _luhn(body), F.lit(10))
    card = _let(_digits_permuted(key, "card", body), lambda new: _shaped(e, F.concat(new, F.pmod(_luhn(new) + off, F.lit(10)).cast("string"))))
    return (
        F.when(kind == "mail", _mail(key, e, width)).when(kind == "name", _name(key, e, width, families)).when(kind == "host", host)
        .when(kind == "ssn", _shaped(e, _digits_permuted(key, "ssn", digits))).when(kind == "phone", phone).otherwise(card)
    )


def _may_hold(text: Column) -> Column:
    """Cheap scans that every text with an entity passes."""
    found = text.contains("@") | text.rlike(r"\d[\d .()\-]{5}")
    for title in TITLES:
        found |= text.contains(title)
    return found


def entities_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def safe_width(docs: DataFrame, key: str, width: int = WIDTH) -> int:
    """The least width, from `width` on, at which no two distinct spelled entities of `docs` share a surrogate and none is another's original.

    The same holds, whatever the titles, for any two family names, and for any
    two persons of distinct gender, given and family name.
    """
    spelled = F.filter(entities_of(F.col("text")), lambda e: kind_of(e).isin("mail", "name"))
    found = docs.where(_may_hold(F.col("text"))).select(F.explode(spelled).alias("e")).select(F.lower("e").alias("same"), "e").groupBy("same").agg(F.min("e").alias("e"))
    found = materialize(found, "spelled")  # the texts are read once for all widths
    _, gender, given, family = _named(F.col("e"))
    names = found.where(kind_of(F.col("e")) == "name").select(gender.alias("gender"), given.alias("given"), family.alias("family"))
    # The first of two words may be the family name.
    families = names.select("family").union(names.where("given <> ''").select("given")).groupBy(F.lower("family").alias("same")).agg(F.min("family").alias("family"))
    persons = names.where("given <> ''").groupBy("gender", F.lower("given"), F.lower("family")).agg(F.min("given").alias("given"), F.min("family").alias("family"))
    while width < 58:
        made = found.select("same", F.lower(surrogate(F.col("e"), key, width)).alias("to"))
        seen = made.select(F.col("to").alias("v"), F.lit(1).alias("n")).union(made.select(F.col("same").alias("v"), F.lit(1000).alias("n")))
        # Parts are told from whole entities by a prefix that none has.
        seen = seen.union(families.select(F.concat(F.lit("\x1ff"), _family(key, F.col("family"), width)), F.lit(1)))
        seen = seen.union(persons.select(F.concat(F.lit("\x1fp"), "gender", F.lit(" "), _given(key, F.col("gender"), F.col("given"), width), F.lit(" "), _family(key, F.col("family"), width)), F.lit(1)))
        if seen.groupBy("v").agg(F.sum("n").alias("n")).where("n not in (1, 1000)").limit(1).count() == 0:
            return width
        width += WIDER
    raise RuntimeError("two entities share a surrogate at every width: take another key")


def replace_pii(df: DataFrame, key: str, column: str = "text", width: int | None = None) -> DataFrame:
    """`df` with surrogates in `column`, and n_entities, the number of entities replaced.

    A null text stays null with 0 entities; an empty one stays empty; whole
    texts are read, however long; repeated rows are treated alike; all other
    columns pass through (an n_entities of the input is replaced); an empty
    table gives an empty result. Repeats of a full name without a title are
    replaced but not counted; a family name alone without a title is no entity.
    """
    if width is None:
        width = safe_width(df.select(F.col(column).cast("string").alias("text")), key)
    text = F.col(column).cast("string")
    # Both arrays stem from one pattern: part i comes before entity i.
    parts = F.split(text, ENTITY, -1)
    families = alone(entities_of(text))
    again = _let(_untitled(key, entities_of(text), width, families), lambda names: F.transform(parts, lambda part: F.aggregate(names, part, lambda acc, n: F.regexp_replace(acc, n["pattern"], n["by"]))))
    parts = F.when(F.exists(entities_of(text), lambda e: e.rlike(r"^\p{L}[^@]* \S+ ")), again).otherwise(parts)
    new = _let(families, lambda own: F.array_join(F.zip_with(parts, entities_of(text), lambda part, e: F.concat(F.coalesce(part, F.lit("")), F.when(e.isNull(), "").otherwise(surrogate(e, key, width, own)))), ""))
    may = _may_hold(text)
    return df.withColumns({column: F.when(may, new).otherwise(text), "n_entities": F.when(may, F.size(entities_of(text))).otherwise(0)})
