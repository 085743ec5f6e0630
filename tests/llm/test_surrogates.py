"""Surrogates against a version in plain Python, and names in texts where every noun is a capital word."""

import hashlib
import re

import regex

from beaconframe.llm import pii

KEY = "k"
ROWS = [
    "Wir trafen Herr Vogt Montag und Herr Vogt Dienstag.", "Herr Vogt Haus und Herr Vogt Garten; Frau Vogt.", "Frau Lena Vogt kam. Herr Vogt auch, und Lena Vogt ging.", "Mr SMITH met Mr Smith and Ms ANNA SMITH.",
    "г-н Иван Петров и г-жа Петрова", "Mail a.b@Example.COM or a.b@example.com, c@d-e.org.", "Call +14155550123, +1 (415) 555-0123, (415) 555-0199 or 415-555-0199.", "123-45-6789 and 4111 1111 1111 1111, 4111111111111111, 4222222222222",
    "Hosts 10.0.0.1 and 255.255.255.255 but 1.2.3.4.5", "", None, "no entity", "Mme Dupont-Aignan, Sr O’Neill.", "Mr Vogt " * 2000, "x" * 50_000 + " Frau Nora Weiß",
]


def _keyed(*what):
    return hashlib.sha256((KEY + "\x1f" + "".join(what)).encode()).hexdigest()


def _number(digest, modulus):
    return int(digest[:15], 16) % modulus


def _rounds(kind, left, right, a, b, back):
    sign = -1 if back else 1
    for i in range(5, -1, -1) if back else range(6):
        if i % 2:
            right = (right + sign * _number(_keyed(kind, str(i), "/", str(left)), b)) % b
        else:
            left = (left + sign * _number(_keyed(kind, str(i), "/", str(right)), a)) % a
    return left, right


def _permuted(kind, left, right, a, b):
    left, right = _rounds(kind, left, right, a, b, False)
    return _rounds(kind, (left + (right == b - 1)) % a, (right + 1) % b, a, b, True)


def _digits(kind, d):
    n = len(d)
    h = n // 2
    left, right = _permuted(kind, int(d[:h] or 0), int(d[h:] or 0), 10**h, 10 ** (n - h))
    return (str(left).zfill(h) if h else "") + str(right).zfill(n - h)


def _shaped(e, digits):
    it = iter(digits)
    return "".join(next(it, "") if c.isdigit() else c for c in e)


def _luhn(body):
    total = 0
    for i, c in enumerate(reversed(body)):
        x = int(c) * 2 if i % 2 == 0 else int(c)
        total += x - 9 if x > 9 else x
    return -total % 10


def _spell(digest, n, script):
    return "".join(pii.SYLLABLES[script][int(c, 16)] for c in digest[:n])


def _script(w):
    return "cyrillic" if regex.search(r"\p{IsCyrillic}", w) else "latin"


def _written(word, new):
    return new.upper() if len(word) > 1 and word == word.upper() else new


def _family(w):
    return _written(w, _spell(_keyed("family", w.lower()), pii.WIDTH // 2, _script(w)).capitalize())


def _given(gender, w):
    digest = _keyed("given", gender, "/", w.lower())
    return _written(w, pii.GIVEN[_script(w), gender][int(digest[59], 16)] + "-" + _spell(digest, pii.GIVEN_WIDTH, _script(w)).capitalize())


def _named(e):
    title = re.match(rf"(?:{pii.MALE}|{pii.FEMALE})\.? ", e)[0]
    rest = e[len(title) :].split(" ")
    return title, "male" if re.match(rf"{pii.MALE}\.? ", e) else "female", rest


def _noun(title, rest, families):
    return title[:4] in ("Herr", "Frau") and rest[0].lower() in families and rest[1].lower() not in families


def _surrogate(e, families):
    if "@" in e:
        local, host = e.lower().split("@")
        return _spell(_keyed("mail", local, "@", host), pii.WIDTH, "latin") + "@h" + _keyed("host", host)[:8] + ".example." + host.rsplit(".", 1)[-1]
    if e[0].isalpha():
        title, gender, rest = _named(e)
        if len(rest) == 1:
            return title + _family(rest[0])
        return title + (f"{_family(rest[0])} {rest[1]}" if _noun(title, rest, families) else f"{_given(gender, rest[0])} {_family(rest[1])}")
    digits = re.sub(r"\D", "", e)
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", e):
        o = list(map(int, e.split(".")))
        left, right = _permuted("host", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", e):
        return _shaped(e, _digits("ssn", digits))
    if re.match(r"\+|\(|\d{3}[.\-]\d{3}[.\-]\d{4}$", e):
        code = m[0] if (m := re.match(pii.COUNTRY, e)) else ""
        rest = e[len(code) :]
        return code + _shaped(rest, _digits("phone", re.sub(r"\D", "", rest)))
    off = (int(digits[-1]) - _luhn(digits[:-1])) % 10
    new = _digits("card", digits[:-1])
    return _shaped(e, new + str((_luhn(new) + off) % 10))


def _replaced(text):
    if text is None:
        return None, 0
    pattern = regex.compile(pii.ENTITY)
    found = [m[0] for m in pattern.finditer(text)]
    families = {r[0].lower() for e in found if "@" not in e and e[0].isalpha() for r in [_named(e)[2]] if len(r) == 1}
    out, at = [], 0
    again = {}
    for e in found:
        if "@" not in e and e[0].isalpha():
            title, gender, rest = _named(e)
            if len(rest) == 2 and not _noun(title, rest, families):
                again[" ".join(rest)] = f"{_given(gender, rest[0])} {_family(rest[1])}"
    for m in [*pattern.finditer(text), None]:
        part = text[at : m.start() if m else len(text)]
        for name, by in again.items():
            part = regex.sub(rf"(?<![\p{{L}}\-]){name}(?![\p{{L}}\-])", by, part)
        out.append(part)
        if m:
            out.append(_surrogate(m[0], families))
            at = m.end()
    return "".join(out), len(found)


def test_every_surrogate_equals_the_plain_version(spark):
    rows = [(i, t, 1.0, "z") for i, t in enumerate([*ROWS, ROWS[3], ROWS[3]])]
    got = pii.replace_pii(spark.createDataFrame(rows, "id int, text string, n_entities double, width string"), KEY).collect()
    assert {r["id"]: (r["text"], r["n_entities"]) for r in got} == {i: _replaced(t) for i, t, *_ in rows}


def test_nouns_after_a_title_stay_and_one_person_has_one_name(spark):
    found = pii.replace_pii(spark.createDataFrame([(t,) for t in ROWS[:4]], "text string"), KEY).collect()
    one, two, three, four = (r["text"] for r in found)
    vogt = _family("Vogt")
    assert one == f"Wir trafen Herr {vogt} Montag und Herr {vogt} Dienstag."
    assert two == f"Herr {vogt} Haus und Herr {vogt} Garten; Frau {vogt}."
    assert three.count(vogt) == 3 and "Lena" not in three
    smith = _family("Smith")
    assert four.count(smith) == 1 and four.count(smith.upper()) == 2 and "ANNA" not in four
