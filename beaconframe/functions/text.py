"""Column functions on text: titles, ids, markup, arrays of names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A dash or bar and a media name of 20 letters at most at the end of a title.
MEDIA_SUFFIX = r"\s*[-|｜–—]\s*[^-|｜–—]{1,20}$"
#: HTML entities and what they stand for, in the order in which they are replaced.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&nbsp;", " "))
PAGE_ENTITIES = (("&nbsp;|&#160;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def collapse_space(c: Column) -> Column:
    """Runs of white space become one blank; none at either end. Null becomes empty."""
    return F.trim(F.regexp_replace(_text(c), r"[\s 　]+", " "))


def clean_title(c: Column) -> Column:
    """The title without its media suffix; the trimmed title where nothing would be left."""
    return F.coalesce(_blank_to_null(F.regexp_replace(_text(c), MEDIA_SUFFIX, "")), F.trim(_text(c)))


def title_key(c: Column) -> Column:
    """The title without its media suffix, only its CJK letters, Latin letters and digits, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(_text(c), MEDIA_SUFFIX, ""), r"[^一-鿿A-Za-z0-9]", ""))


def djb2_36(c: Column) -> Column:
    """h = 33 h + code from 5381, modulo 2^32, in base 36; codes are those of UTF-16, so letters beyond the BMP count as two."""
    code = lambda x: F.conv(F.hex(F.encode(x, "UTF-16BE")), 16, 10).cast("long")
    step = lambda h, n: (h * 33 + n).bitwiseAND(0xFFFFFFFF)
    both = lambda h, x: F.when(code(x) > 0xFFFF, step(step(h, F.shiftright(code(x), 16)), code(x).bitwiseAND(0xFFFF))).otherwise(step(h, code(x)))
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    return F.lower(F.conv(F.aggregate(letters, F.lit(5381).cast("long"), both).cast("string"), 10, 36))


def event_id(scope: Column, link: Column) -> Column:
    """The scope's prefix and the link's hash; null without a link."""
    return F.when(_text(link) != "", F.concat(F.when(scope == "domestic", "twnews-").otherwise("intl-"), djb2_36(link)))


def stable_id(prefix: str, c: Column) -> Column:
    """Prefix and the first 16 hexadecimal digits of SHA-1."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(_text(c).cast("binary")), 1, 16))


def fingerprint(dataset: Column, record: Column, own_id: Column, title: Column) -> Column:
    """Dataset, and the first of record reference, id and title that is not blank."""
    first = F.coalesce(*(_blank_to_null(x.cast("string")) for x in (record, own_id, title)), F.lit(""))
    return F.concat(F.coalesce(_blank_to_null(dataset.cast("string")), F.lit("")), F.lit(":"), first)


def _decode(c: Column, table) -> Column:
    for pattern, by in table:
        c = F.regexp_replace(c, f"(?i){pattern}" if table is PAGE_ENTITIES else pattern, by)
    return c


def strip_markup(c: Column) -> Column:
    """Text of a feed's field: CDATA opened, tags gone, entities decoded, tags that this brings to light gone too."""
    tags = lambda x: F.regexp_replace(x, "<[^>]+>", " ")
    return collapse_space(tags(_decode(tags(F.regexp_replace(_text(c), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), ENTITIES)))


def strip_page(c: Column) -> Column:
    """Text of a page: as a feed's field, but scripts and styles go with their content."""
    opened = F.regexp_replace(_text(c), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for tag in ("script", "style"):
        opened = F.regexp_replace(opened, rf"(?is)<{tag}.*?</{tag}>", " ")
    return collapse_space(_decode(F.regexp_replace(opened, "<[^>]+>", " "), PAGE_ENTITIES))


def strip_html(c: Column) -> Column:
    """Tags that begin with a letter go without a trace; white space is collapsed."""
    return collapse_space(F.regexp_replace(_text(c), r"</?[a-zA-Z][^>]*>", ""))


def compact(c: Column, most: int = 500, hard: bool = False) -> Column:
    """Collapsed text of `most` letters at most, the last an ellipsis if it was longer; `hard` only cuts."""
    text = collapse_space(c)
    return F.substring(text, 1, most) if hard else F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def truncate(c: Column, most: int) -> Column:
    """The first `most` letters and an ellipsis if there are more; white space stays."""
    text = _text(c)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


#: Letters that NFKC leaves as they are, next to each other too. Only texts with any other one go through Python.
SETTLED = r"\x00-\x7FÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-žА-яぁ-ゖァ-ヺ一-鿿、。「」—–“”‘’"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_for_match(c: Column) -> Column:
    """NFKC (Spark has no function for it: only texts that it may change leave the JVM), lower case, letters and digits only."""
    text = _text(c)
    return F.regexp_replace(F.lower(F.coalesce(_nfkc(F.when(text.rlike(f"[^{SETTLED}]"), text)), text)), r"[^\p{L}\p{N}]", "")


def clean_array(c: Column, least: int = 2, most: int = 14, cap: int = 5) -> Column:
    """Trimmed items of `least` to `most` letters, each once, the first `cap`; null if none is left."""
    some = F.slice(F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(_text(x))), lambda x: F.length(x).between(least, most))), 1, cap)
    return F.when(F.size(some) > 0, some)


def clean_relations(c: Column, most: int = 24, cap: int = 8) -> Column:
    """Relations (from, to, type) of three trimmed parts that are not empty and have `most` letters at most, each once, the first `cap`; null if none."""
    parts = ("from", "to", "type")
    good = lambda r: F.length(r["from"]).between(1, most) & F.length(r["to"]).between(1, most) & F.length(r["type"]).between(1, most)
    there = F.filter(c, lambda r: r.isNotNull())
    some = F.slice(F.array_distinct(F.filter(F.transform(there, lambda r: F.struct(*(F.trim(_text(r[p])).alias(p) for p in parts))), good)), 1, cap)
    return F.when(F.size(some) > 0, some)


def ground(items: Column, normal: Column, haystack: Column) -> Column:
    """P25: struct(value, kept, dropped): the items whose normal form the haystack holds. `normal` has the items' normal forms, `haystack` is in normal form too."""
    pairs = F.coalesce(F.arrays_zip(items.alias("item"), normal.alias("normal")), F.array().cast("array<struct<item:string,normal:string>>"))
    kept = F.filter(pairs, lambda p: (p["normal"] != "") & F.contains(haystack, p["normal"]))
    value = F.transform(kept, lambda p: p["item"])
    return F.struct(F.when(F.size(value) > 0, value).alias("value"), F.size(kept).alias("kept"), (F.size(pairs) - F.size(kept)).alias("dropped"))


def grounded_ratio(*grounded: Column) -> Column:
    """P25: kept items among all of several `ground` results; 1 where there was none."""
    kept, dropped = sum((g["kept"] for g in grounded[1:]), grounded[0]["kept"]), sum((g["dropped"] for g in grounded[1:]), grounded[0]["dropped"])
    return F.when(kept + dropped > 0, kept / (kept + dropped)).otherwise(F.lit(1.0))


def display_name(publisher: Column, aggregator: Column, name: Column) -> Column:
    """Publisher, else the aggregator marked as one, else the source's name."""
    return F.coalesce(_blank_to_null(publisher), F.concat(_blank_to_null(aggregator), F.lit(" 聚合")), name)


def compact_failure(c: Column) -> Column:
    """The class of an HTTP failure, or the first 72 letters of the message without tags."""
    text = F.trim(F.regexp_replace(F.regexp_replace(_text(c), "<[^>]*>", " "), r"\s+", " "))
    return (
        F.when(text.rlike(r"\b401\b"), "HTTP 401，需要重新授權").when(text.rlike(r"\b403\b"), "HTTP 403，被來源拒絕").when(text.rlike(r"\b404\b"), "HTTP 404，來源路徑失效")
        .when(text.rlike(r"\b5\d\d\b"), "HTTP 5xx，來源暫時異常").otherwise(F.substring(text, 1, 72))
    )


def query_needle(c: Column) -> Column:
    """The host in a query in lower case, without scheme and www; the query itself where the host has fewer than two letters."""
    low = F.lower(_text(c))
    host = F.split(F.regexp_replace(F.regexp_replace(low, "^https?://", ""), r"^www\.", ""), "[/?#]")[0]
    return F.when(F.length(host) >= 2, host).otherwise(low)


def extract_json(c: Column, schema: str) -> Column:
    """The array (from the first [ to the last ]) in a model's output, else the object, parsed by `schema`, an array's DDL; null if neither parses."""
    bare = F.trim(F.regexp_replace(_text(c), r"(?is)```(?:json)?\s*(.*?)```", "$1"))
    array, one = F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    element = schema.strip()[len("array<") : -1]
    return F.coalesce(F.when(array != "", F.from_json(array, schema)), F.when(one != "", F.array_compact(F.array(F.from_json(one, element)))))
