"""Tags and names of a text by one scan for many words.

Patterns are taken apart into the words that every match of theirs holds. All
words of all patterns make one expression, a tree of their letters that is
entered by ranges of first letters, so a text is walked through once and a
place at which no word begins costs a few comparisons. What the scan has met
gives the tags of plain words at once; any other pattern is tried on a text
only if one of its words is there.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconframe.functions import vocabulary as V
from beaconframe.functions.rules import is_specific

_META = set(r".^$*+?{}[]\()|")
#: Branches of the tree that are tried one after the other; more are halved by their first letters.
_FEW = 4


def _alternatives(pattern: str) -> list[str]:
    """The pattern's parts between bars outside of groups and classes."""
    out, depth, at, inside = [""], 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out[-1] += pattern[at : at + 2]
            at += 2
            continue
        inside = c == "[" or (inside and c != "]")
        depth += (c == "(") - (c == ")") if not inside else 0
        if c == "|" and not depth and not inside:
            out.append("")
        else:
            out[-1] += c
        at += 1
    return out


def anchors(pattern: str) -> list[str] | None:
    """Words one of which every match of the pattern holds; None if they can't be told."""
    found = []
    for part in _alternatives(pattern):
        if not _META & set(part):
            found.append(part)
            continue
        group = re.fullmatch(r"(?:\[[^\]]*\](?:\{\d+,?\d*\}|\+)?)+(?:\(\?:([^()]*)\)|(.*))", part)
        words = _alternatives(group[1] or group[2]) if group else []
        if not words or any(not w or _META & set(w) for w in words):
            # A part without groups and classes: its longest stretch of plain letters, less one before a quantifier.
            plain = [] if set("()[]|\\") & set(part) else re.findall(r"[^.^$*+?{}]+(?![*+?{])", re.sub(r"\{[^}]*\}", "{}", part))
            words = [max(plain, key=len)] if plain else []
        if not words or any(not w for w in words):
            return None
        found += words
    return found if all(found) else None


def _tree(words: Iterable[str]) -> str:
    """An expression that matches the longest of the words that begin at a place."""
    tails: dict[str, set[str]] = {}
    for w in words:
        if w:
            tails.setdefault(w[0], set()).add(w[1:])

    def one(first: str) -> str:
        rest = tails[first]
        more = _tree(rest)
        return re.escape(first) + (f"(?:{more})" + "?" * ("" in rest) if more else "")

    def among(letters: list[str]) -> str:
        if len(letters) <= _FEW:
            return "|".join(map(one, letters))
        half = len(letters) // 2
        sides = (letters[:half], letters[half:])
        return "|".join(f"(?=[{re.escape(s[0])}-{re.escape(s[-1])}])(?:{among(s)})" for s in sides)

    return among(sorted(tails))


class Scanner:
    """One expression for the words of many patterns, and what its hits say of each pattern."""

    def __init__(self, patterns: Iterable[str]):
        self.words = {p: anchors(p) for p in dict.fromkeys(patterns)}
        self.every = sorted({w for ws in self.words.values() for w in ws or ()})
        self.pattern = f"(?=({_tree(self.every)}))" if self.every else None

    def hits(self, text: Column) -> Column:
        """The words that the text holds, the longest at each place, each once: the one scan."""
        if self.pattern is None:
            return F.array().cast("array<string>")
        return F.array_distinct(F.regexp_extract_all(text, F.lit(self.pattern), F.lit(1)))

    def _met(self, hits: Column, words: list[str]) -> Column:
        """Whether a hit begins with one of the words."""
        longer = [w for w in self.every if any(w.startswith(x) for x in words)]
        return F.arrays_overlap(hits, F.array(*map(F.lit, longer)))

    def may(self, hits: Column, pattern: str) -> Column:
        """False only where the pattern has no match."""
        words = self.words[pattern]
        return F.lit(True) if words is None else self._met(hits, words)

    def holds(self, hits: Column, text: Column, pattern: str) -> Column:
        """Whether the text has a match of the pattern."""
        parts = _alternatives(pattern)
        plain = [p for p in parts if not _META & set(p)]
        if self.words[pattern] is None or not plain:
            return self.may(hits, pattern) & text.rlike(pattern)
        odd = "|".join(p for p in parts if _META & set(p))
        met = self._met(hits, plain)
        return met | (self.may(hits, pattern) & text.rlike(odd)) if odd else met


def text_signals(
    text: Column, hits: Column, scanner: Scanner, supplied: Column | None = None, lexicon: tuple[tuple[str, str], ...] = V.LEXICON, patterns: tuple[str, ...] = V.ENTITY_PATTERNS, lead: str = V.LEAD_PARTICLES
) -> tuple[Column, Column]:
    """(tags in the lexicon's order, specific names each once) of a text of which `hits` are the scanner's hits.

    Names come by pattern, without leading particles (two letters stay), then supplied ones.
    """
    tags = F.array_distinct(F.array_compact(F.array(*(F.when(scanner.holds(hits, text, p), tag) for p, tag in lexicon))))
    none = F.array().cast("array<string>")
    found = F.flatten(F.array(*(F.when(scanner.may(hits, p), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for p in patterns)))
    if lead:
        found = F.transform(found, lambda e: F.regexp_replace(e, f"^[{lead}]+(?=.{{2}})", ""))
    if supplied is not None:
        found = F.concat(found, F.transform(F.coalesce(supplied, none), lambda e: F.trim(F.coalesce(e, F.lit("")))))
    return tags, F.array_distinct(F.filter(found, lambda e: is_specific(e)))
