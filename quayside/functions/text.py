"""Text folding that stays inside the JVM: look-alike characters, odd spaces, accents."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of other scripts that are drawn like a Latin letter, one string pair per script.
LOOKALIKES = {
    "Cyrillic": ("АВСЕНІЈКМОРЅТХҮУаорсеухіјѕһԁԛԝѵӏԌԚԜҺӀѴɡ", "ABCEHIJKMOPSTXYYaopceyxijshdqwvlGQWHIVg"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹορναικυϲϳχ", "ABEZHIKMNOPTYXCopvaikucjx"),
    "Armenian": ("ՕՍօսոցհ", "OUoungh"),
    "Latin": ("ɑɡıꓲ", "agiI"),
}
#: Dashes, quotes and spaces drawn like an ordinary one.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Characters that take no room.
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c"
    "\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
)


@lru_cache(maxsize=1)
def _compatibility_pairs() -> tuple[str, str]:
    """Characters whose compatibility form is one printable ASCII character, superscripts and spaces excepted."""
    source, target = [], []
    for code in range(0xA0, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0x3400 <= code <= 0xF8FF:
            continue
        ch = chr(code)
        kind = unicodedata.decomposition(ch)
        if not kind or kind.startswith(("<super>", "<sub>", "<fraction>", "<circle>", "<square>")):
            continue
        plain = unicodedata.normalize("NFKC", ch)
        if len(plain) == 1 and "!" <= plain <= "~" and plain != ch:
            source.append(ch)
            target.append(plain)
    return "".join(source), "".join(target)


@lru_cache(maxsize=1)
def fold_pairs() -> tuple[str, str]:
    """What is folded and into what, character by character; what has no counterpart is deleted."""
    source, target = _compatibility_pairs()
    for a, b in LOOKALIKES.values():
        n = min(len(a), len(b))
        source, target = source + a[:n], target + b[:n]
    source, target = source + DASHES + SPACES, target + "-" * len(DASHES) + " " * len(SPACES)
    return source + INVISIBLE, target


@lru_cache(maxsize=1)
def _accent_pairs() -> tuple[str, str]:
    """Latin letters with accents, lower and upper case, and their base letters."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch and base.isascii():
            source.append(ch)
            target.append(base)
    for a, b in (("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("Đ", "D"), ("ı", "i")):
        source.append(a)
        target.append(b)
    return "".join(source), "".join(target)


def fold_lookalikes(text: Column) -> Column:
    """Every look-alike, full-width form and odd space as its ASCII counterpart; zero-width characters removed."""
    source, target = fold_pairs()
    return F.when(F.octet_length(text) > F.length(text), F.translate(text, source, target)).otherwise(text)


def fold_accents(text: Column) -> Column:
    """Accented Latin letters as their base letters, combining marks removed."""
    source, target = _accent_pairs()
    return F.regexp_replace(F.translate(text, source, target), "[\\u0300-\\u036f]", "")


def squash(text: Column) -> Column:
    """Lower case, without accents, only letters and digits."""
    return F.regexp_replace(fold_accents(F.lower(text)), "[^\\p{L}\\p{N}\\p{M}]", "")


def collapse(text: Column) -> Column:
    """One ordinary space for every run of white space, trimmed."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def unleet(text: Column) -> Column:
    """Digits and signs that a bad scan puts in place of letters, as letters; for words that should hold none."""
    return F.translate(text, "01345@$", "oleasas")


def normalise_quote(text: Column) -> Column:
    """The form in which quotes and pages are compared: folded, collapsed, lower case."""
    return F.lower(collapse(F.translate(fold_lookalikes(text), "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f\u2032\u2033", "''''\"\"\"\"'\"")))
