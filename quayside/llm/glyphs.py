"""One consistent form for texts that look alike: scripts resolved per token, look-alikes, hidden and odd characters.

Every letter of a token stands for the set of scripts in which a letter of that look exists; the sets are
intersected over the token. Letters of several scripts in one token make it mixed, a token of one foreign script
whose letters all have a Latin twin is a whole-script look-alike, unless a neighbouring word is really of that
script. The token is then spelt in a script of the intersection, Latin first; the remaining forms (full width,
ligatures, mathematical letters, loose accents, odd spaces and dashes, characters without width) are normalised.

Null quotes stay null and are no cases, empty ones stay empty; texts of any length are read whole; repeated rows
and clashing extra columns do not matter, as only the named columns are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.text import DASHES, INVISIBLE, LOOKALIKES, SPACES

#: Signs with a look of their own, which stay as they are.
SIGNS = set("²³¹½¼¾™№®©°±★☆…ªº℠℃℉‰€£¥µ×÷·•→←↑↓§¶†‡¢")
#: Scripts whose words may hold joiners, by the rules of their spelling.
JOINING = regex.compile(r"[\p{Script=Arabic}\p{Script=Devanagari}\p{Script=Bengali}\p{Script=Sinhala}\p{Script=Tamil}\p{Script=Telugu}\p{Script=Kannada}\p{Script=Malayalam}\p{Script=Gujarati}\p{Script=Gurmukhi}\p{Script=Khmer}\p{Script=Myanmar}]")
WIDE = regex.compile(r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Hangul}]")
SCRIPT_NAMES = ("Latin", "Greek", "Cyrillic", "Armenian", "Han", "Arabic", "Hebrew", "Devanagari", "Bengali", "Thai", "Hangul", "Hiragana", "Katakana", "Cherokee", "Georgian", "Tamil", "Telugu", "Sinhala", "Khmer", "Myanmar", "Ethiopic", "Lisu", "Coptic")
_SCRIPTS = [(name, regex.compile(rf"\p{{Script={name}}}")) for name in SCRIPT_NAMES]
TOKEN = regex.compile(r"[\p{L}\p{M}‌‍]+")
_INVISIBLE, _SPACES, _DASHES = set(INVISIBLE), set(SPACES), set(DASHES) - set("–—―")


@lru_cache(maxsize=8192)
def script_of(ch: str) -> str:
    return next((name for name, pattern in _SCRIPTS if pattern.match(ch)), "Common")


#: Capitals of two scripts that are drawn like Latin ones, and letters that are like a Latin one in some hands or
#: fonts only, which count where the rest of a token is Latin.
CAPITALS = {
    "Cherokee": ("ᎪᏴᏟᎠᎬᏀᎻᏆᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHIJKLMPRSTVWZ"),
    "Lisu": ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
}
SIMILAR = dict(zip("гтпмвнкитыуω" + "ρτγηεσ", "rtnmbhkutbyw" + "ptynes"))
#: Signs drawn like an ordinary one.
SIGN_TWINS = dict(zip("\u2215\u2216\u2236\u02bc\u02b9\ua789\u2024", "/\\:'':."))


def _twins() -> tuple[dict[str, str], dict[tuple[str, str], str]]:
    """Foreign letter -> Latin twin, and (script, Latin letter) -> its twin there."""
    to_latin: dict[str, str] = {"ρ": "p", "Ү": "Y"}
    to_script: dict[tuple[str, str], str] = {}
    for name, (letters, plain) in (LOOKALIKES | CAPITALS).items():
        for a, b in zip(letters, plain):
            to_latin.setdefault(a, b)
            if name != "Latin":
                to_script.setdefault((script_of(a), b), a)
    # small capitals have their letter in their name
    for code in [*range(0x1D00, 0x1D30), 0x0262, 0x026A, 0x0274, 0x0280, 0x028F, 0x0299, 0x029C, 0x029F, 0xA730, 0xA731]:
        name = unicodedata.name(chr(code), "")
        if name.startswith("LATIN LETTER SMALL CAPITAL ") and len(name.rsplit(" ", 1)[1]) == 1 and "REVERSED" not in name and "TURNED" not in name:
            to_latin.setdefault(chr(code), name[-1].lower())
    return to_latin, to_script


TO_LATIN, TO_SCRIPT = _twins()


def compatible(ch: str) -> str | None:
    """The ordinary form of a full-width, mathematical or ligature character, None where it has none."""
    if ch in SIGNS or ch.isascii():
        return None
    kind = unicodedata.decomposition(ch)
    if not kind or (kind.startswith("<") and kind.split(">")[0] in ("<super", "<sub", "<fraction", "<circle", "<square")):
        return None
    plain = unicodedata.normalize("NFKC", ch)
    return plain if plain != ch and plain.isascii() and plain.strip() else None


def scripts(token: str) -> set[str]:
    return {s for s in map(script_of, token) if s != "Common"}


def resolved(token: str) -> set[str]:
    """The scripts in which the whole token can be spelt with letters of this look."""
    sets = []
    for ch in token:
        own = script_of(ch)
        if own == "Common" or unicodedata.category(ch)[0] == "M":
            continue
        plain = ch if own == "Latin" and ch.isascii() else TO_LATIN.get(ch)
        sets.append({own} | ({"Latin"} | {s for (s, p) in TO_SCRIPT if p == plain} if plain else set()))
    return set.intersection(*sets) if sets else set()


@lru_cache(maxsize=65536)
def judge_token(token: str) -> tuple[str, str]:
    """(kind, spelling): plain, latin_twin, mixed, whole or foreign."""
    odd = any(ch in TO_LATIN and script_of(ch) == "Latin" for ch in token)
    used = scripts(token)
    if used <= {"Latin"}:
        return ("latin_twin", "".join(TO_LATIN.get(c, c) for c in token)) if odd else ("plain", token)
    if len(used) == 1:
        only = next(iter(used))
        return ("whole", "".join(TO_LATIN.get(c, c) for c in token)) if only in ("Greek", "Cyrillic", "Armenian") and "Latin" in resolved(token) else ("foreign", token)
    cjk = {"Han", "Hiragana", "Katakana"}
    if used <= cjk:
        return "foreign", token
    # the script that most letters have which only it has; letters that are alike in two scripts do not vote
    choices = resolved(token)
    foreign = [c for c in token if script_of(c) not in ("Latin", "Common")]
    latin = sum(script_of(c) == "Latin" for c in token)
    readable = all(c in TO_LATIN or c in SIMILAR for c in foreign)
    if "Latin" in choices or (readable and latin >= sum(c not in TO_LATIN for c in foreign)):
        return "mixed", "".join(TO_LATIN.get(c, SIMILAR.get(c, c)) for c in token)
    own = {s: sum(script_of(c) == s and c not in TO_LATIN for c in token) for s in sorted(choices or used)}
    target = max(own, key=lambda s: own[s])
    if target == "Latin":
        return "mixed", "".join(TO_LATIN.get(c, SIMILAR.get(c, c)) for c in token)
    spell = lambda c: c if script_of(c) in (target, "Common") else TO_SCRIPT.get((target, TO_LATIN.get(c, c)), c)
    return "mixed", "".join(map(spell, token))


def normalise(text: str) -> tuple[str, list[str]]:
    """The consistent form of a text and the kinds of disguise found in it."""
    if text.isascii():
        return text, []
    kinds: set[str] = set()
    out: list[str] = []
    for i, ch in enumerate(text):
        if ch.isascii():
            out.append(ch)
        elif ch in _INVISIBLE:
            joins = ch in "‌‍" and i and i + 1 < len(text) and JOINING.match(text[i - 1]) and JOINING.match(text[i + 1])
            if joins:
                out.append(ch)
            else:
                kinds.add("invisible")
                continue
        elif ch in _SPACES:
            wide = ch == "　" and (i == 0 or WIDE.match(text[i - 1])) and (i + 1 == len(text) or WIDE.match(text[i + 1]))
            if not wide:
                kinds.add("space")
            out.append(" ")
        elif ch in SIGN_TWINS:
            kinds.add("sign")
            out.append(SIGN_TWINS[ch])
        elif ch in _DASHES:
            kinds.add("dash")
            out.append("-")
        elif (plain := compatible(ch)) is not None:
            kinds.add("form")
            out.append(plain)
        else:
            out.append(ch)
    flat = "".join(out)
    composed = unicodedata.normalize("NFC", flat)
    if composed != flat:
        kinds.add("accent")
    tokens = list(TOKEN.finditer(composed))
    judged = [judge_token(m.group()) if not m.group().isascii() else ("plain", m.group()) for m in tokens]
    parts: list[str] = []
    end = 0
    for k, (m, (kind, spelling)) in enumerate(zip(tokens, judged)):
        if kind == "whole":
            script = next(iter(scripts(m.group())))
            near = [x for x in (k - 1, k + 1) if 0 <= x < len(tokens) and judged[x][0] == "foreign" and script in scripts(tokens[x].group())]
            if any(abs(tokens[x].start() - m.end()) <= 2 or abs(m.start() - tokens[x].end()) <= 2 for x in near):
                kind, spelling = "foreign", m.group()
        if kind in ("latin_twin", "mixed", "whole"):
            kinds.add(kind)
        parts += [composed[end : m.start()], spelling]
        end = m.end()
    parts.append(composed[end:])
    return "".join(parts), sorted(kinds)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))]))
def _normalise(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        pairs = [normalise(t) if t is not None else (None, []) for t in batch]
        yield pd.DataFrame({"text": [p[0] for p in pairs], "kinds": [p[1] for p in pairs]}, index=batch.index)


def normalise_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text in its consistent form, kinds of disguise) of every row; pure ASCII never leaves the JVM."""
    narrow = df.select(F.col(key), F.col(text).alias("text"))
    other = F.when(F.col("text").rlike("[^\\x00-\\x7f]"), F.col("text"))
    read = narrow.select(key, "text", _normalise.asNondeterministic()(other).alias("n"))
    return read.select(key, F.coalesce("n.text", "text").alias("text"), "n.kinds")


def disguised(df: DataFrame, key: str, text: str) -> DataFrame:
    """The keys of the rows whose text holds a character that looks like, or hides beside, the ordinary one."""
    narrow = df.select(F.col(key), F.col(text).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]"))
    return narrow.select(key, _normalise("text").alias("n")).where(F.size("n.kinds") > 0).select(key)


def script_consistent(text: Column) -> Column:
    """The consistent form as a column; null where null."""
    return F.when(text.isNotNull(), _normalise(F.coalesce(text, F.lit("")))["text"])
