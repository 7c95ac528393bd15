"""Descriptions of goods read into attributes, models and the words that remain.

A description becomes a row of lower-case words and numbers. Measures are read by patterns and brought to one unit;
attribute values that a lexicon of spellings knows and sales talk are found by one Aho-Corasick automaton, longest
match first. No kind of goods is known beforehand: names and brands stay among the remaining words, from which
they are mined (``phrases``). Rare words are repaired to frequent ones that are written almost alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.text import fold_accents, fold_lookalikes, unleet
from quayside.operators.edit_join import edit_distance_join
from quayside.session import cut_lineage

#: Spellings of one attribute value, by dimension and value; words separated by spaces.
PHRASES: dict[str, dict[str, str]] = {
    "leaf": {"opa": "opa", "bop": "bop", "fbop": "fbop", "pf1": "pf 1", "pd": "pd", "d1": "d 1|dust 1"},
    "grade": {g: f"grade {g}|gr {g}|{g} grade" for g in ("aa", "a", "b", "c", "d")},
    "packing": {
        "tin": "tin|metal tin", "net": "net bag|mesh bag", "paper": "paper sack|kraft sack|paper bag|kraft bag", "poly": "poly bag|pe bag", "vacuum": "vac bag|vacuum bag",
        "carton": "carton box|ctn box", "jute": "jute bag|gunny bag", "flexitank": "flexitank|flexi tank", "pet": "pet bottle", "jerry": "jerry can|jerrycan",
        "can": "metal can|tin can", "doypack": "doypack|pouch", "hdpe": "plastic bottle|hdpe bottle", "glass": "glass bottle",
    },
    "roast": {"raw": "raw", "roasted": "roasted|rstd", "salted": "salted|with salt"},
    "bold": {"bold": "bold", "extra": "extra bold|ex bold", "small": "small|sml"},
    "stone": {"pitted": "pitted|stoneless", "unpitted": "unpitted|with stone"},
    "cut": {"diced": "diced|cubed", "whole": "whole", "halves": "halves"},
    "sulphur": {"yes": "sulphured|so 2 treated", "no": "unsulphured|natural no so 2"},
    "oleic": {"classic": "classic", "high": "high oleic|ho", "mid": "mid oleic|mo"},
    "plug": {"g": "uk plug|type g plug", "c": "eu plug|type c plug", "a": "us plug|type a plug"},
    "ports": {"1": "single port|1 port", "2": "dual port|2 port", "3": "triple port|3 port", "4": "quad port|4 port"},
    "finish": {"gloss": "gloss|polished|glossy", "matt": "matt|matte", "satin": "satin"},
    "thread": {"full": "full thread|fully threaded", "half": "half thread|partially threaded"},
    "material": {"brass": "brass", "316": "stainless steel 316|inox 316|ss 316", "304": "stainless steel 304|inox 304|ss 304", "nylon": "nylon|polyamide", "black": "black oxide|blackened", "zinc": "zinc plated|galvanised|galvanized"},
    "border": {"jacquard": "jacquard", "dobby": "dobby border", "plain": "plain border|plain hem"},
    "socket": {"e27": "e 27", "e14": "e 14", "gu10": "gu 10", "b22": "b 22"},
    "mechanism": {"twist": "twist", "click": "click|retractable", "cap": "with cap|capped"},
    "use": {"food": "food safe", "irrigation": "irrigation", "drainage": "drainage"},
    "end": {"plain": "plain end", "threaded": "threaded end", "socket": "socket end|bell end"},
    "motor": {"brushless": "brushless", "brushed": "brushed|brushed motor"},
    "hammer": {"no": "no hammer|drill driver|driver", "yes": "hammer|hammer action"},
    "batteries": {"0": "tool only|bare tool", "1": "1 batt|with 1 battery|1 battery", "2": "2 batt|with 2 batteries|2 batteries", "3": "3 batt|with 3 batteries|3 batteries", "4": "4 batt|with 4 batteries|4 batteries"},
    "drawing": {"fdy": "fdy|fully drawn", "poy": "poy|partially oriented", "dty": "dty|draw textured"},
    "lustre": {"bright": "bright|brt", "semi": "semi dull|sd", "full": "full dull|fd"},
    "insulation": {"rubber": "rubber insulated|rubber sheath", "pvc": "pvc insulated|pvc sheath", "xlpe": "xlpe insulated|xlpe sheath"},
    "body": {"glass": "glass body", "metal": "metal body|steel body", "plastic": "plastic body|pp body"},
    "fabric": {"wool": "for wool|wool care", "colours": "for colours|colour care", "whites": "for whites|white care"},
    "scent": {"pine": "pine", "ocean": "ocean", "lavender": "lavender", "rose": "rose", "none": "unscented|fragrance free", "lemon": "lemon|citrus lemon"},
    "coating": {"pu": "pu dipped|pu coated", "latex": "latex dipped|latex coated", "nitrile": "nitrile dipped|nitrile coated", "leather": "cow leather|cowhide"},
    "fit": {"s": "size s|small", "m": "size m|medium", "l": "size l|large", "xl": "size xl|extra large"},
    "colour": {
        "white": "white|wht", "black": "black|blk|jet black", "navy": "navy|navy blue", "beige": "beige|sand beige", "ivory": "ivory|off white", "violet": "violet|purple", "grey": "grey|gray",
        "green": "green|grn", "yellow": "yellow|ylw", "red": "red", "brown": "brown", "orange": "orange", "blue": "blue", "pink": "pink",
    },
}
#: Praise and offers, which say nothing of the product.
SALES_TALK = (
    "customer favourite|hot sale|premium|100 genuine|no 1 in class|top seller|low moq|bulk offer|new arrival|oem welcome|best price|factory direct|ready to ship|as seen at the fair|export quality|"
    "iso certified plant|wholesale|special deal|trusted supplier|choice|fast dispatch|free samples|great value|limited stock|said to contain|s t c|stc"
)
#: Units of measures in descriptions: dimension and factor to its base unit.
MEASURES = {
    "kg": ("weight", 1000), "kgs": ("weight", 1000), "kilo": ("weight", 1000), "kilos": ("weight", 1000), "g": ("weight", 1), "gm": ("weight", 1), "gms": ("weight", 1), "gram": ("weight", 1), "grams": ("weight", 1),
    "ml": ("volume", 1), "cl": ("volume", 10), "l": ("volume", 1000), "ltr": ("volume", 1000), "litre": ("volume", 1000), "litres": ("volume", 1000), "liter": ("volume", 1000),
    "mm": ("length", 1), "cm": ("length", 10), "m": ("length", 1000), "metre": ("length", 1000), "metres": ("length", 1000), "mtr": ("length", 1000), "meter": ("length", 1000),
    "w": ("watt", 1), "watt": ("watt", 1), "watts": ("watt", 1), "kw": ("watt", 1000), "v": ("volt", 1), "volt": ("volt", 1), "volts": ("volt", 1),
    "k": ("kelvin", 1), "kelvin": ("kelvin", 1), "d": ("denier", 1), "den": ("denier", 1), "denier": ("denier", 1), "f": ("filaments", 1), "fil": ("filaments", 1), "filaments": ("filaments", 1),
    "c": ("cores", 1), "core": ("cores", 1), "cores": ("cores", 1), "gsm": ("gsm", 1),
}
N = r"(\d+(?:\.\d+)?)"
_UNITS = "|".join(sorted(MEASURES, key=len, reverse=True))
#: Patterns over the row of words, tried in this order at each place; each names its dimensions.
_PATTERNS = [
    ("material", r"(?:stainless steel|inox|ss) (\d{3})"),
    ("socket", r"e 27|e 14|gu 10|b 22"),
    ("leaf", r"pf 1|d 1|dust 1"),
    ("fit", r"size (?:s|m|l|xl)"),
    ("sulphur", r"natural no so 2|so 2 treated"),
    ("pack", rf"pack of {N} doz(?:en)?|{N} doz(?:en)? (?:per )?pack|pack of {N}|{N} (?:pcs|pieces|pc) (?:per )?pack|{N} pack|{N} ct"),
    ("bolt", rf"m {N} x {N}(?: mm)?|dia {N} mm l {N} mm|m {N} length {N} cm"),
    ("size", rf"{N} x {N} (cm|mm)|{N} (cm|mm) by {N} (?:cm|mm)"),
    ("gsm", rf"{N} g m 2"),
    ("area", rf"{N} (?:mm 2(?! (?:port|batt|battery|batteries|pcs|pieces|doz|dozen|ct|pack|core|c|x) )|sq mm|sqmm)"),
    ("tip", rf"{N} mm tip|{N} tip|fine {N}"),
    ("pressure", rf"pn {N}(?! (?:mm )?tip)|pressure class {N}"),
    ("kernel_size", rf"size w {N}|w {N}|count {N} lb"),
    ("season", rf"season {N}"),
    ("plated", rf"m {N}"),
    ("measure", rf"{N} ({_UNITS})"),
    ("model", r"(?:ref|model|art) ([a-z]{2,3}) (\d{3,4})"),
    ("series", r"([a-z]{2,3}) (\d{3,4})"),
]
_EACH = {name: re.compile(pattern) for name, pattern in _PATTERNS}
FILLERS = set("by brand of for with in and the size ref model per x a no new art l or".split())

#: A word in which single digits or signs stand for letters, as a bad scan leaves them.
MISREAD = "(?<![\\p{L}\\p{N}@$])(?=[\\p{L}0135@$]{4})\\p{L}+(?:([0135@$])\\1?\\p{L}+)+(?![\\p{L}\\p{N}@$])"
GLUED = "\\p{L}[0135@$]{1,2}\\p{L}"
WORD = "([0-9]+(?:[.,][0-9]+)?|\\p{L}+)"


def words_of(description: Column) -> Column:
    """Lower-case words and numbers, joined by spaces; look-alikes, accents and digits inside words as letters."""
    plain = F.octet_length(description) == F.length(description)
    text = F.replace(F.when(plain, F.lower(description)).otherwise(fold_accents(F.lower(fold_lookalikes(description)))), F.lit("'"), F.lit(""))
    repaired = F.array_join(F.transform(F.split(text, "(?<=\\s)|(?=\\s)"), lambda c: F.when(c.rlike(MISREAD), unleet(c)).otherwise(c)), "")
    return F.array_join(F.regexp_extract_all(F.when(text.rlike(GLUED) & text.rlike(MISREAD), repaired).otherwise(text), F.lit(WORD), F.lit(1)), " ")


#: A word is repaired to one that is so many times as frequent, and occurs so often at least.
MORE_FREQUENT, FREQUENT = 20, 10


def misspelt_words(words: DataFrame) -> DataFrame:
    """(word, right) of the rare words of ``words`` (column words, joined by spaces) that are written almost like a frequent one.

    The closest wins, then the more frequent, then the first by spelling. Two frequent words run together are taken
    apart. Only distinct words are compared, by the edit-distance join.
    """
    counted = words.select(F.explode(F.split("words", " ")).alias("word")).where("word RLIKE '^[^0-9]{3,}$'").groupBy("word").agg(F.count("*").alias("n"))
    counted = cut_lineage(counted)
    frequent = counted.where(F.col("n") >= FREQUENT).select(F.col("word").alias("right"), F.col("n").alias("m"))
    near = edit_distance_join(counted.where("length(word) > 3"), "word", frequent.where("length(right) > 3"), "right").where("distance BETWEEN 1 AND 2")
    near = near.join(counted, "word").join(frequent, "right").where(F.col("m") >= F.col("n") * MORE_FREQUENT)
    closest = near.groupBy("word").agg(F.min_by("right", F.struct("distance", -F.col("m"), "right")).alias("right"))
    cut = counted.where("length(word) >= 6").select("word", "n", F.explode(F.sequence(F.lit(3), F.length("word") - 3)).alias("at"))
    cut = cut.select("word", "n", F.expr("left(word, at)").alias("head"), F.expr("substring(word, at + 1)").alias("tail"))
    side = lambda name: frequent.select(F.col("right").alias(name), F.col("m").alias(f"m_{name}"))
    parts = cut.join(side("head"), "head").join(side("tail"), "tail").withColumn("m", F.least("m_head", "m_tail")).where(F.col("m") >= F.col("n") * MORE_FREQUENT)
    apart = parts.groupBy("word").agg(F.max_by(F.concat_ws(" ", "head", "tail"), F.struct("m", "head")).alias("right"))
    return cut_lineage(closest.unionByName(apart.join(closest, "word", "left_anti")))


#: So many repairs at most are given to the workers as one table; more are joined by shuffle.
SHARED_REPAIRS = 200_000


def repaired_words(lines: DataFrame, repairs: DataFrame, key: str = "line_id") -> DataFrame:
    """``lines`` with their ``words`` repaired by a join of the single words; ``key`` is unique."""
    each = lines.select(key, F.posexplode(F.split("words", " ")).alias("pos", "word")).join(repairs, "word", "left")
    fixed = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("right", "word").alias("word")))).alias("w"))
    return lines.drop("words").join(fixed.select(key, F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("words")), key, "left")


def _number(text: str) -> str:
    """A number in its shortest form: 0.50 is 0.5, 25.0 is 25."""
    value = float(text.replace(",", "."))
    return f"{value:.4f}".rstrip("0").rstrip(".")


@dataclass
class Reading:
    """What a description says: models, attributes by dimension, remaining words."""

    models: list[str] = field(default_factory=list)
    attributes: dict[str, set] = field(default_factory=dict)
    rest: list[str] = field(default_factory=list)


class Reader:
    """Reads rows of words with a lexicon of attribute values: dimension, value, spellings separated by bars."""

    def __init__(self, lexicon: dict[str, dict[str, str]] = PHRASES, series: frozenset[str] = frozenset(), talk: str = SALES_TALK) -> None:
        entries: dict[str, list[tuple[str, str]]] = {}
        for dimension, values in lexicon.items():
            for value, phrases in values.items():
                for phrase in phrases.split("|"):
                    entries.setdefault(phrase, []).append((dimension, value))
        #: values that share a spelling (small is one of two dimensions) cannot be told apart: the first stands for both
        self.same: dict[tuple[str, str], tuple[str, str]] = {}
        for meanings in entries.values():
            for other in meanings:
                self.same[other] = min(self.same.get(m, m) for m in meanings)
        for phrase in talk.split("|"):
            entries.setdefault(phrase, []).append(("talk", phrase))
        self.automaton = automaton_of(entries)
        letters = "|".join(sorted(series)) or "(?!)"
        patterns = [(name, rf"({letters}) (\d{{3,4}})" if name == "series" else pattern) for name, pattern in _PATTERNS]
        self.scan = re.compile(r"(?<= )(?:" + "|".join(f"(?P<{name}>{pattern})" for name, pattern in patterns) + r")(?= )")

    def read(self, words: list[str]) -> Reading:
        reading = Reading()
        if not len(words):
            return reading
        row = " " + " ".join(w.replace(",", ".") for w in words) + " "
        found = reading.attributes

        def put(dimension: str, value: str) -> None:
            dimension, value = self.same.get((dimension, value), (dimension, value))
            found.setdefault(dimension, set()).add(value)

        def take(m: re.Match) -> str:
            kind = m.lastgroup
            groups = [g for g in _EACH[kind].fullmatch(m.group()).groups() if g is not None]
            if kind == "pack":
                many = float(groups[0]) * (12 if " doz" in m.group() else 1)
                put("pack", _number(str(many)))
            elif kind == "bolt":
                put("diameter", _number(groups[0]))
                put("shank", _number(str(float(groups[1]) * (10 if m.group().endswith("cm") else 1))))
            elif kind == "size":
                unit = next(g for g in groups if g in ("cm", "mm"))
                sides = sorted(float(g) * (10 if unit == "cm" else 1) for g in groups if g not in ("cm", "mm"))
                put("size", "x".join(_number(str(s)) for s in sides))
            elif kind == "measure":
                dimension, factor = MEASURES[groups[1]]
                put(dimension, _number(str(float(groups[0]) * factor)))
            elif kind in ("model", "series"):
                reading.models.append(groups[0] + groups[1])
            elif kind == "material":
                put(kind, groups[0])
            elif kind == "fit":
                put(kind, m.group().split()[1])
            elif kind == "sulphur":
                put(kind, "no" if "no" in m.group() else "yes")
            elif kind in ("socket", "leaf"):
                put(kind, m.group().replace("dust", "d").replace(" ", ""))
            elif kind == "plated":
                put("diameter", _number(groups[0]))
            elif kind != "season":
                put(kind, _number(groups[0]))
            return "|"

        row = self.scan.sub(take, row)
        # phrases made of a number and a word (1 port, ss 304, d 1) are still there
        rest, at = [], 0
        for start, end, meanings in longest_matches(self.automaton, row):
            rest.append(row[at : start + 1])
            at = end
            for dimension, value in meanings:
                if dimension != "talk":
                    put(dimension, value)
        rest.append(row[at:])
        if "diameter" in found and "length" in found and "shank" not in found:  # M12, length 4 cm
            found["shank"] = found.pop("length")
        reading.rest = [w for w in "".join(rest).replace("|", " ").split() if w not in FILLERS]
        return reading


def automaton_of(entries: dict[str, object]) -> ahocorasick.Automaton:
    """An automaton over phrases, each between two spaces; a match gives (length, meaning)."""
    automaton = ahocorasick.Automaton()
    for phrase, meaning in entries.items():
        automaton.add_word(f" {phrase} ", (len(phrase) + 2, meaning))
    automaton.make_automaton()
    return automaton


def longest_matches(automaton: ahocorasick.Automaton, row: str) -> list[tuple[int, int, object]]:
    """Longest matches from left to right that do not overlap but for the space between two."""
    by_start: dict[int, tuple[int, object]] = {}
    if not len(automaton):
        return []
    for end, (length, meaning) in automaton.iter(row):
        start = end - length + 1
        if start not in by_start or by_start[start][0] < end:
            by_start[start] = (end, meaning)
    out, free = [], 0
    for start in sorted(by_start):
        if start >= free:
            end, meaning = by_start[start]
            out.append((start, end, meaning))
            free = end  # the closing space opens the next phrase
    return out


#: What stands between marks that are joined to one text.
MARK = "\u0002"
READ_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("models", "marks", "rest")])
#: Letters are those of a series of models if so many listings announce a model with them.
SERIES_LISTINGS = 3


def model_series(worded: DataFrame) -> list[str]:
    """The letters that models begin with, from the listings (column words) that announce one; two or three letters each."""
    letters = worded.select(F.explode(F.regexp_extract_all("words", F.lit("(?:^| )(?:ref|model|art) ([a-z]{2,3}) [0-9]{3,4}(?= |$)"), F.lit(1))).alias("letters"))
    several = letters.groupBy("letters").agg(F.count("*").alias("n")).where(F.col("n") >= SERIES_LISTINGS)
    return sorted(r["letters"] for r in several.collect())  # 18,252 at most


def read_column(lines: DataFrame, words: Column, series: list[str], repairs: dict[str, str], lexicon: dict[str, dict[str, str]] | None = None) -> Column:
    """A row of words, repaired by ``repairs``, as struct(models, marks, rest).

    Models and the rest are joined by spaces, marks (``dimension=value``, in order) by MARK; rest keeps its order.
    """
    shared: Broadcast = lines.sparkSession.sparkContext.broadcast((PHRASES if lexicon is None else lexicon, frozenset(series), repairs))

    @F.pandas_udf(READ_SCHEMA)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexicon, series, repairs = shared.value
        reader = Reader(lexicon, series)
        for batch in batches:
            rows = []
            for row in batch:
                r = reader.read([repairs.get(w, w) for w in row.split()] if row else [])
                rows.append((" ".join(r.models), MARK.join(f"{d}={'|'.join(sorted(r.attributes[d]))}" for d in sorted(r.attributes)), " ".join(r.rest)))
            yield pd.DataFrame(rows, columns=["models", "marks", "rest"])

    # not deterministic for the optimizer: it would run the function once more for each filter on its result
    return read.asNondeterministic()(words)
