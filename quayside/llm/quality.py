"""Text quality statistics of documents, and their form by a learned rule list: prose, list, table or junk.

The statistics are plain: characters, words, lines, punctuation, separators and common words, as SQL expressions over
the whole text. Common words are those in most documents of the corpus, counted over all of it. What the statistics say
of a form is learnt only: an ordered rule list is induced by incremental reduced-error pruning on the labelled
documents, a bounded sample of at most ``MAX_LABELS`` of them (a parameter). For each form, rarest first, a rule is grown
by information gain on two thirds of the ratings until it covers none of another form, then conditions are deleted as
long as that makes it worth more on the rest, until the next rule would be wrong more often than right. The learned
thresholds become one CASE expression, evaluated natively on every document.

Null, empty and blank texts have null statistics and no form; repeated rows are judged one by one; an empty table
gives an empty one; without labels every text is prose. Extra columns are not read. Ratings count by their share of a
document's ratings, so that disagreeing raters weigh half each; null and unknown forms are no ratings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.session import cut_lineage

#: Most labelled documents, and the number of common words taken from the corpus.
MAX_LABELS, COMMON_WORDS = 20_000, 400
#: A word; in texts with scripts that are written without spaces, also one sign of these.
WORD, UNSPACED = "([\\p{L}\\p{M}\\p{N}]++)", "\\u0e00-\\u0e7f\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff"
SIGN_OR_WORD = f"([{UNSPACED}]|(?:(?![{UNSPACED}])[\\p{{L}}\\p{{M}}\\p{{N}}])++)"
#: What separates the cells of a row, and what a line without any lacks; what stands before an entry; how a sentence ends.
CELL = "[\\t|]\\s*+[\\p{L}\\p{N}]|[;,][\"\\p{L}\\p{N}]|[-=]{2,}+[|+]| {3,}+(?=\\S)|</t[dh]>"
CELLED = "[\\t|;,=<]|--|   "
MARKED = "^\\s*+(?:[^\\p{L}\\p{N}\\s<|]{1,2}|[(\\[]?+[\\p{N}]{1,3}[.):\\]]|[(\\[]?+\\p{L}[.):\\]]|\\p{N}{1,3}\\s?+x|<li[^>]*+>)\\s*+[\\p{L}\\p{N}(]"
SENTENCE_END = "[.!?。！？।۔؟…]"
#: Lines of up to so many letters are brief.
BRIEF = 40
#: A line with a smaller share of common words has few of them.
FEW_COMMON = 0.15
MARKUP = "<[^<>]*+>|\\{\\{[^{}]*+\\}\\}|&#?[A-Za-z0-9]++;|\\[object \\w++\\]|[\\u0080-\\u009f\\ufffd]|[ÃÂÐÑâ][\\u0080-\\u00bf€™œŸ]"


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, part.cast("double") / whole).otherwise(0.0), 4)


def present_text(text: Column) -> Column:
    """The text, null where it is blank."""
    return F.when(text.rlike("(?U)\\S"), text)


def words_of(lower: Column) -> Column:
    """The words of a lower-case text."""
    return F.when(lower.rlike(f"[{UNSPACED}]"), F.regexp_extract_all(lower, F.lit(SIGN_OR_WORD), F.lit(1))).otherwise(F.regexp_extract_all(lower, F.lit(WORD), F.lit(1)))


def lines_of(text: Column) -> Column:
    """The lines of a text that are not blank; rows, entries and breaks of its markup end lines too."""
    marked = F.when(text.contains("<"), F.regexp_replace(text, "(?i)<(?:br ?/?|/tr|/li|/p)>", "\n")).otherwise(text)
    return F.filter(F.split(F.translate(marked, "\r", "\n"), "\n"), lambda x: F.trim(x) != "")


def common_words(documents: DataFrame, most: int = COMMON_WORDS) -> list[str]:
    """The words in most documents of the corpus, at most ``most``; each document counts a word once."""
    words = documents.select(F.explode(F.array_distinct(words_of(F.lower("text")))).alias("word"))
    return [r["word"] for r in words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most).collect()]


#: The statistics that rules may use.
FEATURES = (
    "n_words", "mean_word_length", "letter_ratio", "digit_ratio", "symbol_ratio", "upper_ratio", "markup_ratio", "common_word_share", "distinct_word_share", "longest_run_ratio", "hard_word_share",
    "line_count", "mean_line_length", "punctuated_line_share", "repeated_line_share", "marked_share", "celled_share", "brief_share", "uncommon_share", "cell_ratio", "separator_ratio", "sentence_ratio",
)


def statistics(documents: DataFrame, common: list[str] | None = None) -> DataFrame:
    """doc_id and the statistics of every text; null for null, empty and blank texts.

    n_chars, n_words, mean_word_length; shares of characters that are letters, digits, symbols, capitals or markup;
    share of the distinct words that are common, of words that are distinct, of characters in the longest run without a
    space, of words with five consonants in a row; line_count, mean_line_length, shares of lines that end a
    sentence and that repeat another; shares of characters in lines that begin with a mark or number, that hold two
    cells' ends or more, that are brief and end no sentence, and that have few common words; ends of cells, signs between entries and ends of
    sentences for each word. ``common`` is taken from ``documents`` where it is not given.
    """
    common = common_words(documents) if common is None else common
    d = documents.select("doc_id", present_text(F.col("text")).alias("text"))
    stage = lambda df, *new: df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns], *new))))
    known = F.array(*[F.lit(w) for w in common]) if common else F.array().cast("array<string>")
    d = stage(d, F.lower("text").alias("lower"), lines_of(F.col("text")).alias("lines"))
    d = stage(d, words_of(F.col("lower")).alias("words"))
    d = stage(d, F.array_distinct("words").alias("distinct_words"))
    d = stage(d, F.array_intersect("distinct_words", known).alias("known"))
    common_share = lambda words: F.size(F.array_intersect(words, "known")) / F.greatest(F.size(words), F.lit(1))
    # the words of a line are read once more only where there are several lines
    usual = lambda x: F.when(F.size("lines") > 1, common_share(words_of(F.lower(x)))).otherwise(common_share(F.col("distinct_words")))
    read = F.transform("lines", lambda x: F.struct(
        F.length(x).alias("n"), usual(x).alias("usual"), F.when(x.rlike(CELLED), F.regexp_count(x, F.lit(CELL))).otherwise(0).alias("cells"), x.rlike(MARKED).alias("marked"), x.rlike(SENTENCE_END + "[\"'”»)\\s]*+$").alias("ended"),
    ))
    d = stage(d, read.alias("read"), F.length(F.array_join("words", "")).alias("worded"), F.length(F.regexp_replace("text", "\\p{N}++", "")).alias("undigited"))
    n, n_words, n_lines = F.length("text"), F.size("words"), F.size("lines")
    count = lambda pattern: F.regexp_count("lower", F.lit(pattern))
    total = lambda value: F.aggregate("read", F.lit(0), lambda a, x: a + value(x))
    line_chars = total(lambda x: x["n"])
    spaces = n - F.length(F.translate("text", " \t\n\r\u00a0\u3000", ""))
    stated = {
        "n_chars": n,
        "n_words": n_words,
        "mean_word_length": _share(F.col("worded"), n_words),
        "letter_ratio": _share(F.col("worded") - (n - F.col("undigited")), n),
        "digit_ratio": _share(n - F.col("undigited"), n),
        "symbol_ratio": _share(n - F.col("worded") - spaces, n),
        "upper_ratio": _share(n - F.length(F.regexp_replace("text", "[A-Z\\p{Lu}]++", "")), n),
        "markup_ratio": _share(F.when(F.col("text").rlike("[<&{\\[\\u0080-\\u009f\\ufffdÃÂÐÑâ]"), n - F.length(F.regexp_replace("text", MARKUP, ""))).otherwise(0), n),
        "common_word_share": _share(F.size("known"), F.size("distinct_words")),
        "distinct_word_share": _share(F.size("distinct_words"), n_words),
        "longest_run_ratio": _share(F.array_max(F.transform(F.split(F.translate("text", "\t\n\r", "   "), " "), F.length)), n),
        "hard_word_share": _share(count("[b-df-hj-np-tv-xz]{5,}+"), n_words),
        "line_count": n_lines,
        "mean_line_length": _share(line_chars, n_lines),
        "punctuated_line_share": _share(total(lambda x: x["ended"].cast("int")), n_lines),
        "repeated_line_share": _share(n_lines - F.size(F.array_distinct("lines")), n_lines),
        "marked_share": _share(total(lambda x: F.when(x["marked"], x["n"]).otherwise(0)), line_chars),
        "celled_share": _share(total(lambda x: F.when(x["cells"] >= 2, x["n"]).otherwise(0)), line_chars),
        "brief_share": _share(total(lambda x: F.when(~x["ended"] & (x["n"] <= BRIEF), x["n"]).otherwise(0)), line_chars),
        "uncommon_share": _share(total(lambda x: F.when(x["usual"] < FEW_COMMON, x["n"]).otherwise(0)), line_chars),
        "cell_ratio": _share(total(lambda x: x["cells"]), F.greatest(n_words, F.lit(1))),
        "separator_ratio": _share(count("(?: [·•/|→–—-]|[,;]) "), F.greatest(n_words, F.lit(1))),
        "sentence_ratio": _share(count(SENTENCE_END), F.greatest(n_words, F.lit(1))),
    }
    present = F.col("text").isNotNull()
    return d.select("doc_id", *[F.when(present, c).alias(name) for name, c in stated.items()])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, operator, threshold) and the form it gives."""

    form: str
    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, rows: np.ndarray) -> np.ndarray:
        """Which rows of the features' matrix the rule covers."""
        kept = np.ones(len(rows), dtype=bool)
        for f, op, t in self.conditions:
            column = rows[:, FEATURES.index(f)]
            kept &= column >= t if op == ">=" else column <= t
        return kept

    def sql(self) -> str:
        return " AND ".join(f"{f} {op} {t!r}D" for f, op, t in self.conditions)


def _best_condition(rows: np.ndarray, weight: np.ndarray, positive: np.ndarray) -> tuple[str, str, float] | None:
    """The condition with the largest information gain; of equal ones the first."""
    p0, n0 = weight[positive].sum(), weight[~positive].sum()
    before = np.log2(p0 / (p0 + n0))
    best: tuple[float, tuple[str, str, float] | None] = (1e-9, None)
    for k, f in enumerate(FEATURES):
        order = np.argsort(rows[:, k], kind="stable")
        values, w, pos = rows[order, k], weight[order], positive[order]
        edge = np.flatnonzero(values[1:] > values[:-1]) + 1  # a cut lies before each of these
        if not len(edge):
            continue
        p_below, n_below = np.cumsum(w * pos)[edge - 1], np.cumsum(w * ~pos)[edge - 1]
        cuts = np.round((values[edge] + values[edge - 1]) / 2, 4)
        for op, p, n in ((">=", p0 - p_below, n0 - n_below), ("<=", p_below, n_below)):
            gain = np.where(p > 1e-9, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - before), -1.0)
            top = int(np.argmax(gain))
            if gain[top] > best[0] + 1e-9:
                best = (float(gain[top]), (f, op, float(cuts[top])))
    return best[1]


def _grow(rows: np.ndarray, weight: np.ndarray, positive: np.ndarray) -> list[tuple[str, str, float]]:
    """Conditions added until the rule covers no other form, or none improves it."""
    conditions: list[tuple[str, str, float]] = []
    while (~positive).any() and positive.any():
        condition = _best_condition(rows, weight, positive)
        if condition is None or condition in conditions:
            break
        conditions.append(condition)
        kept = Rule("", (condition,)).covers(rows)
        rows, weight, positive = rows[kept], weight[kept], positive[kept]
    return conditions


def _worth(conditions: list, rows: np.ndarray, weight: np.ndarray, positive: np.ndarray) -> float:
    """(right - wrong) / covered on the pruning set, with one rating of each kind added."""
    kept = Rule("", tuple(conditions)).covers(rows)
    p, n = weight[kept & positive].sum(), weight[kept & ~positive].sum()
    return (p - n) / (p + n + 1.0)


def _prune(conditions: list, rows: np.ndarray, weight: np.ndarray, positive: np.ndarray) -> list:
    """Delete the condition whose absence is worth most, as long as the rule gets no worse."""
    while len(conditions) > 1:
        shorter = [conditions[:k] + conditions[k + 1 :] for k in range(len(conditions))]
        worths = [_worth(c, rows, weight, positive) for c in shorter]
        if max(worths) < _worth(conditions, rows, weight, positive):
            break
        conditions = shorter[int(np.argmax(worths))]
    return conditions


def induce_rules(rows: np.ndarray, forms: list[str], weight: np.ndarray, fold: np.ndarray) -> list[Rule]:
    """An ordered rule list from ratings: features, form, weight and fold of each; what no rule covers is prose."""
    forms_, rules = np.array(forms, dtype=object), []
    left = np.ones(len(rows), dtype=bool)
    present = sorted({f for f in forms if f != "prose"}, key=lambda f: (weight[forms_ == f].sum(), f))
    for form in present:
        turn, failed = 0, 0
        while (left & (forms_ == form)).any() and failed < 3:
            held = (fold + turn) % 3 == 0
            turn += 1
            grow, prune = np.flatnonzero(left & ~held), np.flatnonzero(left & held)
            positive = forms_ == form
            conditions = _grow(rows[grow], weight[grow], positive[grow]) if positive[grow].any() else []
            if not conditions:
                failed += 1
                continue
            conditions = _prune(conditions, rows[prune], weight[prune], positive[prune])
            covered = Rule(form, tuple(conditions)).covers(rows)
            right, wrong = weight[prune][(covered & positive)[prune]].sum(), weight[prune][(covered & ~positive)[prune]].sum()
            if right <= wrong:  # another division of the ratings may do better
                failed += 1
                continue
            failed = 0
            rules.append(Rule(form, tuple(conditions)))
            left &= ~covered
    return rules


def learn_form_rules(stats: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> list[Rule]:
    """Rules from the ratings of at most ``max_labels`` documents, the ones smallest by hash of their id."""
    rated = labels.where("form IN ('prose', 'list', 'table', 'junk')").groupBy("doc_id").agg(F.collect_list("form").alias("forms"))
    columns = [F.col(f).cast("double").alias(f) for f in FEATURES]
    sample = rated.join(stats.where("n_chars IS NOT NULL"), "doc_id").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("fold"), "forms", *columns)
    table = sample.orderBy("fold", "doc_id").limit(max_labels).toPandas()
    if table.empty:
        return []
    rows, forms, weight, fold = [], [], [], []
    for features, rated_as, place in zip(table[list(FEATURES)].to_numpy(dtype=float), table["forms"], range(len(table))):
        for form in sorted(set(rated_as)):
            rows.append(features)
            forms.append(form)
            weight.append(list(rated_as).count(form) / len(rated_as))
            fold.append(place)
    return induce_rules(np.array(rows), forms, np.array(weight), np.array(fold))


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with the column form by one CASE expression; null where the statistics are."""
    cases = "".join(f" WHEN {rule.sql()} THEN '{rule.form}'" for rule in rules)
    return stats.withColumn("form", F.expr(f"CASE WHEN n_chars IS NULL THEN NULL{cases} ELSE 'prose' END"))


def document_forms(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, the statistics and the form of every document; the statistics are computed once and written down."""
    stats = cut_lineage(statistics(documents))
    return apply_rules(stats, learn_form_rules(stats, labels, max_labels))
