"""Edit-distance join: equi-join on character bigrams and sorted letters, then an exact check of the distance.

No pair within the allowed distance is lost. An edit destroys at most two of a word's bigrams and an exchange of two letters
at most four, of one more than it has letters (words are padded at both ends). So pairs share a bigram unless
most of the allowed distance are exchanges: two of two or three of three, which leave the sorted letters equal, or two and one
edit in words of eight or nine letters, which leave them equal but for one letter. These are keys as well. No cross join
is made. Both sides are meant to hold distinct words, whose number grows slowly with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bigrams(word: Column) -> Column:
    """The distinct bigrams of a word, with one mark before and after."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))


def allowed_distance(length: Column) -> Column:
    """0 up to three letters, 1 up to five, 2 up to seven, 3 beyond."""
    return F.when(length <= 3, 0).when(length <= 5, 1).when(length <= 7, 2).otherwise(3)


def letters(word: Column) -> Column:
    """The letters of a word in order."""
    return F.array_join(F.array_sort(F.split(word, "")), "")


def edit_distance(a: Column, b: Column, letters_a: Column | None = None, letters_b: Column | None = None) -> Column:
    """Edit distance in which letters that only changed places count half of what Levenshtein counts.

    The distance of the sorted letters is what no change of place explains; of the rest, a swap counts 1. Where the
    sorted letters are at hand, they are passed.
    """
    d = F.levenshtein(a, b)
    own = F.least(F.levenshtein(letters_a if letters_a is not None else letters(a), letters_b if letters_b is not None else letters(b)), d)
    return F.when(d <= 1, d).otherwise((own + F.ceil((d - own) / 2)).cast("int"))


#: Lengths of words that may differ by two exchanges and one edit without a common bigram, one letter more on one side.
SWAPPED = (8, 10)


def keys(word: Column, sorted_letters: Column) -> Column:
    """What words within the allowed distance share one of: bigrams, the sorted letters, and these without one letter."""
    n = F.length(word)
    without = F.when(n.between(*SWAPPED), F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("\u0001-"), F.overlay(sorted_letters, F.lit(""), i, F.lit(1))))))
    same = F.when(n > 3, F.array(F.concat(F.lit("\u0001="), sorted_letters), F.concat(F.lit("\u0001-"), sorted_letters)))
    nothing = F.array().cast("array<string>")
    return F.concat(bigrams(word), F.coalesce(same, nothing), F.coalesce(without, nothing))


def edit_distance_join(left: DataFrame, word: str, right: DataFrame, vocabulary: str, on: list[str] | None = None) -> DataFrame:
    """All pairs (word, vocabulary word) within the allowed distance, with ``distance``.

    ``left`` and ``right`` may share the columns ``on``, which must then be equal. Null words match nothing. Pairs are
    counted by their common bigrams first: so many must be left as the distance cannot destroy. The words are few bytes but
    much work, so a stated number of partitions is not coalesced.
    """
    on = on or []
    parts = left.sparkSession.sparkContext.defaultParallelism
    sides = []
    for df, name, tag in ((left, word, "l"), (right, vocabulary, "r")):
        distinct = df.select(*on, name).distinct().withColumn(f"letters_{tag}", letters(F.col(name)))
        sides.append(distinct.withColumns({f"n_{tag}": F.size(bigrams(F.col(name))), "key": keys(F.col(name), F.col(f"letters_{tag}"))}))
    each = [df.withColumn("key", F.explode("key")) for df in sides]
    pair = [*on, word, vocabulary, "letters_l", "letters_r", "n_l", "n_r"]
    grams = F.count(F.when(~F.col("key").startswith("\u0001"), 1)).alias("common")
    common = each[0].repartition(parts, *on, word).join(each[1], [*on, "key"]).groupBy(*pair).agg(grams)
    limit = allowed_distance(F.least(F.length(word), F.length(vocabulary)))
    likely = common.where((F.abs(F.length(word) - F.length(vocabulary)) <= limit) & (F.col("common") >= F.greatest("n_l", "n_r") - limit * 4))
    near = likely.where(F.levenshtein(F.col(word), F.col(vocabulary), 6) >= 0)
    return near.withColumn("distance", edit_distance(F.col(word), F.col(vocabulary), F.col("letters_l"), F.col("letters_r"))).where(F.col("distance") <= limit).select(*on, word, vocabulary, "distance")
