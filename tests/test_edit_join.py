"""The edit-distance join against brute force on random words."""

import random

from pyspark.sql import functions as F

from quayside.operators.edit_join import allowed_distance, edit_distance, edit_distance_join


def disturbed(word, generator):
    letters = list(word)
    for _ in range(generator.randint(0, 3)):
        i, j = generator.randrange(len(letters)), generator.randrange(len(letters))
        kind = generator.random()
        if kind < 0.6:
            letters[i], letters[j] = letters[j], letters[i]
        elif kind < 0.75:
            letters[i] = generator.choice("abcdefgh")
        elif kind < 0.9:
            letters.insert(i, generator.choice("abcdefgh"))
        elif len(letters) > 1:
            del letters[i]
    return "".join(letters)


def test_no_pair_is_lost(spark):
    generator = random.Random(5)
    right = {"".join(generator.choice("abcdefgh") for _ in range(generator.randint(2, 12))) for _ in range(60)} | {"turkey", "abcdefgh", "banananananananana"}
    left = {disturbed(w, generator) for w in sorted(right) for _ in range(12)} | {"kyrteu", "badcefhg"}
    a = spark.createDataFrame([(w,) for w in sorted(left)] + [(None,)], "word string")
    b = spark.createDataFrame([(w,) for w in sorted(right)] + [(None,)], "entry string")
    got = {tuple(r) for r in edit_distance_join(a, "word", b, "entry").collect()}
    pairs = a.join(b, F.length("word") > 0).where("entry IS NOT NULL").withColumn("distance", edit_distance(F.col("word"), F.col("entry")))
    want = {tuple(r) for r in pairs.where(F.col("distance") <= allowed_distance(F.least(F.length("word"), F.length("entry")))).collect()}
    assert got == want and ("kyrteu", "turkey", 2) in got and ("badcefhg", "abcdefgh", 3) in got and len(want) > 300
