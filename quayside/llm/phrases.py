"""Brands, brand-model phrases and names of goods, mined from listings, and found again by Aho-Corasick.

A listing that is read leaves words: a name of goods, a brand, sometimes what no lexicon knows. Each word is tried as the
brand, the others as the name: a name is trusted if many different words complete it, and a word is a brand if trusted
names complete it in most of its listings, of several shippers. The brands, and with them the models that the same
listings state, become phrases; an automaton finds them in every listing, and the longest phrase that is consistent
(the model is one of that brand) is chosen.

Names of the same goods are found by the listings that agree in all else: of the names that listings with one brand,
model and set of marks have, the rarer ones point to the most frequent. A pointer needs support by several such sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.listings import FREQUENT, MARK, MORE_FREQUENT, automaton_of, longest_matches
from quayside.operators.edit_join import edit_distance_join
from quayside.operators.units import staged
from quayside.session import cut_lineage

#: A name is trusted if so many words complete it; a brand needs so many trusted listings, shippers and names, and this share.
NAME_WORDS, BRAND_LISTINGS, BRAND_SHIPPERS, BRAND_NAMES, BRAND_SHARE = 5, 3, 2, 2, 0.5
#: Listings with more remaining words than this are no evidence for a dictionary; they are read all the same.
MOST_WORDS = 12
#: A name points to another if so many sets of listings, and this share of its sets, have both.
NAME_SETS, SET_SHARE, SET_MARKS = 2, 0.25, 2
#: Phrases of one automaton; a longer dictionary is applied in several, one after the other.
SHARD = 200_000


def words_in(name: str) -> Column:
    """The words of a text column, none of a blank one."""
    return F.when(F.col(name) != "", F.split(name, " ")).otherwise(F.array().cast("array<string>"))


def named(words: Column) -> Column:
    """A name as its distinct words in order."""
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def mine_brands(read: DataFrame) -> DataFrame:
    """(brand, n) borne out by ``read``: rest, shipper_id, one row a listing."""
    some = read.select("shipper_id", F.array_distinct(F.filter(words_in("rest"), lambda w: ~w.rlike("^[0-9]"))).alias("rest")).where(F.size("rest").between(2, MOST_WORDS))
    # equal listings of one shipper are counted once, before anything is tried
    some = some.groupBy("rest", "shipper_id").agg(F.count("*").alias("n"))
    tried = some.select("shipper_id", "n", "rest", F.explode("rest").alias("word")).where("length(word) > 3")
    tried = tried.select("shipper_id", "n", "word", named(F.filter("rest", lambda w: w != F.col("word"))).alias("name"))
    pairs = cut_lineage(tried.groupBy("word", "name").agg(F.sum("n").alias("n"), F.collect_set(F.pmod(F.xxhash64("shipper_id"), F.lit(64))).alias("shippers")))
    trusted = pairs.groupBy("name").agg(F.count("*").alias("words")).where(F.col("words") >= NAME_WORDS).select("name", F.lit(True).alias("trusted"))
    judged = pairs.join(trusted, "name", "left").groupBy("word").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("trusted"), F.col("n"))).alias("n"), F.count(F.when(F.col("trusted"), 1)).alias("names"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("trusted"), F.col("shippers")))))).alias("shippers"),
    )
    kept = (F.col("n") >= BRAND_LISTINGS) & (F.col("shippers") >= BRAND_SHIPPERS) & (F.col("names") >= BRAND_NAMES) & (F.col("n") >= F.col("all") * BRAND_SHARE)
    return judged.where(kept).select(F.col("word").alias("brand"), "n")


def mine_phrases(read: DataFrame, brands: DataFrame) -> DataFrame:
    """(phrase, brand, model): every brand, and every model with the brand that most of its listings name."""
    with_model = read.where("models <> ''").select(F.explode(words_in("models")).alias("model"), "rest").select("model", F.explode(F.array_distinct(words_in("rest"))).alias("brand"))
    owners = with_model.join(brands.select("brand"), "brand").groupBy("model", "brand").agg(F.count("*").alias("n"))
    owner = owners.groupBy("model").agg(F.max_by("brand", F.struct("n", "brand")).alias("brand"))
    spelt = F.regexp_replace("model", "(?<=[a-z])(?=[0-9])", " ")
    both = owner.select(F.explode(F.array(F.concat_ws(" ", "brand", spelt), F.concat_ws(" ", spelt, "brand"))).alias("phrase"), "brand", "model")
    alone = brands.select(F.col("brand").alias("phrase"), "brand", F.lit("").alias("model"))
    return cut_lineage(alone.unionByName(both).groupBy("phrase").agg(F.min("brand").alias("brand"), F.min("model").alias("model")))


def find_phrases(read: DataFrame, phrases: DataFrame) -> DataFrame:
    """``read`` (rest, models) with brand, model and name: the longest phrases, the models stated, the words left.

    The dictionary is given to the workers in parts of SHARD phrases, so that a dictionary of any size is used whole.
    """
    parts = -(-phrases.count() // SHARD)
    stated = F.when(F.col("models") != "", F.concat(F.regexp_replace("models", "(?<=[a-z])(?=[0-9])", " "), F.lit(" "))).otherwise("")
    row = F.concat(F.lit(" "), F.col("rest"), F.lit(" "), stated)
    out = read.withColumn("hits", F.lit(""))
    for part in range(parts):
        few = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part).toPandas()
        out = out.withColumn("hits", F.trim(F.concat_ws(" ", "hits", _finder(read.sparkSession, few)(row))))
    brands = F.array_sort(F.array_distinct(words_in("hits")))
    out = out.select(*read.columns, brands.alias("hits"))
    left = F.array_except(words_in("rest"), F.col("hits"))
    return out.withColumns({"brand": F.array_join("hits", " "), "model": F.coalesce(F.array_min(words_in("models")), F.lit("")), "words": F.array_join(left, " "), "name": named(left)}).drop("hits", "rest", "models")


#: Up to so many brands are looked up among the words of a row by their hash; more are found by the automaton.
FEW_BRANDS = 500


def find_brands(read: DataFrame, phrases: DataFrame, brands: DataFrame) -> DataFrame:
    """``read`` with brand, model and words as ``find_phrases`` gives them, without Python where the brands are few: a brand is one word of the rest."""
    few = [r["brand"] for r in brands.select("brand").limit(FEW_BRANDS + 1).collect()]
    if len(few) > FEW_BRANDS:
        return find_phrases(read, phrases)
    known = F.array(*[F.lit(b) for b in sorted(few)]) if few else F.array().cast("array<string>")
    kept = [F.col(c) for c in read.columns if c not in ("rest", "models")]
    split = staged(read, *kept, F.col("models"), words_in("rest").alias("split"))
    hit = staged(split, *kept, F.col("models"), F.col("split"), F.array_intersect("split", known).alias("hits"))
    left = F.when(F.size("hits") > 0, F.array_except("split", "hits")).otherwise(F.array_distinct("split"))
    model = F.when(F.col("models") == "", "").otherwise(F.array_min(F.split("models", " ")))
    return hit.select(*kept, F.array_join(F.array_sort("hits"), " ").alias("brand"), model.alias("model"), F.array_join(left, " ").alias("words"))


def _finder(spark, few: pd.DataFrame):
    shared = spark.sparkContext.broadcast(list(few.itertuples(index=False, name=None)))

    @F.pandas_udf(T.StringType())
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """The brands of the longest phrases in each row of words; a phrase of brand and model goes before either alone."""
        automaton = automaton_of({phrase: brand for phrase, brand, _ in shared.value})
        for batch in batches:
            yield pd.Series([" ".join(brand for _, _, brand in longest_matches(automaton, row)) for row in batch])

    return find.asNondeterministic()


def misspelt_names(counted: DataFrame) -> DataFrame:
    """(name, right) of rare names that differ from a frequent one in a letter or two, spaces and numbers aside."""
    letters = F.regexp_replace("name", "[^\\p{L}]+", "")
    spelt = cut_lineage(counted.select("name", "n", letters.alias("letters")).where("length(letters) > 5"))
    frequent = spelt.where(F.col("n") >= FREQUENT).groupBy("letters").agg(F.max_by("name", F.struct("n", "name")).alias("right"), F.max("n").alias("m")).withColumnRenamed("letters", "near")
    near = edit_distance_join(spelt, "letters", frequent, "near").where("distance <= 2").join(spelt, "letters").join(frequent, "near")
    near = near.where((F.col("m") >= F.col("n") * MORE_FREQUENT) & (F.col("right") != F.col("name")))
    return near.groupBy("name").agg(F.min_by("right", F.struct("distance", -F.col("m"), "right")).alias("right"))


def goods_of_names(read: DataFrame) -> DataFrame:
    """(name, goods): the name that stands for each name's goods. ``read`` has brand, model, marks and name.

    Every pointer leads to a more frequent name, so following them ends; the ends are the goods.
    """
    sets = read.where((F.col("brand") != "") & (F.size(F.split("marks", MARK)) >= SET_MARKS)).select(F.xxhash64("brand", "model", "marks").alias("set"), "name").distinct()
    frequent = read.groupBy("name").agg(F.count("*").alias("n"))
    sets = cut_lineage(sets.join(frequent, "name"))
    centre = sets.groupBy("set").agg(F.max(F.struct("n", "name")).alias("c"), F.count("*").alias("names")).where("names > 1").select("set", "c.name", "c.n").withColumnsRenamed({"name": "centre", "n": "m"})
    votes = sets.join(centre, "set")
    of_name = votes.groupBy("name").agg(F.count("*").alias("sets"))
    edges = votes.where("name <> centre").groupBy("name", "centre", "n", "m").agg(F.count("*").alias("both"))
    best = edges.join(of_name, "name").where((F.col("both") >= NAME_SETS) & (F.col("both") >= F.col("sets") * SET_SHARE))
    pointer = best.groupBy("name").agg(F.max_by("centre", F.struct("both", "m", "centre")).alias("goods"))
    pointer = frequent.select("name").join(pointer, "name", "left").join(misspelt_names(frequent), "name", "left")
    pointer = cut_lineage(pointer.select("name", F.coalesce("goods", "right", "name").alias("goods")))
    while True:
        ends = pointer.select(F.col("name").alias("goods"), F.col("goods").alias("next"))
        moved = cut_lineage(pointer.join(ends, "goods").select("name", F.col("next").alias("goods"), (F.col("goods") != F.col("next")).alias("moved")))
        pointer = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return pointer
