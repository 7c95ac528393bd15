"""Freely typed values mapped to a canonical list by token-level repair and soft TF-IDF.

Only the distinct values of a field are matched. Each distinct token is joined to the vocabulary of the list's names
by edit distance; the repaired tokens of a value are then combined with the weights of the names' tokens to a soft
TF-IDF score, by which the complete entries are ranked. The value without its spaces and signs is one more token, so
that words torn apart or run together are repaired as well; a value that needs no repair is at distance 0. Names of things outside the list take part, so that a
value that means one of them is not forced onto a neighbour.

Null and blank values give no row; a value written exactly like an entry is mapped to it; a value that means none, or
names several entries, has ref_id 0. Ties go to the entry that occurs more often as itself, then to the smaller ref_id.
Values of any length are matched whole. An empty table gives no rows, an empty list maps all to 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.functions.text import fold_accents, fold_lookalikes, unleet
from quayside.llm.vocabulary import ALL, STOP_WORDS, alias_table
from quayside.operators.edit_join import edit_distance_join
from quayside.session import cut_lineage

#: Least score of an entry, least share of a term's name that must be found, least explained share of a value.
LEAST_SCORE, LEAST_COVER, LEAST_EXPLAINED = 0.62, 0.8, 0.85
SEVERAL = "[/+&;|]|\\s(?i:or|and|oder|ou|und)\\s"


def plain(text: Column) -> Column:
    """Folded and lower case, C&F written cnf, single letters joined to one word, signs as spaces."""
    t = fold_accents(F.lower(fold_lookalikes(F.regexp_replace(text, "²", "2"))))
    t = F.regexp_replace(t, "\\bc\\s*(?:&|\\+|and|n)\\s*f\\b", "cnf")
    t = F.regexp_replace(F.regexp_replace(t, "\\(s\\)", "s"), "&", " and ")
    t = F.regexp_replace(t, "(?<![\\p{L}\\p{N}])(\\p{L})[.\\s/-]+(?=\\p{L}(?![\\p{L}\\p{N}]))", "$1")
    return F.trim(F.regexp_replace(t, "[^\\p{L}\\p{M}\\p{N}@$]+", " "))


#: What announces or follows an entry and is not part of it.
BEFORE = "^(?:(?:made|product|products|produce|grown|mfd|manufactured|produced|origin|country of origin|coo|terms?|incoterms?|inco|100|20[0-9]{2})\\s+(?:in\\s+|of\\s+)?)++"
AFTER = "(?:\\s+(?:origin|certified|fta|incoterms?|20[0-9]{2}|only))++$"


def whole_word(text: Column) -> Column:
    """A plain text without announcing words and without spaces."""
    kept = F.regexp_replace(F.regexp_replace(text, BEFORE, ""), AFTER, "")
    return F.replace(F.when(kept == "", text).otherwise(kept), F.lit(" "), F.lit(""))


def _tokens(field: Column, text: Column) -> Column:
    """Words of a plain text that may carry meaning; numbers and single letters dropped, digits inside words read as letters."""
    stop = F.create_map(*[x for k, v in STOP_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v.split()]))])
    words = F.filter(F.split(text, " "), lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$") & ~F.array_contains(F.coalesce(stop[field], F.array().cast("array<string>")), w))
    return F.array_distinct(F.transform(words, lambda w: F.when(w.rlike("\\p{L}.*\\p{L}|^[0-9@$]\\p{L}{3,}"), unleet(w)).otherwise(w)))


def names(aliases: DataFrame) -> DataFrame:
    """One row per distinct name and division in words: field, alias_id, ref_id, whole, tokens.

    The list's own names come first, then names of listed entries; a name that two of them share has ref_id 0.
    """
    p = aliases.select("field", "ref_id", "own", plain(F.col("alias")).alias("text"))
    p = p.select("field", "ref_id", "own", F.replace(F.col("text"), F.lit(" "), F.lit("")).alias("whole"), _tokens(F.col("field"), F.col("text")).alias("tokens")).where("whole <> ''")
    ids = F.array_distinct(F.collect_list(F.when(F.col("ref_id") > 0, F.col("ref_id"))))
    own = F.array_distinct(F.collect_list(F.when(F.col("own"), F.col("ref_id"))))
    one = p.groupBy("field", "whole").agg(ids.alias("ids"), own.alias("own_ids"), F.collect_set("tokens").alias("spelt"))
    ref = F.when(F.size("own_ids") == 1, F.col("own_ids")[0]).when(F.size("ids") == 1, F.col("ids")[0]).otherwise(0)
    split = one.select("field", "whole", ref.alias("ref_id"), F.explode("spelt").alias("tokens"))
    return split.withColumn("alias_id", F.xxhash64("field", "whole", "tokens"))


#: So many rows of a list or table at most are broadcast, once they are counted.
BROADCAST_NAMES = 100_000
#: The score of a value that needs no repair: no other entry is closer, and names side by side do not overrule it.
EXACT = 9.0


def counted(df: DataFrame) -> DataFrame:
    """``df``, which is written down, to be broadcast if it is short."""
    return F.broadcast(df) if df.count() <= BROADCAST_NAMES else df


#: A token of so many letters may be a name's token cut short, and is as similar as this.
SHORTENED, SHORTENED_SIMILARITY = 4, 0.85


def cut_short(tokens: DataFrame, names_tokens: DataFrame) -> DataFrame:
    """(field, token, name_token, sim) of tokens that are the beginning of the tokens of one entry only."""
    longer = names_tokens.where(F.length("name_token") > SHORTENED).select("field", "ref_id", "name_token").distinct()
    begun = longer.select("field", "ref_id", "name_token", F.explode(F.transform(F.sequence(F.lit(SHORTENED), F.length("name_token") - 1), lambda n: F.left("name_token", n))).alias("token"))
    found = begun.join(tokens.select("field", "token").distinct(), ["field", "token"])
    one = found.groupBy("field", "token").agg(F.min("ref_id").alias("low"), F.max("ref_id").alias("high")).where("low = high AND low > 0").select("field", "token")
    return found.join(one, ["field", "token"]).select("field", "token", "name_token", F.lit(SHORTENED_SIMILARITY).alias("sim")).distinct()


def match_values(values: DataFrame, refs: DataFrame, knowledge: tuple[str, ...] = ALL) -> DataFrame:
    """(field, value, ref_id, score) of each distinct (field, value) in ``values``; ``n`` there counts its rows.

    Every value is repaired: as one token by its letters, and token by token.
    """
    spark = values.sparkSession
    known = cut_lineage(names(alias_table(spark, refs, knowledge)))
    own = refs.select("field", F.col("ref_value").alias("value"), "ref_id")
    prior = values.join(own, ["field", "value"]).groupBy("field", "ref_id").agg(F.sum("n").alias("prior"))
    read = values.select("field", "value", plain(F.col("value")).alias("text"))
    read = read.select("field", "value", whole_word(F.col("text")).alias("whole"), _tokens(F.col("field"), F.col("text")).alias("tokens"))
    read = cut_lineage(read)

    wholes = counted(cut_lineage(known.select("field", "whole", "ref_id").distinct()))

    # the whole value as one token, as it is written and with its digits read as letters
    words = read.select("field", F.explode(F.array_distinct(F.array("whole", unleet(F.col("whole"))))).alias("word"), "value").where("word <> ''")
    near = edit_distance_join(words, "word", known, "whole", ["field"])
    alike = 1 - F.col("distance") / F.greatest(F.length("word"), F.length("whole"))
    by_whole = words.join(near, ["field", "word"]).join(wholes, ["field", "whole"])
    by_whole = by_whole.where((F.col("distance") == 0) | (F.length("word") > 3)).select("field", "value", "ref_id", F.when(F.col("distance") == 0, EXACT).otherwise(alike).alias("score"))

    # token by token
    entry = known.where("size(tokens) > 0").select("field", "alias_id", "ref_id", F.explode("tokens").alias("name_token"))
    df = entry.groupBy("field", "name_token").agg(F.countDistinct(F.when(F.col("ref_id") > 0, F.col("ref_id")).otherwise(F.col("alias_id"))).alias("df"))
    n = known.groupBy("field").agg(F.countDistinct("ref_id").alias("entries"))
    weight = counted(cut_lineage(df.join(n, "field").select("field", "name_token", F.log(1 + F.col("entries") / F.col("df")).alias("w"), F.log(1 + F.col("entries")).alias("w_max"))))
    weighted = entry.join(weight, ["field", "name_token"])
    norms = weighted.groupBy("field", "alias_id").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"), F.sum("w").alias("mass"))
    weighted = cut_lineage(weighted.join(norms, ["field", "alias_id"]))
    tokens = read.select("field", "value", F.posexplode("tokens").alias("pos", "token"))
    pairs = edit_distance_join(tokens, "token", weighted.select("field", "name_token").distinct(), "name_token", ["field"])
    pairs = pairs.select("field", "token", "name_token", (1 - F.col("distance") / F.greatest(F.length("token"), F.length("name_token"))).alias("sim"))
    pairs = cut_lineage(pairs.unionByName(cut_short(tokens, weighted)).groupBy("field", "token", "name_token").agg(F.max("sim").alias("sim")))
    best_weight = pairs.join(weight, ["field", "name_token"]).groupBy("field", "token").agg(F.max_by("w", "sim").alias("w_token"))
    fields = weight.groupBy("field").agg(F.max("w_max").alias("w_max"))
    tokens = tokens.join(best_weight, ["field", "token"], "left").join(F.broadcast(fields), "field").withColumn("w_token", F.coalesce("w_token", "w_max"))
    tokens = cut_lineage(tokens)
    value_norm = tokens.groupBy("field", "value").agg(F.sqrt(F.sum(F.col("w_token") ** 2)).alias("value_norm"), F.sum("w_token").alias("value_mass"))
    hits = tokens.join(pairs, ["field", "token"]).join(weighted, ["field", "name_token"])
    # each token of the value counts once for a name, by its most similar token, and each token of the name once
    hits = hits.groupBy("field", "value", "pos", "alias_id", "ref_id", "norm", "mass", "w_token").agg(F.max(F.struct(F.col("sim") * F.col("w"), "sim", "w", "name_token")).alias("b"))
    hits = hits.groupBy("field", "value", "alias_id", "ref_id", "norm", "mass", "b.name_token").agg(F.max(F.struct("b", (-F.col("pos")).alias("at"), "w_token")).alias("m"))
    hits = hits.select("field", "value", "alias_id", "ref_id", "norm", "mass", (-F.col("m.at")).alias("pos"), F.col("m.w_token").alias("w_token"), F.col("m.b").alias("b"))
    hits = cut_lineage(hits)
    scored = hits.groupBy("field", "value", "alias_id", "ref_id", "norm", "mass").agg(
        F.sum(F.col("w_token") * F.col("b.w") * F.col("b.sim")).alias("dot"),
        F.sum(F.col("b.w") * F.col("b.sim")).alias("found"),
        F.sum(F.col("w_token") * F.col("b.sim")).alias("explained"),
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n_at"),
        F.collect_set(F.when(F.col("b.sim") > 0.95, F.col("pos"))).alias("at"),
    )
    # the names of one entry explain a value together (NE-Niger, Poland POL)
    together = hits.groupBy("field", "value", "pos", "ref_id", "w_token").agg(F.max("b.sim").alias("sim")).where("ref_id > 0").groupBy("field", "value", "ref_id").agg(F.sum(F.col("w_token") * F.col("sim")).alias("by_entry"))
    scored = scored.join(value_norm, ["field", "value"]).join(together, ["field", "value", "ref_id"], "left").select(
        "field", "value", "ref_id", "at", "first",
        (F.col("dot") / (F.col("norm") * F.col("value_norm")) - F.when(F.col("field") == "incoterm", 0.3).otherwise(0.0) * (F.col("last") - F.col("first") + 1 - F.col("n_at"))).alias("score"),
        F.least(F.col("found") / F.col("mass"), F.lit(1.0)).alias("cover"),
        (F.col("explained") / F.col("value_mass")).alias("explains"), (F.col("by_entry") / F.col("value_mass")).alias("entry_explains"),
    )
    scored = cut_lineage(scored)
    accepted = F.when(F.col("field") == "incoterm", (F.col("cover") >= LEAST_COVER) & (F.col("first") == 0)).otherwise(
        (F.col("score") >= LEAST_SCORE) | ((F.col("explains") >= LEAST_EXPLAINED) & (F.col("score") >= 0.45))
    )
    boosted = F.when((F.col("field") != "incoterm") & (F.col("cover") >= 0.99), F.greatest("score", F.coalesce(F.col("entry_explains") * 0.98, F.lit(0.0)))).otherwise(F.col("score"))
    by_token = scored.where(accepted).select("field", "value", "ref_id", boosted.alias("score"), (F.col("cover") >= 0.75).alias("sure"))
    # part of a name that several entries share says nothing
    by_token = by_token.groupBy("field", "value", "ref_id").agg(F.max("score").alias("score"), F.max("sure").alias("sure"))
    alone = F.count("*").over(W.partitionBy("field", "value", "sure"))
    by_token = by_token.withColumn("alone", alone).where("sure OR alone = 1").select("field", "value", "ref_id", "score")

    ranked = by_whole.unionByName(by_token).groupBy("field", "value", "ref_id").agg(F.max("score").alias("score"))
    ranked = ranked.join(prior, ["field", "ref_id"], "left")
    order = W.partitionBy("field", "value").orderBy(F.round("score", 6).desc(), F.coalesce("prior", F.lit(0)).desc(), "ref_id")
    best = ranked.withColumn("k", F.row_number().over(order)).where("k = 1").select("field", "value", "ref_id", "score")

    # several entries named side by side: two names found whole at different places
    whole_names = scored.where((F.col("cover") >= 0.85) & (F.col("ref_id") > 0) & F.col("value").rlike(SEVERAL) & (F.col("field") != "incoterm"))
    places = whole_names.where("size(at) > 0").groupBy("field", "value", "ref_id").agg(F.max_by("at", F.struct("cover", F.size("at"), "score")).alias("at"))
    sets = places.groupBy("field", "value").agg(F.collect_list("at").alias("sets"), F.count("*").alias("m")).where("m > 1")
    apart = F.exists("sets", lambda a: F.exists("sets", lambda b: (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)))
    several = sets.where(apart).select("field", "value", F.lit(0).alias("several"))
    found = best.join(several, ["field", "value"], "left")
    found = found.select("field", "value", F.when((F.col("several") == 0) & (F.col("score") < EXACT), 0).otherwise(F.col("ref_id")).alias("ref_id"), "score")
    return values.select("field", "value").join(found, ["field", "value"], "left").fillna({"ref_id": 0, "score": 0.0})


def canonical_values(lines: DataFrame, refs: DataFrame, key: str = "line_id", fields: tuple[str, ...] = ("origin", "unit", "incoterm"), knowledge: tuple[str, ...] = ALL) -> DataFrame:
    """(key, field, value, ref_id, score) of every non-blank value of the fields in every row, mapped or 0.

    Hot values cost nothing: the values are aggregated before they are matched, and the result joins back by broadcast
    if it is short when counted, else salted by the row.
    """
    cells = lines.select(F.col(key), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))).where("trim(regexp_replace(value, '\\\\s+', ' ')) <> ''")
    values = cut_lineage(cells.groupBy("field", "value").agg(F.count("*").alias("n")))
    matched = cut_lineage(match_values(values, refs, knowledge))
    return join_values(cells, matched)


#: A list of matched values up to this length, counted before, is broadcast: some 20 MB.
BROADCAST_VALUES, SALTS = 200_000, 32


def join_values(cells: DataFrame, matched: DataFrame) -> DataFrame:
    if matched.count() <= BROADCAST_VALUES:
        return cells.join(F.broadcast(matched), ["field", "value"])
    salted = matched.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return cells.withColumn("salt", F.pmod(F.xxhash64(cells.columns[0]), F.lit(SALTS)).cast("int")).join(salted, ["field", "value", "salt"]).drop("salt")


def found(lines: DataFrame, refs: DataFrame, knowledge: tuple[str, ...] = ALL) -> DataFrame:
    """(line_id, field, ref_id) of the values that are not written exactly like an entry of their field."""
    own = refs.select("field", F.col("ref_value").alias("value"), F.lit(True).alias("written")).distinct()
    matched = canonical_values(lines, refs, knowledge=knowledge)
    return matched.join(counted(own), ["field", "value"], "left_anti").select("line_id", "field", "ref_id")
