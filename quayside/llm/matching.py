"""Lines of one consignment matched across its documents by loopy belief propagation.

Candidates are pairs of lines of one consignment from two documents that share something telling: a word of their
descriptions, a brand, a model, a weight. No line is left out for the goods that it names. What a pair agrees on is a
pattern of levels, one for each comparison; the weights of the levels are estimated from the counts of the patterns by
expectation maximisation, which starts from stated prior counts. The one-to-one factors (a line has at most one partner
in each other document) then exchange messages through window joins over the pairs until they no longer change, which
gives the marginal probability of each match. Matches are assigned one to one, the likeliest first. Pairs of lines that
match the same line of a third document are added to the graph as candidates and pass messages like all others. Equal
lines, which share the probability, are matched last.

Of copies only the smallest line_id counts; totals and lines without a description match nothing, nor do lines
without a consignment or document. Candidates stay inside a consignment, so no cross join is made; by the data a
consignment has at most some seventy goods. Ties are broken by position, then by line_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.functions.numbers import printed_number
from quayside.functions.text import fold_lookalikes
from quayside.llm.listings import MARK
from quayside.llm.phrases import find_brands, mine_brands, mine_phrases, words_in
from quayside.llm.products import described, originals, read_listings
from quayside.operators.units import staged
from quayside.schemas import DOC_TYPES
from quayside.session import cut_lineage

#: The comparisons with their levels; for each level the prior counts of matches and of other pairs, of 100 each.
LEVELS = {
    "words": {"unknown": (4, 4), "none": (2, 30), "some": (10, 40), "most": (24, 16), "all": (60, 10)},
    "brand": {"unknown": (40, 40), "differs": (1, 55), "same": (59, 5)},
    "model": {"unknown": (80, 80), "differs": (0.2, 19.5), "same": (19.8, 0.5)},
    "marks": {"none": (25, 30), "one": (18, 10), "two": (22, 4), "more": (25, 2), "mixed": (8, 19), "differs": (2, 35)},
    "gross": {"unknown": (50, 50), "differs": (2, 49), "near": (3, 0.5), "same": (45, 0.5)},
    "net": {"unknown": (60, 60), "differs": (4, 39), "near": (3, 0.5), "same": (33, 0.5)},
    "quantity": {"unknown": (10, 10), "differs": (55, 88), "same": (35, 2)},
    "place": {"unknown": (1, 1), "far": (49, 79), "near": (20, 12), "same": (30, 8)},
}
#: Prior share of matches among the candidates, the weight of the prior in pairs, rounds of estimation, and where it is still.
PRIOR_SHARE, PRIOR_PAIRS, EM_ROUNDS, EM_STILL = 0.2, 300.0, 200, 1e-6
#: Pairs below these log-odds are no candidates: as rivals of others they would change a marginal by less than a thousandth.
LEAST = -7.0
#: Messages per block of rounds, largest change of a message at which it has converged, and most blocks (reported as not converged).
ROUNDS, STILL, MOST_BLOCKS = 4, 1e-2, 25
#: Pairs from this belief on (a probability of a half) are matched first, and what follows from them over a third document.
SURE = 0.0
#: So many pairs at most are broadcast.
FEW = 100_000
#: A pair is matched from these log-odds on, if its lines are free: it is no less likely than that neither has a partner.
LEAST_ODDS = 0.0


def _figure(text: Column) -> Column:
    plain = F.when(text.rlike("^[0-9., ']+$"), text).otherwise(F.trim(F.regexp_replace(fold_lookalikes(text), "[\\s]*(?i:kgs?\\.?)$", "")))
    return F.when(text.rlike("[1-9]"), printed_number(plain))


def read_lines(lines: DataFrame, lexicon: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """The lines that can be matched, with what their descriptions and figures say; each description is read once.

    Brands and models are mined from the invoices and found in all documents.
    """
    wanted = described(lines.where("consignment_id IS NOT NULL AND source_doc IS NOT NULL"))
    first = originals(wanted, "description", "quantity", "net_weight_kg", "gross_weight_kg", "shipper_id")
    stated = first.select(
        "line_id", "consignment_id", "source_doc", "line_no", "description", "shipper_id", _figure(F.col("gross_weight_kg")).cast("double").alias("gross"),
        _figure(F.col("net_weight_kg")).cast("double").alias("net"), F.when(F.col("quantity").rlike("[1-9]"), F.lower(F.trim("quantity"))).alias("quantity"),
    )
    read = read_listings(stated, lexicon)
    invoices = read.where("source_doc = 'invoice'")
    brands = cut_lineage(mine_brands(invoices))
    found = find_brands(read, mine_phrases(invoices, brands), brands)
    telling = F.array_distinct(F.filter(words_in("words"), lambda w: (F.length(w) > 1) & ~F.left(w, F.lit(1)).between("0", "9")))
    marks = F.when(F.col("marks") != "", F.split("marks", MARK)).otherwise(F.array().cast("array<string>"))
    kept = [F.col(c) for c in ("line_id", "consignment_id", "source_doc", "line_no", "brand", "model", "gross", "net", "quantity")]
    return staged(found, *kept, marks.alias("marks"), telling.alias("words"))


@contextmanager
def partitioned_by_part(spark: SparkSession):
    """Joins on several keys take a partitioning by one of them as it is, for what is planned inside."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _first(name: str, *cases: tuple[Column, str], other: str) -> Column:
    """The number of the first level of a comparison whose condition holds."""
    number = list(LEVELS[name]).index
    level = F.lit(number(other))
    for condition, text in reversed(cases):
        level = F.when(condition, number(text)).otherwise(level)
    return level


def _agreement(name: str) -> Column:
    """The level of a comparison of two figures."""
    a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
    return _first(name, (a.isNull() | b.isNull(), "unknown"), (a == b, "same"), (F.abs(a - b) <= F.greatest(a, b) * 0.03, "near"), other="differs")


def _equality(name: str, blank: Column) -> Column:
    return _first(name, (blank, "unknown"), (F.col(f"{name}_a") == F.col(f"{name}_b"), "same"), other="differs")


def pair_counts() -> dict[str, Column]:
    """What the levels of a pair are read from."""
    return {
        "fewer": F.least(F.size("words_a"), F.size("words_b")), "shared": F.size(F.array_intersect("words_a", "words_b")), "both": F.size(F.array_intersect("dims_a", "dims_b")),
        "same": F.size(F.array_intersect("marks_a", "marks_b")), "far": F.abs(F.col("line_no_a") - F.col("line_no_b")),
    }


def pair_pattern() -> Column:
    """The levels of all comparisons of a pair as one number."""
    fewer, shared, both, same, far = (F.col(c) for c in pair_counts())
    blank = lambda name: (F.col(f"{name}_a") == "") | (F.col(f"{name}_b") == "")
    levels = {
        "words": _first("words", (fewer == 0, "unknown"), (shared == 0, "none"), (shared * 2 < fewer, "some"), (shared < fewer, "most"), other="all"),
        "brand": _equality("brand", blank("brand")),
        "model": _equality("model", blank("model")),
        "marks": _first("marks", (both == 0, "none"), (same == 0, "differs"), (both > same, "mixed"), (same == 1, "one"), (same == 2, "two"), other="more"),
        "gross": _agreement("gross"),
        "net": _agreement("net"),
        "quantity": _equality("quantity", F.col("quantity_a").isNull() | F.col("quantity_b").isNull()),
        "place": _first("place", (far.isNull(), "unknown"), (far == 0, "same"), (far <= 2, "near"), other="far"),
    }
    pattern = F.lit(0)
    for name in LEVELS:
        pattern = pattern * len(LEVELS[name]) + levels[name]
    return pattern


def compared_pairs(read: DataFrame) -> DataFrame:
    """consignment_id, a, b, da, db, pattern of the candidates: each pair once, at the first key that its lines share.

    The lines are shuffled once, by consignment; keys and pairs are made where they are. From here on a consignment is
    a digest that only tells where its pairs are; what rivals share is the line and the other's document.
    """
    prefixed = lambda p, c: F.when(F.col(c).cast("string") != "", F.concat(F.lit(p), F.col(c).cast("string")))
    keys = F.array_compact(F.concat(F.transform("words", lambda w: F.concat(F.lit("w"), w)), F.array(prefixed("b", "brand"), prefixed("m", "model"), prefixed("g", "gross"), prefixed("n", "net"))))
    keys = F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k)))  # two keys with one digest make a candidate, no match
    dims = F.transform("marks", lambda m: F.substring_index(m, "=", 1))
    placed = read.withColumns({"keys": keys, "dims": dims}).repartition("consignment_id")
    side = lambda s: placed.select("consignment_id", F.explode("keys").alias("key"), *[F.col(c).alias(f"{c}_{s}") for c in placed.columns if c != "consignment_id"])
    with partitioned_by_part(read.sparkSession):
        joined = side("a").join(side("b").hint("shuffle_hash"), ["consignment_id", "key"]).where((F.col("source_doc_a") < F.col("source_doc_b")) & (F.col("key") == F.get(F.array_intersect("keys_a", "keys_b"), F.lit(0))))
        known = F.array(*[F.lit(d) for d in sorted(DOC_TYPES)])
        number = lambda c: F.array_position(known, F.col(c)).cast("int")
        doc = lambda s: F.when(number(f"source_doc_{s}") > 0, number(f"source_doc_{s}")).otherwise(F.hash(f"source_doc_{s}"))
        stated = ["quantity", "gross", "net", "brand", "model"]
        sides = [F.col(f"{c}_{x}") for c in stated for x in "ab"]
        pairs = staged(joined, F.xxhash64("consignment_id").alias("consignment_id"), F.col("line_id_a").alias("a"), F.col("line_id_b").alias("b"), doc("a").alias("da"), doc("b").alias("db"), *sides, *[c.alias(n) for n, c in pair_counts().items()])
        return cut_lineage(pairs.select("consignment_id", "a", "b", "da", "db", pair_pattern().alias("pattern")))


def _digits(patterns: np.ndarray) -> dict[str, np.ndarray]:
    """The levels of each comparison from the patterns' numbers."""
    out, rest = {}, patterns.copy()
    for name in reversed(LEVELS):
        out[name] = rest % len(LEVELS[name])
        rest //= len(LEVELS[name])
    return out


def estimate_weights(patterns: np.ndarray, counts: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(log-odds of a match, log-ratios of the levels of each comparison) by expectation maximisation over pattern counts.

    Matches and other pairs each have their own frequencies of levels, independent between comparisons; the prior counts
    take part as PRIOR_PAIRS pairs, so that a small table is judged by them and a large one by itself.
    """
    levels = _digits(patterns)
    prior = {name: np.array(list(rows.values())) / np.sum(list(rows.values()), axis=0) for name, rows in LEVELS.items()}
    share, freq = PRIOR_SHARE, {name: p.copy() for name, p in prior.items()}
    for _ in range(EM_ROUNDS):
        odds = math.log(share / (1 - share)) + sum(np.log(freq[n][levels[n], 0] / freq[n][levels[n], 1]) for n in LEVELS)
        match = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        weight = np.stack([counts * match, counts * (1 - match)], axis=1)
        totals = weight.sum(axis=0)
        new = (totals[0] + PRIOR_SHARE * PRIOR_PAIRS) / (totals.sum() + PRIOR_PAIRS)
        for n in LEVELS:
            seen = np.zeros_like(freq[n])
            np.add.at(seen, levels[n], weight)
            freq[n] = (seen + prior[n] * PRIOR_PAIRS) / (totals + PRIOR_PAIRS)
        moved, share = abs(new - share), new
        if moved < EM_STILL:
            break
    return math.log(share / (1 - share)), {n: np.log(freq[n][:, 0] / freq[n][:, 1]) for n in LEVELS}


def candidate_pairs(read: DataFrame) -> DataFrame:
    """consignment_id, a, b, da, db, odds of the pairs that are possible, by weights estimated over all candidates.

    The counts of the patterns go to the driver: there are as many patterns as products of levels at most.
    """
    pairs = compared_pairs(read)
    counts = pairs.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()
    base, ratios = estimate_weights(counts["pattern"].to_numpy(dtype=np.int64), counts["n"].to_numpy(dtype=float))
    odds, rest = F.lit(base), F.col("pattern")
    for name in reversed(LEVELS):
        k = len(LEVELS[name])
        odds = odds + F.get(F.array(*[F.lit(float(x)) for x in ratios[name]]), rest % k)
        rest = F.floor(rest / k)
    return pairs.select("consignment_id", "a", "b", "da", "db", odds.alias("odds")).where(F.col("odds") > LEAST)


#: The pairs of a line with one other document are rivals.
RIVALS = {"a": ("consignment_id", "a", "db"), "b": ("consignment_id", "b", "da")}


def _others(message: Column, side: str) -> Column:
    """log(1 + sum of exp(message) over the other pairs of a line): what speaks against one of its pairs."""
    w = W.partitionBy(*RIVALS[side])
    return F.log1p(F.greatest(F.sum(F.exp(F.least(message, F.lit(30.0)))).over(w) - F.exp(F.least(message, F.lit(30.0))), F.lit(0.0)))


def propagate(pairs: DataFrame) -> DataFrame:
    """The pairs with ``probability``, ``alone`` (neither line has another candidate in the other's document) and ``converged``.

    Messages of the one-to-one factors are exchanged until they are still, damped by a half. All messages of a
    consignment stay in the partition of its pairs: they are shuffled once, and each round only sorts them. Consignments
    whose messages are still after a block of rounds are done; a pair without rivals needs no message. What still moves
    after MOST_BLOCKS blocks is given as it is, with ``converged`` false.
    """
    degree = lambda side: F.count("*").over(W.partitionBy(*RIVALS[side]))
    counted = cut_lineage(pairs.repartition("consignment_id").withColumn("na", degree("a")).withColumn("nb", degree("b")))
    columns = ["consignment_id", "a", "b", "da", "db", "odds"]
    done = counted.where("na = 1 AND nb = 1").select(*columns, F.col("odds").alias("belief"), F.lit(True).alias("alone"), F.lit(True).alias("converged"))
    state = counted.where("na > 1 OR nb > 1").select(*columns, F.col("odds").alias("to_a"), F.col("odds").alias("to_b")).repartition("consignment_id")
    for block in range(MOST_BLOCKS):
        for _ in range(ROUNDS):
            step = state.withColumn("from_a", _others(F.col("to_a"), "a")).withColumn("from_b", _others(F.col("to_b"), "b"))
            new_a, new_b = (F.col("to_a") + F.col("odds") - F.col("from_b")) / 2, (F.col("to_b") + F.col("odds") - F.col("from_a")) / 2
            state = step.select(*columns, new_a.alias("to_a"), new_b.alias("to_b"), F.greatest(F.abs(new_a - F.col("to_a")), F.abs(new_b - F.col("to_b"))).alias("change"))
        last = state.withColumn("from_a", _others(F.col("to_a"), "a")).withColumn("from_b", _others(F.col("to_b"), "b")).withColumn("belief", F.col("odds") - F.col("from_a") - F.col("from_b"))
        last = cut_lineage(last.withColumn("moved", F.max("change").over(W.partitionBy("consignment_id"))))
        over = block == MOST_BLOCKS - 1
        done = done.unionByName(last.where(F.lit(over) | (F.col("moved") <= STILL)).select(*columns, "belief", F.lit(False).alias("alone"), (F.col("moved") <= STILL).alias("converged")))
        moving = last.where(F.col("moved") > STILL)
        if over or moving.isEmpty():
            break
        state = moving.select(*columns, "to_a", "to_b").repartition("consignment_id")
    return done.withColumn("probability", 1 / (1 + F.exp(-F.greatest(F.least("belief", F.lit(40.0)), F.lit(-40.0)))))


MATCH = ["consignment_id", "a", "b", "da", "db", "probability", "converged"]
FREE_SCHEMA = "consignment_id long, a long, b long, da int, db int, odds double, belief double, probability double, converged boolean"


def _free(batches: Iterator[pd.DataFrame], sure: float) -> Iterator[pd.DataFrame]:
    """Of the pairs in order, by consignment and documents, those whose lines no earlier pair has taken; sure pairs take."""
    group, taken_a, taken_b = None, set(), set()
    for batch in batches:
        kept = []
        for k, (a, b, belief, *documents) in enumerate(zip(*(batch[c] for c in ("a", "b", "belief", "consignment_id", "da", "db")))):
            if documents != group:
                group, taken_a, taken_b = documents, set(), set()
            if a not in taken_a and b not in taken_b:
                kept.append(k)
                if belief >= sure:
                    taken_a.add(a)
                    taken_b.add(b)
        yield batch.iloc[kept]


def best_pairs(beliefs: DataFrame, sure: float = -math.inf) -> DataFrame:
    """The one-to-one assignment read from the beliefs: the best pair of the lines still free, until none is left.

    The pairs are sorted once and read in order, as the best of all free pairs is the best of both its lines. Pairs
    below ``sure`` take no line; all of them are kept whose lines are free.
    """
    columns = ["consignment_id", "a", "b", "da", "db", "odds", F.round("belief", 6).alias("belief"), F.round("probability", 6).alias("probability"), "converged"]
    order = ["consignment_id", "da", "db", F.desc("belief"), F.desc(F.round("odds", 6)), "a", "b"]
    ranked = beliefs.select(*columns).repartition("consignment_id").sortWithinPartitions(*order)
    return ranked.mapInPandas(partial(_free, sure=sure), FREE_SCHEMA)


def still_free(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """The pairs whose lines have no match with each other's document yet; few pairs are broadcast."""
    hint = F.broadcast if pairs.count() <= FEW else lambda df: df
    taken = matches.select(F.col("a").alias("line"), F.col("db").alias("doc")).unionByName(matches.select(F.col("b").alias("line"), F.col("da").alias("doc")))
    lines = pairs.select(F.col("a").alias("line"), F.col("db").alias("doc")).unionByName(pairs.select(F.col("b").alias("line"), F.col("da").alias("doc")))
    taken = cut_lineage(taken.join(hint(lines.distinct()), ["line", "doc"], "left_semi"))
    for line, doc in (("a", "db"), ("b", "da")):
        pairs = pairs.join(hint(taken.select(F.col("line").alias(line), F.col("doc").alias(doc))), [line, doc], "left_anti")
    return pairs


def third_party_pairs(matches: DataFrame) -> DataFrame:
    """Candidates that follow from two matches over a third document, for lines that have no partner in each other's.

    Their log-odds are those of both matches being right. Lines that have a partner in every other document, nearly all,
    are left out by a count before anything else is compared.
    """
    end = lambda x, y, dx: matches.select("consignment_id", F.col(x).alias("line"), F.col(y).alias("hub"), F.col(dx).alias("doc"), "probability")
    ends = end("a", "b", "da").unionByName(end("b", "a", "db"))
    documents = ends.agg(F.count_distinct("doc")).first()[0]
    lacking = ends.groupBy("line").agg(F.count("*").alias("n"), F.max("hub").alias("hub"), F.max("doc").alias("doc"), F.max("probability").alias("probability"), F.max("consignment_id").alias("consignment_id"))
    lacking = lacking.where(F.col("n") < documents - 1)
    if documents > 3:  # a line may have several hubs; with three documents it has the one above
        lacking = lacking.select("line").join(ends, "line")
    # a line has one match in each other document, so a hub has as many ends as there are documents: few
    x, y = (lacking.select("consignment_id", "hub", *[F.col(c).alias(f"{c}_{side}") for c in ("line", "doc", "probability")]) for side in "xy")
    p = F.least(F.col("probability_x") * F.col("probability_y"), F.lit(1 - 1e-6))
    two = x.join(y, ["consignment_id", "hub"]).where("doc_x < doc_y")
    found = two.select("consignment_id", F.col("line_x").alias("a"), F.col("line_y").alias("b"), F.col("doc_x").alias("da"), F.col("doc_y").alias("db"), F.log(p / (1 - p)).alias("odds"))
    return cut_lineage(still_free(cut_lineage(found), matches))


def assign(beliefs: DataFrame) -> DataFrame:
    """The matches: the sure ones, what follows from them, then those of lines that share their probability.

    A pair is taken if its odds are not against it: with the rivals of both lines assigned, the choice is between this
    match and no partner for either. So equal lines are matched all the same, by position, then by line_id.
    """
    possible = beliefs.where(F.col("odds") >= LEAST_ODDS)
    free = cut_lineage(best_pairs(possible.where("NOT alone"), SURE))
    alone = possible.where("alone").withColumn("probability", F.round("probability", 6))
    sure = cut_lineage(alone.select(*MATCH).unionByName(free.where(F.col("belief") >= SURE).select(*MATCH)))
    # what is left: pairs that share their probability, and those that a third document speaks for
    shared = free.where(F.col("belief") < SURE).select("consignment_id", "a", "b", "da", "db", "odds")
    left = still_free(shared, sure) if not shared.isEmpty() else shared
    rest = third_party_pairs(sure).unionByName(left).groupBy("consignment_id", "a", "b", "da", "db").agg(F.max("odds").alias("odds"))
    again = cut_lineage(best_pairs(propagate(rest).where(F.col("odds") >= LEAST_ODDS)).select(*MATCH))
    if again.isEmpty():
        return sure
    matches = sure.unionByName(again)
    # what follows from the new matches, with those of their consignments
    near = cut_lineage(matches.join(again.select("consignment_id").distinct(), "consignment_id", "left_semi"))
    last = third_party_pairs(near)
    return matches if last.isEmpty() else matches.unionByName(best_pairs(propagate(last).where(F.col("odds") >= LEAST_ODDS)).select(*MATCH))


def match_lines(lines: DataFrame, lexicon: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(line_id_a, line_id_b, probability, converged) of the matched lines, smaller line_id first."""
    matches = assign(propagate(candidate_pairs(read_lines(lines, lexicon))))
    return matches.select(F.least("a", "b").alias("line_id_a"), F.greatest("a", "b").alias("line_id_b"), "probability", "converged")
