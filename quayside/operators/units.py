"""Quantities recorded in different units, brought to one common unit per kind: SQL expressions and joins only.

``units`` is the canonical list: ref_value, kind, common_unit, factor (common units in one unit); a column
``offset`` is added where the list has one. A unit's spelling is looked up in the fixed vocabulary, and a
misspelt one is repaired by the closest name within the allowed edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.numbers import NUMBER, printed_number
from quayside.functions.text import fold_lookalikes, squash, unleet
from quayside.functions.unit_names import unit_name_table
from quayside.operators.edit_join import edit_distance_join
from quayside.session import cut_lineage

#: Number words that stand before dozen and gross.
NUMBER_WORDS = {
    "a": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "hundred": 100,
}
WORDS = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
#: Net over gross weight of packed goods: nearly always, and at most.
NET_USUAL, NET_SHARE = (0.885, 0.993), (0.72, 1.005)


def unit_key(text: Column) -> Column:
    """The form in which unit names are compared: ``Carton(s)`` is cartons, ``m²`` is m2."""
    t = F.regexp_replace(F.regexp_replace(F.lower(fold_lookalikes(text)), "\\(s\\)", "s"), "²", "2")
    return F.when(text.rlike("^[A-Za-z0-9]+$"), F.lower(text)).otherwise(squash(t))


def vocabulary_of(units: DataFrame) -> DataFrame:
    """(alias, code): fixed names with those of the list itself; no-units have an empty code. Under 400 rows."""
    own = units.select(F.lower("ref_value").alias("alias"), "ref_value").union(units.select(squash(F.col("long_name")), "ref_value"))
    known = unit_name_table(units.sparkSession).join(F.broadcast(units.select("ref_value").distinct()), "ref_value", "left_semi")
    none = unit_name_table(units.sparkSession).where("ref_value = ''")
    return known.select("alias", "ref_value").union(none.select("alias", "ref_value")).union(own).dropna().groupBy("alias").agg(F.max("ref_value").alias("code"))


def repair_units(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(key, code) for each distinct unknown ``key``: the unit whose name is closest, where only one is closest.

    The distinct misspellings are written to the checkpoint folder once, so that the lines are not read for each use.
    """
    words = cut_lineage(unknown.select("key").distinct().withColumn("word", unleet(F.col("key"))))
    near = edit_distance_join(words, "word", vocabulary.where("code <> ''"), "alias").join(F.broadcast(vocabulary), "alias")
    per_unit = near.groupBy("word", "code").agg(F.min("distance").alias("distance"))
    best = per_unit.groupBy("word").agg(F.min_by("code", "distance").alias("code"), F.array_sort(F.collect_list("distance")).alias("d"))
    return cut_lineage(words.join(best.where("size(d) = 1 OR d[1] > d[0]"), "word").select("key", F.col("code").alias("repaired")))


#: A table of up to so many short rows, counted before, is broadcast: some 10 MB at most.
BROADCAST_ROWS = 100_000


#: Copies of a table that is too long to broadcast, so that the rows of one hot key go to as many tasks.
SALTS = 32


def join_counted(df: DataFrame, key: str, small: DataFrame, spread: str) -> DataFrame:
    """Left join on ``key``: by broadcast if ``small``, which is counted, is short, else by shuffle, salted by ``spread``."""
    if small.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), key, "left")
    copies = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(copies, [key, "salt_"], "left").drop("salt_")


def clean_measure(text: Column) -> Column:
    """The printed measure without disguise, without about, equals and only, null where blank."""
    t = F.trim(F.regexp_replace(fold_lookalikes(text), "\\s+", " "))
    t = F.trim(F.regexp_replace(t, "^(?:(?i:abt\\.?|about|approx\\.?|ca\\.?)(?=[\\s0-9])|=|~)\\s*|\\s+(?i:only)$", ""))
    return F.when(text.rlike("^[0-9][0-9.,]*$"), text).otherwise(F.nullif(t, F.lit("")))


TWO = f"^({NUMBER})\\s*(\\p{{L}}[\\p{{L}}0-9@$./ ]*?)(?:\\s+(?i:and)\\s+|\\s*[+,&]\\s*|\\s+)({NUMBER})\\s*(\\p{{L}}[\\p{{L}}0-9@$./]*)$"
OF_144 = f"^(?i:(gr\\.? of 144|gross \\(144\\)))\\s+({NUMBER})$"
UNIT_FIRST = f"^([(]?(?:[\\p{{L}}']|[0-9]+\\p{{L}}).*?)\\s+({NUMBER})$"
NUMBER_FIRST = f"^({NUMBER})\\s*-?\\s*(\\S.*)$"
IN_WORDS = f"^(?i:({WORDS}))\\s+(\\p{{L}}[\\p{{L}} ]*)$"


def split_measure(t: Column) -> Column:
    """A cleaned measure as struct(n1, u1, n2, u2): numbers as printed, unit texts, the second pair for sums.

    Number first (``9 MT``), unit first (``MT 9``), number words (``twelve dozen``), and two units together
    (``9 MT and 40 kg``) are read; null for text without a number.
    """
    none = F.lit(None).cast("string")
    words = F.create_map(*[F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, str(v))])

    def pair(n: Column, u: Column, n2: Column = none, u2: Column = none) -> Column:
        unit = F.nullif(F.trim(F.regexp_replace(u, "^[(](.*)[)]$", "$1")), F.lit(""))
        return F.struct(n.alias("n1"), unit.alias("u1"), n2.alias("n2"), u2.alias("u2"))

    def group(pattern: str, *ks: int) -> list[Column]:
        return [F.regexp_extract(t, pattern, k) for k in ks]

    return (
        F.when(t.rlike(f"^{NUMBER}$"), pair(t, none))
        .when(t.rlike(TWO), pair(*group(TWO, 1, 2, 3, 4)))
        .when(t.rlike(OF_144), pair(*group(OF_144, 2, 1)))
        .when(t.rlike(UNIT_FIRST) & ~t.rlike("(?i)of 144$"), pair(*group(UNIT_FIRST, 2, 1)))
        .when(t.rlike(NUMBER_FIRST), pair(*group(NUMBER_FIRST, 1, 2)))
        .when(t.rlike(IN_WORDS), pair(F.element_at(words, F.lower(F.regexp_extract(t, IN_WORDS, 1))), F.regexp_extract(t, IN_WORDS, 2)))
    )


def first_words(text: Column) -> Column:
    """The first three, two and one words of a text, longest first, up to a mark, a number or a currency."""
    stop = "(?:\\s{2,}|[\\t|]|\\s(?:NT\\.WT|N/W|G/W|net|(?i:USD|EUR|CNY|PKR|AED|GBP|JPY|INR))\\b|\\s[0-9]).*$"
    words = F.split(F.trim(F.regexp_replace(text, stop, "")), " +")
    return F.filter(
        F.transform(F.array(F.lit(3), F.lit(2), F.lit(1)), lambda n: F.when(F.size(words) >= n, F.array_join(F.slice(words, 1, n), " "))),
        lambda x: x.isNotNull() & (x != ""),
    )


NET_IN_QUOTE = f"(?:NT\\.WT|N/W|\\bnet)\\s+{NUMBER}\\s*(.*)$"


def staged(df: DataFrame, *columns: Column) -> DataFrame:
    """``df.select(*columns)`` evaluated once: later steps use the values and do not repeat their expressions."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def measures(lines: DataFrame) -> DataFrame:
    """One row per stated quantity and net weight: line_id, field, n1, n2, gross, texts.

    ``texts`` holds the unit texts in order of preference as struct(part, rank, text): what stands with the value,
    else the unit field (quantity only), else what the quote prints beside the value.
    """
    cell = lambda field, value, unit, gross: F.struct(F.lit(field).alias("field"), value.alias("value"), unit.alias("unit"), gross.alias("gross"))
    none = F.lit(None).cast("string")
    cells = lines.select(
        "line_id", "description", "quote",
        F.inline(F.array(cell("quantity", F.col("quantity"), F.col("unit"), none), cell("net_weight_kg", F.col("net_weight_kg"), none, F.col("gross_weight_kg")))),
    )
    cells = cells.where("trim(value) <> ''")
    carried = ["line_id", "field", "description", "quote", "unit", "gross"]
    cells = staged(cells, *[F.col(c) for c in carried], clean_measure(F.col("value")).alias("value"))
    cells = staged(cells, *[F.col(c) for c in carried], split_measure(F.col("value")).alias("s")).where("s.n1 IS NOT NULL")
    text = lambda part, rank, c: F.struct(F.lit(part).alias("part"), F.lit(rank).alias("rank"), c.alias("text"))
    kept = [F.col(c) for c in ("line_id", "field", "s", "unit", "gross")]
    bare = F.col("s.u1").isNull() & ~F.coalesce(F.col("unit").rlike("\\p{L}"), F.lit(False))
    quantity = F.col("field") == "quantity"
    cells = staged(cells, *kept, F.when(bare, fold_lookalikes(F.col("quote"))).alias("quote"), F.when(bare & quantity, fold_lookalikes(F.col("description"))).alias("d"))
    # what follows the description, set between two spaces, and the quantity set likewise
    tail = F.when((F.length("d") > 0) & F.col("quote").contains(F.col("d")), F.call_function("substring_index", "quote", "d", F.lit(-1))).otherwise(F.col("quote"))
    parts = F.when(quantity, F.concat(F.lit(" "), F.regexp_replace(tail, "[\\t|]", "  "), F.lit("  ")))
    cells = staged(cells, *kept, F.col("quote"), parts.alias("parts"), F.concat(F.lit(" "), F.col("s.n1"), F.lit(" ")).alias("number"))
    at = F.call_function("locate", "number", "parts")
    net = F.when(F.col("quote").rlike("NT\\.WT|N/W|net"), F.regexp_extract("quote", NET_IN_QUOTE, 1))
    behind = F.when(quantity, F.when(at > 0, F.call_function("substr", "parts", at + F.length("number")))).otherwise(net)
    cells = staged(cells, *kept, behind.alias("behind"))
    return cells.select(
        "line_id", "field", F.col("s.n1").alias("n1"), F.col("s.n2").alias("n2"), F.when(F.col("field") != "quantity", clean_measure(F.col("gross"))).alias("gross"),
        F.when(F.col("s.n2").isNotNull(), F.array(text(1, 0, F.col("s.u1")), text(2, 0, F.col("s.u2"))))
        .when(F.col("s.u1").isNotNull(), F.array(text(1, 0, F.col("s.u1"))))
        .when(F.col("behind").isNull(), F.array(text(1, 0, F.col("unit"))))
        .otherwise(F.transform(first_words(F.col("behind")), lambda x, k: F.struct(F.lit(1).alias("part"), (k + 2).alias("rank"), x.alias("text")))).alias("texts"),
    )


def resolve_texts(texts: DataFrame, units: DataFrame) -> DataFrame:
    """(texts, u1, u2) of each distinct array of unit texts: the unit that the first known text of each part names."""
    vocabulary = vocabulary_of(units)
    each = texts.select("texts", F.explode("texts").alias("x")).withColumn("key", unit_key(F.col("x.text")))
    looked_up = cut_lineage(each.join(F.broadcast(vocabulary), F.col("key") == F.col("alias"), "left").drop("alias"))
    repaired = repair_units(looked_up.where("code IS NULL AND key <> ''"), vocabulary)
    spelt = join_counted(looked_up, "key", repaired, "texts")
    code = F.nullif(F.coalesce("code", "repaired"), F.lit(""))
    rank = F.col("x.rank") + F.when(F.col("code").isNull(), 10).otherwise(0)
    per_part = lambda k: F.min(F.when((F.col("x.part") == k) & code.isNotNull(), F.struct(rank, code)))["col2"]
    return spelt.groupBy("texts").agg(per_part(1).alias("u1"), per_part(2).alias("u2"))


#: Decimals of a converted amount, and how a figure, a factor and a shift are held while they are multiplied.
FIGURE, FACTOR, AMOUNT = "decimal(38,12)", "decimal(20,12)", "decimal(38,9)"


def _times(figure: Column, factor: Column) -> Column:
    """figure times factor; null where the product has too many digits, so that one figure fails no job."""
    return F.try_multiply(figure, factor).try_cast(AMOUNT)


def convert_measures(lines: DataFrame, units: DataFrame) -> DataFrame:
    """All stated quantities and net weights in the common unit of their kind.

    Result: line_id, field, unit (ref_value, null where unknown), common_unit, amount (common units), amount_milli
    (thousandths, rounded half up once, null beyond the range of a long), recorded_in_common (whether it was in that
    unit as one figure). A value of zero is not stated; null, blank and unreadable values give no row, cells of any
    length are read; repeated rows give one row each; an empty table gives none. A weight with no unit is in kilograms
    unless the gross weight, always in kilograms, shows another unit of mass.

    The lines are read once and their figures written with the texts of their units; the distinct texts are resolved
    and joined back.
    """
    units = units.where("kind IS NOT NULL")
    offset = F.col("offset") if "offset" in units.columns else F.lit(0)
    units = units.select("ref_value", "long_name", "kind", "common_unit", F.col("factor").cast(FACTOR).alias("factor"), offset.cast(FACTOR).alias("shift"))
    numbers = [printed_number(F.col(c)).alias(n) for c, n in (("n1", "a"), ("n2", "b"), ("gross", "gross"))]
    stated = cut_lineage(staged(measures(lines), F.col("line_id"), F.col("field"), F.col("texts"), *numbers).where("a > 0 OR b > 0"))
    known = cut_lineage(resolve_texts(stated.select("texts").distinct(), units))
    resolved = join_counted(stated, "texts", known, "line_id").drop("texts")
    factors = F.broadcast(units)
    one = factors.select(F.col("ref_value").alias("u1"), F.col("common_unit").alias("common_1"), F.col("factor").alias("f1"), F.col("shift").alias("s1"))
    two = factors.select(F.col("ref_value").alias("u2"), F.col("common_unit").alias("common_2"), F.col("factor").alias("f2"))
    bare = (F.col("field") == "net_weight_kg") & F.col("u1").isNull() & F.col("b").isNull()
    guessed = resolved.withColumn("masses", masses(units)).withColumn("u1", F.when(bare, unit_of_weight(F.col("a"), F.col("gross"), F.col("masses"))).otherwise(F.col("u1")))
    joined = guessed.join(F.broadcast(one), "u1", "left").join(F.broadcast(two), "u2", "left")
    sound = F.col("common_1").isNotNull() & (F.col("b").isNull() | (F.col("common_1") == F.col("common_2")))

    def total(scale: int, factor: str) -> Column:
        """The sum of both figures, factors and shift multiplied by ``scale``."""
        by = lambda c: (F.col(c) * scale).cast(factor)
        second = F.when(F.col("b").isNull(), F.lit(0).cast(AMOUNT)).otherwise(_times(F.col("b"), by("f2")))
        return F.when(sound, F.try_add(F.try_add(_times(F.col("a"), by("f1")), by("s1")), second))

    return joined.select(
        "line_id", "field", F.col("u1").alias("unit"), F.when(sound, F.col("common_1")).alias("common_unit"), total(1, FACTOR).alias("amount"),
        F.round(total(1000, "decimal(24,9)"), 0).try_cast("bigint").alias("amount_milli"), (F.col("b").isNull() & (F.col("u1") == F.col("common_1"))).alias("recorded_in_common"),
    )


#: The unit in which a bare net weight is unless it cannot be.
USUAL_MASS = "KG"


def masses(units: DataFrame) -> Column:
    """The other units of mass of the list in order of their names, with the usual ones in one of each: one value."""
    usual = units.where(F.col("ref_value") == USUAL_MASS).select("common_unit", F.col("factor").alias("usual"))
    others = units.where(F.col("ref_value") != USUAL_MASS).join(usual, "common_unit").select("ref_value", (F.col("factor").cast("double") / F.col("usual").cast("double")).alias("each"))
    return others.agg(F.array_sort(F.collect_list(F.struct("ref_value", "each")))).scalar()


def unit_of_weight(net: Column, gross: Column, others: Column) -> Column:
    """The unit of a bare net weight: kilograms, unless only another unit of mass agrees with the gross weight."""
    share = net.cast("double") / F.nullif(gross, F.lit(0)).cast("double")
    fits = lambda span: F.filter(others, lambda m: (share * m["each"]).between(*span))
    first = lambda span: F.get(fits(span), F.lit(0))["ref_value"]
    other = F.coalesce(first(NET_USUAL), first(NET_SHARE))
    return F.when((gross > 0) & ~share.between(*NET_SHARE), F.coalesce(other, F.lit(USUAL_MASS))).otherwise(USUAL_MASS)


def found(converted: DataFrame) -> DataFrame:
    """The values recorded in another unit than the common one, in thousandths of it, rounded half up."""
    return converted.where("common_unit IS NOT NULL AND NOT recorded_in_common").select("line_id", "field", "common_unit", "amount_milli")
