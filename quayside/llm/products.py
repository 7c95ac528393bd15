"""Invoice lines of the same product, by a reference dictionary that is mined from the listings themselves.

Build-up: listings are read by patterns of measures and a lexicon of attribute spellings; brands, brand-model phrases
and the names of goods are mined from the words that remain (``phrases``). An Aho-Corasick automaton then finds the
phrases in every listing, the longest consistent match is chosen, and the remaining attributes are compared. What no
dictionary knows is part of the name, so that listings with different unread words stay apart unless the listings
themselves show that both name the same goods. No kind of goods is known beforehand.

Of copies (same consignment, document and line number) only the smallest line_id counts; totals and lines without a
description are no products. Null keys make a line its own. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm import listings
from quayside.llm.listings import misspelt_words, model_series, read_column, repaired_words, words_of
from quayside.llm.phrases import find_phrases, goods_of_names, mine_brands, mine_phrases
from quayside.session import cut_lineage

TOTALS = "^(?i:\\W*(?:grand |sub[- ]?)?totals?\\b|carried (?:forward|over)|brought forward|total of )"


def originals(lines: DataFrame, *columns: str) -> DataFrame:
    """The line with the smallest line_id of each (consignment_id, source_doc, line_no), with ``columns``."""
    keyed = lines.select("line_id", "consignment_id", "source_doc", "line_no", *columns)
    whole = F.col("consignment_id").isNotNull() & F.col("source_doc").isNotNull() & F.col("line_no").isNotNull()
    alone = F.when(~whole, F.col("line_id"))
    first = keyed.groupBy("consignment_id", "source_doc", "line_no", alone.alias("alone")).agg(F.min(F.struct("line_id", *columns)).alias("m") if not columns else F.min_by(F.struct("line_id", *columns), "line_id").alias("m"))
    return first.select("m.line_id", "consignment_id", "source_doc", "line_no", *[F.col(f"m.{c}").alias(c) for c in columns])


def described(lines: DataFrame) -> DataFrame:
    """The lines that describe goods: neither blank nor a total."""
    return lines.where(F.col("description").rlike("\\S") & ~F.col("description").rlike(TOTALS))


def read_listings(lines: DataFrame, lexicon: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """``lines`` with models, marks and rest in place of their description; read once and written down."""
    worded = cut_lineage(lines.withColumn("words", words_of(F.col("description"))).drop("description"))
    repairs, shared, series = misspelt_words(worded), {}, model_series(worded)
    if repairs.count() <= listings.SHARED_REPAIRS:
        shared = {r["word"]: r["right"] for r in repairs.collect()}
    else:
        worded = repaired_words(worded, repairs)
    read = worded.withColumn("r", read_column(lines, F.col("words"), series, shared, lexicon))
    return cut_lineage(read.select(*[c for c in worded.columns if c != "words"], "r.*"))


def product_lines(lines: DataFrame, lexicon: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(line_id, product): every invoice line that names a product, with the key of its product."""
    invoices = described(lines.where("source_doc = 'invoice'"))
    read = read_listings(originals(invoices, "description", "shipper_id"), lexicon)
    found = cut_lineage(find_phrases(read, mine_phrases(read, mine_brands(read))).select("line_id", "brand", "model", "marks", "name"))
    known = found.where("name <> '' OR brand <> '' OR marks <> '' OR model <> ''")
    goods = goods_of_names(known)
    named = known.join(F.broadcast(goods) if goods.count() <= FEW_NAMES else goods, "name")
    key = F.concat_ws("\u0001", "goods", "brand", "model", "marks")
    return named.select("line_id", F.md5(key).alias("product"))


#: So many names of goods at most are broadcast.
FEW_NAMES = 200_000


def product_groups(lines: DataFrame) -> DataFrame:
    """(line_id, group_id): membership of every product line; group_id is the smallest line_id of the product."""
    keyed = cut_lineage(product_lines(lines))
    return keyed.join(keyed.groupBy("product").agg(F.min("line_id").alias("group_id")), "product").select("line_id", "group_id")


def product_pairs(lines: DataFrame) -> DataFrame:
    """(line_id_a, line_id_b): all pairs of lines of one product, smaller line_id first.

    Lines of products that occur once are dropped before the join, by a count that is combined before the shuffle.
    """
    keyed = cut_lineage(product_lines(lines))
    several = keyed.groupBy("product").agg(F.count("*").alias("n")).where("n > 1").select("product")
    some = keyed.join(several, "product")
    a, b = some.withColumnRenamed("line_id", "line_id_a"), some.withColumnRenamed("line_id", "line_id_b")
    return a.join(b, "product").where("line_id_a < line_id_b").select("line_id_a", "line_id_b")
