"""The tariff table: from the cells of its pages to rows, lookup by code, and search.

The tariff is a reference table of some thousand rows with a proven bound (eight-digit codes), so it is broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.functions.scalars import candidate_words, dash_depth, own_text, rate_kind, specific_text, tariff_code, undashed
from quayside.session import cut_lineage


def classify_cells(cells: DataFrame) -> DataFrame:
    """``cells`` (page, row_no, code, descr, rate) with kind: what a printed row of the tariff is."""
    code, text, rate = (F.coalesce(F.trim(F.col(c)), F.lit("")) for c in ("code", "descr", "rate"))
    stray = (code != "") & ~code.rlike("[0-9]")
    bare = F.when(stray, "").otherwise(code)
    kind = (
        F.when((code == "") & (text == "") & (rate == ""), "empty")
        .when(code == "PCT CODE", "header")
        .when(code.rlike("^99[0-9]{2}$"), "concession")
        .when(bare.rlike("^\\[[0-9]{2}\\.[0-9]{2}\\]$"), "deleted")
        .when(bare.rlike("^[0-9]{2}\\.[0-9]{2}$"), "heading")
        .when(bare.rlike("^[0-9]{4}\\.[0-9]{4}$"), "line")
        .when(bare != "", "bad_code")
        .when(rate != "", "rate_only")
        .when(dash_depth(F.col("descr")) > 0, "subheading")
        .when(text.rlike("^[IVX]+\\s*[.\\-]") & (F.upper(text) == text), "subchapter")
        .otherwise("continuation")
    )
    return cells.withColumns({"kind": kind, "stray": stray})


def parse_cells(cells: DataFrame, document: str = "tariff") -> tuple[DataFrame, DataFrame]:
    """(tariff rows, rejected rows) of the printed cells.

    Everything ordered is a window: the open heading is filled forward, which cuts the table into segments; inside a
    segment the open subheadings are those not followed by a shallower one, at any depth, and text without a code
    belongs to the accepted line above it, else to the innermost open subheading; a rejected line takes none. A tariff
    is one printed document, a bounded table; several are told apart by the column ``document``.
    """
    keyed = cells if document in cells.columns else cells.withColumn(document, F.lit(1))
    order = W.partitionBy(document).orderBy("page", "row_no")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    c = classify_cells(keyed).withColumn("ord", F.row_number().over(order))
    # after the first concession entry only eight-digit lines count
    c = c.withColumn("closed", F.max((F.col("kind") == "concession").cast("int")).over(upto))
    c = c.where("kind NOT IN ('empty', 'header', 'deleted', 'subchapter') AND (closed = 0 OR kind IN ('line', 'concession'))")
    digits = F.col("code")
    of_line = F.concat_ws(".", F.substring(digits, 1, 2), F.substring(digits, 3, 2))
    alone = (F.col("kind") == "line") & digits.endswith("0000") & (dash_depth(F.col("descr")) == 0)
    heading = F.when(F.col("kind") == "heading", F.trim("code"))
    c = c.withColumn("own_heading", heading).withColumn("open_before", F.last("own_heading", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    # a heading with a single line is printed as one row and opens itself
    opens = F.coalesce(heading, F.when(alone & (F.col("rate") != "") & ~(F.coalesce(F.col("open_before"), F.lit("")) == of_line), of_line))
    c = c.withColumn("opens", opens).withColumn("segment", F.sum(F.col("opens").isNotNull().cast("int")).over(upto)).withColumn("open_heading", F.last("opens", ignorenulls=True).over(upto))
    inside = W.partitionBy(document, "segment").orderBy("ord")
    sofar = inside.rowsBetween(W.unboundedPreceding, 0)
    # text without a code is joined to the line or subheading that is open; a rejected line closes its own
    text = undashed(F.col("descr"))
    kind = rate_kind(F.col("rate"))
    reject = (
        F.when(F.col("kind") == "concession", "concession entry")
        .when(F.col("kind") == "bad_code", "no code in the code column")
        .when(F.col("kind") == "rate_only", "rate without code")
        .when((F.col("kind") == "heading") & (F.coalesce(F.trim("rate"), F.lit("")) != ""), "rate beside a heading")
        .when((F.col("kind") == "line") & (kind == "none"), "line without rate")
        .when((F.col("kind") == "line") & (kind == "unknown"), "unreadable rate")
        .when((F.col("kind") == "line") & (text == ""), "line without text")
        .when((F.col("kind") == "line") & (F.coalesce(F.col("open_heading"), F.lit("")) != of_line), "line outside its heading")
    )
    c = c.withColumns({"reject": reject, "depth": dash_depth(F.col("descr")), "text": text})
    # what the next text without a code belongs to: an accepted line, or 0 for the subheading that is open
    owner = F.when((F.col("kind") == "line") & F.col("reject").isNull(), F.col("ord")).when(F.col("kind").isin("line", "subheading"), 0)
    c = c.withColumn("owner", F.coalesce(F.last(owner, ignorenulls=True).over(sofar), F.lit(0)))
    wrapped = F.col("kind") == "continuation"
    more = c.where(wrapped & (F.col("owner") > 0)).groupBy(document, "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("more"))
    # the open subheadings of a row: each one closes those as deep or deeper, wrapped text lengthens the innermost
    event = F.when(F.col("kind") == "subheading", F.struct("depth", "text")).when(wrapped & (F.col("owner") == 0), F.struct(F.lit(-1).alias("depth"), "text"))
    c = c.withColumn("events", F.collect_list(event).over(sofar))
    top = lambda stack: F.element_at(stack, -1)
    longer = lambda stack, e: F.concat(F.slice(stack, 1, F.size(stack) - 1), F.array(F.struct(top(stack)["depth"].alias("depth"), F.concat_ws(" ", top(stack)["text"], e["text"]).alias("text"))))
    step = lambda stack, e: F.when(e["depth"] >= 0, F.array_append(F.filter(stack, lambda x: x["depth"] < e["depth"]), e)).when(F.size(stack) > 0, longer(stack, e)).otherwise(stack)
    stack = F.aggregate("events", F.array().cast("array<struct<depth:int,text:string>>"), step)
    c = c.withColumn("parents", F.transform(F.filter(stack, lambda x: (F.col("depth") == 0) | (x["depth"] < F.col("depth"))), lambda x: x["text"])).drop("events")
    c = c.where(~wrapped).join(more.withColumnRenamed("owner", "ord"), [document, "ord"], "left").withColumn("text", F.concat_ws(" ", "text", "more"))
    heading_text = F.first(F.when((F.col("kind") == "heading") | F.col("opens").isNotNull(), F.col("text")), ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    c = c.withColumn("heading_text", heading_text)
    path = F.when(F.col("opens").isNotNull(), F.col("text")).otherwise(F.concat_ws(" > ", F.array(F.col("heading_text")), F.col("parents"), F.array(F.col("text"))))
    lines = c.where("kind = 'line' AND reject IS NULL")
    rows = lines.select(
        F.col("code").alias("pct_code"), path.alias("description"), F.when(rate_kind(F.col("rate")) == "ad_valorem", F.replace("rate", F.lit(" "), F.lit(""))).otherwise("").alias("cd_rate"),
        F.substring("code", 1, 2).alias("chapter"), F.col("open_heading").alias("heading"), rate_kind(F.col("rate")).alias("duty_type"),
        F.when(rate_kind(F.col("rate")) == "specific", specific_text(F.col("rate"))).otherwise("").alias("specific_duty_text"), F.col("ord").cast("int").alias("ord"),
    )
    return rows, c.where("reject IS NOT NULL").select("page", "row_no", "code", "reject")


def summarise(tariff: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """One row: rows, specific rows, distinct codes, chapters in order, codes that occur twice."""
    per_code = tariff.groupBy("pct_code").agg(F.count("*").alias("n"), F.sum((F.col("duty_type") == "specific").cast("int")).alias("n_specific"), F.first("chapter").alias("chapter"))
    out = per_code.agg(
        F.sum("n").alias("n_rows"), F.sum("n_specific").alias("n_specific"), F.count("*").alias("n_codes"), F.array_join(F.array_sort(F.collect_set("chapter")), ",").alias("chapters"),
        F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated"),
    )
    return out if rejected is None else out.crossJoin(rejected.agg(F.count("*").alias("n_rejected")))


def build(cells: DataFrame, folder: str) -> DataFrame:
    """Write the tariff of printed cells to ``folder``: the table, and the report of what was left out; the summary is returned.

    ``table`` holds the accepted rows in their order, ``report`` the rejected ones with page, code and reason.
    """
    rows, rejected = (cut_lineage(df) for df in parse_cells(cells))
    rows.orderBy("ord").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/table")  # one bounded table
    rejected.orderBy("page", "row_no").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/report")
    return summarise(rows, rejected)


def lookup(rows: DataFrame, code: str, tariff: DataFrame) -> DataFrame:
    """``rows`` with the tariff row of their code in any spelling; nulls where there is none. The last of twins wins."""
    columns = [c for c in tariff.columns if c not in ("pct_code", "ord")]
    unique = tariff.groupBy("pct_code").agg(F.max_by(F.struct(*columns), "ord").alias("t")).select(F.col("pct_code").alias("tariff_code"), *[F.col(f"t.{c}").alias(f"tariff_{c}") for c in columns])
    return rows.join(F.broadcast(unique), tariff_code(F.col(code)) == F.col("tariff_code"), "left")


def cd_fraction(tariff: DataFrame) -> DataFrame:
    """``tariff`` with the rate as a fraction, null for specific duties, and rate_status."""
    fraction = (F.col("cd_rate").try_cast("decimal(9,4)") / 100).cast("decimal(9,6)")
    return tariff.withColumns({"cd_fraction": F.when(F.col("duty_type") == "ad_valorem", fraction), "rate_status": F.when(F.col("duty_type") == "specific", "specific").when(fraction.isNotNull(), "ad_valorem").otherwise("missing")})


def search(tariff: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Rows that hold every word of ``text``; hits in the row's own text first, then short descriptions, then the code.

    A text of digits, points and spaces is a code or the beginning of one: rows in their printed order. A text without
    a letter or digit finds nothing.
    """
    query = (text or "").strip().lower()
    digits = re.sub("[^0-9]", "", query)
    if digits and re.fullmatch(r"[0-9.\s]+", query):
        return tariff.where(F.replace("pct_code", F.lit("."), F.lit("")).startswith(digits)).orderBy("ord").limit(limit)
    terms = sorted(set(re.findall("[a-z0-9]+", query)))
    if not terms:
        return tariff.limit(0)
    description = F.lower("description")
    hit = lambda c: sum((c.contains(t).cast("int") for t in terms), F.lit(0))
    found = tariff.where(hit(description) == len(terms))
    return found.orderBy(hit(own_text(description)).desc(), F.length("description"), "pct_code").limit(limit)


def candidates(rows: DataFrame, key: str, description: str, tariff: DataFrame, limit: int = 15, per_word: int = 200) -> DataFrame:
    """The ``limit`` tariff rows that share the most words with each description: key, rank, pct_code, words, own_words.

    Words are matched once per distinct word, not per row; each word's hits are cut to the first ``per_word`` of its
    own search order, as the ranking defines. The tariff side of the containment join is broadcast: it is bounded.
    """
    words = rows.select(key, F.explode(candidate_words(F.col(description))).alias("word"))
    t = tariff.select("pct_code", F.lower("description").alias("d"))
    hits = words.select("word").distinct().join(F.broadcast(t), F.expr("contains(d, word)")).withColumn("own", own_text(F.col("d")).contains(F.col("word")).cast("int"))
    order = W.partitionBy("word").orderBy(F.desc("own"), F.length("d"), "pct_code")
    hits = hits.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_word).select("word", "pct_code", "own")
    counted = words.join(hits, "word").groupBy(key, "pct_code").agg(F.count("*").alias("words"), F.sum("own").alias("own_words"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("words"), F.desc("own_words"), "pct_code"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= limit)


def with_kept(found: DataFrame, kept: DataFrame, key: list[str]) -> DataFrame:
    """``found`` and those rows of ``kept`` that it lacks."""
    return found.unionByName(kept.join(found.select(*key), key, "left_anti"), allowMissingColumns=True)
