"""Comparing the three documents of matched lines field by field, and merging them into one line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.functions.numbers import decimal_lenient
from quayside.functions.scalars import country_key, shorten, unit_key
from quayside.schemas import DOC_TYPES, NUMBERS

#: Spread over the largest value below which two weights differ by an advisory only.
WEIGHT_TOLERANCE = "0.02"
LABELS = {"invoice": "invoice", "packing_list": "packing list", "bill_of_lading": "bill of lading"}
COMPARED = ("presence", "unit", "currency", *NUMBERS, "origin")
MERGED = ("quantity", "unit", "unit_price", "currency", "value", "net_weight_kg", "gross_weight_kg", "origin")
FIELDS = ("line_id", "line_no", "description", *NUMBERS, *[f"{n}_raw" for n in NUMBERS], "unit", "currency", "origin", "incoterm", "page", "quote")


def side_by_side(lines: DataFrame, groups: list[str]) -> DataFrame:
    """One row per group of matched lines with a struct per document, null where it has none."""
    one = F.struct(*[F.col(c) for c in FIELDS if c in lines.columns])
    of = lambda doc: F.min_by(F.when(F.col("source_doc") == doc, one), F.when(F.col("source_doc") == doc, F.col("line_id"))).alias(doc)
    return lines.groupBy(*groups).agg(*[of(d) for d in DOC_TYPES])


def _each(f) -> list[Column]:
    return [f(d) for d in DOC_TYPES]


def _distinct(texts: list[Column]) -> Column:
    return F.array_distinct(F.filter(F.array(*texts), lambda x: x.isNotNull() & (x != "")))


def _stated(name: str) -> Column:
    return F.filter(F.array(*_each(lambda d: F.col(f"{d}.{name}"))), lambda x: x.isNotNull() & (x != 0))


def _says(name: str, stated) -> Column:
    """What each document says: ``invoice says X; packing list says Y.``"""
    parts = [F.when(stated(d), F.concat(F.lit(f"{LABELS[d]} says "), F.col(f"{d}.{name}").cast("string"))) for d in DOC_TYPES]
    return F.concat(F.concat_ws("; ", *parts), F.lit("."))


def _values(name: str, stated) -> Column:
    """What the documents that state the field say, by document."""
    entries = F.array(*_each(lambda d: F.when(stated(d), F.struct(F.lit(d).alias("key"), F.col(f"{d}.{name}").cast("string").alias("value")))))
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))


def compare_documents(matched: DataFrame, keys: list[str]) -> DataFrame:
    """One row per field on which the documents of a matched line disagree: keys, rule_ord, field, severity, label, note, values.

    ``label`` names the line by the last of the keys and its shortened description.

    A document that lacks the line is blocking, the bill of lading only advisory and only if it lists any line. Units,
    currencies and origins differ after their spellings are made one; a difference in unit suppresses quantity, in
    currency unit price and value. Numbers are compared where two documents state them; weights within two percent are
    advisory. All is one pass of column expressions, without a join.
    """
    lists = F.max(F.col("bill_of_lading").isNotNull()).over(W.partitionBy(keys[0]))
    m = matched.withColumn("bl_lists", lists)
    units, currencies, origins = (
        _distinct(_each(lambda d: unit_key(F.col(f"{d}.unit")))),
        _distinct(_each(lambda d: F.upper(F.trim(F.col(f"{d}.currency"))))),
        _distinct(_each(lambda d: country_key(F.col(f"{d}.origin")))),
    )
    found: list[Column] = []

    def rule(order: int, field: str, condition: Column, severity: Column | str, note: Column, values: Column) -> None:
        item = F.struct(
            F.lit(order).alias("rule_ord"), F.lit(field).alias("field"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), note.alias("note"), values.alias("values")
        )
        found.append(F.when(condition, item))

    listed = F.map_from_entries(F.array(*_each(lambda d: F.struct(F.lit(d), F.when(F.col(d).isNotNull(), "yes").otherwise("no")))))
    for k, doc in enumerate(DOC_TYPES):
        advisory = doc == "bill_of_lading"
        rule(k, "presence", F.col(doc).isNull() & (F.col("bl_lists") if advisory else F.lit(True)), "advisory" if advisory else "blocking", F.lit(f"not on the {LABELS[doc]}"), listed)
    texted = lambda name: lambda d: F.trim(F.coalesce(F.col(f"{d}.{name}"), F.lit(""))) != ""
    rule(3, "unit", F.size(units) > 1, "blocking", _says("unit", texted("unit")), _values("unit", texted("unit")))
    rule(4, "currency", F.size(currencies) > 1, "blocking", _says("currency", texted("currency")), _values("currency", texted("currency")))
    for k, name in enumerate(NUMBERS):
        stated = _stated(name)
        low, high = F.array_min(stated), F.array_max(stated)
        differs = (F.size(stated) >= 2) & (low != high)
        if name == "quantity":
            differs = differs & (F.size(units) <= 1)
        if name in ("unit_price", "value"):
            differs = differs & (F.size(currencies) <= 1)
        severity: Column | str = "advisory" if name == "unit_price" else "blocking"
        given = lambda d, name=name: F.coalesce(F.col(f"{d}.{name}"), F.lit(0)) != 0
        note = _says(f"{name}_raw", given)
        if name.endswith("_kg"):
            close = (high > 0) & ((high - low) < high * F.lit(WEIGHT_TOLERANCE).cast("decimal(4,2)"))
            severity = F.when(close | (high < 0), "advisory").otherwise("blocking")
            note = F.concat(note, F.lit(" Spread "), F.bround((high - low).cast("double") * 100 / F.nullif(high, F.lit(0)).cast("double"), 2).cast("decimal(18,2)").cast("string"), F.lit("%."))
        rule(5 + k, name, differs, severity, note, _values(f"{name}_raw", given))
    rule(10, "origin", F.size(origins) > 1, "blocking", _says("origin", texted("origin")), _values("origin", texted("origin")))
    items = F.filter(F.array(*found), lambda x: x.isNotNull())
    description = F.coalesce(*_each(lambda d: F.col(f"{d}.description")))
    label = F.concat(F.lit("Line "), F.col(keys[-1]).cast("string"), F.lit(" ("), shorten(description), F.lit(")"))
    found_rows = m.select(*keys, label.alias("label"), F.inline(items))
    return found_rows.select(*keys, "rule_ord", "field", "severity", "label", "note", "values")


def presence(matched: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the names of the documents that lack the line, joined by commas; full groups are left out."""
    missing = F.concat_ws(",", *[F.when(F.col(d).isNull(), F.lit(d)) for d in DOC_TYPES])
    return matched.select(*keys, missing.alias("missing")).where("missing <> ''")


def merge_documents(matched: DataFrame, keys: list[str], resolutions: DataFrame | None = None) -> DataFrame:
    """One line per group: the first document's, its blanks filled from the others, resolutions put over them.

    ``resolutions`` has the keys, field and resolved_value; the last by ``rule_ord`` of a field wins. Numbers
    are read leniently, as everywhere; values are not computed anew from resolved ones.
    """
    base = F.coalesce(*[F.col(d) for d in DOC_TYPES])
    filled = {f: F.coalesce(*[F.nullif(F.col(f"{d}.{f}"), F.lit(0) if f in NUMBERS else F.lit("")) for d in DOC_TYPES], F.lit(0) if f in NUMBERS else F.lit("")) for f in MERGED}
    first = F.coalesce(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in DOC_TYPES])
    merged = matched.select(
        *keys, first.alias("source_doc"), base["description"].alias("description"), base["incoterm"].alias("incoterm"), base["page"].alias("page"), base["quote"].alias("quote"),
        *[c.cast("decimal(18,4)").alias(f) if f in NUMBERS else c.alias(f) for f, c in filled.items()],
    )
    if resolutions is None:
        return merged
    order = F.col("rule_ord") if "rule_ord" in resolutions.columns else F.lit(0)
    last = resolutions.where("resolved_value IS NOT NULL").groupBy(*keys).agg(*[F.max_by(F.when(F.col("field") == f, F.col("resolved_value")), F.when(F.col("field") == f, order)).alias(f"new_{f}") for f in MERGED])
    joined = merged.join(last, keys, "left")
    read = lambda f: F.when(F.col(f"new_{f}").isNotNull(), decimal_lenient(F.col(f"new_{f}"))) if f in NUMBERS else F.col(f"new_{f}")
    new = {f: F.coalesce(read(f), F.col(f)) for f in MERGED}
    return joined.withColumns(new).drop(*[f"new_{f}" for f in MERGED])


def documents_by_value(lines: DataFrame, keys: list[str], field: str) -> DataFrame:
    """keys, value and the documents that state it, in order of precedence, joined by commas."""
    rank = F.array_position(F.array(*[F.lit(d) for d in DOC_TYPES]), F.col("source_doc"))
    docs = F.transform(F.array_sort(F.collect_set(F.struct(rank.alias("rank"), "source_doc"))), lambda x: x["source_doc"])
    stated = lines.withColumn("value_", F.col(field).cast("string")).where("trim(value_) <> ''")
    return stated.groupBy(*keys, "value_").agg(F.array_join(docs, ",").alias("docs")).withColumnRenamed("value_", field)


def union_documents(*parts: DataFrame) -> DataFrame:
    """The lines of several documents as one table, by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
