"""Coercing projections: raw extracted rows to typed lines and classifications. Bad input degrades, it does not fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.numbers import decimal_lenient
from quayside.schemas import CONFIDENCES, DOC_TYPES, INCOTERMS, NUMBERS, WIDTHS


def _text(name: str) -> Column:
    return F.substring(F.trim(F.coalesce(F.col(name), F.lit(""))), 1, WIDTHS[name])


def coerce_lines(raw: DataFrame, *keep: str, position: Column | None = None) -> DataFrame:
    """Typed line items; rows without a description are dropped, ``keep`` columns are carried along.

    Unknown documents become invoice, a missing line number the row's ``position``, a bad page 1, numbers are read
    leniently with 0 for not stated, text is cut to its width, terms outside the list become blank. ``<number>_raw``
    keeps the printed figure.
    """
    code = F.upper(F.substring(F.trim(F.coalesce(F.col("incoterm"), F.lit(""))), 1, 4))
    number = F.col("line_no").try_cast("int")
    page = F.col("page").try_cast("double")
    typed = {
        "source_doc": F.when(F.col("source_doc").isin(*DOC_TYPES), F.col("source_doc")).otherwise(DOC_TYPES[0]),
        "line_no": F.when(number.isNull() | (number == 0), position if position is not None else F.lit(1)).otherwise(number),
        "description": _text("description"),
        **{n: decimal_lenient(F.col(n)) for n in NUMBERS},
        **{f"{n}_raw": F.trim(F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in NUMBERS},
        "unit": _text("unit"),
        "currency": F.upper(_text("currency")),
        "origin": _text("origin"),
        "incoterm": F.when(code.isin(*INCOTERMS), code).otherwise(""),
        "page": F.when(page.isNull() | F.isnan(page), 1).otherwise(F.greatest(F.lit(1), F.least(page, F.lit(1e9)).cast("int"))),
        "quote": _text("quote"),
    }
    return raw.where(F.trim("description") != "").select(*keep, *[c.alias(n) for n, c in typed.items()])


def coerce_classifications(raw: DataFrame, *keep: str) -> DataFrame:
    """Typed classifications: a known confidence or low, at most three alternatives, text cut to its width."""
    confidence = F.lower(F.trim(F.coalesce(F.col("confidence"), F.lit(""))))
    return raw.select(
        *keep, "line_no", _text("pct_code").alias("pct_code"), _text("heading_text").alias("heading_text"), _text("reasoning").alias("reasoning"),
        F.when(confidence.isin(*CONFIDENCES), confidence).otherwise("low").alias("confidence"),
        F.slice(F.filter(F.coalesce(F.col("alternatives"), F.array().cast(raw.schema["alternatives"].dataType)), lambda a: a.isNotNull()), 1, 3).alias("alternatives"),
        F.coalesce("confirmed_by_human", F.lit(False)).alias("confirmed_by_human"),
    )


def header_defaults(consignments: DataFrame) -> DataFrame:
    """The latest row of each consignment, with rate 1, amounts 0 and status commercial_filer where not stated."""
    latest = consignments.groupBy("consignment_id").agg(F.max_by(F.struct("reference", "shipper_id", "importer_status", "fx_rate", "freight", "insurance", "opened_at"), F.struct("updated_at", "opened_at", "reference")).alias("h"), F.max("updated_at").alias("updated_at"))
    status = F.nullif(F.trim(F.col("h.importer_status")), F.lit(""))
    return latest.select(
        "consignment_id", F.col("h.reference").alias("reference"), F.col("h.shipper_id").alias("shipper_id"), F.coalesce(status, F.lit("commercial_filer")).alias("importer_status"),
        F.coalesce(F.col("h.fx_rate"), F.lit(1)).cast("decimal(18,4)").alias("fx_rate"), F.coalesce(F.col("h.freight"), F.lit(0)).cast("decimal(18,2)").alias("freight"),
        F.coalesce(F.col("h.insurance"), F.lit(0)).cast("decimal(18,2)").alias("insurance"), F.col("h.opened_at").alias("opened_at"), "updated_at",
    )
