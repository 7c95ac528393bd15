"""Schemas and fixed lists of the trade documents."""

from __future__ import annotations

from pyspark.sql import types as T

#: Documents in order of precedence, terms of trade, and the widths of text fields.
DOC_TYPES = ("invoice", "packing_list", "bill_of_lading")
INCOTERMS = ("EXW", "FOB", "CFR", "CIF", "CPT", "CIP", "DAP", "DDP", "FCA", "FAS")
CONFIDENCES = ("low", "medium", "high")
WIDTHS = {"description": 300, "unit": 30, "currency": 8, "origin": 40, "incoterm": 4, "quote": 800, "pct_code": 12, "heading_text": 500, "reasoning": 800}
NUMBERS = ("quantity", "unit_price", "value", "net_weight_kg", "gross_weight_kg")
MONEY, AMOUNT = T.DecimalType(20, 2), T.DecimalType(18, 4)


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


RAW_LINE = T.StructType(_strings("source_doc", "line_no", "description", "quantity", "unit", "unit_price", "currency", "value", "net_weight_kg", "gross_weight_kg", "origin", "incoterm", "page", "quote"))
CONSIGNMENT_FILE = T.StructType(
    _strings("_note", "reference", "importer_status", "fx_rate", "freight", "insurance")
    + [T.StructField("_meta", T.MapType(T.StringType(), T.StringType())), T.StructField("lines", T.ArrayType(RAW_LINE))]
)
TARIFF_FILE = T.StructType(_strings("pct_code", "description", "cd_rate", "chapter", "heading", "duty_type", "specific_duty_text"))
EXTRACTION_RECORD = T.StructType(_strings("doc_type", "sha256", "model", "created", "note") + [T.StructField("pages", T.IntegerType()), T.StructField("lines", T.ArrayType(RAW_LINE))])
