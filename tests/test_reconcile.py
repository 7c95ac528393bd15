"""Comparison and merge of documents: the rules one by one."""

from decimal import Decimal

from helpers import line_items

from quayside.operators.coerce import coerce_lines
from quayside.operators.reconcile import compare_documents, documents_by_value, merge_documents, presence, side_by_side

KEYS = ["consignment_id", "line_no"]


def matched(spark, **docs):
    rows = []
    for k, (doc, fields) in enumerate(docs.items()):
        if fields is not None:
            rows.append({"line_id": k, "consignment_id": "C", "line_no": 1, "source_doc": doc, "description": "garlic", **fields})
    return side_by_side(coerce_lines(line_items(spark, *rows), "line_id", "consignment_id"), KEYS)


def differences(spark, a, b, c=None):
    found = compare_documents(matched(spark, invoice=a, packing_list=b, bill_of_lading=c), KEYS)
    return {r["field"]: (r["severity"], r["note"]) for r in found.collect() if r["field"] != "presence"}


def test_weights_within_two_percent_are_advisory(spark):
    for a, b, want in (("1000", "981", "advisory"), ("1000", "980", "blocking"), ("10000", "9801", "advisory"), ("1000", "970", "blocking")):
        assert differences(spark, {"net_weight_kg": a}, {"net_weight_kg": b})["net_weight_kg"][0] == want
    assert "1.67%" in differences(spark, {"net_weight_kg": "3000"}, {"net_weight_kg": "2950"})["net_weight_kg"][1]
    assert differences(spark, {"net_weight_kg": "3000"}, {"net_weight_kg": "3000.00"}) == {}


def test_units_and_currencies_suppress_what_depends_on_them(spark):
    assert differences(spark, {"unit": "BAGS", "quantity": "5"}, {"unit": "bag", "quantity": "5"}) == {}
    assert set(differences(spark, {"unit": "BAGS", "quantity": "5"}, {"unit": "KGS", "quantity": "6"})) == {"unit"}
    assert set(differences(spark, {"currency": "USD", "value": "5"}, {"currency": "PKR", "value": "6"})) == {"currency"}


def test_quantity_value_price_origin(spark):
    found = differences(spark, {"quantity": "150", "value": "5400", "unit_price": "36.00"}, {"quantity": "149", "value": "5364", "unit_price": "36.50"})
    assert {k: v[0] for k, v in found.items()} == {"quantity": "blocking", "value": "blocking", "unit_price": "advisory"}
    assert found["quantity"][1] == "invoice says 150; packing list says 149."
    assert set(differences(spark, {"origin": "China"}, {"origin": "Vietnam"}, {"origin": "P.R. CHINA"})) == {"origin"}
    assert differences(spark, {"origin": "China"}, {"origin": "CHINA"}, {"origin": "P.R. CHINA"}) == {}
    assert differences(spark, {"value": "5"}, {"value": "0"}, {"value": ""}) == {}


def test_presence(spark):
    m = matched(spark, invoice={}, packing_list=None, bill_of_lading=None)
    assert [(r["field"], r["severity"], r["rule_ord"]) for r in compare_documents(m, KEYS).collect()] == [("presence", "blocking", 1)]
    assert presence(m, KEYS).first()["missing"] == "packing_list,bill_of_lading"


def test_merge_fills_blanks_and_takes_resolutions(spark):
    m = matched(spark, invoice={"value": "13200", "quantity": "1200"}, packing_list={"net_weight_kg": "100", "origin": "China"}, bill_of_lading={"origin": "Iran"})
    resolutions = spark.createDataFrame([("C", 1, "quantity", "1180", 2), ("C", 1, "quantity", "1170", 1), ("C", 1, "value", None, 1)], "consignment_id string, line_no int, field string, resolved_value string, rule_ord int")
    r = merge_documents(m, KEYS, resolutions).first()
    assert (r["quantity"], r["value"], r["net_weight_kg"], r["origin"], r["source_doc"]) == (Decimal(1180), Decimal(13200), Decimal(100), "China", "invoice")


def test_documents_by_value_and_empty_tables(spark):
    lines = line_items(spark, *[{"line_id": k, "consignment_id": "C", "line_no": 1, "source_doc": d, "quantity": q} for k, (d, q) in enumerate([("packing_list", "5"), ("invoice", "5"), ("bill_of_lading", "6"), ("invoice", None)])])
    assert {(r["quantity"], r["docs"]) for r in documents_by_value(lines, KEYS, "quantity").collect()} == {("5", "invoice,packing_list"), ("6", "bill_of_lading")}
    empty = side_by_side(coerce_lines(line_items(spark), "line_id", "consignment_id"), KEYS)
    assert compare_documents(empty, KEYS).count() == merge_documents(empty, KEYS).count() == 0
