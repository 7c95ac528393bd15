"""Quantities in different units: each way of writing a measure, and the hard inputs."""

from decimal import Decimal

import pytest
from helpers import line_items, ref_values
from pyspark.sql import functions as F

from quayside.functions.numbers import printed_number
from quayside.operators import units


def converted(spark, data, *rows, **extra):
    listed = ref_values(spark, data).where("field = 'unit'")
    table = units.convert_measures(line_items(spark, *rows, **extra), listed)
    return {(r["line_id"], r["field"]): (r["unit"], r["common_unit"], r["amount"], r["recorded_in_common"]) for r in table.collect()}


@pytest.mark.parametrize(
    ("text", "unit", "want"),
    [
        ("12 MT", None, ("MT", "KG", 12000)), ("MT 12", None, ("MT", "KG", 12000)), ("1,5 kilo", None, ("KG", "KG", 1.5)), ("2 QTL", "KG", ("QTL", "KG", 200)),
        ("9 MT and 40 kg", None, ("MT", "KG", 9040)), ("3 dozen, 4 pieces", None, ("DOZ", "PC", 40)), ("twelve dozen", None, ("DOZ", "PC", 144)), ("one gross", None, ("GRO", "PC", 144)),
        ("1'250.5", "lbs.", ("LB", "KG", Decimal("567.217258685"))), ("100", "P1ECES", ("PC", "PC", 100)), ("7", "TONNUS", ("MT", "KG", 7000)), ("20", "square f0ot", ("FT2", "M2", Decimal("1.8580608"))),
        ("2 500", "ml", ("ML", "L", 2.5)), ("11 gr. of 144", None, ("GRO", "PC", 1584)), ("abt. 3 km", None, ("KM", "M", 3000)), ("5 (M2)", None, ("M2", "M2", 5)), ("12 ЅЕТ", None, ("SET", None, None)),
    ],
)
def test_measures(spark, data, text, unit, want):
    found = converted(spark, data, {"line_id": 1, "quantity": text, "unit": unit})[1, "quantity"]
    assert found[:2] == want[:2]
    assert found[2] is None if want[2] is None else abs(found[2] - Decimal(str(want[2]))) < Decimal("0.000001")


def test_unit_from_the_quote_and_gross_weight(spark, data):
    rows = [
        {"line_id": 1, "description": "Cable 2 core", "quantity": "400", "quote": "1 | Cable 2 core | 400 YARDS | USD | 3.00 | NT.WT 400 kg"},
        {"line_id": 2, "net_weight_kg": "0.3", "gross_weight_kg": "329.1"},
        {"line_id": 3, "net_weight_kg": "300", "gross_weight_kg": "329.1"},
        {"line_id": 4, "net_weight_kg": "500", "gross_weight_kg": "241", "quote": "4 x  7  NT.WT 500 lbs.  G/W 241 kg"},
        {"line_id": 5, "net_weight_kg": "300", "gross_weight_kg": "70"},
    ]
    found = converted(spark, data, *rows)
    assert found[1, "quantity"][0] == "YD" and found[2, "net_weight_kg"][0] == "MT" and found[4, "net_weight_kg"][0] == "LB"
    assert found[3, "net_weight_kg"] == ("KG", "KG", Decimal(300), True)
    assert found[5, "net_weight_kg"][0] == "KG"  # no unit of mass agrees with the gross weight


def test_cases_are_rounded_half_up(spark, data):
    listed = ref_values(spark, data).where("field = 'unit'")
    table = line_items(spark, {"line_id": 1, "quantity": "0.0005 kg", "net_weight_kg": "2.5 g"}, {"line_id": 2, "quantity": "2.0005 MT"}, {"line_id": 3, "quantity": "1.0005 L"})
    found = {(r["line_id"], r["field"]): r["amount_milli"] for r in units.found(units.convert_measures(table, listed)).collect()}
    assert found == {(1, "net_weight_kg"): 3, (2, "quantity"): 2_000_500}


def test_nulls_blanks_zeros_repeats_and_clashing_columns(spark, data):
    rows = [{"line_id": k, "quantity": q, "net_weight_kg": w} for k, (q, w) in enumerate([(None, None), ("", " "), ("0", "0.0"), ("n/a", "-"), ("x" * 50_000, "5 kg"), ("5 MT", None), ("5 MT", None)])]
    rows.append(rows[-1])
    found = converted(spark, data, *rows, alias="x", code="y", key="z", factor=3, a=1, texts="t")
    assert set(found) == {(4, "net_weight_kg"), (5, "quantity"), (6, "quantity")}
    listed = ref_values(spark, data).where("field = 'unit'")
    assert units.convert_measures(line_items(spark, *rows), listed).where("line_id = 6").count() == 2  # a row each
    assert units.convert_measures(line_items(spark), listed).count() == 0


def test_offsets_are_applied(spark):
    listed = spark.createDataFrame([("C", "celsius", "temperature", "K", "1", "273.15"), ("K", "kelvin", "temperature", "K", "1", "0")], "ref_value string, long_name string, kind string, common_unit string, factor string, offset string")
    listed = listed.withColumns({c: F.col(c).cast("decimal(20,12)") for c in ("factor", "offset")})
    found = units.convert_measures(line_items(spark, {"line_id": 1, "quantity": "20", "unit": "celsius"}), listed).first()
    assert found["amount"] == Decimal("293.15") and found["common_unit"] == "K"


@pytest.mark.parametrize(
    ("text", "want"),
    [("1.234,5", 1234.5), ("1,234.5", 1234.5), ("1,234", 1234), ("1,23", 1.23), ("1.234", 1.234), ("1 234", 1234), ("1'234.50", 1234.5), ("12,3456", 12.3456), ("1,234,567", 1234567), ("1.234.567", 1234567), ("x", None), ("", None)],
)
def test_printed_numbers(spark, text, want):
    found = spark.createDataFrame([(text,)], "t string").select(printed_number(F.col("t")).alias("n")).first()["n"]
    assert found is None if want is None else abs(float(found) - want) < 1e-9


@pytest.mark.parametrize(("a", "b", "want"), [("portugal", "potuagl", 2), ("bangladesh", "banlgaedsh", 2), ("slovenia", "slovakia", 2), ("pound", "puond", 1), ("a", "a", 0), ("metre", "mere", 1), ("kitten", "sitting", 3)])
def test_edit_distance(spark, a, b, want):
    from quayside.operators.edit_join import edit_distance, edit_distance_join

    pair = spark.createDataFrame([(a, b)], "a string, b string")
    assert pair.select(edit_distance(F.col("a"), F.col("b")).alias("d")).first()["d"] == want
    found = edit_distance_join(pair.select(F.col("a").alias("word")), "word", pair.select(F.col("b").alias("name")), "name").collect()
    assert [r["distance"] for r in found] == ([want] if want <= 2 else [])


def test_very_long_numbers_do_no_harm(spark, data):
    long = "1,1" * 40_000
    rows = [{"line_id": 1, "quantity": long, "net_weight_kg": long, "gross_weight_kg": long}, {"line_id": 2, "quantity": "5", "description": "x", "quote": f"1 x 5 MT net {long} kg"}, {"line_id": 3, "net_weight_kg": "5", "gross_weight_kg": long}]
    assert set(converted(spark, data, *rows)) == {(2, "quantity"), (3, "net_weight_kg")}


def test_padded_and_long_cells_are_read(spark, data):
    pad, note = " " * 300, " as agreed with the buyer" * 20
    rows = [{"line_id": 1, "quantity": f"{pad}12{pad}MT{pad}"}, {"line_id": 2, "net_weight_kg": f"5 kg{pad}", "gross_weight_kg": f"{pad}6"}, {"line_id": 3, "quantity": "7 MT" + note}, {"line_id": 4, "quantity": "0" * 90 + "5 MT"}]
    got = converted(spark, data, *rows)
    assert set(got) == {(1, "quantity"), (2, "net_weight_kg"), (3, "quantity"), (4, "quantity")}
    assert got[1, "quantity"][:3] == ("MT", "KG", 12000) and got[2, "net_weight_kg"][:3] == ("KG", "KG", 5) and got[4, "quantity"][2] == 5000
    texts = ["1" + " " * 100, "1,5" + " " * 100, "0." + "1" * 90, "1" * 100_000, "1.1" * 40_000]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(printed_number(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in found] == [1, Decimal("1.5"), Decimal("0.111111111111"), None, None]


def test_shuffled_repair_equals_broadcast_repair(spark, data, monkeypatch):
    listed = ref_values(spark, data).where("field = 'unit'")
    lines = spark.read.parquet(f"{data}/line_items.parquet")
    rows = lambda: sorted(map(tuple, units.found(units.convert_measures(lines, listed)).collect()))
    want = rows()
    monkeypatch.setattr(units, "BROADCAST_ROWS", 0)
    assert rows() == want and want


def test_small_and_large_figures(spark, data):
    got = units.convert_measures(line_items(spark, *[{"line_id": k, "quantity": q} for k, q in enumerate(["0.000004 MT", "99999999999999 MT", "3 MT and 40 kg", "5 MT" + " " * 9_990 + "only"])]), ref_values(spark, data).where("field = 'unit'")).collect()
    assert {r["line_id"]: r["amount_milli"] for r in got} == {0: 4, 1: None, 2: 3_040_000, 3: 5_000_000}


def test_long_lists_of_unit_texts_join_by_salted_shuffle(spark, data, monkeypatch):
    rows = [{"line_id": k, "quantity": f"{k + 1} kilogramm"} for k in range(40)] + [{"line_id": 99, "net_weight_kg": "2.5", "gross_weight_kg": "2600"}]
    monkeypatch.setattr(units, "BROADCAST_ROWS", 0)
    got = converted(spark, data, *rows)
    assert len(got) == 41 and got[99, "net_weight_kg"][:3] == ("MT", "KG", 2500) and all(got[k, "quantity"][0] == "KG" for k in range(40))
