"""Free values to the canonical list."""

import pytest
from helpers import line_items, ref_values

from quayside.llm.canonical import canonical_values, found

ORIGIN = {
    "PRC": "China", "I R A Q": "Iraq", "iran.": "Iran", "Österreich": "Austria", "Australie": "Australia", "中国": "China", "Autria": "Austria", "Made in Viet Nam": "Vietnam", "CN-China": "China", "Niger NER": "Niger", "NGA": "Nigeria",
    "U.S.A.": "United States", "100% South Korae": "South Korea", "Slovak Rep.": "Slovakia", "United Kingdom of Great Britain and Nort": "United Kingdom", "Burma": "Myanmar", "R.O.K.": "South Korea",
    "Mali": None, "Algeria": None, "EU": None, "Austria / Russia": None, "Nigeria & Niger": None, "United Kingdom or Morocco": None, "ditto": None, "??": None, "United": None, "North Korea": None,
}
UNIT = {"Ctn's": "CTN", "K.G.": "KG", "P1ECES": "PC", "metri otn": "MT", "M/T": "MT", "sq. m": "M2", "FT²": "FT2", "25kg bags": "BAG", "gr. of 144": "GRO", "barrel": None, "see P/L": None, "carat": None, "-": None}
TERM = {"F O B": "FOB", "fob (Brenna Harbour)": "FOB", "Cost, Insur. & Freight": "CIF", "C & F": "CFR", "Incoterms 2020: Delivered At Place/Terminal B": "DAP", "Free no Bo@rd": "FOB", "DDU": None, "Delivered Duty Unpaid": None, "free of charge": None, "prepaid": None}


@pytest.fixture(scope="module")
def matched(spark, data):
    refs = ref_values(spark, data)
    names = {r["ref_id"]: r["ref_value"] for r in refs.collect()}
    rows = [{"line_id": k, f: v} for f, values in (("origin", ORIGIN), ("unit", UNIT), ("incoterm", TERM)) for k, v in enumerate(values)]
    rows += [{"line_id": 900, "origin": "China"}, {"line_id": 901, "origin": " ", "unit": ""}, {"line_id": 902, "origin": "made in " * 9_000}, {"line_id": 0, "origin": "PRC"}]
    table = line_items(spark, *rows, alias="a", ref_id=5, value=7, token="t", field="f") if False else line_items(spark, *rows, alias="a", ref_id=5, token="t", field="f")
    return table, refs, {(r["field"], r["value"]): names.get(r["ref_id"]) for r in canonical_values(table, refs).collect()}


@pytest.mark.parametrize(("field", "value", "want"), [(f, v, w) for f, values in (("origin", ORIGIN), ("unit", UNIT), ("incoterm", TERM)) for v, w in values.items()])
def test_values(matched, field, value, want):
    assert matched[2][field, value] == want


def test_cases(matched):
    rows = found(matched[0], matched[1]).collect()
    ids = sorted(r["line_id"] for r in rows if r["field"] == "origin")
    assert ids.count(0) == 2 and 900 not in ids and 901 not in ids and ids.count(902) == 1


def test_empty_tables(spark, data):
    refs = ref_values(spark, data)
    assert found(line_items(spark), refs).count() == 0
    assert {r["ref_id"] for r in canonical_values(line_items(spark, {"line_id": 1, "origin": "China"}), refs.limit(0)).collect()} == {0}


def test_salted_join_equals_broadcast_join(matched, monkeypatch):
    from quayside.llm import canonical

    rows = lambda: sorted((r["line_id"], r["field"], r["ref_id"]) for r in found(matched[0], matched[1]).collect())
    want = rows()
    monkeypatch.setattr(canonical, "BROADCAST_VALUES", 0)
    assert rows() == want and want
