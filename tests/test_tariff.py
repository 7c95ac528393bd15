"""The tariff: cells of every kind, lookup, search and candidates."""

import pytest

from quayside.operators import tariff

CELLS = [
    (1, 1, "PCT CODE", "DESCRIPTION", "CD %"),
    (1, 2, "01.05", "Live poultry", ""),
    (1, 3, "", "- Of a weight not exceeding 185 g", ""),
    (1, 4, "", "- - Fowls", ""),
    (1, 5, "0105.1100", "- - - Day old chicks", "3"),
    (1, 6, "", "(1) of breeding stock", ""),
    (1, 7, "", "- Other", ""),
    (1, 8, "0105.9400", "- - Fowls of the species", "5"),
    (1, 9, "0105.9900", "- - Other birds", ""),
    (1, 10, "", "tail of a rejected line", ""),
    (1, 11, "0105.9910", "- - Rare birds", "Rs. 105 50/ MT"),
    (1, 12, "0105.9920", "- - Odd birds", "free"),
    (2, 1, "[05.03]", "Deleted", ""),
    (2, 2, "0205.0000", "Meat of horses", "20"),
    (2, 3, "11.02", "Flour", ""),
    (2, 4, "1103.1100", "- Groats", "5"),
    (2, 5, "`", "", "7"),
    (2, 6, "", "II.- INORGANIC ACIDS", ""),
    (2, 7, "9901", "Concession", "0"),
    (2, 8, "", "dropped after the concession", ""),
    (2, 9, "1102.2000", "- Maize flour", "10"),
]
CELLS = CELLS[:13] + [(1, 20, "11.02", "Flour", "")] + [(1, 20 + d, "", "- " * d + f"Level {d}", "") for d in range(1, 13)] + [(1, 40, "1102.3000", "- " * 13 + "Deep", "1")] + CELLS[13:]


@pytest.fixture(scope="module")
def parsed(spark):
    cells = spark.createDataFrame(CELLS, "page int, row_no int, code string, descr string, rate string")
    rows, rejected = tariff.parse_cells(cells)
    return {r["pct_code"]: r for r in rows.collect()}, {(r["code"] or r["row_no"]): r["reject"] for r in rejected.collect()}


def test_paths(parsed):
    rows, _ = parsed
    assert rows["0105.1100"]["description"] == "Live poultry > Of a weight not exceeding 185 g > Fowls > Day old chicks (1) of breeding stock"
    assert rows["0105.9400"]["description"] == "Live poultry > Other > Fowls of the species"
    assert rows["0205.0000"]["description"] == "Meat of horses" and rows["0205.0000"]["heading"] == "02.05"
    assert rows["1102.2000"]["description"] == "Flour > Maize flour"
    assert rows["0105.9910"]["description"] == "Live poultry > Other tail of a rejected line > Rare birds"
    assert rows["1102.3000"]["description"] == "Flour > " + " > ".join(f"Level {d}" for d in range(1, 13)) + " > Deep"
    assert set(rows) == {"1102.3000", "0105.1100", "0105.9400", "0105.9910", "0205.0000", "1102.2000"}


def test_rates_and_rejects(parsed):
    rows, rejected = parsed
    assert (rows["0105.9910"]["specific_duty_text"], rows["0105.9910"]["cd_rate"], rows["0105.9910"]["duty_type"]) == ("Rs. 10550/MT", "", "specific")
    assert rejected["0105.9900"] == "line without rate" and "unreadable" in rejected["0105.9920"] and rejected["1103.1100"] == "line outside its heading" and "concession" in rejected["9901"]
    assert rejected["`"] == "rate without code"


def test_lookup_takes_any_spelling(spark):
    table = spark.createDataFrame([("0802.8000", "Nuts > Areca nuts", "20", "08", "08.02", "ad_valorem", "", 1), ("0802.8000", "Nuts > later", "5", "08", "08.02", "ad_valorem", "", 2)], "pct_code string, description string, cd_rate string, chapter string, heading string, duty_type string, specific_duty_text string, ord int")
    rows = spark.createDataFrame([(1, "08028000"), (2, " 0802 8000 "), (3, "0802.80"), (4, None)], "id int, code string")
    found = {r["id"]: r["tariff_description"] for r in tariff.lookup(rows, "code", table).collect()}
    assert found == {1: "Nuts > later", 2: "Nuts > later", 3: None, 4: None}


def test_search(spark):
    table = spark.createDataFrame([("0802.8000", "Other nuts > Areca nuts", 3), ("0801.1000", "Areca nuts > Coconuts", 2), ("0804.5010", "Guavas", 1)], "pct_code string, description string, ord int")
    codes = lambda text: [r["pct_code"] for r in tariff.search(table, text).collect()]
    assert codes("areca nuts") == ["0802.8000", "0801.1000"] and codes("0804.50") == ["0804.5010"] and codes("08") == ["0804.5010", "0801.1000", "0802.8000"]
    assert codes("") == codes("...") == codes("nothing here") == []


def test_build_writes_table_and_report(spark, tmp_path):
    cells = spark.createDataFrame(CELLS, "page int, row_no int, code string, descr string, rate string")
    (summary,) = tariff.build(cells, str(tmp_path)).collect()
    table, report = (spark.read.option("header", True).csv(f"{tmp_path}/{name}") for name in ("table", "report"))
    assert summary["n_rows"] == table.count() == 6 and summary["n_rejected"] == report.count() == 5
    assert "concession entry" in {r["reject"] for r in report.collect()}
