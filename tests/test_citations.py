"""Citations: nearest page, corrections and reasons; duplicates by quote."""

import pytest
from helpers import line_items

from quayside.operators.citations import keep_first_quotes, verify_citations

PAGES = "consignment_id string, source_doc string, page int, text string"


def check(spark, quote, cited, pages):
    lines = line_items(spark, {"line_id": 1, "consignment_id": "C", "source_doc": "invoice", "page": cited, "quote": quote, "verified": True, "verify_note": "trust me"})
    table = spark.createDataFrame([("C", "invoice", n, t) for n, t in pages.items()], PAGES)
    r = verify_citations(lines, table, ["consignment_id", "source_doc"]).first()
    return r["verified"], r["page"], r["verify_note"]


ROW = "1  Fresh garlic  1,200 BAGS"


@pytest.mark.parametrize(
    ("cited", "pages", "want"),
    [
        (1, {1: f"x {ROW} y"}, (True, 1)), (2, {1: ROW, 2: "z"}, (True, 1)), (3, {1: ROW}, (True, 1)), (1, {1: "a", 5: ROW}, (False, 1)), (3, {1: ROW, 4: ROW, 3: "q"}, (True, 4)),
        (3, {2: ROW, 4: ROW}, (True, 2)), (1, {1: "another row altogether"}, (False, 1)), (None, {1: ROW}, (True, 1)),
    ],
)
def test_nearest_page(spark, cited, pages, want):
    assert check(spark, ROW, cited, pages)[:2] == want


def test_typography_does_not_matter(spark):
    assert check(spark, "1 fresh garlic – “A” 1​,200", 1, {1: '1  FRESH garlic -\n"A" 1,200'})[0]


def test_reasons(spark):
    assert "too short" in check(spark, "1,200", 1, {1: ROW})[2] and "too short" in check(spark, None, 1, {1: ROW})[2]
    assert "without text" in check(spark, ROW, 1, {1: "  "})[2] and "without text" in check(spark, ROW, 1, {})[2]
    assert "page 5" in check(spark, ROW, 1, {5: ROW, 1: "a"})[2]
    assert not check(spark, "an invented quote", 1, {1: ROW})[0]


def test_first_quotes(spark):
    rows = [{"line_id": k, "consignment_id": "C", "source_doc": "invoice", "quote": q} for k, q in enumerate(["a row here", "A  row here", "", None, "b"])]
    kept = keep_first_quotes(line_items(spark, *rows), ["consignment_id", "source_doc"], ["line_id"]).collect()
    assert [(r["line_id"], r["n"]) for r in sorted(kept, key=lambda r: r["line_id"])] == [(0, 1), (2, 2), (3, 3), (4, 4)]
