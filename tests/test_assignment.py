"""The scored assignment: the best sum, any order of lines, and the known consignment."""

import itertools

import numpy as np
import pytest

from quayside.operators.assignment import assign_lines, largest_assignment, match_consignment, prepare_lines

INVOICE = ["Fresh Garlic, Normal White, size 5.0cm & up, packed in 10kg mesh bags", "Fresh Garlic, Pure White, size 5.5cm & up, packed in 10kg mesh bags", "Dehydrated Garlic Flakes, Grade A, 20kg cartons"]
PACKING = ["GARLIC FRESH PURE WHITE 5.5CM UP (10KG MESH BAGS)", "GARLIC FLAKES DEHYDRATED GRADE A (20KG CTN)", "GARLIC FRESH NORMAL WHITE 5.0CM UP (10KG MESH BAGS)"]
LADING = ["FRESH GARLIC NORMAL WHITE IN MESH BAGS", "FRESH GARLIC PURE WHITE IN MESH BAGS", "DEHYDRATED GARLIC FLAKES IN CARTONS"]


DOCS = ("invoice", "packing_list", "bill_of_lading")


def rows(consignment, invoice, packing, lading):
    return [
        (consignment, doc, n, base + i, t) for doc, texts, base in zip(DOCS, (invoice, packing, lading), (0, 100, 200)) for n, (i, t) in enumerate(texts, 1)
    ]


def table(spark, *some):
    return spark.createDataFrame([r for x in some for r in x], "consignment_id string, source_doc string, line_no int, line_id long, description string")


@pytest.mark.parametrize("shape", [(1, 1), (2, 4), (4, 2), (5, 5), (1, 6), (6, 1)])
def test_sum_is_the_largest_by_brute_force(shape):
    random = np.random.default_rng(sum(shape))
    for _ in range(30):
        score = random.integers(0, 6, shape) / 5
        rows, cols = shape
        pairs = largest_assignment(score)
        assert len(pairs) == min(shape) and len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
        if rows <= cols:
            best = max(sum(score[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(cols), rows))
        else:
            best = max(sum(score[r, c] for c, r in enumerate(p)) for p in itertools.permutations(range(rows), cols))
        assert abs(sum(score[r, c] for r, c in pairs) - best) < 1e-9


def groups(found):
    return {frozenset(g["line_id"]) for _, g in found.groupby("group_no")}


def test_known_consignment_in_all_orders(spark):
    want = {frozenset({0, 102, 200}), frozenset({1, 100, 201}), frozenset({2, 101, 202})}
    packing, lading = list(enumerate(PACKING)), list(enumerate(LADING))
    orders = [(p, b) for p in itertools.permutations(packing) for b in itertools.permutations(lading)]
    prepared = prepare_lines(table(spark, *[rows(f"C{k}", list(enumerate(INVOICE)), p, b) for k, (p, b) in enumerate(orders)])).toPandas()
    assert prepared["key"].nunique() == len(orders)
    for _, lines in prepared.groupby("key"):
        assert groups(match_consignment(lines)) == want


def test_unlike_lines_are_split_and_empty_documents_do_no_harm(spark):
    some = table(spark, rows("A", [(0, "fresh garlic")], [(0, "kitchen sinks")], []), rows("B", [(1, None)], [(1, "x")], [(1, "fresh garlic")]), [(None, "invoice", 1, 9, "alone"), (None, "packing_list", 1, 8, "alone"), ("A", None, 1, 7, "no document")])
    found = assign_lines(some).toPandas()
    assert {k: groups(g) for k, g in found.groupby("consignment_id")} == {"A": {frozenset({0}), frozenset({100})}, "B": {frozenset({1}), frozenset({101}), frozenset({201})}}
    assert sorted(found[found["consignment_id"].isna()]["line_id"]) == [8, 9] and 7 not in set(found["line_id"])
    assert largest_assignment(np.zeros((0, 3))) == []


def test_score_is_the_combined_one(spark):
    found = assign_lines(table(spark, rows("A", [(0, "fresh garlic")], [(0, "fresh garlic")], []))).toPandas()
    assert list(found.sort_values("line_id")["score"]) == [1.0, 1.0]
    found = assign_lines(table(spark, rows("A", [(0, "fresh garlic"), (1, "steel bolts")], [(1, "steel bolts"), (0, "fresh garlic")], []))).toPandas()
    assert sorted(found["score"]) == [0.85, 0.85, 1.0, 1.0]  # the same words at the other end of the list
