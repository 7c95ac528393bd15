"""Belief propagation against the exact marginals, and the matches of small consignments."""

import itertools
import math

import numpy as np
from helpers import line_items

from quayside.llm.matching import LEVELS, assign, estimate_weights, match_lines, propagate


def exact_marginals(odds):
    """Marginal probability of each pair over all one-to-one matchings."""
    pairs, whole, weight = list(odds), 0.0, dict.fromkeys(odds, 0.0)
    for k in range(len(pairs) + 1):
        for chosen in itertools.combinations(pairs, k):
            if len({a for a, _ in chosen}) == len({b for _, b in chosen}) == k:
                w = math.exp(sum(odds[p] for p in chosen))
                whole += w
                for p in chosen:
                    weight[p] += w
    return {p: w / whole for p, w in weight.items()}


def test_marginals(spark):
    trees = {("C1", "i-p"): {(1, 11): 2.0, (1, 12): 1.0, (2, 12): 0.5}, ("C2", "i-p"): {(1, 11): -1.0}, ("C3", "i-p"): {(1, 11): 3.0, (2, 11): 2.5, (3, 11): 0.0}}
    loops = {("C4", "i-p"): {(1, 11): 4.0, (1, 12): 0.0, (2, 11): 0.0, (2, 12): 4.0}}
    rows = [(int(c[1:]), a, b, 1, 2, o) for (c, _), odds in (trees | loops).items() for (a, b), o in odds.items()]
    found = propagate(spark.createDataFrame(rows, "consignment_id long, a long, b long, da int, db int, odds double"))
    got = {(f"C{r['consignment_id']}", r["a"], r["b"]): r["probability"] for r in found.collect()}
    for (c, _), odds in (trees | loops).items():
        for (a, b), p in exact_marginals(odds).items():
            assert abs(got[c, a, b] - p) < (0.02 if c != "C4" else 0.1), (c, a, b, got[c, a, b], p)


def consignment(name, base, docs):
    rows = []
    for doc, lines in docs.items():
        for n, (text, gross) in enumerate(lines, 1):
            rows.append({"line_id": base + len(rows), "consignment_id": name, "source_doc": doc, "line_no": n, "description": text, "gross_weight_kg": gross})
    return rows


DOCS = {
    "invoice": [("Black tea Tamgux, 250g, Grade A, OPA, tin", "10.5"), ("Black tea Tamgux, 500g, Grade A, OPA, tin", "20.5"), ("PVC pipe, PN6, 20mm, red", None), ("TOTAL", "99")],
    "packing_list": [("TEA, BLACK - 0.5 KG - OPA", None), ("PIPE, PVC - RED", "7"), ("TEA, BLACK - 250 G", "10.5")],
    "bill_of_lading": [("STC BLACK TEA", "20.5"), ("S.T.C. TEA, BLACK", "10.5")],
}


def test_small_consignment_copies_and_nulls(spark):
    rows = consignment("C1", 100, DOCS) + consignment("C2", 200, {"invoice": DOCS["invoice"][:1], "packing_list": [("PVC pipe", "1")]})
    rows += [{"line_id": 300, "consignment_id": "C1", "source_doc": "invoice", "line_no": 1, "description": DOCS["invoice"][0][0]}]
    rows += [{"line_id": 301, "consignment_id": None, "source_doc": "invoice", "line_no": 1, "description": "Black tea"}, {"line_id": 302, "consignment_id": "C1", "source_doc": None, "line_no": 1, "description": "Black tea"}, {"line_id": 303, "consignment_id": "C1", "source_doc": "invoice", "line_no": 9}]
    found = match_lines(line_items(spark, *rows, goods="x", a=1, b=2, odds=3.0, docs="d"))
    got = {(r[0], r[1]) for r in found.collect()}
    assert got == {(100, 106), (100, 108), (106, 108), (101, 104), (101, 107), (104, 107), (102, 105)}
    assert all(0.5 <= r["probability"] <= 1 for r in found.collect())


def test_ties_and_empty_table(spark):
    docs = {"invoice": [("Black tea, 250g", None)] * 3, "packing_list": [("Tea, black 250 g", None)] * 3}
    got = {(r[0], r[1]) for r in match_lines(line_items(spark, *consignment("C", 0, docs))).collect()}
    assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got) and got <= {(0, 3), (1, 4), (2, 5)}
    assert match_lines(line_items(spark)).count() == 0


def test_equal_lines_are_all_matched(spark):
    rows = []
    for n, k, m, gross in ((0, 3, 3, None), (1, 4, 4, "10.5"), (2, 6, 6, "7"), (3, 4, 1, "3"), (4, 2, 5, None)):
        rows += consignment(f"C{n}", 100 * n, {"invoice": [("Black tea, 250g", gross)] * k, "packing_list": [("Tea, black 250 g", gross)] * m})
    got = {(r[0], r[1]) for r in match_lines(line_items(spark, *rows)).collect()}
    assert got == {(100 * n + i, 100 * n + k + i) for n, k, m in ((0, 3, 3), (1, 4, 4), (2, 6, 6), (3, 4, 1), (4, 2, 5)) for i in range(min(k, m))}


def test_contradicted_lines_stay_free(spark):
    docs = {"invoice": [("Black tea, 250g", "1")] * 4, "packing_list": [("Tea, black 500 g", "2")] * 4}
    assert match_lines(line_items(spark, *consignment("C", 0, docs))).count() == 0


def test_third_document_goes_before_position(spark):
    pairs = [(7, 0, 4, 1, 3, 9.0), (7, 3, 4, 2, 3, 9.0), (7, 0, 2, 1, 2, 3.0), (7, 0, 3, 1, 2, 3.0), (7, 1, 2, 1, 2, 3.0), (7, 1, 3, 1, 2, 3.0)]
    beliefs = propagate(spark.createDataFrame(pairs, "consignment_id long, a long, b long, da int, db int, odds double"))
    assert {(r["a"], r["b"]) for r in assign(beliefs).collect()} == {(0, 4), (3, 4), (0, 3), (1, 2)}


GARLIC = {
    "invoice": [("Fresh Garlic, Normal White, size 5.0cm & up, packed in 10kg mesh bags", "12360"), ("Fresh Garlic, Pure White, size 5.5cm & up, packed in 10kg mesh bags", "8240"), ("Dehydrated Garlic Flakes, Grade A, 20kg cartons", "3180")],
    "packing_list": [("GARLIC FRESH PURE WHITE 5.5CM UP (10KG MESH BAGS)", "8240"), ("GARLIC FLAKES DEHYDRATED GRADE A (20KG CTN)", "3180"), ("GARLIC FRESH NORMAL WHITE 5.0CM UP (10KG MESH BAGS)", "12360")],
    "bill_of_lading": [("FRESH GARLIC NORMAL WHITE IN MESH BAGS", "12360"), ("FRESH GARLIC PURE WHITE IN MESH BAGS", "8240"), ("DEHYDRATED GARLIC FLAKES IN CARTONS", "3180")],
}


def test_goods_of_no_dictionary(spark):
    want = {(0, 5), (0, 6), (5, 6), (1, 3), (1, 7), (3, 7), (2, 4), (2, 8), (4, 8)}
    assert {(r[0], r[1]) for r in match_lines(line_items(spark, *consignment("G", 0, GARLIC))).collect()} == want
    docs = {"invoice": [("Portland cement grade A", None), ("Laptop computer 14 inch", None)], "packing_list": [("Laptop computer 14 inch", None), ("Portland cement grade A", None)]}
    assert {(r[0], r[1]) for r in match_lines(line_items(spark, *consignment("L", 0, docs))).collect()} == {(0, 3), (1, 2)}


def test_weights_are_estimated_from_the_patterns():
    """Two kinds of pairs that differ in one comparison: its weights are learnt, the others' stay near nought."""
    names = list(LEVELS)

    def pattern(**levels):
        number = 0
        for n in names:
            number = number * len(LEVELS[n]) + list(LEVELS[n]).index(levels.get(n, "unknown" if "unknown" in LEVELS[n] else "none"))
        return number

    patterns = np.array([pattern(gross="same", brand="same"), pattern(gross="differs", brand="same"), pattern(gross="differs", brand="differs")])
    base, ratios = estimate_weights(patterns, np.array([2e5, 1e5, 7e5]))
    of = lambda n, level: ratios[n][list(LEVELS[n]).index(level)]
    assert of("gross", "same") > 4 and of("gross", "differs") < -4 and of("brand", "same") > 1 and abs(of("words", "unknown")) < 0.5 and base < 0
