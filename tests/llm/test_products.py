"""Descriptions read without knowing goods, dictionaries mined from listings, and the groups of equal products."""

import itertools

import pytest
from helpers import line_items
from pyspark.sql import functions as F

from quayside.llm import phrases
from quayside.llm.listings import PHRASES, Reader, misspelt_words, words_of
from quayside.llm.products import product_groups, product_lines, product_pairs, read_listings

GOODS = {"tea": ["Black tea {b} OPA {w} tin", "TEA, BLACK - {b} - {w} - OPA - metal tin"], "flask": ["Steel flask {b} {v} with cup", "{b} flask, steel, {v} with cup"], "pen": ["Ball pen {b} {t} tip click", "{b} Pens, ball point / {t} tip / retractable"]}
BRANDS = ["Tamgux", "Gönwoka", "Halulpex", "Zorñudex", "Norpawyn", "Vikliola", "Munvifar"]


def corpus():
    """Each product of seven brands worded in two ways by different shippers."""
    rows = []
    for goods, wordings in GOODS.items():
        for b, size in itertools.product(BRANDS, (1, 2)):
            for k, wording in enumerate(wordings):
                fields = {"b": b, "w": f"{size * 250}g" if k else f"0.{size * 25} kg", "v": f"{size * 500} ml", "t": f"0.{size + 4}"}
                rows.append((goods, b, size, wording.format(**fields) + f" {'red' if size == 1 else 'blue'}"))
    return [{"line_id": n, "consignment_id": f"C{n}", "source_doc": "invoice", "line_no": 1, "shipper_id": f"S{n % 5}", "description": r[3]} for n, r in enumerate(rows)], [r[:3] for r in rows]


def test_products_of_a_corpus_are_found_without_a_list_of_goods(spark):
    rows, truth = corpus()
    want = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if truth[a] == truth[b]}
    lines = line_items(spark, *rows, goods="x", brand="y", words="z", name="n")
    got = {(r[0], r[1]) for r in product_pairs(lines).collect()}
    assert got == want
    read = read_listings(lines.select("line_id", "description", "shipper_id"))
    assert {r["brand"] for r in phrases.mine_brands(read).collect()} == {"tamgux", "gonwoka", "halulpex", "zornudex", "norpawyn", "vikliola", "munvifar"}


def test_unread_words_keep_products_apart(spark):
    texts = ["Fresh Garlic, Normal White, 5.0cm", "Fresh Garlic, Pure White Snow, 5.0cm", "FRESH GARLIC - normal white - 50 mm", "Steel water bottle 500 ml", "Bicycle helmet red size M", "Work gloves red size M"]
    rows = [{"line_id": k, "consignment_id": f"C{k}", "source_doc": "invoice", "line_no": 1, "shipper_id": "S", "description": t} for k, t in enumerate(texts)]
    assert {(r[0], r[1]) for r in product_pairs(line_items(spark, *rows)).collect()} == {(0, 2)}


def test_copies_totals_nulls_long_texts_and_empty_tables(spark):
    texts = ["Tamgux Ball pen, 0.7 tip, click, grey, 5 ct", "Tamgux ball pen / retractable / gray / pack of 5 / 0.7mm tip", "TOTAL", " ", None, "word " * 20_000, "word " * 20_000]
    rows = [{"line_id": k, "consignment_id": f"C{k}", "source_doc": "invoice", "line_no": 1, "shipper_id": f"S{k % 3}", "description": t} for k, t in enumerate(texts)]
    rows += [{"line_id": 50, "consignment_id": "C0", "source_doc": "invoice", "line_no": 1, "description": texts[0]}]  # a copy
    rows += [{"line_id": 60, "consignment_id": None, "source_doc": "invoice", "line_no": None, "description": texts[0]}]
    rows += [{"line_id": 70, "consignment_id": "C9", "source_doc": "packing_list", "line_no": 1, "description": texts[0]}]
    table = line_items(spark, *rows, product="x", goods="y", r=1, n=2)
    pairs = {(r[0], r[1]) for r in product_pairs(table).collect()}
    assert pairs == {(0, 1), (0, 60), (1, 60), (5, 6)}
    groups: dict = {}
    for r in product_groups(table).collect():
        groups.setdefault(r["group_id"], []).append(r["line_id"])
    assert {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)} == pairs
    assert product_pairs(line_items(spark)).count() == 0


def read(*texts, series=("kt", "al")):
    reader = Reader(series=frozenset(series))
    return [(sorted(r.models), {d: sorted(v) for d, v in r.attributes.items()}) for r in (reader.read(t.lower().split()) for t in texts)]


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("pen 0.7 tip click grey 5 ct", "pen retractable gray pack of 5 0.7 mm tip"), ("bolt m 12 x 40 ss 304 24 pack half thread ref kt 564", "partially threaded model kt 564 dia 12 mm l 40 mm stainless steel 304 2 doz per pack"),
        ("kettle 1.8 kw 230 v 80 cl metal body ylw", "kettle 1800 watts 230 volt 800 ml steel body yellow"), ("sml 0.8 cm", "small 8 mm"), ("size s", "small"), ("m 12 length 4 cm", "m 12 x 40"),
    ],
)
def test_other_spellings_same_marks(a, b):
    x, y = read(a, b)
    assert x == y and x[1]


@pytest.mark.parametrize(("a", "b"), [("5 ct", "6 ct"), ("kt 564", "kt 565"), ("20 mm", "25 mm"), ("pd 250 g", "d 1 250 g"), ("kt 564", "")])
def test_any_difference_counts(a, b):
    x, y = read(a, b)
    assert x != y


def test_words_and_their_repair(spark):
    rows = [("steel flask",)] * 40 + [("stele flask",), ("St33l flask",), ("steelflask",), ("Gönwoka M10x50 ｓｔｅｅｌ",), (None,), ("",)]
    worded = spark.createDataFrame(rows, "description string").select("description", words_of(F.col("description")).alias("words"))
    words = {r["description"]: r["words"] for r in worded.collect()}
    assert words["St33l flask"] == "steel flask" and words["Gönwoka M10x50 ｓｔｅｅｌ"] == "gonwoka m 10 x 50 steel" and words[""] == "" and words[None] is None
    assert {tuple(r) for r in misspelt_words(worded).collect()} == {("stele", "steel"), ("steelflask", "steel flask")}


def test_repairs_and_phrases_beyond_what_is_shared_at_once(spark, monkeypatch):
    rows, _ = corpus()
    rows += [{**rows[0], "line_id": 900, "consignment_id": "C900", "description": "Balck tea Tamgux OPA 0.25 kg tin red"}]
    lines = line_items(spark, *rows)
    whole = lambda: sorted(map(tuple, product_lines(lines).collect()))
    want = whole()
    monkeypatch.setattr("quayside.llm.listings.SHARED_REPAIRS", 0)
    monkeypatch.setattr(phrases, "SHARD", 3)
    assert whole() == want


def test_lexicon_may_lack_goods(spark):
    """Without the attribute spellings of a kind of goods, equal wordings still meet and different ones stay apart."""
    rows, truth = corpus()
    lexicon = {d: v for d, v in PHRASES.items() if d not in ("leaf", "packing", "mechanism", "colour")}
    groups: dict = {}
    for r in product_lines(line_items(spark, *rows), lexicon).collect():
        groups.setdefault(r["product"], set()).add(truth[r["line_id"]])
    assert all(len(g) == 1 for g in groups.values())
