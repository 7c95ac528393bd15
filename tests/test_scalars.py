"""Scalar functions, one row each."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quayside.functions import scalars as S
from quayside.functions import text as X
from quayside.functions.numbers import decimal_lenient, parse_status
from quayside.operators.similarity import description_similarity, sequence_ratio
from quayside.operators.tariff import with_kept
from quayside.operators.reconcile import union_documents


def value(spark, function, *args):
    df = spark.createDataFrame([tuple(args)], ", ".join(f"c{k} string" for k in range(len(args))))
    return df.select(function(*[F.col(f"c{k}") for k in range(len(args))]).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (decimal_lenient, "1,250.50", Decimal("1250.5")), (decimal_lenient, "USD 1250", Decimal(1250)), (decimal_lenient, None, Decimal(0)), (decimal_lenient, "not a number", Decimal(0)), (decimal_lenient, "5-10", Decimal(0)),
        (parse_status, "1,250", "clean"), (parse_status, "Rs. 5", "lossy"), (parse_status, " ", "blank"), (S.tariff_code, "08028000", "0802.8000"), (S.tariff_code, " 0802 8000 ", "0802.8000"), (S.tariff_code, "0802.80", ""), (S.tariff_code, None, ""),
        (S.unit_key, "Bags.", "bag"), (S.unit_key, "TONNES", "mt"), (S.unit_key, None, ""), (S.country_key, "P.R. China", "china"), (S.country_key, "U S A", "u s a"), (S.country_key, None, ""),
        (S.description_tokens, "Size 5.0cm of the 5.0 CM bags", ["5.0", "bags", "cm", "size"]), (S.description_tokens, None, []), (S.candidate_words, "Fresh, garlic in 10kg MESH bags, garlic", ["fresh", "garlic"]),
        (S.specific_text, "Rs. 105 50/ MT", "Rs. 10550/MT"), (S.specific_text, "Rs.5per meter", "Rs. 5 per meter"), (S.rate_kind, "Rs. 250/set", "specific"), (S.rate_kind, "3 0", "ad_valorem"), (S.rate_kind, "free", "unknown"), (S.rate_kind, None, "none"),
        (S.dash_depth, " - – Other", 2), (S.dash_depth, "— Other - x", 0), (S.dash_depth, None, 0), (S.undashed, "- - Of a  weight", "Of a weight"), (S.own_text, "a > b > c d", "c d"),
        (S.shorten, "word " * 20, ("word " * 12).strip() + "…"), (S.shorten, "short  text", "short text"), (S.shorten, None, ""),
        (X.fold_lookalikes, "рісе 1 500​ ｋｇ", "pice 1 500 kg"), (X.fold_accents, "Gönwoka Š", "Gonwoka S"), (X.squash, "Ctn's (m²)", "ctnsm²"), (X.normalise_quote, "A – “B”\n c", 'a - "b" c'),
    ],
)
def test_functions(spark, function, text, want):
    assert value(spark, function, text) == want


def test_other_scalars(spark):
    assert value(spark, S.split_field, "line_2.quantity") == (2, "quantity")
    assert value(spark, lambda c: S.display_number(c.cast("decimal(18,2)")), "1234.5") == "1,234.50" and value(spark, lambda c: S.display_number(c.cast("int")), "0") == ""
    assert value(spark, lambda c: S.money(c.cast("decimal(18,4)")), "-2.345") == Decimal("-2.35")
    assert value(spark, S.content_key, "abc", "invoice") == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad.invoice"
    assert abs(value(spark, sequence_ratio, "fresh garlic", "garlic fresh") - 0.5) < 0.2 and value(spark, sequence_ratio, None, "x") == 0.0
    df = spark.createDataFrame([("a b", "a b", 1.0), ("", "a", 0.0)], "a string, b string, j double")
    tokens = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    assert [r["s"] for r in df.select(description_similarity(tokens(F.col("a")), tokens(F.col("b")), F.col("j")).alias("s")).collect()] == [1.0, 0.0]


def test_unions(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([("y", 2), ("z", 1)], "v string, id int")
    assert union_documents(a, b).count() == 3 and sorted(r["v"] for r in with_kept(a, b, ["id"]).collect()) == ["x", "y"]
