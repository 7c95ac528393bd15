"""Shares reached, caps kept, and what is reported when a source is too small."""

import pytest
from pyspark.sql import functions as F

from quayside.llm import mixing
from quayside.llm.mixing import mix

TARGETS = "mix_name string, source string, target_share double, max_repeats int, size_ratio double"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, "web", f"some words of a page number {k} about tea and pipes") for k in range(300)]
    rows += [(1000 + k, "app", f"short note {k}") for k in range(120)] + [(2000 + k, "card", "ok fine") for k in range(3)]
    rows += [(3000 + k, None, f"some words of a page about tea {k}") for k in range(10)] + [(4000, "web", ""), (4001, "app", None), (4002, "web", "long " * 400)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS repeats", "'q' AS bucket", "0 AS gap")


def test_shares(spark, corpus):
    targets = spark.createDataFrame([("m", "web", 3.0, 2, 0.5), ("m", "app", 1.0, 2, 0.5), ("n", "app", 0.5, 4, 0.4), ("n", "card", 0.3, 4, 0.4), ("n", "ghost", 0.2, 4, 0.4), (None, "web", 1.0, 1, 1.0)], TARGETS)
    rows, report = mix(corpus, targets)
    r = {(x["mix_name"], x["source"]): x for x in report.collect()}
    for key in (("m", "web"), ("m", "app"), ("n", "app")):
        # what is missing of the size is at most what unlabelled documents bring and one short document
        assert r[key]["status"] == "met" and 0.9 * {"m": 1.0, "n": 1.0}[key[0]] <= r[key]["tokens"] / r[key]["target_tokens"] <= 1.001
    assert abs(r["m", "web"]["expected_share"] - 0.75) < 0.01 and abs(r["m", "app"]["expected_share"] - 0.25) < 0.01
    assert r["n", "card"]["status"] == "short" and r["n", "card"]["most_repeats"] == 4 and r["n", "ghost"]["status"] == "absent"
    drawn = rows.collect()
    assert {x["doc_id"] for x in drawn}.isdisjoint({4000, 4001}) and len({(x["mix_name"], x["doc_id"]) for x in drawn}) == len(drawn)
    assert all(1 <= x["repeats"] <= {"m": 2, "n": 4}[x["mix_name"]] for x in drawn)
    assert {(x["mix_name"], x["doc_id"], x["repeats"]) for x in mix(corpus, targets)[0].collect()} == {(x["mix_name"], x["doc_id"], x["repeats"]) for x in drawn}


def test_empty_corpus_and_no_targets(spark, corpus):
    targets = spark.createDataFrame([("m", "web", 1.0, 2, 0.5)], TARGETS)
    rows, report = mix(corpus.limit(0), targets)
    assert rows.count() == 0 and [r["status"] for r in report.collect()] == ["absent"]
    rows, report = mix(corpus, targets.limit(0))
    assert rows.count() == report.count() == 0


def test_rates_of_the_fit_decide_every_row(spark, corpus, monkeypatch):
    targets = spark.createDataFrame([("m", "web", 3.0, 2, 0.5), ("m", "app", 1.0, 2, 0.5)], TARGETS)
    assert mix(corpus, targets)[0].count() > 0
    real = mixing.fit_rates
    monkeypatch.setattr(mixing, "fit_rates", lambda *a: (real(*a)[0].withColumn("rate", F.lit(0.0)), real(*a)[1]))
    assert mix(corpus, targets)[0].count() == 0


def test_fit_meets_goals_that_soft_members_share(spark):
    rows = [("m", 100.0, [1.0, 0.0], 3.0), ("m", 50.0, [0.0, 1.0], 3.0)] + [("m", 10.0, [0.7, 0.3], 2.0)] * 4
    members = spark.createDataFrame(rows, "mix_name string, n_tokens double, member array<double>, cap double")
    one = mixing.Mix("m", [{"source": d, "target_share": w, "max_repeats": 3, "size_ratio": 1.0} for d, w in (("a", 120.0), ("b", 80.0))], ["a", "b"], 200)
    rated, reached = mixing.fit_rates(members, [one])
    rates = rated.collect()
    assert abs(reached["m"][0] - 120) < 0.1 and abs(reached["m"][1] - 80) < 0.1
    assert all(0 <= r["rate"] <= r["cap"] for r in rates) and abs(sum(r["n_tokens"] * r["member"][0] * r["rate"] for r in rates) - 120) < 0.1
    short = mixing.Mix("m", [{"source": "a", "target_share": 1.0, "max_repeats": 3, "size_ratio": 1.0}], ["a", "b"], 10_000)
    assert abs(mixing.fit_rates(members, [short])[1]["m"][0] - (300 + 4 * 10 * 0.7 * 2)) < 1e-6  # all at their caps


def test_posteriors_follow_the_words_and_are_calibrated(spark):
    rows = [(k, "tea leaves and pots", "a") for k in range(200)] + [(1000 + k, "steel bolts and nuts", "b") for k in range(200)] + [(5000, "tea pots", None), (5001, "bolts", None), (5002, "zzz", None), (5003, "", None)]
    found = {r["doc_id"]: r["posterior"] for r in mixing.domain_posteriors(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["a", "b"]).collect()}
    assert set(found) == {5000, 5001, 5002} and found[5000][0] > 0.9 and found[5001][1] > 0.9 and abs(found[5002][0] - 0.5) < 0.05
    same = [(k, "the same words", "a" if k % 4 else "b") for k in range(400)] + [(9000, "the same words", None)]
    (soft,) = mixing.domain_posteriors(spark.createDataFrame(same, "doc_id long, text string, source string"), ["a", "b"]).collect()
    assert abs(soft["posterior"][0] - 0.75) < 0.06
