"""Statistics by hand, rules from labels, and the forms of held-out documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import quality as Q

PROSE = ["I bought it for my sister and it has worked well so far.", "Das Kabel ist gut, aber ich habe es nur einmal benutzt.", "用了6个星期，质量比我想象的好很多。", "lo que más me gusta es el borde que parece muy resistente y no es caro", "Доставили быстро, я очень доволен. Всё работает как надо.", "Not bad at all"]
LISTS = ["- red cable\n- plastic wick\n- steel brush\n- long pouch x6", "1. a bag\n2. two clips\n3. a brush", "12 x knob / 20 x brush / 18 x valve / 6 x bracket", "Beutel\nDeckel, rot\nNetzteil (8)\nErsatzfilter"]
TABLES = ["part\tqty\tprice\nfuse\t3\t4.50\nknob\t7\t1.20", "a;b;c\n1;2;3\n4;5;6", "| x | y | z |\n| 1 | 2 | 3 |\n| 4 | 5 | 6 |", "<table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>", "belt        ok          162\nwick        n/a         65"]
JUNK = ["!!!!!!", "xxxxxxxxxxxxxxxxxxxxxxx", "vgznxh cnkxfta qrvq tzrwq nagqw dxsjcq", "buy buy buy buy buy buy buy buy buy buy", "0x86 0x4C 0x41 0x8B 0xFC", "😍👍🥇😍👍🔥😍⭐🙏🚀", "null", "&nbsp;<div class=\"r1\"></div><span id=x2></span>{{body}}"]


@pytest.fixture(scope="module")
def documents(spark):
    texts = [(t, f) for f, ts in (("prose", PROSE), ("list", LISTS), ("table", TABLES), ("junk", JUNK)) for t in ts]
    rows = [(k, t, f) for k, (t, f) in enumerate(texts * 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, want string").selectExpr("*", "1 AS words", "'l' AS lines", "0 AS kinds", "5 AS n_chars")


def test_statistics(spark):
    table = spark.createDataFrame([(1, "The cat sat. It is 5.\nok"), (2, None), (3, ""), (4, " \n "), (5, "word " * 30_000)], "doc_id long, text string")
    r = {x["doc_id"]: x for x in Q.statistics(table).collect()}
    assert (r[1]["n_chars"], r[1]["n_words"], r[1]["line_count"], r[1]["punctuated_line_share"]) == (24, 7, 2, 0.5)
    assert abs(r[1]["mean_word_length"] - 16 / 7) < 1e-3 and abs(r[1]["digit_ratio"] - 1 / 24) < 1e-3
    assert all(r[k]["n_chars"] is None and r[k]["celled_share"] is None for k in (2, 3, 4)) and r[5]["n_words"] == 30_000
    assert Q.statistics(table.limit(0)).count() == 0


def test_rules_hold_on_documents_they_have_not_seen(spark, documents):
    half = documents.where("doc_id % 2 = 0")
    labels = half.selectExpr("doc_id", "'r1' AS rater", "CASE WHEN doc_id % 46 = 0 THEN 'junk' ELSE want END AS form")  # some are wrong
    rules = Q.learn_form_rules(Q.statistics(half), labels)
    assert {r.form for r in rules} == {"list", "table", "junk"}
    got = {r["doc_id"]: r["form"] for r in Q.apply_rules(Q.statistics(documents), rules).collect()}
    want = {r["doc_id"]: r["want"] for r in documents.collect()}
    right = sum(got[k] == w for k, w in want.items()) / len(want)
    assert right >= 0.9, {(w, got[k], k) for k, w in want.items() if got[k] != w}


def test_no_labels_and_disagreeing_raters(spark, documents):
    none = spark.createDataFrame([], "doc_id long, rater string, form string")
    assert {r["form"] for r in Q.document_forms(documents, none).collect()} == {"prose"}
    torn = spark.createDataFrame([(1, "a", "list"), (1, "b", "table"), (2, None, None)], "doc_id long, rater string, form string")
    assert {r["form"] for r in Q.document_forms(documents, torn).collect()} == {"prose"}


def ratings(**columns):
    rows = np.zeros((len(next(iter(columns.values()))), len(Q.FEATURES)))
    for name, values in columns.items():
        rows[:, Q.FEATURES.index(name)] = values
    return rows


def test_induction_finds_a_threshold():
    rows = ratings(celled_share=np.arange(100) / 100)
    (rule,) = Q.induce_rules(rows, ["table" if k >= 60 else "prose" for k in range(100)], np.ones(100), np.arange(100))
    assert rule.form == "table" and rule.conditions[0][0] == "celled_share" and 0.57 <= rule.conditions[0][2] <= 0.62


def test_conjunctions_are_grown_and_needless_conditions_deleted():
    random = np.random.default_rng(1)
    rows = ratings(celled_share=random.random(900), letter_ratio=random.random(900), digit_ratio=random.random(900))
    table = (rows[:, Q.FEATURES.index("celled_share")] > 0.5) & (rows[:, Q.FEATURES.index("letter_ratio")] < 0.4)
    wrong = random.random(900) < 0.05  # raters err
    rules = Q.induce_rules(rows, ["table" if t != w else "prose" for t, w in zip(table, wrong)], np.ones(900), np.arange(900))
    covered = np.any([r.covers(rows) for r in rules], axis=0)
    assert (covered == table).mean() > 0.93 and {f for f, _, _ in rules[0].conditions} <= {"celled_share", "letter_ratio"}


def test_disagreeing_ratings_count_by_their_share():
    rows = np.repeat(ratings(celled_share=np.arange(60) / 60), 2, axis=0)
    forms = [f for k in range(60) for f in (("table", "table") if k >= 30 else ("table", "prose") if k % 10 == 0 else ("prose", "prose"))]
    (rule,) = Q.induce_rules(rows, forms, np.full(120, 0.5), np.repeat(np.arange(60), 2))
    assert 0.4 <= rule.conditions[0][2] <= 0.6


def test_rules_on_the_tables_held_out_by_document(spark, data):
    """Half of the labelled documents teach, the other half judge; labels themselves err now and then."""
    folder = data.replace("sf0.001", "sf0.1")
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/form_labels.parquet")
    half = lambda k: labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == k)
    stats = Q.statistics(documents.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), Q.common_words(documents)).cache()
    judged = Q.apply_rules(stats, Q.learn_form_rules(stats, half(0))).join(half(1).withColumnRenamed("form", "want"), "doc_id")
    assert judged.agg(F.avg((F.col("form") == F.col("want")).cast("int"))).first()[0] >= 0.85


def test_common_words_are_counted_over_the_corpus(spark):
    table = spark.createDataFrame([(k, t) for k, t in enumerate(["the cat the", "the dog", "用了 the", None, ""])], "doc_id long, text string")
    assert Q.common_words(table, 1) == ["the"] and set(Q.common_words(table)) == {"the", "cat", "dog", "用", "了"} and Q.common_words(table.limit(0)) == []
