"""Files in, files out, the cache, the extractor seam and the stream of lines."""

import json
from decimal import Decimal

from helpers import line_items
from pyspark.sql import functions as F

from quayside.operators import windows
from quayside.plans.pipeline import reconcile
from quayside.sources import files
from quayside.streaming import ingest


def test_consignment_files(spark, tmp_path):
    doc = {"reference": "R1", "fx_rate": "281.50", "extra": 1, "_meta": {"a": "b"}, "lines": [{"source_doc": "hacked", "description": "Garlic", "quantity": "1,250.50", "page": "x", "incoterm": "nonsense", "verified": True}, {"description": " "}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    headers, lines = files.read_consignments(spark, str(tmp_path))
    h, rows = headers.first(), lines.collect()
    assert (h["consignment_id"], h["fx_rate"], h["freight"], h["importer_status"], h["meta"]) == ("R1", Decimal("281.5000"), 0, "commercial_filer", {"a": "b"})
    assert len(rows) == 1 and (rows[0]["source_doc"], rows[0]["quantity"], rows[0]["page"], rows[0]["incoterm"], rows[0]["line_no"]) == ("invoice", Decimal("1250.5"), 1, "", 1)
    out = files.consignments_json(headers.drop("meta"), lines)
    nested = json.loads(out.first()["json"])
    assert nested["lines"][0]["quantity"] == "1250.5000" and nested["fx_rate"] == "281.5000"
    files.write_json(out, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_rates_and_tariff(spark, tmp_path):
    (tmp_path / "rates.json").write_text('{"st": {"standard_rate": "0.18", "verified": false}, "wht": {"by": {"a": 0.055}}}')
    rates = {(r["levy"], r["key"]): r["rate"] for r in files.read_rates(spark, str(tmp_path / "rates.json")).collect()}
    assert rates == {("st", "standard_rate"): Decimal("0.180000"), ("wht", "a"): Decimal("0.055000")}
    (tmp_path / "t.csv").write_text("pct_code,description,cd_rate,chapter,heading,duty_type,specific_duty_text\n0101.2100,Horses,3,01,01.01,ad_valorem,\n")
    assert files.read_tariff(spark, str(tmp_path / "t.csv")).first()["pct_code"] == "0101.2100"


def test_cache_and_extractor(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.bin").write_bytes(b"page one\fpage two")
    (tmp_path / "docs" / "b.bin").write_bytes(b"other")
    documents = files.read_documents(spark, str(tmp_path / "docs"))
    pages = files.page_texts(documents, lambda content: content.decode().split("\f"))
    assert {(r["page"], r["text"]) for r in pages.collect()} == {(1, "page one"), (2, "page two"), (1, "other")}
    known = documents.where("path LIKE '%a.bin'").first()["sha256"]
    record = {"doc_type": "invoice", "sha256": known, "model": "m", "pages": 2, "lines": [{"description": "x"}]}
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "1.json").write_text(json.dumps(record) + "\n" + json.dumps({"doc_type": "invoice", "sha256": "bad"}) + "\nnot json\n")
    cache = files.read_cache(spark, str(tmp_path / "cache"))
    missing = files.cache_misses(documents, cache, F.lit("invoice")).collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in missing] == ["b.bin"]
    files.append_cache(cache, str(tmp_path / "cache2"))
    assert files.read_cache(spark, str(tmp_path / "cache2")).count() == 1
    asked = pages.select(F.lit("d").alias("doc_id"), F.lit("invoice").alias("doc_type"), "page", "text")
    raw = files.extract_lines(asked, lambda kind, page, text: [{"description": f"{kind} {text}", "quantity": 5}, "junk"])
    assert {(r["description"], r["quantity"], r["page"]) for r in raw.collect()} == {("invoice page one", "5", 1), ("invoice page two", "5", 2), ("invoice other", "5", 1)}
    reply = spark.createDataFrame([('{"lines": [{"description": "a", "quantity": 12345678901234567.25}]}',), ("no",)], "r string").select(files.parse_reply(F.col("r")).alias("x")).collect()
    assert reply[0]["x"][0]["quantity"] == "12345678901234567.25" and not reply[1]["x"]


def test_stream_keeps_each_line_once(spark, data, tmp_path):
    lines = spark.read.parquet(f"{data}/line_items.parquet").where("consignment_id IS NOT NULL AND line_no IS NOT NULL AND loaded_at IS NOT NULL")
    lines.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.first_extractions(ingest.line_stream(spark, str(tmp_path / "in"), 1), "4000 days")
    for _ in range(2):  # the second run finds nothing new
        ingest.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == lines.select("consignment_id", "source_doc", "line_no").distinct().count()
    counted = ingest.arrivals(ingest.line_stream(spark, str(tmp_path / "in")), "1 day", "1 day")
    query = counted.writeStream.outputMode("complete").format("memory").queryName("arrivals").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n_lines) AS n FROM arrivals").first()["n"] == lines.count()


def test_stream_knows_late_copies_by_default(spark, tmp_path):
    batches = [[("A", "2024-01-01")], [("B", "2024-02-10")], [("C", "2024-02-11")], [("A", "2024-02-12"), ("D", "2024-01-02")], [("D", "2024-03-30"), ("B", "2024-02-10")]]
    for rows in batches:
        made = spark.createDataFrame([(c, "invoice", 1, t) for c, t in rows], "consignment_id string, source_doc string, line_no int, loaded_at string")
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.first_extractions(ingest.line_stream(spark, str(tmp_path / "in")))
        ingest.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r["consignment_id"], str(r["loaded_at"])[:10]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("A", "2024-01-01"), ("B", "2024-02-10"), ("C", "2024-02-11"), ("D", "2024-01-02")]


def test_pipeline_on_the_known_consignment(spark):
    rows = []
    table = [
        ("invoice", 1, "Fresh Garlic, Normal White, size 5.0cm & up, packed in 10kg mesh bags", "1200", "BAGS", "12000", "12360", "China"), ("invoice", 2, "Fresh Garlic, Pure White, size 5.5cm & up, packed in 10kg mesh bags", "800", "BAGS", "8000", "8240", "China"),
        ("invoice", 3, "Dehydrated Garlic Flakes, Grade A, 20kg cartons", "150", "CTNS", "3000", "3180", "China"), ("packing_list", 1, "GARLIC FRESH PURE WHITE 5.5CM UP (10KG MESH BAGS)", "800", "BAGS", "8000", "8240", "CHINA"),
        ("packing_list", 2, "GARLIC FLAKES DEHYDRATED GRADE A (20KG CTN)", "150", "CTNS", "2950", "3180", "CHINA"), ("packing_list", 3, "GARLIC FRESH NORMAL WHITE 5.0CM UP (10KG MESH BAGS)", "1180", "BAGS", "12000", "12360", "CHINA"),
        ("bill_of_lading", 1, "FRESH GARLIC NORMAL WHITE IN MESH BAGS", "1200", "BAGS", "0", "12360", "P.R. CHINA"), ("bill_of_lading", 2, "FRESH GARLIC PURE WHITE IN MESH BAGS", "800", "BAGS", "0", "8240", "P.R. CHINA"),
        ("bill_of_lading", 3, "DEHYDRATED GARLIC FLAKES IN CARTONS", "150", "CARTONS", "0", "3180", "P.R. CHINA"),
    ]
    for k, (doc, no, text, q, u, net, gross, origin) in enumerate(table):
        rows.append({"line_id": k, "consignment_id": "C", "source_doc": doc, "line_no": no, "description": text, "quantity": q, "unit": u, "net_weight_kg": net, "gross_weight_kg": gross, "origin": origin})
    result = reconcile(line_items(spark, *rows))
    assert {(r["group_no"], r["field"], r["severity"]) for r in result.differences.collect()} == {(1, "quantity", "blocking"), (3, "net_weight_kg", "advisory")}
    assert result.merged.count() == 3 and result.missing.count() == 0


def test_apportion_and_totals(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "1"), ("b", "0"), ("c", "-1"), ("c", "3")], "g string, w string")
    shares = windows.apportion(df, ["g"], F.col("w").cast("decimal(18,4)"), {"s": F.lit("100.00").cast("decimal(18,2)")})
    assert sorted((r["g"], str(r["s"])) for r in shares.collect()) == [("a", "33.33"), ("a", "33.33"), ("a", "33.33"), ("b", "0.00"), ("c", "-50.00"), ("c", "150.00")]
    assert windows.totals(df.limit(0), ["g"], {"s": F.lit(1)}).where("g IS NOT NULL").count() == 0
