"""Sources and sinks: consignment files, tariff tables, rates, page texts, the cache of extractions, JSON export."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.scalars import content_key
from quayside.operators.coerce import coerce_lines
from quayside.schemas import CONSIGNMENT_FILE, EXTRACTION_RECORD, NUMBERS, TARIFF_FILE


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_consignments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, typed lines) of consignment JSON files, one consignment in each; unknown fields are dropped.

    The file's path is the consignment's key where it states no reference.
    """
    raw = spark.read.schema(CONSIGNMENT_FILE).option("multiLine", True).json(path)
    raw = raw.withColumn("consignment_id", F.coalesce(F.nullif("reference", F.lit("")), F.col("_metadata.file_path")))
    amount = lambda name, default: F.coalesce(F.col(name).try_cast("decimal(18,4)"), F.lit(default).cast("decimal(18,4)")).alias(name)
    headers = raw.select("consignment_id", "reference", F.coalesce("importer_status", F.lit("commercial_filer")).alias("importer_status"), amount("fx_rate", "1"), amount("freight", "0"), amount("insurance", "0"), F.col("_meta").alias("meta"))
    lines = raw.select("consignment_id", F.posexplode("lines").alias("pos", "line")).select("consignment_id", "pos", "line.*")
    typed = coerce_lines(lines, "consignment_id", "pos", position=F.col("pos") + 1)
    return headers, typed.withColumn("ord", F.col("pos") + 1).drop("pos")


def read_tariff(spark: SparkSession, path: str) -> DataFrame:
    """A tariff CSV with a header, all strings, with ``ord`` for its printed order within a file."""
    table = spark.read.schema(TARIFF_FILE).option("header", True).csv(path)
    return table.withColumn("ord", F.monotonically_increasing_id())


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of nested numbers as a table levy, key, rate (decimal, never a float): under a hundred rows."""
    text = spark.read.text(path, wholetext=True).first()
    tree = json.loads(text[0], parse_float=str, parse_int=str) if text else {}
    rows: list[tuple[str, str, str]] = []

    def walk(name: str, key: str, node: object) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                walk(name or k, k, v)
        elif isinstance(node, str):
            rows.append((name, key, node))

    walk("", "", tree)
    frame = spark.createDataFrame(rows, "levy string, key string, value string")
    return frame.withColumn("rate", F.col("value").try_cast("decimal(9,6)")).where("rate IS NOT NULL").drop("value")


def read_documents(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Binary files with the digest of their content: path, content, sha256."""
    return spark.read.format("binaryFile").load(paths).select("path", "content", F.sha2("content", 256).alias("sha256"))


def page_texts(documents: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, sha256, page, text), pages from 1, by ``reader``: one text for each page of a document.

    The library that reads a format is the caller's choice; it runs in the workers, one document at a time.
    """

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, s, n, text) for p, s, content in zip(batch["path"], batch["sha256"], batch["content"]) for n, text in enumerate(reader(content), 1)]
            yield pd.DataFrame(rows, columns=["path", "sha256", "page", "text"])

    return documents.select("path", "sha256", "content").mapInPandas(pages, "path string, sha256 string, page int, text string")


def cache_misses(documents: DataFrame, cache: DataFrame, doc_type: Column) -> DataFrame:
    """The documents whose content and type are not in the cache yet."""
    known = cache.where("lines IS NOT NULL").select(F.concat_ws(".", "sha256", "doc_type").alias("cache_key")).distinct()
    return documents.withColumn("cache_key", F.concat_ws(".", "sha256", doc_type)).join(known, "cache_key", "left_anti")


def keyed(documents: DataFrame, content: str, kind: str) -> DataFrame:
    """``documents`` with their cache key."""
    return documents.withColumn("cache_key", content_key(F.col(content), F.col(kind)))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Extraction records; unreadable ones and those without lines are left out."""
    return spark.read.schema(EXTRACTION_RECORD).json(path).where("lines IS NOT NULL")


def append_cache(records: DataFrame, path: str) -> None:
    """Add records to the cache; the file committer makes a finished write visible at once."""
    records.write.mode("append").json(path)


def extract_lines(pages: DataFrame, extractor: Callable[[str, int, str], list[dict]]) -> DataFrame:
    """Raw lines of each non-blank page by a pluggable ``extractor(doc_type, page, text)``, run in the workers.

    ``pages`` has doc_id, doc_type, page, text; the result doc_id, source_doc, page, pos and the raw fields as strings.
    """
    names = ["description", "quantity", "unit", "unit_price", "currency", "value", "net_weight_kg", "gross_weight_kg", "origin", "incoterm", "quote"]
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("source_doc", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("pos", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in names]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                for pos, item in enumerate(extractor(r.doc_type, int(r.page), r.text) or []):
                    if isinstance(item, dict):
                        rows.append((str(r.doc_id), r.doc_type, int(item.get("page") or r.page), pos, *[None if item.get(n) is None else str(item[n]) for n in names]))
            yield pd.DataFrame(rows, columns=["doc_id", "source_doc", "page", "pos", *names])

    return pages.where("trim(text) <> ''").select("doc_id", "doc_type", "page", "text").mapInPandas(run, schema)


def parse_reply(reply: Column) -> Column:
    """A model's JSON reply as an array of raw lines, all fields text; null if it is no such JSON.

    Numbers are read as decimals and printed in plain digits, so none passes through a float.
    """
    names = ("line_no", "description", "quantity", "unit", "unit_price", "currency", "value", "net_weight_kg", "gross_weight_kg", "origin", "incoterm", "page", "quote")
    numbers = ("line_no", *NUMBERS, "page")

    def lines(kind: T.DataType, wanted: tuple[str, ...]) -> Column:
        line = T.StructType([T.StructField(n, kind) for n in wanted])
        return F.from_json(reply, T.StructType([T.StructField("lines", T.ArrayType(line))]))["lines"]

    def merged(text: Column, exact: Column) -> Column:
        digits = lambda n: F.regexp_replace(F.regexp_replace(exact[n].cast("string"), "([.][0-9]*?)0+$", "$1"), "[.]$", "")
        field = lambda n: F.when(text[n].rlike("^-?[0-9.]+([eE][-+]?[0-9]+)?$"), F.coalesce(digits(n), text[n])).otherwise(text[n]) if n in numbers else text[n]
        return F.struct(*[field(n).alias(n) for n in names])

    return F.zip_with(lines(T.StringType(), names), lines(T.DecimalType(38, 10), numbers), merged)


def consignments_json(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """(consignment_id, json): header and nested lines as text, decimals as strings, lines in order."""
    fields = [c for c in lines.columns if c != "consignment_id"]
    texts = [F.col(c).cast("string").alias(c) if c in NUMBERS or isinstance(lines.schema[c].dataType, T.DecimalType) else F.col(c) for c in fields]
    nested = lines.groupBy("consignment_id").agg(F.array_sort(F.collect_list(F.struct(*texts))).alias("lines"))
    header = [F.col(c).cast("string").alias(c) if isinstance(headers.schema[c].dataType, T.DecimalType) else F.col(c) for c in headers.columns]
    joined = headers.select(*header).join(nested, "consignment_id", "left")
    return joined.select("consignment_id", F.to_json(F.struct(*[F.col(c) for c in joined.columns])).alias("json"))


def write_json(documents: DataFrame, path: str) -> None:
    """One JSON document in each line."""
    documents.select("json").write.mode("overwrite").text(path)
