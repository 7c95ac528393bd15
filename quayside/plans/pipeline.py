"""The consignment pipeline: raw lines to verified, matched, compared and merged lines with their tariff rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators.assignment import assign_lines
from quayside.operators.citations import keep_first_quotes, verify_citations
from quayside.operators.coerce import coerce_lines
from quayside.operators.reconcile import compare_documents, merge_documents, presence, side_by_side
from quayside.operators.tariff import candidates, lookup
from quayside.session import cut_lineage
from quayside.sources.files import cache_misses, extract_lines


@dataclass
class Reconciled:
    """What the pipeline makes of a set of consignments."""

    lines: DataFrame
    matched: DataFrame
    differences: DataFrame
    missing: DataFrame
    merged: DataFrame


def reconcile(raw: DataFrame, pages: DataFrame | None = None, resolutions: DataFrame | None = None) -> Reconciled:
    """Coerce, check citations where there are pages, match by assignment, compare and merge.

    ``raw`` holds line_id and consignment_id with the extracted fields. The coerced lines and the groups are written
    once, as several results read them.
    """
    lines = coerce_lines(raw, "line_id", "consignment_id")
    if pages is not None:
        lines = verify_citations(lines, pages, ["consignment_id", "source_doc"])
    lines = cut_lineage(lines)
    groups = assign_lines(lines).select("consignment_id", "group_no", "line_id")
    keys = ["consignment_id", "group_no"]
    matched = cut_lineage(side_by_side(lines.join(groups, ["consignment_id", "line_id"]), keys))
    return Reconciled(lines, matched, compare_documents(matched, keys), presence(matched, keys), merge_documents(matched, keys, resolutions))


def classified(merged: DataFrame, classifications: DataFrame, tariff: DataFrame) -> DataFrame:
    """Merged lines with the tariff row of their classification."""
    codes = classifications.select("consignment_id", F.col("line_no").alias("group_no"), "pct_code")
    return lookup(merged.join(codes, ["consignment_id", "group_no"], "left"), "pct_code", tariff)


def suggested(merged: DataFrame, tariff: DataFrame, limit: int = 15) -> DataFrame:
    """Tariff candidates for each merged line."""
    keyed = merged.withColumn("key", F.struct("consignment_id", "group_no"))
    return candidates(keyed, "key", "description", tariff, limit).select("key.consignment_id", "key.group_no", "rank", "pct_code", "words", "own_words")


def extracted(pages: DataFrame, cache: DataFrame, extractor: Callable[[str, int, str], list[dict]]) -> DataFrame:
    """Typed and verified lines of documents: from the cache where it has them, else asked of ``extractor``.

    ``pages`` has doc_id, doc_type, sha256, page, text; ``cache`` the records of ``read_cache``. Each quote is checked
    against the pages of its own document, and a quote that was read twice is kept once. Documents without lines give none.
    """
    documents = pages.select("doc_id", "doc_type", "sha256").distinct()
    asked = cache_misses(documents, cache, F.col("doc_type")).select("doc_id", "doc_type")
    fresh = extract_lines(pages.join(asked, ["doc_id", "doc_type"]), extractor)
    known = cache.where("lines IS NOT NULL").groupBy("sha256", "doc_type").agg(F.max_by("lines", "created").alias("lines"))
    names = [c for c in fresh.columns if c not in ("doc_id", "source_doc", "page", "pos")]
    held = documents.join(known, ["sha256", "doc_type"]).select("doc_id", F.col("doc_type").alias("source_doc"), F.posexplode("lines").alias("pos", "x"))
    held = held.select("doc_id", "source_doc", F.col("x.page").try_cast("int").alias("page"), "pos", *[F.col(f"x.{n}").alias(n) for n in names])
    raw = fresh.unionByName(held).withColumn("line_no", F.col("pos") + 1)
    # a line is told apart by its document and place
    raw = cut_lineage(raw.withColumn("line_id", F.xxhash64("doc_id", "source_doc", F.coalesce("page", F.lit(0)), "pos")))
    lines = coerce_lines(raw, "line_id", "doc_id")
    checked = verify_citations(lines, pages.withColumnRenamed("doc_type", "source_doc"), ["doc_id", "source_doc"])
    return keep_first_quotes(checked, ["doc_id", "source_doc"], ["page", "line_no", "line_id"])
