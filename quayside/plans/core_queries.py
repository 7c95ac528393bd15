"""Registered queries of the core operators over the trade tables, each with its SQL counterpart where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.functions import scalars as S
from quayside.functions.numbers import decimal_lenient, parse_status, printed_number
from quayside.functions.text import fold_pairs
from quayside.operators import assignment, citations, coerce, reconcile, similarity, tariff, windows
from quayside.plans import pipeline
from quayside.schemas import DOC_TYPES, INCOTERMS, NUMBERS, RAW_LINE
from quayside.sources.files import consignments_json, keyed, read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _case(names: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + f" ELSE {key} END"


UNIT = _case(S.UNIT_ALIASES, "regexp_replace(lower(coalesce({c}, '')), '[^a-z]', '', 'g')")
COUNTRY = _case(S.COUNTRY_ALIASES, "trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z]+', ' ', 'g'))")
NUMBER = "coalesce(try_cast(regexp_replace({c}, '[^0-9.\\-]', '', 'g') AS DECIMAL(18,4)), 0)"
TOKENS = "list_sort(list_filter(list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '([0-9]+(?:[.][0-9]+)?|[a-z]+)', 1)), lambda x: x NOT IN (" + _quoted(S.STOP_WORDS) + ")))"


# ---- coercion and scalar functions

@query("SELECT line_id, " + NUMBER.format(c="quantity") + """ AS amount,
       CASE WHEN quantity IS NULL OR trim(quantity) = '' THEN 'blank'
            WHEN regexp_replace(quantity, '[0-9.,\\-]', '', 'g') = '' THEN 'clean' ELSE 'lossy' END AS parse_status FROM line_items""")
def lenient_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "line_items")
    return lines.select("line_id", decimal_lenient(F.col("quantity")).alias("amount"), parse_status(F.col("quantity")).alias("parse_status"))


@query("""WITH t AS (SELECT line_id, regexp_replace(gross_weight_kg, '[ '']', '', 'g') AS t FROM line_items WHERE trim(gross_weight_kg) <> '')
SELECT line_id, try_cast(CASE
    WHEN contains(t, '.') AND contains(t, ',') AND length(split_part(t, ',', -1)) < length(split_part(t, '.', -1)) THEN replace(replace(t, '.', ''), ',', '.')
    WHEN contains(t, '.') AND contains(t, ',') THEN replace(t, ',', '')
    WHEN regexp_full_match(t, '[0-9]+(,[0-9]{3})+') THEN replace(t, ',', '')
    WHEN regexp_full_match(t, '[0-9]+,[0-9]+') THEN replace(t, ',', '.')
    WHEN regexp_full_match(t, '[0-9]+([.][0-9]+){2,}') THEN replace(t, '.', '')
    ELSE t END AS DECIMAL(28,6)) AS amount FROM t""")
def printed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "line_items").where("trim(gross_weight_kg) <> ''")
    return lines.select("line_id", printed_number(F.col("gross_weight_kg")).alias("amount"))


@query("""SELECT line_id, CASE WHEN source_doc IN (""" + _quoted(DOC_TYPES) + """) THEN source_doc ELSE 'invoice' END AS source_doc,
       CASE WHEN line_no IS NULL OR line_no = 0 THEN 1 ELSE line_no END AS line_no, substring(trim(description), 1, 300) AS description, """
       + ", ".join(NUMBER.format(c=n) + f" AS {n}" for n in NUMBERS) + """,
       substring(trim(coalesce(unit, '')), 1, 30) AS unit, upper(substring(trim(coalesce(currency, '')), 1, 8)) AS currency, substring(trim(coalesce(origin, '')), 1, 40) AS origin,
       CASE WHEN upper(substring(trim(coalesce(incoterm, '')), 1, 4)) IN (""" + _quoted(INCOTERMS) + """) THEN upper(substring(trim(incoterm), 1, 4)) ELSE '' END AS incoterm,
       greatest(1, coalesce(page, 1)) AS page, substring(trim(coalesce(quote, '')), 1, 800) AS quote
FROM line_items WHERE trim(description) <> ''""")
def coerced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = coerce.coerce_lines(read_table(spark, sf_dir, "line_items"), "line_id")
    return typed.drop(*[f"{n}_raw" for n in NUMBERS])


@query("""SELECT consignment_id, line_no, substring(trim(coalesce(pct_code, '')), 1, 12) AS pct_code, substring(trim(coalesce(heading_text, '')), 1, 500) AS heading_text,
       CASE WHEN lower(trim(confidence)) IN ('low', 'medium', 'high') THEN lower(trim(confidence)) ELSE 'low' END AS confidence,
       CAST(least(3, len(list_filter(coalesce(alternatives, []), lambda x: x IS NOT NULL))) AS INTEGER) AS n_alternatives, coalesce(confirmed_by_human, false) AS confirmed_by_human FROM classifications""")
def coerced_classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = coerce.coerce_classifications(read_table(spark, sf_dir, "classifications"), "consignment_id")
    return typed.withColumn("n_alternatives", F.size("alternatives")).drop("alternatives", "reasoning")


@query("""SELECT consignment_id, line_no, CASE WHEN length(regexp_replace(coalesce(pct_code, ''), '[^0-9]', '', 'g')) = 8
       THEN substring(regexp_replace(pct_code, '[^0-9]', '', 'g'), 1, 4) || '.' || substring(regexp_replace(pct_code, '[^0-9]', '', 'g'), 5, 4) ELSE '' END AS code FROM classifications""")
def normalised_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "classifications").select("consignment_id", "line_no", S.tariff_code(F.col("pct_code")).alias("code"))


@query(f"SELECT line_id, {UNIT.format(c='unit')} AS unit_key, {COUNTRY.format(c='origin')} AS country_key FROM line_items")
def comparison_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "line_items")
    return lines.select("line_id", S.unit_key(F.col("unit")).alias("unit_key"), S.country_key(F.col("origin")).alias("country_key"))


@query(f"SELECT line_id, array_to_string({TOKENS.format(c='description')}, ' ') AS tokens FROM line_items")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "line_items").select("line_id", F.array_join(S.description_tokens(F.col("description")), " ").alias("tokens"))


@query("""SELECT pct_code, CASE WHEN duty_type = 'ad_valorem' THEN cast(try_cast(cd_rate AS DECIMAL(9,4)) / 100 AS DECIMAL(9,6)) END AS cd_fraction,
       CASE WHEN duty_type = 'specific' THEN 'specific' WHEN try_cast(cd_rate AS DECIMAL(9,4)) IS NOT NULL THEN 'ad_valorem' ELSE 'missing' END AS rate_status FROM pct_codes""")
def rate_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tariff.cd_fraction(read_table(spark, sf_dir, "pct_codes")).select("pct_code", "cd_fraction", "rate_status")


@query("""WITH r AS (SELECT pct_code, CASE WHEN duty_type = 'specific' THEN specific_duty_text ELSE cd_rate END AS printed FROM pct_codes)
SELECT pct_code, CASE WHEN printed IS NULL OR trim(printed) = '' THEN 'none'
    WHEN regexp_full_match(replace(printed, ' ', ''), '[0-9]{1,3}([.][0-9]+)?') THEN 'ad_valorem'
    WHEN regexp_full_match(regexp_replace(regexp_replace(regexp_replace(printed, '\\s+', '', 'g'), '^Rs\\.', 'Rs. '), '([0-9])per', '\\1 per '), 'Rs\\. [0-9]+(/(MT|Kg|set)| per meter)') THEN 'specific'
    ELSE 'unknown' END AS kind FROM r""")
def rate_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = F.when(F.col("duty_type") == "specific", F.col("specific_duty_text")).otherwise(F.col("cd_rate"))
    return read_table(spark, sf_dir, "pct_codes").select("pct_code", S.rate_kind(printed).alias("kind"))


@query("""SELECT DISTINCT consignment_id, source_doc, page, sha256(text) || '.' || source_doc AS cache_key FROM doc_pages WHERE text IS NOT NULL""")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "doc_pages").where("text IS NOT NULL")
    return keyed(pages, "text", "source_doc").select("consignment_id", "source_doc", "page", "cache_key").distinct()


# ---- citations and duplicates

@query("""WITH l AS (SELECT line_id, consignment_id, source_doc, greatest(1, coalesce(page, 1)) AS cited, lower(trim(regexp_replace(coalesce(quote, ''), '\\s+', ' ', 'g'))) AS q FROM line_items),
p AS (SELECT consignment_id, source_doc, page AS pg, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS body FROM doc_pages),
h AS (SELECT l.line_id, p.pg, abs(p.pg - l.cited) AS far FROM l JOIN p USING (consignment_id, source_doc) WHERE length(l.q) >= 8 AND contains(p.body, l.q)),
n AS (SELECT line_id, arg_min(pg, (far, pg)) FILTER (WHERE far <= 2) AS found FROM h GROUP BY 1)
SELECT l.line_id, n.found IS NOT NULL AS verified, coalesce(n.found, l.cited) AS page FROM l LEFT JOIN n USING (line_id)""")
def citations_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, pages = read_table(spark, sf_dir, "line_items"), read_table(spark, sf_dir, "doc_pages")
    return citations.verify_citations(lines, pages, ["consignment_id", "source_doc"], citations.plain_text).select("line_id", "verified", "page")


def _folded(column: str) -> str:
    """The SQL of the folded form: characters replaced, white space collapsed, lower case."""
    source, target = (x.replace("'", "''") for x in fold_pairs())
    plain = f"translate(coalesce({column}, ''), '{source}', '{target}')"
    quotes = f"translate({plain}, '\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f\u2032\u2033', '\'\'\'\'\'\'\'\'\"\"\"\"\'\'\"')"
    return f"lower(trim(regexp_replace({quotes}, '[\\s\\x{{0B}}\\x{{85}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g')))"


@query(f"""WITH l AS (SELECT line_id, consignment_id, source_doc, greatest(1, coalesce(page, 1)) AS cited, {_folded('quote')} AS q FROM line_items),
p AS (SELECT consignment_id, source_doc, page AS pg, {_folded('text')} AS body FROM doc_pages),
t AS (SELECT consignment_id, source_doc, bool_or(length(body) > 0) AS has_text FROM p GROUP BY 1, 2),
h AS (SELECT l.line_id, p.pg, abs(p.pg - l.cited) AS far FROM l JOIN p USING (consignment_id, source_doc) WHERE length(l.q) >= 8 AND contains(p.body, l.q)),
n AS (SELECT line_id, arg_min(pg, (far, pg)) FILTER (WHERE far <= 2) AS found, min(pg) AS elsewhere FROM h GROUP BY 1)
SELECT l.line_id, n.found IS NOT NULL AS verified, coalesce(n.found, l.cited) AS page, CASE WHEN length(l.q) < 8 THEN 'too short to be checked'
  WHEN NOT coalesce(t.has_text, false) THEN 'document without text, quote not checked' WHEN n.found = l.cited THEN 'on the cited page'
  WHEN n.found IS NOT NULL THEN 'page corrected from ' || l.cited || ' to ' || n.found WHEN n.elsewhere IS NOT NULL THEN 'only on page ' || n.elsewhere || ', too far from page ' || l.cited
  ELSE 'nowhere near page ' || l.cited END AS verify_note
FROM l LEFT JOIN n USING (line_id) LEFT JOIN t ON t.consignment_id = l.consignment_id AND t.source_doc = l.source_doc""")
def citations_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, pages = read_table(spark, sf_dir, "line_items"), read_table(spark, sf_dir, "doc_pages")
    return citations.verify_citations(lines, pages, ["consignment_id", "source_doc"]).select("line_id", "verified", "page", "verify_note")


def _printed_rows(kind: str, page: int, text: str) -> list[dict]:
    """A stand-in for a model: every printed row of a page is a line."""
    return [{"description": row.strip(), "quote": row.strip()} for row in text.split("\n") if len(row.strip()) >= 8]


@query(f"""WITH r AS (SELECT consignment_id AS doc_id, source_doc, page, unnest(string_split(text, chr(10))) AS row FROM (SELECT consignment_id, source_doc, page, max(text) AS text FROM doc_pages WHERE trim(text) <> '' GROUP BY ALL)),
q AS (SELECT doc_id, source_doc, {_folded('substring(trim(row), 1, 800)')} AS q FROM r WHERE length(trim(row)) >= 8)
SELECT doc_id, source_doc, count(DISTINCT q) AS n_lines, count(DISTINCT q) AS n_verified FROM q GROUP BY ALL""")
def composed_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache, extractor, coercion, citation check and first quotes in one plan; a third of the documents come from the cache."""
    pages = read_table(spark, sf_dir, "doc_pages").where("trim(text) <> ''").groupBy("consignment_id", "source_doc", "page").agg(F.max("text").alias("text"))
    pages = pages.select(F.col("consignment_id").alias("doc_id"), F.col("source_doc").alias("doc_type"), F.sha2(F.concat_ws("/", "consignment_id", "source_doc"), 256).alias("sha256"), "page", "text")
    rows = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: F.length(x) >= 8)
    line = lambda x: F.struct(*[(x if f.name in ("description", "quote") else F.col("page").cast("string") if f.name == "page" else F.lit(None).cast("string")).alias(f.name) for f in RAW_LINE])
    held = pages.where(F.pmod(F.xxhash64("sha256"), F.lit(3)) == 0).groupBy("sha256", "doc_type").agg(F.flatten(F.collect_list(F.transform(rows, line))).alias("lines"))
    found = pipeline.extracted(pages, held.withColumn("created", F.lit("now")), _printed_rows)
    return found.groupBy("doc_id", "source_doc").agg(F.count("*").alias("n_lines"), F.count_if("verified").alias("n_verified"))


@query("""WITH k AS (SELECT line_id, consignment_id, source_doc, page, line_no, lower(trim(regexp_replace(coalesce(quote, ''), '\\s+', ' ', 'g'))) AS q FROM line_items),
f AS (SELECT *, row_number() OVER (PARTITION BY consignment_id, source_doc, q ORDER BY line_id) AS k FROM k)
SELECT line_id, CAST(row_number() OVER (PARTITION BY consignment_id, source_doc ORDER BY line_id) AS INTEGER) AS n FROM f WHERE k = 1 OR q = ''""")
def first_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "line_items")
    return citations.keep_first_quotes(lines, ["consignment_id", "source_doc"], ["line_id"], citations.plain_text).select("line_id", "n")


@query("""SELECT consignment_id, arg_max(importer_status, updated_at) AS stated, max(updated_at) AS updated_at,
       coalesce(nullif(trim(arg_max(coalesce(importer_status, ''), updated_at)), ''), 'commercial_filer') AS importer_status FROM consignments GROUP BY 1""".replace("arg_max(importer_status, updated_at) AS stated, ", ""))
def latest_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coerce.header_defaults(read_table(spark, sf_dir, "consignments")).select("consignment_id", "updated_at", "importer_status")


# ---- similarity and matching

@query(f"""WITH t AS (SELECT consignment_id, line_id, unnest({TOKENS.format(c='description')}) AS token FROM line_items WHERE source_doc = 'invoice'),
s AS (SELECT consignment_id, count(*) AS n FROM line_items WHERE source_doc = 'invoice' GROUP BY 1)
SELECT t.consignment_id, token, count(*) AS df, round(ln(1 + any_value(n) / count(*)), 6) AS weight FROM t JOIN s USING (consignment_id) GROUP BY 1, 2""")
def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "line_items").where("source_doc = 'invoice'")
    return similarity.token_weights(lines, ["consignment_id"]).withColumn("weight", F.round("weight", 6))


_PAIRS = """l AS (SELECT consignment_id, source_doc, line_no, min(line_id) AS line_id FROM line_items WHERE consignment_id IS NOT NULL AND line_no IS NOT NULL GROUP BY ALL),
pairs AS (SELECT i.consignment_id, i.line_id AS a, p.line_id AS b FROM l i JOIN l p ON i.consignment_id = p.consignment_id AND i.line_no = p.line_no WHERE i.source_doc = 'invoice' AND p.source_doc = 'packing_list')"""


def _line_pairs(lines: DataFrame) -> DataFrame:
    """Invoice and packing list lines of the same number."""
    first = lines.where("consignment_id IS NOT NULL AND line_no IS NOT NULL").groupBy("consignment_id", "source_doc", "line_no").agg(F.min("line_id").alias("line_id"))
    side = lambda doc, name: first.where(F.col("source_doc") == doc).select("consignment_id", "line_no", F.col("line_id").alias(name))
    return side("invoice", "a").join(side("packing_list", "b"), ["consignment_id", "line_no"]).select("consignment_id", "a", "b")


@query(f"""WITH {_PAIRS}, t AS (SELECT consignment_id, line_id, unnest({TOKENS.format(c='description')}) AS token FROM line_items),
n AS (SELECT consignment_id, count(*) AS n FROM line_items GROUP BY 1),
w AS (SELECT t.consignment_id, token, ln(1 + any_value(n) / count(*)) AS w FROM t JOIN n USING (consignment_id) GROUP BY 1, 2),
ma AS (SELECT a, b, sum(w) AS m FROM pairs JOIN t ON t.line_id = a JOIN w ON w.consignment_id = pairs.consignment_id AND w.token = t.token GROUP BY 1, 2),
mb AS (SELECT a, b, sum(w) AS m FROM pairs JOIN t ON t.line_id = b JOIN w ON w.consignment_id = pairs.consignment_id AND w.token = t.token GROUP BY 1, 2),
ms AS (SELECT a, b, sum(w) AS m FROM pairs JOIN t x ON x.line_id = a JOIN t y ON y.line_id = b AND y.token = x.token JOIN w ON w.consignment_id = pairs.consignment_id AND w.token = x.token GROUP BY 1, 2)
SELECT pairs.consignment_id, a, b, round(CASE WHEN coalesce(ma.m, 0) > 0 AND coalesce(mb.m, 0) > 0 THEN coalesce(ms.m, 0) / (ma.m + mb.m - coalesce(ms.m, 0)) ELSE 0 END, 6) AS similarity
FROM pairs LEFT JOIN ma USING (a, b) LEFT JOIN mb USING (a, b) LEFT JOIN ms USING (a, b)""")
def weighted_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "line_items")
    weights = similarity.token_weights(lines, ["consignment_id"])
    return similarity.weighted_jaccard(_line_pairs(lines), lines, lines, weights, ["consignment_id"])


@query()
def line_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the descriptions of invoice and packing list lines of one number: weighted tokens and sequence ratio."""
    lines = read_table(spark, sf_dir, "line_items")
    pairs = similarity.weighted_jaccard(_line_pairs(lines), lines, lines, similarity.token_weights(lines, ["consignment_id"]), ["consignment_id"])
    tokens = lambda side: lines.select(F.col("line_id").alias(side), S.description_tokens(F.col("description")).alias(f"tokens_{side}"))
    both = pairs.join(tokens("a"), "a").join(tokens("b"), "b")
    return both.select("consignment_id", "a", "b", similarity.description_similarity(F.col("tokens_a"), F.col("tokens_b"), F.col("similarity")).alias("similarity"))


@query("""SELECT line_id, percent_rank() OVER (PARTITION BY consignment_id, source_doc ORDER BY line_no, line_id) AS position,
       CAST(row_number() OVER (PARTITION BY consignment_id, source_doc ORDER BY line_no, line_id) AS INTEGER) AS n FROM line_items""")
def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "line_items")
    keys, order = ["consignment_id", "source_doc"], [F.asc_nulls_last("line_no"), F.asc("line_id")]
    return windows.renumber(windows.with_position(lines, keys, order), keys, order).select("line_id", "position", "n")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first extraction of each line that has a description and a place."""
    lines = read_table(spark, sf_dir, "line_items").where("consignment_id IS NOT NULL AND line_no IS NOT NULL")
    first = lines.groupBy("consignment_id", "source_doc", "line_no").agg(F.min("line_id").alias("line_id")).select("line_id")
    return coerce.coerce_lines(lines.join(first, "line_id", "left_semi"), "line_id", "consignment_id")


@query()
def assigned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment.assign_lines(_documents(spark, sf_dir))


# ---- comparison and merge, documents matched by line number

_TYPED = """f AS (SELECT min(line_id) AS line_id FROM line_items WHERE consignment_id IS NOT NULL AND line_no IS NOT NULL GROUP BY consignment_id, source_doc, line_no),
l0 AS (SELECT line_id, consignment_id, CASE WHEN line_no = 0 THEN 1 ELSE line_no END AS line_no, CASE WHEN source_doc IN (""" + _quoted(DOC_TYPES) + """) THEN source_doc ELSE 'invoice' END AS source_doc,
   substring(trim(description), 1, 300) AS description, """ + ", ".join(NUMBER.format(c=n) + f" AS {n}" for n in NUMBERS) + """,
   substring(trim(coalesce(unit, '')), 1, 30) AS unit, upper(substring(trim(coalesce(currency, '')), 1, 8)) AS currency, substring(trim(coalesce(origin, '')), 1, 40) AS origin
   FROM line_items SEMI JOIN f USING (line_id) WHERE trim(description) <> ''),
l AS (SELECT * FROM l0 QUALIFY row_number() OVER (PARTITION BY consignment_id, line_no, source_doc ORDER BY line_id) = 1),
k AS (SELECT DISTINCT consignment_id, line_no FROM l)"""
_SIDES = " ".join(f"LEFT JOIN l {d} ON {d}.consignment_id = k.consignment_id AND {d}.line_no = k.line_no AND {d}.source_doc = '{d}'" for d in DOC_TYPES)


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.side_by_side(_documents(spark, sf_dir), ["consignment_id", "line_no"])


def _list(expression: str) -> str:
    return "[" + ", ".join(expression.format(d=d) for d in DOC_TYPES) + "]"


def _differences_sql() -> str:
    texts = {"unit": UNIT.format(c="{d}.unit"), "currency": "upper(trim({d}.currency))", "origin": COUNTRY.format(c="{d}.origin")}
    many = {f: f"len(list_distinct(list_filter({_list(e)}, lambda x: x IS NOT NULL AND x <> ''))) > 1" for f, e in texts.items()}
    parts = [f"SELECT consignment_id, line_no, {k} AS rule_ord, 'presence' AS field, '{'advisory' if d == 'bill_of_lading' else 'blocking'}' AS severity FROM m WHERE no_{d}" + (" AND bl_lists" if d == "bill_of_lading" else "") for k, d in enumerate(DOC_TYPES)]
    parts += [f"SELECT consignment_id, line_no, {k}, '{f}', 'blocking' FROM m WHERE many_{f}" for k, f in ((3, "unit"), (4, "currency"), (10, "origin"))]
    columns = [f"{d}.line_id IS NULL AS no_{d}" for d in DOC_TYPES] + [f"{c} AS many_{f}" for f, c in many.items()]
    for k, n in enumerate(NUMBERS):
        stated = f"list_filter({_list('{d}.' + n)}, lambda x: x IS NOT NULL AND x <> 0)"
        columns += [f"list_min({stated}) AS lo_{n}", f"list_max({stated}) AS hi_{n}", f"len({stated}) AS n_{n}"]
        also = {"quantity": " AND NOT many_unit", "unit_price": " AND NOT many_currency", "value": " AND NOT many_currency"}.get(n, "")
        severity = "'advisory'" if n == "unit_price" else f"CASE WHEN (hi_{n} > 0 AND (hi_{n} - lo_{n}) < hi_{n} * 0.02) OR hi_{n} < 0 THEN 'advisory' ELSE 'blocking' END" if n.endswith("_kg") else "'blocking'"
        parts.append(f"SELECT consignment_id, line_no, {5 + k}, '{n}', {severity} FROM m WHERE n_{n} >= 2 AND lo_{n} <> hi_{n}{also}")
    lists = "max(CASE WHEN bill_of_lading.line_id IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY k.consignment_id) = 1 AS bl_lists"
    return f"WITH {_TYPED}, m AS (SELECT k.consignment_id, k.line_no, {lists}, {', '.join(columns)} FROM k {_SIDES}) " + " UNION ALL ".join(parts)


@query(_differences_sql())
def document_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconcile.compare_documents(_matched(spark, sf_dir), ["consignment_id", "line_no"])
    return found.select("consignment_id", "line_no", "rule_ord", "field", "severity")


def _notes_sql() -> str:
    """The differences with their label, note and values, put together as text."""
    labels, documents = reconcile.LABELS, list(DOC_TYPES)
    joined = lambda parts, mark: f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), '{mark}')"
    columns, rows = [], []
    for d in documents:
        columns.append(f"CASE WHEN {d}.line_id IS NULL THEN 'no' ELSE 'yes' END AS has_{d}")
    listed = "'{' || " + joined([f"""'"{d}":"' || has_{d} || '"'""" for d in documents], ",") + " || '}'"
    rows += [f"SELECT consignment_id, line_no, 'presence' AS field, '{labels[d]}' AS missing, 'not on the {labels[d]}' AS note, {listed} AS vals FROM m WHERE has_{d} = 'no'" for d in documents]

    def says(shown: str, stated: str) -> tuple[str, str]:
        text = [f"CASE WHEN {stated.format(d=d)} THEN '{labels[d]} says ' || {shown.format(d=d)} END" for d in documents]
        pairs = [f"""CASE WHEN {stated.format(d=d)} THEN '"{d}":' || to_json({shown.format(d=d)}) END""" for d in documents]
        return joined(text, "; ") + " || '.'", "'{' || " + joined(pairs, ",") + " || '}'"

    for f in ("unit", "currency", "origin"):
        note, values = says("{d}." + f, "trim(coalesce({d}." + f + ", '')) <> ''")
        columns += [f"{note} AS note_{f}", f"{values} AS vals_{f}"]
        rows.append(f"SELECT consignment_id, line_no, '{f}', NULL, note_{f}, vals_{f} FROM m")
    for n in NUMBERS:
        note, values = says("{d}." + n + "_raw", "coalesce({d}." + n + ", 0) <> 0")
        stated = f"list_filter({_list('{d}.' + n)}, lambda x: x IS NOT NULL AND x <> 0)"
        if n.endswith("_kg"):
            spread = f"CAST((list_max({stated}) - list_min({stated})) AS DOUBLE) * 100 / CAST(nullif(list_max({stated}), 0) AS DOUBLE)"
            note = f"{note} || ' Spread ' || CAST(CAST(round_even({spread}, 2) AS DECIMAL(18,2)) AS VARCHAR) || '%.'"
        columns += [f"{note} AS note_{n}", f"{values} AS vals_{n}"]
        rows.append(f"SELECT consignment_id, line_no, '{n}', NULL, note_{n}, vals_{n} FROM m")
    flat = "trim(regexp_replace(coalesce(" + ", ".join(f"{d}.description" for d in documents) + r"), '\s+', ' ', 'g'))"
    short = rf"CASE WHEN length({flat}) <= 60 THEN {flat} ELSE trim(regexp_extract({flat} || ' ', '^(.{{0,59}})(?:\s|$)', 1)) || '…' END"
    typed = _TYPED.replace(NUMBER.format(c=NUMBERS[0]) + f" AS {NUMBERS[0]}", ", ".join(f"trim(coalesce({n}, '')) AS {n}_raw" for n in NUMBERS) + ", " + NUMBER.format(c=NUMBERS[0]) + f" AS {NUMBERS[0]}", 1)
    differences = _differences_sql()
    return (
        f"WITH d AS ({differences}), n AS (WITH {typed}, m AS (SELECT k.consignment_id, k.line_no, {', '.join(columns)} FROM k {_SIDES}) {' UNION ALL '.join(rows)}), "
        f"s AS (WITH {typed} SELECT k.consignment_id, k.line_no, 'Line ' || k.line_no || ' (' || {short} || ')' AS label FROM k {_SIDES}) "
        "SELECT d.consignment_id, d.line_no, d.rule_ord, d.field, d.severity, s.label, n.note, n.vals AS \"values\" FROM d JOIN s USING (consignment_id, line_no) JOIN n ON n.consignment_id = d.consignment_id AND n.line_no = d.line_no AND n.field = d.field "
        f"AND (d.field <> 'presence' OR n.missing = CASE d.rule_ord {' '.join(f'WHEN {k} THEN ' + repr(labels[d]) for k, d in enumerate(documents))} END)"
    )


@query(_notes_sql())
def document_difference_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconcile.compare_documents(_matched(spark, sf_dir), ["consignment_id", "line_no"])
    return found.withColumn("values", F.to_json("values"))


@query(f"""WITH {_TYPED} SELECT k.consignment_id, k.line_no, concat_ws(',', {", ".join(f"CASE WHEN {d}.line_id IS NULL THEN '{d}' END" for d in DOC_TYPES)}) AS missing
FROM k {_SIDES} WHERE {" OR ".join(f"{d}.line_id IS NULL" for d in DOC_TYPES)}""")
def missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.presence(_matched(spark, sf_dir), ["consignment_id", "line_no"])


def _merged_sql(field: str) -> str:
    blank = "0" if field in NUMBERS else "''"
    return "coalesce(" + ", ".join(f"nullif({d}.{field}, {blank})" for d in DOC_TYPES) + f", {blank}) AS {field}"


@query(f"""WITH {_TYPED} SELECT k.consignment_id, k.line_no, {", ".join(_merged_sql(f) for f in reconcile.MERGED)},
CASE WHEN invoice.line_id IS NOT NULL THEN 'invoice' WHEN packing_list.line_id IS NOT NULL THEN 'packing_list' ELSE 'bill_of_lading' END AS source_doc,
CASE WHEN invoice.line_id IS NOT NULL THEN invoice.description WHEN packing_list.line_id IS NOT NULL THEN packing_list.description ELSE bill_of_lading.description END AS description
FROM k {_SIDES}""")
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = reconcile.merge_documents(_matched(spark, sf_dir), ["consignment_id", "line_no"])
    return merged.select("consignment_id", "line_no", *reconcile.MERGED, "source_doc", "description")


@query(f"""WITH d AS ({_differences_sql()}), r AS (SELECT DISTINCT consignment_id, line_no, field FROM d WHERE field IN ('quantity', 'unit')),
g AS (WITH {_TYPED} SELECT k.consignment_id, k.line_no, {_merged_sql('quantity')}, {_merged_sql('unit')}, {_merged_sql('value')} FROM k {_SIDES})
SELECT g.consignment_id, g.line_no, CASE WHEN q.field IS NULL THEN g.quantity ELSE 1250.5 END AS quantity, CASE WHEN u.field IS NULL THEN g.unit ELSE 'CTN' END AS unit, g.value
FROM g LEFT JOIN r q ON q.consignment_id = g.consignment_id AND q.line_no = g.line_no AND q.field = 'quantity' LEFT JOIN r u ON u.consignment_id = g.consignment_id AND u.line_no = g.line_no AND u.field = 'unit'""")
def resolved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged lines in which every difference of quantity and unit was settled by one printed answer, the last given."""
    keys = ["consignment_id", "line_no"]
    matched = _matched(spark, sf_dir)
    asked = reconcile.compare_documents(matched, keys).where("field IN ('quantity', 'unit')").select(*keys, "field")
    answers = F.explode(F.array(F.struct(F.lit(1).alias("rule_ord"), F.lit("first answer").alias("resolved_value")), F.struct(F.lit(2).alias("rule_ord"), F.when(F.col("field") == "unit", "CTN").otherwise("1,250.50").alias("resolved_value"))))
    resolutions = asked.select(*keys, "field", answers.alias("r")).select(*keys, "field", "r.*")
    return reconcile.merge_documents(matched, keys, resolutions).select(*keys, "quantity", "unit", "value")


@query("""WITH d AS (SELECT DISTINCT consignment_id, line_no, trim(quantity) AS quantity, source_doc,
   CASE source_doc WHEN 'invoice' THEN 1 WHEN 'packing_list' THEN 2 WHEN 'bill_of_lading' THEN 3 ELSE 0 END AS r FROM line_items WHERE trim(quantity) <> '')
SELECT consignment_id, line_no, quantity, string_agg(source_doc, ',' ORDER BY r) AS docs FROM d GROUP BY ALL""")
def documents_by_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "line_items").withColumn("quantity", F.trim("quantity"))
    return reconcile.documents_by_value(lines, ["consignment_id", "line_no"], "quantity")


@query()
def reconciled_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline: citations, assignment, comparison; one row per difference."""
    lines = read_table(spark, sf_dir, "line_items").where("consignment_id IS NOT NULL AND line_no IS NOT NULL")
    first = lines.groupBy("consignment_id", "source_doc", "line_no").agg(F.min("line_id").alias("line_id")).select("line_id")
    result = pipeline.reconcile(lines.join(first, "line_id", "left_semi"), read_table(spark, sf_dir, "doc_pages"))
    return result.differences.withColumn("values", F.to_json("values"))


# ---- tariff

@query("""WITH c AS (SELECT consignment_id, line_no, pct_code AS stated, CASE WHEN length(regexp_replace(coalesce(pct_code, ''), '[^0-9]', '', 'g')) = 8
       THEN substring(regexp_replace(pct_code, '[^0-9]', '', 'g'), 1, 4) || '.' || substring(regexp_replace(pct_code, '[^0-9]', '', 'g'), 5, 4) ELSE '' END AS code FROM classifications)
SELECT consignment_id, line_no, stated, t.pct_code AS tariff_code, t.description AS tariff_description, t.cd_rate AS tariff_cd_rate FROM c LEFT JOIN pct_codes t ON t.pct_code = c.code""")
def tariff_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tariff.lookup(read_table(spark, sf_dir, "classifications"), "pct_code", read_table(spark, sf_dir, "pct_codes"))
    return found.select("consignment_id", "line_no", F.col("pct_code").alias("stated"), "tariff_code", "tariff_description", "tariff_cd_rate")


@query("""WITH t AS (SELECT pct_code, lower(description) AS d, trim(split_part(lower(description), '>', -1)) AS own FROM pct_codes)
SELECT pct_code FROM t WHERE contains(d, 'dried') AND contains(d, 'apricots') ORDER BY -(contains(own, 'dried')::INT + contains(own, 'apricots')::INT), length(d), pct_code LIMIT 20""")
def tariff_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tariff.search(read_table(spark, sf_dir, "pct_codes"), "Dried apricots").select("pct_code")


@query("SELECT pct_code FROM pct_codes WHERE starts_with(replace(pct_code, '.', ''), '0852') ORDER BY ord LIMIT 20")
def tariff_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tariff.search(read_table(spark, sf_dir, "pct_codes"), "08.52").select("pct_code")


_WORDS = "list_distinct(list_filter(regexp_split_to_array(replace(lower(description), ',', ' '), '\\s+'), lambda x: regexp_full_match(x, '\\p{L}{4,}') AND x NOT IN (" + _quoted(S.SEARCH_STOP_WORDS) + ")))"


@query(f"""WITH w AS (SELECT line_id, unnest({_WORDS}) AS word FROM line_items WHERE source_doc = 'invoice'),
t AS (SELECT pct_code, lower(description) AS d, trim(split_part(lower(description), '>', -1)) AS own FROM pct_codes),
h AS (SELECT word, pct_code, contains(own, word)::INT AS own, row_number() OVER (PARTITION BY word ORDER BY contains(own, word) DESC, length(d), pct_code) AS k FROM (SELECT DISTINCT word FROM w) JOIN t ON contains(d, word)),
c AS (SELECT line_id, pct_code, count(*) AS words, CAST(sum(own) AS BIGINT) AS own_words FROM w JOIN h USING (word) WHERE k <= 200 GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY line_id ORDER BY words DESC, own_words DESC, pct_code) AS INTEGER) AS rank FROM c)
SELECT line_id, pct_code, words, own_words, rank FROM r WHERE rank <= 15""")
def tariff_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "line_items").where("source_doc = 'invoice'")
    return tariff.candidates(lines, "line_id", "description", read_table(spark, sf_dir, "pct_codes"))


@query("""WITH p AS (SELECT pct_code, count(*) AS n, sum((duty_type = 'specific')::INT) AS s, any_value(chapter) AS chapter FROM pct_codes GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(s) AS BIGINT) AS n_specific, count(*) AS n_codes, string_agg(DISTINCT chapter, ',' ORDER BY chapter) AS chapters, count(*) FILTER (WHERE n > 1) AS n_repeated FROM p""")
def tariff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tariff.summarise(read_table(spark, sf_dir, "pct_codes"))


def tariff_cells_of(codes: DataFrame) -> DataFrame:
    """The table printed again as cells: a heading row and dash rows where the path changes, then the line."""
    steps = F.split("description", " > ")
    printed = F.when(F.col("duty_type") == "specific", F.col("specific_duty_text")).otherwise(F.col("cd_rate"))
    before = W.orderBy("ord")
    rows = codes.select("ord", "pct_code", "heading", steps.alias("steps"), printed.alias("printed"))
    rows = rows.withColumn("last_heading", F.lag("heading").over(before)).withColumn("last_steps", F.lag("steps").over(before))
    new = ~F.coalesce((F.col("heading") == F.col("last_heading")) & (F.col("steps")[0] == F.col("last_steps")[0]), F.lit(False))
    cell = lambda code, text, rate: F.struct(code.alias("code"), text.alias("descr"), rate.alias("rate"))
    dashes = lambda n: F.concat(F.repeat(F.lit("- "), n))
    parents = F.transform(F.slice(F.col("steps"), 2, F.greatest(F.size("steps") - 2, F.lit(0))), lambda s, i: F.struct(s.alias("s"), (i + 1).alias("d")))
    fresh = F.filter(parents, lambda p: new | (F.col("last_steps").isNull()) | (F.slice(F.col("last_steps"), 2, p["d"]) != F.slice(F.col("steps"), 2, p["d"])))
    subs = F.transform(fresh, lambda p: cell(F.lit(""), F.concat(dashes(p["d"]), p["s"]), F.lit("")))
    head = F.when(new, F.array(cell(F.col("heading"), F.col("steps")[0], F.lit("")))).otherwise(F.array().cast("array<struct<code:string,descr:string,rate:string>>"))
    line = F.array(cell(F.col("pct_code"), F.concat(dashes(F.size("steps") - 1), F.element_at("steps", -1)), F.col("printed")))
    cells = rows.select("ord", F.posexplode(F.concat(head, subs, line)).alias("k", "c"))
    return cells.select(F.lit(1).alias("page"), (F.col("ord") * 100 + F.col("k")).alias("row_no"), "c.code", "c.descr", "c.rate")


@query("SELECT pct_code, description, cd_rate, chapter, heading, duty_type, specific_duty_text FROM pct_codes")
def tariff_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tariff printed as cells and parsed again: the same table."""
    rows, _ = tariff.parse_cells(tariff_cells_of(read_table(spark, sf_dir, "pct_codes")))
    return rows.drop("ord")


#: A printed page with every kind of row: deleted and single headings, wrapped text, rejected lines, the concessions at the end.
HARD_CELLS = (
    (1, 1, "PCT CODE", "DESCRIPTION", "CD %"), (1, 2, "01.05", "Live poultry", ""), (1, 3, "", "- Of a weight not exceeding 185 g", ""), (1, 4, "", "- - Fowls", ""), (1, 5, "0105.1100", "- - - Day old chicks", "3"),
    (1, 6, "", "(1) of breeding stock", ""), (1, 7, "", "- Other", ""), (1, 8, "0105.9400", "- - Fowls of the species", "5"), (1, 9, "0105.9900", "- - Other birds", ""), (1, 10, "", "as listed", ""),
    (1, 11, "0105.9910", "- - Rare birds", "Rs. 105 50/ MT"), (1, 12, "0105.9920", "- - Odd birds", "free"), (2, 1, "[05.03]", "Deleted", ""), (2, 2, "0205.0000", "Meat of horses", "20"), (2, 3, "11.02", "Flour", ""),
    (2, 4, "1103.1100", "- Groats", "5"), (2, 5, "`", "", "7"), (2, 6, "", "II.- INORGANIC ACIDS", ""), (2, 7, "1102.2000", "- Maize flour", "10"), (2, 8, "9901", "Concession", "0"), (2, 9, "", "dropped after the concession", ""), (2, 10, "1102.9000", "- Other flour", "1 1"),
)


@query("""SELECT * FROM (VALUES ('0105.1100', 'Live poultry > Of a weight not exceeding 185 g > Fowls > Day old chicks (1) of breeding stock', '3', ''), ('0105.9400', 'Live poultry > Other > Fowls of the species', '5', ''),
('0105.9910', 'Live poultry > Other as listed > Rare birds', '', 'Rs. 10550/MT'), ('0205.0000', 'Meat of horses', '20', ''), ('1102.2000', 'Flour > Maize flour', '10', ''), ('1102.9000', 'Flour > Other flour', '11', ''),
('0105.9900', 'line without rate', NULL, NULL), ('0105.9920', 'unreadable rate', NULL, NULL), ('1103.1100', 'line outside its heading', NULL, NULL), ('`', 'rate without code', NULL, NULL), ('9901', 'concession entry', NULL, NULL)) AS t(code, text, cd_rate, specific_duty_text)""")
def tariff_hard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows with their path and rates, rejected ones with the reason."""
    rows, rejected = tariff.parse_cells(spark.createDataFrame(list(HARD_CELLS), "page int, row_no int, code string, descr string, rate string"))
    nothing = F.lit(None).cast("string")
    return rows.select(F.col("pct_code").alias("code"), F.col("description").alias("text"), "cd_rate", "specific_duty_text").unionByName(rejected.select("code", F.col("reject").alias("text"), nothing.alias("cd_rate"), nothing.alias("specific_duty_text")))


@query(r"""WITH f AS (SELECT line_id, line_no, trim(regexp_replace(coalesce(description, ''), '\s+', ' ', 'g')) AS flat FROM line_items)
SELECT line_id, line_no, 'quantity' AS field, CASE WHEN length(flat) <= 60 THEN flat ELSE trim(regexp_extract(flat || ' ', '^(.{0,59})(?:\s|$)', 1)) || '…' END AS short FROM f""")
def field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of fields taken apart again, and descriptions shortened for them."""
    lines = read_table(spark, sf_dir, "line_items")
    name = S.split_field(F.concat(F.lit("line_"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.lit(".quantity")))
    return lines.select("line_id", name.alias("n"), S.shorten(F.col("description")).alias("short")).select("line_id", "n.line_no", "n.field", "short")


# ---- totals and shares

def _share(charge: str, weight: str, whole: str) -> str:
    """A charge's share by weight in exact integers: hundredths of the charge, ten-thousandths of the weights."""
    c, w, s = (f"CAST({x} * {k} AS HUGEINT)" for x, k in ((charge, 100), (weight, 10000), (whole, 10000)))
    return f"CAST(CASE WHEN {whole} > 0 THEN CAST((2 * {c} * {w} + {s}) // (2 * {s}) AS DECIMAL(18,2)) / 100 ELSE 0 END AS DECIMAL(18,2))"


@query(f"""WITH h AS (SELECT consignment_id, arg_max(coalesce(freight, 0), (updated_at, opened_at, reference)) AS freight FROM consignments GROUP BY 1),
l AS (SELECT line_id, consignment_id, {NUMBER.format(c='value')} AS value FROM line_items WHERE source_doc = 'invoice'),
s AS (SELECT consignment_id, sum(value) AS whole FROM l GROUP BY 1)
SELECT line_id, {_share("freight", "value", "whole")} AS freight_share FROM l JOIN s USING (consignment_id) JOIN h USING (consignment_id)""")
def freight_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "line_items").where("source_doc = 'invoice'").select("line_id", "consignment_id", decimal_lenient(F.col("value")).alias("value"))
    headers = coerce.header_defaults(read_table(spark, sf_dir, "consignments")).select("consignment_id", "freight")
    shared = windows.apportion(lines.join(headers, "consignment_id"), ["consignment_id"], F.col("value"), {"freight_share": F.col("freight")})
    return shared.select("line_id", "freight_share")


@query(f"""SELECT consignment_id, source_doc, count(*) AS n_rows, sum({NUMBER.format(c='gross_weight_kg')}) AS gross, sum({NUMBER.format(c='value')}) AS value
FROM line_items GROUP BY ROLLUP (consignment_id, source_doc)""")
def document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "line_items")
    sums = {"gross": decimal_lenient(F.col("gross_weight_kg")), "value": decimal_lenient(F.col("value"))}
    return windows.totals(lines, ["consignment_id", "source_doc"], sums)


@query("""SELECT consignment_id, count(*) AS n_lines, count(*) FILTER (WHERE verified) AS n_verified, count(*) FILTER (WHERE NOT coalesce(verified, false)) AS n_flagged FROM line_items GROUP BY 1""")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = ~F.coalesce("verified", F.lit(False))
    return read_table(spark, sf_dir, "line_items").groupBy("consignment_id").agg(F.count("*").alias("n_lines"), F.count_if("verified").alias("n_verified"), F.count_if(flagged).alias("n_flagged"))


@query("""SELECT line_id, last_value(nullif(trim(origin), '') IGNORE NULLS) OVER (PARTITION BY consignment_id, source_doc ORDER BY line_id ROWS UNBOUNDED PRECEDING) AS origin FROM line_items""")
def filled_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "line_items").withColumn("origin", F.nullif(F.trim("origin"), F.lit("")))
    return windows.forward_fill(lines, ["consignment_id", "source_doc"], ["line_id"], "origin").select("line_id", "origin")


@query()
def exported_consignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = coerce.header_defaults(read_table(spark, sf_dir, "consignments")).select("consignment_id", "reference", "importer_status", "fx_rate", "freight", "insurance")
    lines = _documents(spark, sf_dir).select("consignment_id", "line_no", "source_doc", "description", *NUMBERS, "unit", "currency", "origin")
    return consignments_json(headers, lines)


# ---- the same operators at the size of the order tables

@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(l_extendedprice AS DECIMAL(18,4)) AS w FROM lineitem),
s AS (SELECT l_orderkey, sum(w) AS whole FROM l GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {_share("CAST(o_totalprice AS DECIMAL(18,2))", "w", "whole")} AS price_share
FROM l JOIN s USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey""")
def order_price_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.col("l_extendedprice").cast("decimal(18,4)").alias("w"))
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    shared = windows.apportion(lines.join(orders, "l_orderkey"), ["l_orderkey"], F.col("w"), {"price_share": F.col("o_totalprice")})
    return shared.drop("w", "o_totalprice")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n_rows, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS value
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    sums = {"quantity": F.col("l_quantity").cast("decimal(18,2)"), "value": F.col("l_extendedprice").cast("decimal(18,2)")}
    return windows.totals(lines, ["l_returnflag", "l_linestatus"], sums)


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name), '([0-9]+(?:[.][0-9]+)?|[a-z]+)', 1))), ' ') AS tokens FROM part""")
def part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", F.array_join(S.description_tokens(F.col("p_name")), " ").alias("tokens"))
