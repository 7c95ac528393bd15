"""Names under which the entries of the canonical list are typed: from the list, the JVM's locale data and fixed text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.unit_names import NO_UNITS, UNIT_NAMES

#: Languages whose names of countries are taken from the JVM's locale data.
LANGUAGES = "en fr de es it pt nl sv da nb fi pl cs sk sl hr hu ro bg sr el tr ru uk uz kk ar fa ur hi bn ta si my th vi id ms ko ja zh zh-Hant am sw et lv lt he".split()
#: Further names of countries, by ISO code; abbreviated and misspelt forms are left to the repair.
COUNTRY_NAMES = {
    "CN": "中华人民共和国|中國|prc|mainland china|red china|zhongguo|chine populaire",
    "VN": "viet nam",
    "DE": "brd|frg|rfa",
    "AT": "oesterreich|republik osterreich",
    "US": "usa|us|united states of america|the united states|america|eeuu|ee uu|etats unis d amerique|estados unidos de america",
    "GB": "uk|gb|great britain|england|britain|scotland|wales|angleterre|grossbritannien|inglaterra|gran bretana",
    "AE": "uae|u a e|emirates|emirats|emiratos|dubai|abu dhabi|الإمارات",
    "KR": "한국|rok|republic of korea|korea republic of|coree du sud|corea del sur",
    "TR": "turkiye|turkey|turquie|turquia",
    "IR": "persia|iran islamic republic of|perse",
    "IQ": "irak",
    "IN": "bharat|hindustan|union of india",
    "ID": "nkri",
    "SK": "slovensko",
    "SI": "slovenija",
    "NL": "holland|nederland|the netherlands|hollande|olanda",
    "CH": "suisse|schweiz|svizzera|svizra|helvetia",
    "SE": "sverige",
    "ES": "espana",
    "IT": "italia",
    "FR": "republique francaise",
    "PL": "polska",
    "BR": "brasil",
    "MX": "mejico",
    "JP": "日本国|nippon|nihon|nippon koku",
    "TH": "siam|prathet thai|ประเทศไทย",
    "LK": "ceylon",
    "PK": "pak",
    "EG": "misr",
    "MA": "maroc|al maghrib",
    "ZA": "rsa|suid afrika",
    "ET": "abyssinia",
    "RU": "rossiya|rossija|russian federation",
    "UA": "ukraina",
    "GR": "hellas|ellada|grece",
    "CZ": "cesko|czech republic|tchequie",
    "MM": "burma|birmanie|birma",
    "CI": "elfenbeinkuste|costa de marfil|costa d avorio|cote d ivoire|cote divoire|ivory coast|rep of cote d ivoire",
    "TW": "台灣|臺灣|formosa|chinese taipei|taiwan roc|taiwan province of china",
}
#: Names that are no single country of any list.
NO_COUNTRIES = "eu|european union|eec|ussr|cis|yugoslavia|swaziland|zaire|korea|north korea|dpr korea|dprk|africa|asia|europe|america latina|foreign|various|mixed|mixed origin|unknown|see remarks|ditto|same as above|not declared|as per attached|as per b l|origin to follow|to be advised|tba|tbc|n a|na|nil|none|other|others|imported|domestic|international"
#: The terms of trade under other names, and terms that are not in the list.
TERM_NAMES = {
    "EXW": "ex works|ex factory|ex mill|ex warehouse|ex work|exworks|ex works factory",
    "FOB": "free on board|free on board vessel|fob stowed|fobst",
    "CFR": "cost and freight|cnf|candf|c and f|caf|cost freight",
    "CIF": "cost insurance and freight|cost insurance freight|cost insur and freight|cost ins and freight",
    "CPT": "carriage paid to|carriage paid|carriage paid to destination|freight carriage paid to",
    "CIP": "carriage and insurance paid to|carriage and insurance paid|carriage insurance paid to",
    "DAP": "delivered at place",
    "DDP": "delivered duty paid|duty paid delivered",
    "FCA": "free carrier",
    "FAS": "free alongside ship|free along side ship|free alongside vessel",
}
NO_TERMS = "ddu|delivered duty unpaid|des|delivered ex ship|deq|delivered ex quay|daf|delivered at frontier|dat|delivered at terminal|dpu|delivered at place unloaded|foc|free of charge|fot|free on truck|free on rail|freight collect|freight prepaid|prepaid|collect|as agreed|door to door|net 30 days|l c at sight|t t advance|n a|na|cad|cash against documents|fio|free in and out|free house|franco|to be advised|tba"
#: Words that only announce an entry.
STOP_WORDS = {
    "origin": "made in product of origin grown mfd manufactured produced coo certified fta country the and or la le de et y und du des from 100 percent rep republic pr fr sr ar ir rp",
    "unit": "of the in per",
    "incoterm": "terms term incoterms incoterm the inco 2000 2010 2020 delivery shipment port",
}


#: Kinds of knowledge that may be left out: names from the locale data, and the fixed spellings above.
LOCALE, SPELLINGS = "locale", "spellings"
ALL = (LOCALE, SPELLINGS)


def _locale_rows(spark: SparkSession) -> list[tuple[str, str, str, str]]:
    """Names of all countries in all languages; an unlisted one takes part by few languages and its codes."""
    rows = []
    locale = spark.sparkContext._jvm.java.util.Locale
    languages = [locale.forLanguageTag(x) for x in LANGUAGES]
    for code in locale.getISOCountries():
        country = locale("", code)
        rows += [("origin", code, country.getDisplayCountry(x), "any" if k < 4 else "listed") for k, x in enumerate(languages)]
        rows += [("origin", code, code, "unlisted"), ("origin", code, country.getISO3Country(), "unlisted")]
    return rows


def _spelling_rows() -> list[tuple[str, str, str, str]]:
    """The fixed spellings; what means no entry has no code."""
    rows = [("origin", code, name, "any") for code, names in COUNTRY_NAMES.items() for name in names.split("|")]
    rows += [("origin", "", name, "any") for name in NO_COUNTRIES.split("|")]
    for field, known, outside, mark in (("unit", UNIT_NAMES, NO_UNITS.split(), " "), ("incoterm", TERM_NAMES, NO_TERMS.split("|"), "|")):
        rows += [(field, code, name, "listed") for code, names in known.items() for name in names.split(mark)]
        rows += [(field, "", name, "any") for name in outside]
    return rows


def alias_table(spark: SparkSession, refs: DataFrame, knowledge: tuple[str, ...] = ALL) -> DataFrame:
    """(field, ref_id, alias, own): every known name of every entry; ref_id 0 for names of things outside the list.

    ``own`` marks the names that the list itself gives. The list may have any length: it is only joined. ``knowledge``
    says what is added to it, some ten thousand names by construction.
    """
    listed = refs.select("field", "ref_id", F.when(F.col("field") == "origin", F.col("code2")).otherwise(F.col("ref_value")).alias("code"))
    own = refs.select("field", "ref_id", F.explode(F.array("ref_value", "long_name", "code2", "code3")).alias("alias"), F.lit(True).alias("own"))
    rows = (_locale_rows(spark) if LOCALE in knowledge else []) + (_spelling_rows() if SPELLINGS in knowledge else [])
    if not rows:
        return own.where("trim(alias) <> ''")
    added = spark.createDataFrame(rows, "field string, code string, alias string, use string").join(listed, ["field", "code"], "left")
    kept = F.when(F.col("ref_id").isNull(), F.col("use").isin("any", "unlisted")).otherwise(F.col("use") != "unlisted")
    return own.unionByName(added.where(kept).select("field", F.coalesce("ref_id", F.lit(0)).alias("ref_id"), "alias", F.lit(False).alias("own"))).where("trim(alias) <> ''")
