"""Names of units of measure and packages: a fixed vocabulary, as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Spellings in use, by code; letters and digits only. UN/ECE trade codes are among them.
UNIT_NAMES = {
    "KG": "kg kgs kgm kilo kilos kilogram kilograms kilogramme kilogrammes",
    "G": "g gr grm grms gm gms gram grams gramme grammes",
    "MT": "mt mton mtons metricton metrictons metrictonne metrictonnes mts ton tons tonne tonnes tne",
    "QTL": "qtl qtls quintal quintals quintl dtn",
    "LB": "lb lbs lbr pound pounds pnd pnds",
    "OZ": "oz ozs onz ounce ounces",
    "STN": "stn shortton shorttons shton shtons shtn uston ustons",
    "L": "l lt ltr ltrs lit lits litre litres liter liters",
    "ML": "ml mls mlt millilitre millilitres milliliter milliliters",
    "GAL": "gal gals gll gallon gallons usgallon usgallons usgal usgals gallonus gallonsus",
    "M": "m mtr mtrs metre metres meter meters linm",
    "CM": "cm cms cmt centimetre centimetres centimeter centimeters",
    "FT": "ft fot foot feet linft",
    "YD": "yd yds yrd yard yards",
    "KM": "km kms kmt kilometre kilometres kilometer kilometers",
    "M2": "m2 mtk sqm sqmtr sqmtrs sqmt sqmetre sqmetres squaremetre squaremetres squaremeter squaremeters",
    "FT2": "ft2 ftk sqft sqfeet sqfoot squarefoot squarefeet",
    "PC": "pc pcs pce pces piece pieces each ea h87",
    "DOZ": "doz dozs dz dzn dzns dozn dozen dozens",
    "GRO": "gro grs gross grosses gross144 grof144",
    "PR": "pr prs npr pair pairs",
    "THO": "tho mil mille thousand thousandpcs thousandpieces thsd 000pcs",
    "SET": "set sets",
    "BAG": "bag bags bg bgs ppbag ppbags jutebag jutebags 25kgbag 25kgbags 50kgbag 50kgbags",
    "CTN": "ct ctn ctns carton cartons cartn cartns",
    "BOX": "bx bxs box boxes woodenbox woodenboxes",
    "CS": "cs case cases",
    "DRM": "dr drm drms drum drums steeldrum steeldrums",
    "ROL": "ro rol roll rolls rls rll",
    "PLT": "px plt plts pallet pallets skidpallet skidpallets",
    "BDL": "be bdl bdls bndl bundle bundles",
    "PKT": "pa pkt pkts packet packets",
}
#: Words that stand where a unit should and are none of the list.
NO_UNITS = "barrel barrels container containers unitprice teu feu 40fcl 20fcl ream reams skein skeins jar jars bushel bushels lot lots carat carats kwh shipment shipments na seepl aslist asperlist au can cans cone cones"


def unit_name_table(spark: SparkSession) -> DataFrame:
    """(alias, ref_value): the vocabulary as a table of under 250 rows; no-units have an empty ref_value."""
    rows = [(a, code) for code, names in UNIT_NAMES.items() for a in names.split()] + [(a, "") for a in NO_UNITS.split()]
    return spark.createDataFrame(rows, "alias string, ref_value string")
