"""Small tables for tests."""

LINE = (
    "line_id long, consignment_id string, shipper_id string, source_doc string, line_no int, description string, quantity string, unit string, unit_price string, currency string, "
    "value string, net_weight_kg string, gross_weight_kg string, origin string, incoterm string, page int, quote string, verified boolean, verify_note string"
)
NAMES = [c.split()[0] for c in LINE.split(", ")]


def line_items(spark, *rows, **extra):
    """Rows given as dicts; what is missing is null. ``extra`` adds columns with one value."""
    from pyspark.sql import functions as F

    table = spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], LINE)
    return table.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else table


def ref_values(spark, data):
    return spark.read.parquet(f"{data}/ref_values.parquet")
