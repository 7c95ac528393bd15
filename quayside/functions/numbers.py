"""Printed numbers: tolerant decimal and the separators' rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One printed number: grouped by spaces or apostrophes, or by points and commas.
#: Repeats are possessive: the engine would otherwise recurse once for each of them.
NUMBER = "(?:[0-9]{1,3}(?:[ '][0-9]{3})++(?:[.,][0-9]+)?(?![0-9])|[0-9]+(?:[.,][0-9]+)*+)"


def decimal_lenient(text: Column, default: str = "0") -> Column:
    """Keep digits, point and minus, read the rest as a decimal; the default where that fails."""
    kept = F.regexp_replace(text, "[^0-9.\\-]", "")
    return F.coalesce(kept.try_cast("decimal(18,4)"), F.lit(default).cast("decimal(18,4)"))


def parse_status(text: Column) -> Column:
    """blank, clean, or lossy where characters other than commas were dropped on reading."""
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "blank")
        .when(F.regexp_replace(text, "[0-9.,\\-]", "") == "", "clean")
        .otherwise("lossy")
    )


def printed_number(text: Column) -> Column:
    """A printed number as decimal(38,12), null where it is none or too large.

    The later of ``.`` and ``,`` is the decimal mark where both occur; a comma before exactly three digits
    groups thousands, as do several commas or several points; any other single comma and a single point are
    decimal marks; spaces and apostrophes group thousands. Text of any length is read.
    """
    t = F.regexp_replace(text, "[ ']", "")
    both = t.contains(".") & t.contains(",")
    comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
    plain = (
        F.when(~text.rlike("[,' ]") & ~text.rlike("[.].*[.]"), text)
        .when(both & comma_last, F.regexp_replace(F.regexp_replace(t, "[.]", ""), ",", "."))
        .when(both, F.regexp_replace(t, ",", ""))
        .when(t.rlike("^[0-9]+(,[0-9]{3})++$"), F.regexp_replace(t, ",", ""))
        .when(t.rlike("^[0-9]+,[0-9]+$"), F.regexp_replace(t, ",", "."))
        .when(t.rlike("^[0-9]+([.][0-9]+){2,}+$"), F.regexp_replace(t, "[.]", ""))
        .otherwise(t)
    )
    return plain.try_cast("decimal(38,12)")
