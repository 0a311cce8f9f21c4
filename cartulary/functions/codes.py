"""Short codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What counts as either sex in requests, and on pages besides.
MALE, FEMALE = ("M", "MASCULINO", "HOMBRE", "MALE"), ("F", "FEMENINO", "MUJER", "FEMALE")
MALE_ON_PAGES, FEMALE_ON_PAGES = (*MALE, "MASC"), (*FEMALE, "FEM")


def sex_code(value: Column) -> Column:
    """M or F for the words and abbreviations of either; else null."""
    v = F.upper(F.trim(value))
    return F.when(v.isin(*MALE_ON_PAGES), "M").when(v.isin(*FEMALE_ON_PAGES), "F")


def request_sex_code(value: Column) -> Column:
    """The narrower rule for requests: abbreviations of three letters or more are not accepted."""
    v = F.upper(F.trim(value))
    return F.when(v.isin(*MALE), "M").when(v.isin(*FEMALE), "F")


def group_code(number: Column) -> Column:
    return F.format_string("DOC-%03d", number.cast("int"))
