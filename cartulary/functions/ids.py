"""Identifier columns. Four sources accept different forms; the rules stay apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions.text import once, repair_digits


def check_id(value: Column) -> Column:
    """struct<ok, value, reason> of a document number: 7 to 10 digits, no leading zero, after spaces . , - are gone."""
    clean = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "[ .,-]", "")
    reason = (
        F.when(F.coalesce(value, F.lit("")) == "", "empty")
        .when(~clean.rlike("^[0-9]+$"), "not digits")
        .when(clean.startswith("0"), "leading zero")
        .when(F.length(clean) < 7, "too short")
        .when(F.length(clean) > 10, "too long")
    )
    return F.struct(reason.isNull().alias("ok"), F.when(reason.isNull(), clean).alias("value"), reason.alias("reason"))


def valid_id(value: Column) -> Column:
    """The clean document number, or null."""
    clean = F.regexp_replace(F.trim(value), "[ .,-]", "")
    return once(clean, lambda c: F.when(c.rlike("^[0-9]+$") & ~c.startswith("0") & F.length(c).between(7, 10), c))


def request_id(value: Column) -> Column:
    """The form that requests accept: 6 to 10 digits after spaces . , are gone; a leading zero is allowed."""
    clean = F.regexp_replace(value, "[ .,]", "")
    return F.when(clean.rlike("^[0-9]{6,10}$"), clean)


def is_sheet_id(value: Column) -> Column:
    """The form that spreadsheets may hold: 6 to 12 digits."""
    return F.coalesce(F.trim(value).rlike("^[0-9]{6,12}$"), F.lit(False))


def _first_valid(candidates: Column) -> Column:
    return F.get(F.filter(F.transform(candidates, valid_id), lambda v: v.isNotNull()), 0)


def id_from_text(text: Column, keywords: Sequence[str] = ("NUMBER", "DOCUMENT", "ID")) -> Column:
    """A page's document number by four rules in turn: after a keyword (the first keyword counts before its place),
    dotted, a line of digits alone, or a run of seven characters that repair to digits."""
    found = lambda pattern, source=text: F.regexp_extract_all(source, F.lit(pattern), F.lit(1))
    by_word = [_first_valid(found(rf"{k}[ .:]*([1-9][0-9. ]{{5,12}}[0-9])", F.upper(text))) for k in keywords]
    dotted = _first_valid(found(r"([1-9][0-9]{0,2}(?:\.[0-9]{3}){2,3})"))
    alone = _first_valid(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9. ]{7,14}$")))
    repaired = _first_valid(F.transform(found(r"([0-9OoQDlIiBbSsZzGgqAT|!]{7,10})"), repair_digits))
    return F.coalesce(*by_word, dotted, alone, repaired)


def footer_id(text: Column) -> Column:
    """struct<id, sex> of a barcode footer such as X-1234567-12345678-M-0012345678-20200101."""
    pattern = r"[A-Z]-[0-9]+-[0-9]+-([MF])-([0-9]+)-"
    return F.struct(valid_id(F.regexp_replace(F.regexp_extract(text, pattern, 2), "^0+", "")).alias("id"), F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).alias("sex"))


def synthetic_id(*key: Column) -> Column:
    """A stand-in for a missing number, the same for the same key."""
    return F.concat(F.lit("SIN_ID_"), F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 8))


def is_synthetic(value: Column) -> Column:
    return F.upper(value).contains("SIN_ID")


def mrz_fields(text: Column, country: str = "XXX", pivot: int = 25, keep_sex: bool = False) -> Column:
    """struct<birth_date, id, surnames, given, sex> of machine-readable lines.

    Years up to the pivot are of this century. Page text uses pivot 25 and drops the sex; lines with a layout use
    pivot 30 and keep it: two rules that disagree, both kept.
    """
    return once(text, lambda t: _machine(t, country, pivot, keep_sex))


def _machine(text: Column, country: str, pivot: int, keep_sex: bool) -> Column:
    dates = r"([0-9]{2})([0-9]{2})([0-9]{2})[0-9]([MF])[0-9]{6}"
    part = lambda i: F.regexp_extract(text, dates, i)
    century = F.when(part(1).try_cast("int") <= pivot, "20").otherwise("19")
    born = F.try_to_date(F.nullif(F.concat(century, part(1), F.lit("-"), part(2), F.lit("-"), part(3)), F.lit("19--")), "yyyy-MM-dd")
    names = r"([A-Z]+(?:<[A-Z]+)*)<<([A-Z]+(?:<[A-Z]+)*)"
    name = lambda i: F.when(text.contains("<<"), F.nullif(F.translate(F.regexp_extract(text, names, i), "<", " "), F.lit("")))
    sex = F.nullif(part(4), F.lit("")) if keep_sex else F.lit(None).cast("string")
    return F.struct(born.alias("birth_date"), valid_id(F.regexp_extract(text, rf"{country}([0-9]{{7,10}})", 1)).alias("id"), name(1).alias("surnames"), name(2).alias("given"), sex.alias("sex"))
