"""Neighbouring lines of a page: windows over (document, page) in line order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cartulary.functions.codes import sex_code
from cartulary.functions.dates import compact_date, parse_date
from cartulary.functions.places import place_name
from cartulary.functions.text import is_text_line, once, person_name

PAGE = ("document_id", "page_number")


def _order(keys, by: str = "line_index") -> W.WindowSpec:
    return W.Window.partitionBy(*keys).orderBy(by)


def split_lines(df: DataFrame, text: str, keys) -> DataFrame:
    """One row a line of a text: keys, line_index from 0, text; blank lines keep their place but are left out."""
    rows = df.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_index", "text"))
    return rows.where(F.trim("text") != "")


def with_neighbours(lines: DataFrame, keys=PAGE, before: int = 1, after: int = 3) -> DataFrame:
    """Lines with previous_1.., next_1.. of the same page, null beyond its ends."""
    w = _order(keys)
    return lines.withColumns({f"previous_{i}": F.lag("text", i).over(w) for i in range(1, before + 1)} | {f"next_{i}": F.lead("text", i).over(w) for i in range(1, after + 1)})


def next_valid(lines: DataFrame, keys=PAGE, ahead: int = 4) -> DataFrame:
    """Lines with next_valid: the first of the next lines that can be a name."""
    valid = F.when(is_text_line(F.col("text")), F.trim("text"))
    return lines.withColumn("next_valid", F.first(valid, ignorenulls=True).over(_order(keys).rowsBetween(1, ahead)))


def previous_valid(lines: DataFrame, keys=PAGE) -> DataFrame:
    valid = F.when(is_text_line(F.col("text")), F.trim("text"))
    return lines.withColumn("previous_valid", F.lag(valid, 1).over(_order(keys)))


def lines_above(lines: DataFrame, keys=PAGE, most: int = 2) -> DataFrame:
    """Lines with above: up to `most` texts just before, the nearest last."""
    return lines.withColumn("above", F.collect_list("text").over(_order(keys).rowsBetween(-most, -1)))


def around(lines: DataFrame, keys=PAGE, before: int = 2, after: int = 3) -> DataFrame:
    """Lines with around: the texts from `before` lines before to `after` lines after, in order."""
    return lines.withColumn("around", F.collect_list("text").over(_order(keys).rowsBetween(-before, after)))


def reading_order(boxes: DataFrame, keys=PAGE) -> DataFrame:
    """Lines or regions numbered from the top; ties by line_index."""
    return boxes.withColumn("position", F.row_number().over(W.Window.partitionBy(*keys).orderBy("y", "line_index")))


def names_by_position(lines: DataFrame, label: str, keys=PAGE) -> DataFrame:
    """(keys, value) of the line of a label: the valid line before it, else the first valid one of the next."""
    near = next_valid(previous_valid(lines, keys), keys)
    hit = near.where(F.upper("text").rlike(rf"\b{label}\b"))
    return hit.groupBy(*keys).agg(F.min_by(F.coalesce("previous_valid", "next_valid"), "line_index").alias("value"))


def sex_near(lines: Column, keyword: str = "SEX") -> Column:
    """The sex on the keyword's line, alone on the line before, or on one of the next three."""

    def found(s: Column) -> Column:
        upper, at = s["upper"], s["at"]
        inline = F.regexp_extract(F.get(upper, at), rf"{keyword}[ :]*(M|F|MASC|FEM)\b", 1)
        alone = F.transform(F.concat(F.slice(upper, F.greatest(at, F.lit(1)), F.when(at > 0, 1).otherwise(0)), F.slice(upper, at + 2, 3)), sex_code)
        return F.when(at.isNotNull(), F.coalesce(once(inline, lambda x: sex_code(F.nullif(x, F.lit("")))), F.get(F.filter(alone, lambda x: x.isNotNull()), 0)))

    at = lambda upper: F.get(F.filter(F.transform(upper, lambda x, i: F.when(x.rlike(rf"\b{keyword}\b"), i)), lambda i: i.isNotNull()), 0)
    upper = F.transform(lines, lambda x: F.upper(F.trim(x)))
    return once(once(upper, lambda u: F.struct(u.alias("upper"), at(u).alias("at"))), found)


def _first_index(lines: Column, pattern: str) -> Column:
    return F.get(F.filter(F.transform(lines, lambda x, i: F.when(F.upper(x).rlike(pattern), i)), lambda i: i.isNotNull()), 0)


def compact_date_after(lines: Column, keyword: str, ahead: int = 2) -> Column:
    """The first compact date on the lines after a keyword's."""
    at = _first_index(lines, rf"\b{keyword}\b")
    found = F.filter(F.transform(F.slice(lines, F.coalesce(at, F.lit(0)) + 2, ahead), compact_date), lambda d: d.isNotNull())
    return F.when(at.isNotNull(), F.get(found, 0))


def date_and_place(lines: Column, keyword: str, before: int = 2, after: int = 3) -> Column:
    """struct<date, place> of the first line "DATE[,] PLACE" around a keyword's line, else anywhere."""
    pattern = r"^\s*([0-9]{1,2}[ \-/.]?[A-Z]{3,4}[ \-/.]?[0-9]{4})[,.]?\s+(\D{3,})$"
    pair = lambda x: F.struct(parse_date(F.regexp_extract(F.upper(x), pattern, 1)).alias("date"), place_name(F.regexp_extract(F.upper(x), pattern, 2)).alias("place"))
    first = lambda xs: F.get(F.filter(F.transform(xs, pair), lambda p: p["date"].isNotNull() & p["place"].isNotNull()), 0)
    at = _first_index(lines, rf"\b{keyword}\b")
    start = F.greatest(F.coalesce(at, F.lit(0)) - before, F.lit(0))
    near = F.slice(lines, start + 1, F.coalesce(at, F.lit(0)) + after + 1 - start)
    return F.coalesce(F.when(at.isNotNull(), first(near)), first(lines))


def line_before_label(lines: Column, label: str) -> Column:
    """The name on the line before a line that holds nothing but a label."""
    at = _first_index(lines, rf"^\s*{label}\s*$")
    return F.when(at > 0, person_name(F.get(lines, at - 1)))


def words_after_label(text: Column, label: str, most: int = 5) -> Column:
    """Up to five words after a label, cleaned as a name."""
    found = F.regexp_extract(F.upper(text), rf"{label}[ :.]*\n?\s*((?:[A-ZÁÉÍÓÚÜÑ]+[ ]?){{1,{most}}})", 1)
    return person_name(F.nullif(found, F.lit("")))
