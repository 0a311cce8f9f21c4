"""Names on a page by the order of their labels: a scan over its lines from the top that carries state past each line.

Two forms are told apart by which label stands first. With the surname label above the given-name label, values stand
above their labels: at most the two nearest lines between this label and the one before it. Otherwise they stand below:
all lines between the labels, then at most two lines after the surname label. A value on the label's own line counts
before either. A page without both labels, or without values near them, has its first two clean lines.

A line keeps, of all lines above it, the two nearest that can be a name; that and the two lines below is all that a
label asks of its page. So one window in line order serves every rule, and no page is gathered in one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cartulary.functions.text import LETTERS, NAME_STOP_WORDS, label_name

PAGE = ["document_id", "page_number"]
#: Synthetic labels of a form; callers pass their own.
NUMBER_LABEL, SURNAME_LABEL, GIVEN_LABEL = r"\b(NUMBER|DOCUMENT NO)\b", r"\b(SURNAMES?|FAMILY NAMES?)\b", r"\b(GIVEN NAMES?|FORENAMES?)\b"
#: Words that make a line a heading wherever they stand in it.
HEADINGS = ("REGISTER", "REPUBLIC", "IDENTIF")
#: The part of the page with names, the part of it where clean lines count, the lines above a label
#: that count if no number stands before it, and what a clean line's confidence is of the page's.
ZONE, CLEAN_ZONE, REACH, CLEAN_SHARE = 0.55, (0.10, 0.50), 3, 0.75


def _named(text: Column, label: str | None, stop_words: Sequence[str]) -> Column:
    """A line as a name, without the label that it bears."""
    return label_name(text if label is None else F.regexp_replace(text, f"(?i){label}", ""), stop_words)


def name_candidates(
    lines: DataFrame, number: str = NUMBER_LABEL, surname: str = SURNAME_LABEL, given: str = GIVEN_LABEL, stop_words: Sequence[str] = NAME_STOP_WORDS, headings: Sequence[str] = HEADINGS
) -> DataFrame:
    """One row a page: document_id, page_number, surname_inline, surname_near, given_inline, given_near, first_clean, second_clean.

    lines: document_id, page_number, line_index, text, y. Lines of one height count by line_index. Near values are
    null unless the page bears both labels; a page without lines in the zone has no row. Null texts are no names.
    """
    page, order = W.Window.partitionBy(*PAGE), W.Window.partitionBy(*PAGE).orderBy("y", "line_index")
    above = order.rowsBetween(W.Window.unboundedPreceding, -1)
    text = F.coalesce("text", F.lit(""))
    upper = F.upper(F.trim(text))
    lone = F.regexp_replace(upper, "[^0-9]", "").rlike("^[0-9]{7,10}$")
    rows = lines.where(F.col("y") < ZONE).select(*PAGE, "line_index", "y", text.alias("text"), upper.alias("upper"), _named(text, None, stop_words).alias("clean"))
    rows = rows.withColumn("pos", F.row_number().over(order) - 1)
    first = lambda c: F.min(F.when(c, F.col("pos"))).over(page)
    rows = rows.withColumns({"num": first(F.col("upper").rlike(number) | lone), "sur": first(F.col("upper").rlike(surname)), "giv": first(F.col("upper").rlike(given))})
    own = F.when(F.col("clean").isNotNull(), F.struct("pos", "clean"))
    rows = rows.withColumn("before", F.last(own, ignorenulls=True).over(above))
    pair = F.when(F.col("clean").isNotNull(), F.struct("pos", "clean", F.col("before.pos").alias("pos2"), F.col("before.clean").alias("clean2")))
    word, heading = F.col("clean").rlike(f"[{LETTERS}]{{3,}}"), F.col("clean").rlike("|".join(headings)) if headings else F.lit(False)
    fit = F.when(F.col("y").between(*CLEAN_ZONE) & ~F.col("y").isin(*CLEAN_ZONE) & word & ~heading & ~F.col("text").rlike("[0-9]"), F.col("clean"))
    rows = rows.withColumns({"near": F.last(pair, ignorenulls=True).over(above), "next1": F.lead("clean", 1).over(order), "next2": F.lead("clean", 2).over(order), "fit": fit})
    rows = rows.withColumn("first_clean", F.first("fit", ignorenulls=True).over(order.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)))

    def last_two(low: Column) -> Column:
        """The nearest clean lines from a position on, in page order; at most two."""
        part = lambda pos, clean: F.when(F.col(f"near.{pos}") >= low, F.col(f"near.{clean}"))
        return F.concat_ws(" ", part("pos2", "clean2"), part("pos", "clean"))

    is_above = F.col("sur") < F.col("giv")
    low = F.when(F.col("num") < F.col("sur"), F.col("num") + 1).otherwise(F.greatest(F.lit(0), F.col("sur") - REACH))
    at_surname, at_given = F.col("pos") == F.col("sur"), F.col("pos") == F.col("giv")
    between = F.when((F.col("pos") > F.col("giv")) & (F.col("pos") < F.col("sur")) & F.col("clean").isNotNull(), F.struct("pos", "clean"))
    both = F.col("sur").isNotNull() & F.col("giv").isNotNull()
    held = rows.groupBy(*PAGE).agg(
        F.max(F.when(both & at_surname, _named(F.col("text"), surname, stop_words))).alias("surname_inline"),
        F.max(F.when(both & at_given, _named(F.col("text"), given, stop_words))).alias("given_inline"),
        F.max(F.when(both & at_surname, F.when(is_above, last_two(low)).otherwise(F.concat_ws(" ", "next1", "next2")))).alias("surname_near"),
        F.max(F.when(both & at_given & is_above, last_two(F.col("sur") + 1))).alias("given_near"),
        F.array_sort(F.collect_list(F.when(both & ~is_above, between))).alias("between"),
        F.max("first_clean").alias("first_clean"),
        F.min_by("fit", F.when(F.col("fit").isNotNull() & (F.col("fit") != F.col("first_clean")), F.col("pos"))).alias("second_clean"),
    )
    joined = F.array_join(F.transform("between", lambda x: x["clean"]), " ")
    some = lambda c: F.nullif(c, F.lit(""))
    return held.select(*PAGE, "surname_inline", some(F.col("surname_near")).alias("surname_near"), "given_inline", some(F.coalesce("given_near", joined)).alias("given_near"), "first_clean", "second_clean")


def choose_names(surname: Column, given: Column, confidence: float = 0.95) -> Column:
    """struct<surnames, given_names>, each struct<value, confidence, source>, from the columns of name_candidates().

    surname, given: what machine-readable lines give, or null. If they give both, these stand; else a value on a
    label's own line comes first, then theirs, then one near its label, then clean lines.
    """
    known = surname.isNotNull() & given.isNotNull()

    def chosen(own: Column, name: str, clean: Column) -> Column:
        one = lambda value, source, share: F.when(value.isNotNull(), F.struct(value.alias("value"), share.alias("confidence"), F.lit(source).alias("source")))
        by_label = F.lit(confidence)
        return F.when(known, one(own, "machine", F.lit(0.98))).otherwise(
            F.coalesce(
                one(F.col(f"{name}_inline"), "on the label's line", by_label), one(own, "machine", F.lit(0.98)), one(F.col(f"{name}_near"), "order of labels", by_label), one(clean, "clean lines", F.lit(confidence * CLEAN_SHARE))
            )
        )

    return F.struct(chosen(surname, "surname", F.col("first_clean")).alias("surnames"), chosen(given, "given", F.col("second_clean")).alias("given_names"))


def page_names(lines: DataFrame, confidence: float = 0.95, **labels) -> DataFrame:
    """One row a page: document_id, page_number, surnames, given_names (struct<value, confidence, source>, null if none)."""
    none = F.lit(None).cast("string")
    names = F.transform(F.array(choose_names(none, none, confidence)), lambda x: x)[0]
    return name_candidates(lines, **labels).select(*PAGE, names.alias("n")).select(*PAGE, "n.surnames", "n.given_names")
