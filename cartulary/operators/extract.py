"""Reading a record's fields off a page's lines, and off a document's two sides.

Blocks in turn: machine-readable lines; the number at the top of the page, then the footer; names by the order of
their labels; dates; place; sex. A field keeps the value of the first block that gives one, but two dates on the page
overwrite a birth date that was read from machine-readable lines, and a lone letter at its place on the page a sex.
Only fields that no block gives are looked for by their place to labels, each line serving one of them.
All of it is built-in expressions, windows and joins on the page.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cartulary.functions import dates, ids
from cartulary.functions.codes import sex_code
from cartulary.functions.places import place_in_parentheses, place_name
from cartulary.functions.text import PLACE_STOP_WORDS, label_name, once
from cartulary.operators import merge, names, spatial
from cartulary.operators.lines import sex_near

PAGE = ["document_id", "page_number"]
FIELDS = ("id_number", "surnames", "given_names", "birth_date", "issue_date", "issue_place", "sex")
#: The order in which fields take lines; a line serves one.
RANKED = ("surnames", "given_names", "id_number", "birth_date", "issue_date", "issue_place", "sex")
#: Where the number of a record stands, where places stand, and where a lone letter is a sex.
TOP, BODY, SEX_Y, SEX_X = 0.35, 0.28, 0.20, 0.45


def typed(field: Column, text: Column, region_words: Sequence[str] = PLACE_STOP_WORDS) -> Column:
    """A candidate's text as its field's value; null if it can't be one."""
    date = F.date_format(once(dates.parse_date(text), lambda d: dates.plausible(d)), "yyyy-MM-dd")
    return (
        F.when(field == "id_number", ids.valid_id(text))
        .when(field.isin("birth_date", "issue_date"), date)
        .when(field == "sex", sex_code(text))
        .when(field == "issue_place", F.when(~text.rlike("[0-9]"), place_name(text, region_words)))
        .otherwise(label_name(text))
    )


def ranked_fields(lines: DataFrame, labels: Mapping[str, Sequence[str]] = spatial.LABELS, wanted: DataFrame | None = None) -> DataFrame:
    """(page, field, value, confidence, status, source) by place to the field's label; a line serves one field.

    What follows a label on its own line is a candidate as well, in a box set off by .3 of the label's width; the line
    of another field's label is none. wanted: (page, field) of the fields to look for; without it all. Only fields
    whose best candidate is VALID have a row.
    """
    found = spatial.find_labels(lines, labels).withColumn("label_lines", F.collect_set("label_index").over(W.Window.partitionBy(*PAGE)))
    found = spatial.with_regions(found)
    if wanted is not None:
        # two labels of names shape the regions of all, so fields leave after the regions are known
        found = found.join(wanted.select(*PAGE, "field"), [*PAGE, "field"], "left_semi")
    patterns = F.create_map(*[F.lit(x) for f, p in labels.items() for x in (f, "|".join(sorted(p, key=len, reverse=True)))])
    rest = F.trim(F.regexp_replace(F.col("label_text"), F.concat(F.lit("^.*?("), patterns[F.col("field")], F.lit(")[ :.]*")), F.lit("")))
    shifted = F.struct((F.col("label.x") + F.col("label.w") * 0.3).alias("x"), F.col("label.y").alias("y"), F.col("label.w").alias("w"), F.col("label.h").alias("h"))
    # each label meets each line of its page once: its own as what follows it, in no region, others but lines of labels
    own = F.col("line_index") == F.col("label_index")
    others = lines.select(*PAGE, "line_index", "text", "confidence", spatial.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("candidate"))
    met = found.join(others, PAGE).where(own | ~F.array_contains("label_lines", F.col("line_index")))
    met = met.withColumns({"region": F.when(~own, F.col("region")), "candidate": F.when(own, shifted).otherwise(F.col("candidate"))})
    met = met.withColumn("r", spatial.relation(F.col("label"), F.col("candidate"), F.col("region"))).where(F.col("r.relation").isin(*spatial.COMPATIBLE))
    said = met.select(*PAGE, "field", "line_index", "confidence", "r.relation", F.col("r.score").alias("spatial"), F.when(own, rest).otherwise(F.col("text")).alias("text"), own.alias("own")).where("NOT own OR text <> ''")
    # values are made of lines that stand in their place, once each: Spark moves no filter below a generator
    fit = said.select("*", F.explode_outer(F.array(typed(F.col("field"), F.col("text")))).alias("value")).where(F.col("value").isNotNull()).drop("text", "own")
    best = spatial.exclusive(fit, [f for f in RANKED if f in labels], valid_only=True)
    return best.select(*PAGE, "field", "value", F.col("score").alias("confidence"), "status", F.lit("spatial").alias("source"))


def _entry(field: str, value: Column, confidence: float, source: str) -> Column:
    return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(confidence).alias("confidence"), F.lit("VALID").alias("status"), F.lit(source).alias("source"))


def _top_id(ls: Column) -> Column:
    """The first valid number, dotted or plain, on the lines at the top of the page."""
    found = F.flatten(F.transform(F.filter(ls, lambda x: x["y"] < TOP), lambda x: F.regexp_extract_all(F.upper(x["text"]), F.lit(r"\b(\d{1,3}(?:\.\d{3}){1,3}|\d{7,10})\b"), F.lit(1))))
    return F.get(F.filter(F.transform(found, ids.valid_id), lambda v: v.isNotNull()), 0)


def _page_dates(ls: Column) -> Column:
    """The distinct plausible dates of all lines, in order; of a line whose month can't be read, a day in January."""
    # a date has a year of four digits
    each = F.flatten(F.transform(F.filter(ls, lambda x: x["text"].rlike("[0-9]{4}")), lambda x: F.array_append(dates.dates_of(x["text"]), dates.rescued_month(F.trim(x["text"])))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(each, lambda d: dates.plausible(d)), lambda d: d.isNotNull())))


def _placed_sex(ls: Column) -> Column:
    """The last lone M or F right of the middle, or letter after a height or a blood group."""
    after = lambda t: F.nullif(F.regexp_extract(t, r"\b(?:1\.\d{2}|[ABO][+-])\s+([MF])\b", 1), F.lit(""))
    of = lambda x, t: F.coalesce(F.when(t.isin("M", "F") & (x["y"] > SEX_Y) & (x["x"] > SEX_X), t), after(t))
    hits = F.filter(F.transform(ls, lambda x: of(x, F.upper(F.trim(x["text"])))), lambda v: v.isNotNull())
    return once(hits, lambda h: F.get(h, F.size(h) - 1))


def page_blocks(lines: DataFrame, country: str = "XXX", confidence: float = 0.95, **labels) -> DataFrame:
    """(page, field, value, confidence, status, source, block) of the rules that read a page as a whole.

    labels: the patterns of names.name_candidates().
    """
    line = F.struct("line_index", F.coalesce("text", F.lit("")).alias("text"), "y", "x")
    pages = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(line)).alias("ls"))
    pages = pages.withColumn("texts", F.transform("ls", lambda x: x["text"])).withColumn("joined", F.array_join("texts", "\n"))
    texts, joined = F.col("texts"), F.col("joined")
    machine = ids.mrz_fields(F.upper(F.translate(joined, " ", "")), country, pivot=30, keep_sex=True)
    below = F.transform(F.filter("ls", lambda x: x["y"] > BODY), lambda x: x["text"])
    parts = F.struct(
        machine.alias("m"),
        _top_id(F.col("ls")).alias("top"),
        ids.footer_id(joined).alias("footer"),
        _page_dates(F.col("ls")).alias("d"),
        once(place_in_parentheses(below), lambda s: place_name(s["name"])).alias("place"),
        _placed_sex(F.col("ls")).alias("placed_sex"),
        sex_near(texts).alias("sex"),
    )
    named = pages.select(*PAGE, F.transform(F.array(parts), lambda s: s)[0].alias("p")).join(names.name_candidates(lines, **labels), PAGE, "left")
    chosen = F.transform(F.array(names.choose_names(F.col("p.m.surnames"), F.col("p.m.given"), confidence)), lambda n: n)[0]

    def blocks(s: Column, n: Column) -> Column:
        several, alone = F.size(s["d"]) > 1, F.when(F.size(s["d"]) == 1, F.get(s["d"], 0))
        first, last = F.when(several, F.get(s["d"], 0)), F.when(several, F.get(s["d"], F.size(s["d"]) - 1))
        no_birth = s["m"]["birth_date"].isNull()
        entries = [
            (0, _entry("birth_date", first, confidence, "dates")),
            (0, _entry("issue_date", last, confidence, "dates")),
            (0, _entry("sex", s["placed_sex"], confidence, "place on the page")),
            *[(1, _entry(f, s["m"][m], 0.98, "machine")) for f, m in (("id_number", "id"), ("birth_date", "birth_date"), ("sex", "sex"))],
            (2, _entry("id_number", s["top"], confidence, "top of page")),
            (3, _entry("id_number", s["footer"]["id"], confidence, "footer")),
            (5, _entry("birth_date", F.when(no_birth, alone), confidence, "dates")),
            (5, _entry("issue_date", F.when(~no_birth, alone), confidence, "dates")),
            (5, _entry("issue_place", s["place"], confidence, "place and region")),
            (6, _entry("sex", F.coalesce(s["footer"]["sex"], s["sex"]), 0.85, "near label")),
        ]
        by_order = [(4, F.struct(F.lit(f).alias("field"), n[f]["value"].alias("value"), n[f]["confidence"].alias("confidence"), F.lit("VALID").alias("status"), n[f]["source"].alias("source"))) for f in ("surnames", "given_names")]
        return F.array(*[F.struct(F.lit(b).alias("block"), e.alias("e")) for b, e in [*entries, *by_order]])

    # parts and names are made once for each page, in an array of one
    both = F.array(F.struct(F.col("p"), chosen.alias("n")))
    rows = named.select(*PAGE, F.inline_outer(F.transform(both, lambda x: blocks(x["p"], x["n"]))[0]))
    return rows.select(*PAGE, "e.*", "block").where(F.col("value").isNotNull())


def extract_fields(lines: DataFrame, labels: Mapping[str, Sequence[str]] = spatial.LABELS, country: str = "XXX", confidence: float = 0.95, **name_labels) -> DataFrame:
    """One row a page and field: page, field, value, confidence, status, source; fields without a value need review.

    lines: document_id, page_number, line_index, text, confidence, x, y, w, h.
    """
    read = page_blocks(lines, country, confidence, **name_labels)
    best = read.groupBy(*PAGE, "field").agg(F.min_by(F.struct("value", "confidence", "status", "source"), F.struct("block", -F.col("confidence"))).alias("b"))
    grid = lines.select(*PAGE).distinct().select("*", F.explode(F.array(*[F.lit(f) for f in FIELDS])).alias("field"))
    known = grid.join(best, [*PAGE, "field"], "left")
    placed = ranked_fields(lines, labels, known.where(F.col("b").isNull())).select(*PAGE, "field", F.struct("value", "confidence", "status", "source").alias("r"))
    out = known.join(placed, [*PAGE, "field"], "left").withColumn("b", F.coalesce("b", "r"))
    return out.select(*PAGE, "field", "b.value", F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("b.status", F.lit("REVIEW_REQUIRED")).alias("status"), "b.source")


def as_records(fields: DataFrame) -> DataFrame:
    """One row a page, each field as struct<value, confidence>, null without a value."""
    value = lambda f: F.max(F.when((F.col("field") == f) & F.col("value").isNotNull(), F.struct("value", "confidence"))).alias(f)
    return fields.groupBy(*PAGE).agg(*[value(f) for f in FIELDS])


def extract_groups(fields: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a group of pages: document_id, group_id and each field merged from front and back.

    groups: document_id, group_id, front_page, back_page, as pair_pages() gives them.
    """
    records = as_records(fields)
    key = F.concat_ws("/", F.col("document_id").cast("string"), "group_id").alias("key")

    def side(page: str) -> DataFrame:
        named = groups.where(F.col(page).isNotNull()).select("document_id", key, F.col(page).alias("page_number"))
        return named.join(records, PAGE, "left").select("key", *FIELDS)

    merged = merge.merge_sides(side("front_page"), side("back_page"), "key", FIELDS)
    return groups.select("document_id", "group_id", key).join(merged, "key", "left").drop("key")
