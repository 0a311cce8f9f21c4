"""Labels and values on a page: boxes, regions, relations, and the best value of each label.

Boxes are struct<x, y, w, h> in parts of the page. All rules are column expressions; label and candidate meet in
an equi-join on the page.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cartulary.functions.text import once

#: Scores of the relations of a candidate to its label.
SCORES = {"DIRECTLY_ABOVE": 1.00, "DIRECTLY_RIGHT": 1.00, "DIRECTLY_BELOW": 0.90, "SAME_ROW": 0.85, "NEAR": 0.70, "FAR": 0.20, "ABOVE": 0.00, "WRONG_REGION": 0.00}
COMPATIBLE = ("DIRECTLY_BELOW", "DIRECTLY_ABOVE", "DIRECTLY_RIGHT", "SAME_ROW", "NEAR")
#: Synthetic labels of a form; digits may stand for letters.
LABELS: Mapping[str, Sequence[str]] = {
    "id_number": ("NUMBER", "DOCUMENT N[O0]"),
    "surnames": ("SURNAMES?", "FAM[I1]LY NAMES?"),
    "given_names": ("G[I1]VEN NAMES?", "F[O0]RENAMES?"),
    "birth_date": ("B[I1]RTH",),
    "issue_date": ("DATE AND PLACE [O0]F [I1]SSUE", "[I1]SSUED?"),
    "issue_place": ("DATE AND PLACE [O0]F [I1]SSUE", "PLACE [O0]F [I1]SSUE"),
    "sex": ("SEX", "GENDER"),
}


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A box within the page."""
    part = lambda c, n: F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(1.0)).alias(n)
    return F.struct(part(x, "x"), part(y, "y"), part(w, "w"), part(h, "h"))


def centre_x(b: Column) -> Column:
    return b["x"] + b["w"] / 2


def centre_y(b: Column) -> Column:
    return b["y"] + b["h"] / 2


def horizontal_overlap(a: Column, b: Column) -> Column:
    """The shared width over the smaller width."""
    shared = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    narrow = F.least(a["w"], b["w"])
    return F.when(narrow > 0, shared / narrow).otherwise(0.0)


def region(field: Column, label: Column, names_y: Column, surnames_y: Column) -> Column:
    """struct<x_min, x_max, y_min, y_max>: where a field's value may lie.

    With the surname label above the name label, values of both lie above their labels; with it below, below.
    """
    y = label["y"]
    is_name = field.isin("given_names", "surnames")
    both = names_y.isNotNull() & surnames_y.isNotNull()
    above = both & (surnames_y < names_y)
    low = F.when(above & is_name, y - 0.20).when(above, y - 0.15).when(both & is_name, y - 0.02).when(both, y).when(is_name, y - 0.20).otherwise(y - 0.15)
    high = F.when(above & is_name, y + 0.04).when(both & ~above & is_name, y + 0.18).otherwise(y + 0.20)
    return F.struct(
        F.round(F.greatest(F.lit(0.0), label["x"] - 0.20), 4).alias("x_min"),
        F.round(F.least(F.lit(1.0), label["x"] + F.greatest(label["w"] * 4.5, F.lit(0.70))), 4).alias("x_max"),
        F.round(F.greatest(F.lit(0.0), low), 4).alias("y_min"),
        F.round(high, 4).alias("y_max"),
    )


def relation(label: Column, candidate: Column, within: Column | None = None) -> Column:
    """struct<relation, score> of a candidate's place to its label; the order of the rules carries meaning."""
    dy, up = candidate["y"] - label["y"], label["y"] - candidate["y"]
    off = F.abs(centre_x(candidate) - centre_x(label))
    column = off <= label["w"] * 3.5
    nearer = F.greatest(F.lit(0.80), 1.00 - (up / 0.14) * 0.20) * F.greatest(F.lit(0.40), 1.00 - (off / F.greatest(label["w"] * 2.0, F.lit(0.05))) * 0.60)
    one = lambda name, score=None: F.struct(F.lit(name).alias("relation"), (F.lit(SCORES[name]) if score is None else score).alias("score"))
    out = F.when(F.lit(False), one("WRONG_REGION"))
    if within is not None:
        outside = (candidate["y"] < within["y_min"] - 0.005) | (candidate["y"] >= within["y_max"]) | (candidate["x"] < within["x_min"] - 0.05)
        out = out.when(outside, one("WRONG_REGION"))
    return (
        out.when(candidate["y"] < label["y"] - 0.14, one("ABOVE"))
        .when((up > 0) & (up <= 0.14) & column, one("DIRECTLY_ABOVE", nearer))
        .when((dy > 0) & (dy <= 0.15) & column, one("DIRECTLY_BELOW"))
        .when((F.abs(dy) <= label["h"] * 1.8) & (candidate["x"] >= label["x"] + label["w"] * 0.1), one("DIRECTLY_RIGHT"))
        .when(F.abs(centre_y(candidate) - centre_y(label)) <= label["h"] * 1.5, one("SAME_ROW"))
        .when((dy > 0) & (dy <= 0.25), one("NEAR"))
        .otherwise(one("WRONG_REGION"))
    )


def field_score(spatial: Column, confidence: Column) -> Column:
    """struct<score, status>: VALID from .85."""
    score = 0.35 + 0.40 * spatial + 0.15 * confidence + 0.10
    return F.struct(score.alias("score"), F.when(score >= 0.85, "VALID").otherwise("REVIEW_REQUIRED").alias("status"))


def find_labels(lines: DataFrame, labels: Mapping[str, Sequence[str]] = LABELS) -> DataFrame:
    """(document_id, page_number, field, label_index, label_text, label): each field's first line that bears a label."""
    text = F.upper(F.trim("text"))
    letters = F.translate(text, "01", "OI")
    some = "|".join(x for p in labels.values() for x in p)
    hits = F.filter(
        F.array(*[F.when(text.rlike("|".join(p)) | letters.rlike("|".join(p)), F.lit(f)) for f, p in labels.items()]), lambda x: x.isNotNull()
    )
    # most lines bear no label; an outer explode, since Spark's filter for empty arrays would work hits out twice
    found = lines.where(text.rlike(some) | letters.rlike(some)).select("document_id", "page_number", "line_index", text.alias("t"), box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("b"), F.explode_outer(hits).alias("field")).where("field IS NOT NULL")
    first = F.min_by(F.struct("line_index", "t", "b"), "line_index").alias("l")
    return found.groupBy("document_id", "page_number", "field").agg(first).select("document_id", "page_number", "field", F.col("l.line_index").alias("label_index"), F.col("l.t").alias("label_text"), F.col("l.b").alias("label"))


def with_regions(labels: DataFrame) -> DataFrame:
    """Labels with region: where their fields' values may lie on the page, by all labels of it."""
    y = lambda f: F.max(F.when(F.col("field") == f, F.col("label.y"))).over(W.Window.partitionBy("document_id", "page_number"))
    placed = labels.withColumns({"__names_y": y("given_names"), "__surnames_y": y("surnames")})
    return placed.withColumn("region", region(F.col("field"), F.col("label"), F.col("__names_y"), F.col("__surnames_y"))).drop("__names_y", "__surnames_y")


def candidates(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Each label with each other line of its page and their relation within the field's region."""
    page = ["document_id", "page_number"]
    placed = with_regions(labels)
    others = lines.select(*page, "line_index", "text", "confidence", box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("candidate"))
    pairs = placed.join(others, page).where(F.col("line_index") != F.col("label_index"))
    return pairs.withColumn("r", relation(F.col("label"), F.col("candidate"), F.col("region"))).select("*", "r.relation", F.col("r.score").alias("spatial")).drop("r")


def best_candidates(pairs: DataFrame) -> DataFrame:
    """The best compatible candidate of each field: by score, then the earlier line; with its runner-up's score."""
    w = W.Window.partitionBy("document_id", "page_number", "field").orderBy(F.desc("spatial"), "line_index")
    ok = pairs.where(F.col("relation").isin(*COMPATIBLE))
    ranked = ok.withColumns({"rank": F.row_number().over(w), "runner_up": F.lead("spatial").over(w)}).where("rank = 1").drop("rank")
    return ranked.withColumn("f", field_score(F.col("spatial"), F.col("confidence"))).select("*", F.col("f.score").alias("score"), F.col("f.status").alias("status")).drop("f")


def exclusive(pairs: DataFrame, order: Sequence[str], valid_only: bool = False) -> DataFrame:
    """The best candidate of each field in a given order of fields; a line serves one field.

    Each choice depends on those before it: a fold over the page's candidates, sorted by field, score and line, that
    carries the fields served and the lines used. With valid_only a field whose best candidate isn't VALID stays
    empty and uses no line. Fields that `order` doesn't name take no part.
    """
    keys = ["document_id", "page_number"]
    places = F.create_map(*[F.lit(x) for i, f in enumerate(order) for x in (f, i)])
    fit = field_score(F.col("spatial"), F.col("confidence"))
    ok = pairs.where(F.col("relation").isin(*COMPATIBLE)).withColumn("__place", F.try_element_at(places, F.col("field"))).where("__place IS NOT NULL")
    # the rows themselves are kept beside what orders them, so that they are made once
    slim = F.struct(F.col("__place").alias("p"), (-F.col("spatial")).alias("s"), F.col("line_index").alias("line"), (fit["status"] == "VALID").alias("valid"), F.struct(*[F.col(c) for c in pairs.columns if c not in keys]).alias("row"))
    start = F.struct(F.array().cast("array<int>").alias("served"), F.array().cast("array<int>").alias("lines"), F.array().cast("array<int>").alias("taken"))

    def step(a: Column, x: Column, at: Column) -> Column:
        free = ~F.array_contains(a["served"], x["p"]) & ~F.array_contains(a["lines"], x["line"].cast("int"))
        take = free & (x["valid"] if valid_only else F.lit(True))
        add = lambda old, on, new: F.when(on, F.array_append(old, new)).otherwise(old)
        line = x["line"].cast("int")
        return F.struct(add(a["served"], free, x["p"]).alias("served"), add(a["lines"], take, line).alias("lines"), add(a["taken"], take, at).alias("taken"))

    def taken(each: Column) -> Column:
        places = F.transform(each, lambda x, i: F.struct(x["p"].alias("p"), x["line"].alias("line"), x["valid"].alias("valid"), i.alias("i")))
        return F.transform(F.aggregate(places, start, lambda a, x: step(a, x, x["i"]), lambda a: a["taken"]), lambda i: F.get(each, i)["row"])

    folded = ok.groupBy(*keys).agg(F.array_sort(F.collect_list(slim)).alias("each")).select(*keys, F.explode_outer(once(F.col("each"), taken)).alias("row")).where("row IS NOT NULL")
    best = folded.select(*keys, "row.*").select(*pairs.columns)
    return best.withColumn("f", fit).select("*", F.col("f.score").alias("score"), F.col("f.status").alias("status")).drop("f")


def debug_report(labels: DataFrame, pairs: DataFrame, accepted: DataFrame) -> DataFrame:
    """(document_id, page_number, field, role, text, box): labels, accepted values and rejected candidates."""
    page = ["document_id", "page_number", "field"]
    keys = [*page, "line_index"]
    a = labels.select(*page, F.lit("LABEL").alias("role"), F.col("label_text").alias("text"), F.col("label").alias("box"))
    b = accepted.select(*page, F.lit("ACCEPTED").alias("role"), "text", F.col("candidate").alias("box"))
    c = pairs.join(accepted.select(*keys), keys, "left_anti").select(*page, F.lit("REJECTED").alias("role"), "text", F.col("candidate").alias("box"))
    return a.union(b).union(c)
