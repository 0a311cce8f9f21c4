"""Recognised layouts: documents of pages of positioned lines, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.schemas import LAYOUT


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYOUT).json(path)


def lines_of(layouts: DataFrame) -> DataFrame:
    """One row a line: document_id, page_number, line_index and the line's columns; pages without lines give none."""
    pages = layouts.select("document_id", F.explode("pages").alias("p"))
    return pages.select("document_id", F.col("p.page_number").alias("page_number"), F.posexplode("p.lines").alias("line_index", "l")).select(
        "document_id", "page_number", "line_index", "l.text", "l.confidence", "l.x", "l.y", "l.w", "l.h"
    )


def anchored_text(text: Column, segments: Column) -> Column:
    """The parts [start, end) of a text, joined and trimmed."""
    return F.trim(F.array_join(F.transform(segments, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])), ""))


def polygon_box(vertices: Column) -> Column:
    """struct<x, y, w, h> around an array of points, to four places."""
    xs, ys = F.transform(vertices, lambda v: v["x"]), F.transform(vertices, lambda v: v["y"])
    side = lambda a: F.round(F.array_max(a) - F.array_min(a), 4)
    return F.struct(F.round(F.array_min(xs), 4).alias("x"), F.round(F.array_min(ys), 4).alias("y"), side(xs).alias("w"), side(ys).alias("h"))


def better_text(first: Column, second: Column) -> Column:
    """Of two readings of a page the one with more words; the first, if it has four or as many."""
    words = lambda c: F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\S+)"), F.lit(1)))
    return F.when((words(first) < 4) & (words(second) > words(first)), second).otherwise(first)


def synthetic_lines(text: Column) -> Column:
    """Lines without a layout, set one below another: x .1, y .05 a line (1 at most), w .8, h .04."""
    kept = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.transform(kept, lambda x, i: F.struct(F.trim(x).alias("text"), F.lit(0.9).alias("confidence"), F.lit(0.1).alias("x"), F.least(F.lit(0.05) * i, F.lit(1.0)).alias("y"), F.lit(0.8).alias("w"), F.lit(0.04).alias("h")))
