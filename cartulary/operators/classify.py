"""Classifying pages: type, side and layout, by weighted patterns. Patterns are parameters with synthetic defaults."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE_A = ("NATIONAL REGISTER", "IDENTITY DOCUMENT", "PERSONAL NUMBER")
TYPE_B = ("YOUTH CARD", "MINOR CARD")
FIELD_LABELS = ("SURNAMES", "GIVEN NAMES", "DATE OF BIRTH", "DATE AND PLACE OF ISSUE", "SEX")
NUMBER = r"(NUMBER|DOCUMENT)\s*[.:]*\s*[1-9][0-9.\s]{5,12}"
FRONT = ("NATIONAL REGISTER", "SURNAMES", "GIVEN NAMES")
BACK = ("DATE OF BIRTH", "PLACE OF BIRTH")
STRONG_BACK = ("REGISTRAR", "PLACE OF ISSUE", "I<XXX")
#: Fixed value: Unicode's space separators.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _hits(text: Column, patterns: Sequence[str], weight: int = 1) -> Column:
    return reduce(lambda a, b: a + b, [F.when(text.rlike(p), weight).otherwise(0) for p in patterns], F.lit(0))


def _size(text: Column) -> Column:
    """Characters of a text as it is written, but for outer spaces of any width: in upper case ß would count as two."""
    return F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)))


def _result(kind: str, name: str, confidence: Column, review: Column | None = None) -> Column:
    parts = [F.lit(kind).alias(name), F.round(confidence, 2).alias("confidence")]
    return F.struct(*parts, *([review.alias("review")] if review is not None else []))


def document_type(text: Column, type_a: Sequence[str] = TYPE_A, type_b: Sequence[str] = TYPE_B, labels: Sequence[str] = FIELD_LABELS, number: str = NUMBER) -> Column:
    """struct<doc_type, confidence, review>; thresholds count in this order."""
    body = F.upper(F.coalesce(text, F.lit("")))
    found = _hits(body, labels)
    a = _hits(body, type_a, 2) + F.when(found >= 3, 3).otherwise(0) + F.when(body.rlike(number), 2).otherwise(0)
    b = _hits(body, type_b, 3)
    one = lambda kind, c, review: _result(kind, "doc_type", c, F.lit(review))
    return (
        F.when(_size(text) < 15, one("NO_DOCUMENT", F.lit(0.0), True))
        .when(b >= 3, one("TYPE_B", F.least(F.lit(0.98), 0.70 + b * 0.08), False))
        .when(a >= 4, one("TYPE_A", F.least(F.lit(0.99), 0.65 + a * 0.06), False))
        .when((a >= 2) | (found >= 2), one("UNKNOWN", F.lit(0.50), True))
        .otherwise(one("NO_DOCUMENT", F.lit(0.10), True))
    )


def page_side(text: Column, front: Sequence[str] = FRONT, back: Sequence[str] = BACK, strong_back: Sequence[str] = STRONG_BACK, type_b: Sequence[str] = TYPE_B, b_front: str = "DATE OF BIRTH", b_back: str = "PLACE OF ISSUE|REGISTRAR") -> Column:
    """struct<side, confidence>: front, back, both, or unknown; in ties the front counts."""
    body = F.upper(F.coalesce(text, F.lit("")))
    f = _hits(body, front, 2)
    r = _hits(body, back, 2) + _hits(body, strong_back, 3)
    is_b = body.rlike("|".join(type_b))
    fb, rb = F.when(is_b & body.rlike(b_front), 4).otherwise(0), F.when(is_b & body.rlike(b_back), 4).otherwise(0)
    top = F.greatest(f, r, fb, rb)
    one = lambda side, c: _result(side, "side", c)
    return (
        F.when(_size(text) < 10, one("UNKNOWN", F.lit(0.0)))
        .when((f >= 2) & (r >= 2), one("BOTH", F.lit(0.99)))
        .when(top < 2, one("UNKNOWN", F.lit(0.30)))
        .when((top == r) & (r > f), one("BACK", F.least(F.lit(0.99), 0.70 + r * 0.05)))
        .when((top == f) & (f >= r), one("FRONT", F.least(F.lit(0.99), 0.70 + f * 0.05)))
        .when(top == rb, one("B_BACK", F.lit(0.90)))
        .when(top == fb, one("B_FRONT", F.lit(0.90)))
        .otherwise(one("UNKNOWN", F.lit(0.40)))
    )


def page_layout(text: Column, surnames: str = "SURNAMES", names: str = "GIVEN NAMES", header: str = "NATIONAL REGISTER", issue: str = "PLACE OF ISSUE", machine: str = "I<XXX", card: str = "YOUTH CARD") -> Column:
    """struct<layout, direction, confidence>: where values lie relative to their labels."""
    body = F.upper(F.coalesce(text, F.lit("")))
    has = body.rlike
    one = lambda layout, direction, c: F.struct(F.lit(layout).alias("layout"), F.lit(direction).alias("direction"), F.lit(c).alias("confidence"))
    return (
        F.when(F.trim(body) == "", one("UNKNOWN", "VALUE_ABOVE_LABEL", 0.0))
        .when((has(surnames) & has(names)) | (has(header) & ~has(issue)), one("FRONT", "VALUE_ABOVE_LABEL", 0.95))
        .when(has(issue) | has(machine), one("BACK", "VALUE_ABOVE_LABEL", 0.95))
        .when(has(card), one("CARD", "VALUE_BELOW_LABEL", 0.90))
        .otherwise(one("UNKNOWN", "VALUE_ABOVE_LABEL", 0.50))
    )


def simple_type(text: Column, type_b: Sequence[str] = TYPE_B, type_a: Sequence[str] = TYPE_A) -> Column:
    """The type by two tests, the card first."""
    body = F.upper(text)
    return F.when(body.rlike("|".join(type_b)), "TYPE_B").when(body.rlike("|".join(type_a)), "TYPE_A").otherwise("UNKNOWN")
