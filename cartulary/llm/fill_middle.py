"""Fill-in-middle examples: texts cut into units by zero-width boundaries, and two of the cuts reorder them.

A unit grammar is a list of character classes: a run of one class is a unit, and so is every other character. Two
neighbours belong together only if one class holds both, so the places between units are those where no class holds
the characters on both sides. That is one look-around expression without width, at which Spark's split() cuts and
keeps every piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import fresh, without

#: Runs of which classes are units.
WORDS: Sequence[str] = ("A-Za-z",)
CHARACTERS: Sequence[str] = ()
#: What marks the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A place between the halves of a character beyond the basic plane is none.
INSIDE_CHARACTER = r"(?<![\x{D800}-\x{DBFF}])"


def boundary(grammar: Sequence[str]) -> str:
    """The expression that matches, without width, between two units of a grammar, and never at either end."""
    within = "".join(f"(?!(?<=[{c}])(?=[{c}]))" for c in grammar)
    return f"(?s){INSIDE_CHARACTER}(?<=.)(?=.){within}"


def units(text: Column, grammar: Sequence[str] = WORDS) -> Column:
    """The units of a text in order; joined they are the text. An empty one has none, where split() would give one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(doc_id: Column, seed: int = 1) -> Column:
    """Four numbers of 32 bits from the id, as an array; a null id counts as one without digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.transform(F.array(digest), lambda d: F.array(*[F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]))[0]


def transform(
    docs: DataFrame, grammar: Sequence[str] = WORDS, plain_from: int = 90, spm_below: int = 20, seed: int = 1, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars and output.

    The draws h1 to h4 of an id fix everything, so reruns agree. The prefix ends after the smaller of h1 % (n + 1) and
    h2 % (n + 1) units, the middle after the larger. The form is plain, and the output the text, if the text is empty,
    holds one of the marks, or h3 % 100 >= plain_from; else spm if h4 % 100 < spm_below, else psm. Lengths are code
    points, null where the form is plain. A null text is an empty one; texts of any length are cut whole; repeated
    rows stay and come out alike; an empty table gives no rows; columns of these names are replaced.
    """
    docs = without(docs, "n", "form", "prefix_chars", "middle_chars", "output")
    (work,) = fresh(docs, "work")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def cut(s: Column) -> Column:
        h, u = s["h"], s["u"]
        n = F.size(u)
        a, b = h[0] % (n + 1), h[1] % (n + 1)
        first, last = F.least(a, b).cast("int"), F.greatest(a, b).cast("int")
        part = lambda start, size: F.array_join(F.slice(u, start + 1, size), "")
        marked = F.greatest(*[F.instr(s["t"], m) for m in (PREFIX, SUFFIX, MIDDLE)]) > 0
        form = F.when((s["t"] == "") | marked | (h[2] % 100 >= plain_from), "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
        return F.struct(form.alias("form"), n.cast("long").alias("n"), s["t"].alias("t"), part(F.lit(0), first).alias("p"), part(first, last - first).alias("m"), part(last, n - last).alias("s"))

    parts = F.transform(F.transform(F.array(F.struct(draws(F.col(f"`{doc_id}`"), seed).alias("h"), units(body, grammar).alias("u"), body.alias("t"))), cut), lambda x: x)[0]
    rows = docs.select(*kept, parts.alias(work))
    of = lambda f: F.col(f"{work}.{f}")
    mark = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    psm, spm = mark(PREFIX, of("p"), SUFFIX, of("s"), MIDDLE, of("m")), mark(SUFFIX, of("s"), PREFIX, of("p"), MIDDLE, of("m"))
    length = lambda f: F.when(of("form") != "plain", F.char_length(of(f)).cast("long"))
    output = F.when(of("form") == "psm", psm).when(of("form") == "spm", spm).otherwise(of("t"))
    return rows.select(*kept, of("n").alias("n"), of("form").alias("form"), length("p").alias("prefix_chars"), length("m").alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text of an output: its parts lie between the marks, and no part holds one."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    back = lambda p: F.when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1]))
    return F.when(form == "plain", output).otherwise(F.transform(F.array(parts), back)[0])
