"""Fill-in-middle against a plain version; units join to the text, outputs go back to it."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from cartulary.llm import fill_middle
from tests.llm.support import documents, frame

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain(doc_id, text):
    text = text or ""
    u = UNIT.findall(text)
    n = len(u)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def rows():
    out = documents()
    odd = ["🎉", "a🎉b", "🎉🎉c", "x\ny\n\n", "a<P>b", "<S>", "<M", "a<<P", "<<S>", "P>S>M>", "\n", "ab", "a b", "é", "aéb", "\r\n", " x", "A1b2", "<P", "S>", "éf", "\U0010ffff\U00010000a"]
    for k in range(12):
        out += [(20_000 + 100 * k + i, t, None, None, None) for i, t in enumerate(odd)]
    out.append((30_001, "word, " * 400_000, None, None, None))
    out.append((30_002, "q" * 2_000_000, None, None, None))
    return out


def test_against_plain(spark):
    data = rows()
    got = fill_middle.transform(frame(spark, data)).withColumn("back", fill_middle.restore(F.col("output"), F.col("form")))
    have = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got.drop("text").collect())
    assert have == Counter((d[0], *plain(d[0], d[1])) for d in data)
    assert got.where("back <> coalesce(text, '')").count() == 0
    assert {k[2] for k in have} == {"plain", "psm", "spm"}


def test_units_of_other_grammars(spark):
    texts = ["ab12 cd", "", "🎉a1", "12ab", "  x", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for grammar, unit in ((fill_middle.WORDS, UNIT), (("A-Za-z", "0-9"), re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")), (fill_middle.CHARACTERS, re.compile(r"(?s).")), ((r"\n", r"^\n"), re.compile(r"\n+|[^\n]+"))):
        for r in df.select("t", fill_middle.units(F.col("t"), grammar).alias("u")).collect():
            assert r.u == unit.findall(r.t)


def test_empty_and_clashing(spark):
    assert fill_middle.transform(frame(spark, [])).collect() == []
    docs = frame(spark, [(1, "one two", "en", "s", 1), (1, None, None, None, None)]).selectExpr("*", "5 AS n", "6 AS work", "'x' AS output")
    out = fill_middle.transform(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "work", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted((r.n, r.work) for r in out.collect()) == [(0, 6), (3, 6)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
