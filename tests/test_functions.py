"""Scalar rules over invented inputs, one rule of a cascade at a time."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartulary.functions import codes, dates, ids, places, text
from cartulary.functions.similarity import best_match, indel_ratio, lcs_length


def each(spark, rule, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


CASES = [
    (text.comparison_key, [" Gálvez ", "nan", None, "ñandú  x", "NULL"], ["GALVEZ", "", "", "ÑANDU X", ""]),
    (text.without_accents, ["ñandú çà"], ["NANDU CA"]),
    (text.sheet_text, [" ab ", "nan", None], ["AB", "", ""]),
    (text.repair_name, ["sab!", "G0MEZ", "MART1NEZ", "CASTILL0", "VARGA5", "AB1"], ["SABI", "GOMEZ", "MARTINEZ", "CASTILLO", "VARGAS", "ABI"]),
    (text.person_name, ["SIGNATURE Ana Lu", "de", "a b c", "uno dos tres cuatro cinco seis", None, "R0SA"], ["ANA LU", None, None, "UNO DOS TRES CUATRO CINCO", None, "ROSA"]),
    (text.repair_digits, ["O1l B8SZG", "q A T"], ["0118852 6".replace(" ", ""), "947"]),
    (text.word_key, ["G0MEZ", "A0B0C", "1ABC", "Ñúñez"], ["GOMEZ", "AOBOC", "ABC", "ÑUÑEZ"]),
    (text.byte_size, ["2097152", "512"], ["2.0 MB", "0.5 KB"]),
    (ids.valid_id, ["12.345.678", "0123456789", "123456", "12345678901", "12a45678", None, "1 234-567"], ["12345678", None, None, None, None, None, "1234567"]),
    (ids.request_id, ["012345", "12345", "1.234.567"], ["012345", None, "1234567"]),
    (ids.is_sheet_id, ["123456789012", " 123456 ", "x", None], [True, True, False, False]),
    (codes.sex_code, ["masc", "Mujer", "x", None], ["M", "F", None, None]),
    (codes.request_sex_code, ["MASC", "MALE"], [None, "M"]),
    (places.place_name, ["Rivera (Norte)", "PLACE OF DE SOTO", "DE", "ab", None], ["RIVERA", "OF DE SOTO", None, None, None]),
    (text.needs_recognition, [None, "too short", "several longer words make up this quite sufficient text here"], [True, True, False]),
]


@pytest.mark.parametrize(("rule", "values", "want"), CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_rules(spark, rule, values, want):
    assert each(spark, rule, values) == want


def test_dates(spark):
    d = dt.date
    values = ["2001-02-03", "03/02/2001", "3-FEB-2001", "22OCT2006", "NOV 07 1987", "15 de enero de 2020", "31/02/2001", "31-FEB-2001", "x", None, "5.6.1999", "1 de febrer0 de 1999"]
    want = [d(2001, 2, 3), d(2001, 2, 3), d(2001, 2, 3), d(2006, 10, 22), d(1987, 11, 7), d(2020, 1, 15), None, None, None, None, d(1999, 6, 5), d(1999, 2, 1)]
    assert each(spark, dates.parse_date, values) == want
    assert each(spark, dates.compact_date, ["05 MAY. 1987 X", "5MAY1987", "x 5MAY1987"]) == [d(1987, 5, 5), d(1987, 5, 5), None]
    assert each(spark, dates.rescued_month, ["24-???-2001", "24-MAY-2001"]) == [d(2001, 1, 24), None]
    near = each(spark, lambda v: dates.date_near(F.split(v, "\n"), ["ISSUED", "BORN"]), ["BORN\nx\n01/02/1990\nISSUED 3-MAY-2010", "BORN 2001-01-01", "none"])
    assert near == [d(2010, 5, 3), d(2001, 1, 1), None]
    one = spark.createDataFrame([([d(2005, 1, 1)],), ([d(2015, 1, 1)],), ([d(2015, 1, 1), d(1990, 1, 1), None],), ([],)], "a array<date>")
    got = [tuple(r) for r in one.select(F.inline(F.array(dates.from_all_dates(F.col("a"))))).collect()]
    assert got == [(d(2005, 1, 1), None), (None, d(2015, 1, 1)), (d(1990, 1, 1), d(2015, 1, 1)), (None, None)]


def test_ids_in_text(spark):
    got = each(spark, ids.id_from_text, ["NUMBER 1.234.567", "a 12.345.678 b", "x\n12345678\ny", "l2345G78", "x", "ID 7654321 NUMBER 1234567"])
    assert got == ["1234567", "12345678", "12345678", "12345678", None, "1234567"]
    mrz = each(spark, lambda v: ids.mrz_fields(v, keep_sex=True), ["8001017F3001011XXX12345678<8\nDOE<ROE<<ANA", "x"])
    assert tuple(mrz[0]) == (dt.date(1980, 1, 1), "12345678", "DOE ROE", "ANA", "F") and tuple(mrz[1]) == (None,) * 5
    assert each(spark, ids.footer_id, ["A-123-456-M-0012345678-2001"])[0] == ("12345678", "M")
    assert each(spark, ids.synthetic_id, ["k"])[0].startswith("SIN_ID_")


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert lcs_length(a, b) == lcs_length(b, a) == table[-1][-1]


def test_similarity(spark):
    df = spark.createDataFrame([("MEDELIN", "MEDELLIN"), ("A", "B"), ("", ""), (None, "A")], "a string, b string")
    assert [r[0] for r in df.select(indel_ratio("a", "b")).collect()] == [pytest.approx(93.3333, abs=1e-3), 0.0, 100.0, None]
    words = spark.createDataFrame([("RIVRA",), ("QQQQ",)], "w string")
    names = spark.createDataFrame([("RIVERA",), ("RIBERA",), ("Z",)], "word string")
    assert [tuple(r)[::2] for r in best_match(words, "w", names, 80.0).collect()] == [("RIVRA", "RIVERA")]


def test_places(spark):
    gazetteer = spark.createDataFrame([("RIVERA", False, None), ("ORIENTE", True, None), ("VILLA RIVERA", False, "RIVERA"), ("MONTÉS", False, None)], "name string, is_region boolean, alias_of string")
    rows = spark.createDataFrame([("rivera",), ("Montes",), ("VILA RIVERA",), ("ORIENTE",), ("ORIENT",), ("zz",), (None,)], "v string")
    got = {r.v: r.place for r in places.resolve_places(rows, "v", gazetteer).collect()}
    assert got == {"rivera": "RIVERA", "Montes": "MONTÉS", "VILA RIVERA": "RIVERA", "ORIENTE": None, "ORIENT": None, "zz": None, None: None}


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=15), min_size=1, max_size=5))
def test_key_is_idempotent(spark, values):
    once = each(spark, text.comparison_key, values)
    assert each(spark, text.comparison_key, once) == once


def test_repeats_late_in_a_text(spark, tmp_path):
    from cartulary.plans import text_queries

    letters = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(120)]
    rows = [(1, " ".join([*letters, letters[3]])), (2, " ".join(letters)), (3, ""), (4, None), (5, "b a B\na c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.duplicated, r.kept) for r in text_queries.duplicate_tokens(spark, str(tmp_path)).collect()}
    assert got == {1: (True, 120), 2: (False, 120), 3: (False, 0), 4: (None, None), 5: (True, 3)}
    words = spark.createDataFrame([(["b", "á", "B", "a", "c"],)], "w array<string>").select(text.duplicate_words(F.col("w")).alias("f")).first().f
    assert words.duplicated and words.kept == ["b", "á", "c"]


def test_longest_matches(spark):
    import random
    import re

    from cartulary.functions import phrases

    rng = random.Random(2)
    names = [("A",), ("A", "B"), ("A", "B", "C"), ("B", "A"), ("C", "C"), ("NORTH", "HILL"), ("NORTH", "HILL", "UNDER", "LAKE"), ("UNDER", "LAKE", "SIDE"), ("A", "A", "A"), ("B", "C", "A", "B", "C", "A", "B")]
    texts = [" ".join(rng.choice("ABCD") for _ in range(rng.randrange(40))) for _ in range(60)] + ["IN NORTH HILL UNDER LAKE SIDE", "NORTH HILL UNDER", "A " * 3000, "", "X"]
    pattern = re.compile(r"\b(" + "|".join(sorted((" ".join(n) for n in names), key=len, reverse=True)) + r")\b")
    want = {(k, len(t[: m.start()].split()), len(m.group(1).split()), m.group(1)) for k, t in enumerate(texts) for m in pattern.finditer(t)}
    table = spark.createDataFrame([(list(n), " ".join(n)) for n in names] + [(["A", "B"], "Z later"), ([], "none"), ([None], "null"), (["A", None], "null")], "words array<string>, name string")
    rows = spark.createDataFrame([(k, t.split()) for k, t in enumerate(texts)] + [(999, None), (998, [None, "A", "B"])], "k int, tokens array<string>")
    got = {tuple(r) for r in phrases.longest_matches(rows, ["k"], "tokens", table).collect()}
    assert got == want | {(998, 1, 2, "A B")}
    assert phrases.longest_matches(rows, ["k"], "tokens", table.limit(0)).count() == 0


def test_phrases_longer_than_what_is_read_ahead(spark):
    """Phrases that differ in a late word only; no array of words is made for each place."""
    from cartulary.functions import phrases

    long = [list("ABCDEFGHIJ"), [*"ABCDEFGHI", "X"], list("ABCDEFGH"), ["A"]]
    table = spark.createDataFrame([(w, i) for i, w in enumerate(long)], "words array<string>, i int")
    texts = spark.createDataFrame([(1, list("ABCDEFGHIJ")), (2, list("ABCDEFGHIXA")), (3, list("ABCDEFGHI")), (None, list("ZABCDEFGHIJ")), (4, list("AA"))], "k int, tokens array<string>")
    found = phrases.longest_matches(texts, ["k"], "tokens", table)
    assert {tuple(r) for r in found.collect()} == {(1, 0, 10, 0), (2, 0, 10, 1), (2, 10, 1, 3), (3, 0, 8, 2), (None, 1, 10, 0), (4, 0, 1, 3), (4, 1, 1, 3)}
    assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_fuzzy_index_loses_nothing(spark, monkeypatch):
    """Against all pairs: short words of few letters, where much is alike, and long ones, which meet by character pairs."""
    import random

    from cartulary.functions import similarity

    monkeypatch.setattr(similarity, "SMALL", 0)
    rng = random.Random(1)
    word = lambda low, high, letters: "".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))
    known = sorted({word(1, 12, "abcd") for _ in range(90)} | {word(18, 45, "abcdefgh") for _ in range(12)} | {"é🎉x", "é🎉"})

    def edited(w):
        for _ in range(rng.randrange(1 + len(w) // 4)):
            i = rng.randrange(len(w) + 1)
            w = w[:i] + rng.choice("abcde") + w[i + rng.randrange(2) :]
        return w or "a"

    asked = sorted({word(1, 12, "abcd") for _ in range(40)} | {edited(w) for w in known})
    d, q = spark.createDataFrame([(w, len(w)) for w in [*known, ""]], "word string, size int"), spark.createDataFrame([(w,) for w in [*asked, None, ""]], "q string")
    ratio = {True: lambda a, b: 200.0 * similarity.lcs_length(a, b) / (len(a) + len(b)), False: lambda a, b: 100.0 * (1 - _distance(a, b) / max(len(a), len(b)))}
    for exact, cutoff in ((True, 60.0), (True, 80.0), (False, 60.0), (False, 75.0), (True, 85.0)):
        want = {}
        for a in asked:
            low, b = min((-ratio[exact](a, b), b) for b in known)
            if -low >= cutoff:
                want[a] = (b, round(-low, 6), len(b))
        assert {r.q: (r.word, round(r.ratio, 6), r.size) for r in similarity.best_match(q, "q", d, cutoff, exact).collect()} == want
    # the index leaves few of all pairs
    assert similarity.candidates(q, "q", d, 85.0).count() * 10 < len(asked) * len(known)
