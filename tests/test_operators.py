"""Operators over small invented tables."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartulary import schemas, session
from cartulary.operators import classify, lines, merge, pairing, reconcile, scoring, spatial, views
from cartulary.plans import text_queries
from cartulary.sources import layout, tabular
from cartulary.streaming.upsert import latest_version, start_upserts

FIELDS = ["name", "place"]
ROW = "id string, name string, place string, n int"


def frames(spark, store, external):
    return spark.createDataFrame(store, ROW), spark.createDataFrame(external, ROW)


def test_reconcile(spark):
    s, e = frames(spark, [("1", "Ana", "X", 1), ("2", "Luz", None, 1), ("3", "Eva", "Y", 1)], [("1", " ána ", "x", 1), ("2", "Lux", "nan", 1), ("2", "Luz", "", 2), ("4", "New", "Z", 1)])
    pairs = reconcile.matched(s, e, "id", FIELDS, "n")
    got = {(r.id, r.field, r.store_value, r.external_value, r.diff_kind) for r in reconcile.differences(pairs, "id", FIELDS).collect()}
    assert got == {("2", "name", "Luz", "Lux", "diferente"), ("3", "registro_completo", "Eva|Y", None, "nuevo_bd"), ("4", "registro_completo", None, "New|Z", "faltante_bd")}
    assert tuple(reconcile.summary(pairs).first()) == (3, 4, 1, 1, 1, 1)
    none = s.limit(0)
    assert reconcile.summary(reconcile.matched(none, e, "id", FIELDS)).first()["missing_in_store"] == 4
    missing = reconcile.differences(reconcile.matched(s, e.drop("place"), "id", FIELDS, "n"), "id", FIELDS)
    assert {r.id for r in missing.where("field = 'place'").collect()} == {"1"}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(*[st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from(["x", "X ", "y", None]), st.sampled_from(["p", ""]), st.just(1)), max_size=8)] * 2)
def test_every_key_is_counted_once(spark, store, external):
    s, e = frames(spark, store, external)
    r = reconcile.summary(reconcile.matched(s, e, "id", FIELDS)).first()
    missing = r.missing_in_store if store else len({x[0] for x in external})
    assert r.equal + r.different + missing + r.new_in_store == len({x[0] for x in store + external})


def test_report(spark):
    diffs = spark.createDataFrame([("1", "name", "a", "b", "diferente"), ("9", "registro_completo", None, "z", "faltante_bd")], "id string, field string, store_value string, external_value string, diff_kind string")
    facts = spark.createDataFrame([("1", "DOC-007", None, 4, 3, "e", 81.5, "VALID")], "id string, group_id string, front_page int, back_page int, page_number int, engine string, confidence double, record_status string")
    got = {r.id_number: r for r in reconcile.report(diffs, facts, "id").collect()}
    assert (got["1"].group_id, got["1"].front_page, got["1"].back_page, got["1"].confidence) == ("DOC-007", "3", "4", 81.5)
    assert (got["9"].group_id, got["9"].front_page, got["9"].back_page, got["9"].record_status) == ("DOC-001", "1", "-", "REVIEW_REQUIRED")
    assert [r.diff_kind for r in reconcile.report(diffs.limit(0), facts, "id").collect()] == ["SIN DIFERENCIAS"]


def test_one_pass(spark, tmp_path):
    s, e = frames(spark, [("1", "Ana", "X", 1), ("2", "Luz", None, 1), ("3", "Eva", "Y", 1), (None, "No", "Key", 1)], [("1", "ana", "x", 1), ("2", "Lux", "", 1), ("2", "Luz", "", 2), ("4", "New", "Z", 1), (None, "a", "b", 1), (None, "c", "d", 2)])
    got = reconcile.reconcile_to(s, e, "id", FIELDS, f"{tmp_path}/d", "c7", "n")
    assert got == {"store_rows": 4, "external_rows": 6, "equal": 1, "different": 1, "missing_in_store": 1, "new_in_store": 1}
    assert got == reconcile.summary(reconcile.matched(s, e, "id", FIELDS, "n")).first().asDict()
    back = reconcile.written_differences(spark, f"{tmp_path}/d", "id")
    assert sorted(map(tuple, back.drop("comparison_id").collect()), key=str) == sorted(map(tuple, reconcile.reconcile(s, e, "id", FIELDS, "n").collect()), key=str)
    one = reconcile.written_differences(spark, f"{tmp_path}/d", "id", kind="nuevo_bd")
    assert [r.id for r in one.collect()] == ["3"] and "PartitionFilters: [isnotnull(diff_kind" in one._jdf.queryExecution().executedPlan().toString()
    # one full outer join for details, counters and sinks
    pairs = reconcile.matched(s, e, "id", FIELDS)
    plan = reconcile.differences(pairs, "id", FIELDS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1 and plan.count("Join ") == 1
    nothing = s.limit(0)
    assert reconcile.reconcile_to(nothing, nothing, "id", FIELDS, f"{tmp_path}/none", "c8") == dict.fromkeys(got, 0)
    assert reconcile.written_differences(spark, f"{tmp_path}/none", "id").count() == 0


def test_report_of_repeated_records(spark):
    diffs = spark.createDataFrame([("1", "name", "a", "b", "diferente")], "id string, field string, store_value string, external_value string, diff_kind string")
    schema = "id string, group_id string, front_page int, back_page int, page_number int, engine string, confidence double, record_status string"
    rows = [("1", f"DOC-{k:03d}", k, k, k, "e", float(k), "VALID") for k in range(40, 0, -1)]
    for parts in (1, 7):
        assert reconcile.report(diffs, spark.createDataFrame(rows, schema).repartition(parts), "id").first().group_id == "DOC-001"


def test_headers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Cédula,Nombres,Ciudad,other\n 123456 , ana ,nan,1\nx12,b,c,2\n")
    assert [tuple(r) for r in tabular.read_sheet(spark, str(tmp_path / "s.csv")).collect()] == [("123456", "ANA", "", "1")]
    df = spark.createDataFrame([("1", "2")], "cedula string, cc string")
    with pytest.raises(ValueError, match="several"):
        tabular.rename_headers(df)
    with pytest.raises(ValueError, match="no column"):
        tabular.rename_headers(df.select(F.col("cc").alias("zz")))
    assert [r[0] for r in spark.createDataFrame([("a.PDF",), ("b.doc",)], "f string").select(tabular.allowed_file(F.col("f"), ["pdf"])).collect()] == [True, False]
    (tmp_path / "d.json").write_text('{"words": ["a", "b", "a"]}')
    assert tabular.read_dictionary(spark, str(tmp_path / "d.json"), "words").count() == 2


def test_layout(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"document_id":"d","text":"ab cd","pages":[{"page_number":1,"lines":[{"text":"x","x":0.1},{"text":"y","x":0.2}]},{"page_number":2}]}')
    got = layout.lines_of(layout.read_layouts(spark, str(tmp_path / "l.json"))).collect()
    assert [(r.page_number, r.line_index, r.text) for r in got] == [(1, 0, "x"), (1, 1, "y")]
    one = spark.range(1).select(
        layout.anchored_text(F.lit("hello world "), F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end")), F.struct(F.lit(5).alias("start"), F.lit(8).alias("end")))).alias("t"),
        layout.polygon_box(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.1, 0.2), (0.5, 0.9))])).alias("b"),
        layout.better_text(F.lit("a b"), F.lit("a b c")).alias("c"),
        layout.synthetic_lines(F.lit("a\n\n b")).alias("s"),
    ).first()
    assert one.t == "hello wo" and tuple(one.b) == (0.1, 0.2, 0.4, 0.7) and one.c == "a b c" and [(x.text, x.y) for x in one.s] == [("a", 0.0), ("b", 0.05)]


def test_lines(spark):
    rows = [("d", 1, i, t) for i, t in enumerate(["Ana Luz", "GIVEN NAMES", "12", "Eva", "SEX: F"])]
    df = spark.createDataFrame(rows, "document_id string, page_number int, line_index int, text string")
    assert lines.names_by_position(df, "GIVEN NAMES").first().value == "Ana Luz"
    r = {x.line_index: x for x in lines.next_valid(lines.lines_above(lines.around(df))).collect()}
    assert r[1].next_valid == "Eva" and r[3].above == ["GIVEN NAMES", "12"] and r[4].around == ["12", "Eva", "SEX: F"]
    sex = df.groupBy("document_id").agg(lines.sex_near(F.array_sort(F.collect_list("text"))).alias("s")).first().s
    assert sex == "F"
    alone = spark.createDataFrame([(["M", "SEX", "x"],), (["SEX", "a", "F"],), (["x"],)], "l array<string>").select(lines.sex_near(F.col("l"))).collect()
    assert [r[0] for r in alone] == ["M", "F", None]


def test_values_near_labels(spark):
    page = ["ROE", "GIVEN NAMES", "ANA LU", "EXPIRES", "x", "05MAY1987", "DATE AND PLACE", "07-JUN-2010, SAN TELMO"]
    one = spark.createDataFrame([(page,)], "l array<string>").select(
        lines.compact_date_after(F.col("l"), "EXPIRES").alias("a"),
        lines.date_and_place(F.col("l"), "DATE AND PLACE").alias("b"),
        lines.line_before_label(F.col("l"), "GIVEN NAMES").alias("c"),
        lines.words_after_label(F.array_join("l", "\n"), "GIVEN NAMES").alias("d"),
        lines.compact_date_after(F.col("l"), "NONE").alias("e"),
    ).first()
    assert one.a == dt.date(1987, 5, 5) and tuple(one.b) == (dt.date(2010, 6, 7), "SAN TELMO") and one.c == "ROE" and one.d == "ANA LU" and one.e is None


def _boxes(spark, rows):
    return spark.createDataFrame([("d", 1, i, t, 0.9, *b) for i, (t, b) in enumerate(rows)], "document_id string, page_number int, line_index int, text string, confidence double, x double, y double, w double, h double")


def test_spatial(spark):
    page = _boxes(spark, [("G1VEN NAMES", (0.1, 0.30, 0.2, 0.02)), ("ANA", (0.1, 0.36, 0.2, 0.02)), ("SURNAMES", (0.1, 0.42, 0.2, 0.02)), ("ROE", (0.1, 0.47, 0.2, 0.02)), ("FAR", (0.1, 0.02, 0.2, 0.02))])
    labels = spatial.find_labels(page)
    assert {(r.field, r.label_index) for r in labels.collect()} == {("surnames", 2), ("given_names", 0)}
    pairs = spatial.candidates(page, labels)
    assert {r.spatial for r in pairs.where("text = 'FAR'").collect()} == {0.0}
    taken = spatial.exclusive(pairs, ["surnames", "given_names"]).select("field", "line_index").collect()
    assert len({r.line_index for r in taken}) == 2
    roles = [r.role for r in spatial.debug_report(labels, pairs, spatial.best_candidates(pairs)).collect()]
    assert roles.count("LABEL") == 2 and roles.count("ACCEPTED") == 2 and "REJECTED" in roles
    below = spark.range(1).select(
        spatial.relation(spatial.box(*map(F.lit, (0.1, 0.5, 0.2, 0.02))), spatial.box(*map(F.lit, (0.1, 0.56, 0.2, 0.02)))).alias("r"),
        spatial.relation(spatial.box(*map(F.lit, (0.1, 0.5, 0.2, 0.02))), spatial.box(*map(F.lit, (0.1, 0.1, 0.2, 0.02)))).alias("a"),
        spatial.horizontal_overlap(spatial.box(*map(F.lit, (0.0, 0, 0.2, 0))), spatial.box(*map(F.lit, (0.1, 0, 0.2, 0)))).alias("o"),
    ).first()
    assert tuple(below.r) == ("DIRECTLY_BELOW", 0.9) and tuple(below.a) == ("ABOVE", 0.0) and below.o == pytest.approx(0.5)


def test_classify(spark):
    def one(rule, value):
        return tuple(spark.range(1).select(rule(F.lit(value)).alias("r")).first().r)

    assert one(classify.document_type, "short") == ("NO_DOCUMENT", 0.0, True)
    assert one(classify.document_type, "NATIONAL REGISTER IDENTITY DOCUMENT NUMBER 1234567") == ("TYPE_A", 0.99, False)
    assert one(classify.document_type, "a YOUTH CARD of someone") == ("TYPE_B", 0.94, False)
    assert one(classify.document_type, "NATIONAL REGISTER only here") == ("UNKNOWN", 0.5, True)
    assert one(classify.document_type, "nothing of the kind here") == ("NO_DOCUMENT", 0.1, True)
    assert one(classify.page_side, "SURNAMES and GIVEN NAMES") == ("FRONT", 0.9)
    assert one(classify.page_side, "the REGISTRAR signs here") == ("BACK", 0.85)
    assert one(classify.page_side, "SURNAMES REGISTRAR") == ("BOTH", 0.99)
    assert one(classify.page_side, "some other text") == ("UNKNOWN", 0.3)
    assert one(classify.page_layout, "SURNAMES GIVEN NAMES")[0] == "FRONT" and one(classify.page_layout, "YOUTH CARD")[1] == "VALUE_BELOW_LABEL"


def test_letters_count_as_written(spark):
    """Upper case has two letters for ß; wide spaces around a text are spaces."""
    rows = [("ß" * 14,), ("ß" * 15,), ("\u00a0" * 9 + "x" * 14 + "\u3000",), (" FRONT " + "ß" * 2,), (" FRONT " + "ß" * 5,)]
    of = spark.createDataFrame(rows, "t string").select(classify.document_type(F.col("t")).alias("d"), classify.page_side(F.col("t"), front=["FRONT"]).alias("s")).collect()
    assert [r.d.confidence for r in of[:3]] == [0.0, 0.1, 0.0] and [r.s.side for r in of[3:]] == ["UNKNOWN", "FRONT"]


def test_lone_sharp_s_is_no_word(spark):
    rows = [("d", 1, i, t) for i, t in enumerate(["ß ß ß", "Ab ß cd ef gh ij", "ab ßa cd ef gh ij"])]
    got = lines.previous_valid(spark.createDataFrame([*rows, ("d", 1, 3, "x")], "document_id string, page_number int, line_index int, text string"))
    assert [r.previous_valid for r in got.orderBy("line_index").collect()] == [None, None, "Ab ß cd ef gh ij", None]


def test_doc_classify_of_null_texts(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.doc_type, r.confidence) for r in text_queries.doc_classify(spark, str(tmp_path)).collect()} == {1: ("NO_DOCUMENT", 0.1), 2: ("NO_DOCUMENT", 0.0)}


PAGES = "document_id string, page_number int, side string, doc_type string, confidence double, id_number string"


def pair(spark, *pages):
    rows = [("d", n, side, "A", 0.9, number) for n, side, number in pages]
    return [(r.group_id, r.front_page, r.back_page, r.confidence, r.status) for r in pairing.pair_pages(spark.createDataFrame(rows, PAGES)).orderBy("group_id").collect()]


def test_pairing(spark):
    f, b = "FRONT", "BACK"
    assert pair(spark, (2, b, "1"), (1, f, "1")) == [("DOC-001", 1, 2, 0.99, "VALID")]
    assert [x[1:3] for x in pair(spark, (1, f, "1"), (2, f, "2"), (3, b, "1"), (4, b, "2"))] == [(1, 3), (2, 4)]
    assert pair(spark, (1, f, "1"), (2, b, "9")) == [("DOC-001", 1, 2, 0.35, "VALID")]  # in conflict, but next to each other
    assert pair(spark, (1, f, "1"), (2, "UNKNOWN", None)) == [("DOC-001", 1, 2, 0.75, "VALID")]
    assert pair(spark, (1, f, None)) == [("DOC-001", 1, None, 0.9, "REVIEW_REQUIRED")]
    assert pair(spark, (1, b, None)) == [("DOC-001", None, 1, 0.7, "REVIEW_REQUIRED")]
    assert pair(spark, (1, "BOTH", "5")) == [("DOC-001", 1, 1, 0.99, "VALID")]
    assert [x[4] for x in pair(spark, (1, f, "1"), (3, f, "1"))] == ["VALID", "DUPLICATE_REVIEW_REQUIRED"]
    score = lambda a, c, d: spark.range(1).select(pairing.association(F.lit(a).cast("string"), F.lit(c).cast("string"), F.lit("A"), F.lit("A"), F.lit(d)).alias("s")).first().s
    for a, c, d, want in (("1", "1", 1, 0.99), ("1", "2", 1, 0.10), (None, "1", 4, 0.25 + 0.07), (None, None, -1, 0.35)):
        assert score(a, c, d) == pytest.approx(want)
    # two backs of one number: the first goes late to that number's lone front
    assert [x[1:3] for x in pair(spark, (1, f, "1"), (9, f, None), (20, b, None), (30, b, None))] == [(1, None), (9, None), (None, 20), (None, 30)]
    # the earlier front has the page that both want
    assert [x[1:3] for x in pair(spark, (1, f, None), (3, b, None), (4, f, None))] == [(1, 3), (4, None)]


def in_turn(pages):
    """The greedy choice of one document, front by front, each against all pages left: [(front, other)]."""
    left = {n: (side, number, kind) for n, side, number, kind in pages}
    out = []
    for n, side, number, kind in sorted(pages, key=lambda p: p[0]):
        if "FRONT" not in side:
            continue
        options = []
        for o, (s, i, t) in left.items():
            gap = o - n
            known = bool(number and i)
            points = 0.10 if known and number != i else min(0.99, 0.5 * known + 0.25 * (t == kind) + (0.15 if gap == 1 else max(0.05, 0.15 - gap * 0.02) if gap > 1 else 0) + 0.1 * (abs(gap) <= 2))
            more = min(0.99, points + 0.25) if abs(gap) == 1 else points
            if "BACK" in s and gap == 1 and points >= 0.2:
                options.append((1, 0, o))
            elif s == "UNKNOWN" and gap == 1:
                options.append((2, 0, o))
            elif "BACK" in s and more >= 0.35:
                options.append((3, -more, o))
        if options:
            left.pop(min(options)[2])
        out.append((n, min(options)[2] if options else None))
    return out


@pytest.mark.parametrize("block", [pairing.BLOCK, 5, 2])
def test_blocks_equal_the_choice_in_turn(spark, block):
    rng = random.Random(block)
    sides, numbers = ["FRONT", "BACK", "FRONT", "BACK", "UNKNOWN"], [None, None, "1", "2"]
    docs = {f"d{k}": [(n, rng.choice(sides), rng.choice(numbers), rng.choice("AAB" if k % 2 else "A")) for n in range(1, rng.randint(2, 30))] for k in range(60)}
    docs["one"] = [(n, rng.choice(sides[:2]), "1", rng.choice(["A", "B", None])) for n in range(-3, 40)]
    docs["chain"] = [(n, "FRONT" if n % 4 < 2 else "BACK", None, "A") for n in range(40)]
    rows = [(d, n, s, t, 0.9, i) for d, pages in docs.items() for n, s, i, t in pages]
    held = pairing._pages(spark.createDataFrame(rows, PAGES), "document_id")
    got = {(r.k, r.front): r.other for r in pairing.settle(held, block).collect()}
    assert got == {(d, f): o for d, pages in docs.items() for f, o in in_turn(pages) if o is not None}


def test_pages_of_one_document_in_many_files(spark, tmp_path):
    """Pages dealt without order: a join that becomes a broadcast while it runs must not leave a block in several tasks."""
    docs = {k: [(n, ("FRONT", "BACK")[n % 4 > 1], None, "A") for n in range(12)] for k in range(300)}
    rows = [(k, n, side, number, kind) for k, pages in docs.items() for n, side, number, kind in pages]
    spark.createDataFrame(rows, "k long, page int, role string, id string, type string").repartition(8, "page").write.parquet(f"{tmp_path}/p")
    spread = session.cut(spark.read.parquet(f"{tmp_path}/p").repartition(8, "page"))
    # as for tables that are estimated large and turn out small
    planned = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
    for name, value in planned.items():
        spark.conf.set(name, value)
    try:
        got = {(r.k, r.front, r.other) for r in pairing.settle(spread).collect()}
    finally:
        for name in planned:
            spark.conf.unset(name)
    assert got == {(k, f, o) for k, pages in docs.items() for f, o in in_turn(pages) if o is not None}


@pytest.mark.parametrize("sides", ["FB", "BF", "F B"])
def test_many_pages_of_one_number(spark, sides, monkeypatch):
    """1,000 fronts and backs of one number in one round: fronts first, backs first, by turns."""
    side = {"FB": lambda n: "FRONT" if n < 1000 else "BACK", "BF": lambda n: "BACK" if n < 1000 else "FRONT", "F B": lambda n: ("FRONT", "BACK")[n % 2]}[sides]
    pages = [(n, side(n), "7", "A" if n % 3 else "B") for n in range(2000)]
    cuts = []
    monkeypatch.setattr(pairing, "cut", lambda df: cuts.append(1) or session.cut(df))
    got = pairing.settle(pairing._pages(spark.createDataFrame([("d", n, s, t, 0.9, i) for n, s, i, t in pages], PAGES), "document_id"))
    assert {(r.front, r.other) for r in got.collect()} == {x for x in in_turn(pages) if x[1] is not None} and len(cuts) == 1


def test_points_are_the_association(spark):
    ids, gaps = [None, "1", "2"], [g for g in range(-4, 9) if g]
    rows = [(a, b, s, t, g) for a in ids for b in ids for s in ("A", None) for t in ("A", "B", None) for g in gaps]
    df = spark.createDataFrame(rows, "a string, b string, s string, t string, g int")
    for r in df.select("*", pairing.association(F.col("a"), F.col("b"), F.col("s"), F.col("t"), F.col("g")).alias("want")).collect():
        assert pairing.points((10, "FRONT", r.a, r.s), (10 + r.g, "BACK", r.b, r.t)) == r.want


def test_all_pages_are_grouped_once(spark):
    rng = random.Random(1)
    sides = ["FRONT", "BACK", "UNKNOWN", "BOTH", "B_FRONT", "B_BACK", "other", None, *schemas.SIDES]
    rows = [(f"d{i % 20}", i // 20, rng.choice(sides), "A", 0.9, rng.choice([None, "", "1", "2", "3"])) for i in range(200)]
    got = pairing.pair_pages(spark.createDataFrame(rows, PAGES))
    pages = got.select("document_id", F.explode(F.array_distinct("pages")).alias("p")).collect()
    assert sorted(map(tuple, pages)) == sorted((d, n) for d, n, *_ in rows)
    ids = got.groupBy("document_id").agg(F.sort_array(F.collect_list("group_id")).alias("g")).collect()
    assert all(r.g == [f"DOC-{k:03d}" for k in range(1, len(r.g) + 1)] for r in ids)


def test_classified_pages_are_paired(spark):
    """What page_side() says feeds pair_pages(); pages of both sides stay."""
    texts = ["NATIONAL REGISTER SURNAMES GIVEN NAMES", "DATE OF BIRTH PLACE OF BIRTH", "SURNAMES and DATE OF BIRTH", "YOUTH CARD DATE OF BIRTH", "nothing to see on this page", ""]
    pages = spark.createDataFrame([("d", n, t) for n, t in enumerate(texts, 1)], "document_id string, page_number int, text string")
    sided = pages.select("*", classify.page_side(F.col("text"))["side"].alias("side"), F.lit("A").alias("doc_type"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("id_number"))
    assert "BOTH" in {r.side for r in sided.collect()}
    got = pairing.pair_pages(sided).collect()
    assert sorted({p for r in got for p in r.pages}) == [1, 2, 3, 4, 5, 6] and (3, 3) in {(r.front_page, r.back_page) for r in got}


def test_scoring(spark):
    given_names = spark.createDataFrame([("ANA",), ("MARIA",)], "word string")
    surnames = spark.createDataFrame([("ROE",)], "word string")
    words = spark.createDataFrame([("Ana",), ("MARIB",), ("ZZZ",)], "w string")
    got = {r.word: r for r in scoring.word_evidence(words, "w", given_names, surnames).collect()}
    assert got["Ana"].given_score == 0.95 and got["MARIB"].given_score == pytest.approx(0.68) and got["MARIB"].fuzzy and got["ZZZ"].given_score == 0
    rows = spark.createDataFrame([(1, ["Ana", "ZZZ"], True, True, 10.0, 0.9)], "k int, tokens array<string>, label_present boolean, place_ok boolean, distance double, confidence double")
    scored = scoring.score_candidates(rows, "k", "tokens", scoring.word_evidence(words, "w", given_names, surnames))
    assert scored.count() == 3
    best = scoring.decide(scored, "k").first()
    assert best.candidate == "Ana" and best.status == "valid" and best.score == pytest.approx(0.4 + 0.3 + 0.135 + 0.095 + 0.05)


def test_best_names_are_the_decision_over_all_runs(spark):
    """Random words, some in one or both dictionaries; no word is gathered, so work grows with the words alone."""
    rng = random.Random(5)
    vocabulary = ["ANA", "LUZ", "ANNA", "ROE", "ROES", "TELMO", "x", "y", None]
    rows = [(k, [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))], k % 3 > 0, k % 2 == 0, float(k * 7 % 90), 0.9) for k in range(200)] + [(None, ["ANA", "x"], True, True, 1.0, 0.9), (900, None, True, True, 1.0, 0.9)]
    df = spark.createDataFrame(rows, "k long, tokens array<string>, label_present boolean, place_ok boolean, distance double, confidence double")
    names = lambda *ws: spark.createDataFrame([(w,) for w in ws], "word string")
    evidence = scoring.word_evidence(df.select(F.explode("tokens").alias("w")), "w", names("ANA", "LUZ", "TELMO"), names("ROE", "TELMO"), exact_ratio=False)
    scored = scoring.score_candidates(df, "k", "tokens", evidence)
    per = {k: len(t or []) for k, t, *_ in rows}
    assert {r.k: r["count"] for r in scored.groupBy("k").count().collect()} == {k: sum(max(n - i, 0) for i in range(4)) for k, n in per.items() if n}
    facts = ["k", "candidate", "size", "start", "score", "runner_up"]
    best = scoring.best_names(df, "k", "tokens", evidence)
    assert sorted(map(str, best.select(facts).collect())) == sorted(map(str, scoring.decide(scored, "k").select(facts).collect()))
    assert {r.k for r in best.where("status = 'valid'").collect()} & {k for k, *_ in rows}
    for plan in (scored, best):
        assert "collect_list" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_runs_without_evidence_are_scored_once_a_row(spark):
    """Their scores are made before the row's words are set apart, and are those of the rule."""
    rows = [(1, ["x", "ANA", "y", "y"], True, True, 10.0, 0.9), (2, ["x", "y"], False, True, 60.0, 0.333333), (3, ["ANA"], True, None, None, None), (4, [], True, True, 1.0, 0.9)]
    df = spark.createDataFrame(rows, "k long, tokens array<string>, label_present boolean, place_ok boolean, distance double, confidence double")
    names = spark.createDataFrame([("ANA",)], "word string")
    evidence = scoring.word_evidence(df.select(F.explode("tokens").alias("w")), "w", names, names, exact_ratio=False)
    runs = scoring.word_runs(df, "k", "tokens", evidence)
    got = {(r.k, i): r[f"p{i}"] for r in runs.collect() for i in range(1, 5)}
    plain = lambda label, place, confidence, near, k: round(label * 0.4 + place * 0.3 + confidence * 0.15 + 0.025 + (0.03 * (k - 1) if near else 0), 4)
    assert got == {(1, i): plain(1, 1, 0.9, True, i) for i in range(1, 5)} | {(2, i): plain(0.4, 0.8, 0.333333, False, i) for i in range(1, 5)} | {(3, i): 0.485 for i in range(1, 5)}
    scored = {(r.k, r.start, r.size): r for r in scoring.score_candidates(df, "k", "tokens", evidence).collect()}
    assert len(scored) == 10 + 3 + 1 and all(r.score == got[k, n] for (k, at, n), r in scored.items() if "ANA" not in r.candidate)
    assert scored[1, 1, 3].candidate == "x ANA y" and scored[1, 1, 3].dictionary == 0.32 and scored[1, 2, 1].score == pytest.approx(0.4 + 0.3 + 0.135 + 0.095 + 0.05)


def test_record_confidence(spark):
    schema = "id_number string, given_names string, surnames string, birth_date string, issue_date string, issue_place string, sex string"
    df = spark.createDataFrame([("1234567", "ANA", "ROE", "x", "x", "x", "F"), ("SIN_ID_1", None, "B", None, None, None, None), (None,) * 7], schema)
    assert [r[0] for r in df.select(scoring.extraction_confidence()).collect()] == [92.5, 17.5, 0.0]
    assert [r[0] for r in df.select(merge.is_record()).collect()] == [True, False, False]
    with_c = df.withColumn("confidence", scoring.extraction_confidence())
    assert [r[0] for r in with_c.select(merge.record_status(F.lit("layout"), merge.needs_review())).collect()] == ["VALID", "REVIEW_REQUIRED", "REVIEW_REQUIRED"]


def test_merge(spark):
    schema = "k string, t int, a string, b string, score double, engine string"
    rows = [("x", 1, "a1", None, 50.0, "e1"), ("x", 2, None, "b2", 50.0, "e2"), ("x", 3, "a3", None, 40.0, "e3"), ("y", 1, None, None, None, "e")]
    got = {r.k: tuple(r)[1:] for r in merge.upsert(spark.createDataFrame(rows, schema), "k", ["t"], ["a", "b"], "score", ["engine"]).collect()}
    assert got == {"x": ("a3", "b2", 50.0, "e1"), "y": (None, None, None, "e")}
    store = spark.createDataFrame([("x", 9, "old", "old", 60.0, "e0")], schema)
    got = merge.merge_into(store, spark.createDataFrame(rows, schema), "k", ["t"], ["a", "b"], "score", ["engine"]).where("k = 'x'").first()
    assert tuple(got)[1:] == ("a3", "b2", 60.0, "e0")
    side = "g string, given_names struct<value:string,confidence:double>, issue_date struct<value:string,confidence:double>"
    f = spark.createDataFrame([("1", ("A", 0.9), ("d1", 0.8)), ("2", ("A", 0.9), None)], side)
    b = spark.createDataFrame([("1", ("B", 0.9), ("d2", 0.8)), ("3", ("C", 0.9), ("d3", 0.7))], side)
    got = {r.g: r for r in merge.merge_sides(f, b, "g", ["given_names", "issue_date"]).collect()}
    assert tuple(got["1"].issue_date) == ("d2", 0.5, "REVIEW_REQUIRED") and tuple(got["1"].given_names) == ("A", 0.5, "REVIEW_REQUIRED")
    assert got["3"].given_names is None and tuple(got["2"].issue_date) == (None, 0.0, "MISSING_DATA")


def test_views(spark):
    df = spark.createDataFrame([(1, "a_b", True), (2, "axb", None), (3, "c", False)], "id int, name string, flag boolean")
    assert {r.id for r in views.search(df, "A_B", ["name"]).collect()} == {1, 2}
    assert {r.id for r in views.search(df, "A_B", ["name"], escaped=True).collect()} == {1}
    assert views.equal_if_given(df, {"flag": False}).count() == 1 and views.equal_if_truthy(df, {"name": ""}).count() == 3
    assert views.deleted(df, df.where("id = 1"), "id").count() == 2 and views.lookup(df, "id", " 2 ").count() == 1
    reviewed = df.withColumn("reviewed_fields", F.array(F.lit("surnames")))
    got = views.updated(reviewed, {"name": "new", "surnames": None, "given_names": "x"}).first()
    assert got.name == "NEW" and got.reviewed_fields == ["surnames", "given_names"]
    docs = spark.createDataFrame([(1, 7), (2, None)], "id int, user_id int")
    users = spark.createDataFrame([(7, "u", "e", True)], "id int, name string, email string, active boolean")
    recs = spark.createDataFrame([(1, 1, True), (2, 1, False)], "id int, document_id int, requires_review boolean")
    assert {(r.id, r.user_name, r.records, r.in_review) for r in views.document_summary(docs, users, recs).collect()} == {(1, "u", 2, 1), (2, None, 0, 0)}
    assert views.active_user(users, "E").count() == 1
    assert spark.range(1).select(views.percent_done(F.lit(1), F.lit(3)), views.percent_done(F.lit(1), F.lit(0))).first() == (33.0, 0.0)


def test_streamed_upserts_merge_once(spark, tmp_path):
    schema = "k string, t int, a string, score double, engine string"
    batches = [[("x", 1, "a1", 5.0, "e1")], [("x", 2, None, 7.0, "e2"), ("y", 1, "b", 1.0, "e")], [("x", 3, "a3", 7.0, "e3")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = start_upserts(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, f"{tmp_path}/store", f"{tmp_path}/state", "k", ["t"], ["a"], "score", ["engine"])
        q.awaitTermination()
        assert latest_version(spark, f"{tmp_path}/store").count() == min(k + 1, 2)
    got = {r.k: (r.a, r.score, r.engine, r.t) for r in latest_version(spark, f"{tmp_path}/store").collect()}
    assert got == {"x": ("a3", 7.0, "e2", 3), "y": ("b", 1.0, "e", 1)}


def _parts(path):
    return {(v.name, p.name) for v in (path / "data").iterdir() for p in v.iterdir() if p.name.startswith("part=")}


def test_store_rewrites_only_touched_ranges(spark, tmp_path):
    from cartulary.streaming import store

    schema = "k long, t int, a string, score double, engine string"
    args = ("k", ["t"], ["a"], "score", ["engine"])
    path, at = tmp_path / "s", str(tmp_path / "s")
    rows = {k: (k, 1, f"a{k}", float(k), "e") for k in range(10_000)}
    store.merge(spark.createDataFrame(list(rows.values()), schema), at, 0, *args, parts=100)
    assert store.read(spark, at).count() == 10_000 and 90 <= len(_parts(path)) <= 100
    before = _parts(path)
    # one key in a hundred, next to each other: about one range in a hundred
    batch = [(k, 2, None if k % 2 else f"b{k}", -1.0 if k % 3 else 1e9, "new") for k in range(4000, 4100)]
    touched = store.merge(spark.createDataFrame(batch, schema), at, 1, *args)
    assert 1 <= len(touched) <= 3 and len(_parts(path) - before) == len(touched)
    got = {r.k: (r.t, r.a, r.score, r.engine) for r in store.read(spark, at).collect()}
    for k, t, a, score, engine in batch:
        _, _, old, best, by = rows[k]
        assert got[k] == (t, a or old, max(best, score), engine if score > best else by)
    assert got[3999] == (1, "a3999", 3999.0, "e") and len(got) == 10_000
    # the same merge again gives the same table; keys below, above and null find a range
    store.merge(spark.createDataFrame(batch, schema), at, 1, *args)
    assert {r.k: (r.t, r.a, r.score, r.engine) for r in store.read(spark, at).collect()} == got
    store.merge(spark.createDataFrame([(-5, 1, "low", 1.0, "e"), (10**9, 1, "high", 1.0, "e"), (None, 1, "none", 1.0, "e")], schema), at, 2, *args)
    assert {r.a for r in store.read(spark, at).where("k < 0 OR k >= 10000 OR k IS NULL").collect()} == {"low", "high", "none"}
    store.merge(spark.createDataFrame([(None, 2, "again", 1.0, "e")], schema), at, 3, *args)
    assert store.read(spark, at).where("k IS NULL").count() == 1
    # a merge that ended before its manifest changes nothing
    (path / "data" / "version=9" / "part=0").mkdir(parents=True)
    assert store.read(spark, at).count() == 10_003
    gone = store.drop_old(spark, at, keep=1)
    assert gone >= len(touched) and store.read(spark, at).count() == 10_003 and len(store._manifests(spark, at)) == 1
    assert (path / "data" / "version=9").exists()
    # an empty table, then rows
    store.merge(spark.createDataFrame([], schema), f"{at}e", 0, *args)
    assert store.read(spark, f"{at}e").count() == 0
    store.merge(spark.createDataFrame([(1, 1, "x", 1.0, "e")], schema), f"{at}e", 1, *args)
    assert store.read(spark, f"{at}e").first().a == "x"
