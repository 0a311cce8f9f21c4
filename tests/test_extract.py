"""Whole pages of invented records."""

from pyspark.sql import functions as F

from cartulary.functions import places
from cartulary.operators import extract, names
from cartulary.sources import sinks

SCHEMA = "document_id string, page_number int, line_index int, text string, confidence double, x double, y double, w double, h double"


def page(n, *lines):
    return [("d", n, i, t, 0.9, 0.1, y, 0.3, 0.02) for i, (t, y) in enumerate(lines)]


FRONT = page(1, ("NATIONAL REGISTER", 0.02), ("NUMBER 12.345.678", 0.10), ("ROE", 0.26), ("SURNAMES", 0.30), ("ANA", 0.42), ("GIVEN NAMES", 0.46))
BACK = page(2, ("DATE OF BIRTH 03-MAY-1990", 0.1), ("SEX F", 0.2), ("DATE AND PLACE OF ISSUE", 0.5), ("07-JUN-2010 RIVERA (ORIENTE)", 0.55))
MACHINE = page(3, ("9005037F3001011XXX12345678<8", 0.8), ("ROE<<ANA<MARIA", 0.85))


def test_fields_and_groups(spark):
    lines = spark.createDataFrame(FRONT + BACK + MACHINE, SCHEMA)
    fields = extract.extract_fields(lines).cache()
    got = {(r.page_number, r.field): r for r in fields.collect()}
    assert len(got) == 21
    value = lambda p, f: got[p, f].value
    assert value(1, "id_number") == "12345678" and value(1, "surnames") == "ROE" and value(1, "given_names") == "ANA"
    assert (value(2, "birth_date"), value(2, "issue_date"), value(2, "sex")) == ("1990-05-03", "2010-06-07", "F")
    assert value(2, "issue_place") == "RIVERA"
    assert (value(3, "id_number"), value(3, "birth_date"), value(3, "given_names"), got[3, "sex"].source) == ("12345678", "1990-05-03", "ANA MARIA", "machine")
    assert got[1, "issue_date"].status == "REVIEW_REQUIRED" and value(1, "issue_date") is None
    groups = spark.createDataFrame([("d", "DOC-001", 1, 2), ("d", "DOC-002", None, 3)], "document_id string, group_id string, front_page int, back_page int")
    merged = {r.group_id: r for r in extract.extract_groups(fields, groups).collect()}
    assert merged["DOC-001"].surnames.value == "ROE" and merged["DOC-001"].issue_date.value == "2010-06-07"
    assert merged["DOC-002"].surnames is None and merged["DOC-002"].id_number.value == "12345678"


def test_places_by_stage(spark):
    gazetteer = spark.createDataFrame([("RIVERA", False, None), ("SAN TELMO", False, None), ("ORIENTE", True, None), ("NORTH HILL", False, None), ("NORTH HILL UNDER LAKE", False, None)], "name string, is_region boolean, alias_of string")
    rows = [("a", 0, "x"), ("a", 1, "RIVRA (ORIENTE)"), ("b", 0, "PLACE OF ISSUE"), ("b", 1, "SAN TELMO"), ("c", 0, "in SAN TELMO here"), ("d", 0, "at RIVEERA"), ("e", 0, "ORIENTE"), ("f", 0, "at NORTH HILL UNDER LAKE"), ("g", 0, "NORTH HILL or SAN TELMO")]
    lines = spark.createDataFrame([(k, 1, i, t) for k, i, t in rows], "document_id string, page_number int, line_index int, text string")
    got = {r.document_id: (r.place, r.stage) for r in places.extract_places(lines, gazetteer).collect()}
    assert got == {"a": ("RIVERA", 1), "b": ("SAN TELMO", 2), "c": ("SAN TELMO", 3), "d": ("RIVERA", 4), "f": ("NORTH HILL UNDER LAKE", 3), "g": ("NORTH HILL", 3)}
    assert places.longest_first(["A", "ABC", "AB"]) == "ABC|AB|A"


def test_sinks(spark, tmp_path):
    diffs = spark.createDataFrame([("1", "x", "diferente"), ("2", "y", "nuevo_bd")], "id string, field string, diff_kind string")
    sinks.append_differences(diffs, f"{tmp_path}/d", "c1")
    sinks.append_differences(diffs, f"{tmp_path}/d", "c2")
    sinks.write_by_kind(diffs, f"{tmp_path}/k")
    sinks.write_sheet(diffs, f"{tmp_path}/s")
    sinks.replace(diffs, f"{tmp_path}/v1")
    assert spark.read.parquet(f"{tmp_path}/d").count() == 4 and {r[0] for r in spark.read.parquet(f"{tmp_path}/k").select("diff_kind").distinct().collect()} == {"diferente", "nuevo_bd"}
    assert spark.read.option("header", True).csv(f"{tmp_path}/s").where(F.col("id") == "1").count() == 1


def one(spark, *lines):
    rows = [("d", 1, i, t, 0.9, 0.1, y, 0.3, 0.02) for i, (t, y) in enumerate(lines)]
    r = names.page_names(spark.createDataFrame(rows, SCHEMA)).first()
    return tuple((x.value, x.source, round(x.confidence, 4)) if x else None for x in (r.surnames, r.given_names))


def test_names_by_label_order(spark):
    by = lambda v, c=0.95, s="order of labels": (v, s, c)
    # values above their labels: at most two lines, none from before the number
    assert one(spark, ("OLD WORDS", 0.05), ("NUMBER 12.345.678", 0.10), ("LONG", 0.2), ("TAIL", 0.22), ("SURNAMES", 0.25), ("ANA", 0.3), ("LUZ", 0.32), ("EVA", 0.34), ("GIVEN NAMES", 0.4)) == (by("LONG TAIL"), by("LUZ EVA"))
    # without a number the three lines above count
    assert one(spark, ("ONE", 0.01), ("TWO", 0.02), ("7", 0.03), ("6", 0.04), ("SURNAMES", 0.05), ("ANA", 0.06), ("GIVEN NAMES", 0.07))[0] == by("TWO")
    # values below their labels: all lines between, two after
    assert one(spark, ("GIVEN NAMES", 0.1), ("ANA", 0.2), ("LUZ", 0.21), ("EVA", 0.22), ("SURNAMES", 0.3), ("ROE", 0.31), ("POE", 0.32), ("END", 0.33)) == (by("ROE POE"), by("ANA LUZ EVA"))
    # the label's own line first; what stands lower than the zone is no name
    assert one(spark, ("SURNAMES: ROE", 0.1), ("GIVEN NAMES", 0.2), ("ANA", 0.6)) == (by("ROE", s="on the label's line"), None)
    # no labels: the first two different clean lines, no heading, none with a digit or outside the zone
    assert one(spark, ("HIGH", 0.1), ("CIVIL REGISTERS", 0.15), ("ROE", 0.2), ("ROE", 0.21), ("A 1", 0.22), ("ANA LUZ", 0.3)) == (by("ROE", 0.7125, "clean lines"), by("ANA LUZ", 0.7125, "clean lines"))
    assert one(spark, ("ROE", 0.2)) == (by("ROE", 0.7125, "clean lines"), None)
    # lines come in order of y, whatever their index; of one height by index
    assert one(spark, ("GIVEN NAMES", 0.3), ("ANA", 0.25), ("SURNAMES", 0.2), ("ROE", 0.1)) == (by("ROE"), by("ANA"))
    assert names.page_names(spark.createDataFrame([], SCHEMA)).count() == 0


def test_machine_lines_and_labels(spark):
    lines = spark.createDataFrame([("d", 1, i, t, 0.9, 0.1, y, 0.3, 0.02) for i, (t, y) in enumerate([("SURNAMES POE", 0.1), ("GIVEN NAMES", 0.2), ("EVA", 0.25), ("ROE<<ANA<MARIA", 0.85)])], SCHEMA)
    got = {r.field: r for r in extract.extract_fields(lines).collect()}
    assert (got["surnames"].value, got["given_names"].value, got["surnames"].source) == ("ROE", "ANA MARIA", "machine")


def test_zones_dates_and_sex(spark):
    def fields(*rows):
        lines = spark.createDataFrame([("d", 1, i, t, 0.9, x, y, 0.1, 0.02) for i, (t, x, y) in enumerate(rows)], SCHEMA)
        return {r.field: r.value for r in extract.extract_fields(lines).collect()}

    got = fields(("1.234 and 87.654.321", 0.1, 0.3), ("12345678", 0.1, 0.4), ("M", 0.5, 0.3), ("F", 0.3, 0.4), ("24-???-2001", 0.1, 0.5))
    assert (got["id_number"], got["sex"], got["birth_date"], got["issue_date"]) == ("87654321", "M", "2001-01-24", None)
    got = fields(("1.65 O+ F", 0.1, 0.3), ("A-1-2-M-12345678-2", 0.1, 0.9), ("03-MAY-1990", 0.1, 0.5), ("07/06/2010", 0.1, 0.6), ("01-JAN-1850", 0.1, 0.7))
    assert (got["id_number"], got["sex"], got["birth_date"], got["issue_date"]) == ("12345678", "F", "1990-05-03", "2010-06-07")
    # a field that no block gives is looked for by its label, on lines that serve no other
    got = fields(("ROE", 0.1, 0.58), ("SURNAMES", 0.1, 0.6), ("ANA", 0.1, 0.66), ("GIVEN NAMES", 0.1, 0.68), ("GENDER", 0.1, 0.8), ("FEM", 0.12, 0.83))
    assert (got["surnames"], got["given_names"], got["sex"]) == ("ROE", "ANA", "F")


def test_extraction_is_one_plan(spark):
    plan = extract.extract_fields(spark.createDataFrame(FRONT, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_pages_are_dealt_once(spark, tmp_path):
    """Names are read with one shuffle of lines by page, after the one that joins their parts."""
    from cartulary.plans import page_queries

    spark.range(60).selectExpr("id l_orderkey", "1 l_linenumber", "id % 7 l_partkey", "1L l_suppkey", "1D l_quantity", "1D l_extendedprice", "0D l_discount", "0D l_tax", "current_date() l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(6).selectExpr("id p_partkey", "concat('part ', id) p_name").write.parquet(f"{tmp_path}/part.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = page_queries.page_names(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        numbered = page_queries._indexed(spark, str(tmp_path)).select("l_orderkey", "line_index").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3
    assert sorted(map(tuple, numbered)) == [(k, k % 3) for k in range(60) if k % 7 < 6]


def test_placed_values_read_the_page_twice(spark):
    """Once for its labels and once for the lines that meet them; the chosen rows aren't made again to be found."""
    rows = [("d", 1, i, t, 0.9, x, y, 0.2, 0.02) for i, (t, x, y) in enumerate([("SEX: F", 0.1, 0.2), ("NUMBER", 0.1, 0.4), ("12345678", 0.1, 0.45), ("SURNAMES", 0.5, 0.7), (None, 0.5, 0.72), ("ROE", 0.5, 0.68)])]
    lines = spark.createDataFrame(rows, "document_id string, page_number int, line_index int, text string, confidence double, x double, y double, w double, h double")
    got = extract.ranked_fields(lines)
    assert {r.field: r.value for r in got.collect()} == {"sex": "F", "id_number": "12345678", "surnames": "ROE"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2 and plan.count("Join ") == 1
