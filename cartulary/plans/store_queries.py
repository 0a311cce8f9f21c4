"""Lines of a page and their neighbours, regions and candidates of labels, and the small rules of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cartulary.functions import codes, dates, ids, text
from cartulary.operators import lines, spatial, trigrams, views
from cartulary.plans.registry import query, table
from cartulary.session import shared_path
from cartulary.sources import workbook

STOP_SQL = ", ".join(f"'{w}'" for w in text.NAME_STOP_WORDS)
LINES_SQL = """l AS (SELECT doc_id, i - 1 AS line_index, ls[i] AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i) WHERE trim(ls[i], ' ') <> '')"""
VALID_SQL = rf"""v AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[0-9]') AND length(trim(text, ' ')) >= 3 AND len(list_filter(string_split(trim(regexp_replace(upper(text), '[\s\x0B]+', ' ', 'g'), ' '), ' '), lambda w: length(w) >= 2 AND w NOT IN ({STOP_SQL}))) BETWEEN 1 AND 5 THEN trim(text, ' ') END AS valid FROM l)"""


@query(
    f"""WITH {LINES_SQL}, {VALID_SQL}
    SELECT doc_id, line_index, array_to_string(coalesce(list(text) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []), '|') AS above, array_to_string(list(text) OVER (w ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING), '|') AS around,
      lag(valid) OVER w AS previous_valid, first(valid IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS next_valid FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY line_index)"""
)
def line_context(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each document with those above and around them, and the nearest that can be names."""
    keys = ["doc_id"]
    rows = lines.split_lines(table(spark, d, "documents"), "text", keys)
    out = lines.next_valid(lines.previous_valid(lines.around(lines.lines_above(rows, keys), keys), keys), keys)
    return out.select("doc_id", "line_index", F.array_join("above", "|").alias("above"), F.array_join("around", "|").alias("around"), "previous_valid", "next_valid")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey % 97) / 100.0, l_linenumber) AS position FROM lineitem")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    boxes = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line_index"), ((F.col("l_partkey") % 97) / 100.0).alias("y"))
    return lines.reading_order(boxes, ["l_orderkey"]).select("l_orderkey", F.col("line_index").alias("l_linenumber"), "position")


PAGE_LINES_SQL = """n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS i FROM lineitem),
  p AS (SELECT l_orderkey AS d, i, CASE i WHEN 1 THEN 'SURNAMES' WHEN 2 THEN 'G1VEN NAMES' WHEN 3 THEN 'SEX' ELSE 'VALUE' END AS t, l_quantity / 60.0 AS x, ((l_partkey % 97) / 100.0)::DOUBLE AS y, (0.05 + l_discount)::DOUBLE AS w, 0.02::DOUBLE AS h FROM n),
  l AS (SELECT d, CASE i WHEN 1 THEN 'surnames' WHEN 2 THEN 'given_names' ELSE 'sex' END AS field, i AS label_index, x AS lx, y AS ly, w AS lw, h AS lh, max(y) FILTER (i = 2) OVER (PARTITION BY d) AS ny, max(y) FILTER (i = 1) OVER (PARTITION BY d) AS sy FROM p WHERE i <= 3),
  m AS (SELECT *, ny IS NOT NULL AND sy IS NOT NULL AS two, field <> 'sex' AS is_name FROM l),
  r AS (SELECT *, round(greatest(0, lx - 0.2), 4) AS x_min, round(least(1, lx + greatest(lw * 4.5, 0.7)), 4) AS x_max,
    round(greatest(0, CASE WHEN two AND sy < ny THEN CASE WHEN is_name THEN ly - 0.2 ELSE ly - 0.15 END WHEN two THEN CASE WHEN is_name THEN ly - 0.02 ELSE ly END WHEN is_name THEN ly - 0.2 ELSE ly - 0.15 END), 4) AS y_min,
    round(CASE WHEN two AND sy < ny AND is_name THEN ly + 0.04 WHEN two AND sy >= ny AND is_name THEN ly + 0.18 ELSE ly + 0.2 END, 4) AS y_max FROM m)"""


def _page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as lines of a page: the first three are labels, one of them with a damaged letter."""
    k = F.row_number().over(W.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
    i = F.col("i")
    label = F.when(i == 1, "SURNAMES").when(i == 2, "G1VEN NAMES").when(i == 3, "SEX").otherwise("VALUE")
    return table(spark, d, "lineitem").withColumn("i", k).select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_number"), F.col("i").alias("line_index"), label.alias("text"), F.lit(0.9).alias("confidence"), (F.col("l_quantity") / 60.0).alias("x"), ((F.col("l_partkey") % 97) / 100.0).alias("y"), (0.05 + F.col("l_discount")).alias("w"), F.lit(0.02).alias("h"))


@query(f"WITH {PAGE_LINES_SQL} SELECT d AS document_id, field, label_index, x_min, x_max, y_min, y_max FROM r WHERE EXISTS (SELECT 1 FROM p WHERE p.d = r.d AND p.i <> r.label_index)")
def value_regions(spark: SparkSession, d: str) -> DataFrame:
    """Where the value of each label may lie, by the places of the name labels."""
    page = _page_lines(spark, d)
    pairs = spatial.candidates(page, spatial.find_labels(page))
    return pairs.select("document_id", "field", "label_index", "region.*").distinct()


@query(
    f"""WITH {PAGE_LINES_SQL}, c AS (SELECT r.*, p.i, p.x, p.y, p.w, p.h, abs((p.x + p.w / 2) - (lx + lw / 2)) AS off_, p.y - ly AS dy FROM r JOIN p ON p.d = r.d AND p.i <> label_index)
    SELECT d AS document_id, field, i AS line_index, CASE WHEN y < y_min - 0.005 OR y >= y_max OR x < x_min - 0.05 THEN 'WRONG_REGION' WHEN y < ly - 0.14 THEN 'ABOVE' WHEN ly - y > 0 AND ly - y <= 0.14 AND off_ <= lw * 3.5 THEN 'DIRECTLY_ABOVE'
      WHEN dy > 0 AND dy <= 0.15 AND off_ <= lw * 3.5 THEN 'DIRECTLY_BELOW' WHEN abs(dy) <= lh * 1.8 AND x >= lx + lw * 0.1 THEN 'DIRECTLY_RIGHT' WHEN abs((y + h / 2) - (ly + lh / 2)) <= lh * 1.5 THEN 'SAME_ROW' WHEN dy > 0 AND dy <= 0.25 THEN 'NEAR' ELSE 'WRONG_REGION' END AS relation FROM c"""
)
def label_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each label with each other line of its page, and their relation within the label's region."""
    page = _page_lines(spark, d)
    return spatial.candidates(page, spatial.find_labels(page)).select("document_id", "field", "line_index", "relation")


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'M' WHEN 2 THEN 'F' WHEN 3 THEN 'F' END AS sex, CASE c_custkey % 6 WHEN 0 THEN 'M' WHEN 2 THEN 'F' END AS asked, 'DOC-' || lpad(c_custkey::VARCHAR, greatest(3, length(c_custkey::VARCHAR))::INT, '0') AS code FROM customer")
def short_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    said = F.element_at(F.array(*[F.lit(x) for x in ("m ", "Masc", "Mujer", "FEM", "other", None)]), (k % 6 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", codes.sex_code(said).alias("sex"), codes.request_sex_code(said).alias("asked"), codes.group_code(k).alias("code"))


@query(
    """WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '0' || c_custkey::VARCHAR || '.123,45 6' WHEN 1 THEN c_custkey::VARCHAR || 'x' WHEN 2 THEN (c_custkey + 100000)::VARCHAR || '000000' ELSE ' 12.345.' || c_custkey::VARCHAR END AS raw FROM customer), c AS (SELECT *, regexp_replace(raw, '[ .,]', '', 'g') AS clean FROM n)
    SELECT c_custkey, CASE WHEN regexp_full_match(clean, '[0-9]{6,10}') THEN clean END AS asked, regexp_full_match(trim(raw), '[0-9]{6,12}') AS sheet, 'SIN_ID_' || left(sha256(c_custkey::VARCHAR || '|' || raw), 8) AS stand_in FROM c"""
)
def number_forms(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    s = k.cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("0"), s, F.lit(".123,45 6"))).when(k % 4 == 1, F.concat(s, F.lit("x"))).when(k % 4 == 2, F.concat((k + 100_000).cast("string"), F.lit("000000"))).otherwise(F.concat(F.lit(" 12.345."), s))
    return table(spark, d, "customer").select("c_custkey", ids.request_id(raw).alias("asked"), ids.is_sheet_id(raw).alias("sheet"), ids.synthetic_id(s, raw).alias("stand_in"))


@query(
    """WITH n AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN (s_suppkey + 10000000)::VARCHAR WHEN 1 THEN s_suppkey::VARCHAR ELSE (s_suppkey + 90000000)::VARCHAR END AS n FROM supplier)
    SELECT s_suppkey, CASE WHEN length(n) BETWEEN 7 AND 10 THEN n END AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex FROM n"""
)
def footer_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    number = F.when(k % 3 == 0, k + 10_000_000).when(k % 3 == 1, k).otherwise(k + 90_000_000).cast("string")
    line = F.concat(F.lit("text A-1234567-55-"), F.when(k % 2 == 0, "M").otherwise("F"), F.lit("-00"), number, F.lit("-20200101"))
    return table(spark, d, "supplier").select("s_suppkey", ids.footer_id(line).alias("f")).select("s_suppkey", "f.id", "f.sex")


@query(
    """WITH n AS (SELECT o_orderkey, try_strptime((year(o_orderdate) - o_orderkey % 90)::VARCHAR || strftime(o_orderdate, '-%m-%d'), '%Y-%m-%d')::DATE AS a, o_orderdate::DATE AS b FROM orders),
    f AS (SELECT *, list_sort(list_distinct(list_filter([b, a, b], lambda x: x IS NOT NULL))) AS k FROM n)
    SELECT o_orderkey, CASE WHEN year(a) BETWEEN 1930 AND 2026 THEN a END AS kept, CASE WHEN a < b THEN a ELSE b END AS birth, CASE WHEN a < b THEN b ELSE a END AS issue, CASE WHEN len(k) > 1 OR year(k[1]) <= 1995 THEN k[1] END AS first_, CASE WHEN len(k) > 1 THEN k[len(k)] WHEN year(k[1]) > 1995 THEN k[1] END AS last_ FROM f"""
)
def date_rules(spark: SparkSession, d: str) -> DataFrame:
    """Plausible years, dates put in order, and birth and issue from all dates of a document."""
    day = F.col("o_orderdate")
    rows = table(spark, d, "orders")
    # 29 February of a year without one is no date
    a = dates.calendar_date((F.year(day) - F.col("o_orderkey") % 90).cast("string"), F.month(day), F.dayofmonth(day).cast("string"))
    b = day.cast("date")
    out = rows.select("o_orderkey", dates.plausible(a).alias("kept"), dates.in_order(b, a).alias("o"), dates.from_all_dates(F.array(b, a, b, F.lit(None).cast("date")), 1995).alias("f"))
    return out.select("o_orderkey", "kept", F.col("o.birth_date").alias("birth"), F.col("o.issue_date").alias("issue"), F.col("f.birth_date").alias("first_"), F.col("f.issue_date").alias("last_"))


@query(
    """SELECT s_suppkey, concat_ws(' ', CASE WHEN s_suppkey % 4 <> 0 THEN s_name END, n_name) AS whole, round(least(greatest(CASE WHEN s_acctbal / 5000 <= 1 THEN s_acctbal / 5000 * 100 ELSE s_acctbal / 5000 END, 0), 100)) AS shown,
      CASE WHEN s_suppkey % 3 > 0 THEN round(100.0 * (s_suppkey % 2) / (s_suppkey % 3)) ELSE 0 END AS done, s_suppkey % 4 <> 0 AND s_name <> '' AS complete FROM supplier JOIN nation ON n_nationkey = s_nationkey"""
)
def shown_values(spark: SparkSession, d: str) -> DataFrame:
    """Full names, confidences and progress as they are shown, and whether a row is complete."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("given", F.when(k % 4 != 0, F.col("s_name")))
    return s.select("s_suppkey", text.full_name(F.col("given"), F.col("n_name")).alias("whole"), text.display_confidence(F.col("s_acctbal") / 5000).alias("shown"), views.percent_done(k % 2, k % 3).alias("done"), views.is_complete("given", "n_name").alias("complete"))


@query(
    """WITH r AS (SELECT o_orderkey, o_custkey, (o_orderkey % 9)::INT AS page_number, (o_orderkey % 100)::DOUBLE + 0.5 AS confidence FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))
    SELECT o_custkey AS document_id, max(page_number) AS pages, round(avg(confidence), 2) AS mean_confidence, 'completado' AS status FROM r GROUP BY o_custkey"""
)
def completed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Records whose document is stored and that are not deleted, and their documents' completion."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 9).cast("int").alias("page_number"), ((F.col("o_orderkey") % 100).cast("double") + 0.5).alias("confidence"))
    stored = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return views.completion(views.deleted(views.of_stored(o, stored), gone, "id"))


@query("SELECT s_suppkey, upper('new name') AS given_names, s_name AS surnames, 'surnames,given_names' AS reviewed FROM supplier")
def record_updates(spark: SparkSession, d: str) -> DataFrame:
    """An edit of one reviewed field, in upper case; an empty change leaves its field."""
    r = table(spark, d, "supplier").select("s_suppkey", F.lit("old").alias("given_names"), F.col("s_name").alias("surnames"), F.array(F.lit("surnames")).alias("reviewed_fields"))
    return views.updated(r, {"given_names": "new name", "surnames": None}).select("s_suppkey", "given_names", "surnames", F.array_join("reviewed_fields", ",").alias("reviewed"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0 AND lower(c_name) = lower('CUSTOMER#000000007')")
def active_user(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_name").alias("email"), (F.col("c_acctbal") > 0).alias("active"))
    return views.active_user(users, "CUSTOMER#000000007").select("c_custkey", "c_mktsegment")


@query("SELECT c_mktsegment AS sheet, c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def workbook_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Customers as workbooks of a sheet a segment, read again from their cells."""
    path = shared_path(spark, "workbooks") + "/customers"
    workbook.write_workbooks(table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_name", "c_nationkey", "c_acctbal"), path, kind="c_mktsegment", workbooks=8)
    types = ("bigint", "string", "int", "double")
    cells = [F.get("cells", F.lit(i)).cast(t).alias(c) for i, (c, t) in enumerate(zip(("c_custkey", "c_name", "c_nationkey", "c_acctbal"), types, strict=True))]
    return workbook.workbook_rows(spark, path).where("row > 1").select("sheet", *cells)


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%d wid_et%' OR p_type ILIKE '%d wid_et%' UNION ALL SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%ALL%GIZ_O%' OR p_type ILIKE '%ALL%GIZ_O%'")
def search_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """Parts by two patterns, through an index of the trigrams of their names and types."""
    parts, columns = table(spark, d, "part"), ["p_name", "p_type"]
    path = shared_path(spark, "trigrams") + "/parts"
    trigrams.write_index(parts, "p_partkey", columns, path)
    found = [trigrams.search(parts, "p_partkey", columns, path, q).select("p_partkey", "p_name", "p_type") for q in ("d wid_et", "ALL%GIZ_O")]
    return found[0].unionByName(found[1])
