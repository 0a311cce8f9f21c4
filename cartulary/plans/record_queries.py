"""Reconciliation, merging, views and listings, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions.ids import is_sheet_id, request_id, valid_id
from cartulary.operators import merge, reconcile, scoring, views
from cartulary.plans.registry import query, table
from cartulary.session import shared_path
from cartulary.sources.tabular import rename_headers

FIELDS = ("name", "segment", "nation", "balance")

STORE_SQL = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation, c_acctbal::DECIMAL(15,2)::VARCHAR AS balance FROM customer"
CHANGED_SQL = """CASE WHEN c_custkey % 5 = 0 THEN '  ' || lower(c_name) || ' x' ELSE c_name END AS name,
  CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) || '  ' ELSE c_mktsegment END AS segment,
  c_nationkey::VARCHAR AS nation, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal::DECIMAL(15,2)::VARCHAR END AS balance"""
EXT_SQL = f"""SELECT c_custkey AS id, {CHANGED_SQL} FROM customer WHERE c_custkey % 7 <> 0
  UNION ALL SELECT c_custkey + 10000000, {CHANGED_SQL} FROM customer WHERE c_custkey % 11 = 0"""


def key_sql(x: str) -> str:
    """comparison_key() in SQL; DuckDB's capital of ß is another letter."""
    upper = f"replace(upper(trim(coalesce({x}, ''))), 'ẞ', 'SS')"
    return f"CASE WHEN {upper} IN ('NAN','NONE','NULL') THEN '' ELSE trim(regexp_replace(translate({upper}, 'ÁÉÍÓÚÜ', 'AEIOUU'), '\\s+', ' ', 'g')) END"


PAIRS_SQL = f"store AS ({STORE_SQL}), ext AS ({EXT_SQL})"
TEXT_SQL = {s: "concat_ws('|', " + ", ".join(f"coalesce({s}.{f}, '')" for f in FIELDS) + ")" for s in "se"}
DIFF_SQL = f"""WITH {PAIRS_SQL}, diffs AS (
  SELECT e.id, 'registro_completo' AS field, NULL::VARCHAR AS store_value, {TEXT_SQL["e"]} AS external_value, 'faltante_bd' AS diff_kind
    FROM ext e WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.id = e.id)
  UNION ALL SELECT s.id, 'registro_completo', {TEXT_SQL["s"]}, NULL, 'nuevo_bd' FROM store s WHERE NOT EXISTS (SELECT 1 FROM ext e WHERE e.id = s.id)
  {" ".join(f"UNION ALL SELECT s.id, '{f}', nullif(s.{f}, ''), nullif(e.{f}, ''), 'diferente' FROM store s JOIN ext e ON s.id = e.id WHERE {key_sql('s.' + f)} <> {key_sql('e.' + f)}" for f in FIELDS)})"""
SAME_SQL = " AND ".join(f"{key_sql('s.' + f)} = {key_sql('e.' + f)}" for f in FIELDS)


def store(spark: SparkSession, d: str) -> DataFrame:
    balance = F.col("c_acctbal").cast("decimal(15,2)").cast("string")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), balance.alias("balance"))


def external(spark: SparkSession, d: str) -> DataFrame:
    """An external sheet made from customers: some missing, some new, some changed."""
    rows = store(spark, d)
    fifth = F.col("id") % 5 == 0
    changed = rows.select(
        "id",
        F.when(fifth, F.concat(F.lit("  "), F.lower("name"), F.lit(" x"))).otherwise(F.col("name")).alias("name"),
        F.when(fifth, F.concat(F.lower("segment"), F.lit("  "))).otherwise(F.col("segment")).alias("segment"),
        "nation",
        F.when(F.col("id") % 10 != 0, F.col("balance")).alias("balance"),
    )
    return changed.where("id % 7 <> 0").union(changed.where("id % 11 = 0").withColumn("id", F.col("id") + 10_000_000))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.matched(store(spark, d), external(spark, d), "id", FIELDS)


@query(f"{DIFF_SQL} SELECT * FROM diffs")
def reconcile_detail(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.differences(pairs(spark, d), "id", FIELDS)


COUNTS_SQL = f"""(SELECT count(*) FROM store) AS store_rows, (SELECT count(*) FROM ext) AS external_rows,
  (SELECT count(*) FROM store s JOIN ext e ON s.id = e.id WHERE {SAME_SQL}) AS equal,
  (SELECT count(*) FROM store s JOIN ext e ON s.id = e.id WHERE NOT ({SAME_SQL})) AS different,
  (SELECT count(*) FROM ext e WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.id = e.id)) AS missing_in_store,
  (SELECT count(*) FROM store s WHERE NOT EXISTS (SELECT 1 FROM ext e WHERE e.id = s.id)) AS new_in_store"""


@query(f"WITH {PAIRS_SQL} SELECT {COUNTS_SQL}")
def reconcile_summary(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.summary(pairs(spark, d))


@query(f"WITH {PAIRS_SQL} SELECT e.id FROM ext e WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.id = e.id)")
def reconcile_missing(spark: SparkSession, d: str) -> DataFrame:
    return external(spark, d).join(store(spark, d), "id", "left_anti").select("id")


@query(f"WITH {PAIRS_SQL} SELECT s.id FROM store s WHERE NOT EXISTS (SELECT 1 FROM ext e WHERE e.id = s.id)")
def reconcile_new(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).join(external(spark, d), "id", "left_anti").select("id")


@query(f"WITH {PAIRS_SQL} SELECT s.id FROM store s JOIN ext e ON s.id = e.id WHERE {SAME_SQL}")
def reconcile_equal(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).where(F.col("in_store") & F.col("in_external") & (F.size("differing") == 0)).select("id")


@query(f"WITH {PAIRS_SQL} SELECT 0 AS store_rows, (SELECT count(*) FROM ext) AS external_rows, 0 AS equal, 0 AS different, (SELECT count(*) FROM ext) AS missing_in_store, 0 AS new_in_store")
def reconcile_empty_store(spark: SparkSession, d: str) -> DataFrame:
    none, ext = store(spark, d).limit(0), external(spark, d)
    return reconcile.summary(reconcile.matched(none, ext, "id", FIELDS))


@query(f"{DIFF_SQL} SELECT * FROM diffs")
def reconcile_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """As reconcile_detail, with a second row of each external key that must not count."""
    ext = external(spark, d).withColumn("row", F.lit(1))
    again = ext.withColumns({"name": F.lit("SECOND"), "row": F.lit(2)})
    return reconcile.reconcile(store(spark, d), ext.union(again), "id", FIELDS, ordinal="row")


@query(f"{DIFF_SQL} SELECT * FROM diffs WHERE diff_kind = 'diferente' ORDER BY id, field LIMIT 100")
def reconcile_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """A listing's page: one kind, in a fixed order, 100 rows."""
    return reconcile_detail(spark, d).where("diff_kind = 'diferente'").orderBy("id", "field").limit(100)


@query(
    f"""{DIFF_SQL}, facts AS (SELECT c_custkey AS id, n_name AS group_id, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 50)::INT END AS front_page,
      CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 50 + 1)::INT END AS back_page, (c_custkey % 50)::INT AS page_number, (c_custkey % 100)::DOUBLE AS confidence, NULL::VARCHAR AS record_status, NULL::VARCHAR AS engine
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
    SELECT d.id::VARCHAR AS id_number, coalesce(group_id, 'DOC-001') AS group_id, coalesce(front_page::VARCHAR, page_number::VARCHAR, '1') AS front_page, coalesce(back_page::VARCHAR, '-') AS back_page,
      field, coalesce(store_value, '') AS store_value, coalesce(external_value, '') AS external_value, upper(diff_kind) AS diff_kind, coalesce(confidence, 0.0) AS confidence,
      coalesce(record_status, 'REVIEW_REQUIRED') AS record_status, coalesce(engine, 'google_document_ai') AS engine,
      CASE diff_kind WHEN 'faltante_bd' THEN 'missing in the store' WHEN 'nuevo_bd' THEN 'missing in the external table' ELSE 'values differ' END AS reason
    FROM diffs d LEFT JOIN facts f ON d.id = f.id"""
)
def reconcile_report(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    k = F.col("c_custkey")
    facts = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        k.alias("id"),
        F.col("n_name").alias("group_id"),
        F.when(k % 3 == 0, (k % 50).cast("int")).alias("front_page"),
        F.when(k % 4 == 0, (k % 50 + 1).cast("int")).alias("back_page"),
        (k % 50).cast("int").alias("page_number"),
        (k % 100).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("record_status"),
        F.lit(None).cast("string").alias("engine"),
    )
    # facts twice over, the second with other values: the first by its columns counts
    again = facts.withColumns({"confidence": F.col("confidence") + 1000, "group_id": F.concat(F.col("group_id"), F.lit("~"))})
    _, path = _written(spark, d)
    return reconcile.report(reconcile.written_differences(spark, path, "id", "bigint"), facts.union(again), "id")


def _written(spark: SparkSession, d: str) -> tuple[dict[str, int], str]:
    path = shared_path(spark, "differences")
    return reconcile.reconcile_to(store(spark, d), external(spark, d), "id", FIELDS, path, "c1"), path


@query(f"WITH {PAIRS_SQL} SELECT {COUNTS_SQL}")
def reconcile_observed(spark: SparkSession, d: str) -> DataFrame:
    """The counters that are observed while differences are written."""
    counts, _ = _written(spark, d)
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))


@query(f"{DIFF_SQL} SELECT id, field, store_value, external_value, 'c1' AS comparison_id FROM diffs WHERE diff_kind = 'nuevo_bd'")
def reconcile_kind_folder(spark: SparkSession, d: str) -> DataFrame:
    """One kind of written differences; the other folders aren't read."""
    _, path = _written(spark, d)
    return reconcile.written_differences(spark, path, "id", "bigint", "nuevo_bd").drop("diff_kind")


@query(f"WITH {PAIRS_SQL}, counts AS (SELECT {COUNTS_SQL}) UNPIVOT counts ON COLUMNS(*) INTO NAME metric VALUE value")
def store_metrics_long(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.metrics_long(reconcile_summary(spark, d))


@query("SELECT c_custkey::VARCHAR AS id_number, c_name AS given_names, c_mktsegment AS issue_place FROM customer")
def header_alias_rename(spark: SparkSession, d: str) -> DataFrame:
    messy = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias(" Cédula "), F.col("c_name").alias("Primer Nombre"), F.col("c_mktsegment").alias("CIUDAD"))
    return rename_headers(messy)


@query(
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' ' || (o_orderkey + 12000000)::VARCHAR WHEN 1 THEN '0' || o_orderkey::VARCHAR WHEN 2 THEN '12.345.' || (o_orderkey % 900 + 100)::VARCHAR ELSE 'N' || o_orderkey::VARCHAR END AS raw FROM orders),
    c AS (SELECT *, regexp_replace(trim(raw), '[ .,-]', '', 'g') AS strict, regexp_replace(raw, '[ .,]', '', 'g') AS loose FROM t)
    SELECT o_orderkey, CASE WHEN regexp_full_match(strict, '[1-9][0-9]{6,9}') THEN strict END AS valid_id, CASE WHEN regexp_full_match(loose, '[0-9]{6,10}') THEN loose END AS request_id, regexp_full_match(trim(raw), '[0-9]{6,12}') AS sheet_id FROM c"""
)
def id_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = k.cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" "), (k + 12_000_000).cast("string"))).when(k % 4 == 1, F.concat(F.lit("0"), text)).when(k % 4 == 2, F.concat(F.lit("12.345."), (k % 900 + 100).cast("string"))).otherwise(F.concat(F.lit("N"), text))
    return table(spark, d, "orders").select("o_orderkey", valid_id(raw).alias("valid_id"), request_id(raw).alias("request_id"), is_sheet_id(raw).alias("sheet_id"))


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey % 2 AS side, max(o_orderkey) AS k FROM orders GROUP BY ALL), v AS (SELECT o_custkey, side, o_orderpriority AS value, 0.5 + (o_orderkey % 5) / 10.0::DOUBLE AS confidence FROM o JOIN orders USING (o_custkey) WHERE o_orderkey = k),
    j AS (SELECT coalesce(f.o_custkey, b.o_custkey) AS o_custkey, f.value AS a, b.value AS b, f.confidence AS ca, b.confidence AS cb FROM (SELECT * FROM v WHERE side = 0) f FULL JOIN (SELECT * FROM v WHERE side = 1) b ON f.o_custkey = b.o_custkey)
    SELECT o_custkey, coalesce(a, b) AS value, round(CASE WHEN a = b THEN least(0.99, greatest(ca, cb) + 0.05) WHEN a IS NOT NULL AND b IS NOT NULL THEN 0.5 WHEN a IS NOT NULL THEN ca ELSE cb END, 4) AS confidence,
      CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN 'REVIEW_REQUIRED' ELSE 'VALID' END AS status FROM j"""
)
def field_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    side = F.col("o_orderkey") % 2
    best = o.groupBy("o_custkey", side.alias("side")).agg(F.max_by(F.struct(F.col("o_orderpriority").alias("value"), (0.5 + (F.col("o_orderkey") % 5) / 10.0).alias("confidence")), "o_orderkey").alias("field"))
    half = lambda s: best.where(F.col("side") == s).select("o_custkey", "field")
    merged = merge.merge_sides(half(0), half(1), "o_custkey", ["field"])
    return merged.select("o_custkey", "field.value", F.round("field.confidence", 4).alias("confidence"), "field.status")


@query(
    """SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'view') AS event_type, arg_max(props, (ts, event_id)) FILTER (props IS NOT NULL) AS props,
      arg_min({'value': value, 'event_id': event_id}, (value IS NULL, -value, ts, event_id)).value AS value, arg_min({'value': value, 'event_id': event_id}, (value IS NULL, -value, ts, event_id)).event_id AS best_event
    FROM events WHERE user_id IS NOT NULL GROUP BY user_id"""
)
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("user_id IS NOT NULL").withColumns({"event_type": F.expr("CASE WHEN event_type <> 'view' THEN event_type END"), "best_event": F.col("event_id")})
    return merge.upsert(e, "user_id", ["ts", "event_id"], ["event_type", "props"], "value", ["best_event"])


@query(
    """SELECT c_custkey, c_name, any_value(n_name) AS n_name, count(o_orderkey) AS orders, coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END), 0) AS open_orders
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name"""
)
def summary_view(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.col("c_nationkey").alias("user_id"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("email"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), (F.col("o_orderstatus") == "O").alias("requires_review"))
    out = views.document_summary(c, n, o)
    return out.select(F.col("id").alias("c_custkey"), "c_name", F.col("user_name").alias("n_name"), F.col("records").alias("orders"), F.col("in_review").alias("open_orders"))


def _as_store(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    status = F.when(F.col("o_orderstatus") == "F", "completado").when(F.col("o_orderstatus") == "O", "procesando").otherwise("error")
    documents = table(spark, d, "orders").select(status.alias("status"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("confidence"))
    records = table(spark, d, "customer").select((F.col("c_acctbal") < 0).alias("requires_review"))
    return documents, records, table(spark, d, "events")


STATS_SQL = """(SELECT count(*) FROM orders) AS documents, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS completed, (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) AS failed,
  (SELECT count(*) FROM customer) AS records, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS in_review, (SELECT count(*) FROM events) AS comparisons"""


@query(f"SELECT {STATS_SQL}, (SELECT round(coalesce(avg(o_totalprice), 0), 2) FROM orders WHERE o_orderstatus <> 'P') AS mean_confidence")
def dashboard_scalars(spark: SparkSession, d: str) -> DataFrame:
    return views.statistics(*_as_store(spark, d)).drop("in_process").withColumn("mean_confidence", F.round("mean_confidence", 2))


@query(f"SELECT {STATS_SQL}, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS in_process")
def dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.statistics(*_as_store(spark, d)).drop("mean_confidence")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 50 OFFSET 100")
def list_page(spark: SparkSession, d: str) -> DataFrame:
    return views.page(table(spark, d, "orders"), "o_orderdate", "o_orderkey", 100, 50).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE (c_name ILIKE '%00_1%' OR c_mktsegment ILIKE '%00_1%' OR c_custkey::VARCHAR ILIKE '%00_1%') AND c_acctbal > 0")
def search_ilike(spark: SparkSession, d: str) -> DataFrame:
    """Wildcards in the query count, as in the listing it stands for."""
    return views.search(table(spark, d, "customer"), "00_1", ["c_name", "c_mktsegment", "c_custkey"]).where("c_acctbal > 0").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(replace(c_name, '.', '')), 'customer#00000001') OR contains(lower(replace(c_mktsegment, '.', '')), 'customer#00000001')")
def search_loose(spark: SparkSession, d: str) -> DataFrame:
    return views.loose_search(table(spark, d, "customer"), "Customer #0000.0001", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name")


@query("SELECT * FROM orders WHERE o_orderkey::VARCHAR = '33' LIMIT 1")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return views.lookup(table(spark, d, "orders"), "o_orderkey", " 33 ")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O'")
def owner_scope(spark: SparkSession, d: str) -> DataFrame:
    mine = views.visible_to(table(spark, d, "orders"), "o_custkey", 7, is_admin=False)
    return views.equal_if_truthy(mine, {"o_orderstatus": "O", "o_orderpriority": ""}).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey AS \"Número\", strftime(o_orderdate, '%d/%m/%Y %H:%M') AS \"Fecha\", CASE WHEN o_orderstatus = 'O' THEN 'SÍ' ELSE 'NO' END AS \"Revisión\" FROM orders")
def export_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("review", F.col("o_orderstatus") == "O")
    return views.export(rows, {"o_orderkey": "Número", "o_orderdate": "Fecha", "review": "Revisión"}, flags=["review"], times=["o_orderdate"], newest="o_orderdate", then=["o_orderkey"])


RECORD_SQL = """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'SIN_ID_' || c_custkey::VARCHAR ELSE (c_custkey + 10000000)::VARCHAR END AS id_number,
  CASE c_custkey % 7 WHEN 0 THEN 'POR REVISAR' WHEN 1 THEN 'A' WHEN 2 THEN NULL ELSE c_name END AS given_names, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS surnames,
  CASE WHEN c_custkey % 2 = 0 THEN '1990-01-01' END AS birth_date, CASE WHEN c_custkey % 4 <> 0 THEN '2010-01-01' END AS issue_date, CASE WHEN c_custkey % 6 <> 0 THEN 'PLACE' END AS issue_place, CASE WHEN c_custkey % 8 <> 0 THEN 'F' END AS sex FROM customer"""
POINTS_SQL = """least(greatest(round(17.5 + CASE WHEN coalesce(id_number, '') <> '' THEN 25 ELSE 0 END + CASE WHEN coalesce(given_names, '') <> '' THEN 15 ELSE 0 END + CASE WHEN coalesce(surnames, '') <> '' THEN 15 ELSE 0 END
  + CASE WHEN birth_date IS NOT NULL THEN 6 ELSE 0 END + CASE WHEN issue_date IS NOT NULL THEN 6 ELSE 0 END + CASE WHEN issue_place IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN sex IS NOT NULL THEN 3 ELSE 0 END
  - CASE WHEN contains(coalesce(id_number, ''), 'SIN_ID') THEN 25 ELSE 0 END - CASE WHEN coalesce(given_names, '') IN ('', 'POR REVISAR') THEN 10 WHEN NOT contains(trim(given_names), ' ') AND length(given_names) < 3 THEN 5 ELSE 0 END
  - CASE WHEN coalesce(surnames, '') IN ('', 'POR REVISAR') THEN 10 WHEN NOT contains(trim(surnames), ' ') AND length(surnames) < 3 THEN 5 ELSE 0 END, 2), 0.0), 100.0)::DOUBLE"""


def records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda on, value: F.when(on, F.lit(value))
    return table(spark, d, "customer").select(
        "c_custkey",
        F.when(k % 5 == 0, None).when(k % 5 == 1, F.concat(F.lit("SIN_ID_"), k.cast("string"))).otherwise((k + 10_000_000).cast("string")).alias("id_number"),
        F.when(k % 7 == 0, "POR REVISAR").when(k % 7 == 1, "A").when(k % 7 == 2, None).otherwise(F.col("c_name")).alias("given_names"),
        F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("surnames"),
        text(k % 2 == 0, "1990-01-01").alias("birth_date"),
        text(k % 4 != 0, "2010-01-01").alias("issue_date"),
        text(k % 6 != 0, "PLACE").alias("issue_place"),
        text(k % 8 != 0, "F").alias("sex"),
    )


@query(f"WITH r AS ({RECORD_SQL}) SELECT c_custkey, {POINTS_SQL} AS confidence FROM r")
def extraction_confidence(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("c_custkey", scoring.extraction_confidence().alias("confidence"))


@query(
    f"""WITH r AS ({RECORD_SQL}), s AS (SELECT *, {POINTS_SQL} AS confidence, CASE WHEN c_custkey % 9 = 0 THEN 'tesseract_fallback' ELSE 'layout' END AS engine FROM r),
    v AS (SELECT *, confidence < 70 OR coalesce(trim(given_names), '') = '' OR coalesce(trim(surnames), '') = '' OR coalesce(trim(id_number), '') = '' OR issue_date IS NULL OR issue_place IS NULL OR contains(coalesce(id_number, ''), 'SIN_ID') AS review FROM s)
    SELECT c_custkey, review, CASE WHEN engine = 'tesseract_fallback' THEN 'FALLBACK_TESSERACT' WHEN review THEN 'REVIEW_REQUIRED' ELSE 'VALID' END AS status FROM v
    WHERE (coalesce(trim(id_number), '') <> '' AND NOT starts_with(id_number, 'SIN_ID')) OR (coalesce(trim(given_names), '') <> '' AND given_names <> 'POR REVISAR' AND coalesce(trim(surnames), '') <> '' AND surnames <> 'POR REVISAR')"""
)
def review_status(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).where(merge.is_record()).withColumn("confidence", scoring.extraction_confidence())
    engine = F.when(F.col("c_custkey") % 9 == 0, "tesseract_fallback").otherwise("layout")
    return r.withColumn("review", merge.needs_review()).select("c_custkey", "review", merge.record_status(engine, F.col("review")).alias("status"))


@query(
    f"""WITH r AS ({RECORD_SQL}), v AS (SELECT c_custkey, unnest(['given_names', 'surnames', 'id_number']) AS field, unnest([given_names, surnames, id_number]) AS value FROM r)
    SELECT *, CASE WHEN coalesce(value, '') <> '' THEN 'VALID' WHEN field IN ('id_number', 'given_names') THEN 'MISSING_DATA' ELSE 'REVIEW_REQUIRED' END AS status FROM v"""
)
def field_status(spark: SparkSession, d: str) -> DataFrame:
    return merge.field_status(records(spark, d), "c_custkey", ["given_names", "surnames", "id_number"], ["id_number", "given_names"])


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
