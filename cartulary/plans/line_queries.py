"""Small rules of texts and of lines near a keyword, over texts derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import dates, places, text
from cartulary.operators import classify, lines, merge, views
from cartulary.plans.page_queries import MONTH_NAMES, ORDER_SQL, ORDERS, SEX_SQL, _indexed
from cartulary.plans.registry import query, table

COMPACT_SQL = r"try_strptime(regexp_extract({x}, '^([0-9]{{1,2}})\s*([A-Z]{{3}})[A-Z]*\s*([0-9]{{4}})', 1) || '/' || list_position({months}, regexp_extract({x}, '^([0-9]{{1,2}})\s*([A-Z]{{3}})[A-Z]*\s*([0-9]{{4}})', 2)) || '/' || regexp_extract({x}, '^([0-9]{{1,2}})\s*([A-Z]{{3}})[A-Z]*\s*([0-9]{{4}})', 3), '%d/%m/%Y')::DATE"


def _compact_sql(x: str) -> str:
    return COMPACT_SQL.format(x=f"upper(trim(translate({x}, '.,', '')))", months=list(MONTH_NAMES))


SAID_SQL = f"{list(MONTH_NAMES)}[month(o_orderdate)]"


@query(
    rf"""WITH r AS (SELECT o_orderkey, day(o_orderdate)::VARCHAR AS dd, {SAID_SQL} AS mon, year(o_orderdate)::VARCHAR AS yy, o_orderpriority AS pr, o_orderkey % 5 AS k FROM orders),
    t AS (SELECT *, CASE k WHEN 0 THEN dd || ' ' || mon || '. ' || yy || ' x' WHEN 1 THEN ' ' || dd || lower(mon) || 'x' || yy WHEN 2 THEN '31 ' || mon || ' ' || yy WHEN 3 THEN 'on ' || dd || mon || yy END AS short_,
      CASE k WHEN 0 THEN lpad(dd, 2, '0') || '-???-' || yy WHEN 1 THEN dd || '-MAY-' || yy ELSE '9-**' || '*-' || yy END AS torn, 'Issued ' || dd || ' ' || mon || ': San Telmo, ' || CASE WHEN k < 3 THEN 'El Alto 7' ELSE 'Norte-Sur' END AS where_,
      CASE k WHEN 0 THEN 'SURNAMESROE' WHEN 1 THEN 'Number12  x' WHEN 2 THEN 'SEXF' || chr(10) || chr(10) || 'end' ELSE ' names ' END AS glued FROM r)
    SELECT o_orderkey, {_compact_sql("short_")} AS compact, CASE WHEN regexp_matches(torn, '^[0-9]{{1,2}}-[^0-9A-Z]{{3}}-[0-9]{{4}}$') THEN try_strptime(string_split(torn, '-')[1] || '/01/' || string_split(torn, '-')[3], '%d/%m/%Y')::DATE END AS rescued,
      trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(where_), '[0-9]', ' ', 'g'), '\b({"|".join([*text.PLACE_STOP_WORDS, *MONTH_NAMES])})\b', ' ', 'g'), '\b(EL ALTO)\b', ' ', 'g'), '[^A-ZÁÉÍÓÚÜÑ\s]', ' ', 'g'), '\s+', ' ', 'g')) AS place,
      trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(glued), '\b(SURNAMES)([A-Z0-9])', '\1 \2', 'g'), '\b(NUMBER)([A-Z0-9])', '\1 \2', 'g'), '\b(SEX)([A-Z0-9])', '\1 \2', 'g'), '[ \t]+', ' ', 'g'), '\n{{2,}}', chr(10), 'g'), ' ') AS tidy,
      CASE WHEN regexp_matches(upper(pr), 'URGENT|LOW') THEN 'TYPE_B' WHEN regexp_matches(upper(pr), 'HIGH') THEN 'TYPE_A' ELSE 'UNKNOWN' END AS kind,
      CASE WHEN upper(trim(coalesce(short_, ''))) = 'NAN' THEN '' ELSE upper(trim(coalesce(short_, ''))) END AS cell,
      CASE WHEN o_orderkey * 512 >= 1048576 THEN format('{{:,.1f}} MB', (o_orderkey // 2048)::DOUBLE) ELSE format('{{:,.1f}} KB', o_orderkey * 512 / 1024.0::DOUBLE) END AS size FROM t"""
)
def text_rules(spark: SparkSession, d: str) -> DataFrame:
    """Dates at the start of a text, months that can't be read, raw places, tidied pages, types, cells and sizes."""
    k, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    mon = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(day))
    dd, yy = F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    join = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    short = F.when(k == 0, join(dd, " ", mon, ". ", yy, " x")).when(k == 1, join(" ", dd, F.lower(mon), "x", yy)).when(k == 2, join("31 ", mon, " ", yy)).when(k == 3, join("on ", dd, mon, yy))
    torn = F.when(k == 0, join(F.lpad(dd, 2, "0"), "-???-", yy)).when(k == 1, join(dd, "-MAY-", yy)).otherwise(join("9-***-", yy))
    where = join("Issued ", dd, " ", mon, ": San Telmo, ", F.when(k < 3, "El Alto 7").otherwise("Norte-Sur"))
    glued = F.when(k == 0, "SURNAMESROE").when(k == 1, "Number12  x").when(k == 2, "SEXF\n\nend").otherwise(" names ")
    n = F.col("o_orderkey") * 512
    size = text.byte_size(F.when(n >= 1 << 20, F.floor(F.col("o_orderkey") / 2048) * (1 << 20)).otherwise(n))
    return table(spark, d, "orders").select(
        "o_orderkey", dates.compact_date(short).alias("compact"), dates.rescued_month(torn).alias("rescued"), places.raw_place(where, ["El Alto"]).alias("place"), text.tidy_text(glued).alias("tidy"),
        classify.simple_type(F.col("o_orderpriority"), ["URGENT", "LOW"], ["HIGH"]).alias("kind"), text.sheet_text(short).alias("cell"), size.alias("size"),
    )


@query(
    """WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN n_name ELSE s_name END AS given, s_name AS surnames, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'OTHER' END AS og, CASE WHEN s_suppkey % 5 = 0 THEN 'THIRD' ELSE s_name END AS os, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey)
    SELECT s_suppkey, CASE WHEN given = surnames AND og <> surnames THEN og ELSE given END AS given_names, CASE WHEN given = surnames AND og = surnames AND os <> given THEN os ELSE surnames END AS surnames, given || ' ' || surnames AS before_,
      (CASE WHEN s_suppkey % 2 = 0 THEN 70.0 ELSE (s_suppkey % 50)::DOUBLE END + CASE WHEN s_suppkey % 3 = 0 THEN 70.0 ELSE (s_suppkey % 90)::DOUBLE END) / 2 AS confidence, (SELECT count(*) FROM supplier) AS exported FROM s"""
)
def record_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Names that were read twice over, the mean confidence of two sides, and the size of the export."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    given = F.when(k % 4 != 0, F.col("n_name")).otherwise(F.col("s_name"))
    fixed = merge.repaired_names(given, F.col("s_name"), F.when(k % 3 == 0, F.col("s_name")).otherwise("OTHER"), F.when(k % 5 == 0, "THIRD").otherwise(F.col("s_name")))
    confidence = merge.mean_side_confidence(F.when(k % 2 != 0, (k % 50).cast("double")), F.when(k % 3 != 0, (k % 90).cast("double")))
    total = views.export_summary(s).select(F.col("rows").alias("exported"))
    out = s.select("s_suppkey", fixed.alias("f"), confidence.alias("confidence")).join(total, F.lit(True))
    return out.select("s_suppkey", "f.given_names", "f.surnames", F.col("f.before").alias("before_"), "confidence", "exported")


#: What stands on the lines of these pages.
SAYINGS = ("SURNAMES", "GIVEN NAMES", "SEX", "SEX: F", "M", "DATE OF BIRTH", "ISSUED", "DATED", "SLASHES", "COMPACT", "FEM", "GIVEN NAMES ANA LUZ")
KINDS = 22

LINES_SQL = rf"""raw AS (SELECT l_orderkey // {ORDERS} AS d, (row_number() OVER (PARTITION BY l_orderkey // {ORDERS} ORDER BY {ORDER_SQL}) - 1)::INT AS i, (l_partkey * 13 + l_suppkey * 5) % {KINDS} AS kind, upper(p_name) AS name, lpad(day(l_shipdate)::VARCHAR, 2, '0') AS dd, month(l_shipdate) AS mm, year(l_shipdate)::VARCHAR AS yy FROM lineitem JOIN part ON p_partkey = l_partkey),
  t AS (SELECT d, i, CASE kind {" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SAYINGS) if s not in ("DATED", "SLASHES", "COMPACT"))} WHEN 7 THEN dd || '-' || {list(MONTH_NAMES)}[mm] || '-' || yy || ' RIVERA' WHEN 8 THEN dd || '/' || lpad(mm::VARCHAR, 2, '0') || '/' || yy WHEN 9 THEN dd || ' ' || {list(MONTH_NAMES)}[mm] || ' ' || yy ELSE name END AS s FROM raw),
  g AS (SELECT d, list(s ORDER BY i) AS ls FROM t GROUP BY d)"""


def _named_day_sql(x: str) -> str:
    part = f"regexp_extract({x}, '^([0-9]{{2}})[- ]([A-Z]{{3}})[- ]([0-9]{{4}})', ['d', 'm', 'y'])"
    return f"coalesce(try_strptime(regexp_extract({x}, '^([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})$', 1), '%d/%m/%Y')::DATE, try_strptime({part}.d || '/' || list_position({list(MONTH_NAMES)}, {part}.m) || '/' || {part}.y, '%d/%m/%Y')::DATE)"


def _first_sql(values: str) -> str:
    return f"list_filter({values}, lambda v: v IS NOT NULL)[1]"


def _person_sql(x: str) -> str:
    """person_name() of the lines on these pages; a dated line is read by its letters, of which months and places stay."""
    letters = f"trim(regexp_replace(regexp_replace({x}, '[^A-Z\\s\\-]', '', 'g'), '\\s+', ' ', 'g'))"
    words = f"list_filter(string_split({letters}, ' '), lambda w: length(w) > 1 AND NOT regexp_matches(w, '^({'|'.join(text.NAME_STOP_WORDS)})([^A-Z0-9_]|$)'))[1:5]"
    return f"CASE WHEN length(array_to_string({words}, ' ')) >= 3 AND array_to_string({words}, ' ') NOT IN ({', '.join(repr(p) for p in text.PARTICLES)}) THEN array_to_string({words}, ' ') END"


_AT = r"list_position(list_transform(ls, lambda q: regexp_matches(upper(q), '{p}')), true)"


@query(
    rf"""WITH {LINES_SQL}, a AS (SELECT *, {_AT.format(p="BIRTH")} AS b, {_AT.format(p="ISSUED")} AS u, {_AT.format(p=chr(92) + "bISSUED" + chr(92) + "b")} AS w, {_AT.format(p=chr(92) + "bSEX" + chr(92) + "b")} AS sx, {_AT.format(p="^" + chr(92) + "s*SURNAMES" + chr(92) + "s*$")} AS sl FROM g),
    p AS (SELECT *, list_transform(ls, lambda q: CASE WHEN regexp_matches(q, '^[0-9]{{2}}-[A-Z]{{3}}-[0-9]{{4}} RIVERA$') THEN {_named_day_sql("q")} END) AS pd FROM a)
    SELECT d AS document_id, coalesce(CASE WHEN b > 0 THEN {_first_sql(f"list_transform(ls[b:b + 2], lambda q: {_named_day_sql('q')})")} END, CASE WHEN u > 0 THEN {_first_sql(f"list_transform(ls[u:u + 2], lambda q: {_named_day_sql('q')})")} END) AS near_date,
      CASE WHEN w > 0 THEN {_first_sql(f"list_transform(ls[w + 1:w + 2], lambda q: {_compact_sql('q')})")} END AS after_date,
      CASE WHEN sx > 0 THEN coalesce({SEX_SQL.format(x="regexp_extract(ls[sx], 'SEX[ :]*(M|F|MASC|FEM)" + chr(92) + "b', 1)")}, {_first_sql(f"list_transform(CASE WHEN sx > 1 THEN ls[sx - 1:sx - 1] ELSE [] END || ls[sx + 1:sx + 3], lambda q: {SEX_SQL.format(x='q')})")}) END AS sex,
      coalesce(CASE WHEN w > 0 THEN {_first_sql("pd[greatest(w - 2, 1):w + 3]")} END, {_first_sql("pd")})::DATE AS pair_date, CASE WHEN {_first_sql("pd")} IS NOT NULL THEN 'RIVERA' END AS pair_place,
      CASE WHEN sl > 1 THEN {_person_sql("ls[sl - 1]")} END AS before_label,
      CASE WHEN list_contains(ls, 'GIVEN NAMES ANA LUZ') THEN 'ANA LUZ' END AS after_label FROM p"""
)
def keyword_lines(spark: SparkSession, d: str) -> DataFrame:
    """Dates, sexes, places and names that stand near a keyword on a page's lines."""
    rows = _indexed(spark, d)
    kind, day = (F.col("l_partkey") * 13 + F.col("l_suppkey") * 5) % KINDS, F.col("l_shipdate")
    mon, dd, yy = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(day)), F.date_format(day, "dd"), F.date_format(day, "yyyy")
    made = {"DATED": F.concat(F.concat_ws("-", dd, mon, yy), F.lit(" RIVERA")), "SLASHES": F.date_format(day, "dd/MM/yyyy"), "COMPACT": F.concat_ws(" ", dd, mon, yy)}
    said = F.when(F.lit(False), "")
    for i, s in enumerate(SAYINGS):
        said = said.when(kind == i, made[s] if s in made else F.lit(s))
    page = rows.select("document_id", "line_index", said.otherwise(F.upper("p_name")).alias("s")).groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "s"))), lambda x: x["s"]).alias("ls"))
    ls = F.col("ls")
    pair = F.transform(F.array(lines.date_and_place(ls, "ISSUED")), lambda x: x)[0]
    whole = F.get(F.filter(F.transform(ls, lambda x: lines.words_after_label(x, "GIVEN NAMES")), lambda v: v.isNotNull()), 0)
    return page.select(
        "document_id", dates.date_near(ls, ["BIRTH", "ISSUED"]).alias("near_date"), lines.compact_date_after(ls, "ISSUED").alias("after_date"), lines.sex_near(ls).alias("sex"), pair["date"].alias("pair_date"),
        pair["place"].alias("pair_place"), lines.line_before_label(ls, "SURNAMES").alias("before_label"), whole.alias("after_label"),
    )
