"""Whole pages read into records, over pages derived from order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cartulary.functions import places, text
from cartulary.operators import extract, lines, names, spatial
from cartulary.plans.registry import query, table
from cartulary.plans.store_queries import VALID_SQL

#: Orders whose lines make one page.
ORDERS = 3
ORDER_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"

NAME_LINES_SQL = f"""raw AS (SELECT l_orderkey // {ORDERS} AS d, (row_number() OVER (PARTITION BY l_orderkey // {ORDERS} ORDER BY {ORDER_SQL}) - 1)::INT AS line_index, l_partkey % 14 AS kind, upper(p_name) AS name, l_partkey, ((l_suppkey * 7 + l_linenumber) % 62) / 100.0::DOUBLE AS y
    FROM lineitem JOIN part ON p_partkey = l_partkey),
  l AS (SELECT d, line_index, y, CASE kind WHEN 0 THEN 'SURNAMES' WHEN 1 THEN 'Given names' WHEN 2 THEN 'Surname: ' || name WHEN 3 THEN 'GIVEN NAMES ' || name WHEN 4 THEN 'NUMBER' WHEN 5 THEN '12.' || (l_partkey % 900 + 100)::VARCHAR || '.678'
    WHEN 6 THEN 'NATIONAL REGISTER' WHEN 7 THEN 'de la ' || name WHEN 8 THEN name || ' 7' WHEN 9 THEN NULL ELSE name END AS text FROM raw)"""


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with their part, the page that they are on and their place in it.

    Parts are joined before lines are numbered, and the page is a column before the window: rows are dealt by page
    once, and what follows on pages needs no other shuffle. Lines without a part keep their numbers until they go.
    """
    part = table(spark, d, "part").select("p_partkey", "p_name")
    rows = table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("document_id", F.floor(F.col("l_orderkey") / ORDERS))
    order = W.Window.partitionBy("document_id").orderBy(*ORDER_SQL.split(", "))
    return rows.withColumn("line_index", F.row_number().over(order) - 1).where("p_partkey IS NOT NULL")


def _name_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of names, labels with and without a value, numbers and headings, in any order down the page."""
    name, kind = F.upper("p_name"), F.col("l_partkey") % 14
    said = (
        F.when(kind == 0, "SURNAMES").when(kind == 1, "Given names").when(kind == 2, F.concat(F.lit("Surname: "), name)).when(kind == 3, F.concat(F.lit("GIVEN NAMES "), name)).when(kind == 4, "NUMBER")
        .when(kind == 5, F.concat(F.lit("12."), (F.col("l_partkey") % 900 + 100).cast("string"), F.lit(".678"))).when(kind == 6, "NATIONAL REGISTER").when(kind == 7, F.concat(F.lit("de la "), name))
        .when(kind == 8, F.concat(name, F.lit(" 7"))).when(kind == 9, None).otherwise(name)
    )
    rows = _indexed(spark, d)
    return rows.select("document_id", F.lit(1).alias("page_number"), "line_index", said.alias("text"), (((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 62) / 100.0).alias("y"))


def clean_sql(x: str) -> str:
    """label_name() of a text without ! and |."""
    stop = ", ".join(f"'{w}'" for w in (*text.NAME_STOP_WORDS, *text.PARTICLES))
    words = f"list_filter(string_split(trim(regexp_replace(regexp_replace(upper(replace({x}, '1', 'I')), '[^{text.LETTERS}\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND w NOT IN ({stop}))"
    return f"CASE WHEN length(array_to_string({words}, ' ')) >= 3 THEN array_to_string({words}[1:5], ' ') END"


NAMES_SQL = rf"""p AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY y, line_index) - 1 AS pos, coalesce(text, '') AS t, upper(trim(coalesce(text, ''))) AS u FROM l WHERE y < 0.55),
  q AS (SELECT *, {clean_sql("t")} AS clean FROM p),
  g AS (SELECT d, list({{'pos': pos, 'clean': clean, 't': t, 'y': y}} ORDER BY pos) AS ls, min(pos) FILTER (regexp_matches(u, '{names.NUMBER_LABEL}') OR regexp_full_match(regexp_replace(u, '[^0-9]', '', 'g'), '[0-9]{{7,10}}')) AS num,
    min(pos) FILTER (regexp_matches(u, '{names.SURNAME_LABEL}')) AS sur, min(pos) FILTER (regexp_matches(u, '{names.GIVEN_LABEL}')) AS giv FROM q GROUP BY d),
  s AS (SELECT d, ls, sur < giv AS above, sur, giv, sur IS NOT NULL AND giv IS NOT NULL AS two, CASE WHEN num < sur THEN num + 1 ELSE greatest(0, sur - 3) END AS low,
    regexp_replace(ls[sur + 1].t, '(?i){names.SURNAME_LABEL}', '', 'g') AS own_s, regexp_replace(ls[giv + 1].t, '(?i){names.GIVEN_LABEL}', '', 'g') AS own_g,
    list_transform(list_filter(ls, lambda x: x.clean IS NOT NULL AND x.y > 0.10 AND x.y < 0.50 AND regexp_matches(x.clean, '[{text.LETTERS}]{{3,}}') AND NOT regexp_matches(x.clean, '{"|".join(names.HEADINGS)}') AND NOT regexp_matches(x.t, '[0-9]')), lambda x: x.clean) AS fit FROM g),
  k AS (SELECT d, CASE WHEN two THEN {clean_sql("own_s")} END AS inline_s, CASE WHEN two THEN {clean_sql("own_g")} END AS inline_g,
    CASE WHEN NOT two THEN NULL WHEN above THEN nullif(array_to_string(list_transform(list_filter(ls, lambda x: x.clean IS NOT NULL AND x.pos >= low AND x.pos < sur), lambda x: x.clean)[-2:], ' '), '') ELSE nullif(array_to_string(list_transform(list_filter(ls, lambda x: x.clean IS NOT NULL AND x.pos > sur AND x.pos <= sur + 2), lambda x: x.clean), ' '), '') END AS near_s,
    CASE WHEN NOT two THEN NULL WHEN above THEN nullif(array_to_string(list_transform(list_filter(ls, lambda x: x.clean IS NOT NULL AND x.pos > sur AND x.pos < giv), lambda x: x.clean)[-2:], ' '), '') ELSE nullif(array_to_string(list_transform(list_filter(ls, lambda x: x.clean IS NOT NULL AND x.pos > giv AND x.pos < sur), lambda x: x.clean), ' '), '') END AS near_g,
    fit[1] AS first_, list_filter(fit, lambda x: x <> fit[1])[1] AS second_ FROM s)"""


def _spread(field: str) -> list[Column]:
    return [F.col(f"{field}.value").alias(field), F.col(f"{field}.source").alias(f"{field}_source"), F.round(f"{field}.confidence", 4).alias(f"{field}_confidence")]


def _named_sql(name: str, of: str, clean: str) -> str:
    return f"""coalesce(inline_{of}, near_{of}, {clean}) AS {name}, CASE WHEN inline_{of} IS NOT NULL THEN 'on the label''s line' WHEN near_{of} IS NOT NULL THEN 'order of labels' WHEN {clean} IS NOT NULL THEN 'clean lines' END AS {name}_source,
      CASE WHEN inline_{of} IS NOT NULL OR near_{of} IS NOT NULL THEN 0.95 WHEN {clean} IS NOT NULL THEN 0.7125 END::DOUBLE AS {name}_confidence"""


@query(f"WITH {NAME_LINES_SQL}, {NAMES_SQL} SELECT d AS document_id, {_named_sql('surnames', 's', 'first_')}, {_named_sql('given_names', 'g', 'second_')} FROM k")
def page_names(spark: SparkSession, d: str) -> DataFrame:
    """Names by the order of their labels, on the label's own line, or the first clean lines."""
    return names.page_names(_name_lines(spark, d)).select("document_id", *_spread("surnames"), *_spread("given_names"))


@query(
    rf"""WITH {NAME_LINES_SQL}, {VALID_SQL}, w AS (SELECT *, lag(valid) OVER o AS before_, first(valid IGNORE NULLS) OVER (o ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS after_ FROM v WINDOW o AS (PARTITION BY d ORDER BY line_index))
    SELECT d AS document_id, list(coalesce(before_, after_) ORDER BY line_index)[1] AS value FROM w WHERE regexp_matches(upper(text), '\bSURNAMES\b') GROUP BY d"""
)
def label_names(spark: SparkSession, d: str) -> DataFrame:
    """The name before a page's first label, or the first one after it."""
    return lines.names_by_position(_name_lines(spark, d), "SURNAMES").select("document_id", "value")


#: What stands on the lines of a derived page, by turns; NAME, ID and DAY come from the order line.
PALETTE = (
    "SURNAMES", "GIVEN NAMES", "NUMBER ID", "DOTTED", "SLASHES", "NAMED", "M", "SEX F", "DATE OF BIRTH", "PLACE OF ISSUE", "RIVERA (ORIENTE)", "MACHINE", "ROE<<ANA<MARIA", "A-1-2-M-00ID-2",
    "24-???-2001", "1.65 O+ F", "FEM", "SAN TELMO", "GENDER", "ISSUED",
)
KINDS = 45
MONTH_NAMES = ("ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEP", "OCT", "NOV", "DIC")


def _kind_sql() -> str:
    number = "((10000000 + l_partkey)::VARCHAR)"
    day = "lpad(day(l_shipdate)::VARCHAR, 2, '0')"
    made = {
        "NUMBER ID": f"'NUMBER ' || {number}", "DOTTED": f"left({number}, 2) || '.' || {number}[3:5] || '.' || {number}[6:8]", "SLASHES": f"{day} || '/' || lpad(month(l_shipdate)::VARCHAR, 2, '0') || '/' || year(l_shipdate)::VARCHAR",
        "NAMED": f"{day} || '-' || {list(MONTH_NAMES)}[month(l_shipdate)] || '-' || year(l_shipdate)::VARCHAR", "MACHINE": f"'9005037F3001011XXX' || {number} || '<8'", "A-1-2-M-00ID-2": f"'A-1-2-M-00' || {number} || '-2'",
    }
    return "CASE kind " + " ".join(f"WHEN {i} THEN {made.get(k) or repr(k)}" for i, k in enumerate(PALETTE)) + " WHEN 20 THEN NULL ELSE name END"


def _kind(kind: Column) -> Column:
    number, day = (F.lit(10_000_000) + F.col("l_partkey")).cast("string"), F.col("l_shipdate")
    dd = F.date_format(day, "dd")
    made = {
        "NUMBER ID": F.concat(F.lit("NUMBER "), number), "DOTTED": F.concat_ws(".", F.substring(number, 1, 2), F.substring(number, 3, 3), F.substring(number, 6, 3)), "SLASHES": F.date_format(day, "dd/MM/yyyy"),
        "NAMED": F.concat_ws("-", dd, F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(day)), F.date_format(day, "yyyy")), "MACHINE": F.concat(F.lit("9005037F3001011XXX"), number, F.lit("<8")), "A-1-2-M-00ID-2": F.concat(F.lit("A-1-2-M-00"), number, F.lit("-2")),
    }
    out = F.when(kind == len(PALETTE), None)
    for i, k in enumerate(PALETTE):
        if k in made:
            out = out.when(kind == i, made[k])
    return out.otherwise(F.coalesce(F.get(F.array(*[F.lit(k) for k in PALETTE]), kind.cast("int")), F.upper("p_name")))


def _record_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of records with labels and values of all kinds, anywhere on the page."""
    kind = (F.col("l_partkey") * 31 + F.col("l_suppkey") * 7 + F.col("line_index")) % KINDS
    # by a generator, below which Spark moves no filter on a text: each text is made once
    rows = _indexed(spark, d).select("*", F.explode_outer(F.array(_kind(kind))).alias("text"))
    x, y = (F.col("l_suppkey") % 7) / 10.0, ((F.col("l_suppkey") * 7 + F.col("l_partkey")) % 97) / 100.0
    return rows.select("document_id", F.lit(1).alias("page_number"), "line_index", "text", F.lit(0.9).alias("confidence"), x.alias("x"), y.alias("y"), F.lit(0.2).alias("w"), F.lit(0.02).alias("h"))


def _day_sql(x: str) -> str:
    """parse_date() for the layouts on these pages, anywhere in a text."""
    slashes, named = r"^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})$", r"\b([0-9]{1,2}-(?:ENE|FEB|MAR|ABR|MAY|JUN|JUL|AGO|SEP|OCT|NOV|DIC)-[0-9]{4})\b"
    part = f"string_split(regexp_extract({x}, '{named}', 1), '-')"
    months = f"list_position({list(MONTH_NAMES)}, {part}[2])"
    return f"coalesce(try_strptime(regexp_extract({x}, '{slashes}', 1), '%d/%m/%Y')::DATE, try_strptime({part}[1] || '/' || {months} || '/' || {part}[3], '%d/%m/%Y')::DATE)"


def _id_sql(x: str) -> str:
    digits = f"regexp_replace(trim({x}), '[ .,-]', '', 'g')"
    return f"CASE WHEN regexp_full_match({digits}, '[1-9][0-9]{{6,9}}') THEN {digits} END"


SEX_SQL = "CASE WHEN {x} IN ('M','MASCULINO','HOMBRE','MALE','MASC') THEN 'M' WHEN {x} IN ('F','FEMENINO','MUJER','FEMALE','FEM') THEN 'F' END"


def _place_sql(x: str) -> str:
    pair = rf"([{places.LETTERS}\s]{{3,30}})\s*\(\s*[{places.LETTERS}\s]{{3,30}}\s*\)"
    named = f"CASE WHEN regexp_matches({x}, '{pair}') THEN trim(regexp_extract({x}, '{pair}', 1)) ELSE {x} END"
    blank = rf"regexp_replace({named}, '(?i)\b({'|'.join(text.PLACE_STOP_WORDS)})\b', ' ', 'g')"
    plain = rf"trim(regexp_replace(trim(regexp_replace(upper(regexp_replace({blank}, '[^{places.LETTERS}\s]', ' ', 'g')), '\s+', ' ', 'g')), '{places.PREFIXES}', ''))"
    return f"CASE WHEN len(list_filter(string_split({plain}, ' '), lambda w: length(w) >= 3)) > 0 AND {plain} NOT IN ({', '.join(repr(p) for p in places.NO_PLACE)}) THEN {plain} END"


def _labels_sql() -> str:
    """Of each field the first line with its label, and what follows the label there."""
    parts = []
    for f, patterns in spatial.LABELS.items():
        any_of, longest = "|".join(patterns), "|".join(sorted(patterns, key=len, reverse=True))
        hit = f"(regexp_matches(u, '{any_of}') OR regexp_matches(translate(u, '01', 'OI'), '{any_of}'))"
        parts.append(f"SELECT d, '{f}' AS field, line_index AS label_index, trim(regexp_replace(u, '^.*?({longest})[ :.]*', '')) AS rest, x AS lx, y AS ly, w AS lw, h AS lh FROM t WHERE {hit} QUALIFY row_number() OVER (PARTITION BY d ORDER BY line_index) = 1")
    return " UNION ALL ".join(parts)


_RELATION_SQL = """CASE WHEN NOT own AND (y < y_min - 0.005 OR y >= y_max OR x < x_min - 0.05) THEN NULL WHEN y < ly - 0.14 THEN NULL
    WHEN ly - y > 0 AND ly - y <= 0.14 AND off_ <= lw * 3.5 THEN greatest(0.80::DOUBLE, 1.00::DOUBLE - ((ly - y) / 0.14::DOUBLE) * 0.20::DOUBLE) * greatest(0.40::DOUBLE, 1.00::DOUBLE - (off_ / greatest(lw * 2.0::DOUBLE, 0.05::DOUBLE)) * 0.60::DOUBLE)
    WHEN y - ly > 0 AND y - ly <= 0.15 AND off_ <= lw * 3.5 THEN 0.90 WHEN abs(y - ly) <= lh * 1.8 AND x >= lx + lw * 0.1 THEN 1.00 WHEN abs((y + h / 2) - (ly + lh / 2)) <= lh * 1.5 THEN 0.85 WHEN y - ly > 0 AND y - ly <= 0.25 THEN 0.70 END::DOUBLE"""
_FIELDS = list(extract.RANKED)

EXTRACT_SQL = rf"""raw AS (SELECT *, l_orderkey // {ORDERS} AS d, (row_number() OVER (PARTITION BY l_orderkey // {ORDERS} ORDER BY {ORDER_SQL}) - 1)::INT AS line_index FROM lineitem),
  k AS (SELECT *, (l_partkey * 31 + l_suppkey * 7 + line_index) % {KINDS} AS kind, upper(p_name) AS name FROM raw JOIN part ON p_partkey = l_partkey),
  l AS (SELECT d, line_index, {_kind_sql()} AS text, ((l_suppkey % 7) / 10.0)::DOUBLE AS x, (((l_suppkey * 7 + l_partkey) % 97) / 100.0)::DOUBLE AS y, 0.2::DOUBLE AS w, 0.02::DOUBLE AS h FROM k),
  t AS (SELECT *, coalesce(text, '') AS s, upper(trim(coalesce(text, ''))) AS u FROM l),
  {NAMES_SQL.replace("k AS (", "nk AS (")},
  pg AS (SELECT d, string_agg(s, chr(10) ORDER BY line_index) AS joined, replace(upper(string_agg(s, chr(10) ORDER BY line_index)), ' ', '') AS m, list(u ORDER BY line_index) AS us,
    list({{'i': line_index, 'u': u, 'x': x, 'y': y, 's': s}} ORDER BY line_index) AS ls FROM t GROUP BY d),
  m AS (SELECT *, regexp_extract(m, '([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})[0-9]([MF])[0-9]{{6}}', ['yy', 'mm', 'dd', 'sex']) AS z, nullif(replace(regexp_extract(m, '([A-Z]+(?:<[A-Z]+)*)<<([A-Z]+(?:<[A-Z]+)*)', 1), '<', ' '), '') AS m_s,
    nullif(replace(regexp_extract(m, '([A-Z]+(?:<[A-Z]+)*)<<([A-Z]+(?:<[A-Z]+)*)', 2), '<', ' '), '') AS m_g, {_id_sql("regexp_extract(m, 'XXX([0-9]{7,10})', 1)")} AS m_id,
    {_id_sql("ltrim(regexp_extract(joined, '[A-Z]-[0-9]+-[0-9]+-([MF])-([0-9]+)-', 2), '0')")} AS f_id, nullif(regexp_extract(joined, '[A-Z]-[0-9]+-[0-9]+-([MF])-([0-9]+)-', 1), '') AS f_sex, list_position(list_transform(us, lambda q: regexp_matches(q, '\bSEX\b')), true) AS sx FROM pg),
  r AS (SELECT *, CASE WHEN z.yy <> '' THEN try_strptime((CASE WHEN try_cast(z.yy AS INT) <= 30 THEN '20' ELSE '19' END) || z.yy || '-' || z.mm || '-' || z.dd, '%Y-%m-%d')::DATE END AS m_birth,
    list_filter(list_transform(flatten(list_transform(list_filter(ls, lambda q: q.y < 0.35), lambda q: regexp_extract_all(q.u, '\b(\d{{1,3}}(?:\.\d{{3}}){{1,3}}|\d{{7,10}})\b', 1))), lambda q: {_id_sql("q")}), lambda q: q IS NOT NULL)[1] AS top,
    list_filter(list_transform(ls, lambda q: CASE WHEN q.u IN ('M', 'F') AND q.y > 0.20 AND q.x > 0.45 THEN q.u ELSE nullif(regexp_extract(q.u, '\b(?:1\.\d{{2}}|[ABO][+-])\s+([MF])\b', 1), '') END), lambda q: q IS NOT NULL)[-1] AS p_sex,
    list_filter(list_transform(list_filter(ls, lambda q: q.y > 0.28), lambda q: trim(regexp_extract(q.s, '([{places.LETTERS} ]{{3,30}}?)\s*\(\s*([{places.LETTERS} ]{{3,30}}?)\s*\)', 1))), lambda q: q <> '')[1] AS pair,
    {SEX_SQL.format(x="regexp_extract(us[sx], 'SEX[ :]*(M|F|MASC|FEM)\\b', 1)")} AS in_sex, list_filter(list_transform(CASE WHEN sx > 1 THEN us[sx - 1:sx - 1] ELSE [] END || us[sx + 1:sx + 3], lambda q: {SEX_SQL.format(x="q")}), lambda q: q IS NOT NULL)[1] AS by_sex FROM m),
  dd AS (SELECT d, list_sort(list(DISTINCT day)) AS days FROM (SELECT d, coalesce({_day_sql("u")}, try_strptime(CASE WHEN regexp_matches(u, '^[0-9]{{1,2}}-[^0-9A-Z]{{3}}-[0-9]{{4}}$') THEN left(u, 2) || '/01/' || right(u, 4) END, '%d/%m/%Y')::DATE) AS day FROM t) WHERE year(day) BETWEEN 1930 AND 2026 GROUP BY d),
  b AS (SELECT r.d, CASE WHEN m_s IS NOT NULL AND m_g IS NOT NULL THEN m_s ELSE coalesce(inline_s, m_s, near_s, first_) END AS surnames, CASE WHEN m_s IS NOT NULL AND m_g IS NOT NULL THEN m_g ELSE coalesce(inline_g, m_g, near_g, second_) END AS given_names,
    coalesce(m_id, top, f_id) AS id_number, CASE WHEN len(days) > 1 THEN days[1] ELSE coalesce(m_birth, days[1]) END::VARCHAR AS birth_date, CASE WHEN len(days) > 1 THEN days[len(days)] WHEN m_birth IS NOT NULL THEN days[1] END::VARCHAR AS issue_date,
    {_place_sql("pair")} AS issue_place, coalesce(p_sex, nullif(z.sex, ''), f_sex, in_sex, by_sex) AS sex FROM r LEFT JOIN nk ON nk.d = r.d LEFT JOIN dd ON dd.d = r.d),
  v AS (SELECT d, unnest({_FIELDS}) AS field, unnest([{", ".join(_FIELDS)}]) AS value FROM b),
  la AS ({_labels_sql()}),
  lp AS (SELECT *, max(ly) FILTER (field = 'given_names') OVER (PARTITION BY d) AS ny, max(ly) FILTER (field = 'surnames') OVER (PARTITION BY d) AS sy FROM la),
  lr AS (SELECT *, ny IS NOT NULL AND sy IS NOT NULL AS two, field IN ('surnames', 'given_names') AS is_name FROM lp),
  re AS (SELECT *, round(greatest(0, lx - 0.2), 4) AS x_min, round(greatest(0, CASE WHEN two AND sy < ny THEN CASE WHEN is_name THEN ly - 0.2 ELSE ly - 0.15 END WHEN two THEN CASE WHEN is_name THEN ly - 0.02 ELSE ly END WHEN is_name THEN ly - 0.2 ELSE ly - 0.15 END), 4) AS y_min,
    round(CASE WHEN two AND sy < ny AND is_name THEN ly + 0.04 WHEN two AND sy >= ny AND is_name THEN ly + 0.18 ELSE ly + 0.2 END, 4) AS y_max FROM lr),
  ca AS (SELECT re.*, false AS own, t.line_index AS i, s AS said, x, y, w, h FROM re JOIN t USING (d) WHERE NOT EXISTS (SELECT 1 FROM la WHERE la.d = re.d AND la.label_index = t.line_index) UNION ALL SELECT *, true, label_index, rest, lx + lw * 0.3, ly, lw, lh FROM re WHERE rest <> ''),
  ty AS (SELECT *, abs((x + w / 2) - (lx + lw / 2)) AS off_, CASE WHEN field = 'id_number' THEN {_id_sql("said")} WHEN field IN ('birth_date', 'issue_date') THEN (CASE WHEN year({_day_sql("upper(trim(said))")}) BETWEEN 1930 AND 2026 THEN {_day_sql("upper(trim(said))")} END)::VARCHAR
    WHEN field = 'sex' THEN {SEX_SQL.format(x="upper(trim(said))")} WHEN field = 'issue_place' THEN CASE WHEN NOT regexp_matches(said, '[0-9]') THEN {_place_sql("trim(said)")} END ELSE {clean_sql("said")} END AS val FROM ca),
  sc AS (SELECT d, field, i, val, {_RELATION_SQL} AS spatial FROM ty WHERE val IS NOT NULL),
  so AS (SELECT sc.*, list_position({_FIELDS}, field) AS p, 0.35::DOUBLE + 0.40::DOUBLE * spatial + 0.15::DOUBLE * 0.9::DOUBLE + 0.10::DOUBLE AS score FROM sc JOIN v USING (d, field) WHERE v.value IS NULL AND spatial IS NOT NULL),
  sn AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY p, -spatial, i) AS n FROM so),
  fold AS (SELECT DISTINCT d, 0::BIGINT AS n, []::INT[] AS served, []::INT[] AS used, NULL::VARCHAR AS field, NULL::VARCHAR AS val, NULL::DOUBLE AS score FROM sn
    UNION ALL SELECT f.d, sn.n, CASE WHEN list_contains(f.served, p) OR list_contains(f.used, i) THEN f.served ELSE list_append(f.served, p) END, CASE WHEN list_contains(f.served, p) OR list_contains(f.used, i) OR sn.score < 0.85 THEN f.used ELSE list_append(f.used, i) END,
      CASE WHEN list_contains(f.served, p) OR list_contains(f.used, i) OR sn.score < 0.85 THEN NULL ELSE sn.field END, sn.val, sn.score FROM fold f JOIN sn ON sn.d = f.d AND sn.n = f.n + 1)"""


@query(
    f"""WITH RECURSIVE {EXTRACT_SQL} SELECT v.d AS document_id, v.field, coalesce(v.value, fold.val) AS value, v.value IS NULL AND fold.val IS NOT NULL AS placed, CASE WHEN coalesce(v.value, fold.val) IS NULL THEN 'REVIEW_REQUIRED' ELSE 'VALID' END AS status
    FROM v LEFT JOIN fold ON fold.d = v.d AND fold.field = v.field"""
)
def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every field of every page: machine-readable lines, zones, names, dates, places, then values placed by their labels."""
    out = extract.extract_fields(_record_lines(spark, d))
    return out.select("document_id", "field", "value", F.coalesce(F.col("source") == "spatial", F.lit(False)).alias("placed"), "status")
