"""The registered queries of this subpackage, with production parameters, and the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import ann_search, bpe_codec, chat_format, fill_middle, hard_negatives, katz_lm, language_id, line_dedup, mixing, ngram_join, quality_rules, token_counts, warc_revisits
from cartulary.llm.common import read

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_json(path: str | None = None) -> str:
    """The contents of a tokenizer file; by default the public 50k byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


def language_pieces(path: str | None = None) -> list[str]:
    """The letter pieces of a sentencepiece vocabulary; by default the public 32k one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(PIECES)
    return language_id.pieces_of(path)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(read(spark, sf_dir, "conversations"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_json(), limit=512)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_codec.round_trip(read(spark, sf_dir, "documents"), tokenizer_json())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_revisits.resolve(warc_revisits.captures(read(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return out.withColumn("headers", F.when(F.col("headers").isNotNull(), F.array_join(lines, "; ")))


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search.search(read(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_lm_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_lm.score(read(spark, sf_dir, "documents"), folds=10, min_count=1)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.identify(read(spark, sf_dir, "documents"), language_pieces(), folds=5)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(read(spark, sf_dir, "documents"))
    rows = plan.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("copies_in").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    # labels of some rows are moved by one, so that near rows of other labels exist
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), every=100, positives=5, negatives=5, low=80, scale=256.0)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_lines(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transform(read(spark, sf_dir, "documents"))
    back = fill_middle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_ann_search": op7_ann_search,
    "op8_lm_katz": op8_lm_katz,
    "op9_language_id": op9_language_id,
    "op10_mixing": op10_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_line_dedup": op12_line_dedup,
    "op13_fill_middle": op13_fill_middle,
}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: All pairs that share a gram; components by reachability.
OP1 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, least(len(ws) + 1, 2)))) AS i)),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
  edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
  reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN edges ON r = x),
  c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""

#: Null texts count as empty; rows are told apart by a number of their own.
OP4 = rf"""WITH d AS (SELECT *, row_number() OVER () AS r, md5(([text, lang, source])::VARCHAR) AS k, {WORDS_SQL} AS ws FROM documents),
  win AS (SELECT r, p, hash(array_to_string(ws[p:p + 7], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 6)) AS p)),
  twice AS (SELECT r, p FROM win QUALIFY count(*) OVER (PARTITION BY r, h) > 1),
  covered AS (SELECT r, count(DISTINCT p + o) AS n FROM twice, range(0, 8) x(o) GROUP BY r),
  lines AS (SELECT r, k, doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM d),
  norm AS (SELECT r, k, doc_id, source, trim(regexp_replace(lower(raw), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM lines),
  frequent AS (SELECT source, line, min(doc_id) AS first FROM norm WHERE line <> '' GROUP BY ALL HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'x' || k)) > 50),
  gone AS (SELECT r, sum(len(string_split(n.line, ' '))) AS n FROM norm n JOIN frequent f ON n.line = f.line AND n.source IS NOT DISTINCT FROM f.source AND (n.doc_id IS NULL OR n.doc_id IS DISTINCT FROM f.first) GROUP BY r),
  dup AS (SELECT r, count(*) - count(DISTINCT raw) AS n FROM lines WHERE regexp_matches(raw, '[^\x20\x09-\x0D]') GROUP BY r),
  base AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
    FROM d LEFT JOIN covered USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
  f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < 20 OR n_words - removed_words < 0.3 * n_words)) AS kept FROM f"""

OP2 = """WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l, count(*) AS n_turns FROM t GROUP BY conv_id),
  p AS (SELECT DISTINCT md5(l[1:k]::VARCHAR) AS h, k FROM c, LATERAL (SELECT unnest(range(1, n_turns)) AS k)),
  o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY md5(l::VARCHAR), n_turns ORDER BY conv_id) = 1)
SELECT conv_id, n_turns, array_to_string(list_transform(l, lambda x: '<|' || coalesce(x.r, '') || '|>' || chr(10) || coalesce(x.t, '') || chr(10)), '') AS text
FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.h = md5(o.l::VARCHAR) AND p.k = o.n_turns)"""

OP6 = r"""WITH u AS (SELECT *, regexp_replace(url, '#.*$', '') AS bare FROM pages),
  k AS (SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^:/?]+://([^/?]*)', 1)), '^([^@]*@)?(www[.])?', ''), ':(80|443)$', '') AS host,
    regexp_extract(bare, '^[^:/?]+://[^/?]*([^?]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))) AS q FROM u),
  c AS (SELECT page_id, '"' || md5(html) || '"' AS tag, sha1(html) AS digest, octet_length(encode(html)) AS n, 1700000000 + page_id * 60 AS made, 1700000000 + page_id * 60 + (page_id * 7919) % 10007 * 60 + 30 AS later,
    host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key FROM k),
  j AS (SELECT r.page_id, r.key, r.later, r.made AS own, r.tag AS sent, p.page_id AS found, p.tag, p.made, p.digest, p.n FROM c r LEFT JOIN c p ON r.key = p.key AND p.made < r.later
    QUALIFY row_number() OVER (PARTITION BY r.page_id ORDER BY p.made DESC NULLS LAST, 'p' || p.page_id::VARCHAR DESC) = 1),
  v AS (SELECT *, CASE WHEN found IS NULL THEN 'no_response' WHEN page_id % 4 IN (0, 1) THEN CASE WHEN sent = tag THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN page_id % 4 = 2 THEN CASE WHEN own = made THEN 'resolved' ELSE 'validator_mismatch' END ELSE 'validator_mismatch' END AS verdict FROM j)
SELECT 'r' || page_id::VARCHAR AS record_id, key AS canonical_url, later AS captured, verdict, CASE WHEN verdict = 'resolved' THEN 'p' || found::VARCHAR END AS refers_to, CASE WHEN verdict = 'resolved' THEN digest END AS payload_digest,
  CASE WHEN verdict = 'resolved' THEN 'cache-control: max-age=120; content-length: ' || n::VARCHAR || '; content-type: text/html; date: ' || later::VARCHAR || '; etag: ' || tag || '; last-modified: ' || made::VARCHAR END AS headers FROM v"""

#: Every anchor against every row.
OP11 = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

OP12 = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, md5(([text, lang, source])::VARCHAR) AS own FROM documents),
  l AS (SELECT r, coalesce(doc_id::VARCHAR, 'x' || own) AS doc, unnest(ls) AS line, unnest(range(len(ls))) AS at_ FROM d),
  k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc) >= 10),
  c AS (SELECT r, count(*) FILTER (f.key IS NOT NULL) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY at_) FILTER (f.key IS NULL), '') AS kept FROM k LEFT JOIN f ON k.key = f.key GROUP BY r)
SELECT doc_id, len(ls) AS n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN c USING (r)"""

OP13 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
  h AS (SELECT *, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
  f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
  p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

ORACLE: dict[str, str] = {"op1_ngram_jaccard_join": OP1, "op2_chat_formatting": OP2, "op4_quality_rules": OP4, "op6_warc_revisits": OP6, "op11_hard_negatives": OP11, "op12_line_dedup": OP12, "op13_fill_middle": OP13}
