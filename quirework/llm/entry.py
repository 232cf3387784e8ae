"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import apportion, decontaminate, feistel_shards, hnsw, line_templates, main_text, ppm_langid, private_data
from quirework.llm import simhash_dedup, warc
from quirework.llm.common import table


def op1_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.personal_data(table(spark, sf_dir, "documents"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards.shard_documents(table(spark, sf_dir, "documents"))


def op5_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    # where a record lies depends on how the archives were split, so file and offset are left to the operator
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op7_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = apportion.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.withColumn("shards", F.array_join(F.col("shards").cast("array<string>"), ","))


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_langid.identify(table(spark, sf_dir, "documents"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_templates(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def queries():
    return {
        f.__name__: f
        for f in (
            op1_cgk_decontamination, op2_hnsw_neighbours, op3_personal_data, op4_feistel_shards,
            op5_warc_capture_index, op6_main_text, op7_sainte_lague_mix, op8_ppm_language, op9_line_templates,
            op10_simhash_near_dedup,
        )
    }


MIX_SQL = r"""
WITH m AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM m GROUP BY source),
i AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS idx, count(*) OVER () AS sources, (sum(source_size) OVER ())::BIGINT AS total FROM s),
w AS (SELECT *, idx % 3 + 1 AS weight, (3 * source_size)::DOUBLE / (idx % 3 + 1) AS ratio, greatest(10000, 64 * sources) AS blocks FROM i),
c AS (SELECT *, (sum(3 * source_size) OVER o - 3 * source_size)::BIGINT AS capped, (sum(weight) OVER () - sum(weight) OVER o + weight)::BIGINT AS free FROM w
  WINDOW o AS (ORDER BY ratio, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
u AS (SELECT *, (total - capped)::DOUBLE / free AS unit FROM c),
f AS (SELECT arg_min(unit, struct_pack(ratio, idx)) AS unit FROM u WHERE unit * weight <= 3 * source_size),
t AS (SELECT u.* EXCLUDE (unit), least((3 * source_size)::DOUBLE, f.unit * weight) AS target FROM u, f),
k AS (SELECT *, target / sum(target) OVER () * blocks AS share FROM t),
q AS (SELECT idx, blocks, target / (2 * unnest(range(0, ceil(share + 2)::BIGINT)) + 1) AS quotient FROM k WHERE target > 0),
a0 AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, idx) AS n FROM q) WHERE n <= blocks),
a AS (SELECT idx, count(*) AS quota, list_transform(range(0, 8), lambda j: len(list_filter(list(n), lambda x: (x - 1) % 8 <= j))) AS upto FROM a0 GROUP BY idx),
g AS (SELECT k.*, list_transform(upto, lambda x: x * (total::DOUBLE / blocks)) AS bounds, least(coalesce(quota, 0) * (total::DOUBLE / blocks), (3 * source_size)::DOUBLE) AS tokens FROM k LEFT JOIN a USING (idx)),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(tokens / source_size)::INT ELSE 0 END AS passes FROM g),
d AS (SELECT m.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 AS middle FROM m),
r AS (SELECT d.doc_id, size, source_size, target, middle, list_transform(bounds, lambda b: least(b, tokens)) AS bounds, passes + CASE WHEN source_size > 0 AND middle <= tokens - passes * source_size THEN 1 ELSE 0 END AS times
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken, times::INT AS times,
  coalesce(array_to_string(list_transform(range(0, times), lambda i: least(len(list_filter(bounds, lambda b: b <= i * source_size + middle)), 7)), ','), '') AS shards FROM r
"""


TEMPLATE_SQL = r"""
WITH RECURSIVE t AS (SELECT DISTINCT md5(text) AS tk, text FROM documents WHERE text IS NOT NULL),
l0 AS (SELECT tk, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM t),
l1 AS (SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]{2,}|[\x09-\x0D]', ' ', 'g'), ' ') AS plain FROM l0),
l2 AS (SELECT tk, pos, line, CASE WHEN regexp_matches(plain, '[0-9]') THEN array_to_string(list_transform(string_split(plain, ' '),
  lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ') ELSE plain END AS masked FROM l1),
l AS (SELECT *, len(string_split(masked, ' ')) || ':' || array_to_string(string_split(masked, ' ')[1:3], ' ') AS leaf FROM l2 WHERE masked <> '' AND len(string_split(masked, ' ')) >= 4),
per AS (SELECT masked, leaf, count(DISTINCT tk) AS n FROM l GROUP BY ALL),
r(masked, leaf, n, model) AS (SELECT masked, leaf, n, NULL::VARCHAR FROM per WHERE leaf IN (SELECT leaf FROM per GROUP BY leaf HAVING count(*) > 1 AND sum(n) >= 3)
  UNION ALL SELECT masked, leaf, n, CASE WHEN list_sum(list_transform(list_zip(string_split(masked, ' '), string_split(founder, ' ')), lambda z: (z[1] = z[2])::INT)) >= len(string_split(masked, ' ')) * 0.7::DOUBLE THEN founder END
  FROM (SELECT *, first_value(masked) OVER (PARTITION BY leaf ORDER BY n DESC, md5(masked)) AS founder, count(*) OVER (PARTITION BY leaf) AS lines, sum(n) OVER (PARTITION BY leaf) AS texts FROM r WHERE model IS NULL)
  WHERE lines > 1 AND texts >= 3),
assigned AS (SELECT masked, model FROM r WHERE model IS NOT NULL),
often AS (SELECT model FROM l JOIN assigned USING (masked) GROUP BY model HAVING count(DISTINCT tk) >= 3),
dropped AS (SELECT masked FROM assigned WHERE model IN (SELECT model FROM often) UNION SELECT masked FROM per WHERE n >= 3 AND masked NOT IN (SELECT masked FROM assigned)),
gone AS (SELECT DISTINCT tk, pos FROM l WHERE masked IN (SELECT masked FROM dropped)),
kept AS (SELECT l0.tk, count(*) AS n_lines, count(gone.pos) AS n_dropped, string_agg(CASE WHEN gone.pos IS NULL THEN line END, chr(10) ORDER BY l0.pos) AS text
  FROM l0 LEFT JOIN gone ON l0.tk = gone.tk AND l0.pos = gone.pos GROUP BY l0.tk)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept ON md5(d.text) = kept.tk
"""


PRIVATE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS tk FROM documents),
u AS (SELECT tk, any_value(text) AS text, count(*) AS copies FROM d GROUP BY tk),
pat(kind, ord) AS (VALUES ('email', 0), ('ip', 1), ('card', 2), ('phone', 3)),
x AS (SELECT tk, text, kind, ord, CASE ord WHEN 0 THEN regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 1 THEN regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)')
    WHEN 2 THEN regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+') ELSE regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]') END AS m,
  CASE ord WHEN 0 THEN string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 1 THEN string_split_regex(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)')
    WHEN 2 THEN string_split_regex(text, '[0-9](?:[\x20-]?[0-9])+') ELSE string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') END AS g FROM u, pat),
y AS (SELECT tk, kind, ord, m, g, unnest(m) AS value, generate_subscripts(m, 1) AS i FROM x),
z AS (SELECT tk, kind, ord, value, regexp_replace(value, '[^0-9]', '', 'g') AS digits,
  (list_sum(list_transform(g[1:i], lambda e: length(e))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda e: length(e))), 0))::BIGINT AS a FROM y),
base AS (SELECT tk, kind, ord, value, a, a + length(value) AS b FROM z WHERE CASE ord WHEN 1 THEN regexp_full_match(value, '(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))\.(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))\.(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))\.(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))')
  WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k: CASE WHEN k % 2 = 1 THEN substring(digits, length(digits) - k + 1, 1)::INT
    ELSE substring(digits, length(digits) - k + 1, 1)::INT * 2 - CASE WHEN substring(digits, length(digits) - k + 1, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  WHEN 3 THEN length(digits) BETWEEN 10 AND 15 ELSE true END),
l0 AS (SELECT tk, copies, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM u WHERE tk IN (SELECT tk FROM base)),
l1 AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY tk ORDER BY no) - length(line) - 1)::BIGINT AS begin_at FROM l0),
lines AS (SELECT DISTINCT l1.tk, copies, begin_at, line, ord || ':' || lower(regexp_replace(value, '[^A-Za-z0-9@.]', '', 'g')) AS entity FROM l1 JOIN base ON l1.tk = base.tk AND a >= begin_at AND a < begin_at + length(line) + 1),
seen AS (SELECT DISTINCT tk, copies, entity, unnest(list_filter(list_distinct(string_split_regex(lower(line), '\P{L}+')), lambda e: length(e) >= 3)) AS term FROM lines),
n AS (SELECT count(*) AS n FROM d),
ne AS (SELECT entity, sum(copies) AS n_e FROM (SELECT DISTINCT tk, copies, entity FROM lines) GROUP BY entity),
tog AS (SELECT entity, term, sum(copies) AS n_et, n_e, n, sum(copies) * pow(n::DOUBLE / n_e, 1 - 1 / 1.25::DOUBLE) * (1 + 1e-9) AS most FROM seen JOIN ne USING (entity), n WHERE n_e < n GROUP BY entity, term, n_e, n HAVING count(*) >= 3),
nt AS (SELECT term, sum(copies) AS n_t FROM (SELECT copies, unnest(list_filter(list_distinct(string_split_regex(lower(text), '\P{L}+')), lambda e: length(e) >= 3)) AS term FROM u WHERE EXISTS (SELECT 1 FROM tog)) GROUP BY term),
pairs AS (SELECT entity, term FROM tog JOIN nt USING (term) WHERE n_t <= most),
marked AS (SELECT tk, begin_at, line, list(DISTINCT term) AS terms FROM lines JOIN pairs USING (entity) GROUP BY ALL),
v AS (SELECT tk, begin_at, terms, regexp_extract_all(line, '\p{L}+') AS m, string_split_regex(line, '\p{L}+') AS g FROM marked),
v1 AS (SELECT *, unnest(m) AS value, generate_subscripts(m, 1) AS i FROM v),
term AS (SELECT tk, 'term' AS kind, 4 AS ord, value, begin_at + (list_sum(list_transform(g[1:i], lambda e: length(e))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda e: length(e))), 0))::BIGINT AS a FROM v1 WHERE list_contains(terms, lower(value))),
every AS (SELECT tk, kind, ord, a, b FROM base UNION ALL SELECT tk, kind, ord, a, a + length(value) FROM term),
r AS (SELECT tk, count(*) FILTER (ord = 0) AS n_email, count(*) FILTER (ord = 1) AS n_ip, count(*) FILTER (ord = 2) AS n_card, count(*) FILTER (ord = 3) AS n_phone, count(*) FILTER (ord = 4) AS n_term,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) FILTER (ord < 4), '') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) AS spans FROM every GROUP BY tk)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_term, 0) AS n_term FROM d LEFT JOIN r USING (tk)
"""


ARCHIVE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((('0x' || substring(h, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_personal_data": PRIVATE_SQL, "op5_warc_capture_index": ARCHIVE_SQL, "op7_sainte_lague_mix": MIX_SQL, "op9_line_templates": TEMPLATE_SQL}
