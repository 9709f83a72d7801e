"""Thin queries over whole tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import decontaminate, fingerprints, htmltext, licenses, lm, neardup, phrases, repair, sentencepieces, substrings, tokencounts, toxicity, urlfilter


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_texts(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("detections")


def op5_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_main_text(_table(spark, sf_dir, "pages"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(_table(spark, sf_dir, "conversations"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # noqa: F401  part of this subpackage: the queries stand or fall together

    named = (op1_sentencepiece, op2_minhash, op3_substrings, op4_licenses, op5_maxent, op6_toxicity, op7_decontaminate, op8_tokens, op9_html, op10_winnowing, op11_urls, op12_repair, op13_phrases, pipeline)
    return {f.__name__: f for f in named}


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g FROM d),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = p.a JOIN s sb ON sb.doc_id = p.b WHERE 100 * c >= 85 * (len(sa.g) + len(sb.g) - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(n, m) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.n),
c AS (SELECT n, min(m) AS m FROM r GROUP BY n)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.m AS component_id, c.m = s.doc_id AS kept FROM s JOIN c ON c.n = s.doc_id
"""

OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM (SELECT doc_id, i, unnest(range(50)) AS k FROM win JOIN f USING (h) WHERE m < doc_id)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.pos) AS body, count(*) AS n FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos WHERE g.pos IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.g = dw.g AND bw.n = dw.n),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


#: Targets of links in html are taken where they are absolute; tests hold relative ones against a plain version.
OP11 = rf"""
WITH RECURSIVE u AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
t AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM u WHERE html ILIKE '%canonical%' OR html ILIKE '%refresh%'),
l AS (SELECT url AS a, CASE WHEN regexp_matches(tag, '(?i)\srel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?i)\shref\s*=\s*["'']?(https?://[^\s"''>]*)', 1)
                            WHEN regexp_matches(tag, '(?i)\shttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i)url\s*=\s*["'']?(https?://[^\s"''>]*)', 1) ELSE '' END AS b FROM t),
n AS (SELECT url FROM p WHERE contains(url, '://') UNION SELECT b FROM l WHERE b <> '' AND contains(a, '://')),
s AS (SELECT url, regexp_extract(lower(url), '^\s*([a-z][a-z0-9+.-]*)://', 1) AS scheme, regexp_replace(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}'), '^.*@', '') AS h,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(?s)^[^#]*?://[^?#]*(\?[^#]*)', 1) AS q FROM n),
c AS (SELECT url, scheme || '://' || regexp_replace(CASE scheme WHEN 'http' THEN regexp_replace(h, ':(80)?$', '') WHEN 'https' THEN regexp_replace(h, ':(443)?$', '') ELSE h END, '\.$', '') || CASE WHEN path = '' THEN '/' ELSE path END || q AS addr FROM s),
e AS (SELECT a, b FROM l WHERE b <> '' AND contains(a, '://') UNION SELECT b, a FROM l WHERE b <> '' AND contains(a, '://') UNION SELECT url, addr FROM c WHERE url <> addr UNION SELECT addr, url FROM c WHERE url <> addr),
g AS (SELECT DISTINCT a AS url, translate(regexp_extract(a, '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host, regexp_extract(a, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM e),
bad(url) AS (SELECT url FROM g JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY url HAVING arg_max(v, length(h) + length(p)) = 'block' UNION SELECT e.b FROM bad JOIN e ON e.a = bad.url),
m AS (SELECT p0.page_id, p0.url, p0.host, p0.path, rules.h, rules.p, rules.v, length(rules.h) + length(rules.p) AS n FROM (SELECT *, row_number() OVER () AS k FROM p) p0 LEFT JOIN rules ON (p0.host = rules.h OR ends_with(p0.host, '.' || rules.h)) AND starts_with(p0.path, rules.p) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC NULLS LAST) = 1)
SELECT page_id, host, path, h || p AS rule, coalesce(v, CASE WHEN bad.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, v IS NULL AND bad.url IS NOT NULL AS by_alias FROM m LEFT JOIN bad ON bad.url = m.url
"""

OP13 = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
g AS (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) ks(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, g, a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cut AS (SELECT lang, g, c.k, c.a, w, cuts.n AS head, array_to_string(w[1:cuts.n], ' ') AS x, array_to_string(w[cuts.n+1:], ' ') AS y FROM c, (VALUES (1), (2)) cuts(n) WHERE cuts.n < c.k),
sc AS (SELECT cut.lang, cut.g, cut.k, cut.a, cut.w, head, fx.a AS l, fy.a AS r, CAST((CAST(1000000 AS HUGEINT) * cut.a * cut.a) // (CAST(fx.a AS HUGEINT) * fy.a) AS BIGINT) AS score
  FROM cut JOIN f fx ON fx.lang = cut.lang AND fx.g = cut.x AND fx.k = head JOIN f fy ON fy.lang = cut.lang AND fy.g = cut.y AND fy.k = cut.k - head),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, head) = 1),
longer AS (SELECT lang, p, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS p FROM c WHERE k = 3) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.p = best.g AND best.k = 2 WHERE longer.a IS NULL OR 100 * longer.a < 50 * best.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, g AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r, CAST(n.n AS BIGINT) AS n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": OP2, "op3_substrings": OP3, "op7_decontaminate": OP7, "op11_urls": OP11, "op13_phrases": OP13}
