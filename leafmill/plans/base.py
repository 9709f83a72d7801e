"""The driver's tables read as the library's tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_no"), "text", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.lit(0).alias("rotation"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.pmod(k, F.lit(5)).alias("page_no"), "event_id", F.col("event_type").alias("type"), k.alias("k"), "value", "ts")
    idx = F.row_number().over(W.partitionBy("doc_id", "page_no").orderBy("event_id")) - 1
    return e.select("doc_id", "page_no", idx.alias("idx"), "type", F.concat("type", F.lit(" "), F.col("k").cast("string")).alias("contents"), F.lit("black").alias("stroke"), F.lit("white").alias("fill"), F.lit(1.0).alias("border_width"), F.lit("S").alias("border_style"), F.lit(1.0).alias("opacity"), "k", "value", "ts", "event_id")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("doc_id"), (F.col("p_size") % 5).alias("page_no"), "*")
    idx = F.row_number().over(W.partitionBy("doc_id", "page_no").orderBy("p_partkey")) - 1
    full = F.col("p_partkey") % 7 != 0
    return p.select(
        "doc_id", "page_no", idx.alias("idx"), (F.col("p_size") * 10).alias("width"), F.floor(F.col("p_retailprice") / 10).cast("int").alias("height"), F.lit(8).alias("bits_per_component"),
        (F.col("p_partkey") % 5).cast("int").alias("color_space"), F.when(F.col("p_brand") != "Brand#1", F.lower("p_type")).alias("compression"), (F.col("p_partkey") % 3).cast("int").alias("mask"), (F.col("p_size") * 1000).cast("long").alias("size_bytes"),
        F.col("p_size").cast("double").alias("x0"), F.col("p_size").cast("double").alias("y0"), F.when(full, F.col("p_size") * 11.0).alias("x1"), F.when(full, F.col("p_size") * 2.0).alias("y1"),
    )


def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").cast("long").alias("doc_id"), (F.col("c_custkey") % 3).cast("int").alias("page_no"), F.concat(F.lit("f"), (F.col("c_custkey") % 20).cast("string")).alias("name"), F.col("c_mktsegment").alias("value"), ((F.col("c_custkey") % 2) * 2).cast("int").alias("flags"), F.col("c_custkey").alias("field_id"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("path"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("duration"))


PG = "pg AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_no, text, CAST(595 AS DOUBLE) AS width, CAST(842 AS DOUBLE) AS height, CAST(0 AS INTEGER) AS rotation FROM conversations)"
CNT = PG + ", cnt AS (SELECT doc_id, count(*) AS n_pages FROM pg GROUP BY 1)"
AN = """an0 AS (SELECT user_id AS doc_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_id, event_type AS type, value, ts FROM events),
an AS (SELECT doc_id, CAST(k % 5 AS INTEGER) AS page_no, CAST(row_number() OVER (PARTITION BY doc_id, k % 5 ORDER BY event_id) - 1 AS INTEGER) AS idx, type, type || ' ' || k AS contents,
  'black' AS stroke, 'white' AS fill, CAST(1 AS DOUBLE) AS border_width, 'S' AS border_style, CAST(1 AS DOUBLE) AS opacity, k, value, ts, event_id FROM an0)"""
IM = """im AS (SELECT p_partkey % 100 AS doc_id, CAST(p_size % 5 AS INTEGER) AS page_no, CAST(row_number() OVER (PARTITION BY p_partkey % 100, p_size % 5 ORDER BY p_partkey) - 1 AS INTEGER) AS idx,
  CAST(p_size * 10 AS INTEGER) AS width, CAST(floor(p_retailprice / 10) AS INTEGER) AS height, 8 AS bits_per_component, CAST(p_partkey % 5 AS INTEGER) AS color_space,
  CASE WHEN p_brand <> 'Brand#1' THEN lower(p_type) END AS compression, CAST(p_partkey % 3 AS INTEGER) AS mask, CAST(p_size * 1000 AS BIGINT) AS size_bytes,
  CAST(p_size AS DOUBLE) AS x0, CAST(p_size AS DOUBLE) AS y0, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size * 11 AS DOUBLE) END AS x1, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size * 2 AS DOUBLE) END AS y1 FROM part)"""
FF = "ff AS (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(c_custkey % 3 AS INTEGER) AS page_no, 'f' || (c_custkey % 20) AS name, c_mktsegment AS value, CAST((c_custkey % 2) * 2 AS INTEGER) AS flags, c_custkey AS field_id FROM customer)"
RQ = "rq AS (SELECT user_id AS client, ts, event_id AS id, event_type AS path, CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INTEGER) AS status, value AS duration FROM events)"
WL = r"""wl AS (SELECT doc_id, flatten(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '\S')),
  lambda l: string_split(list_reduce(list_filter(string_split_regex(l, '\s+'), lambda w: w <> ''), lambda a, x: CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(x) <= 80 THEN a || ' ' || x ELSE a || chr(10) || x END), chr(10)))) AS lines FROM documents)"""
PT = WL + ", pt0 AS (SELECT doc_id, unnest(lines) AS text, unnest(range(len(lines))) AS i FROM wl UNION ALL SELECT doc_id, NULL, 0 FROM wl WHERE len(lines) = 0), pt AS (SELECT doc_id, CAST(i // 54 AS INTEGER) AS page_no, CAST(i % 54 AS INTEGER) AS line_on_page, CAST(50 + 14 * (i % 54) AS DOUBLE) AS y, text FROM pt0)"
# each parting tag becomes a mark, the tag and another mark; what stands before the first has no tag
HP = r"""hp0 AS (SELECT page_id AS doc_id, string_split(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', '', 'g'), '(?i)<(/[^>]*|(?:h[1-6]|p|pre|code|li|ul|ol)(?:\s[^>]*)?)>', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM pages),
hp1 AS (SELECT doc_id, n, CASE WHEN n = 0 THEN '' ELSE lower(regexp_extract(part, '^[A-Za-z0-9]*')) END AS tag, CASE WHEN n = 0 THEN part ELSE split_part(part, chr(2), 2) END AS raw FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS n FROM hp0)),
hp2 AS (SELECT doc_id, n, CASE WHEN tag IN ('', 'ul', 'ol') THEN 'p' ELSE tag END AS tag, trim(replace(replace(replace(regexp_replace(regexp_replace(raw, '(?i)<br\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS text FROM hp1),
hp AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS i, tag, text FROM hp2 WHERE text <> '')"""
# the same with a b as a parting tag
HPB = HP.replace("|ol)", "|ol|b)")
SP = HP + """, sp0 AS (SELECT doc_id, CAST(i // 54 AS INTEGER) AS page_no, CAST(i % 54 AS INTEGER) AS block, 0 AS line, 0 AS span, text,
  CASE WHEN tag IN ('code', 'pre') THEN 'Courier' WHEN tag LIKE 'h_' THEN 'Helvetica-Bold' ELSE 'Helvetica' END AS font,
  CAST(CASE tag WHEN 'h1' THEN 18 WHEN 'h2' THEN 14 WHEN 'h3' THEN 12 WHEN 'code' THEN 9 WHEN 'pre' THEN 9 ELSE 11 END AS DOUBLE) AS size,
  CAST(CASE WHEN tag IN ('code', 'pre') THEN 8 WHEN tag LIKE 'h_' THEN 16 ELSE 0 END AS INTEGER) AS flags FROM hp WHERE text <> ''),
sp AS (SELECT *, CAST(50 AS DOUBLE) AS x0, 50 + 14 * block - size AS y0, 50 + length(text) * size * 0.5 AS x1, CAST(50 + 14 * block AS DOUBLE) AS y1 FROM sp0)"""
SPB = HPB + SP.removeprefix(HP).replace("tag LIKE 'h_'", "tag LIKE 'h_' OR tag = 'b'")
