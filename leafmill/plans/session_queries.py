"""Queries of sessions and request streams in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.plans.base import RQ, query, requests, table
from leafmill.streaming import sessions as S


@query("""WITH c AS (SELECT 's' || user_id AS session_id, arg_max(event_type, ts) AS filename, arg_max(event_type, ts) = 'error' AS gone, min(ts) AS created_at, max(ts) AS last_modified FROM events GROUP BY 1) SELECT session_id, filename, created_at, last_modified FROM c WHERE NOT gone""")
def session_upsert(spark, d):
    e = table(spark, d, "events")
    return S.session_upsert(e.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), "ts", (F.col("event_type") == "error").alias("deleted"), F.col("event_type").alias("filename")))


@query("""WITH e AS (SELECT user_id AS client, event_id AS id, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
f AS (SELECT client, list_reduce(list([CAST(t AS BIGINT)] ORDER BY s), lambda acc, x: CASE WHEN len(list_filter(acc, lambda h: h > x[1] - 86400000000)) < 3 THEN list_concat(acc, x) ELSE acc END) AS admitted FROM e GROUP BY 1)
SELECT e.client, e.id, e.ts, list_contains(admitted, t) AS admitted, CAST(3 - len(list_filter(admitted, lambda h: h > t - 86400000000 AND h <= t)) AS BIGINT) AS remaining FROM e JOIN f USING (client)""")
def rate_admission(spark, d):
    return S.rate_admission(requests(spark, d).select("client", "ts", "id"), 3, 86_400)


@query(f"WITH {RQ} SELECT client, id, CAST(count(*) OVER (PARTITION BY client ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS n_window FROM rq")
def rate_trailing(spark, d):
    return S.rate_trailing(requests(spark, d), 86_400).select("client", "id", "n_window")


@query("""WITH e AS (SELECT CASE WHEN user_id % 5 > 0 THEN user_id END AS client, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY CASE WHEN user_id % 5 > 0 THEN user_id END ORDER BY ts, event_id) AS s FROM events),
f AS (SELECT client, list_reduce(list([CAST(t AS BIGINT), CAST(id AS BIGINT)] ORDER BY s), lambda acc, x: CASE WHEN len(list_filter(acc, lambda h: h > x[1] - 86400000000)) < 3 THEN acc || [x[1]] ELSE acc END) AS admitted FROM (SELECT client, s, t, id FROM e UNION ALL SELECT DISTINCT client, 0, -1000000000000000, 0 FROM e) GROUP BY 1)
SELECT e.client, e.id, list_contains(admitted, t) AS admitted FROM e JOIN f ON e.client IS NOT DISTINCT FROM f.client""")
def rate_admission_nulls(spark, d):
    """A fifth of the clients without a name: they are one client."""
    r = requests(spark, d).select(F.when(F.col("client") % 5 > 0, F.col("client")).alias("client"), "ts", "id")
    return S.rate_admission(r, 3, 86_400).select("client", "id", "admitted")


@query("""WITH e AS (SELECT user_id AS client, epoch_us(ts) AS t FROM events), w AS (SELECT client, unnest(range(t // 21600000000 * 21600000000 + 21600000000, t // 21600000000 * 21600000000 + 86400000001, 21600000000)) AS u FROM e)
SELECT client, make_timestamp(u) AS "at", CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1, 2""")
def rate_windows(spark, d):
    return S.rate_windows(requests(spark, d).select("client", "ts"), 86_400, 21_600)


@query(f"WITH {RQ} SELECT path, status, time_bucket(INTERVAL 1 DAY, ts) AS window_start, CAST(count(*) AS BIGINT) AS n, round(avg(duration), 6) AS avg_ms, max(duration) AS max_ms FROM rq GROUP BY 1, 2, 3")
def request_metrics(spark, d):
    return S.request_metrics(requests(spark, d), "1 day").withColumn("avg_ms", F.round("avg_ms", 6))


@query("""WITH s AS (SELECT user_id AS session_id, max(ts) AS last_modified FROM events WHERE user_id % 3 > 0 OR ts < TIMESTAMP '2024-01-15' GROUP BY 1) SELECT session_id, last_modified FROM s WHERE last_modified < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR AND session_id % 10 <> 0""")
def expire_sessions(spark, d):
    e = table(spark, d, "events").where("user_id % 3 > 0 or ts < timestamp_ntz'2024-01-15 00:00:00'")
    last = e.groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last_modified"))
    active = last.where("session_id % 10 = 0")
    return S.expire_sessions(last, F.expr("timestamp_ntz'2024-01-31 00:00:00'"), active)


@query("""WITH l AS (SELECT user_id, event_type || '-' || CAST(json_extract(props, '$.k') AS INTEGER) AS name, max(ts) AS ts FROM events GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, name) AS INTEGER) AS rank FROM l) SELECT * FROM r WHERE rank <= 10""")
def recent_files(spark, d):
    e = table(spark, d, "events")
    return S.recent_files(e.select("user_id", F.concat_ws("-", "event_type", F.get_json_object("props", "$.k")).alias("name"), "ts"))
