"""Sessions and request streams: each behaviour in a batch form and a Structured Streaming form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafmill.streaming.admission import LIMIT, WINDOW_S, rate_admission  # noqa: F401  the batch form
from leafmill.streaming.store import stored_sessions, upsert_stream  # noqa: F401

TTL_HOURS = 24


def client_key(forwarded: Column, real: Column, peer: Column) -> Column:
    """First of X-Forwarded-For, else X-Real-IP, else the peer, else unknown."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(some(F.split(forwarded, ",").getItem(0)), some(real), some(peer), F.lit("unknown"))


def session_upsert(changes: DataFrame) -> DataFrame:
    """Latest state of each session: changes have session_id, ts, deleted and the state's columns."""
    rest = [c for c in changes.columns if c not in ("session_id", "ts", "deleted")]
    last = changes.groupBy("session_id").agg(F.max_by(F.struct("deleted", *rest), "ts").alias("s"), F.min("ts").alias("created_at"), F.max("ts").alias("last_modified"))
    return last.where("not s.deleted").select("session_id", *[F.col(f"s.{c}").alias(c) for c in rest], "created_at", "last_modified")


def rate_admission_stream(requests: DataFrame, limit: int = LIMIT, window_s: int = WINDOW_S, late: str = "10 minutes") -> DataFrame:
    """The same over a stream (client, ts, id): state is at most limit stamps for each client, and goes when the watermark has passed them.

    Rows of a micro-batch are taken in order of time; one that comes after later ones were
    judged is judged against the stamps admitted by then, and one behind the watermark is
    dropped.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        out = []
        for i, ts in zip(rows["id"], rows["ts"], strict=True):
            t = int(ts.value // 1000)
            held = [h for h in held if h > t - window_s * 1_000_000]
            ok = len(held) < limit
            if ok:
                held.append(t)
            out.append((key[0], i, ts, ok, limit - len(held)))
        state.update((held,))
        newest = max(held, default=0) // 1000
        state.setTimeoutTimestamp(max(newest + 2 * window_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["client", "id", "ts", "admitted", "remaining"])

    kind = requests.schema["client"].dataType.simpleString()
    return requests.withWatermark("ts", late).groupBy("client").applyInPandasWithState(judge, f"client {kind}, id long, ts timestamp, admitted boolean, remaining long", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def rate_trailing(requests: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """Requests of the same client in the window up to each one, itself included; null where a request has no stamp.

    Counted in windows of (client, span of window_s), to each of which the span before is
    brought: none grows with a client's rows.
    """
    span, t = window_s * 1_000_000, F.unix_micros(F.col("ts").cast("timestamp"))
    rows = requests.withColumn("__t", t).withColumn("__back", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__span", F.floor(F.col("__t") / span) + F.col("__back"))
    w = W.partitionBy("client", "__span").orderBy("__t").rangeBetween(-span + 1, 0)
    counted = rows.withColumn("n_window", F.when(F.col("__t").isNotNull(), F.count(F.lit(1)).over(w)))
    return counted.where("__back = 0").drop("__t", "__back", "__span")


def rate_windows(requests: DataFrame, window_s: int = WINDOW_S, every_s: int | None = None, late: str = "10 minutes") -> DataFrame:
    """Trailing counts at fixed times: client, at and n, the requests in the window_s before at (every every_s, default a tenth of it), where there are any.

    Sliding windows of event time, the same over a table and a stream. On a stream a count
    comes once the watermark has passed its time, and later rows are dropped (LateRows
    counts them); state is a number for each client and open window. Windows end at whole
    multiples of every_s since 1970; a request of exactly at is not in it.
    """
    every = every_s or max(1, window_s // 10)
    rows = requests.withWatermark("ts", late) if requests.isStreaming else requests
    counts = rows.groupBy("client", F.window("ts", f"{window_s} seconds", f"{every} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("client", F.col("w.end").alias("at"), "n")


def request_metrics(requests: DataFrame, every: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean and largest duration by path and status; every: by tumbling windows too. On a stream, rows later than the watermark are dropped."""
    keys = ["path", "status"]
    if every:
        if requests.isStreaming:
            requests = requests.withWatermark("ts", late)
        keys = [F.window("ts", every).alias("w"), *keys]
    out = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("avg_ms"), F.max("duration").alias("max_ms"))
    return out.withColumn("window_start", F.col("w.start")).drop("w") if every else out


def expire_sessions(sessions: DataFrame, now: Column, active: DataFrame | None = None, hours: int = TTL_HOURS) -> DataFrame:
    """Sessions to delete: older than the limit and not active."""
    old = sessions.where(F.col("last_modified") < now - F.make_dt_interval(hours=F.lit(hours)))
    return old if active is None else old.join(active.select("session_id").distinct(), "session_id", "left_anti")


def expire_stream(requests: DataFrame, hours: int = TTL_HOURS, late: str = "1 hour") -> DataFrame:
    """Sessions of a stream that ended by a gap as long as the limit: session_id, started, ended, n."""
    g = requests.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", f"{hours} hours"))
    return g.agg(F.count(F.lit(1)).alias("n")).select("session_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def recent_files(opened: DataFrame, keep: int = 10) -> DataFrame:
    """The last files of each user (user_id, name, ts), one entry for each name, newest first."""
    last = opened.groupBy("user_id", "name").agg(F.max("ts").alias("ts"))
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), "name"))
    return last.withColumn("rank", n).where(F.col("rank") <= keep)


def recent_files_stream(opened: DataFrame, keep: int = 10, late: str = "1 hour", ttl_days: int = 90) -> DataFrame:
    """The same over a stream, in update mode: each user whose list changed, with names, newest first. A user's list goes ttl_days after the last file."""

    def newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        for b in batches:
            last = b.groupby("name")["ts"].max()
            for name, ts in zip(last.index, last.array, strict=True):
                held[name] = max(held.get(name, 0), int(ts.value // 1000))
        top = sorted(held.items(), key=lambda x: (-x[1], x[0]))[:keep]
        state.update(([n for n, _ in top], [t for _, t in top]))
        state.setTimeoutTimestamp(max(top[0][1] // 1000 + ttl_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "names": [[n for n, _ in top]]})

    kind = opened.schema["user_id"].dataType.simpleString()
    return opened.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(newest, f"user_id {kind}, names array<string>", "names array<string>, stamps array<long>", "update", GroupStateTimeout.EventTimeTimeout)


class LateRows(StreamingQueryListener):
    """Rows that each stream of a session has dropped because they came behind the watermark.

    A side metric over the whole life of a query: every progress is added up, by the query's
    id, so restarts of a query go on counting while the listener lives. Rows are counted as
    the stateful operator meets them, that is after an aggregation's partial sums.
    """

    def __init__(self):
        self.rows: dict[str, int] = {}

    @staticmethod
    def watch(spark: SparkSession) -> LateRows:
        """A listener that has been added to the session."""
        listener = LateRows()
        spark.streams.addListener(listener)
        return listener

    def of(self, query: StreamingQuery) -> int:
        return self.rows.get(str(query.id), 0)

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
