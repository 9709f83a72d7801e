"""Admission of requests under a sliding limit, over tables in which one client may hold a third of all rows."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from leafmill.operators.folds import fold_by_key
from leafmill.sources.kept import Kept

LIMIT, WINDOW_S = 100, 60
#: Rows of a busy stretch that are folded in one task before the next takes over.
SLICE_ROWS = 1_000_000


def null_safe(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a table by keys of which nulls are equal; the table's keys go."""
    named = table.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in table.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(named, same, how).drop(*[f"__{k}" for k in keys])


def rate_admission(requests: DataFrame, limit: int = LIMIT, window_s: int = WINDOW_S, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Admits a request (client, ts, id) unless limit admitted ones lie in the window before it; rejected ones don't count.

    Returns client, id, ts, admitted and remaining. Stamps of exactly window_s before are out;
    requests of one stamp come in order of id. A null client is one client; requests without
    a stamp can't be judged and have nulls.

    A request is contested if more than limit requests, admitted or not, lie in the window up
    to it; one that is not is admitted. Where none in the window of a request is contested,
    what remains is the limit less their number, and so it is for nearly all of an ordinary
    table: windows of (client, span of window_s) decide it, to each of which the two spans before are
    brought, so no window grows with a client's rows. What is left are busy stretches: from a
    contested request that has none in the window before it, to the last that has one.
    All requests in the window before a stretch are admitted, so it is gone through in order
    by itself, beginning with them; only limit stamps are kept. A stretch of more than
    slice_rows rows, of a client that never pauses, is cut by time: its slices are folded in
    rounds, all clients' at once, and each hands its last admitted stamps to the next.
    """
    span, kept = window_s * 1_000_000, Kept(requests.sparkSession, "admission")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = requests.select("client", "id", "ts", t.alias("t")).withColumn("span", F.floor(F.col("t") / span))
    seen = rows.where("t is not null").withColumn("back", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("span", F.col("span") + F.col("back"))
    by = W.partitionBy("client", "span")
    order = by.orderBy("t", "id")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    out_of_window = F.count(F.lit(1)).over(by.orderBy("t").rangeBetween(W.unboundedPreceding, -span))
    seen = seen.withColumn("n", F.row_number().over(order) - out_of_window).withColumn("contested", F.col("n") > limit)
    seen = seen.withColumn("last", F.max(F.when(F.col("contested"), F.col("t"))).over(before)).where("back = 0")
    free = F.coalesce(F.col("last") <= F.col("t") - span, F.lit(True))
    judged = kept.keep(seen.select("client", "id", "ts", "t", "span", "n", (F.col("contested") | ~free).alias("busy"), (F.col("contested") & free).alias("starts")))

    calm = judged.where("not busy").select("client", "id", "ts", F.lit(True).alias("admitted"), (F.lit(limit) - F.col("n")).cast("long").alias("remaining"))
    bare = rows.where("t is null").select("client", "id", "ts", F.lit(None).cast("boolean").alias("admitted"), F.lit(None).cast("long").alias("remaining"))
    return calm.unionByName(bare).unionByName(_stretches(judged, limit, span, slice_rows, kept))


def _stretches(judged: DataFrame, limit: int, span: int, slice_rows: int, kept: Kept) -> DataFrame:
    """Busy rows, folded by stretch (the stamp of its first row) and slice."""
    # sums over spans of a client, which are as many as its time has, not its rows
    spans = judged.where("busy").groupBy("client", "span").agg(F.max(F.when(F.col("starts"), F.col("t"))).alias("at"), F.count(F.lit(1)).alias("rows"))
    earlier = W.partitionBy("client").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select("client", "span", F.last("at", True).over(earlier).alias("carried"), F.floor(F.coalesce(F.sum("rows").over(earlier), F.lit(0)) / slice_rows).cast("int").alias("slice"))
    in_span = W.partitionBy("client", "span").orderBy("t", "id").rowsBetween(W.unboundedPreceding, 0)
    busy = judged.where("busy").withColumn("own", F.last(F.when(F.col("starts"), F.col("t")), True).over(in_span))
    busy = null_safe(busy, spans, ["client", "span"]).withColumn("stretch", F.coalesce("own", "carried"))
    busy = busy.select("client", "stretch", "slice", "t", F.lit(True).alias("asked"), "id", "ts", "starts")

    # the requests in the window before a stretch, all of them admitted: a stretch has at most limit of them
    starts = busy.where("starts").select("client", "stretch", "slice", F.col("id").alias("first"), F.explode(F.array(F.floor(F.col("t") / span), F.floor(F.col("t") / span) - 1)).alias("span"))
    near = null_safe(judged.select("client", "span", "t", "id", "ts"), starts, ["client", "span"])
    near = near.where((F.col("t") > F.col("stretch") - span) & ((F.col("t") < F.col("stretch")) | (F.col("t") == F.col("stretch")) & (F.col("id") < F.col("first"))))
    near = near.select("client", "stretch", "slice", "t", F.lit(False).alias("asked"), "id", "ts")
    held = F.lit(None).cast("array<long>").alias("held")
    todo = busy.drop("starts").unionByName(near).select("slice", "client", "stretch", "t", "asked", "id", "ts", held)
    rounds = (spans.agg(F.max("slice")).first()[0] or 0) + 1
    if rounds > 1:
        todo = kept.keep(todo, by=["slice"])

    def step(now: deque, row) -> tuple | None:
        if row.held is not None:  # what the slice before has handed on
            now.extend(row.held)
            return None
        if not row.asked:
            now.append(row.t)
            return None
        while now and now[0] <= row.t - span:
            now.popleft()
        ok = len(now) < limit
        if ok:
            now.append(row.t)
        return row.client, row.stretch, row.id, row.ts, ok, limit - len(now), None

    key = todo.schema
    fields = StructType([key["client"], key["stretch"], key["id"], key["ts"], *StructType.fromDDL("admitted boolean, remaining long").fields, StructField("held", ArrayType(LongType()))])
    columns = ["client", "stretch", "t", "asked", "id", "ts", "held"]

    def folded(rows: DataFrame, hands_on: bool) -> DataFrame:
        end = (lambda now: (*now[0], None, None, None, None, list(now[1]))) if hands_on else None
        return fold_by_key(rows.select(*columns), ["client", "stretch"], ["t", "asked", "id"], lambda row: ((row.client, row.stretch), deque()), lambda now, row: step(now[1], row), end, fields)

    results, handed = [], None
    for k in range(rounds):
        part = (todo.where(F.col("slice") == k) if rounds > 1 else todo).drop("slice")
        if handed is not None:
            part = part.unionByName(null_safe(handed, part.select("client", "stretch").distinct(), ["client", "stretch"]))
        done = folded(part, k + 1 < rounds)
        if k + 1 < rounds:
            done = kept.keep(done)
            last = done.where("held is not null").select("client", "stretch", F.lit(None).cast("long").alias("t"), F.lit(True).alias("asked"), "id", "ts", "held")
            handed = last if handed is None else last.unionByName(null_safe(handed, last.select("client", "stretch"), ["client", "stretch"], "left_anti"))
        results.append(done.where("held is null"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select("client", "id", "ts", "admitted", "remaining")
