"""Substring dedup: Rabin-Karp hashes of fixed-length word windows, counted in Spark."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.joins import join_by_key, with_likely
from leafmill.llm.schemas import schema
from leafmill.llm.scratch import Scratch
from leafmill.llm.wordhash import SPACES, Words, ranges, second, words
from leafmill.llm.worker import text_of, tidy

WINDOW, GRAM = 50, 8
_CUT = "n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<start:int,end:int>>"


def _anchored(part: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts of one document with the same smallest gram hash.

    Returns for each run: document, first start, last start, smallest gram hash. Equal
    windows have equal grams, so equal windows always stand in runs of the same hash.
    """
    none = np.zeros(0, np.int64)
    starts = len(part.hashes) - window + 1
    if starts <= 0:
        return none, none, none, none.astype(np.uint64)
    low, _ = part.windows(gram)
    width = window - gram + 1
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: starts], low[width - size : width - size + starts])
    owner = part.owners()
    at = np.flatnonzero(owner[:starts] == owner[window - 1 :])
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    low, owner = low[at], owner[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return owner[first], at[first], at[last], low[first]


def _runs(window: int, gram: int):
    @tidy
    def scan(batches):
        for batch in batches:
            ids, tags = batch.column("id"), batch.column("tag")
            for part in words(batch.column("text"), SPACES, False):
                doc, a, b, low = _anchored(part, window, gram)
                run = [ranges(x, a, b + window) ^ (b - a).astype(np.uint64) if len(doc) else low for x in (part.hashes | np.uint64(1), second(part.hashes))]
                row = pa.array(doc + part.first, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(row), tags.take(row), pa.array((a - part.bounds[doc]).astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (low, *run))], names=["id", "tag", "at", "gram", "run", "run2"])

    return scan


def _windows(window: int):
    """Hash of each window of the runs listed with a document."""

    @tidy
    def scan(batches):
        for batch in batches:
            ids, tags, listed = batch.column("id"), batch.column("tag"), batch.column("runs").to_pylist()
            for part in words(batch.column("text"), SPACES, False):
                doc, a, b, _ = _anchored(part, window, GRAM)
                pick = np.array([x in wanted for x, wanted in zip((a - part.bounds[doc]).tolist(), (listed[d + part.first] for d in doc.tolist()), strict=True)], dtype=bool) if len(doc) else np.zeros(0, bool)
                doc, a, b = doc[pick], a[pick], b[pick]
                n = b - a + 1
                at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                owner = np.repeat(doc, n)
                h = [ranges(x, at, at + window) if len(at) else np.zeros(0, np.uint64) for x in (part.hashes | np.uint64(1), second(part.hashes))]
                row = pa.array(owner + part.first, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(row), tags.take(row), pa.array((at - part.bounds[owner]).astype(np.int32)), *(pa.array(x.view(np.int64)) for x in h)], names=["id", "tag", "at", "h", "h2"])

    return scan


def _cut(window: int):
    """Counts, digest, text and removed intervals of each document from the runs and windows to remove."""

    @tidy
    def scan(batches):
        for batch in batches:
            runs, single, texts = batch.column("whole").to_pylist(), batch.column("starts").to_pylist(), text_of(batch)
            n_words, removed, digests, kept, spans = [], [], [], [], []
            for part in words(texts, SPACES, False):
                doc, a, b, _ = _anchored(part, window, GRAM)
                first = np.searchsorted(doc, np.arange(len(part.bounds)))
                for d in range(len(part.bounds) - 1):
                    i, lo, hi = d + part.first, int(part.bounds[d]), int(part.bounds[d + 1])
                    data = part.data[part.offsets[d] : part.offsets[d + 1]].tobytes()
                    body = data.split()
                    gone: list[list[int]] = []
                    if runs[i] or single[i]:
                        cover = np.zeros(hi - lo + 1, np.int32)
                        whole = set(runs[i] or ())
                        for k in range(first[d], first[d + 1]):
                            if int(a[k]) - lo in whole:
                                cover[a[k] - lo] += 1
                                cover[b[k] - lo + window] -= 1
                        at = np.array(single[i] or [], np.int64)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                        mask = np.cumsum(cover[:-1]) > 0
                        edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
                        gone = edge.reshape(-1, 2).tolist()
                        body = [w for w, out in zip(body, mask.tolist(), strict=True) if not out]
                    left = b" ".join(body)
                    n_words.append(hi - lo)
                    removed.append(sum(y - x for x, y in gone))
                    digests.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode() if gone else None)
                    spans.append([{"start": x, "end": y} for x, y in gone])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["row", "n_words", "n_removed", "kept_sha256", "kept_text", "removed"])

    return scan


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes each word inside a window of words that also starts in a document of smaller id.

    Returns a row per row of df: doc_id, n_words, n_removed, kept_sha256 (of the kept words
    joined by one space), kept_text (those words, or the text as it was if none went) and
    removed (maximal intervals of words, end exclusive); carried columns come as struct row,
    whatever their names. Windows are judged on the input.

    Windows are taken in runs that share their smallest 8-word gram. Only runs whose gram is
    found in another document too can matter. Of those, a run that occurs whole in a smaller
    document is settled by its own hashes; of the rest each window's hashes go to Spark, which
    finds the smallest document of each. Hashes are Rabin-Karp sums over 64-bit word hashes;
    windows are told apart by two of them, 128 bits together.

    Null texts have no words, and texts of fewer words than a window lose none. Texts of any
    length are read whole. Ids are integers; null ids are dropped. Rows that repeat an id
    remove nothing from each other, and each is judged by its own text. An empty table gives
    no rows.
    """
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    scratch = Scratch(df.sparkSession, "substrings")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = ["id", "tag"]  # a row is known by its id and a hash of its text: ids may repeat
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text")).where("id is not null")
    runs, n = scratch.keep_counted(docs.mapInArrow(_runs(window, GRAM), "id long, tag long, at int, gram long, run long, run2 long"), "runs")
    several = [F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")]
    grams = scratch.keep(runs.groupBy("gram").agg(*several).where("lo < hi").select("gram", "n"), "grams")
    shared, n = scratch.keep_counted(join_by_key(runs, grams, ["gram"], n).select(*key, "at", "run", "run2"), "shared")
    scratch.drop(runs)
    first = scratch.keep(shared.groupBy("run", "run2").agg(*several).where("lo < hi").select("run", "run2", "lo", "n"), "first")
    judged = join_by_key(shared, first, ["run", "run2"], n, "left").select(*key, "at", F.coalesce(F.col("lo") < F.col("id"), F.lit(False)).alias("whole"))
    judged = scratch.keep(judged, "judged")
    scratch.drop(shared)
    per_doc = judged.groupBy(*key).agg(F.collect_set(F.when(F.col("whole"), F.col("at"))).alias("whole"), F.collect_set(F.when(~F.col("whole"), F.col("at"))).alias("runs"))
    opened = per_doc.where(F.size("runs") > 0).select(*key, "runs")
    likely = with_likely(docs, judged.where("not whole").select(*key).distinct(), key, "__likely").where("__likely")
    open_docs = likely.join(opened, key).select(*key, "text", "runs")
    windows, n = scratch.keep_counted(open_docs.mapInArrow(_windows(window), "id long, tag long, at int, h long, h2 long"), "windows")
    smallest = scratch.keep(windows.groupBy("h", "h2").agg(*several).where("lo < hi").select("h", "h2", "lo", "n"), "smallest")
    starts = join_by_key(windows, smallest, ["h", "h2"], n).where("id > lo").groupBy(*key).agg(F.collect_set("at").alias("starts"))
    fates = per_doc.select(*key, "whole").where(F.size("whole") > 0).join(starts, key, "full_outer")
    fates = scratch.keep(fates, "fates")
    row = F.struct(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), *[F.col(f"`{c}`").alias(c) for c in carry if c not in ("text", "doc_id")])
    carried = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), row.alias("row")).where("id is not null")
    carried = with_likely(carried, fates, key, "__likely")
    spared = carried.where("not __likely").select("row", *[F.lit(None).cast("array<int>").alias(c) for c in ("whole", "starts")])
    ready = carried.where("__likely").join(fates, key, "left").select("row", "whole", "starts").unionByName(spared)
    out = ready.mapInArrow(_cut(window), schema(ready.schema["row"], _CUT))
    out = out.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", "kept_sha256", F.coalesce("kept_text", "row.text", F.lit("")).alias("kept_text"), "removed", "row")
    return out if carry else out.drop("row")
