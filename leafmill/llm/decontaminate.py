"""Benchmark decontamination: words of documents inside any window of a benchmark item."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.schemas import schema
from leafmill.llm.scratch import Scratch
from leafmill.llm.wordhash import NON_ALNUM, ranges, second, words
from leafmill.llm.worker import text_of, tidy

WINDOW = 13
#: Bytes of benchmark text whose windows one broadcast may hold; more are scanned for in blocks.
BLOCK_BYTES = 8 << 20
#: Blocks that are scanned for in one job.
CHAIN = 4
#: Bytes of a segment of a long item: it is the unit that is dealt to blocks.
SEGMENT_BYTES = 1 << 18
FILTER_BITS = 22
_FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


class WindowSet:
    """The windows of benchmark items by hash, with the words to check a hit against: numpy arrays, about nine times the text.

    Equal windows are one group, known by 128 bits; a group has the words of its first
    window and the items that hold it.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [n for n, _ in items]
        lengths, hashes, others, owners, places, data, starts, ends, digits = [], [], [], [], [], [], [], [], []
        n_words = n_bytes = 0
        for part in words(pa.array([t for _, t in items], pa.string()), NON_ALNUM, True) if items else ():
            size = np.diff(part.bounds)
            n = np.minimum(size, window)
            data.append(part.data)
            starts.append(part.starts + n_bytes)
            ends.append(part.ends + n_bytes)
            digits = (part.hashes | np.uint64(1), second(part.hashes))
            for length in np.unique(n[n > 0]).tolist():
                mine = np.flatnonzero(n == length)
                count = size[mine] - length + 1
                at = np.repeat(part.bounds[:-1][mine] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                lengths.append(np.full(len(at), length, np.int32))
                owners.append((np.repeat(mine, count) + part.first).astype(np.int32))
                places.append(at + n_words)
                hashes.append(ranges(digits[0], at, at + length))
                others.append(ranges(digits[1], at, at + length))
            n_words += len(part.starts)
            n_bytes += len(part.data)
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.data, self.starts, self.ends = join(data, np.uint8), join(starts, np.int64), join(ends, np.int64)
        length, h, o, owner, place = join(lengths, np.int32), join(hashes, np.uint64), join(others, np.uint64), join(owners, np.int32), join(places, np.int64)
        self.by_length = {}
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            own = own[np.lexsort((owner[own], o[own], h[own]))]
            new = np.ones(len(own), dtype=bool)
            new[1:] = (h[own][1:] != h[own][:-1]) | (o[own][1:] != o[own][:-1])
            first = np.flatnonzero(new)
            bits = np.zeros(1 << FILTER_BITS, dtype=bool)
            bits[h[own] >> np.uint64(64 - FILTER_BITS)] = True
            self.by_length[n] = (np.packbits(bits), h[own][first], place[own][first], np.append(first, len(own)), owner[own])

    def same(self, part, i: int, place: int, n: int) -> bool:
        """Whether the n words of a document from word i on are those from place on."""
        return all(part.word(i + j) == self.data[self.starts[place + j] : self.ends[place + j]].tobytes() for j in range(n))


def _hits(texts, held: WindowSet, bits: dict):
    """For each document: number of words, merged hit spans and names of items found."""
    for part in words(texts, NON_ALNUM, True):
        docs = len(part.bounds) - 1
        spans: dict[int, list[tuple[int, int]]] = {}
        groups: dict[int, set[tuple[int, int]]] = {}
        owner = None
        for n, (_, keys, place, _, _) in held.by_length.items():
            h, whole = part.windows(n)
            if not len(h):
                continue
            at = np.flatnonzero(bits[n][h >> np.uint64(64 - FILTER_BITS)] & whole)
            lo, hi = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], "right")
            found = hi > lo
            if found.any() and owner is None:
                owner = part.owners()
            for i, a, b in zip(at[found].tolist(), lo[found].tolist(), hi[found].tolist(), strict=True):
                for g in range(a, b):
                    if held.same(part, i, int(place[g]), n):
                        d = int(owner[i])
                        spans.setdefault(d, []).append((i - int(part.bounds[d]), i - int(part.bounds[d]) + n))
                        groups.setdefault(d, set()).add((n, g))
        for d in range(docs):
            items = {int(x) for n, g in groups.get(d, ()) for x in held.by_length[n][4][held.by_length[n][3][g] : held.by_length[n][3][g + 1]]}
            yield part, d, int(part.bounds[d + 1] - part.bounds[d]), _merged(spans.get(d, ())), sorted({held.names[i] for i in items})


def _segments(window: int, limit: int = SEGMENT_BYTES):
    """Cuts long items at words, with window - 1 words of overlap: the windows stay the same."""

    def run(batches):
        for batch in batches:
            items, texts = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                body = text.encode()
                if len(body) <= limit:
                    items.append(item)
                    texts.append(text)
                    continue
                for part in words(pa.array([text], pa.string()), NON_ALNUM, True):
                    a, n = 0, len(part.starts)
                    while a < n:
                        b = max(int(np.searchsorted(part.ends, part.starts[a] + limit, "right")), a + window)
                        items.append(item)
                        texts.append(body[part.starts[a] : part.ends[min(b, n) - 1]].decode())
                        a = b - window + 1 if b < n else n
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], names=["item", "text"])

    return run


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Where windows of benchmark items occur in documents.

    Returns a row per row of docs: row (struct of doc_id, text and the carried columns,
    whatever their names), n_words, spans (array of {start, end} in words, merged, end
    exclusive) and items (sorted array of item ids as text).

    The windows of the items are a broadcast hash set of about block_bytes of text; a
    larger benchmark is split by a hash, long items in segments, and scanned for block by
    block, each scan adding to what the one before has found; after four blocks what is found
    is written and their sets go. Each hash match is checked word
    by word. Null and empty texts and items have no words and no hits; texts and items of any
    length are read whole; repeated items count by their id, repeated rows give repeated
    rows, and null item ids are left out; empty tables give no hits or no rows.
    """
    spark = docs.sparkSession
    bench = items.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).where("item is not null").distinct()
    bench = bench.mapInArrow(_segments(window), "item string, text string")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    out = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(c) for c in carry if c not in ("doc_id", "text")]).alias("row"))
    fields = schema(out.schema["row"], _FOUND)
    scratch, live, before = Scratch(spark, "decontaminate"), [], None
    for block in range(blocks):
        if len(live) == CHAIN:  # the driver and a task hold no more sets than this, however large the benchmark is
            kept = scratch.keep(out, "found")
            for old in live:
                old.destroy()
            if before is not None:
                scratch.drop(before)
            out, live, before = kept, [], kept
        mine = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else bench
        shared = spark.sparkContext.broadcast(WindowSet([(r.item, r.text) for r in mine.toLocalIterator()], window))
        live.append(shared)
        out = out.mapInArrow(_scan(shared), fields)
    return out


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _scan(shared):
    """Adds what one broadcast finds to what earlier ones have found."""

    @tidy
    def run(batches):
        held = shared.value
        bits = {n: np.unpackbits(b).astype(bool) for n, (b, *_) in held.by_length.items()}
        for batch in batches:
            again = "spans" in batch.schema.names
            olds = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True) if again else iter(lambda: ((), ()), None)
            n_words, spans, names = [], [], []
            for (_, _, n, merged, found), (old, was) in zip(_hits(text_of(batch), held, bits), olds, strict=False):
                n_words.append(n)
                spans.append([{"start": a, "end": b} for a, b in _merged([*merged, *((x["start"], x["end"]) for x in old)])])
                names.append(sorted({*found, *was}))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(SPAN)), pa.array(names, pa.list_(pa.string()))], names=["row", "n_words", "spans", "items"])

    return run


def _merged(spans) -> list[list[int]]:
    merged: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def _n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def contamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Digest of find_contamination: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated when it has hit words and they are a twentieth of its words or more.
    """
    found = find_contamination(docs, items, **options).withColumn("n_hit", _n_hit())
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, with the same columns, without contaminated documents, or (remove = "spans") with all documents but without their hit words.

    What stands between the words that stay does too. Texts without hits stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"unknown removal: {remove}")
    found = find_contamination(docs, items, id_col, text_col, carry=tuple(c for c in docs.columns if c not in (id_col, text_col)), **options)
    if remove == "documents":
        found = found.withColumn("n_hit", _n_hit()).where("not (n_hit > 0 and 20 * n_hit >= n_words)")
        text = F.col("row.text")
    else:
        found = found.mapInArrow(_removed, schema(found.schema["row"], "left string"))
        text = F.col("left")
    source = {id_col: F.col("row.doc_id"), text_col: text}
    return found.select(*[source.get(c, F.col("row")[c]).alias(c) for c in docs.columns])




def _removed(batches):
    for batch in batches:
        left = without_spans(batch.column("row").field("text"), batch.column("spans").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(left, pa.string())], names=["row", "left"])


def without_spans(texts, spans) -> list[str | None]:
    """Texts without the words in their spans; what stood between words stays."""
    out: list[str | None] = []
    column = pa.array(texts, pa.string()) if not isinstance(texts, (pa.Array, pa.ChunkedArray)) else texts
    at, valid = 0, column.is_valid().to_pylist()
    for part in words(column, NON_ALNUM, True):
        for d in range(len(part.bounds) - 1):
            raw = column[at].as_py()
            if not spans[at]:
                out.append(raw if valid[at] else None)
            else:
                body, base, begin, kept = raw.encode(), int(part.offsets[d]), 0, []
                w = int(part.bounds[d])
                for s in spans[at]:
                    kept.append(body[begin : int(part.starts[w + s["start"]]) - base])
                    begin = int(part.ends[w + s["end"] - 1]) - base
                kept.append(body[begin:])
                out.append(b"".join(kept).decode())
            at += 1
    return out
