"""MinHash near-duplicates: universal hash minima in bands, full-set verification, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.components import connected_components
from leafmill.llm.joins import join_by_key, with_likely
from leafmill.llm.scratch import Scratch
from leafmill.llm.wordhash import SPACES, mix, ranges, words
from leafmill.llm.worker import tidy

SHINGLE = 5
#: Minima in a band, bands. At a similarity of 0.85 a pair misses all bands with probability 3e-6.
ROWS, BANDS = 8, 40
#: Shingles of a verification block; a larger family is compared block against block.
BLOCK_SHINGLES = 200_000
#: Documents of a verification block: its table of common shingles is square.
BLOCK_DOCS = 1_000


@cache
def _hashes(rows: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors and addends of rows * bands universal hashes, and the factors that make a band's minima one key."""
    rng = np.random.default_rng(20_240_607)
    a = rng.integers(0, 1 << 32, rows * bands, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, rows * bands, dtype=np.uint64).astype(np.uint32)
    return a, b, np.array([pow(0x9E3779B97F4A7C55, i + 1, 1 << 64) for i in range(rows)], np.uint64)


def shingle_sets(texts) -> Iterator[np.ndarray]:
    """Sorted distinct 5-word shingle hashes of each text; with fewer words the whole sequence; none without words."""
    for part in words(texts, SPACES, True):
        windows, _ = part.windows(SHINGLE)
        seeds = part.hashes | np.uint64(1)
        for d in range(len(part.bounds) - 1):
            a, b = int(part.bounds[d]), int(part.bounds[d + 1])
            if b - a >= SHINGLE:
                yield np.unique(windows[a : b - SHINGLE + 1])
            elif b > a:
                yield ranges(seeds[a:b], np.zeros(1, np.int64), np.full(1, b - a)) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def band_keys(shingles: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band of the minima of rows * bands universal hashes."""
    a, b, powers = _hashes(rows, bands)
    low = np.full(rows * bands, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    for at in range(0, len(x), 1024):
        h = x[at : at + 1024] * a
        h += b
        np.minimum(low, h.min(axis=0), out=low)
    minima = low.reshape(bands, rows).astype(np.uint64)
    return mix((minima + np.uint64(1)) @ powers + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signed(rows: int, bands: int):
    @tidy
    def run(batches):
        for batch in batches:
            n, digests, keys = [], [], []
            for s in shingle_sets(batch.column("text")):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(s, rows, bands).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "h", "n_shingles", "class", "bands"])

    return run


_PLACE = ("fam", "bi", "bj", "id", "h")


@tidy
def _with_sets(batches):
    """Shingle sets of rows; of equal rows, which the join has put side by side, one for each place."""
    text, places = None, set()
    for batch in batches:
        keep = []
        for k, (fam, bi, bj, doc, h) in enumerate(zip(*(batch.column(c).to_pylist() for c in _PLACE), strict=True)):
            if (doc, h) != text:
                text, places = (doc, h), set()
            if (fam, bi, bj) not in places:
                places.add((fam, bi, bj))
                keep.append(k)
        batch = batch.take(pa.array(keep, pa.int64()))
        sets = [s.tobytes() for s in shingle_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PLACE), pa.array(sets, pa.binary())], names=[*_PLACE, "hashes"])


def _forest(ids: np.ndarray, sets: list[np.ndarray], over: int, of: int) -> list[tuple[int, int]]:
    """Links of a forest that joins all documents linked in this group: over * |A and B| >= of * |A or B|."""
    m = len(ids)
    sizes = np.array([len(s) for s in sets], np.float64)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(m), sizes.astype(np.int64))
    shared = np.bincount(place, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    hit = shared[place]
    doc, place = doc[hit], column[place[hit]]
    order = np.argsort(place, kind="stable")
    doc, place = doc[order], place[order]
    common = np.zeros((m, m), np.float32)
    width = max(1, min(4096, (1 << 22) // m))
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(place, (at, at + width))
        table = np.zeros((m, width), np.float32)
        table[doc[lo:hi], place[lo:hi] - at] = 1
        common += table @ table.T
    linked = over * common.astype(np.float64) >= of * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(linked, False)
    links, todo = [], np.ones(m, dtype=bool)
    for root in np.argsort(ids, kind="stable"):
        if not todo[root]:
            continue
        todo[root] = False
        front = [root]
        while front:
            near = np.flatnonzero(linked[front.pop()] & todo)
            todo[near] = False
            front.extend(near.tolist())
            links += [(int(ids[k]), int(ids[root])) for k in near]
    return links


def _verified(over: int, of: int):
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, sets, text = None, [], [], None

        def ended():
            got = _forest(np.array(ids), sets, over, of) if len(ids) > 1 else []
            return pd.DataFrame(got, columns=["src", "dst"])

        for batch in batches:
            for fam, bi, bj, doc, h, raw in zip(*(batch[c] for c in _PLACE), batch["hashes"], strict=True):
                if (fam, bi, bj) != key:
                    if len(ids) > 1:
                        yield ended()
                    key, ids, sets, text = (fam, bi, bj), [], [], None
                if (doc, h) == text:  # an equal row, from another task
                    continue
                text = (doc, h)
                ids.append(doc)
                sets.append(np.frombuffer(raw, np.uint64))
        if len(ids) > 1:
            yield ended()

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", over: int = 100, of: int = 85, block_shingles: int = BLOCK_SHINGLES, block_docs: int = BLOCK_DOCS, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Groups of near-duplicates: doc_id, n_shingles, component_id, kept, one row per row of df.

    Documents are linked when over * |A and B| >= of * |A or B| for their shingle sets (100
    and 85: a Jaccard similarity of 0.85). Equal sets are one class, of which only the
    smallest id goes on. Classes that share the rows minima of one of the bands are joined to families by
    large-star and small-star; in each family every pair is verified on its full sets, the
    large families block against block, and each block pair sends on only a forest of the
    links it found. Components of these links are the result. component_id is the smallest
    id reachable; kept marks it.

    Null and empty texts, and texts without words, have no shingles and are linked with
    nothing; texts of any length are read whole. Ids are integers. Rows that repeat an id
    are one document of several texts: they get one component, to which each of the texts
    links. Null ids are dropped. An empty table gives no rows. Other columns of df, whatever
    their names, are not read.
    """
    scratch = Scratch(df.sparkSession, "neardup")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null").withColumn("h", F.xxhash64("text"))
    signed, total = scratch.keep_counted(docs.mapInArrow(_signed(rows, bands), "id long, h long, n_shingles long, class binary, bands array<long>"), "signed")
    full = signed.where("class is not null")
    classes = scratch.keep(full.groupBy("class").agg(F.min(F.struct("id", "h")).alias("r"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")).select("class", F.col("r.id").alias("rep"), "r.h", "copies", "n", "bands"), "classes")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    family = connected_components(banded.join(buckets.hint("merge"), "key").where("rep <> head").select("rep", "head"), scratch, "rep", "head")

    member = family.join(classes.select(F.col("rep").alias("node"), "h", "n"), "node").select("node", "h", F.col("component").alias("fam"), "n")
    member = scratch.keep(member, "members")
    blocks = member.groupBy("fam").agg(F.ceil(F.greatest(F.sum("n") / F.lit(block_shingles), F.count(F.lit(1)) / F.lit(block_docs))).cast("int").alias("blocks"))
    placed = member.join(blocks, "fam").withColumn("block", F.pmod(F.xxhash64("node", "h"), F.col("blocks")).cast("int"))
    placed = placed.select(F.col("node").alias("id"), "h", "fam", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "block")
    placed = placed.select("id", "h", "fam", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    # a class is verified by one text: that of its smallest id
    likely = with_likely(docs, member.select(F.col("node").alias("id"), "h"), ["id", "h"], "likely").where("likely")
    wanted = likely.join(placed.hint("merge"), ["id", "h"]).select(*_PLACE, "text")
    sets = wanted.mapInArrow(_with_sets, "fam long, bi int, bj int, id long, h long, hashes binary")
    groups = sets.repartition("fam", "bi", "bj").sortWithinPartitions(*_PLACE)
    links = groups.mapInPandas(_verified(over, of), "src long, dst long")

    # an id of several texts links the classes of all of them
    several = scratch.keep(signed.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("class").alias("c")).where("lo <> hi or c between 1 and n - 1").select("id", "n"), "several")
    own = join_by_key(full.select("id", "class"), several, ["id"], total).distinct().join(classes.select("class", "rep"), "class").where("id <> rep")
    joined = scratch.keep(connected_components(links.unionByName(own.select(F.col("id").alias("src"), F.col("rep").alias("dst"))), scratch), "joined")

    label = classes.select("class", "rep", F.col("copies").alias("n")).join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("class", F.coalesce("component", "rep").alias("c"), "n")
    out = join_by_key(full.select("id", "n_shingles", "class"), scratch.keep(label, "labels"), ["class"], total).select("id", "n_shingles", "c")
    bare = signed.where("class is null").join(joined.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left").select("id", "n_shingles", F.coalesce("c", "id").alias("c"))
    out = out.unionByName(bare)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("c").alias("component_id")).withColumn("kept", F.expr("doc_id = component_id"))
