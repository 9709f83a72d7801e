"""Document fingerprints by winnowing, in DataFrame functions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Units in a k-gram; k-grams in a window (a power of two).
K, WINDOW = 3, 8
#: A word of up to 16 characters is a unit; of a longer one each character begins a unit of up to 8.
UNITS = r"(?=((?<!\S)\S{1,16}(?!\S)|\S{1,8}))(?:(?<!\S)\S{1,16}(?!\S)|\S)"
#: Bytes of text in a block of next_document, and blocks at most: the driver holds 16 bytes for each.
BLOCK_BYTES, BLOCKS = 8 << 20, 100_000
NO_ID = -(1 << 63)


def _slid(a: Column, b: Column, by: int, join) -> Column:
    """join(a[i], b[i + by]) for each i that has both."""
    n = F.greatest(F.size(b) - F.lit(by), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + by), n), join)


def _rolled(h: Column, x: Column) -> Column:
    """Cyclic polynomial: the hash so far, turned by one bit, takes in the next unit."""
    return F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63)).bitwiseXOR(x)


def add_grams(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds <out>, the hashes of the k-grams of a text, one for each place (in units, from 0).

    Units are words (runs of what is not white space) of up to 16 characters; in longer
    words, and so in text without spaces, each character begins a unit of up to 8. The units
    around a place depend on at most 16 characters on either side, at every length of text.
    The hash is a 64-bit rolling one (a cyclic polynomial, grown for all places at once by a
    unit at a time). Fewer units than a k-gram make one k-gram; null is empty, and a text
    without units has none.
    """
    t, c = F.coalesce(F.col(text), F.lit("")), f"__{out}_"
    df = df.withColumn(c + "u", F.transform(F.regexp_extract_all(t, F.lit(UNITS), F.lit(1)), lambda x: F.xxhash64(x)))
    u, grams = F.col(c + "u"), F.col(c + "u")
    for n in range(1, K):
        df = df.withColumn(f"{c}g{n}", _slid(grams, u, n, _rolled))
        grams = F.col(f"{c}g{n}")
    whole = F.when(F.size(u) > 0, F.array(F.aggregate(u, F.lit(0).cast("long"), _rolled))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.when(F.size(u) >= K, grams).otherwise(whole)).drop(c + "u", *[f"{c}g{n}" for n in range(1, K)])


def _minima(df: DataFrame, values: str, lower) -> DataFrame:
    """Turns an array into the lower one of each window of WINDOW neighbours (of all, when they are fewer), by windows of 2, 4 and 8."""
    m, step = F.col(values), 1
    while step < WINDOW:
        few = F.array(F.aggregate(m, F.get(m, F.lit(0)), lower))
        df = df.withColumn(values, F.when(F.size(m) > step, _slid(m, m, step, lower)).when(F.size(m) > 1, few).otherwise(m))
        step *= 2
    return df


def add_hashes(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds <out>, the distinct hashes that winnowing selects, in order of place: of every window of 8 k-grams the smallest."""
    return _minima(add_grams(df, text, out), out, lambda a, b: F.least(a, b)).withColumn(out, F.array_distinct(out))


def add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds <out>, an array of {hash, place}: the selected k-grams of a text in order of place.

    Of every window of 8 k-grams the smallest is selected, the rightmost among equals. Texts
    that share WINDOW + K - 1 units in a row therefore share a selected hash. Fewer k-grams
    than a window make one window.
    """
    grams, at = f"__{out}_h", f"__{out}_at"
    h = F.col(grams)
    df = add_grams(df, text, grams)
    df = df.withColumn(at, F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>")))
    df = _minima(df, at, lambda p, q: F.when(F.get(h, p) < F.get(h, q), p).otherwise(q))
    return df.withColumn(out, F.transform(F.array_distinct(at), lambda p: F.struct(F.get(h, p).alias("hash"), p.cast("long").alias("place")))).drop(grams, at)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of hashes, 1 for two empty ones, 0 when one is missing."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.coalesce(F.when(any_ == 0, F.lit(1.0)).otherwise(both / any_), F.lit(0.0)).cast("double")


def fingerprint_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.hex(x))), " ")


def _block_of(ids: np.ndarray, ties: np.ndarray) -> Column:
    """Block of a row (__id, __o): the last of the starts (by descending id, then tie) that is not after it; a binary search."""
    bid, bo = F.lit(ids), F.lit(ties)
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, len(ids).bit_length()) - 1, -1, -1)])

    def half(lo: Column, step: Column) -> Column:
        at = lo + step
        i, o = F.get(bid, at), F.get(bo, at)
        return F.when((at < len(ids)) & ((i > F.col("__id")) | ((i == F.col("__id")) & (o <= F.col("__o")))), at).otherwise(lo)

    return F.aggregate(steps, F.lit(0), half)


def in_order(df: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows in blocks (__b) that are sorted by descending id; after each block comes a guest (__g = 1), the row that follows its last one.

    lead() over the window order_window() reads the next row; after the last comes the
    first. Rows of one id follow each other by a hash of their text; null ids come last.
    The blocks begin at rows that a hash of id and text picks, as many as there are
    block_bytes of text, so ids may be dense, sparse, repeated or null. The texts are
    shuffled once, by block.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID).cast("long"))
    rows = df.withColumn("__id", key).withColumn("__o", F.xxhash64(text_col))
    keys = rows.select("__id", "__o", F.octet_length(text_col).alias("n"))
    found = keys.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("bytes"), F.min(F.struct((-1 - F.col("__id")).alias("i"), "__o")).alias("first")).first()
    if not found.rows:
        return rows.withColumn("__b", F.lit(0)).withColumn("__g", F.lit(0))
    share = min(1.0, min(BLOCKS, (found.bytes or 0) / block_bytes) / found.rows)
    chance = F.pmod(F.xxhash64("__id", "__o", F.lit("start")), F.lit(1 << 30)) < int(share * (1 << 30))
    starts = {(r["__id"], r["__o"]) for r in keys.where(chance).select("__id", "__o").distinct().toLocalIterator()}
    order = sorted(starts | {(-1 - found["first"]["i"], found["first"]["__o"])}, key=lambda x: (-x[0], x[1]))
    ids, ties = (np.array([x[k] for x in order], np.int64) for k in (0, 1))
    n = len(order)
    rows = rows.withColumn("__b", _block_of(ids, ties))
    begins = (F.get(F.lit(ids), F.col("__b")) == F.col("__id")) & (F.get(F.lit(ties), F.col("__b")) == F.col("__o"))
    to = lambda b, g: F.struct(b.cast("int").alias("b"), F.lit(g).alias("g"))
    own, guest = to(F.col("__b"), 0), to(F.pmod(F.col("__b") - 1, F.lit(n)), 1)
    dealt = rows.withColumn("__to", F.explode(F.when(begins, F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.select(*df.columns, "__id", "__o", F.col("__to.b").alias("__b"), F.col("__to.g").alias("__g"))
    return dealt.repartition("__b").sortWithinPartitions("__b", "__g", F.desc("__id"), "__o")


def order_window():
    return W.partitionBy("__b").orderBy("__g", F.desc("__id"), "__o")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text: id, n_chars, fingerprint (array of {hash, place}), one row per row of df."""
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return add_fingerprint(base.withColumn("n_chars", F.char_length("text").cast("long")), "text", "fingerprint").drop("text")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Compares every text with an edited form of it and with the next document, one row per row of df.

    The edited form has its last floor(n_chars / 3) code points replaced by the first as
    many (or all) of the next document by descending id; after the last comes the first.
    Null text is empty, and an empty text has an empty fingerprint. A single document is its
    own next one. Rows that share an id follow each other by a hash of their text, equal ones
    in any order; null ids come last. Texts of any length are read whole. Other columns of
    df, whatever their names, are not read. An empty table gives no rows. Columns: doc_id,
    n_chars, edited_sha256, fingerprint and edited_fingerprint (hashes in hex, in order of
    place), near_edited, near_next.
    """
    base = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = add_hashes(in_order(base, "doc_id", "text", block_bytes), "text", "fp")
    both = own.withColumn("next_text", F.lead("text").over(order_window())).withColumn("next_fp", F.lead("fp").over(order_window())).where("__g = 0")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - int(floor(char_length(text) / 3)))"), F.expr("substring(coalesce(next_text, text), 1, int(floor(char_length(text) / 3)))"))
    both = both.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fp", F.coalesce("next_fp", "fp").alias("next_fp"), edited.alias("edited"))
    both = add_hashes(both, "edited", "efp")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("fp")).alias("fingerprint"),
        fingerprint_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
