"""Phrase collocation mining: word-id n-grams in counting quotient filters that are merged by quotient."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.scratch import Scratch
from leafmill.llm.wordhash import mix
from leafmill.llm.worker import release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text of a shard, in bytes: a worker holds the ids of its words.
SHARD_BYTES = 32 << 20
#: n-grams of a bucket of quotients: a worker holds one bucket while it merges.
BUCKET = 1 << 19
#: Different words, and n-grams, that a worker holds before it sends them on.
HELD_WORDS, HELD_GRAMS = 300_000, 600_000
#: Text that is cut to words at a time, in bytes; words that are packed at a time.
SLICE, STRETCH = 1 << 20, 100_000
#: Words are numbered in parts of about so many.
PART = 100_000

# [.,;:!?\x0A-\x0D] end a piece, and become a byte that UTF-8 never has; a tab is a space.
_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t" + UPPER.encode(), b"\xff" * 10 + b" " + LOWER.encode())
_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_FILTER = "bucket long, q int, runs binary, rest binary, counts binary, large binary"


def tokens(text: str) -> Iterator[list[bytes]]:
    """Words and ends of pieces (a byte 0xFF) of a text, a slice at a time."""
    data = text.encode().translate(_CUT)
    at = 0
    while at < len(data):
        to = at + SLICE
        if to < len(data):
            cut = max(data.rfind(b" ", at, to), data.rfind(b"\xff", at, to))
            to = cut + 1 if cut >= 0 else min(x for x in (data.find(b" ", to), data.find(b"\xff", to), len(data)) if x >= 0)
        yield data[at:to].replace(b"\xff", b" \xff ").split(b" ")
        at = to


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, lang, word and n of the words of each shard."""
    release()
    held: dict[tuple, Counter] = {}

    def sent():
        for (shard, lang), found in held.items():
            found.pop(b"", None)
            found.pop(b"\xff", None)
            words = pa.array(list(found), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(shard, pa.int64()), len(found)), pa.repeat(pa.scalar(lang, pa.string()), len(found)), words, pa.array(found.values(), pa.int64())], names=["shard", "lang", "word", "n"])
        held.clear()

    for batch in batches:
        for shard, lang, text in zip(batch.column("shard").to_pylist(), batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for part in tokens(text.as_py()):
                held.setdefault((shard, lang), Counter()).update(part)
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from sent()
    yield from sent()


class Packing:
    """n-grams of two or three word ids of b bits as one number in two halves, and an invertible permutation of these.

    A missing third id is 0. Three rounds change each half by a function of the other, so
    every number of 3b bits has one image, from which it is got back. The top bits of the
    image are the bucket, the next ones the quotient; all the others are kept as the
    remainder: nothing is lost.
    """

    def __init__(self, bits: int, bucket_bits: int):
        self.b, self.low, self.high = bits, 3 * bits // 2, 3 * bits - 3 * bits // 2
        self.bucket_bits = min(bucket_bits, self.high)
        self.narrow = 3 * bits <= 64

    def _mask(self, n: int) -> np.uint64:
        return np.uint64((1 << n) - 1)

    def permuted(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, split = np.uint64, self.low - self.b
        low = z | ((y & self._mask(split)) << u(self.b))
        high = (y >> u(split)) | (x << u(self.b - split))
        for r in _ROUNDS:
            high = high ^ (mix(low + u(r)) & self._mask(self.high))
            low = low ^ (mix(high ^ u(r)) & self._mask(self.low))
        return high, low

    def restored(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, split = np.uint64, self.low - self.b
        for r in reversed(_ROUNDS):
            low = low ^ (mix(high ^ u(r)) & self._mask(self.low))
            high = high ^ (mix(low + u(r)) & self._mask(self.high))
        y = ((high & self._mask(self.b - split)) << u(split)) | (low >> u(self.b))
        return high >> u(self.b - split), y, low & self._mask(self.b)

    def summed(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each number once, in order, with the sum of its counts (None: ones)."""
        if not len(high):
            return high, low, np.zeros(0, np.int64)
        if self.narrow and counts is None:
            key, n = np.unique((high << np.uint64(self.low)) | low, return_counts=True)
            return key >> np.uint64(self.low), key & self._mask(self.low), n
        order = np.argsort((high << np.uint64(self.low)) | low) if self.narrow else np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
        n = np.diff(np.append(new, len(high))) if counts is None else np.add.reduceat(counts[order], new)
        return high[new], low[new], n

    def filters(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """A row for each bucket: lengths of the runs of each quotient, the remainders in order, a byte for each counter (255: see large)."""
        below = self.high - self.bucket_bits
        bucket = high >> np.uint64(below)
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(high)) if len(high) else np.zeros(1, np.int64)
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            q = min(below, max(0, int(b - a).bit_length() - 1))
            left = below - q
            runs = np.bincount(((high[a:b] >> np.uint64(left)) & self._mask(q)).astype(np.int64), minlength=1 << q)
            runs = runs.astype(np.uint8 if runs.max() < 256 else np.uint32)
            rest = self._packed(high[a:b] & self._mask(left), low[a:b], left)
            n = counts[a:b]
            rows.append((int(bucket[a]), q, runs.tobytes(), rest.tobytes(), np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype(np.int64).tobytes()))
        kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "q", "runs", "rest", "counts", "large"])

    def read(self, bucket: int, q: int, runs: bytes, rest: bytes, counts: bytes, large: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers and counts of a filter."""
        below = self.high - self.bucket_bits
        left = below - q
        lengths = np.frombuffer(runs, np.uint8 if len(runs) == 1 << q else np.uint32)
        quotients = np.repeat(np.arange(1 << q, dtype=np.uint64), lengths)
        n = np.frombuffer(counts, np.uint8).astype(np.int64)
        n[n == 255] = np.frombuffer(large, np.int64)
        end, low = self._unpacked(np.frombuffer(rest, np.uint8).reshape(len(n), -1), left)
        return (np.uint64(bucket) << np.uint64(below)) | (quotients << np.uint64(left)) | end, low, n

    def _packed(self, end: np.ndarray, low: np.ndarray, left: int) -> np.ndarray:
        """Remainders as rows of bytes: what is left of the high half, then the low one, in one number if it has the room."""
        if left + self.low <= 64:
            return _bytes((end << np.uint64(self.low)) | low, left + self.low)
        return np.concatenate([_bytes(end, left), _bytes(low, self.low)], axis=1)

    def _unpacked(self, raw: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray]:
        if left + self.low <= 64:
            both = _number(raw)
            return both >> np.uint64(self.low), both & self._mask(self.low)
        width = -(-left // 8)
        return _number(raw[:, :width]), _number(raw[:, width:])


def _bytes(x: np.ndarray, bits: int) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8)[:, : -(-bits // 8)]


def _number(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view(np.uint64).ravel()


def _counted(packing: Packing):
    """Filters of the n-grams of each shard: the ids of its words come first, then its texts."""

    def run(batches):
        release()
        ids: dict[str, dict[bytes, int]] = {}
        shard, row = None, [0, 0]
        held: list[tuple] = []

        def grams(found: np.ndarray):
            """n-grams that begin before the last two."""
            x, y, z = found[:-2], found[1:-1], found[2:]
            two = (x > 0) & (y > 0)
            three = two & (z > 0)
            parts = [packing.permuted(x[two], y[two], np.zeros(int(two.sum()), np.uint64)), packing.permuted(x[three], y[three], z[three])]
            return packing.summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), None)

        def one():
            held[:] = [packing.summed(*(np.concatenate(x) for x in zip(*held, strict=True)))] if held else []

        def full():
            """Filters to send on: when merging has left more than half of what may be held."""
            if sum(len(h[0]) for h in held) > HELD_GRAMS:
                one()
                if len(held[0][0]) > HELD_GRAMS // 2:
                    yield packing.filters(*held.pop())

        for batch in batches:
            for at, kind, lang, text, number in zip(*(batch.column(c) for c in ("shard", "kind", "lang", "text", "id")), strict=True):
                at, kind, lang, number = at.as_py(), kind.as_py(), lang.as_py(), number.as_py()
                if at != shard:
                    ids, shard = {}, at
                if kind == 0:
                    ids.setdefault(lang, {})[text.as_py().encode()] = number
                    continue
                get = ids.get(lang, {}).get
                for part in tokens(text.as_py()):
                    row += [get(w, 0) for w in part if w]  # 0: an end, or a word of no candidate
                    if len(row) > STRETCH:
                        held.append(grams(np.array(row, np.uint64)))
                        row = row[-2:]
                        yield from full()
                row += [0, 0]
        held.append(grams(np.array(row + [0, 0], np.uint64)))
        one()
        if held:
            yield packing.filters(*held.pop())

    return run


def _merged(packing: Packing, least: int):
    """Merges the filters of each bucket and gives the n-grams that are frequent enough."""

    def run(batches):
        release()
        bucket, held, size = None, [], 0

        def one():
            held[:] = [packing.summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]

        def ended():
            one()
            high, low, n = held.pop()
            often = n >= least
            x, y, z = packing.restored(high[often], low[often])
            return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (x, y, z)] + [pa.array(n[often])], names=["x", "y", "z", "a"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = [c[k].as_py() for c in batch.columns]
                if row[0] != bucket:
                    if held:
                        yield ended()
                    bucket, held, size = row[0], [], 0
                held.append(packing.read(*row))
                size += len(held[-1][2])
                if size > 2 * BUCKET and len(held) > 1:
                    one()
                    size = len(held[0][2]) // 2  # merges again when as much has come
        if held:
            yield ended()

    return run


def _numbered(words: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """words with ids from 1, without a gap: numbers within parts, and what the parts before hold."""
    parts = max(1, -(-n // PART))
    words = words.withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(parts)))
    sizes = {r.part: r.n for r in words.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = np.cumsum([0, *(sizes.get(p, 0) for p in range(parts))]).tolist()
    number = F.row_number().over(W.partitionBy("part").orderBy("lang", "word"))
    starts = words.sparkSession.createDataFrame(list(enumerate(before[:-1])), "part long, start long")
    return scratch.keep(words.withColumn("k", number).join(F.broadcast(starts), "part").select("lang", "word", "n", (F.col("start") + F.col("k")).alias("id")), "words")


def mine_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, inside: int = 50, top: int = 2000, shard_bytes: int = SHARD_BYTES, bucket: int = BUCKET) -> DataFrame:
    """The first phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts, with A-Z lower-cased, are cut to pieces at [.,;:!?] and line ends, these to words
    at spaces and tabs. A phrase with a >= least occurrences is a candidate. Its score is the
    lowest, over its cuts in two, of floor(1000000 * a * a / (l * r)), where l and r count
    the parts (of equal scores, the shortest first part). Candidates inside a longer one that
    has inside percent of their occurrences or more are dropped. n: words of the language.

    Texts are dealt to shards of bounded size. Words that occur least times are numbered,
    and each shard meets the ids of its own words. n-grams are packed ids; an invertible
    permutation makes them a quotient and a remainder, and a shard's counting quotient
    filter holds them with their counts. Filters are shuffled by ranges of quotients and
    merged; nothing is broadcast but where the numbers of 100,000 words begin.

    Null texts are empty, null languages are "und"; an empty language is a language. Equal
    rows count each. Texts of any length are cut in slices, and n-grams run over the cuts.
    An empty table, and one without candidates, gives no rows. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "phrases")
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    total = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    # texts stay where they are: a shard is a run of neighbours of about shard_bytes
    run = max(1, total.rows * shard_bytes // max(1, total.bytes or 0))
    dealt = docs.withColumn("shard", F.expr(f"monotonically_increasing_id() div {run}"))
    dealt = scratch.keep(dealt, "dealt")
    pairs = scratch.keep(dealt.mapInArrow(_words_of, "shard long, lang string, word string, n long"), "pairs")

    counted = scratch.keep(pairs.groupBy("lang", "word").agg(F.sum("n").alias("n")), "counted")
    sizes = scratch.keep(counted.groupBy("lang").agg(F.sum("n").alias("n"), F.count_if(F.col("n") >= least).alias("often")), "sizes")
    both = sizes.agg(F.sum("n").alias("n"), F.sum("often").alias("often")).first()
    often, n_words = both.often or 0, both.n or 0
    words = _numbered(counted.where(F.col("n") >= least), scratch, often)

    packing = Packing(max(2, often.bit_length()), max(0, (2 * n_words // bucket).bit_length()))
    own = pairs.select("shard", "lang", "word").join(words, ["lang", "word"]).select("shard", F.lit(0).alias("kind"), "lang", F.col("word").alias("text"), "id")
    rows = own.unionByName(dealt.select("shard", F.lit(1).alias("kind"), "lang", "text", F.lit(0).cast("long").alias("id")))
    filters = rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_counted(packing), _FILTER)
    merged = filters.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merged(packing, least), "x long, y long, z long, a long")
    found = scratch.keep(merged, "found")
    for table in (dealt, pairs, counted):
        scratch.drop(table)
    return _ranked(found, words, sizes, inside, top)


def _ranked(found: DataFrame, words: DataFrame, sizes: DataFrame, inside: int, top: int) -> DataFrame:
    two = found.where("z = 0").select("x", "y", "a")
    three = found.where("z > 0")
    part = lambda x, y, f: two.select(F.col("x").alias(x), F.col("y").alias(y), F.col("a").alias(f))
    three = three.join(part("x", "y", "head"), ["x", "y"]).join(part("y", "z", "rest"), ["y", "z"])
    ends = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("z").alias("y"))))
    longer = three.select(ends.alias("p"), "a").groupBy("p.x", "p.y").agg(F.max("a").alias("longest"))
    two = two.join(longer, ["x", "y"], "left").where(F.expr(f"longest is null or 100 * longest < {inside} * a"))

    word = lambda key, name, count: words.select(F.col("id").alias(key), F.col("word").alias(name), F.col("n").alias(count))
    first = words.select(F.col("id").alias("x"), F.col("word").alias("w1"), F.col("n").alias("n1"), "lang")
    score = lambda left, right: F.expr(f"cast(1000000 as decimal(38,0)) * a * a div (cast({left} as decimal(38,0)) * {right})")
    two = two.join(first, "x").join(word("y", "w2", "n2"), "y").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"), score("n1", "n2").alias("score"))
    three = three.join(first, "x").join(word("y", "w2", "n2"), "y").join(word("z", "w3", "n3"), "z")
    three = three.withColumn("s1", score("n1", "rest")).withColumn("s2", score("head", "n3"))
    pick = lambda a, b: F.when(F.col("s1") <= F.col("s2"), F.col(a)).otherwise(F.col(b))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("n1", "head").alias("l"), pick("rest", "n3").alias("r"), F.least("s1", "s2").alias("score"))

    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = two.unionByName(three).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    # the first of a language are among the first of each of its 256 parts
    near = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt")
    best = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = best.join(sizes.select("lang", "n"), "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
