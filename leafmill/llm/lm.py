"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(a | history) * P(b | a, history) * P(leaf | class (a, b), history) * share
of the word in its leaf. The first three factors, and a fourth for the leaves of rarer words, are
softmaxes over 32 branches, of the sum of weight rows that hashed features of the history pick:
the last word, the last two, and the one before the last (a skip). The 1,024 classes hold every
word of the corpus: the frequent ones are dealt by rank, so that each class has one of the 1,024
most frequent, all others by hash. In its class each of the 24 words by rank has a leaf of its
own; the others have 8 leaves, by hash, and 32 leaves in each of these. A word's share is that of
its smoothed count. What the counts leave to words never met is a share of the class.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.joins import join_by_key
from leafmill.llm.schemas import schema
from leafmill.llm.scratch import Scratch
from leafmill.llm.wordhash import SPACES, mix, words
from leafmill.llm.worker import release

#: Branches of each level, and classes.
WIDTH = 32
CLASSES = WIDTH**2
#: Words dealt to classes by rank, and leaves of all others: of a class, and in all.
RANKED, REST = 24 * CLASSES, WIDTH - 24
ENDS = CLASSES * REST * WIDTH
#: Features that each level reads: 0 the last word, 1 the last two, 2 the one before the last.
READS = ((0, 1, 2),) * 4
#: Rows of a level's weight table at least, training tokens for a row, and rows for each unit of their root where that is less.
LEAST_ROWS, TOKENS_A_ROW, ROOT_ROWS = 1 << 10, 4000, 3
#: The last level, which only rarer words reach, has so many times fewer rows.
LAST = 4
#: Partitions of shards at most: beyond, a task goes through several shards, one after the other.
MOST_PARTITIONS = 4096
#: Training tokens of a shard, for each row.
SHARD_TOKENS = 128
#: Words that the broadcast table of counts holds at most; the rest is joined.
HEAD = 200_000
RATE, BATCH = 0.2, 4096
#: Rows of a weight table sent together to be averaged.
BLOCK = 1 << 11

_M = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
END = np.uint64(0x2545F4914F6CDD1D)
START = np.uint64(0x94D049BB133111EB)
SLOT_BITS = 22
_ONES = np.ones(WIDTH, np.float32)
#: Bound of a weight: the exponential of a sum of some of them still is a number.
LARGEST = np.float32(20)


def tokens(column):
    """(first document, tokens, bounds) of runs of texts: word hashes, each text closed by END."""
    for part in words(column, SPACES, True):
        n = np.diff(part.bounds)
        bounds = np.concatenate(([0], np.cumsum(n + 1)))
        out = np.full(int(bounds[-1]), END, np.uint64)
        out[np.arange(len(part.hashes)) + part.owners()] = part.hashes
        yield part.first, out, bounds


def histories(tok: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the last word, the last two and the one before the last, for each token."""
    one, two = np.roll(tok, 1), np.roll(tok, 2)
    first = bounds[:-1]
    one[first] = START
    two[first] = START
    second = first[np.diff(bounds) > 1] + 1
    two[second] = START
    return mix(one * _M[0]), mix(one * _M[1] + (two << np.uint64(1))), mix(two * _M[2])


class Head:
    """The most frequent words: count of a token or 0, and its place by rank or -1."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.lexsort((keys, -counts))
        self.keys, self.counts = keys[order], counts[order]
        slot = (self.keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        self.table = np.full(1 << SLOT_BITS, -1, np.int32)
        self.table[slot[first]] = first
        rest = np.setdiff1d(np.arange(len(self.keys)), first)
        self.rest = rest[np.argsort(self.keys[rest])]

    def __getstate__(self):
        return self.keys, self.counts

    def __setstate__(self, state):
        self.__init__(*state)

    def rank(self, tok: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(tok), -1)
        at = self.table[tok >> np.uint64(64 - SLOT_BITS)].astype(np.int64)
        good = (at >= 0) & (self.keys[at] == tok)
        lost = np.flatnonzero((at >= 0) & ~good)
        at[~good] = -1
        if len(lost) and len(self.rest):
            keys = self.keys[self.rest]
            place = np.minimum(np.searchsorted(keys, tok[lost]), len(keys) - 1)
            same = keys[place] == tok[lost]
            at[lost[same]] = self.rest[place[same]]
        return at


def classes(rank: np.ndarray, tok: np.ndarray) -> np.ndarray:
    """Class of each token, by its rank or its hash."""
    return np.where((rank >= 0) & (rank < RANKED), rank % CLASSES, tok.view(np.int64) % CLASSES)


def leaves(rank: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf of each token in its class, and the leaf in that one, which counts for words that are not dealt by rank."""
    low = tok.view(np.int64) % ENDS
    return np.where((rank >= 0) & (rank < RANKED), rank // CLASSES, RANKED // CLASSES + low // CLASSES % REST), low // (CLASSES * REST)


def table_rows(total: int) -> int:
    """Rows of a weight table after total training tokens, a power of two: in proportion to them, later to their root, without an end."""
    return max(LEAST_ROWS, 1 << min(total // TOKENS_A_ROW, ROOT_ROWS * math.isqrt(total)).bit_length())


def _sorted(i: np.ndarray) -> np.ndarray:
    """Order of row numbers, by radix sorts of 16 bits."""
    if i.dtype == np.uint16:
        return np.argsort(i, kind="stable")
    order = np.argsort(i.astype(np.uint16), kind="stable")
    return order[np.argsort((i[order] >> np.uint32(16)).astype(np.uint16), kind="stable")]


def _sums(grad: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the rows of grad by runs of order, which go from the longest to the shortest: by places in the runs while many have one, then run by run."""
    out = grad.take(order.take(first), 0)
    for j in range(1, n[0]):
        k = np.count_nonzero(n > j)
        if k < 24:
            for g in range(k):
                out[g] += grad.take(order[first[g] + j : first[g] + n[g]], 0).sum(0)
            break
        out[:k] += grad.take(order.take(first[:k] + j), 0)
    return out


class Model:
    """Weights: a bias table and a table of rows for each level; and what the words of a class and of a leaf add up to."""

    def __init__(self, mass: np.ndarray, rows: int, ends: np.ndarray | None = None, ranked: np.ndarray | None = None):
        """mass: smoothed counts by class; ranked: those of the words dealt by rank, by leaf and class; ends: those of the others, by their hash modulo ENDS. Without these two there are classes only."""
        self.mass = mass
        whole = np.zeros((WIDTH, WIDTH))
        whole[np.arange(CLASSES) % WIDTH, np.arange(CLASSES) // WIDTH] = mass

        def log(x: np.ndarray) -> np.ndarray:
            total = x.sum(-1, keepdims=True)
            with np.errstate(divide="ignore"):  # a branch without words
                return np.where(total > 0, np.log(x / np.where(total > 0, total, 1)), 0).astype(np.float32)

        self.bias = [log(whole.sum(1))[None, :], log(whole)]
        if ends is not None:
            self.ends = ends.reshape(WIDTH, CLASSES * REST).T
            self.leaves = np.concatenate((ranked, self.ends.sum(1).reshape(REST, CLASSES))).T
            self.bias += [log(self.leaves), log(self.ends)]
        self.rows = rows
        self.weights = [np.zeros((rows // (LAST if level == 3 else 1), WIDTH), np.float32) for level in range(len(READS))]

    def step(self, cls: np.ndarray, feats: tuple[np.ndarray, ...], learn: float | None = None, seen=None) -> np.ndarray | None:
        """Natural log of the probability of each token's class; learn: the rate, to update the weights instead."""
        path = (cls % WIDTH, cls // WIDTH)
        out = [self._level(level, node, own, feats, learn, seen) for level, (node, own) in enumerate(zip((np.zeros(len(cls), np.int64), path[0]), path, strict=True))]
        return None if learn is not None else np.log(out[0] * out[1])

    def within(self, cls: np.ndarray, leaf: np.ndarray, last: np.ndarray, feats: tuple[np.ndarray, ...], learn: float | None = None, seen=None) -> np.ndarray | None:
        """Natural log of the probability of each token's last leaf in its class, if it is one of the words met; learn as in step."""
        out = self._level(2, cls, leaf, feats, learn, seen)
        rare = np.flatnonzero(leaf >= RANKED // CLASSES)
        if len(rare):
            node = cls[rare] + CLASSES * (leaf[rare] - RANKED // CLASSES)
            more = self._level(3, node, last[rare], tuple(f[rare] for f in feats), learn, seen)
            if learn is None:
                out[rare] *= more
        return None if learn is not None else np.log(out)

    def known(self, cls: np.ndarray, leaf: np.ndarray, last: np.ndarray) -> np.ndarray:
        """log10 of what the words met have of each token's class, over what those of its last leaf add up to."""
        rare = leaf >= RANKED // CLASSES
        of = np.where(rare, self.ends[np.where(rare, cls + CLASSES * (leaf - RANKED // CLASSES), 0), last], self.leaves[cls, leaf])
        return np.log10(np.maximum(self.leaves.sum(1), 1e-30))[cls] - np.log10(np.maximum(of, 1e-30))

    def _level(self, level: int, node: np.ndarray, own: np.ndarray, feats: tuple[np.ndarray, ...], learn: float | None, seen) -> np.ndarray | None:
        """Probability of each token's own branch of its node; learn: the rate, to update the weights instead."""
        table = self.weights[level]
        mask, kind = np.uint64(len(table) - 1), np.uint16 if len(table) <= 1 << 16 else np.uint32
        salt = (node.astype(np.uint64) + np.uint64(level)) * _M[1]
        idx = [((mix(feats[k] + salt) if level else feats[k]) & mask).astype(kind) for k in READS[level]]
        at = np.arange(len(own))
        z = self.bias[level].take(node, 0)
        for i in idx:
            z += table.take(i, 0)
        np.exp(z, out=z)
        total = z @ _ONES
        if learn is None:
            return np.maximum(z[at, own] / total, 1e-30).astype(np.float64)
        z /= total[:, None]
        z[at, own] -= 1
        self._update(table, idx, z, learn, seen[level])
        return None

    @staticmethod
    def _update(table: np.ndarray, idx: list[np.ndarray], grad: np.ndarray, rate: float, seen: np.ndarray) -> None:
        for i in idx:
            order = _sorted(i)
            rows = i[order]
            first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            n = np.diff(np.append(first, len(rows)))
            longest = np.argsort((BATCH - n).astype(np.uint16), kind="stable")
            first, n = first[longest], n[longest]
            rows = rows[first]
            change = _sums(grad, order, first, n)
            change *= (-rate / np.sqrt(n))[:, None].astype(np.float32)
            change += table.take(rows, 0)
            table[rows] = np.clip(change, -LARGEST, LARGEST, out=change)
            seen[rows] += n


def _batches(column, size: int = BATCH):
    for first, tok, bounds in tokens(column):
        feats = histories(tok, bounds)
        yield first, tok, bounds, feats


def _count(batches):
    """Counts of tokens, summed over a few runs of texts before they go to Spark."""
    release()
    held, size = [], 0

    def summed():
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "c"])

    for batch in batches:
        for _, tok, _ in tokens(batch.column("text")):
            held.append(tok)
            size += len(tok)
            if size > 2_000_000:
                yield summed()
                held, size = [], 0
    if held:
        yield summed()


def _learned(head, start):
    """A pass of gradient updates over each shard's texts, from weights of zero; sends each weight row times its use.

    Shards come one after the other, their texts in order of a hash. Tokens are taken in
    batches of one size, wherever the texts and the partitions end, so that a shard's
    changes depend on nothing but its texts.
    """

    def run(batches):
        release()
        words_ = head.value
        model = seen = shard = None
        held: list[tuple] = []

        def train(last: bool) -> None:
            cls, leaf, last_leaf, *feats = (np.concatenate(x) for x in zip(*held, strict=True))
            full = len(cls) if last else len(cls) // BATCH * BATCH
            for at in range(0, full, BATCH):
                s = slice(at, min(at + BATCH, full))
                now = tuple(f[s] for f in feats)
                model.step(cls[s], now, RATE, seen)
                model.within(cls[s], leaf[s], last_leaf[s], now, RATE, seen)
            held[:] = [tuple(x[full:] for x in (cls, leaf, last_leaf, *feats))]

        def ended():
            train(True)
            for level, (now, n) in enumerate(zip(model.weights, seen, strict=True)):
                for b in range(0, len(now), BLOCK):
                    times = n[b : b + BLOCK, None]
                    change = np.concatenate((now[b : b + BLOCK] * times, times), 1).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([level], pa.int32()), pa.array([b], pa.int32()), pa.array([change.tobytes()], pa.binary())], names=["shard", "kind", "block", "change"])

        for batch in batches:
            shards = np.array(batch.column("shard").to_pylist(), np.int64)
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)] if len(shards) else []
            for a, b in zip(edges, edges[1:], strict=False):
                if shards[a] != shard:
                    if shard is not None:
                        yield from ended()
                    shard, held = int(shards[a]), []
                    model = Model(*start.value)
                    seen = [np.zeros(len(w), np.float32) for w in model.weights]
                for _, tok, _, feats in _batches(batch.column("text").slice(a, b - a)):
                    rank = words_.rank(tok)
                    held.append((classes(rank, tok), *leaves(rank, tok), *feats))
                    if sum(len(x[0]) for x in held) > 1 << 16:
                        train(False)
        if shard is not None:
            yield from ended()

    return run


def _sum_blocks(keys: list[str]):
    """Sum of changes, in order of their first shard."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        total = np.frombuffer(group["change"].iloc[0], np.float32).astype(np.float32)
        for raw in group["change"].iloc[1:]:
            total = total + np.frombuffer(raw, np.float32)
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], **{k: [group[k].iloc[0]] for k in keys}, "change": [total.tobytes()]})

    return run


def _scored(head, model):
    def run(batches):
        words_, held = head.value, model.value
        logs, mass = np.log10(words_.counts + 0.5), np.log10(held.mass)
        for batch in batches:
            n_docs = batch.num_rows
            n, known, base, score = (np.zeros(n_docs) for _ in range(4))
            tails = []
            for first, tok, bounds, feats in _batches(batch.column("text")):
                rank = words_.rank(tok)
                cls, (leaf, last) = classes(rank, tok), leaves(rank, tok)
                p, more = np.zeros(len(tok)), np.zeros(len(tok))
                for a in range(0, len(tok), BATCH):
                    s = slice(a, a + BATCH)
                    now = tuple(f[s] for f in feats)
                    p[s], more[s] = held.step(cls[s], now), held.within(cls[s], leaf[s], last[s], now)
                p /= math.log(10)
                more = more / math.log(10) + held.known(cls, leaf, last)
                inside = rank >= 0
                lg = np.zeros(len(tok))
                lg[inside] = logs[rank[inside]]
                p += lg - mass[cls] + np.where(inside, more, 0)
                here = slice(first, first + len(bounds) - 1)
                add = lambda x, b=bounds: np.add.reduceat(x, b[:-1])
                n[here], known[here], base[here], score[here] = np.diff(bounds), add(inside.astype(float)), add(lg), add(p)
                out = np.concatenate(([0], np.cumsum(~inside)))[bounds]
                tails.append((out, tok[~inside].view(np.int64), more[~inside].astype(np.float32)))
            ends = np.concatenate([[0], *(np.diff(o) for o, *_ in tails)]).cumsum()
            values = [np.concatenate([t[k] for t in tails]) if tails else np.zeros(0, kind) for k, kind in ((1, np.int64), (2, np.float32))]
            tail = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in values], names=["h", "more"]))
            yield pa.RecordBatch.from_arrays([batch.column("keys"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), tail], names=["keys", "n_tokens", "known", "base", "score", "tail"])

    return run


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD) -> DataFrame:
    """Trains on the texts whose crc32(id as text) mod 5 is not 1 and scores all of them.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10
    of the text's probability under the model), one row per row of df.

    Counts cover all training texts. The head_words most frequent words go to every task;
    other tokens are joined with the counts. Training is one pass over all training texts,
    in shards by a hash of id and text, whose number grows with the texts: each shard updates
    its own copy of the weights by batches, and the changes of a weight row are averaged over
    shards by how often each met the row, in two steps of sums of fixed size. The tables of
    weights grow with the training tokens (table_rows) and are broadcast. Neither files nor
    partitions bear on the result. Null texts are empty; an empty text is the one token
    end. Texts of any length are read whole. Rows that repeat get one score each. A null id
    counts as training. An empty table gives no rows; other columns of df, whatever their
    names, are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "lm")
    rest = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)), F.lit(0))
    keys = F.struct(F.col(id_col).alias("id"), (rest == 1).alias("held_out")).alias("keys")
    rows = df.select(keys, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    train = rows.where("not keys.held_out")
    counts = scratch.keep(train.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    level = F.floor(F.log2("c") * 8).cast("int")
    table = sorted((r.l, r.n, r.c) for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect())
    total, types = sum(c for *_, c in table), sum(n for _, n, _ in table)
    least, held = 0, 0
    for lev, n, _ in reversed(table):
        if held + n > head_words:
            least = lev + 1
            break
        held += n
    top = counts.where(level >= least).toArrow()
    head = Head(np.array(top.column("h"), np.int64).view(np.uint64), np.array(top.column("c"), np.int64))
    ends = np.zeros(ENDS)
    np.add.at(ends, head.keys[RANKED:].view(np.int64) % ENDS, head.counts[RANKED:] + 0.5)
    others = counts.where(level < least).groupBy(F.pmod("h", F.lit(ENDS)).alias("j")).agg(F.sum(F.col("c") + 0.5).alias("m")).toArrow()  # a row for each last leaf at most
    ends[np.array(others.column("j"), np.int64)] += np.array(others.column("m"), np.float64)
    ranked = np.zeros(RANKED)
    ranked[: len(head.counts)] = head.counts[:RANKED] + 0.5
    mass = 0.5 + ranked.reshape(-1, CLASSES).sum(0) + ends.reshape(-1, CLASSES).sum(0)  # 0.5: for words never met
    n_rows = table_rows(total)
    start = (mass, n_rows, ends, ranked.reshape(-1, CLASSES))
    model = Model(*start)
    shards = max(1, total // (n_rows * SHARD_TOKENS))
    shared = spark.sparkContext.broadcast(head)
    dealt = train.select(F.xxhash64("keys.id", "text").alias("order"), "text").withColumn("shard", F.pmod("order", F.lit(shards)))
    dealt = dealt.repartitionByRange(min(shards, MOST_PARTITIONS), "shard").sortWithinPartitions("shard", "order").select("shard", "text")
    changes = dealt.mapInArrow(_learned(shared, spark.sparkContext.broadcast(start)), "shard long, kind int, block int, change binary")
    groups = max(1, math.isqrt(shards))
    salted = changes.withColumn("salt", F.pmod("shard", F.lit(groups)))
    summed = "shard long, kind int, block int, change binary"
    merged = salted.groupBy("kind", "block", "salt").applyInPandas(_sum_blocks(["kind", "block"]), summed)
    if groups > 1:
        merged = merged.groupBy("kind", "block").applyInPandas(_sum_blocks(["kind", "block"]), summed)
    for row in merged.toLocalIterator():  # the model's own size, whatever the corpus
        part = np.frombuffer(row.change, np.float32).reshape(-1, WIDTH + 1)
        model.weights[row.kind][row.block : row.block + BLOCK] += part[:, :-1] / np.maximum(part[:, -1:], 1)
    scored = rows.mapInArrow(_scored(shared, spark.sparkContext.broadcast(model)), schema(rows.schema["keys"], "n_tokens long, known long, base double, score double, tail array<struct<h: long, more: float>>"))
    scored = scratch.keep(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare, n = scratch.keep_counted(scored.select("row", F.inline("tail")), "tail")
    met = rare.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(counts, "h")
    tail = join_by_key(rare, scratch.keep(met, "met"), ["h"], n, "left")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("t"), F.count("c").alias("k"), F.sum(F.when(F.col("c").isNotNull(), F.col("more").cast("double"))).alias("more"))
    out = scored.drop("tail").join(tail, "row", "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
    scale = math.log10(total + 0.5 * (types + 1))
    return out.select(
        F.col("keys.id").alias("doc_id"),
        "keys.held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("t") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("score") + F.col("t") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
