"""The language model beside a plain one: loops over tokens, Python's numbers, no arrays of features."""

import math
import random
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.llm import lm
from leafmill.llm.wordhash import MIX_A, MIX_B
from tests.llm.brute import low, spaced

MASK = (1 << 64) - 1
M = [int(x) for x in lm._M]


def mix(x):
    x ^= x >> 33
    x = x * int(MIX_A) & MASK
    x ^= x >> 29
    x = x * int(MIX_B) & MASK
    return x ^ (x >> 32)


class Plain:
    def __init__(self, ordered, hash_of):
        """ordered: training texts in order; hash_of: the hash of a word."""
        self.hash_of = hash_of
        self.counts = Counter(t for text in ordered for t in self.tokens(text))
        by_rank = sorted(self.counts, key=lambda t: (-self.counts[t], t))
        self.rank = {t: i for i, t in enumerate(by_rank)}
        self.mass = [0.5] * lm.CLASSES
        for t, c in self.counts.items():
            self.mass[self.class_of(t)] += c + 0.5
        self.inner = [sum(self.mass[a + lm.WIDTH * b] for b in range(lm.WIDTH)) for a in range(lm.WIDTH)]
        self.weights = [{}, {}]
        batch = []
        for text in ordered:
            tok = self.tokens(text)
            batch += [(self.class_of(t), *self.history(tok, i)) for i, t in enumerate(tok)]
            while len(batch) >= lm.BATCH:
                self.learn(batch[: lm.BATCH])
                batch = batch[lm.BATCH :]
        self.learn(batch)

    def tokens(self, text):
        return [self.hash_of[w] for w in spaced(low(text))] + [int(lm.END)]

    def class_of(self, t):
        r = self.rank.get(t, -1)
        signed = t - (1 << 64) if t >> 63 else t
        return r % lm.CLASSES if 0 <= r < lm.RANKED else signed % lm.CLASSES

    def history(self, tok, i):
        one = tok[i - 1] if i > 0 else int(lm.START)
        two = tok[i - 2] if i > 1 else int(lm.START)
        return mix(one * M[0] & MASK), mix((one * M[1] + (two << 1)) & MASK), mix(two * M[2] & MASK)

    def levels(self, cls, feats):
        """Of each level: its rows of weights, the shares of its branches and the one that is taken."""
        first, second = cls % lm.WIDTH, cls // lm.WIDTH
        inner = self.inner
        rows0 = [feats[k] % lm.LEAST_ROWS for k in lm.READS[0]]
        rows1 = [mix((feats[k] + (first + 1) * M[1]) & MASK) % lm.LEAST_ROWS for k in lm.READS[1]]
        bias0 = [math.log(x / sum(self.mass)) for x in inner]
        bias1 = [math.log(self.mass[first + lm.WIDTH * b] / inner[first]) for b in range(lm.WIDTH)]
        for level, (rows, bias, own) in enumerate(((rows0, bias0, first), (rows1, bias1, second))):
            z = [math.exp(b + sum(self.weights[level].get(r, [0.0] * lm.WIDTH)[j] for r in rows)) for j, b in enumerate(bias)]
            yield rows, [x / sum(z) for x in z], own

    def learn(self, batch):
        for level in (0, 1):
            grads = []
            for cls, *feats in batch:
                rows, shares, own = list(self.levels(cls, feats))[level]
                grads.append((rows, [s - (j == own) for j, s in enumerate(shares)]))
            for k in range(len(lm.READS[level])):
                met = {}
                for rows, g in grads:
                    met.setdefault(rows[k], []).append(g)
                for r, gs in met.items():
                    old = self.weights[level].get(r, [0.0] * lm.WIDTH)
                    new = [w - lm.RATE / math.sqrt(len(gs)) * sum(g[j] for g in gs) for j, w in enumerate(old)]
                    self.weights[level][r] = [max(-float(lm.LARGEST), min(float(lm.LARGEST), x)) for x in new]

    def score(self, text):
        tok, total = self.tokens(text), 0.0
        for i, t in enumerate(tok):
            cls = self.class_of(t)
            for _, shares, own in self.levels(cls, self.history(tok, i)):
                total += math.log10(shares[own])
            total += math.log10(self.counts.get(t, 0) + 0.5) - math.log10(self.mass[cls])
        return total


def test_scores_equal_a_plain_model(spark):
    """Two batches of training, held-out texts, words never met, an empty text."""
    rng = random.Random(11)
    follow = {f"w{i}": [f"w{rng.randint(0, 60)}" for _ in range(3)] for i in range(61)}

    def text(n):
        w = ["w0"]
        for _ in range(n):
            w.append(rng.choice(follow[w[-1].lower()]) if rng.random() < 0.9 else f"W{rng.randint(0, 60)}")
        return " ".join(w)

    texts = {i: text(rng.randint(0, 60)) for i in range(200)} | {300: "", 301: "never seen words", 302: "w1  w2\tw3"}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    order = [r.doc_id for r in df.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 1).orderBy(F.xxhash64("doc_id", "text")).collect()]
    assert all(zlib.crc32(str(i).encode()) % 5 != 1 for i in order) and len(order) < len(texts)
    vocabulary = sorted({w for t in texts.values() for w in spaced(low(t))})
    ((_, hashes, bounds),) = lm.tokens(pa.array(vocabulary))
    plain = Plain([texts[i] for i in order], {w: int(hashes[b]) for w, b in zip(vocabulary, bounds, strict=False)})
    got = {r.doc_id: r for r in lm.score_texts(df).collect()}
    for i, t in texts.items():
        assert abs(got[i].score - plain.score(t)) < 2e-3 * max(1, abs(got[i].score)), i
        assert got[i].n_tokens == len(spaced(t)) + 1
    assert sum(got[i].score - got[i].base_score for i in order) > 1
