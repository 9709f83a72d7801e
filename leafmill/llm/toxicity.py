"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from leafmill.llm.scratch import Scratch
from leafmill.llm.wordhash import BASE, NON_ALNUM, Words, mix, powers, text_buffers
from leafmill.llm.wordhash import pieces as runs
from leafmill.llm.worker import text_of, tidy

#: Labelled rows the trees are fitted on at most, and entries of the learned lexicon at most.
TRAINING_ROWS, LEXICON = 20_000, 4_000
#: Texts with a label from which the lexicon is learned at least this often before it counts.
LEAST_TOXIC = 3
#: Bytes of texts whose features are made at once: the arrays for it take some 300 bytes for each.
RUN_BYTES = 1 << 18
STEMS = (4, 5, 6, 7, 8, 9)
NEAR = 6
#: Second person in the languages of the corpus (fixed values).
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "ihnen", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "vosotros", "tus", "su", "vuestro")
#: Characters written for letters (fixed values).
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
FEATURES = ("words", "lex_share", "lex_any", "lex_max", "stem_share", "stem_max", "disguised", "near_you", "you_share", "capitals", "exclaims", "questions", "symbols", "mixed_words", "stretched")

_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in LEET.items():
    _LEET[ord(_a)] = ord(_b)
_KEPT = NON_ALNUM.copy()  # separators of disguised words: their marks count as letters
_KEPT[[ord(c) for c in LEET]] = False


def _hash_word(word: bytes) -> int:
    total = sum((b + 1) * pow(int(BASE), i, 1 << 64) for i, b in enumerate(word)) % (1 << 64)
    return int(mix(np.array([total], np.uint64))[0])


_YOU = np.sort(np.array([_hash_word(w.encode()) for w in SECOND_PERSON], np.uint64))


def _stems(part: Words, lengths) -> Iterator[tuple[int, np.ndarray]]:
    """For each length, the hash of each word's first bytes, marked with their number; 0 for words that are no longer."""
    up, down = powers(len(part.data) + 1)
    sums = np.zeros(len(part.data) + 1, np.uint64)
    np.cumsum((part.data.astype(np.uint64) + np.uint64(1)) * up[: len(part.data)], out=sums[1:])
    size, begin, scale = part.ends - part.starts, sums[part.starts], down[part.starts]
    for length in lengths:
        h = np.zeros(len(size), np.uint64)
        at = np.flatnonzero(size > length)
        h[at] = mix((sums[part.starts[at] + length] - begin[at]) * scale[at]) ^ np.uint64(length)
        yield length, h


def _found(values: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weight of each value that is a key, else 0."""
    if not len(keys) or not len(values):
        return np.zeros(len(values))
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, weights[at], 0.0)


@tidy
def _terms(batches):
    """Distinct words and word stems of labelled texts, with whether the text is toxic."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column("text"))
        toxic = np.array(batch.column("toxic").to_pylist(), np.int64)
        for a, b in runs(offsets, RUN_BYTES):
            part = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a, NON_ALNUM, True)
            owner = part.owners().astype(np.uint64)
            for length, h in ((0, part.hashes), *_stems(part, STEMS)):
                keep = h != 0
                pair = np.unique(np.stack([owner[keep], h[keep]], 1), axis=0) if keep.any() else np.zeros((0, 2), np.uint64)
                bad = toxic[pair[:, 0].astype(np.int64) + a]
                keys, place = np.unique(pair[:, 1], return_inverse=True)
                n = np.bincount(place, minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), length, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.bincount(place, bad, len(keys)).astype(np.int64)), pa.array(n.astype(np.int64))], names=["stem", "h", "toxic", "n"])


def learn_lexicon(labelled: DataFrame, limit: int = LEXICON) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Words and stems that mark toxic texts: sorted hashes and log odds by stem length (0: whole words).

    Counts cover all the labelled texts given; the limit entries of most weight are kept.
    """
    counts = labelled.mapInArrow(_terms, "stem int, h long, toxic long, n long").groupBy("stem", "h").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    total = labelled.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    bad, all_ = float(total.t or 0), float(total.n or 0)
    if not bad or bad == all_:
        return {}
    prior = math.log(bad / (all_ - bad))
    odds = F.log((F.col("toxic") + 0.05) / (F.col("n") - F.col("toxic") + 0.2 + 0.05 * F.lit((all_ - bad) / bad))) - prior
    top = counts.where(F.col("toxic") >= min(LEAST_TOXIC, max(1, bad / 20))).withColumn("w", odds).where("w > 1.5").orderBy(F.desc(F.col("w") * F.log1p("toxic")), "stem", "h").limit(limit)
    out: dict[int, list] = {}
    for row in top.toLocalIterator():
        out.setdefault(row.stem, []).append((row.h % (1 << 64), row.w))
    return {k: (np.array([h for h, _ in sorted(v)], np.uint64), np.array([w for _, w in sorted(v)])) for k, v in out.items()}


def feature_rows(column, lexicon: dict) -> np.ndarray:
    """Features of each text, in the order of FEATURES."""
    raw, offsets = text_buffers(column)
    rows = np.zeros((len(offsets) - 1, len(FEATURES)))
    none = (np.zeros(0, np.uint64), np.zeros(0))
    for a, b in runs(offsets, RUN_BYTES):
        body, places = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        part = Words(body, places, a, NON_ALNUM, True)
        n_docs, owner = b - a, part.owners()
        n = np.diff(part.bounds).astype(float)
        each = np.maximum(n, 1)
        lex = _found(part.hashes, *lexicon.get(0, none))
        stem = np.zeros(len(part.hashes))
        for length, h in _stems(part, [n for n in STEMS if n in lexicon]):
            stem = np.maximum(stem, _found(h, *lexicon[length]))
        you = _found(part.hashes, _YOU, np.ones(len(_YOU)))
        disguised = Words(_LEET[body], places, a, _KEPT, True)
        shown = np.zeros(len(body) + 1)
        np.cumsum(_LEET[body] != body, out=shown[1:])
        marks = shown[disguised.ends] - shown[disguised.starts]
        hidden = (_found(disguised.hashes, *lexicon.get(0, none)) > 0) & (marks > 0)
        top = np.maximum(lex, stem)
        near = np.zeros(len(lex))
        if len(lex):
            reach = np.concatenate(([0.0], np.cumsum(you)))
            at = np.arange(len(lex))
            lo, hi = np.maximum(part.bounds[owner], at - NEAR), np.minimum(part.bounds[owner + 1], at + NEAR + 1)
            near = (top > 0) * (reach[hi] - reach[lo] > 0)
        by = lambda x, o=owner: np.bincount(o, x, n_docs)
        peak = lambda x: np.maximum.reduceat(np.append(x, 0), np.minimum(part.bounds[:-1], len(x))) * (n > 0)
        cum = lambda flag: np.diff(np.concatenate(([0], np.cumsum(flag)))[places])
        chars = np.maximum(np.diff(places), 1).astype(float)
        letters = (body >= 65) & (body <= 90)
        same = np.zeros(len(body), dtype=bool)
        if len(body) > 2:
            same[2:] = (body[2:] == body[1:-1]) & (body[1:-1] == body[:-2]) & (body[2:] >= 65) & (body[2:] < 128)
        size = np.maximum(part.ends - part.starts, 1)
        digits = np.concatenate(([0], np.cumsum((part.data >= 48) & (part.data <= 57))))
        amount = digits[part.ends] - digits[part.starts]
        rows[a:b] = np.stack([np.log1p(n), by(lex > 0) / each, np.log1p(by(lex > 0)), peak(lex), by(stem > 0) / each, peak(stem), np.log1p(np.bincount(disguised.owners(), hidden, n_docs)), np.log1p(by(near)), by(you) / each, cum(letters) / chars, cum(body == 33) / chars, cum(body == 63) / chars, cum((body > 32) & (body < 128) & NON_ALNUM[body | 0] & ~letters) / chars, by((amount > 0) & (amount < size)) / each, cum(same) / chars], 1)
    return rows


def _featured(shared):
    @tidy
    def run(batches):
        for batch in batches:
            rows = feature_rows(text_of(batch), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], names=["row", *FEATURES])

    return run


class ToxicityModel:
    """Lexicon, trees and calibration fitted on labelled rows."""

    def __init__(self, lexicon: dict, trees, isotonic, prior: float):
        self.lexicon, self.trees, self.isotonic, self.prior = lexicon, trees, isotonic, prior

    def score(self, df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """row (a struct of the carried columns) and score (0 to 1) of every row of df.

        Null and empty texts have the score of a text without features. Texts of any length
        are read whole; repeated rows get one score each; carried columns may have any name;
        an empty table gives no rows.
        """
        text = [] if "text" == text_col and "text" in carry else [F.col(text_col).alias("text")]  # carried once
        rows = df.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]).alias("row"), *text)
        shared = df.sparkSession.sparkContext.broadcast(self.lexicon)
        fields = StructType([rows.schema["row"], *(StructField(f, DoubleType()) for f in FEATURES)])
        features = rows.mapInArrow(_featured(shared), fields)
        if self.trees is None:
            return features.select("row", F.lit(self.prior).alias("score"))
        raw = self.trees.transform(_assembled(features)).withColumn("p", vector_to_array("probability")[1]).select("row", "p")
        return self.isotonic.transform(raw).select("row", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction")).alias("score"))


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", rows: int = TRAINING_ROWS) -> ToxicityModel:
    """Fits on labelled texts whose crc32(id as text) mod 3 is not 1.

    A bounded sample of these, by a hash of their ids, is what is fitted on, one text for each
    id (of rows that repeat an id, the text of the smallest hash): its
    texts by a second hash give the lexicon (half), the trees (three tenths) and the
    calibration (the rest), so none is judged on texts it has read. Null labels are left
    out; an id with several labels counts as toxic if one is. With labels of one kind only,
    every score is their mean.
    """
    crc = lambda c: F.crc32(F.col(c).cast("string"))
    marked = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull() & (F.pmod(crc(label_id), F.lit(3)) != 1)).groupBy(F.col(label_id).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(rows)
    scratch = Scratch(docs.sparkSession, "toxicity")
    small = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    small = small.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic")).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(10)))
    small = scratch.keep(small, "labelled")
    part = small.where("part < 5")
    lexicon = learn_lexicon(part.select("text", "toxic"))
    rest = small.where("part >= 5")
    found = small.agg(F.avg("toxic")).first()[0]
    kinds = rest.groupBy(F.col("part") < 8).agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).collect()
    if len(kinds) < 2 or any(k.lo == k.hi for k in kinds):
        return ToxicityModel(lexicon, None, None, float(found or 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @tidy
    def run(batches):
        for batch in batches:
            rows = feature_rows(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("part"), *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], names=["label", "part", *FEATURES])

    table = rest.select("text", F.col("toxic").cast("double").alias("toxic"), "part").mapInArrow(run, "label double, part long, " + ", ".join(f"{f} double" for f in FEATURES))
    table = scratch.keep(table.coalesce(6), "features")
    ready = _assembled(table)
    trees = GBTClassifier(maxIter=12, maxDepth=3, maxBins=32, stepSize=0.3, seed=7).fit(ready.where("part < 8"))
    held = trees.transform(ready.where("part >= 8")).select("label", vector_to_array("probability")[1].alias("p"))
    isotonic = IsotonicRegression(featuresCol="p", labelCol="label").fit(held)
    return ToxicityModel(lexicon, trees, isotonic, float(found))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model fitted on the labels that are not held out.

    Null and empty texts have the score of a text without features; texts of any length are
    read whole; rows that repeat get a row each; null ids are not held out. Other columns are
    not read. Empty tables: no documents give no rows, no labels a score of 0 for all.
    """
    scored = fit_toxicity(docs, labels).score(docs).select("row.doc_id", "score")
    return scored.select("doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
