"""Token counts through a digest cache: only distinct texts that the cache lacks are encoded."""

from __future__ import annotations

import hashlib
import json
import os

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.joins import join_by_key
from leafmill.llm.scratch import Scratch
from leafmill.llm.worker import hold

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"
#: Bytes of a worker's table of encoded pieces, with what Python adds to each; it starts anew when it is full.
KEPT_BYTES, EACH = 48 << 20, 120
#: Longer pieces are encoded anew each time.
KEPT_CHARS = 1000


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer's file: a changed tokenizer never meets counts of another one."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


class Counter:
    """Token counts of texts as the tokenizer's library gives them.

    A byte-level BPE with its own pattern, and no normaliser, cuts before a space that a
    character other than white space follows, so the pieces between such spaces can be
    counted one by one and kept. Texts in which a space is followed by white space, or that
    hold a special token, are encoded whole, and so is every text for any other tokenizer.
    """

    def __init__(self, body: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(body)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = json.loads(body)
        cutter = kind.get("pre_tokenizer") or {}
        self.cuts = kind.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space") and kind.get("model", {}).get("type") == "BPE" and not kind["model"].get("dropout")
        self.pieces: dict[str, int] = {}
        self.size = 0

    def _whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _splits(self, text: str) -> list[str] | None:
        if not self.cuts or any(s in text for s in self.special):
            return None
        parts = text.split(" ")
        if not all(p and not p[0].isspace() for p in parts[1:]):
            return None
        return parts

    def count(self, texts: list[str]) -> list[int]:
        cut = [self._splits(t) for t in texts]
        heads = {p[0] for p in cut if p}
        new = {x for p in cut if p for x in p[1:]}.difference(self.pieces)
        size = sum(map(_bytes, new))
        if self.size + size > KEPT_BYTES:
            self.pieces.clear()
            new = {x for p in cut if p for x in p[1:]}
            self.size, size = 0, sum(map(_bytes, new))
        self.size += size
        order = list(new)
        for at in range(0, len(order), 10_000):
            some = order[at : at + 10_000]
            for x, e in zip(some, self.tokenizer.encode_batch_fast([" " + x for x in some], add_special_tokens=False), strict=True):
                self.pieces[x] = len(e.ids)
        first = {x: self._whole(x) for x in heads}
        get = self.pieces.__getitem__
        out = [self._whole(t) if p is None else first[p[0]] + sum(map(get, p[1:])) for t, p in zip(texts, cut, strict=True)]
        for x in [x for x in new if len(x) > KEPT_CHARS]:
            del self.pieces[x]
            self.size -= _bytes(x)
        return out


def _bytes(piece: str) -> int:
    """Memory of a piece in the table at most, nearly."""
    return 4 * len(piece) + EACH


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array([pack(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())], names=["content", "packed"])


def _counted(version: str, shared):
    def run(batches):
        counter, unpack = hold(("tokens", version), lambda: Counter(shared.value)), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            packed = batch.column("packed").to_pylist()
            counts: list[int] = []
            held, size = [], 0
            for p in packed:  # some megabytes of texts at a time
                held.append(unpack(p).decode())
                size += len(held[-1])
                if size > 1 << 21:
                    counts += counter.count(held)
                    held, size = [], 0
            counts += counter.count(held)
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    return run


def count_tokens(df: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text, one row per row of df.

    cache is a folder of counts by content digest and tokenizer version; what it lacks is
    encoded once for each distinct text and appended. Without one, the call has a cache of
    its own in the shared folder. Texts travel to the encoding tasks compressed.

    Null is empty, and empty has 0 tokens. Rows that repeat give repeated rows. Texts of any
    length are counted whole. An empty table gives no rows. Special strings inside a text are
    read as the library reads them by default. Other columns of df, whatever their names, are
    not read.
    """
    spark = df.sparkSession
    version = tokenizer_version(tokenizer)
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.unhex(F.sha2(text, 256))
    keyed = df.select(content.alias("content"), text.alias("text")).mapInArrow(_packed, "content binary, packed binary")
    if cache is None:
        cache = Scratch(spark, "tokencounts").path("cache")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).select("content")
    misses = keyed.join(stored, "content", "left_anti").groupBy("content").agg(F.first("packed").alias("packed"))
    misses.mapInArrow(_counted(version, shared), CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    rows = df.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content"))
    scratch = Scratch(spark, "tokencounts")
    rows, total = scratch.keep_counted(rows, "rows")
    copies = scratch.keep(rows.groupBy("content").agg(F.count(F.lit(1)).alias("n")).join(counts, "content"), "copies")
    return join_by_key(rows, copies, ["content"], total).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
