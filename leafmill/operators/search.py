"""Search for many literals at once: an automaton of all terms goes over each page, and only hits leave it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from leafmill.sources.kept import Kept

#: Characters of the terms of one automaton, which each worker holds: some 60 MB.
TERM_CHARS = 1_000_000
#: Hits of a batch of results.
BATCH = 20_000

_built: dict = {}


def _automaton(key: str, shared) -> tuple[ahocorasick.Automaton, pa.Array, list[str]]:
    """The automaton over the distinct terms, with the rows of each, and the ids and terms of these rows; a worker keeps one."""
    if key not in _built:
        _built.clear()
        with pa.ipc.open_stream(shared.value) as reader:
            table = reader.read_all().combine_chunks()
        terms, rows = table.column("query").to_pylist(), {}
        for i, t in enumerate(terms):
            rows.setdefault(t, []).append(i)
        machine = ahocorasick.Automaton()
        for t, own in rows.items():
            machine.add_word(t, (len(t), own))
        if rows:
            machine.make_automaton()
        ids = table.column("query_id")
        _built[key] = machine, ids.chunk(0) if ids.num_chunks else pa.array([], ids.type), terms
    return _built[key]


def _found(spark: SparkSession, found: pa.Table, context: int, names: list[str]):
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as writer:
        writer.write_table(found)
    key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, ids, terms = _automaton(key, shared)
        if not terms:
            return
        for batch in batches:
            pages, queries, rest = [], [], ([], [], [], [])

            def made():
                own = pa.array(pages, pa.int64())
                columns = [batch.column("doc_id").take(own), batch.column("page_no").take(own), ids.take(pa.array(queries, pa.int64()))]
                kinds = (pa.int32(), pa.string(), pa.string(), pa.string())
                return pa.RecordBatch.from_arrays(columns + [pa.array(list(c), k) for c, k in zip(rest, kinds, strict=True)], names=names)

            for k, text in enumerate(batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                for end, (n, own) in machine.iter(text):
                    at = end + 1 - n
                    before, after = text[max(0, at - context) : at], text[end + 1 : end + 1 + context]
                    for q in own:
                        pages.append(k)
                        queries.append(q)
                        for column, value in zip(rest, (at, before, terms[q], after), strict=True):
                            column.append(value)
                    if len(pages) >= BATCH:
                        yield made()
                        pages, queries, rest = [], [], ([], [], [], [])
            if pages:
                yield made()

    return run


def search_context(pages: DataFrame, queries: DataFrame, context: int = 50, term_chars: int = TERM_CHARS) -> DataFrame:
    """Hits of each query (query_id, query) in page texts, overlaps included, with what stands around.

    doc_id, page_no, query_id, at (code points from 0), before, match and after (context of
    them at most). All terms are one Aho-Corasick automaton: a page is read once however many
    terms there are, and no page, and no part of one that is no hit, is shuffled. The terms
    are broadcast up to term_chars characters. More of them are cut to blocks of that size by
    a hash, and pages are read once for each block, one after the other, with the hits written
    in between: what driver and workers hold stays the same, and no page is sent anywhere.
    A single term longer than that is a block of its own.

    Null and empty queries find nothing; equal ones have hits each; rows that repeat give
    repeated hits; null texts hold nothing.
    """
    spark = pages.sparkSession
    asked = queries.where("query <> ''").select("query_id", "query")
    total = asked.agg(F.sum(F.length("query")).alias("n")).first().n or 0
    names = ["doc_id", "page_no", "query_id", "at", "before", "match", "after"]
    kinds = [pages.schema["doc_id"].dataType, pages.schema["page_no"].dataType, queries.schema["query_id"].dataType, IntegerType(), *[StringType()] * 3]
    fields = StructType([StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    read = pages.select("doc_id", "page_no", "text")

    def hits(terms: DataFrame) -> DataFrame:
        return read.mapInArrow(_found(spark, terms.toArrow(), context, names), fields)

    blocks = -(-int(total) // term_chars)
    if blocks <= 1:
        return hits(asked)
    kept = Kept(spark, "search")
    asked = kept.keep(asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")), by=["block"])
    out = None
    for b in range(blocks):
        part = kept.keep(hits(asked.where(F.col("block") == b).select("query_id", "query")))
        out = part if out is None else out.unionByName(part)
    return out
