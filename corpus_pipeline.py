"""A training-data pipeline in stages; each works on what its predecessor kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.decontaminate import decontaminate
from leafmill.llm.joins import with_likely
from leafmill.llm.neardup import near_duplicates
from leafmill.llm.queries import tokenizer_file
from leafmill.llm.scratch import Scratch
from leafmill.llm.sentencepieces import encode_texts
from leafmill.llm.substrings import dedup_substrings
from leafmill.llm.toxicity import fit_toxicity

THRESHOLD = 0.7
#: Near-duplicates have a similarity of 80 / 100 or more; a pair at just that misses all 50 bands of 7 minima with probability 8e-6.
OVER, OF, ROWS, BANDS = 100, 80, 7, 50
#: Rows of an Arrow batch at most. Spark's 10,000 are all rows of a task as a rule, and their texts a buffer of 32 MB in the JVM.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def small_batches(stage):
    """A stage whose session hands small batches to Python; it keeps a setting that is smaller yet. Results do not depend on it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
            spark.conf.set(BATCH, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay as they are.

    Null and empty texts have the score of a text without features; texts of any length are
    read whole; equal rows have one fate; columns keep their names; an empty table stays empty.
    """
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs, carry=tuple(docs.columns)).where(F.col("score") < THRESHOLD).select("row.*")


@small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays.

    Rows that repeat an id are one document: if it stays, all its different rows do, and
    equal ones once. Rows without an id can't be judged and stay. Null and empty texts are
    near nothing. Only rows that may go, or whose id repeats, are shuffled.
    """
    scratch = Scratch(spark, "near_dedup")
    near = near_duplicates(docs, over=OVER, of=OF, rows=ROWS, bands=BANDS)
    fate = near.groupBy(F.col("doc_id").alias("id")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    fate = scratch.keep(fate.select("id", "kept"), "fates")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))  # no name of docs meets one of these
    marked = with_likely(rows, fate, ["id"], "likely")
    judged = marked.where("likely").join(fate, "id", "left").where(F.coalesce("kept", F.lit(True)))
    once = judged.withColumn("digest", F.sha2(F.to_json("row"), 256)).dropDuplicates(["id", "digest"])
    return marked.where("not likely").select("row").unionByName(once.select("row")).select("row.*")


@small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside repeated windows go; a document that loses none stays as it is, one that loses all stays with an empty text.

    Null and empty texts lose nothing; rows without an id stay as they are; texts of any
    length are read whole; rows that repeat an id are judged each; an empty table stays empty.
    """
    cut = dedup_substrings(docs, carry=tuple(docs.columns))
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text")), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    out = cut.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
    return out.unionByName(docs.where("doc_id is null"))


@small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go.

    Null and empty texts have none and stay; texts of any length are read whole; rows that
    repeat have one fate; other columns stay; an empty table, or benchmark, takes nothing out.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@small_batches
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that is left; null and empty ones have none. Rows that repeat stay, texts of any length are encoded whole, an empty table gives no rows."""
    return encode_texts(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: The first stage is a trained model, which SQL can't express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(docs)  # nothing reads it any more
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
