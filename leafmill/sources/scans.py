"""Sources: files, texts, tables, JSON; and the gate that uploads go through."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.sources.kept import file_system, shared_folder

LIMIT = 50 << 20


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", at_least: int = 1) -> DataFrame:
    """path, length and modificationTime of matching files; contents are not read. Fewer files than asked for is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")
    if files.limit(at_least).count() < at_least:
        raise FileNotFoundError(f"fewer than {at_least} files match {pattern}")
    return files


def scan_text(source: SparkSession | DataFrame, path: str | None = None) -> DataFrame:
    """doc_id (path or the table's id), line_no and line of whole text files, or of a table with doc_id and text."""
    if isinstance(source, DataFrame):
        whole = source.select("doc_id", "text")
    else:
        whole = source.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    return whole.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A table with a header row (quotes inside quoted cells are doubled); without a schema, types are inferred in an extra pass."""
    reader = spark.read.option("header", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def scan_json(payloads: DataFrame) -> DataFrame:
    """row_no, key, value of JSON texts (doc_id, payload).

    An array has a row for each element, with the union of the keys of its objects in name
    order; missing keys, and all keys of other elements, are empty. A single object has a
    row for each key, a scalar one row without a key. Bad JSON has none.
    """
    body = F.trim("payload")
    as_list = F.from_json(F.when(body.startswith("["), body), "array<string>")
    listed = payloads.select("doc_id", as_list.alias("items")).where("items is not null")
    keys = F.array_sort(F.array_distinct(F.flatten(F.transform("items", lambda x: F.coalesce(F.json_object_keys(F.when(F.trim(x).startswith("{"), x)), F.array().cast("array<string>"))))))
    rows = listed.select("doc_id", keys.alias("keys"), F.posexplode("items").alias("row_no", "item"))
    maps = rows.select("doc_id", "row_no", F.explode("keys").alias("key"), F.from_json(F.when(F.trim("item").startswith("{"), F.col("item")), "map<string,string>").alias("m"))
    table = maps.select("doc_id", "row_no", "key", F.coalesce(F.element_at("m", F.col("key")), F.lit("")).alias("value"))
    single = payloads.where(body.startswith("{")).select("doc_id", F.explode(F.map_entries(F.from_json(body, "map<string,string>"))).alias("e")).select("doc_id", F.lit(0).alias("row_no"), "e.key", F.coalesce("e.value", F.lit("")).alias("value"))
    scalar = payloads.where(body.rlike(r'^(-?\d+(\.\d+)?([eE][-+]?\d+)?|true|false|null|"([^"\\]|\\.)*")$')).select("doc_id", F.lit(0).alias("row_no"), F.lit("").alias("key"), F.when(body.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>"), F.lit(0))).otherwise(body).alias("value"))
    return table.unionByName(single).unionByName(scalar)


def ingest_gate(files: DataFrame, limit: int = LIMIT, allowed: tuple[str, ...] = ("application/pdf",)) -> DataFrame:
    """reject_reason of each file (path, content, length, content_type), null for those that pass."""
    kind = F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";").getItem(0)))
    fits = F.lit(False)
    for a in allowed:
        fits = fits | (kind.startswith(a[:-1]) if a.endswith("/*") else kind == a)
    head = F.substring("content", 1, 5)
    reason = (
        F.when(~F.lower("path").endswith(".pdf"), F.lit("wrong extension"))
        .when(F.col("content").isNull() | (F.col("length") == 0), F.lit("empty file"))
        .when(F.col("length") > limit, F.lit("too large"))
        .when(head != F.lit(b"%PDF-"), F.lit("bad signature"))
        .when(~fits, F.lit("content type not allowed"))
    )
    return files.withColumn("reject_reason", reason)


_REPORT = "input string, output string, ok boolean, n_rows long, step string, error string"


def run_batch(inputs: dict[str, DataFrame], steps: list[tuple[str, dict]], registry: dict[str, Callable[..., DataFrame]], folder: str | None = None, at_once: int = 4) -> tuple[dict[str, DataFrame], DataFrame]:
    """Runs a chain of named operators over many inputs: outputs by name, and a report with a row for each input.

    An unknown operator or an empty chain is an error. An output's name is its input's with
    _processed, or _converted for a single step. Each input is run by itself, at_once of them
    side by side in job groups of their own, and written below folder (default: the folder
    between jobs): first under a name that nobody reads, then renamed. So an input that fails,
    when its plan is made or at any of its rows, leaves nothing behind and stops no other. The
    report has input, output, ok, n_rows, and of a failure the step (an operator, or run) and
    the error. An output that is there already is not replaced: that is a failure too.
    """
    if not steps:
        raise ValueError("no operators given")
    unknown = [name for name, _ in steps if name not in registry]
    if unknown:
        raise ValueError(f"unknown operator: {', '.join(unknown)}")
    spark = next((df.sparkSession for df in inputs.values()), None) or SparkSession.active()
    group = f"batch-{uuid.uuid4().hex}"
    folder = (folder or f"{shared_folder(spark)}/{group}").rstrip("/")

    def one(name: str) -> tuple:
        base = name.rpartition(".")[0] or name
        output, step = base + ("_converted" if len(steps) == 1 else "_processed"), "run"
        draft = f"{folder}/_{group}/{uuid.uuid4().hex}"
        system, at = file_system(spark, draft)
        try:
            spark.sparkContext.setJobGroup(f"{group}-{name}", f"batch input {name}", True)
            df = inputs[name]
            for step, parameters in steps:  # noqa: B007  the step that fails is told
                df = registry[step](df, **parameters)
            step, watch = "run", Observation()
            df.observe(watch, F.count(F.lit(1)).alias("n")).write.parquet(draft)
            _, final = file_system(spark, f"{folder}/{output}")
            if system.exists(final) or not system.rename(at, final):
                raise FileExistsError(f"{output} is there already")
            return name, output, True, watch.get["n"], None, None, df.schema
        except Exception as e:  # noqa: BLE001  one bad input does not stop the others
            return name, output, False, None, step, f"{type(e).__name__}: {e}", None
        finally:
            system.delete(at, True)

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        done = list(pool.map(one, inputs))
    system, drafts = file_system(spark, f"{folder}/_{group}")
    system.delete(drafts, True)
    out = {output: spark.read.schema(fields).parquet(f"{folder}/{output}") for _, output, ok, *_, fields in done if ok}
    return out, spark.createDataFrame([d[:-1] for d in done], _REPORT)


def batch_report(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Sizes in KB (1 decimal) of files (name, bytes) before and after, by name."""
    kb = lambda c: F.floor(F.col(c) * 10.0 / 1024 + 0.5) / 10
    both = inputs.select("name", F.col("bytes").alias("a")).join(outputs.select("name", F.col("bytes").alias("b")), "name", "full_outer")
    return both.select("name", kb("a").cast("double").alias("input_kb"), kb("b").cast("double").alias("output_kb"))


def batch_totals(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """The head of the report, one row: n_inputs, n_outputs, and the bytes of each."""
    both = inputs.select(F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("bytes").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(outputs.select(F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).cast("long").alias("a"), F.col("bytes").alias("b")))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return both.agg(total("i", "n_inputs"), total("o", "n_outputs"), total("a", "input_bytes"), total("b", "output_bytes"))
