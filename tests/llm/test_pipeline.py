import random

import corpus_pipeline
import pyarrow as pa
from leafmill.llm import toxicity, worker
from tests.llm import brute


def test_run_equals_plain_version(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(20))) for i in range(6)]
    passage, docs, labels = text(70), [], []
    for i in range(420):
        w = text(rng.randint(5, 90))
        if i % 6 == 0:
            w[1:1] = rng.sample(["idiot", "scum", "trash", "loser"], 2)
        if i % 11 == 0:
            w += passage
        if i % 17 == 0:
            w += items[i % 6][1].split()
        labels.append((i, int(i % 6 == 0)))
        docs.append([i, " ".join(w)])
        if i % 9 == 0:
            docs.append([1000 + i, " ".join(w + ["end"])])
    docs += [[3000, None], [3001, ""], [None, "no id"]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    scores = {r.doc_id: r.predicted for r in toxicity.score_toxicity(table, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    kept = [(i, t) for i, t in docs if not scores[i]]
    assert 0 < sum(scores.values()) < len(docs) / 2
    near = brute.near_duplicates([x for x in kept if x[0] is not None], corpus_pipeline.OVER, corpus_pipeline.OF)
    kept = [(i, t) for i, t in kept if i is None or near[i][1] == i]
    cut = brute.substrings([x for x in kept if x[0] is not None])
    kept = [(i, t if i is None else cut[i][3]) for i, t in kept]
    bad = brute.contamination(kept, items)
    kept = [i for i, _ in kept if not bad[i][4]]
    assert len(kept) < len(docs) - 60
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(i for i in kept if i is not None) and sum(r.doc_id is None for r in out) == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "encoding"]


def test_near_dedup_links_at_four_fifths(spark):
    """Pairs at a similarity of 0.82 and of exactly 0.8 are linked, one at 0.79 is not."""
    docs = []
    for k, left in ((0, 82), (10, 80), (20, 79)):
        w = [f"v{k}x{i}" for i in range(104)]
        docs += [(k, " ".join(w)), (k + 1, " ".join(w[: left + 4]))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [0, 10, 20, 21]


def test_stages_with_odd_rows_and_names(spark):
    """Repeated ids, nulls, a very long text and names that need quotes: no stage crashes, and none loses a row it should keep."""
    long = " ".join(f"l{i}" for i in range(60_000))
    rows = [(1, "a b c d e f", 1), (2, "a b c d e f", 2), (7, "q r s t u v w", 3), (7, "q r s t u v w", 3), (7, "quite other text", 4), (8, None, 5), (9, "", 6), (None, "no id", 7), (None, "no id", 7), (10, long, 8)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), n, n, "x") for i, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long, `my-col` long, `row.text` long, id string")
    items = spark.createDataFrame([(1, "nothing of the sort here at all")], "item_id long, text string")
    from leafmill.llm.decontaminate import decontaminate

    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r["my-col"] for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 7, 8] and kept.columns == docs.columns
    cut = corpus_pipeline.substring_dedup(spark, docs, "")
    assert sorted(map(str, cut.collect())) == sorted(map(str, docs.collect()))
    for remove in ("documents", "spans"):
        assert sorted(map(str, decontaminate(docs, items, remove).collect())) == sorted(map(str, docs.collect()))
    assert sorted(r.n_tokens > 0 for r in corpus_pipeline.encoding(spark, docs, "").collect()).count(False) == 2
    none = docs.limit(0)
    assert all(f.count() == 0 for f in (corpus_pipeline.near_dedup(spark, none, ""), corpus_pipeline.substring_dedup(spark, none, ""), decontaminate(none, items), corpus_pipeline.encoding(spark, none, "")))


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, ddl in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_leaves_carried_columns_alone(spark):
    """Columns whose names the code uses itself, or used to, stay as they are."""
    names = ("__id", "__part", "__bit", "__likely", "likely", "row", "id", "kept", "digest", "h")
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words stand here now"), (3, "other words stand here now")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_tasks_of_a_stage_drop_what_a_worker_holds_of_another():
    worker.hold("an encoder", object)
    assert list(toxicity._terms(iter([]))) == [] and not worker._state


def test_tasks_work_on_slices_of_large_batches():
    """A batch of 10 MB is worked on in slices of which none is larger than it should be; no row is lost, moved or changed."""
    texts = pa.array([None, "", *(f"w{i} " * 400 for i in range(5_000))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["id", "text"])
    sizes = []

    @worker.tidy
    def run(batches):
        for b in batches:
            sizes.append(b.nbytes)
            yield b

    assert batch.nbytes > 2 * worker.SLICE_BYTES
    assert pa.Table.from_batches(run(iter([batch]))).equals(pa.Table.from_batches([batch]))
    assert len(sizes) > 2 and max(sizes) < 1.2 * worker.SLICE_BYTES


def test_stages_hand_small_batches_to_python(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get(corpus_pipeline.BATCH)
    try:
        for now, then in (("10000", "1000"), ("0", "1000"), ("70", "70")):
            spark.conf.set(corpus_pipeline.BATCH, now)
            corpus_pipeline.encoding(spark, docs, "")
            assert spark.conf.get(corpus_pipeline.BATCH) == then
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)
