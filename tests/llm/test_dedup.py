import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from leafmill.llm import decontaminate, joins, neardup, substrings, wordhash
from leafmill.llm.components import connected_components
from leafmill.llm.scratch import Scratch
from tests.llm import brute


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\x1cZ0_😀", max_size=30)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    for table, lower, plain in ((wordhash.SPACES, False, brute.spaced), (wordhash.NON_ALNUM, True, brute.alnum)):
        at, seen = 0, {}
        for part in wordhash.words(pa.array(texts, pa.string()), table, lower):
            for d in range(len(part.bounds) - 1):
                got = [part.word(k).decode() for k in range(part.bounds[d], part.bounds[d + 1])]
                assert got == plain(texts[at])
                for k, w in zip(range(part.bounds[d], part.bounds[d + 1]), got, strict=True):
                    assert seen.setdefault(w, part.hashes[k]) == part.hashes[k]
                at += 1
        assert at == len(texts) and len(set(seen.values())) == len(seen)


def edited(rng, words, share):
    return " ".join(f"new{rng.random()}" if rng.random() < share else w for w in words)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, base, passage = [], text(160), text(90)
    docs += [" ".join(base)] * 12
    docs += [edited(rng, base, s) for s in (0.005, 0.01, 0.02, 0.03, 0.05) for _ in range(14)]
    docs += [" ".join(text(rng.randint(1, 120))) for _ in range(40)]
    docs += [" ".join(text(20) + passage + text(30)) for _ in range(10)]
    docs += [None, "", " \n\t", "one", "One", "two words", "two  words", "a b c d e", "A b c d e", " ".join(base).upper(), "x " * 3000]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,many", [(neardup.BLOCK_SHINGLES, neardup.BLOCK_DOCS), (700, 1000), (10**6, 9)])
def test_near_duplicates_equal_brute_force(spark, block, many):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, id string, class int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, block_shingles=block, block_docs=many).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(2, "a b"), (2, "a b"), (5, "a b"), (None, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()) == [(2, 2, True), (2, 2, True), (5, 2, False)]


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(1)
    for n, m in ((60, 50), (200, 190), (30, 200)):
        links = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
        want = brute.components({x for p in links for x in p}, links)
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "src long, dst long"), Scratch(spark, "t")).collect()}
        assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}


@pytest.mark.parametrize("window", [50, 9])
def test_substrings_equal_brute_force(spark, window):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substrings.dedup_substrings(df, window=window).collect()}
    want = {k: (*v[:3], v[3] or "") for k, v in brute.substrings(rows, window).items()}
    assert got == want


def test_substrings_of_nothing(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string"), window=3)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_contamination_equals_brute_force(spark, block):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta Épsilon zeta".split()) + str(rng.randint(0, 9)) for _ in range(n))
    items = [(i, text(rng.choice((1, 3, 12, 13, 14, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, "!!"), (3, "again other words here")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, f"{text(20)}, {items[i][1].upper()}-{text(5)}") for i in range(20)] + [(200, None), (201, ""), (202, items[5][1] * 3)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination_report(df, bench, block_bytes=block).collect()}
    assert got == brute.contamination(docs, items)
    found = decontaminate.find_contamination(df, bench, block_bytes=block).where("size(spans) > 0").limit(5).collect()
    for r in found:
        left = decontaminate.without_spans([r.row.text], [[s.asDict() for s in r.spans]])[0]
        assert len(brute.alnum(left)) == r.n_words - sum(s.end - s.start for s in r.spans)
    assert decontaminate.contamination_report(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_rows_that_share_an_id(spark):
    """An id of several texts is one document: one component, to which all its texts link; each text is cut by itself."""
    passage = [f"p{i}" for i in range(60)]
    a, b, c = "a b c d e f g h", "o p q r s t u", "k l m n"
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (6, b), (8, c), (8, None), (9, c), (2, None), (2, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [(2, 0, 2, True)] * 2 + [(3, 4, 3, True), (5, 3, 3, False), (5, 4, 3, False), (6, 3, 3, False), (8, 0, 8, True), (8, 1, 8, True), (9, 1, 8, False)]
    rows = [(1, " ".join(passage)), (2, " ".join(["long"] * 5 + passage + ["end"])), (2, "short text"), (2, " ".join(f"own{i}" for i in range(80))), (4, " ".join(passage)), (4, " ".join(passage))]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text.count(" ")) for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 60, 0, 59), (2, 2, 0, 1), (2, 66, 60, 5), (2, 80, 0, 79), (4, 60, 60, 0), (4, 60, 60, 0)]


def test_joins_by_hot_keys_lose_nothing(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 1000, F.lit(0)).otherwise(F.col("id") % 700).alias("k"), F.lit(7).alias("clash"))
    found = rows.groupBy("k").agg(F.max("id").alias("top"), F.count("*").alias("n")).where("k % 3 = 0")
    plain = rows.join(found.drop("n"), "k", "left")
    for hot in (1, 10, 10**6):
        got = joins.join_by_key(rows, found, ["k"], 3000, "left", hot=hot)
        assert sorted(map(tuple, got.select("id", "k", "clash", "top").collect())) == sorted(map(tuple, plain.select("id", "k", "clash", "top").collect()))
        assert joins.join_by_key(rows, found, ["k"], 3000, hot=hot).count() == plain.where("top is not null").count()


def test_flags_of_wanted_keys_miss_none(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 100 > 0, F.col("id")).alias("a"), (F.col("id") * 7).alias("b"))
    wanted = df.where("a % 11 = 3").select("a", "b")
    for bits in (1 << 29, 1 << 15):
        got = joins.with_likely(df, wanted, ["a", "b"], "flag", bits)
        assert got.columns == ["a", "b", "flag"] and got.count() == 20_000
        assert got.where("a % 11 = 3 and not flag").count() == 0 and got.where("flag and a is null").count() == 0
        if bits > 1 << 20:
            assert got.where("flag and a % 11 <> 3").count() < 2000
    assert joins.with_likely(df, wanted.limit(0), ["a", "b"], "flag").where("flag").count() == 0


def test_long_items_and_items_in_common(spark):
    """Segments of long items keep every window; a window of many items counts for all of them."""
    words = [f"b{i}" for i in range(90_000)]
    items = [(1, " ".join(words)), (2, " ".join(words[-13:])), *[(100 + i, "yes") for i in range(50)]]
    at = 41_000
    docs = [(1, " ".join(words[at : at + 13]).upper()), (2, "yes, yes " * 500), (3, " ".join(words[-13:])), (4, None), (5, " ".join(words[at : at + 12]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination_report(df, bench).collect()}
    assert got == {1: (13, 13, 1), 2: (1000, 1000, 50), 3: (13, 13, 2), 4: (0, 0, 0), 5: (12, 0, 0)}
    assert decontaminate.contamination_report(df, bench, block_bytes=100_000).exceptAll(decontaminate.contamination_report(df, bench)).count() == 0
    assert decontaminate.contamination_report(df.limit(0), bench).count() == 0
    left = {r.doc_id: r.text for r in decontaminate.decontaminate(spark.createDataFrame([(1, "keep this: yes. And that"), (2, None)], "doc_id long, text string"), bench, "spans").collect()}
    assert left == {1: "keep this: . And that", 2: None}


def test_dedup_of_odd_tables(spark):
    """A very long text and its near copy, names that clash, empty documents and items."""
    long = [f"w{i}" for i in range(150_000)]
    rows = [(1, " ".join(long), 0, "a"), (2, " ".join([*long[:-50], "end"]), 0, "b"), (3, "x", 0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fam int, `n.hit` string")
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup_substrings(df).collect()}
    assert got == {1: (150_000, 0), 2: (149_951, 149_950), 3: (1, 0)}
    items = spark.createDataFrame([(7, " ".join(long[100:113]), 1)], "item_id long, text string, doc_id int")
    assert {r.doc_id: (r.n_hit, r.contaminated) for r in decontaminate.contamination_report(df, items).collect()} == {1: (13, False), 2: (13, False), 3: (0, False)}
    assert decontaminate.contamination_report(df, items.limit(0)).where("n_hit = 0 and not contaminated").count() == 3
    assert neardup.near_duplicates(df.limit(0)).count() == decontaminate.contamination_report(df.limit(0), items).count() == 0


def test_a_hot_repeated_id_is_brought_once(spark):
    """30,000 equal rows of one id beside a near copy, with other texts of the same id: one row of each text is verified."""
    base = [f"w{i}" for i in range(40)]
    near = " ".join(base + ["end"])
    other = " ".join(f"v{i}" for i in range(40))
    rows = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(" ".join(base)).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(3, near), (7, other), (7, other), (9, other), (10, None)], "doc_id long, text string"))
    got = neardup.near_duplicates(rows).groupBy("doc_id", "component_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(3, 3, 1), (7, 3, 30_002), (9, 3, 1), (10, 10, 1)]
