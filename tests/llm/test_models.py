import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import htmltext, lm, sentencepieces, tokencounts, toxicity
from leafmill.llm.queries import tokenizer_file
from tests.llm import brute

ODD = ["", " ", "  two  spaces ", "line\n\nbreaks\r\n x", "日本語 テキスト😀 x", "a\0b c", "<|endoftext|> in <|endoftext|>text", "<s> hi</s> <0x0A>", "it's I'm we'll 'tis", "x" * 3000, "ab" * 300 + " " + "é" * 500, "tab\t tab 　wide space", "a▁b", "12345 67 8.9,0", "!!! ??? ...", " lead", "trail "]


def test_sentencepieces_equal_the_library(spark):
    import sentencepiece

    rng = random.Random(1)
    texts = ODD + [" ".join("".join(rng.choice("etaoinshrdluéß") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    model = tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    df = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in sentencepieces.encode_texts(df, model).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == lib.encode(t), t
        assert rows[i].decodes == ("▁" not in t)
    assert rows[900].ids == [] and rows[900].n_tokens == 0
    back = {r.doc_id: r.text for r in sentencepieces.decode_ids(spark.createDataFrame([(r.doc_id, r.ids) for r in rows.values()], "doc_id long, ids array<int>"), model).collect()}
    assert all(back[i] == t for i, t in enumerate(texts) if "▁" not in t)


def test_token_counts_equal_the_library_and_fill_the_cache(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = [*ODD, "same text", "same text", *(f"word{i} " * i for i in range(1, 40))]
    df = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string")
    cache = str(tmp_path / "cache")
    for _ in range(2):
        rows = {r.doc_id: r for r in tokencounts.count_tokens(df, path, cache, limit=30).collect()}
        for i, t in enumerate(texts):
            n = len(lib.encode(t, add_special_tokens=False).ids)
            assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len(t.encode()), n > 30)
        assert rows[900].n_tokens == 0
    assert spark.read.parquet(cache).count() == len({*texts})


def test_language_model(spark):
    rng = random.Random(4)
    follow = {w: [f"w{rng.randint(0, 30)}" for _ in range(2)] for w in [f"w{i}" for i in range(31)]}

    def text(n):
        w = ["w0"]
        for _ in range(n):
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    docs = [(i, text(80)) for i in range(400)] + [(1000, None), (1001, ""), (1002, "NEW unseen Words"), (1003, "w1 W1")]
    for head in (lm.HEAD, 5):
        rows = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), head_words=head).collect()}
        count, end = {}, object()
        for i, t in docs:
            if zlib.crc32(str(i).encode()) % 5 != 1:
                for w in [*brute.spaced(brute.low(t)), end]:
                    count[w] = count.get(w, 0) + 1
        total, types = sum(count.values()), len(count)
        for i, t in docs:
            w = [*brute.spaced(brute.low(t)), end]
            base = sum(math.log10((count.get(x, 0) + 0.5) / (total + 0.5 * (types + 1))) for x in w)
            r = rows[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(x in count for x in w), total)
            assert r.base_score == pytest.approx(base) and r.score < 0
        held = [r for r in rows.values() if r.held_out and r.doc_id < 400]
        assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)  # clearly higher than words alone


def test_language_model_probabilities_sum_to_one():
    """Over all classes, and over the words of all classes, with trained weights."""
    rng = np.random.default_rng(0)
    counts = np.sort(rng.integers(1, 500, 40_000))[::-1]
    words = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mass = np.full(lm.CLASSES, 0.5)
    cls = lm.classes(np.arange(40_000), words)
    np.add.at(mass, cls, counts + 0.5)
    model = lm.Model(mass, 1 << 12)
    for w in model.weights:
        w += rng.normal(0, 1, w.shape).astype(np.float32)
    every = np.arange(lm.CLASSES)
    p = np.exp(model.step(every, tuple(np.full(len(every), x, np.uint64) for x in (5, 77, 901))))
    assert p.sum() == pytest.approx(1, abs=1e-4) and (p > 0).all()
    words = (p[cls] * (counts + 0.5) / mass[cls]).sum() + (p * 0.5 / mass).sum()
    assert words == pytest.approx(1, abs=1e-4)


def test_words_of_a_class_depend_on_history(spark):
    """Words of one class, each of them after a word of its own: the right one is likelier than the other, known by rank or by hash."""

    def hashed(names):
        ((_, tok, bounds),) = lm.tokens(pa.array(names))
        return {w: int(h) for w, h in zip(names, tok[bounds[:-1]], strict=True)}

    def gain(pairs, asked, copies, head):
        """What the second word of a pair gains over the other word, in held-out texts."""
        train, held = ([i for i in range(200_000) if (zlib.crc32(str(i).encode()) % 5 == 1) == part] for part in (False, True))
        docs = [f"{x} {y}" for x, y in pairs for _ in range(copies)]
        right, wrong = ([(f"{x} {w[k]}") for x, *w in asked] for k in (0, 1))
        rows = [*zip(train, docs, strict=False), *zip(held, right + wrong, strict=False)]
        got = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), head_words=head).collect()}
        n = len(asked)
        return sum(got[i] for i in held[:n]) / n - sum(got[i] for i in held[n : 2 * n]) / n

    # by rank, of words that occur as often: the end has the first, then they go by their hashes
    pairs = [(f"x{i}", f"y{i}") for i in range(lm.CLASSES)]
    hashes = hashed([w for pair in pairs for w in pair])
    order = sorted(hashes, key=hashes.get)
    asked = [(f"x{a[1:]}", a, b) for a, b in zip(order, order[lm.CLASSES :], strict=False) if a[0] == b[0] == "y"]
    assert len(asked) > 100 and gain(pairs, asked, 12, lm.HEAD) > 0.1
    # by hash: in two leaves of a class, and in two leaves of one of these
    hashes = hashed([f"y{i}" for i in range(6000)])
    for modulus in (lm.CLASSES, lm.CLASSES * lm.REST):
        met = {}
        a, b = next((met[h % modulus], w) for w, h in hashes.items() if met.setdefault(h % modulus, w) != w and len({h % (lm.CLASSES * lm.REST), hashes[met[h % modulus]] % (lm.CLASSES * lm.REST)}) == (2 if modulus == lm.CLASSES else 1))
        assert hashes[a] % lm.ENDS != hashes[b] % lm.ENDS
        assert gain([("c", a), ("d", b)], [("c", a, b), ("d", b, a)], 300, 0) > 0.1


def test_language_model_probabilities_of_words_sum_to_one():
    """Over the words of all leaves, and those never met, with trained weights."""
    rng = np.random.default_rng(1)
    counts = np.sort(rng.integers(1, 500, 60_000))[::-1]
    words = rng.integers(0, 1 << 63, 60_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    head = lm.Head(words, counts)
    rank = head.rank(head.keys)
    cls, (leaf, last) = lm.classes(rank, head.keys), lm.leaves(rank, head.keys)
    ends, ranked = np.zeros(lm.ENDS), head.counts[: lm.RANKED] + 0.5
    np.add.at(ends, head.keys[lm.RANKED :].view(np.int64) % lm.ENDS, head.counts[lm.RANKED :] + 0.5)
    mass = 0.5 + ranked.reshape(-1, lm.CLASSES).sum(0) + ends.reshape(-1, lm.CLASSES).sum(0)
    model = lm.Model(mass, 1 << 12, ends, ranked.reshape(-1, lm.CLASSES))
    assert model.leaves.sum() + 0.5 * lm.CLASSES == pytest.approx(mass.sum()) == pytest.approx((counts + 0.5).sum() + 0.5 * lm.CLASSES)
    for w in model.weights:
        w += rng.normal(0, 1, w.shape).astype(np.float32)
    feats = lambda n: tuple(np.full(n, x, np.uint64) for x in (5, 77, 901))
    p = np.exp(model.step(np.arange(lm.CLASSES), feats(lm.CLASSES)))
    q = np.exp(model.within(cls, leaf, last, feats(len(cls)))) * 10 ** model.known(cls, leaf, last)
    assert (p[cls] * q * (head.counts + 0.5) / mass[cls]).sum() + (p * 0.5 / mass).sum() == pytest.approx(1, abs=1e-4)
    assert np.ptp(np.log(q)) > 1


def test_weight_tables_grow_without_an_end():
    """Beyond 65,536 rows as well, all of which are met and learned; row numbers are sorted as by one sort."""
    sizes = [lm.table_rows(10**k) for k in range(3, 16)]
    assert sizes == sorted(sizes) and sizes[0] == lm.LEAST_ROWS and sizes[7] > 1 << 16 and len(set(sizes[6:])) == len(sizes[6:])
    rng = np.random.default_rng(2)
    for rows, kind in ((1 << 16, np.uint16), (1 << 20, np.uint32)):
        i = rng.integers(0, rows, 5000).astype(kind)
        assert (lm._sorted(i) == np.argsort(i, kind="stable")).all()
    model = lm.Model(np.full(lm.CLASSES, 1.5), 1 << 18)
    seen = [np.zeros(len(w), np.float32) for w in model.weights]
    for _ in range(40):
        feats = tuple(rng.integers(0, 1 << 63, lm.BATCH, dtype=np.uint64) for _ in range(3))
        model.step(rng.integers(0, lm.CLASSES, lm.BATCH), feats, lm.RATE, seen)
    for level in (0, 1):
        assert seen[level].sum() == 3 * 40 * lm.BATCH
        quarters = seen[level].reshape(4, -1).sum(1)
        assert (quarters > 0.9 * quarters.mean()).all() and ((np.abs(model.weights[level]).sum(1) > 0) == (seen[level] > 0)).all()


def test_language_model_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """The same texts in 1 and in 7 partitions, in other orders and batches, with several shards, have the same scores."""
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{int(rng.random() ** 3 * 300)}" for _ in range(rng.randint(1, 300)))) for i in range(400)] + [(7, None), (7, "w1"), (None, "w1 w2"), (8, "long " * 100_000)]
    monkeypatch.setattr(lm, "SHARD_TOKENS", 16)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, keys string, h int")
    got = []
    for parts, size in ((1, 10_000), (7, 50)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got.append(sorted(((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in lm.score_texts(df.repartition(parts), head_words=100).collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got[0]) == len(docs)
    for a, b in zip(*got, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-6)
    assert lm.score_texts(df.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    plain = [f"word{i}" for i in range(300)]
    bad = ["idiot", "scum", "trash", "loser"]
    docs, labels = [], []
    for i in range(1500):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += [(5000, None), (5001, ""), (5002, "You are an 1d10t"), (None, "idiot")]
    d, n = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (9, None)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(d, n).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    only = toxicity.score_toxicity(d.limit(5), n.where("toxic = 0")).collect()
    assert {r.score for r in only} == {0.0} and toxicity.score_toxicity(d.limit(0), n).count() == 0


WEIGHTS = htmltext.weights_of(Counter())
PAGES = [
    ('<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad --><div class="ad">buy</div><article><h1>Head &amp; line</h1><p><b>One\n two.<br><p>Three &lt;b&gt;</p></article><footer>&copy; site</footer></body></html>', "Head & line\n\nOne two.\n\nThree <b>"),
    ("<body><div id='cookie-notice'>we use cookies</div><form><p>sign up</p></form><div><p>first words of it all</p><p>second part of this</p></div><div class='comments'><p>reader says</p></div><aside>more</aside>", "first words of it all\n\nsecond part of this"),
    ("<article><h1>A</h1><p>text</p><section class='reader-comments'><p>me too</p></section><p>end &#233;&nbsp;x</p></article>", "A\n\ntext\n\nend é x"),
    ("", ""), (None, ""), ("<p>", ""), ("no markup at all", "no markup at all"), ("<article><p>cut off &amp", "cut off &"), ("<script>never closed <p>x</p>", ""), ("<article><p>" + "long " * 50000 + "</p></article>", ("long " * 50000).strip()),
    # unclosed elements, stray quotes, headers of articles, names that only look like those of side elements
    ("<body><nav><ul><li><a href=/a>menu</a></ul><div><p>the text of the page stays</p><p>and so does this</p></div>", "the text of the page stays\n\nand so does this"),
    ("<body><nav class=menu><a href=/a>menu</a><article><p>the article is whole</p></article>", "the article is whole"),
    ("<p title=it's>first words here</p><p data-x=\"a>b\" class=don't>second words</p>", "first words here\n\nsecond words"),
    ("<article><header><h1>Head line</h1><p>by someone</p></header><p>text of it</p></article>", "Head line\n\nby someone\n\ntext of it"),
    ('<article><h1 class="article-header">Head</h1><h2 class="section-header">Part</h2><p class="search-engine">engines</p><div class="social-policy with-sidebar comments-open"><p>policy</p></div></article>', "Head\n\nPart\n\nengines\n\npolicy"),
    ("<article><p>a</p><div><div><div><div><p>b</p></div></div></div></div></article>", "a\n\nb"),
    ("<article><p>a b c</p><p class='notice'>cookies<p>d<p>e</article>", "a b c\n\nd\n\ne"),
    ("<main><p>one</p><div class='advert-top'>buy<div>now</div></div><p>two</p><article class='comment'><p>no</p></article></main>", "one\n\ntwo"),
    ("<article><p>one</p><div class='comment-section'>" + "<p>reader words</p>" * 300 + "</div><p>two</p></article><p>after</p>", "one\n\ntwo"),
    ("<article><p>see <a href=x>all of the long report here</a></p><p><a href=y>the next part</a></p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "see all of the long report here\n\nthe next part\n\nx\n\ny\n\n1\n\n2"),
    ("<article><p>x &amp;lt; y</p><p>a<b>b</b>c d<br>e <math>m</math></p><textarea>no</textarea></article>", "x &lt; y\n\nabc d e m"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert htmltext.main_text(page, WEIGHTS) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(-6, 0), st.integers(-8, 8), st.just(True)), max_size=12))
def test_best_run_equals_brute_force(scores):
    def total(a, b):
        return sum(c + w for c, w, _ in scores[a:b]) - scores[a][0]

    a, b = htmltext.best_run(scores)
    best = max((total(i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
    assert (total(a, b) if b > a else 0) == max(best, 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<nav>", "</nav>", "<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<li>", "<ul>", "</ul>", "word ", "&amp;", "<a href='", "'>", "</a>", "<br/>", "<", "<table><td>", "</tr>", "<!--", "-->"]), max_size=30))
def test_main_text_of_broken_pages(parts):
    page = "".join(parts)
    found = htmltext.blocks(page)
    assert all(b.words for b in found) and htmltext.main_text(page, WEIGHTS).count("word") <= page.count("word")


def test_main_text_learns_weights(spark):
    rows = [(i, f"http://x/{i}", p, 1) for i, (p, _) in enumerate(PAGES)] + [(50 + i, "u", f"<body><ul><li><a>menu {i}</a></li><li><a>item</a></li></ul><article><h1>Title {i}</h1><p class='alert'>{'in words ' * 30}</p><p>some words of page {i}</p></article>", 2) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, `keys` long")
    weights = htmltext.learn_weights(df)
    assert weights["words"] > 0 > weights["words-linked"] and weights["tag li"] < weights["tag p"] < 0
    assert weights["side .alert"] > -1 and weights["side .ad"] < -5
    got = {r.page_id: r for r in htmltext.extract_main_text(df).collect()}
    assert got[0].text == PAGES[0][1] and got[0].n_chars == len(PAGES[0][1]) and got[4].text == "" and got[55].text.startswith("Title 5\n\nin words") and got[55].text.endswith("some words of page 5")
    assert htmltext.extract_main_text(df.limit(0)).count() == 0
    copies = df.where("page_id = 50").crossJoin(spark.range(300).select(F.col("id").alias("copy"))).drop("copy")
    assert htmltext.learn_weights(copies.unionByName(df)) == weights


def test_models_that_ids_would_be_wrong_for_are_refused():
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        body = f.read()
    sentencepieces._check(body)
    part = lambda number, inner: bytes([number << 3 | 2, len(inner)]) + inner
    for trainer, rule in ((b"\x18\x01", b""), (b"\x18\x02", part(2, b"map")), (b"\x18\x02", b"\x20\x01")):
        with pytest.raises(ValueError):
            sentencepieces._check(part(2, trainer) + part(3, rule))


def test_kept_chunks_and_pieces_are_bounded(spark, monkeypatch):
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("etaoinéß日本") for _ in range(n))
    texts = [" ".join(word(rng.choice((3, 9, 2000))) for _ in range(rng.randint(1, 6))) for _ in range(120)]
    monkeypatch.setattr(sentencepieces, "KEPT_BYTES", 40_000)
    monkeypatch.setattr(tokencounts, "KEPT_BYTES", 20_000)
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        encoder = sentencepieces.Encoder(sentencepieces.Pieces(f.read()))
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    for at in range(0, 120, 10):
        assert [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts[at : at + 10])] == lib.encode(texts[at : at + 10])
        assert sum(map(sentencepieces._bytes, encoder.chunks)) == encoder.size < 60_000
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        with open(tokenizer_file(name), encoding="utf-8") as f:
            counter = tokencounts.Counter(f.read())
        other = Tokenizer.from_file(tokenizer_file(name))
        for at in range(0, 120, 10):
            assert counter.count(texts[at : at + 10]) == [len(other.encode(t, add_special_tokens=False).ids) for t in texts[at : at + 10]]
            assert sum(map(tokencounts._bytes, counter.pieces)) == counter.size < 60_000


def test_encoders_of_odd_tables(spark):
    """Empty tables, repeated rows, names that clash and a very long text without spaces."""
    model, path = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_50k.json")
    rows = [(1, "same", 5, "a"), (1, "same", 5, "a"), (None, None, 6, "b"), (2, "ab9" * 30_000, 7, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long, `n tokens` string")
    for out in (sentencepieces.encode_texts(df, model), tokencounts.count_tokens(df, path)):
        got = out.collect()
        assert len(got) == 4 and sum(r.n_tokens == 0 for r in got) == 1 and len({r.n_tokens for r in got if r.doc_id == 1}) == 1
    assert sentencepieces.encode_texts(df.limit(0), model).count() == tokencounts.count_tokens(df.limit(0), path).count() == 0
    assert sentencepieces.decode_ids(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), model).first().text == ""


def test_toxicity_of_odd_rows(spark):
    """Empty tables, repeated rows, names that clash, labels without documents and a very long text."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("fine", "words", "only")) for _ in range(20)) + (" you idiot scum" if i % 3 == 0 else ""), i, "x") for i in range(600)]
    rows += [(9000, "plain " * 200_000, 1, "x"), (9001, "idiot", 1, "x"), (9001, "idiot", 1, "x"), (9002, None, 1, "x"), (9003, "", 1, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score long, `row` string")
    n = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(10**6, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(d, n).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[9002].score == by[9003].score < 0.7 and 0 <= by[9000].score <= 1
    assert len({r.score for r in got if r.doc_id == 9001}) == 1
    assert toxicity.score_toxicity(d.limit(0), n.limit(0)).count() == 0
    assert {r.score for r in toxicity.score_toxicity(d, n.limit(0)).collect()} == {0.0}
    model = toxicity.fit_toxicity(d, n)
    assert model.score(d, carry=tuple(d.columns)).select("row.*").columns == d.columns
