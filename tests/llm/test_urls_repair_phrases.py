import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import phrases, repair, urlfilter
from leafmill.llm.queries import oracle_sql, queries
from tests.llm.brute import components, low
from tests.oracle import spark_rows, sql_rows

# urls


def rule_of(url, rules=urlfilter.RULES):
    if url is None or "://" not in url:
        return "", "", None, None
    host, path = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url).groups()
    host = low(host)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def test_blocks_reach_aliases_and_allow_takes_precedence(spark):
    head = lambda tag: f"<html><head>{tag}</head><p>text</p></html>"
    pages = [
        (1, "http://spam.net/es/1", None),
        (2, "https://a.org/x", head('<link rel="canonical" href="http://spam.net/es/1">')),
        (3, "https://b.org/y", head("<meta http-equiv='refresh' content='0; URL=https://a.org/x'>")),  # over two links
        (4, "https://c.org/dir/z", head('<LINK HREF="../q?a=1&amp;b=2" REL="alternate canonical">')),  # relative, to no page
        (5, "https://c.org/q?a=1&b=2", ""),
        (6, "http://fine.com/p", head('<link rel=canonical href="http://spam.net/es/1">')),  # allowed by its own rule
        (7, "http://example.com:80/en/k", None),  # the port hides the host of a rule; another rule fits com:80? no
        (8, "http://example.com/en/k#top", None),
        (9, "https://d.org/n", head('<!-- <link rel="canonical" href="http://spam.net/es/1"> --><script>var x = \'<link rel="canonical" href="http://spam.net/es/1">\'</script>')),
        (10, None, head('<link rel="canonical" href="http://spam.net/es/1">')),
        (11, "no url", None),
        (12, "https://e.org/m", head('<link rel="canonical" href="http://[bad">')),
        (13, "HTTP://WWW.Example.COM/en/1", None),
        (14, "https://a.org/x", None),
        (15, "https://f.org", None),
        (16, "https://g.org/1?x#y", None),
        (17, "https://h.org/", head("<link " + "a'b\"c" * 50_000 + '><link x="' + "y" * 300_000 + '" rel="canonical" href="//a.org/x">')),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, rule string")
    redirects = spark.createDataFrame([("https://f.org/", "https://g.org/1?x"), ("https://g.org/1?x", "http://sub.spam.net/fr/0")], "src string, dst string")
    got = {r.page_id: r for r in urlfilter.filter_urls(df, redirects=redirects).collect()}
    assert {i for i, r in got.items() if r.by_alias} == {2, 3, 7, 14, 15, 16, 17}
    for i, url, _ in pages:
        host, path, rule, verdict = rule_of(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if got[i].by_alias else "allow"))
    assert got[8].verdict == "block" and got[13].verdict == "allow" and got[6].verdict == "allow"
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


def test_long_chains_and_a_hot_component(spark):
    """A chain of 200 redirects, and a target of 3,000: one block reaches all of them."""
    urls = [f"https://h{i}.org/" for i in range(200)] + [f"https://k.org/{i}" for i in range(3000)] + ["https://free.org/"]
    links = [(a, b) for a, b in zip(urls[:199], urls[1:200], strict=True)] + [(u, urls[100]) for u in urls[200:3200]] + [(urls[199], "http://x.net/fr/")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = urlfilter.filter_urls(df, redirects=spark.createDataFrame(links, "src string, dst string"), html_col=None)
    assert {r.page_id for r in out.where("verdict = 'block'").collect()} == set(range(3200))


@settings(max_examples=8, deadline=None)
@given(st.randoms(use_true_random=False))
def test_rules_of_a_table_equal_compiled_ones(spark, rng):
    labels, parts = ["a", "b", "com", "net", ""], ["/", "/x", "/x/", "/x/y", "", "/é"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = sorted({(host(), rng.choice(parts)) for _ in range(30)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules if h]
    urls = [f"http://{host()}{rng.choice(parts)}{rng.choice(parts)}" for _ in range(80)]
    df = spark.createDataFrame([(i, u, *rule_of(u, rules)) for i, u in enumerate(urls)], "id long, url string, host string, path string, want string, verdict string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for given_rules in (tuple(rules), table):
        got = urlfilter.matched(df, given_rules).collect()
        lengths = lambda r: None if r is None else len(r)  # noqa: E731  rules of one length may tie: host.com/ has one spelling only
        assert all(lengths(r.rule) == lengths(r.want) for r in got) and len(got) == 80


# conversations


def plain_edits(rows):
    """All edits of a few rows (initial, must go, ends open): the cheapest, then ASCII-least."""
    inserted = [list(x) for n in range(3) for x in itertools.product("ua", repeat=n)]
    best = None
    choices = [[(ins, e) for ins in inserted for e in ([("D", 3, "")] + ([] if gone else [("K", 0 + o, r), ("R", 2 + o, "u"), ("R", 2 + o, "a")]))] for r, gone, o in rows]
    for path in itertools.product(*choices, [(ins, ("", 0, "")) for ins in inserted]):
        cost, audit, roles = 0, "", ""
        for ins, (letter, c, role) in path:
            cost, audit, roles = cost + 2 * len(ins) + c, audit + "I" * len(ins) + letter, roles + "".join(ins) + role
        if (best is None or (cost, audit) < best) and re.fullmatch("(s?(ua)+)?", roles):
            best = (cost, audit)
    return best


def plain_path(rows):
    """The same for any length: the least (cost, letters) of each state, row by row."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    after = lambda s, c: c if c in step.get(s, "") else None

    def inserts(states):
        for _ in range(2):
            for s, (cost, audit) in list(states.items()):
                for c in "ua":
                    if after(s, c):
                        states[c] = min(states.get(c, (10**9, "")), (cost + 2, audit + "I"))
        return states

    states = {"": (0, "")}
    for r, gone, o in rows:
        now = {}
        for s, (cost, audit) in inserts(states).items():
            for letter, c, to in [("D", 3, s)] + ([] if gone else [("K", o, after(s, r))] + [("R", 2 + o, after(s, x)) for x in "ua"]):
                if to is not None:
                    now[to] = min(now.get(to, (10**9, "")), (cost + c, audit + letter))
        states = now
    states = inserts(states)
    return min(states[s] for s in ("", "a") if s in states)


def joined(rows, size):
    all_rows = repair.Joined()
    for at in range(0, len(rows), size):
        all_rows.add([{"a": a, "b": b, "cost": c, "audit": t} for (a, b), (c, t) in repair.ways(rows[at : at + size]).items()])
    return all_rows.end()


ROWS = st.tuples(st.sampled_from(["s", "u", "u", "a", "a", "x", ""]), st.booleans(), st.booleans())


@settings(max_examples=25, deadline=None)
@given(st.lists(ROWS, max_size=2))
def test_edits_are_the_cheapest_of_all(rows):
    rows = [(r if r else "?", g, o) for r, g, o in rows]
    assert joined(rows, 9) == plain_edits(rows) == plain_path(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(ROWS, max_size=40), st.integers(1, 12))
def test_edits_of_blocks_equal_plain_ones(rows, size):
    want = plain_path([(r or "?", g, o) for r, g, o in rows])
    assert joined(rows, size) == joined(rows, 99) == want


def plain_report(rows):
    """rows: conv_id, turn, role, text."""
    out = {}
    for c in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == c):
            role, text = (" " if x is None else x for x in (role, text))
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            kept += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        cost, audit = plain_path([(r[:1] or "?", f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(kept, faults, strict=True)])
        lines, rest, state = [], iter(kept), ""
        for letter in audit:
            due = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            if letter == "I":
                lines.append((due, ""))
            else:
                _, role, text = next(rest)
                if letter == "D":
                    continue
                lines.append((role if letter == "K" else due, text))
            state = lines[-1][0][:1]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        count = Counter(faults)
        out[c] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversations(seed=5):
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), None]:
        for turn in range(rng.randint(1, 12)):
            text = rng.choice(["Hello.", "What? ", "no end", " \t", "", None, "x", "Yes!\n", "é"])
            rows.append((c, rng.choice([turn, turn, turn, None, turn + 3]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), text))
    rows += [(100, i, "assistant" if i % 2 else "user", f"t {i}.") for i in range(900)]  # several blocks
    rows += [(101, 5, "user", "same.")] * 700 + [(101, None, "user", "same.")]
    rows += [(next(i for i in range(200, 999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0), 0, "user", "dropped.")]
    return rows


def test_reports_equal_a_plain_version(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, n long, first string").repartition(5)
    want = plain_report(rows)
    for block in (repair.BLOCK, 7):
        got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair_conversations(df, block=block).collect()}
        assert got == want
    assert want[next(r[0] for r in reversed(rows))] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair_conversations(df.limit(0)).count() == 0


def test_without_damage_a_legal_conversation_stays(spark):
    rows = [("c", 0, "system", "S."), ("c", 1, "user", "Q?"), ("c", 2, "assistant", "A." * 200_000)]
    r = repair.repair_conversations(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"), damage=False).first()
    assert (r.cost, r.audit, r.illegal) == (0, "KKK", 0)
    assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for *_, a, b in rows).encode()).hexdigest()


# phrases


def plain_phrases(rows, least=10, inside=50, top=2000):
    out = []
    by_lang = {}
    for lang, text in rows:
        by_lang.setdefault("und" if lang is None else lang, []).extend(re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low(text)))
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in (1, 2, 3) for i in range(len(p) - k + 1))
        often = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in often.items():
            if any(len(h) > len(g) and g in (h[:2], h[1:]) and 100 * b >= inside * a for h, b in often.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        n = sum(len(p) for p in pieces)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(seed=2):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "été", "a", "b", "c", "ÉTÉ", "x\x0by", "d e"] + [f"w{i}" for i in range(60)]
    fixed = ["new york times", "the of", "a b c", "A B c d", "été été été"]
    rows = []
    for _ in range(400):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice(["en", "de", None, "und", ""]), "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ".", "?!"]) for p in parts)))
    rows += [("en", None), ("en", ""), ("en", "...;\n"), ("fr", "ok " * 9), ("en", rows[0][1])]
    rows += [("long", " ".join(rng.choice(words) for _ in range(60_000)))]
    return rows


@pytest.mark.parametrize(("shard", "bucket", "top"), [(phrases.SHARD_BYTES, phrases.BUCKET, 2000), (9_000, 50, 7)])
def test_phrases_equal_a_plain_count(spark, monkeypatch, shard, bucket, top):
    rows = texts()
    df = spark.createDataFrame([(lang, t, 1, "z") for lang, t in rows], "lang string, text string, n long, phrase string")
    out = phrases.mine_phrases(df, shard_bytes=shard, bucket=bucket, top=top)
    assert sorted(map(tuple, out.collect())) == plain_phrases(rows, top=top)
    assert phrases.mine_phrases(df.limit(0)).count() == 0


def test_small_slices_and_flushes_change_nothing():
    """The same from tokens cut every few bytes and filters sent every few n-grams."""
    rows = texts(4)[:150]
    p = phrases.Packing(16, 3)
    ids = {}
    data = [[ids.setdefault(w, len(ids) + 1) for w in low(t or "").split()] for _, t in rows]
    x = np.array([w for d in data for w in d], np.uint64)
    parts = [p.filters(*p.summed(*p.permuted(x[k : k + 500], x[k : k + 500], x[k : k + 500]), None)) for k in range(0, len(x), 500)]
    entries = [p.read(*(c[i].as_py() for c in part.columns)) for part in parts for i in range(part.num_rows)]
    high, low_half, n = p.summed(*(np.concatenate(e) for e in zip(*entries, strict=True)))
    a, b, c = p.restored(high, low_half)
    assert (a == b).all() and (b == c).all() and dict(zip(a.tolist(), n.tolist(), strict=True)) == Counter(x.tolist())
    text = "Ab, cd\tef" * 7 + "." + "q" * 50
    whole = [w for part in phrases.tokens(text) for w in part if w]
    old, phrases.SLICE = phrases.SLICE, 5
    try:
        assert [w for part in phrases.tokens(text) for w in part if w] == whole
    finally:
        phrases.SLICE = old


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 42), st.integers(0, 30), st.data())
def test_filters_keep_every_number_and_count(bits, bucket_bits, data):
    word = st.integers(0, (1 << bits) - 1)
    grams = data.draw(st.dictionaries(st.tuples(word, word, word), st.one_of(st.integers(1, 300), st.integers(1, 1 << 40)), min_size=1, max_size=40))
    p = phrases.Packing(bits, bucket_bits)
    x, y, z = (np.array(v, np.uint64) for v in zip(*grams, strict=True))
    made = p.filters(*p.summed(*p.permuted(x, y, z), np.array(list(grams.values()), np.int64)))
    got = {}
    for i in range(made.num_rows):
        high, low_half, n = p.read(*(c[i].as_py() for c in made.columns))
        got |= dict(zip(zip(*(v.tolist() for v in p.restored(high, low_half)), strict=True), n.tolist(), strict=True))
    assert got == grams


@pytest.mark.parametrize("name", ["op11_urls", "op13_phrases"])
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    df = queries()[name](spark, sf)
    columns = sorted(df.columns)
    assert spark_rows(df, columns) == sql_rows(oracle_sql()[name], sf, columns)


def test_repair_query_equals_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries()["op12_repair"](spark, sf).collect()} == plain_report(rows)
    assert components([1, 2], [(1, 2)]) == {1: 1, 2: 1}
