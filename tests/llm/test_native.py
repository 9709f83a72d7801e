import hashlib
import random
import re

import pytest
import xxhash

from leafmill.llm import fingerprints, licenses

TEXTS = [
    (1, "Released under the MIT License. See CC BY and cc-by; MIT license"),
    (2, None),
    (3, ""),
    (4, "cc by cc by cc by-sa 4.0 the GNU General Public License v 3 or Apache License, Version 2.0"),
    (5, "écc by _cc by_ nothing; Kit license mit_license mit\nlicense"),
    (6, "plain words without any of it"),
    (7, "\x00mit license\x7fgnu  general,public license 😀 apache license"),
    (7, "\x00mit license\x7fgnu  general,public license 😀 apache license"),
]


def base_rows(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


MORE = [
    "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: Apache-2.0", "BSD-3-Clause", "MPL-2.0", "Apache 2.0", "GPLv3 or later", "GPLv3", "licensed under MIT", "released under the MIT", "License: MIT",
    "Lesser GPL v2.1", "licensed under the Apache License, Version 2.0", "under CC BY-SA 4.0", "to the extent possible under law", "All rights reserved.", "mit Liebe gemacht", "the GNU Lesser General Public License as published, GNU General Public License v2 only",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")", "Redistribution and use in source and binary forms, with or without modification, are permitted", "cc by cc by cc by",
    "0BSD zero-clause BSD; two clause bsd license; http://creativecommons.org/licenses/by-nc-sa/4.0/", "CC0 1.0 Universal", "Placed in the public domain", "EULA",
]


def plain_detections(text):
    """Every match of every rule, less those inside another of higher priority, or inside a longer (or the first by label) of the same."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    spaced = " " + "  ".join(w) + " "
    found = set()
    for _, pattern, label, priority, _ in licenses.rules():
        for m in re.finditer(pattern, spaced):
            at = len(spaced[: m.start()].split())
            found.add((at, at + len(m[0].split()), priority, label))
    inside = lambda d, e: e[0] <= d[0] and d[1] <= e[1] and (e[2] > d[2] or (e[2] == d[2] and (e[:2] != d[:2] or e[3] < d[3])))
    return sorted(d for d in found if not any(e != d and inside(d, e) for e in found))


def test_licenses_equal_brute_force(spark):
    rng = random.Random(4)
    parts = " ".join(x.split(": ")[1] for x in licenses.SIGNATURES.strip().splitlines())
    pool = re.findall(r"[a-z0-9]+", parts)
    texts = [t for _, t in TEXTS] + MORE + [" ".join(rng.choice((*MORE, *pool)) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    texts += [" ".join(rng.choice(w.split("|")) for w in re.sub(r"\[[^\]]+\]", lambda m: rng.choice(("", m[0][1:-1])), x.split(": ")[1]).split()) + "." for x in licenses.SIGNATURES.strip().splitlines()]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, `key` string, `__w` int")
    labels = set()
    for r in licenses.scan_licenses(df).collect():
        want = plain_detections(texts[r.doc_id])
        assert [(d.start, d.end, d.priority, d.label) for d in sorted(r.detections)] == want or sorted((d.start, d.end, d.priority, d.label) for d in r.detections) == want, texts[r.doc_id]
        base = base_rows(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base
        assert r.labels == ",".join(sorted({d[3] for d in want} | set(filter(None, base[4].split(",")))))
        left = 1.0
        for d in r.detections:
            left *= 1 - d.weight
        assert r.score == pytest.approx(max(1 - left, 0.5 if r.n_base else 0)) and 0 <= r.score <= 1
        labels |= set(r.labels.split(","))
    assert len(labels) > 60


@pytest.mark.parametrize("text,labels", [("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("BSD-3-Clause", "bsd-3-clause"), ("MPL-2.0", "mpl-2.0"), ("Apache 2.0", "apache-2.0"), ("GPLv3 or later", "gpl-3.0"), ("licensed under MIT", "mit"), ("Lesser GPL v2.1", "lgpl-2.1"), ("licensed under the Apache License, Version 2.0", "apache,apache-2.0"), ("under CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"), ("to the extent possible under law", ""), ("mit Liebe gemacht", "")])
def test_licenses_as_people_write_them(text, labels):
    assert ",".join(sorted({d[3] for d in plain_detections(text)} | set(filter(None, base_rows(text)[4].split(","))))) == labels


def test_gate_lets_every_signature_through():
    for line in licenses.SIGNATURES.strip().splitlines():
        need = re.sub(r"\[[^\]]+\]", " ", line.split(": ")[1]).split()
        stem = any(all(w.startswith(licenses.STEMS) for w in x.split("|")) for x in need)
        assert stem or "cc by" in " ".join(need) or need[-1] in ("mit", "isc", "zlib") and need[-2] in ("under", "under|by"), line
    assert len(licenses.rules()) >= 300 == len(set(licenses.SIGNATURES.strip().splitlines()[:300]))


def test_many_places_take_seconds(spark):
    import time

    df = spark.createDataFrame([(1, "mit license " * 100_000)], "doc_id long, text string")
    began = time.perf_counter()
    r = licenses.scan_licenses(df).first()
    assert (r.n_base, r.last_word, len(r.detections)) == (100_000, 199_998, 199_999) and time.perf_counter() - began < 60
    assert licenses.scan_licenses(df.limit(0)).count() == 0


MASK = (1 << 64) - 1
S = r"[^ \t\n\x0b\f\r]"


def plain_fingerprint(text):
    """Hash and place of each selected k-gram, by going through all windows."""
    units = [m[1] for m in re.finditer(rf"(?=((?<!{S}){S}{{1,16}}(?!{S})|{S}{{1,8}}))(?:(?<!{S}){S}{{1,16}}(?!{S})|{S})", text or "")]
    u = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in units]
    grams = []
    for i in range(max(len(u) - fingerprints.K + 1, min(len(u), 1))):
        h = 0
        for x in u[i : i + fingerprints.K]:
            h = ((h << 1 | h >> 63) ^ x) & MASK
        grams.append(h - (1 << 64) if h >> 63 else h)
    picked = []
    for i in range(max(len(grams) - fingerprints.WINDOW + 1, min(len(grams), 1))):
        span = grams[i : i + fingerprints.WINDOW]
        at = max(k for k, h in enumerate(span) if h == min(span)) + i
        if at not in picked:
            picked.append(at)
    return [(grams[k], k) for k in picked]


def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def as_text(fingerprint):
    return " ".join(dict.fromkeys(f"{h & MASK:x}" for h, _ in fingerprint))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeß日") for _ in range(rng.choice((1, 3, 5, 8, 16, 17, 30)))) for _ in range(n))


@pytest.mark.parametrize("block", [1 << 20, 3000, 1])
@pytest.mark.parametrize("ids", [[5, 3, 9], [7], [1, 4097, 8200, -3, 4096], list(range(0, 40000, 977)), [17**k for k in range(14)] + [-(5**20)]])
def test_fingerprints_of_edited_texts_equal_brute_force(spark, ids, block):
    texts = {i: prose(i, 1 + abs(i) % 60) for i in ids}
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in texts.items()], "doc_id long, text string, id string, __b int, __o int").repartition(3)
    order = sorted(ids, reverse=True)
    after = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    rows = {r.doc_id: r for r in fingerprints.edited_fingerprints(df, block_bytes=block).collect()}
    assert sorted(rows) == sorted(ids)
    for i, t in texts.items():
        cut = len(t) // 3
        edited = t[: len(t) - cut] + texts[after[i]][:cut]
        own, other, following = map(plain_fingerprint, (t, edited, texts[after[i]]))
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (as_text(own), as_text(other))
        assert r.near_edited == pytest.approx(jaccard(own, other)) and r.near_next == pytest.approx(jaccard(own, following))


def test_fingerprints_and_places_equal_brute_force(spark):
    texts = [None, "", " \n\t", "x", "a b", "a b c", "z " * 300, "日本語" * 200, "ab" * 3000, *(prose(k, n) for k, n in enumerate((1, 2, 9, 10, 11, 12, 60, 400)))]
    got = fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.id: [(x.hash, x.place) for x in r.fingerprint] for r in got} == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert [k for _, k in plain_fingerprint("z " * 300)] == list(range(fingerprints.WINDOW - 1, 300 - fingerprints.K + 1))


def test_likeness_is_the_same_at_every_length(spark):
    """Near copies of 399, 400 and 401 characters are alike, also where a character is put into text without spaces."""
    for text in (prose(1, 200).replace("日", "f"), "".join(chr(0x4E00 + 37 * k % 900) for k in range(900))):
        rows = [(2 * k, text[:n]) for k, n in enumerate((401, 400, 399))] + [(-1, text[:200] + "#" + text[200:401])]
        got = {r.doc_id: r.near_next for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert min(got[4], got[2], got[0]) > 0.8


def test_fingerprints_of_repeated_and_missing_ids(spark):
    rows = [(4, "one two three four"), (4, "other words here now"), (4, "one two three four"), (None, "no id at all"), (None, None), (9, "the first of them")]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["4", "4", "4", "9", "None", "None"]
    same = [r for r in got if r.doc_id == 4 and r.n_chars == 18]
    assert len({r.fingerprint for r in same}) == 1 and sorted(r.near_next for r in same) == [0.0, 1.0]
    assert spark.createDataFrame([], "doc_id long, text string").transform(fingerprints.edited_fingerprints).count() == 0


def test_fingerprint_of_a_very_long_text(spark):
    text = " ".join(f"w{k * k % 7919}" for k in range(400_000))
    df = spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")
    assert all(r.near_next > 0.99 for r in fingerprints.edited_fingerprints(df).collect())


def test_winnowing_guarantee(spark):
    """Texts that share enough units in a row share a selected hash."""
    shared = " ".join(f"common{i}" for i in range(fingerprints.WINDOW + fingerprints.K - 1))
    rows = [(k, " ".join(f"own{k}x{i}" for i in range(60)) + " " + shared + " " + " ".join(f"tail{k}y{i}" for i in range(40 + k))) for k in range(6)]
    got = [{x.hash for x in r.fingerprint} for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert all(a & b for a in got for b in got)


def test_native_plans_run_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for out in (licenses.scan_licenses(df), fingerprints.edited_fingerprints(df), fingerprints.fingerprints(df)):
        assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().optimizedPlan().toString())
