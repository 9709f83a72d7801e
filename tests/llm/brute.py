"""Plain versions of the operators, for small tables."""

import hashlib
import re

UPPER = re.compile("[A-Z]")


def low(text):
    return UPPER.sub(lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))


def components(nodes, links):
    best = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(best[a], best[b])
            if best[a] != m or best[b] != m:
                best[a] = best[b] = m
                moved = True
    return best


def near_duplicates(docs, over=100, of=85):
    sets = {}
    for i, t in docs:
        w = spaced(low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and over * len(sets[a] & sets[b]) >= of * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(ids, links).items()}


def substrings(docs, window=50):
    first = {}
    for i, t in docs:
        w = spaced(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in docs:
        w = spaced(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else t)
    return out


def contamination(docs, items, window=13):
    out = {}
    for i, t in docs:
        w, hit, found = alnum(t), set(), set()
        for name, text in items:
            b = alnum(text)
            n = min(window, len(b))
            grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found.add(str(name))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out
