"""Main text of web pages by a maximum-scoring subsequence of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.schemas import schema

#: Pages that weights are learned from at most: a bounded sample of the pages that mark their article.
LABELLED_PAGES = 2000

#: Comments, declarations and tags. A quote counts only after an equals sign, so a stray one ends nothing.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
RAW = frozenset("script style noscript template textarea iframe svg canvas title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul video audio".split())
#: Elements that the start of another ends, with the element that the search for them stops at.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)), "option": (("option",), ("select",))}
OPEN_ENDED = frozenset("p li dd dt td th tr thead tbody tfoot option optgroup body html head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset(("article", "main"))

#: Features: elements, and words of class, id or role, that usually hold what is not the article.
SIDE_TAGS = frozenset("nav header footer aside form menu dialog button select fieldset".split())
SIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts popup popups modal sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations subscribe subscription newsletter signup search login pagination pager widget widgets toolbar skip complementary contentinfo".split())
#: Those of them that an article element may be: a reader's.
REPLIES = frozenset("comment comments reply replies".split())
#: Words that may stand beside them in a hyphenated name; any other word makes it a name of something else.
BESIDE_WORDS = frozenset("area bar block bottom box button buttons container element footer form global group holder icons inner item items left link links list main message outer page panel posts reader readers right section site slot strip thread top unit user users widget wrap wrapper".split())
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORD = re.compile(r"[A-Za-z]+?(?=[A-Z][a-z]|[^A-Za-z]|$)")

#: What a page's own mark of its article adds to a word inside it, and takes from one outside.
MARK = 3.0
#: Words that a side feature counts as seen with, in and out of articles, before any page is read.
SIDE_PRIOR = (1, 400)


class Block(NamedTuple):
    tags: list[str]  # since the block before
    words: list[str]
    article: bool
    main: bool
    linked: bool
    sides: tuple[str, ...]  # side features of the elements around it


def tokens(page: str):
    """(kind, name or text, attributes) of a page: open and close tags, and text between them; raw elements are passed over."""
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else (end if name in ("script", "style") else at)
        else:
            yield "open", name, m[3] or ""


def side_features(name: str, attributes: str, in_article: bool) -> list[str]:
    """Side features of an element. The header of an article is none; neither is a heading, whatever its class."""
    if name in HEADINGS or name in ("html", "body", "main"):
        return ["hidden"] if HIDDEN.search(attributes) else []
    found = [name] if name in SIDE_TAGS and not (name == "header" and in_article) else []
    if attributes:
        for _, *values in ATTRIBUTE.findall(attributes):
            for token in "".join(values).split():
                words = [w.lower() for w in WORD.findall(token)]
                side = [w for w in words if w in (SIDE_WORDS if name != "article" else REPLIES)]
                if side and all(w in SIDE_WORDS or w in BESIDE_WORDS for w in words) and not (side == ["header"] and in_article):
                    found += ["." + w for w in side]
        if HIDDEN.search(attributes):
            found.append("hidden")
    return found


class _Open(NamedTuple):
    name: str
    index: int
    sides: tuple[str, ...]
    article: int
    main: int


def _walk(found: list, closed: set[int] | None):
    """Goes through tokens with the stack of open blocks: yields (token number, the innermost block) before each token.

    An end tag ends what is open inside its element; starts end what HTML says they end.
    closed: the elements that have an end tag (None: to find them). Any other element
    that should have one holds nothing: its features do not spread to the rest of the page.
    """
    bottom = _Open("", -1, (), 0, 0)
    stack = [bottom]
    count: Counter = Counter()
    ended: set[int] = set()

    def pop() -> _Open:
        top = stack.pop()
        count[top.name] -= 1
        return top

    for k, (kind, name, attributes) in enumerate(found):
        if kind == "open" and name in BLOCK:
            if stack[-1].name == "p":
                pop()
            ends, stop = IMPLIED.get(name, ((), ()))
            if any(count[x] for x in ends):
                i = len(stack) - 1
                while i > 0 and stack[i].name not in ends and stack[i].name not in stop:
                    i -= 1
                if i > 0 and stack[i].name in ends:
                    while len(stack) > i:
                        pop()
        yield k, stack[-1], ended
        if name not in BLOCK or kind == "text":
            continue
        if kind == "open":
            if name in VOID or attributes.endswith("/") and name not in ("p", "div", "li"):
                continue
            up = stack[-1]
            holds = closed is None or k in closed or name in OPEN_ENDED
            sides = up.sides
            if holds and closed is not None:
                sides += tuple(x for x in dict.fromkeys(side_features(name, attributes, up.article + up.main > 0)) if x not in sides)
            stack.append(_Open(name, k, sides, up.article + (name == "article" and holds), up.main + (name == "main" and holds)))
            count[name] += 1
        elif count[name]:
            while True:
                top = pop()
                if top.name == name:
                    ended.add(top.index)
                    break


def blocks(page: str) -> list[Block]:
    """Blocks of text of a page in order, with the tags between them and what is open around them."""
    found = list(tokens(page))
    closed: set[int] = set()
    for _, _, closed in _walk(found, None):
        pass
    # an article that is cut off with its page has no end tag; it is held to be whole
    closed |= {k for k, (kind, name, _) in enumerate(found) if kind == "open" and name in ARTICLE}
    out: list[Block] = []
    tags: list[str] = []
    text: list[str] = []
    links = linked = total = 0
    around = None
    for k, inner, _ in _walk(found, closed):
        kind, name, _ = found[k]
        if kind == "text":
            if around is None:
                around = inner
            text.append(html.unescape(name))
            total += len(name)
            linked += len(name) * (links > 0)
            continue
        if name == "br":
            text.append(" ")
        elif name in BLOCK:
            words = "".join(text).split()
            if words:
                out.append(Block(tags, words, around.article > 0, around.main > 0, 2 * linked > total, around.sides))
                tags = []
            text, linked, total, around = [], 0, 0, None
        elif name == "a":
            links = links + 1 if kind == "open" else max(0, links - 1)
        tags.append(name)
    words = "".join(text).split()
    if words:
        out.append(Block(tags, words, around.article > 0, around.main > 0, 2 * linked > total, around.sides))
    return out


def _marked(found: list[Block]) -> list[bool] | None:
    """Whether each block is inside the article that the page marks (its article elements, else its main); None without a mark."""
    for pick in (lambda b: b.article, lambda b: b.main):
        inside = [pick(b) for b in found]
        if any(x and not b.sides for x, b in zip(inside, found, strict=True)):
            return inside
    return None


KNOWN_TAGS = BLOCK | VOID | frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label map mark object output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var".split())


def tallies(page: str) -> Counter:
    """How often words, tags and side features occur in and out of a page's marked article; nothing for a page without one."""
    counts: Counter = Counter()
    found = blocks(page)
    inside = _marked(found)
    if inside is None:
        return counts
    for b, where in zip(found, inside, strict=True):
        side = "in" if where else "out"
        counts[side, "words-linked" if b.linked else "words"] += len(b.words)
        for t in b.tags:
            counts[side, "tag " + (t if t in KNOWN_TAGS else "other")] += 1
        for s in b.sides:
            counts[side, "side " + s] += len(b.words)
    return counts


def _count(batches):
    for batch in batches:
        total: Counter = Counter()
        for page in batch.column("html").to_pylist():
            total.update(tallies(page))
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["side", "name", "n"])


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", limit: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights of words (positive), tags and side features (negative) from at most limit different pages that mark their article.

    The sample is taken by a hash of id and page, so it is the same at every run; hashes
    alone are sorted for it, and the pages are read where they are. Names are those of
    KNOWN_TAGS and of the side features: there are some hundred weights, whatever the pages.
    """
    marked = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where(F.col("html").rlike(r"(?i)<(article|main)\b")).select(F.xxhash64("id", "html").alias("h"), "html")
    chosen = marked.select("h").distinct().orderBy("h").limit(limit)
    sample = marked.join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("html").alias("html")).select("html")
    counts = sample.mapInArrow(_count, "side string, name string, n long").groupBy("side", "name").agg(F.sum("n").alias("n"))
    seen: Counter = Counter()
    for row in counts.toLocalIterator():
        seen[row.side, row.name] += row.n
    return weights_of(seen)


def weights_of(seen: Counter) -> dict[str, float]:
    """Log odds of being inside an article, between bounds that keep words positive and tags and sides negative."""
    odds = lambda name, a, b: math.log((seen["in", name] + a) / (seen["out", name] + b))
    bound = lambda x, low, high: max(low, min(high, x))
    weights = {"words": bound(odds("words", 0.5, 0.5), 0.25, 2.0) if seen["in", "words"] else 1.0, "words-linked": bound(odds("words-linked", 0.5, 5.0), -2.0, -0.25)}
    for tag in (*KNOWN_TAGS, "other"):
        name = "tag " + tag
        weights[name] = bound(odds(name, 0.5, 0.5), -1.0, -0.01) if seen["in", name] + seen["out", name] else -0.3
    for side in (*SIDE_TAGS, *("." + w for w in SIDE_WORDS), "hidden"):
        weights["side " + side] = bound(odds("side " + side, *SIDE_PRIOR), -6.0, 0.0)
    return weights


def scored(found: list[Block], weights: dict[str, float]) -> list[tuple[float, float, bool]]:
    """(score of the tags before a block, score of its words, whether it belongs to a run that covers it), for each block."""
    inside = _marked(found)
    out = []
    for k, b in enumerate(found):
        mark = 0.0 if inside is None else MARK if inside[k] else -MARK
        sides = sum(weights["side " + s] for s in b.sides)
        word = weights["words-linked" if b.linked else "words"] + mark + sides
        belongs = sides > -1.0 or word > 0
        if mark > 0:  # what the page marks is one piece: its tags cost nothing, its side pieces are left out
            out.append((0.0, len(b.words) * min(word, 2.0) if belongs and word > 0 else 0.0, belongs))
        else:
            cost = sum(weights.get("tag " + t, weights["tag other"]) for t in b.tags)
            out.append((cost, len(b.words) * max(-1.0, min(word, 2.0)), belongs))
    return out


def best_run(scores: list[tuple[float, float, bool]]) -> tuple[int, int]:
    """First and past-last block of the contiguous run of the largest sum, the first of equals, in one linear scan; the tags before the first block are not in it."""
    best = here = 0.0
    begin, span = 0, (0, 0)
    for i, (cost, worth, _) in enumerate(scores):
        if here + cost <= 0:
            here, begin, cost = 0.0, i, 0.0
        here += cost + worth
        if here > best:
            best, span = here, (begin, i + 1)
    return span


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Main text of one page: blocks joined by two line feeds.

    Words score their positive weight and tags their negative one; words in links, inside
    side elements (menus, notices, comments, ...) or outside the article that the page
    marks score below zero. The contiguous run of blocks with the largest sum is the
    article, and side elements inside it are left out.
    """
    found = blocks(page) if page else []
    if not found:
        return ""
    scores = scored(found, weights)
    a, b = best_run(scores)
    return "\n\n".join(" ".join(x.words) for x, (_, _, belongs) in zip(found[a:b], scores[a:b], strict=True) if belongs)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page, one row per row.

    Null and empty pages, and pages without words, have the empty text. A page of any
    length is read whole. Repeated rows give repeated rows, an empty table gives none; other
    columns of pages, whatever their names, are not read. Ties between runs go to the first.
    """
    held = weights or learn_weights(pages, id_col, html_col)

    def run(batches):
        for batch in batches:
            texts = [main_text(x, held) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("keys"), pa.array(texts, pa.string())], names=["keys", "text"])

    rows = pages.select(F.struct(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).alias("keys"), F.col(html_col).alias("html"))
    found = rows.mapInArrow(run, schema(rows.schema["keys"], "text string"))
    return found.select("keys.page_id", "keys.url", "text", F.char_length("text").cast("long").alias("n_chars"))
