"""SentencePiece encoding and decoding by suffix-array matching.

A batch's new chunks (a space and what follows up to the next one) are joined to one text
whose suffixes are sorted; each piece of the vocabulary finds its places by binary search.
The places are edges from a piece's start to its end. Sorted by position, they are relaxed:
an edge is taken where the best path to its start ends in a piece that stands next to it in
the model's own merge order. For a model of merges (BPE) that gives the one path which
merging gives, since a sequence of pieces is the merge result exactly when each adjacent
pair is.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.schemas import schema
from leafmill.llm.worker import hold, trim

SPACE = "▁"
#: Bytes of chunks, with what Python adds to each, that a worker keeps encoded; when they are more, those not met since go.
KEPT_BYTES, EACH = 32 << 20, 160
#: Chunks of more characters are encoded anew each time.
KEPT_CHARS = 1000
#: Chunks longer than this are relaxed one by one.
LONG = 400
MEMO_BITS = 21
NEVER = 1 << 30
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


class Pieces:
    """The vocabulary of a model: pieces, merge ranks, and how each piece is merged from two others."""

    def __init__(self, body: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=body)
        _check(body)
        n = sp.get_piece_size()
        self.texts = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        bare = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.ids = {t: i for i, t in enumerate(self.texts) if bare[i]}
        self.bytes = {int(self.texts[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.score = {t: sp.get_score(i) for t, i in self.ids.items()}
        order = sorted(self.ids, key=lambda t: (-self.score[t], self.ids[t]))
        rank = np.full(n + 1, -1, np.int64)
        for r, t in enumerate(order):
            if len(t) > 1:
                rank[self.ids[t]] = r
        self.rank = rank
        # a piece of several characters is the result of merging them, or it is never made
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        usable, pairs = [], {}
        for t, i in self.ids.items():
            if len(t) > 1:
                for k in range(1, len(t)):
                    a, b = self.ids.get(t[:k]), self.ids.get(t[k:])
                    if a is not None and b is not None:
                        pairs[a * (n + 1) + b] = int(rank[i])
            if SPACE in t[1:]:
                continue  # runs of spaces are merged plainly
            got = self.merge(t)
            if len(t) == 1 or len(got) == 1:
                usable.append((t, i))
                if len(t) > 1:
                    a, b = self._last
                    self.left[i], self.right[i] = self.ids[a], self.ids[b]
        self.width = -(-max((len(t) for t, _ in usable), default=1) // 8) * 8  # characters of the longest piece, in eights
        self.letters = np.zeros((len(usable), self.width), np.uint32)
        for r, (t, _) in enumerate(usable):
            self.letters[r, : len(t)] = [ord(c) for c in t]
        self.lengths = np.array([len(t) for t, _ in usable], np.int32)
        self.usable_ids = np.array([i for _, i in usable], np.int32)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_ranks = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.n = n

    def merge(self, text: str) -> list[str]:
        """Plain merging by best score, leftmost first: used for runs of spaces and to learn how pieces are made."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            whole = parts[i] + parts[j]
            if whole in self.score:
                heapq.heappush(heap, (-self.score[whole], i, j, whole))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != whole:
                continue
            self._last = (parts[i], parts[j])
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def to_ids(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids) -> str:
        """Text of ids; bytes that make no character, and ids that are null or outside of the vocabulary, become U+FFFD. The space put before a text is taken off."""
        out = []
        run: list[int] = []
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(bytes(run).decode("utf-8", "replace"))
                run = []
            out.append(self.texts[i] if i is not None and 0 <= i < len(self.texts) else "\ufffd")
        if run:
            out.append(bytes(run).decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _fields(message: bytes):
    """(field number, value) of a message in the wire format of protocol buffers."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            shift += 7
            at += 1
            if message[at - 1] < 128:
                return value, at

    at = 0
    while at < len(message):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


def _check(body: bytes) -> None:
    """Raises for a model that these ids would be wrong for: one that is not of merges, or that changes the text first."""
    model = dict(_fields(body))  # 2: trainer, 3: normaliser (numbers of the published format)
    trainer, rule = dict(_fields(model.get(2, b""))), dict(_fields(model.get(3, b"")))
    if trainer.get(3, 1) != 2:
        raise ValueError("a model of merges (BPE) is needed")
    if rule.get(2) or rule.get(4, 1) != 0 or rule.get(3, 1) != 1 or rule.get(5, 1) != 1:
        raise ValueError("a model that leaves its text as it is, but for the space put before it, is needed")


class Encoder:
    """Encodes texts with one vocabulary; keeps chunks, and pairs of pieces that may stand side by side."""

    def __init__(self, pieces: Pieces):
        self.v = pieces
        self.chunks: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0
        self.memo_keys = np.full(1 << MEMO_BITS, -1, np.int64)
        self.memo = np.zeros(1 << MEMO_BITS, dtype=bool)

    # pairs

    def _crossing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of two pieces, NEVER if there is none."""
        keys = a * (self.v.n + 1) + b
        at = np.minimum(np.searchsorted(self.v.pair_keys, keys), len(self.v.pair_keys) - 1)
        return np.where(self.v.pair_keys[at] == keys, self.v.pair_ranks[at], NEVER)

    def _side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair as it is: no merge over the border may come before the ones inside.

        The later made of the two is taken apart, and what then stands at the border is looked
        at, until both are single characters.
        """
        good = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), NEVER)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(live):
            bad = self._crossing(a, b) < limit
            good[live[bad]] = False
            ra, rb = self.v.rank[a], self.v.rank[b]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)  # among equals the left one is merged first
            go = ~bad & (np.maximum(ra, rb) >= 0)
            a, b = np.where(first, self.v.right[a], a), np.where(first, b, self.v.left[b])
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return good

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * (self.v.n + 1) + b
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        out = self.memo[slot]
        new = np.flatnonzero(self.memo_keys[slot] != keys)
        if len(new):
            fresh, place = np.unique(keys[new], return_inverse=True)
            got = self._side_by_side(fresh // (self.v.n + 1), fresh % (self.v.n + 1))[place]
            out[new] = got
            self.memo_keys[slot[new]], self.memo[slot[new]] = keys[new], got
        return out

    # matching

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of every place of every piece, by a suffix array; text: code points, chunks parted by 0."""
        alphabet = np.unique(text)
        wide = len(alphabet) > 255
        bits, per = (16, 4) if wide else (8, 8)
        code = np.searchsorted(alphabet, text).astype(np.uint64)
        width = self.v.width
        padded = np.concatenate((code, np.zeros(width, np.uint64)))
        n = len(text)
        keys = []
        for k in range(0, width, per):
            key = np.zeros(n, np.uint64)
            for j in range(per):
                key |= padded[k + j : k + j + n] << np.uint64(bits * (per - 1 - j))
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        here = np.isin(self.v.letters, alphabet) | (self.v.letters == 0)
        rows = np.flatnonzero(here.all(axis=1))
        if not len(rows):
            none = np.zeros(0, np.int32)
            return none, none, none
        length, ids = self.v.lengths[rows], self.v.usable_ids[rows]
        codes = np.where(self.v.letters[rows] == 0, 0, np.searchsorted(alphabet, self.v.letters[rows])).astype(np.uint64)
        lows = [np.bitwise_or.reduce([codes[:, k + j] << np.uint64(bits * (per - 1 - j)) for j in range(per)]) for k in range(0, width, per)]
        spare = [np.uint64(bits) * np.clip(per - (length - k), 0, per - 1).astype(np.uint64) for k in range(0, width, per)]
        highs = [low + ((np.uint64(1) << free) - np.uint64(1)) for low, free in zip(lows, spare, strict=True)]
        lo, hi = np.searchsorted(keys[0], lows[0]), np.searchsorted(keys[0], highs[0], "right")
        for r in np.flatnonzero((length > per) & (hi > lo)).tolist():
            a, b = int(lo[r]), int(hi[r])
            for k in range(1, -(-int(length[r]) // per)):
                part = keys[k][a:b]
                a, b = a + int(np.searchsorted(part, lows[k][r])), a + int(np.searchsorted(part, highs[k][r], "right"))
                if a >= b:
                    break
            lo[r], hi[r] = a, b
        count = np.maximum(hi - lo, 0)
        at = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        return suffixes[at].astype(np.int32), np.repeat(length, count), np.repeat(ids, count)

    # relaxation

    def encode_chunks(self, chunks: list[str]) -> None:
        """Encodes chunks (without the space before them) and keeps them."""
        odd = [c for c in chunks if SPACE in c or "\0" in c]
        for c in odd:
            self.chunks[c] = np.array(self.v.to_ids(self.v.merge(SPACE + c)), np.int32).tobytes()
        plain = [c for c in chunks if SPACE not in c and "\0" not in c]
        if not plain:
            return
        text = np.frombuffer(("\0" + "".join(f"{SPACE}{c}\0" for c in plain)).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(c) + 1 for c in plain])
        begin = np.cumsum(sizes + 1) - sizes
        start, length, piece = self.edges(text)
        first_of = np.repeat(begin, sizes + 1).astype(np.int32)
        # a character that is no piece is a symbol of its own, which merges with nothing
        alone = np.ones(len(text), dtype=bool)
        alone[start[length == 1]] = False
        lost = np.flatnonzero(alone & (text != 0)).astype(np.int32)
        start, length, piece = np.concatenate((start, lost)), np.concatenate((length, np.ones(len(lost), np.int32))), np.concatenate((piece, np.full(len(lost), self.v.n, np.int32)))
        to = start + length
        depth = to - first_of[start - 1]
        last = np.full(len(text) + 1, -1, np.int64)
        back = np.zeros(len(text) + 1, np.int64)
        at_start = np.zeros(len(text) + 1, dtype=bool)
        at_start[begin] = True
        rest = np.zeros(0, np.int64)
        order = np.argsort(np.minimum(depth, 65535).astype(np.uint16), kind="stable")
        if sizes.max() > LONG:
            long = np.repeat(sizes > LONG, sizes + 1)[start - 1]
            rest, order = np.flatnonzero(long), order[~long[order]]
        start_, to_, piece_ = start[order], to[order], piece[order]
        steps = np.concatenate(([0], np.cumsum(np.bincount(depth[order], minlength=1)[1:])))
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            self._relax(start_[a:b], to_[a:b], piece_[a:b], last, back, at_start)
        if len(rest):
            self._relax_long(rest[np.lexsort((to[rest],))], start, to, piece, last, back, at_start)
        chosen = np.zeros(len(text) + 1, dtype=bool)
        here = begin + sizes
        while len(here):
            chosen[here] = True
            here = back[here]
            here = here[~at_start[here]]
        places = np.flatnonzero(chosen)
        ids = last[places].astype(np.int32)
        ends = np.searchsorted(places, begin + sizes, "right")
        raw, a = ids.tobytes(), 0
        strange = np.concatenate(([0], np.cumsum(ids == self.v.n)))
        for c, b in zip(plain, ends.tolist(), strict=True):
            if strange[b] > strange[a]:
                out: list[int] = []
                p = int(begin[0]) if a == 0 else int(places[a - 1]) + 1
                for k in range(a, b):
                    q = int(places[k])
                    out += [int(ids[k])] if ids[k] != self.v.n else self.v.to_ids([chr(x) for x in text[p:q].tolist()])
                    p = q
                self.chunks[c] = np.array(out, np.int32).tobytes()
            else:
                self.chunks[c] = raw[4 * a : 4 * b]
            a = b

    def _relax(self, start, to, piece, last, back, at_start) -> None:
        before = last[start]
        fine = at_start[start]
        ask = np.flatnonzero(~fine & (before >= 0))
        if len(ask):
            fine[ask] = self.allowed(before[ask], piece[ask].astype(np.int64))
        to = to[fine]
        last[to], back[to] = piece[fine], start[fine]

    def _relax_long(self, e, start, to, piece, last, back, at_start) -> None:
        """The same, one edge after the other: a long chunk has too many positions to go through with arrays."""
        memo: dict[tuple[int, int], bool] = {}
        for s, t, p in zip(start[e].tolist(), to[e].tolist(), piece[e].tolist(), strict=True):
            if not at_start[s]:
                pair = (int(last[s]), p)
                if pair[0] < 0:
                    continue
                if pair not in memo:
                    memo[pair] = bool(self.allowed(np.array([pair[0]]), np.array([p]))[0])
                if not memo[pair]:
                    continue
            last[t], back[t] = p, s

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of 32-bit integers."""
        cut = []
        for t in texts:
            if not t:
                cut.append([])
            elif "  " in t or t[0] == " " or t[-1] == " " or SPACE in t:
                cut.append([x[1:] for x in _RUNS.findall(SPACE + t.replace(" ", SPACE))])
            else:
                cut.append(t.split(" "))
        new = set().union(*cut).difference(self.chunks)
        size = sum(map(_bytes, new))
        if self.size + size > KEPT_BYTES:  # what is still in use moves on, the rest goes
            self.old, self.chunks = self.chunks, {}
            new = set().union(*cut)
            self.size, size = 0, sum(map(_bytes, new))
        self.size += size
        if self.old:
            known = new & self.old.keys()
            for c in known:
                self.chunks[c] = self.old[c]
            new -= known
        self.encode_chunks(list(new))
        get = self.chunks.__getitem__
        out = [b"".join(map(get, parts)) for parts in cut]
        for c in [c for c in new if len(c) > KEPT_CHARS]:
            del self.chunks[c]
            self.size -= _bytes(c)
        return out


def _bytes(chunk: str) -> int:
    """Memory of a chunk and its ids at most, nearly."""
    return 8 * len(chunk) + EACH


def _groups(texts: pa.Array, limit: int = 1 << 18):
    """Runs of texts of about limit bytes: the suffix array of a run's new chunks takes some 200 bytes a character."""
    at = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def encode_texts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decodes (whether the ids give the text back), one row per row of df.

    model is the path of a SentencePiece BPE model whose text is not normalised (any other
    raises ValueError); the ids are those of its library. Null and empty texts have no ids.
    Characters that are no piece become their bytes. Texts of any length are encoded whole.
    Repeated rows give repeated rows, an empty table gives none. Other columns of df,
    whatever their names, are not read.
    """
    spark = df.sparkSession
    with open(model, "rb") as f:
        pieces = Pieces(f.read())
    shared = spark.sparkContext.broadcast(pieces)

    def run(batches):
        encoder = hold(("pieces", model), lambda: Encoder(shared.value))
        for batch in batches:
            for a, b in _groups(batch.column("text")):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                raw = encoder.encode(texts)
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw]))).astype(np.int32)
                flat = np.frombuffer(b"".join(raw), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                same = [encoder.v.decode(np.frombuffer(x, np.int32).tolist()) == t for x, t in zip(raw, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(ends).astype(np.int64)), ids, pa.array(same)], names=["doc_id", "n_tokens", "ids", "decodes"])
                del texts, raw, ends, flat, ids, same
            del batch
            trim()

    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema(rows.schema["doc_id"], "n_tokens long, ids array<int>, decodes boolean"))


def decode_ids(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of arrays of ids; null is the empty text."""
    with open(model, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(Pieces(f.read()))

    def run(batches):
        pieces = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pieces.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, schema(rows.schema["doc_id"], "text string"))
