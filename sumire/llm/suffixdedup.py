"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

Sorting all suffixes of a corpus in one place is out of the question, so they are dealt to merges that can run
alone: of every LENGTH-byte string its least K-byte run by hash (the leftmost of equals) is its anchor, and equal strings have
equal anchors. Anchors seen in one document only are dropped. A chunk of documents is a shard: it sorts the rotations of the contexts of
its other anchors (the bytes of the strings that they anchor) once, and sends each bucket of anchors its part of the transform.
A bucket merges the shards' transforms by refining their interleave round by round; where a round splits two neighbours is their common
prefix, and runs with common prefixes of a whole string are the repeated intervals. Hashes only deal; anchors and strings are
told apart by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import parts, table
from .anchors import grams, sliding

LENGTH, K = 50, 20
#: Bytes of text in a chunk of documents, and for each bucket of anchors.
CHUNK, BUCKET = 4 << 20, 2 << 20
#: The strings of an anchor that occurs more often are dealt to buckets by a second anchor of SECOND bytes beside the first.
HOT, SECOND = 1 << 16, 8
#: Anchors whose strings are merged at a time: so few that symbols mostly have 8 bits and rows stay in a core's cache.
TOGETHER = 128
WIDE = 2 * LENGTH - K  # bytes of a context at most
DEPTH = LENGTH - K + 1  # symbols of a string: its anchor is one


class Chunk:
    """Documents' bytes end to end, with the anchors of their strings: anchor p has the windows that start in [low, high]."""

    def __init__(self, texts: list[bytes], docs: np.ndarray, known: np.ndarray, buckets: int):
        size = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.docs, n = docs, len(self.data)
        self.p = self.low = self.high = self.doc = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        some = (size >= LENGTH) & known
        if not some.any():
            return
        h = grams(self.data, K)
        bits = int(n).bit_length()
        mask = np.uint64((1 << bits) - 1)
        least = sliding((h & ~mask) | np.arange(len(h), dtype=np.uint64), LENGTH - K + 1, np.minimum)
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, self.starts[some], 1)
        np.add.at(step, self.ends[some] - LENGTH + 1, -1)
        j = np.flatnonzero(np.cumsum(step)[: len(least)])
        a = (least[j] & mask).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        self.p, self.low = a[first], j[first]
        self.high = j[np.concatenate([first[1:] - 1, [len(j) - 1]])]
        own = h[self.p]
        self.key = ((own >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (own & np.uint64(0xFFFFFFFF))
        self.doc = docs[np.searchsorted(self.ends, self.p, side="right")]

    def classes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts of the anchors at, ordered by key and bytes: their rows, the order of each within its key, and each anchor's class."""
        rows = np.zeros((len(at), 10 + WIDE), np.uint8)
        size = self.high[at] + LENGTH - self.low[at]
        rows[:, :8] = self.key[at].astype(">u8").view(np.uint8).reshape(-1, 8)
        rows[:, 8], rows[:, 9] = self.p[at] - self.low[at], size
        span = np.arange(WIDE)
        for i in range(0, len(at), 1 << 14):
            s = slice(i, i + (1 << 14))
            where = self.low[at[s], None] + span
            rows[s, 10:] = np.where(span < size[s, None], self.data[np.minimum(where, len(self.data) - 1)], 0)
        distinct, own = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_inverse=True)
        out = distinct.view(np.uint8).reshape(-1, rows.shape[1])
        key = np.ascontiguousarray(out[:, :8]).view(">u8").ravel().astype(np.uint64)
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        start = np.flatnonzero(first)
        nth = np.arange(len(key)) - start[np.cumsum(first) - 1] if len(key) else np.zeros(0, np.int64)
        return out, nth, own


def _chunk(rows: pa.Table, buckets: int) -> Chunk:
    texts = [x or b"" for x in rows["text"].to_pylist()]
    ids = rows["doc_id"].to_pylist()
    return Chunk(texts, np.array([0 if x is None else x for x in ids], np.int64), np.array([x is not None for x in ids], bool), buckets)


def _u(blobs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _cuts(sorted_keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of keys in order."""
    if not len(sorted_keys):
        return []
    b = (sorted_keys >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    return [(int(b[i]), int(i), int(j)) for i, j in zip(at, [*at[1:], len(b)], strict=True)]


def _seen(buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        """A chunk's keys, by bucket: those in one of its documents, and those in several with how often they occur (65,535 at most)."""
        c = _chunk(rows, buckets)
        order = np.lexsort((c.doc, c.key))
        key, doc = c.key[order], c.doc[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        last = np.concatenate([first[1:] - 1, [len(key) - 1]]) if len(key) else first
        many, often = doc[first] != doc[last], np.minimum(last - first + 1, 0xFFFF).astype("<u2")
        key = key[first]
        out = [(b, key[i:j].astype("<u4")[~many[i:j]].tobytes(), key[i:j].astype("<u4")[many[i:j]].tobytes(), often[i:j][many[i:j]].tobytes()) for b, i, j in _cuts(key)]
        chunk = rows["chunk"][0].as_py()
        return pa.table({"bucket": pa.array([r[0] for r in out], pa.int64()), "chunk": pa.array([chunk] * len(out), pa.int64())} | {n: pa.array([r[i] for r in out], pa.binary()) for i, n in enumerate(("once", "many", "often"), 1)})

    return run


def _shared_keys(rows: pa.Table) -> pa.Table:
    """For each chunk the keys of this bucket that are in several documents, those of more than HOT occurrences apart."""
    once, many, often = (rows[n].to_pylist() for n in ("once", "many", "often"))
    flat = _u([*once, *many], "<u4")
    u, at = np.unique(flat, return_inverse=True)
    single = sum(map(len, once)) // 4
    times = np.bincount(at, np.concatenate([np.ones(single), _u(often, "<u2")]), len(u))
    shared = np.bincount(at, minlength=len(u)) > 1
    shared[at[single:]] = True
    hot = shared & (times > HOT)
    out = []
    for chunk, a, b in zip(rows["chunk"].to_pylist(), once, many, strict=True):
        own = _u([a, b], "<u4")
        place = np.searchsorted(u, own)
        keys, most = own[(shared & ~hot)[place]], own[hot[place]]
        if len(keys) or len(most):
            out.append((chunk, keys.tobytes(), most.tobytes() if len(most) else None))
    bucket = rows["bucket"][0].as_py()
    return pa.table({"chunk": pa.array([r[0] for r in out], pa.int64()), "bucket": pa.array([bucket] * len(out), pa.int64()), "keys": pa.array([r[1] for r in out], pa.binary()), "hot": pa.array([r[2] for r in out], pa.binary())})


def _keys(buckets: list[int], blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *((np.uint64(b) << np.uint64(32)) | np.frombuffer(x, "<u4").astype(np.uint64) for b, x in zip(buckets, blobs, strict=True))])


def _split(rows: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window, bucket) of the parts of contexts: a whole one goes by its anchor, one of a hot anchor is cut where its windows' second anchors differ."""
    key = np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64)
    windows = rows[:, 9].astype(np.int64) - LENGTH
    plain, many = np.flatnonzero(~hot), np.flatnonzero(hot)
    out = [(plain, np.zeros(len(plain), np.int64), windows[plain], (key[plain] >> np.uint64(32)).astype(np.int64))]
    q, wide = np.arange(WIDE - SECOND + 1), np.uint64(2**64 - 1)
    for i in range(0, len(many), 1 << 12):
        some = many[i : i + (1 << 12)]
        at, last = rows[some, 8].astype(np.int64)[:, None], windows[some]
        body = np.ascontiguousarray(rows[some, 10:])
        h = grams(body.ravel(), SECOND) * np.uint64(0x9FB21C651E98DF25)
        h = np.concatenate([h, np.zeros(SECOND - 1, np.uint64)]).reshape(len(some), WIDE)[:, : len(q)]
        second = np.full((len(some), DEPTH), wide)
        for j in range(DEPTH):  # what lies beside the anchor in window j
            second[:, j] = np.where((q >= j) & (q <= at - SECOND) | (q >= at + K) & (q <= j + LENGTH - SECOND), h, wide).min(1)
        inside = np.arange(DEPTH) <= last[:, None]
        new = inside & np.concatenate([np.ones((len(some), 1), bool), second[:, 1:] != second[:, :-1]], axis=1)
        who, first = np.nonzero(new)
        end = np.concatenate([np.where(who[1:] == who[:-1], first[1:] - 1, last[who[:-1]]), last[who[-1:]]]) if len(who) else who
        to = (second[who, first] ^ key[some][who] * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(buckets)
        out.append((some[who], first, end, to.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sorted(high: np.ndarray, low: np.ndarray, most: int, name: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray]:
    """Names in order of (high, low, name), and which of them begin a new (high, low); low is below most, a name below names."""
    a, b = max(1, int(most - 1).bit_length()), max(1, int(names - 1).bit_length())
    if len(high) and int(high.max()).bit_length() + a + b <= 63:  # one sort of packed numbers
        packed = np.sort(((high << a | low) << b) | name)
        name, key = packed & ((1 << b) - 1), packed >> b
        return name, np.concatenate([[True], key[1:] != key[:-1]])
    order = np.lexsort((name, low, high))
    high, low = high[order], low[order]
    return name[order], np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])[: len(high)]


def rotations(piece: np.ndarray, text: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Order of the rotations of strings that lie end to end in text, by piece (of each string) and symbols; equal ones in order of place.

    Ranks by so many symbols give those by twice as many; only rotations that are still tied go on.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    kind = np.int32 if n < 1 << 31 else np.int64
    end = np.repeat(np.cumsum(length).astype(kind), length)
    size = np.repeat(length.astype(kind), length)
    rank, todo, by, most = np.zeros(n, kind), np.arange(n), 2, int(length.max())
    after = np.concatenate([text[1:], text[:1]])
    after[np.cumsum(length) - 1] = text[np.cumsum(length) - length]
    symbols = int(text.max()) + 1
    todo, new = _sorted(np.repeat(piece, length) * symbols + text, after, symbols, todo, n)
    while True:
        # ranks are first places: those of a group of ties that was parted are counted from its own
        start = np.flatnonzero(new)
        count = np.diff(np.concatenate([start, [len(todo)]]))
        old = rank[todo[start]]
        first = np.concatenate([[True], old[1:] != old[:-1]])
        home = start[first][np.cumsum(first) - 1]
        rank[todo] = np.repeat(old + start - home, count)
        todo = np.sort(todo[np.repeat(count > 1, count)])  # in order of place: what is read next lies together
        if not len(todo):
            order = np.empty(n, np.int64)
            order[rank] = np.arange(n)
            return order
        if by >= most:
            return rank.argsort(kind="stable")
        ahead, stop, wrap = todo + by, end[todo], size[todo]
        while (over := ahead >= stop).any():
            ahead[over] -= wrap[over]
        todo, new = _sorted(rank[todo].astype(np.int64), rank[ahead].astype(np.int64), n, todo, n)
        by *= 2


SHARDS = "bucket long, chunk long, low binary, high binary, nth binary, first binary, least binary, spread binary, anchors binary, numbers binary, bwt binary, marks binary"


def _contexts(buckets: int):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        """A chunk's transforms of its distinct contexts of shared anchors, one for each bucket, with the least and the most doc_id of each context."""
        out: list[tuple] = []
        if docs.num_rows and shared.num_rows:
            c = _chunk(docs, buckets)
            names = shared["bucket"].to_pylist()
            often = _keys(names, [x or b"" for x in shared["hot"].to_pylist()])
            at = np.flatnonzero(np.isin(c.key, np.concatenate([_keys(names, shared["keys"].to_pylist()), often])))
            rows, nth, own = c.classes(at)
            least, most = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), np.iinfo(np.int64).min)
            np.minimum.at(least, own, c.doc[at])
            np.maximum.at(most, own, c.doc[at])
            key = np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64)
            row, first, last, bucket = _split(rows, np.isin(key, often), buckets)
            order = bucket.argsort(kind="stable")
            row, first, last, bucket = (x[order] for x in (row, first, last, bucket))
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            chunk = docs["chunk"][0].as_py()
            # so few buckets at a time that what is sorted stays in a core's cache
            i = 0
            while i < len(cut):
                j = max(i + 1, int(np.searchsorted(cut, cut[i] + (1 << 12), side="right")) - 1)
                s = slice(cut[i], cut[j] if j < len(cut) else len(bucket))
                out += _transforms(chunk, bucket[s], rows[row[s]], first[s], last[s], key[row[s]], nth[row[s]], least[row[s]], most[row[s]])
                i = j
        return pa.table({x.split()[0]: pa.array([r[i] for r in out], pa.int64() if i < 2 else pa.binary()) for i, x in enumerate(SHARDS.split(", "))})

    return run


def _transforms(chunk: int, bucket: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray, key: np.ndarray, nth: np.ndarray, least: np.ndarray, most: np.ndarray) -> list[tuple]:
    """For each bucket, in order, the transform of its strings: symbols are 0 (end mark), bytes and one, and above these the anchors by their bytes."""
    at = rows[:, 8].astype(np.int64)  # of the anchor in the whole context
    anchor = np.ascontiguousarray(rows[np.arange(len(rows))[:, None], 10 + at[:, None] + np.arange(K)])
    known, number = np.unique(anchor.view(f"V{K}").ravel(), return_inverse=True)
    length = last - first + LENGTH - K + 2
    begin = np.cumsum(length) - length
    who = np.repeat(np.arange(len(rows)), length)
    inside = np.arange(int(length.sum())) - np.repeat(begin, length)
    place = (at - first)[who]
    wide = rows.shape[1]
    text = rows.ravel()[np.minimum((np.arange(len(rows)) * wide + 10 + first - begin)[who] + np.arange(len(who)) + np.where(inside > place, K - 1, 0), rows.size - 1)].astype(np.int64) + 1
    text[begin + at - first] = 257 + number
    text[begin + length - 1] = 0
    new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    order = rotations(np.cumsum(new) - 1, text, length)
    before = text[np.where(inside[order] > 0, order - 1, begin[who[order]] + length[who[order]] - 1)]
    marks = (before == 0) | (before > 256)
    ends = who[order][text[order] == 0]  # strings in order of their end marks' rotations
    out, low_symbol = [], np.where(before == 0, 0, np.where(before > 256, 1, before - 1)).astype(np.uint8)
    start = np.flatnonzero(new)
    stop = np.concatenate([start[1:], [len(rows)]])
    piece_text = np.concatenate([[0], np.cumsum(length)])
    for i, j in zip(start.tolist(), stop.tolist(), strict=True):
        s, t = ends[i:j], slice(int(piece_text[i]), int(piece_text[j]))
        local, numbers = np.unique(before[t][before[t] > 256] - 257, return_inverse=True)
        k, spread = key[s], most[s] - least[s]
        out.append((int(bucket[i]), chunk, k.astype("<u4").tobytes(), (k >> np.uint64(32)).astype("<u4").tobytes(), nth[s].astype("<u4").tobytes(), first[s].astype("u1").tobytes(), least[s].astype("<i8").tobytes(), spread.astype("<i8").tobytes(), known[local].tobytes(), numbers.astype("<u4").tobytes(), low_symbol[t].tobytes(), np.packbits(marks[t]).tobytes()))
    return out


def interleave(bwt: np.ndarray, step: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges the transforms of shards that lie one behind the other: the merged order of their rows, and each row's common prefix with the one before, depth at most.

    bwt has the symbol before each row's rotation, step the row (of the same shard) of the rotation that begins with it. The interleave begins as the
    shards lie. A round reads the symbols in its order, deals the rows that they lead to stably by symbol, and is then right for one
    symbol more. A block of rows alike so far keeps its place for good, so the round that first parts two neighbours gives
    their common prefix. A round that parts none is the last.
    """
    n = len(bwt)
    order, block, common, step = np.arange(n, dtype=np.int32), np.zeros(n, np.int32), np.full(n, depth, np.uint8), step.astype(np.int32)
    common[:1] = 0
    for done in range(depth):
        symbol = bwt[order]
        dealt = symbol.argsort(kind="stable")
        symbol, rest = symbol[dealt], block[dealt]
        order = step[order[dealt]]
        part = (symbol[1:] != symbol[:-1]) | (rest[1:] != rest[:-1])
        new = part & (common[1:] == depth)
        if done and not new.any():
            break
        common[1:][new] = done
        np.cumsum(part, out=block[1:])
    return order, common


class Shards:
    """A bucket's transforms, read back: rows of all shards one behind the other, and the strings' rows and symbols from their end marks backwards."""

    def __init__(self, rows: pa.Table):
        get = lambda n, kind: _u(rows[n].to_pylist(), kind)
        strings = np.array([len(x) // 4 for x in rows["nth"].to_pylist()], np.int64)
        symbols = np.array([len(x) for x in rows["bwt"].to_pylist()], np.int64)
        known = np.array([len(x) // K for x in rows["anchors"].to_pylist()], np.int64)
        marks = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n in zip(rows["marks"].to_pylist(), symbols, strict=True)]).astype(bool)
        low = get("bwt", "u1")
        bwt = low.astype(np.int64) + 1
        bwt[marks] = 0
        _, number = np.unique(get("anchors", f"V{K}"), return_inverse=True)
        anchors = np.flatnonzero(marks & (low == 1))
        bwt[anchors] = 257 + number[get("numbers", "<u4") + np.repeat(np.cumsum(known) - known, strings)]
        n = len(bwt)
        dealt, _ = _sorted(np.repeat(np.arange(len(symbols)), symbols), bwt, int(bwt.max()) + 1, np.arange(n), n)
        self.step = np.empty(n, np.int64)
        self.step[dealt] = np.arange(n)
        self.bwt, self.of = bwt, np.repeat(np.arange(len(strings)), strings)
        at = np.arange(int(strings.sum())) + np.repeat(np.cumsum(symbols) - symbols - (np.cumsum(strings) - strings), strings)
        most = DEPTH + LENGTH - K + 1  # symbols of a string at most
        rows_, symbols_ = np.full((most, len(at)), -1, np.int32), np.zeros((most, len(at)), np.uint32)
        self.length, left = np.zeros(len(at), np.int64), np.arange(len(at))
        for t in range(most):
            rows_[t, left] = at
            symbols_[t, left] = found = bwt[at]
            self.length[left[found == 0]] = t + 1
            left, at = left[found > 0], self.step[at[found > 0]]
        self.rows, self.symbols, self.anchor = np.ascontiguousarray(rows_.T), np.ascontiguousarray(symbols_.T), symbols_.max(0)

    def earliest(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each string's windows, one string after the other, the least doc_id of any string that has them; and the windows' offsets."""
        windows = self.length - DEPTH
        distinct, own = np.unique(self.symbols.view(f"V{self.symbols.shape[1] * 4}").ravel(), return_inverse=True)
        first = np.full(len(distinct), len(own))
        np.minimum.at(first, own, np.arange(len(own)))
        low = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(low, own, least)
        offset = np.concatenate([[0], np.cumsum(windows)])
        cls = np.repeat(np.arange(len(windows)), windows)
        j = np.arange(len(cls)) - offset[cls]
        row = self.rows[first[own[cls]], (self.length[cls] - 1 - j)]  # of the string that stands for its equals
        found = np.full(len(self.bwt), np.iinfo(np.int64).max)
        held = self.rows[first]
        found[held[held >= 0]] = np.repeat(low, (held >= 0).sum(1))
        # strings with an anchor of their own are done; the others' transforms are merged, TOGETHER anchors at a time
        anchor = self.anchor[first]
        mixed = np.flatnonzero(np.bincount(anchor)[anchor] > 1)
        mixed = mixed[anchor[mixed].argsort(kind="stable")]
        number = np.cumsum(np.concatenate([[True], anchor[mixed[1:]] != anchor[mixed[:-1]]])) if len(mixed) else mixed
        to = np.empty(len(self.bwt), np.int32)
        cut = np.searchsorted(number, np.arange(1, int(number[-1]) + TOGETHER + 1, TOGETHER)) if len(number) else number
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            held = self.rows[first[mixed[i:j]]]
            keep = np.sort(held[held >= 0])  # these strings' rows alone are still a transform, shard by shard
            if not len(keep):
                continue
            to[keep] = np.arange(len(keep))
            names, dense = np.unique(self.bwt[keep], return_inverse=True)
            order, common = interleave(dense.astype(np.uint8 if len(names) <= 256 else np.uint16), to[self.step[keep]], DEPTH)
            doc = found[keep][order]
            begin = np.flatnonzero(common < DEPTH)
            found[keep[order]] = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.concatenate([begin, [len(doc)]])))
        return found[row], offset


def _earlier(rows: pa.Table) -> pa.Table:
    """For each chunk the runs of windows of its contexts that some document below the chunk's highest has: key, class, first, last and doc_id."""
    get = lambda n, kind: _u(rows[n].to_pylist(), kind)
    s = Shards(rows)
    high, low, nth, shift, least = get("high", "<u4"), get("low", "<u4"), get("nth", "<u4"), get("first", "u1").astype(np.int64), get("least", "<i8")
    most = least + get("spread", "<i8")
    found, offset = s.earliest(least)
    cls = np.repeat(np.arange(len(least)), np.diff(offset))
    j = np.arange(len(cls)) - offset[cls] + shift[cls]
    keep = found < most[cls]
    cls, j, doc = cls[keep], j[keep], found[keep]
    new = np.concatenate([[True], (cls[1:] != cls[:-1]) | (doc[1:] != doc[:-1]) | (j[1:] != j[:-1] + 1)]) if len(cls) else np.zeros(0, bool)
    i0 = np.flatnonzero(new)
    i1 = np.concatenate([i0[1:] - 1, [len(cls) - 1]]).astype(np.int64) if len(i0) else i0
    cut = np.searchsorted(s.of[cls[i0]] if len(i0) else i0, np.arange(rows.num_rows + 1))
    out = []
    for n, chunk in enumerate(rows["chunk"].to_pylist()):
        r = slice(cut[n], cut[n + 1])
        if cut[n] < cut[n + 1]:
            c = cls[i0[r]]
            out.append((chunk, high[c].tobytes(), low[c].tobytes(), nth[c].tobytes(), j[i0[r]].astype("u1").tobytes(), j[i1[r]].astype("u1").tobytes(), doc[i0[r]].tobytes()))
    return pa.table({n: pa.array([r[i] for r in out], pa.int64() if not i else pa.binary()) for i, n in enumerate(RUNS)})


RUNS = ["chunk", "high", "low", "nth", "first", "last", "doc"]


def _covered(c: Chunk, runs: pa.Table) -> np.ndarray:
    """Which bytes of the chunk earlier documents have."""
    step = np.zeros(len(c.data) + 1, np.int32)
    if runs.num_rows and len(c.key):
        high, low, nth, first, last, doc = (_u(runs[n].to_pylist(), k).astype(np.int64) for n, k in zip(RUNS[1:], ("<u4", "<u4", "<u4", "u1", "u1", "<i8"), strict=True))
        key = ((high << 32) | low).astype(np.uint64)
        at = np.flatnonzero(np.isin(c.key, key))
        rows, n_in_key, own = c.classes(at)
        whole = np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64)
        cls = np.searchsorted(whole, key) + nth  # the first class of the key, and so many on
        order = np.argsort(cls, kind="stable")
        cls, first, last, doc = cls[order], first[order], last[order], doc[order]
        lo, hi = np.searchsorted(cls, own), np.searchsorted(cls, own, side="right")
        n = hi - lo
        who = np.repeat(np.arange(len(at)), n)
        r = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        ok = doc[r] < c.doc[at][who]
        who, r = who[ok], r[ok]
        np.add.at(step, c.low[at[who]] + first[r], 1)
        np.add.at(step, c.low[at[who]] + last[r] + LENGTH, -1)
    return np.cumsum(step)[:-1] > 0


def _digest(buckets: int):
    def run(docs: pa.Table, runs: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if docs.num_rows:
            c = _chunk(docs, buckets)
            gone = _covered(c, runs)
            for i, (a, b) in enumerate(zip(c.starts.tolist(), c.ends.tolist(), strict=True)):
                g = gone[a:b]
                n = int(g.sum())
                spans = int(g[0]) + int((g[1:] > g[:-1]).sum()) if n else 0
                out.append((docs["doc_id"][i].as_py(), b - a, n, spans, hashlib.sha256((c.data[a:b][~g] if n else c.data[a:b]).tobytes()).hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.table({n: pa.array([r[i] for r in out], kinds[i]) for i, n in enumerate(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))})

    return run


def _planned(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Documents dealt into chunks by doc_id and text, the runs of their repeated windows by chunk, and how many buckets there are."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = d.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks, buckets = size // CHUNK + 1, size // BUCKET + 1
    d = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    d = d.repartition(max(parts(docs.sparkSession), min(chunks, 100_000)), "chunk")  # one exchange, which all three passes read
    by, places = d.groupBy("chunk"), max(parts(docs.sparkSession), min(buckets, 100_000))
    seen = by.applyInArrow(_seen(buckets), "bucket long, chunk long, once binary, many binary, often binary")
    shared = seen.repartition(places, "bucket").groupBy("bucket").applyInArrow(_shared_keys, "chunk long, bucket long, keys binary, hot binary")
    shards = by.cogroup(shared.groupBy("chunk")).applyInArrow(_contexts(buckets), SHARDS)
    return d, shards.repartition(places, "bucket").groupBy("bucket").applyInArrow(_earlier, ", ".join(f"{n} {'binary' if i else 'long'}" for i, n in enumerate(RUNS))), buckets


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row.

    Every byte goes that a LENGTH-byte string covers which also starts in a document of smaller doc_id. Rows of one doc_id don't
    take from each other; rows without doc_id neither lose nor take anything. A null text is empty.
    """
    d, runs, buckets = _planned(docs)
    return d.groupBy("chunk").cogroup(runs.groupBy("chunk")).applyInArrow(_digest(buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
