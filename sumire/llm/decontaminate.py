"""Benchmark decontamination by a generalised suffix automaton of the test items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Scratch, fresh, table

#: Bytes to bytes: A-Z in lower case, all that parts words a space. 0x80 and above belong to words.
WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Texts of more bytes than this are cut into several automata, each of a bounded broadcast; so many of these are held in one pass over the documents.
BLOCK_BYTES, HELD = 2 << 20, 4


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class Automaton:
    """Longest matches of word sequences inside items.

    A window is window consecutive words of an item, or a whole item of fewer; items without words have none.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        rows = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, row in rows:
            last = 0
            for w in row:
                last = self._add(last, w)
        self.least = min([window, *(len(r) for _, r in rows)])
        self.items: dict[int, set[str]] = {}  # of the state that holds a full window
        self.short: dict[int, set[str]] = {}  # of the state whose longest string is a short item
        for name, row in rows:
            s = 0
            for i, w in enumerate(row):
                s = self.next[s][w]
                if i + 1 >= window:
                    self.items.setdefault(self._at(s), set()).add(name)
            if len(row) < window:
                self.short.setdefault(s, set()).add(name)
        self.shorts: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)  # (words, state) along the links
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.shorts[s] = self.shorts[self.link[s]] + (((self.length[s], s),) if s in self.short else ())

    def _at(self, s: int) -> int:
        while self.length[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def _add(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, q, w)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return cur

    def _split(self, p: int, q: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words (from, to) and the names of the items with occurring windows."""
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        seen: set[int] = set()
        if len(words) < self.least:
            return spans, names
        nxt, link, length, window, shorts = self.next, self.link, self.length, self.window, self.shorts
        s = n = 0
        for i, w in enumerate(map(self.ids.get, words)):
            if w is None:
                s = n = 0
                continue
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            t = nxt[s].get(w)
            if t is None:
                continue
            s, n = t, n + 1
            took = 0
            if n >= window:
                took = window
                if s not in seen:
                    seen.add(s)
                    names |= self.items[self._at(s)]
            if shorts[s]:
                for m, x in shorts[s]:
                    if m <= n:
                        took = max(took, m)
                        names |= self.short[x]
            if took:
                a = i + 1 - took
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, names


def load_items(items: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """Item texts in blocks of BLOCK_BYTES at most (or one text), one after the other; null texts have no words, a null id is the empty string."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    block: list[tuple[str, bytes]] = []
    size = 0
    for r in rows.toLocalIterator():
        if size + len(r.text) > BLOCK_BYTES and block:
            yield block
            block, size = [], 0
        block.append((r.item_id, bytes(r.text)))
        size += len(r.text)
    if block:
        yield block


def _passes(docs: DataFrame, items: DataFrame) -> Iterator[list]:
    """Broadcast blocks of items for each pass over the documents, HELD at most; without items one pass without blocks."""
    held: list = []
    first = True
    for block in load_items(items):
        if len(held) == HELD:
            yield held
            held, first = [], False
        held.append(docs.sparkSession.sparkContext.broadcast(block))
    if held or first:
        yield held


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Scanner:
    """Looks for the windows of some blocks of items, each an automaton that is built once a task."""

    def __init__(self, held: list, window: int):
        self.machines = [Automaton([(name, words_of(x)) for name, x in h.value], window) for h in held]

    def scan(self, texts: list[bytes | None], spans: list[list[tuple[int, int]]] | None = None, names: list[list[str]] | None = None) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """For each text how many words it has, the merged spans of hit words, and the names of items with occurring windows; those of earlier passes among them."""
        n, all_spans, all_names = [], [], []
        for i, x in enumerate(texts):
            words = words_of(x)
            own, of = list(spans[i]) if spans else [], set(names[i]) if names else set()
            for m in self.machines:
                found, more = m.scan(words)
                own += found
                of |= more
            n.append(len(words))
            all_spans.append(merge(own))
            all_names.append(sorted(of))
        return n, all_spans, all_names


PAIR = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
_PAIR = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _before(b: pa.RecordBatch, at: int) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    return [[(p["a"], p["b"]) for p in s] for s in b.column(at).to_pylist()], b.column(at + 1).to_pylist()


def _pass(docs: DataFrame, held: list, window: int, at: int, added: list[str], again: bool) -> DataFrame:
    """One pass: docs with the three columns, or, if they are there already, with what this pass finds besides."""
    schema = docs.schema if again else T.StructType([*docs.schema.fields, *map(T.StructField, added, (T.LongType(), PAIR, T.ArrayType(T.StringType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(held, window)
        for b in batches:
            columns = list(b.columns)[:-3] if again else list(b.columns)
            n, spans, names = scanner.scan(b.column(at).cast(pa.binary()).to_pylist(), *(_before(b, len(columns) + 1) if again else ()))
            made = [pa.array(n, pa.int64()), pa.array([[{"a": p, "b": q} for p, q in s] for s in spans], _PAIR), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *made], schema.names)

    return docs.mapInArrow(run, schema)


def hits(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """docs with __words long, __spans (merged spans of hit words, [from, to)) and __items (names of items with occurring windows, sorted), as the last three columns; they are named otherwise if docs has such columns.

    Items are a test set, whose bytes are read in blocks: each block is one broadcast of bounded size and one automaton, built once a task. More
    than HELD blocks take further passes, between which the documents are written. Null and empty texts have no words, spans or items.
    """
    at, added, scratch = docs.columns.index("text"), fresh(docs, "__words", "__spans", "__items"), Scratch(docs.sparkSession, "hits")
    out = None
    for held in _passes(docs, items):
        out = _pass(docs, held, window, at, added, False) if out is None else _pass(scratch.save(out), held, window, at, added, True)
    return out


def n_hit(spans: str) -> Column:
    return F.expr(f"aggregate(`{spans}`, 0L, (s, x) -> s + x.b - x.a)")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of hits(): a row for each document; a null text has no words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hits(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.col("__words").alias("n_words"), n_hit("__spans").alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the bytes from the first to the last word of each span; all outside the spans stays."""
    raw = text.encode()
    clean = raw.translate(WORDS)
    ends, at = [], 0
    for w in clean.split():
        at = clean.index(w, at)
        ends.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : ends[a][0]])
        last = ends[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, share: float = 0.05) -> DataFrame:
    """Rows of docs: those with hit words in at least share of their words go, in others the hit spans are removed.

    Columns stay; n_chars follows the text if there is such a column. Null and empty texts stay as they are.
    """
    at, names, passes = docs.columns.index("text"), docs.columns, list(_passes(docs, items))
    found, added, scratch = docs, fresh(docs, "__words", "__spans", "__items"), Scratch(docs.sparkSession, "hits")
    for i, held in enumerate(passes[:-1]):
        found = scratch.save(_pass(found, held, window, at, added, i > 0))
    held, many, again = passes[-1], 1 / share, len(passes) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(held, window)
        for b in batches:
            columns = list(b.columns)[: len(names)]
            n, spans, _ = scanner.scan(b.column(at).cast(pa.binary()).to_pylist(), *(_before(b, len(names) + 1) if again else ()))
            hit = [sum(q - p for p, q in s) for s in spans]
            if any(hit):
                columns[at] = pa.array([_cut(x, s) if s else x for x, s in zip(columns[at].to_pylist(), spans, strict=True)], columns[at].type)
            stay = pa.array([not h or h * many < k for h, k in zip(hit, n, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names).filter(stay)

    out = found.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in names else out


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def _sql() -> str:
    words = r"list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return rf"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {words} AS w FROM benchmark),
iw AS (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS key FROM iw),
d AS (SELECT doc_id, {words} AS w FROM documents),
dw AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM k) WHERE len(w) >= m),
h AS (SELECT doc_id, p, m, item_id FROM (SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS key FROM dw) JOIN k USING (m, key)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""


SQL = {"op9_decontaminate": _sql()}
