from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sumire.llm import suffixdedup

LENGTH = 50


def expected(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    first: dict[bytes, int] = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        if i is not None:
            for k in range(len(b) - LENGTH + 1):
                s = b[k : k + LENGTH]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        if i is not None:
            for k in range(len(b) - LENGTH + 1):
                if first[b[k : k + LENGTH]] < i:
                    gone[k : k + LENGTH] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def made() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared = [word(n) for n in (49, 50, 51, 80, 200, 1000)]
    docs: list[tuple[int | None, str | None]] = [(None, None), (-5, None), (-4, ""), (None, shared[4]), (3, shared[4]), (3, shared[4]), (4, shared[4])]
    for i in range(10, 60):
        docs.append((i, word(rng.randrange(30)) + rng.choice(shared) + word(rng.randrange(60)) + rng.choice(shared)[: rng.randrange(1, 120)]))
    for i in range(60, 80):  # repetitive bytes, ties of anchors
        docs.append((i, "a" * rng.randrange(40, 200) + rng.choice(["b", ""]) + "ab" * rng.randrange(60)))
    docs += [(80 + i, "xyz" * 40 + word(i)) for i in range(30)]
    docs += [(200, word(60_000)), (201, "q"), (202, "z" * 30_000)]
    docs.append((203, docs[-3][1][1000:50_000]))
    rng.shuffle(docs)
    return docs


def test_brute_force(spark, tables):
    docs = made()
    assert got(suffixdedup.op6_suffix_array(spark, tables(documents=docs))) == expected(docs)


def test_many_chunks_and_buckets(spark, tables, monkeypatch):
    monkeypatch.setattr(suffixdedup, "CHUNK", 4000)
    monkeypatch.setattr(suffixdedup, "BUCKET", 3000)
    docs = made()
    assert got(suffixdedup.op6_suffix_array(spark, tables(documents=docs))) == expected(docs)


def test_table(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert got(suffixdedup.op6_suffix_array(spark, sf_dir)) == expected(list(zip(docs["doc_id"], docs["text"], strict=True)))


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, "a" * 49), (2, "a" * 49)], [(1, "a" * 50), (2, "a" * 50)]])
def test_small(spark, tables, docs):
    assert got(suffixdedup.op6_suffix_array(spark, tables(documents=docs))) == expected(docs)


def shards_of(collections: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Transforms of collections of strings: symbols before, steps, and what rotation (shard, string, place) each row is."""
    bwt, step, names = [], [], []
    for k, strings in enumerate(collections):
        strings = [[*s, 0] for s in strings]
        length = np.array([len(s) for s in strings])
        text = np.concatenate([np.array(s) for s in strings])
        where = [(k, i, j) for i, s in enumerate(strings) for j in range(len(s))]
        order = suffixdedup.rotations(np.zeros(len(strings), np.int64), text, length)
        turned = lambda w, st=strings: st[w[1]][w[2] :] + st[w[1]][: w[2]]
        assert [turned(where[i]) for i in order] == sorted(turned(w) for w in where)
        rows = [where[i] for i in order]
        before = np.array([strings[i][j - 1] for _, i, j in rows])
        to = np.empty(len(before), np.int64)
        to[before.argsort(kind="stable")] = np.arange(len(before))
        bwt.append(before)
        step.append(to + len(names))
        names += rows
    return np.concatenate(bwt).astype(np.uint16), np.concatenate(step), names


@pytest.mark.parametrize("depth", [1, 2, 5, 40])
def test_interleave_merges_transforms(depth):
    rng = random.Random(6)
    collections = [[[rng.randrange(1, 4) for _ in range(rng.randrange(3, 30))] for _ in range(rng.randrange(1, 9))] for _ in range(5)]
    collections[3].append(collections[0][0])
    bwt, step, names = shards_of(collections)
    order, common = suffixdedup.interleave(bwt, step, depth)
    turned = lambda w: ([*collections[w[0]][w[1]], 0] * 20)[w[2] : w[2] + depth]
    keys = [turned(names[i]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(len(bwt)))
    for a, b, n in zip(keys, keys[1:], common[1:], strict=False):
        assert n == next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), depth)


def test_hash_clashes_remove_nothing(spark, tables):
    """Anchors of these two share a bucket and 32 bits of their hash; the strings differ."""
    docs = [(1, "xhhovtcnrygurpkpcakaouhqajwfjudzuzxhqigfpohdatggct"), (2, "xhhovtcnrygurpkhcmyjmfvhqjoqkpgfolnhqigfpohdatggct")]
    assert got(suffixdedup.op6_suffix_array(spark, tables(documents=docs))) == expected(docs)
    assert [r[2] for r in got(suffixdedup.op6_suffix_array(spark, tables(documents=docs)))] == [0, 0]


def here(docs: list[tuple[int | None, str | None]], chunks: int, buckets: int) -> list[tuple]:
    """All passes in this process, where constants can be changed."""
    pick = lambda t, name, k: t.filter(pa.array([x.as_py() == k for x in t[name]], pa.bool_()))
    join = lambda tables: pa.concat_tables(tables)
    rows = pa.table({"doc_id": [i for i, _ in docs], "text": pa.array([None if t is None else t.encode() for _, t in docs], pa.binary()), "chunk": [n % chunks for n in range(len(docs))]})
    each = [pick(rows, "chunk", k) for k in range(chunks)]
    seen = join([suffixdedup._seen(buckets)(c) for c in each])
    shared = join([suffixdedup._shared_keys(pick(seen, "bucket", k)) for k in sorted(set(seen["bucket"].to_pylist()))])
    shards = join([suffixdedup._contexts(buckets)(c, pick(shared, "chunk", k)) for k, c in enumerate(each)])
    runs = join([suffixdedup._earlier(pick(shards, "bucket", k)) for k in sorted(set(shards["bucket"].to_pylist()))])
    return sorted((tuple(r.values()) for r in join([suffixdedup._digest(buckets)(c, pick(runs, "chunk", k)) for k, c in enumerate(each)]).to_pylist()), key=repr)


@pytest.mark.parametrize("hot", [1 << 16, 20, 0])
@pytest.mark.parametrize("chunks, buckets", [(1, 1), (7, 5)])
def test_second_anchors(monkeypatch, hot, chunks, buckets):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    docs = made()
    assert here(docs, chunks, buckets) == expected(docs)


def test_weak_hashes_change_nothing(monkeypatch):
    """Keys of so few bits that most anchors clash."""
    real = suffixdedup.Chunk.__init__

    def few(self, *args):
        real(self, *args)
        self.key = self.key & ~np.uint64(0xFFFFFFFC)

    monkeypatch.setattr(suffixdedup.Chunk, "__init__", few)
    for hot in (1 << 16, 3):
        monkeypatch.setattr(suffixdedup, "HOT", hot)
        docs = made()
        assert here(docs, 3, 2) == expected(docs)
