from __future__ import annotations

import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from sumire.llm import simhash, wide
from sumire.llm.simhash import fingerprint


def plain(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a: frozenset, b: frozenset) -> bool:
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("block, route", [(4096, 50_000), (7, 30)])
def test_brute_force(spark, tables, union, sf_dir, monkeypatch, block, route):
    monkeypatch.setattr(wide, "BLOCK", block)
    monkeypatch.setattr(wide, "ROUTE", route)
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    docs = list(zip(t["doc_id"], t["text"], strict=True))
    rng, top = random.Random(3), max(t["doc_id"]) + 1
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    made = [None, "", " \t", "One two", "one  TWO", "one", " ".join(base)]
    for n in (1, 1, 1, 1, 2, 2, 2, 3, 3, 4, 5, 6) * 3:
        w = base.copy()
        for k in rng.sample(range(90), n):
            w[k] = f"x{rng.randrange(10**6)}"
        made.append(" ".join(w))
    docs += list(enumerate(made, top))
    sets = [plain(x) for _, x in docs]
    for n, (i, _) in enumerate(docs):
        union.find(i)
        for k in range(n):
            if alike(sets[n], sets[k]):
                union.link(i, docs[k][0])
    got = wide.similar(spark.read.parquet(tables(documents=docs) + "/documents.parquet")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: union.find(i) for i, _ in docs} and len(got) == len(docs)


def test_stage_drops_near_copies_of_more_than_three_bits(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    copy = [*words[:58], "other", "end"]
    a, b = " ".join(words), " ".join(copy)
    assert alike(plain(a), plain(b)) and (fingerprint(a.encode()) ^ fingerprint(b.encode())).bit_count() > 3
    docs = spark.createDataFrame([(4, a), (9, b), (5, " ".join(words[:40]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()) == [4, 5]


def test_one_row_of_each_group_stays(spark):
    """Repeated and null ids, repeated rows, and columns named like those added on the way."""
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text, "x"), (3, text, "x"), (3, text + " more", "y"), (None, text, "z"), (None, "alone", "n"), (None, "alone", "n"), (1, "one", None), (2, "ONE ", None), (8, None, "e"), (9, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __name string")
    got = simhash.stage_simhash(spark, docs, "")
    assert got.columns == ["doc_id", "text", "__name"]
    ids = sorted((tuple(r) for r in got.collect()), key=repr)
    assert len(ids) == 4 and [r[0] for r in ids].count(3) == 1 and (None, "alone", "n") in ids and (1, "one", None) in ids and (8, None, "e") in ids
    assert simhash.stage_simhash(spark, docs.limit(0), "").collect() == []


def test_spanning_joins_what_is_alike():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 60, 100).astype(np.uint64))
    sets = [np.sort(np.concatenate([base[: 100 - k], np.arange(i * 1000, i * 1000 + k).astype(np.uint64)])) for i, k in enumerate(rng.integers(0, 40, 300))]
    own = [frozenset(s.tolist()) for s in sets]
    up = list(range(300))

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i in range(300):
        for j in range(i):
            if alike(own[i], own[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    links = wide.spanning(list(range(300)), sets)
    assert all(alike(own[a], own[b]) for a, b in links) and len(links) == 300 - len({find(i) for i in range(300)})
    got = list(range(300))
    for a, b in links:
        x, y = got[a], got[b]
        got = [min(x, y) if g in (x, y) else g for g in got]
    assert [find(i) for i in range(300)] == [min(j for j in range(300) if got[j] == got[i]) for i in range(300)]


@pytest.mark.parametrize("alike_", [0.8, 0.85, 0.9])
def test_most_pairs_become_candidates(alike_):
    """Of 300 pairs of a given similarity, how many meet in a segment."""
    rng, met = np.random.default_rng(8), 0
    for _ in range(300):
        both = int(round(200 * 2 * alike_ / (1 + alike_)))
        a = rng.integers(0, 1 << 63, 400 - both).astype(np.uint64)
        prints = [wide.fingerprint(x) for x in (a[:200], np.concatenate([a[:both], a[200:]]))]
        bits = np.unpackbits(prints[0].view(np.uint8) ^ prints[1].view(np.uint8), bitorder="little")
        met += bits.reshape(-1, wide.BITS).sum(1).min() <= 1 and bits[-128:].sum() <= wide.FAR
    assert met >= 300 * 0.97


def test_stars_join_what_links_join():
    rng = random.Random(9)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(200)]
    up = {x: x for e in links for x in e}
    for _ in range(500):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = wide.stars(np.array(links, np.int64))
    assert sorted(map(tuple, got.tolist())) == sorted((m, x) for x, m in up.items() if m != x)
    assert len(wide.stars(np.zeros((0, 2), np.int64))) == 0


def joined(n: int, links) -> list[int]:
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_spanning_of_sets_of_many_sizes():
    """Empty, equal, short and long sets, and sets at just 0.8 and just below."""
    rng = np.random.default_rng(12)
    sets = [np.empty(0, np.int64), np.empty(0, np.int64), np.array([5]), np.array([5]), np.array([6]), np.arange(4), np.arange(5), np.arange(6), np.arange(1000, 1009), np.arange(1001, 1010), np.arange(1000, 1010)]
    for size in (3, 10, 40, 300, 4000):
        base = rng.integers(-(1 << 62), 1 << 62, size)
        for share in (1, 0.95, 0.9, 0.85, 0.8, 0.75, 0.5):
            own = rng.choice(base, max(1, round(share * size)), replace=False)
            sets += [own, np.concatenate([own, rng.integers(-(1 << 62), 1 << 62, max(1, size // 9))])]
    sets = [np.unique(sets[i]).astype(np.int64) for i in rng.permutation(len(sets))]
    own = [frozenset(s.tolist()) for s in sets]
    want = joined(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if own[i] and alike(own[i], own[j])])
    links = wide.spanning(list(range(len(sets))), sets)
    assert joined(len(sets), links) == want and len(links) == len(sets) - len(set(want)) and all(alike(own[a], own[b]) for a, b in links)
    assert wide.spanning([], []) == [] and wide.spanning(["a"], [np.arange(3)]) == []


def test_spanning_of_a_large_group_with_few_links():
    """Copies of one text with so many changes that few are alike: what is left must not be indexed anew for each."""
    rng = np.random.default_rng(6)
    base, sets = rng.integers(0, 1 << 62, 400), []
    for i in range(3000):
        keep = rng.random(400) >= (0.02 if i % 50 == 0 else rng.uniform(0.2, 0.5))
        sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 62, int((~keep).sum()))])))
    began = time.process_time()
    links = wide.spanning(list(range(3000)), sets)
    assert time.process_time() - began < 8
    own = [frozenset(s.tolist()) for s in sets]
    assert all(alike(own[a], own[b]) for a, b in links)
    light = joined(3000, links)[::50]
    assert len(set(light)) == 1


def test_groups_are_not_collected_into_rows(spark):
    """A group of many long sets goes to Python row by row; as one row of arrays it would fill an executor's heap."""
    rows = [(bytes([i]), 7, list(range(i % 2 * 100, i % 2 * 100 + 20))) for i in range(6)]
    found = wide.compared(spark.createDataFrame(rows, "name binary, component long, shingles array<long>"), wide.Scratch(spark, "test"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "collect_list" not in plan
    assert joined(6, [(bytes(r.a)[0], bytes(r.b)[0]) for r in found.collect()]) == [0, 1, 0, 1, 0, 1]
