from __future__ import annotations

import random
import re

import pyarrow.parquet as pq
import pytest
import xxhash

from sumire.llm import simhash


def plain_fingerprint(text: str | None) -> int:
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(docs, union) -> list[tuple]:
    fps = [(i, plain_fingerprint(t)) for i, t in docs]
    for n, (i, a) in enumerate(fps):
        union.find(i)
        for j, b in fps[:n]:
            if (a ^ b).bit_count() <= 3:
                union.link(i, j)
    return sorted((i, f"{fp:016x}", union.find(i)) for i, fp in fps)


ODD = [None, "", " \t\n", "One", "one", "ONE two", "one  TWO", "Ünïcode ÄB c", "x" * 100_000, "a b c " * 30_000, "a b c " * 30_001, "a b c", "a\x1cb c d"]


def test_brute_force(spark, tables, union, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    docs = list(zip(docs["doc_id"], docs["text"], strict=True))
    rng, top = random.Random(1), max(i for i, _ in docs) + 1
    for t in ODD + [docs[0][1]] * 3:
        docs.append((top, t))
        top += 1
    long = max((t for _, t in docs[:100]), key=lambda t: len(t or "")).split()
    for _ in range(40):  # near copies
        w = long.copy()
        w[rng.randrange(len(w))] = rng.choice(("x", "yy", "zzz"))
        docs.append((top, " ".join(w)))
        top += 1
    rng.shuffle(docs)
    got = simhash.op2_simhash(spark, tables(documents=docs)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected(docs, union)


@pytest.mark.parametrize("group", [4096, 3])
def test_links_near_and_not_beyond(spark, monkeypatch, union, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    from sumire.llm._shared import Scratch, components

    rng, fps = random.Random(2), set()
    for _ in range(40):
        base = rng.getrandbits(64)
        fps.add(base)
        for bits in (1, 2, 3, 3, 3, 4, 5):
            x = base
            for b in rng.sample(range(64), bits):
                x ^= 1 << b
            fps.add(x)
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << a) ^ (1 << b) for a in range(32) for b in range(32, 64)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    for n, a in enumerate(signed):
        union.find(a)
        for b in signed[:n]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                union.link(a, b)
    scratch = Scratch(spark, "test")
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), scratch)
    pairs = [(r.a, r.b) for r in found.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), scratch).collect()}
    assert {x: got.get(x, x) for x in signed} == {x: union.find(x) for x in signed}


def test_a_long_chain_is_one_component(spark):
    from sumire.llm._shared import Scratch, components

    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    got = components(edges, Scratch(spark, "test")).collect()
    assert len(got) == 301 and {r.component for r in got} == {0}


def test_empty_and_null_ids(spark, tables):
    assert simhash.op2_simhash(spark, tables(documents=[])).collect() == []
    rows = simhash.op2_simhash(spark, tables(documents=[(None, "a b c"), (7, "a b c"), (7, "q"), (None, "lone words here"), (9, None), (3, " ")])).collect()
    got = sorted(((r.doc_id, r.component_id) for r in rows), key=repr)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (9, 3), (3, 3)], key=repr)


def test_stage_keeps_one_of_each_and_all_columns(spark):
    docs = spark.createDataFrame([(5, "same words in here", "x"), (2, "Same words in here", "y"), (8, "others altogether now", "z"), (None, "same words in here", "n")], "doc_id int, text string, __sim_gone string")
    out = simhash.stage_simhash(spark, docs, "")
    assert out.columns == docs.columns
    # one row of each group: a copy without an id goes as any other
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([(2, "Same words in here", "y"), (8, "others altogether now", "z")], key=repr)
