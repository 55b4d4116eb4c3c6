from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest

from sumire.llm import embeddings


def usable(v) -> bool:
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows: list[tuple], union, alike: float = 0.95):
    ok = [(n, np.float64(v)) for n, (_, v, *_) in enumerate(rows) if usable(v)]
    pairs = set()
    for size in {len(v) for _, v in ok}:
        some = [(n, v) for n, v in ok if len(v) == size]
        x = np.stack([v for _, v in some])
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= alike, 1)), strict=True):
            pairs.add((some[a][0], some[b][0]))
    return pairs


def links(rows, pairs) -> dict[int, int]:
    out = dict.fromkeys(range(len(rows)), 0)
    for a, b in pairs:
        out[a] += 1
        out[b] += 1
    return out


def near(rng, v, cosine):
    noise = rng.standard_normal(len(v))
    v = v / np.linalg.norm(v)
    noise -= noise @ v * v
    return cosine * v + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)


def test_all_pairs_of_a_table(spark, sf_dir, union):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    rows = list(zip(t["vec_id"], t["embedding"], strict=True))
    pairs = brute(rows, union)
    got = {r.vec_id: r for r in embeddings.op8_embeddings(spark, sf_dir).collect()}
    want = links(rows, pairs)
    assert len(got) == len(rows) and all(got[i].n_links <= want[n] for n, (i, _) in enumerate(rows))
    assert sum(r.n_links for r in got.values()) >= 0.9 * 2 * len(pairs)


def test_recall_without_false_links(spark, tables, monkeypatch, union):
    monkeypatch.setattr(embeddings, "CELL", 8)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "GUESTS", 20)
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(300):
        v = rng.standard_normal(16)
        rows += [v] + [near(rng, v, c) * rng.uniform(0.1, 9) for c in (0.99, 0.955, 0.945, 0.9)]
    hot = rng.standard_normal(16)
    rows += [hot] * 50 + [near(rng, hot, 0.96) for _ in range(200)]
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]
    pairs = brute(rows, union)
    got = {r.vec_id: r for r in embeddings.op8_embeddings(spark, tables(embeddings=rows)).collect()}
    want = links(rows, pairs)
    assert all(got[i].n_links <= want[n] for n, (i, _) in enumerate(rows))
    assert sum(r.n_links for r in got.values()) >= 0.95 * 2 * len(pairs)
    for a, b in pairs:
        union.link(rows[a][0], rows[b][0])
    agree = sum(got[i].component_id == union.find(i) for i, _ in rows)
    assert agree >= 0.95 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark, tables):
    one, nan, inf = [1.0, 2.0], float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, one), (8, [2.0, 4.0]), (9, one), (10, one), (10, one), (11, [1.0, 2.0, 0.0]), (None, one), (12, [-1.0, -2.0]), (13, [1e-38, 2e-38]), (14, [1e38, 2e38]), (None, None), (15, [0.0, -0.0]), (16, [-0.0, 1.0]), (17, [0.0, 1.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.op8_embeddings(spark, tables(embeddings=rows)).collect()), key=repr)
    lone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 11, 12, 15)]
    hot = [(i, 7, 7, i == 7) for i in (7, 8, 9, 10, 10, 13, 14)] + [(None, 7, 7, False)]
    assert got == sorted([*lone, *hot, (None, 0, None, False), (16, 1, 16, True), (17, 1, 16, False)], key=repr)


def test_empty(spark, tables):
    assert embeddings.op8_embeddings(spark, tables(embeddings=[])).collect() == []
    assert embeddings.op8_embeddings(spark, tables(embeddings=[(1, None)])).collect()[0].kept


def test_cells_come_nearest_first():
    rng = np.random.default_rng(9)
    index = embeddings.MultiIndex(rng.standard_normal((500, 8)), 500 * embeddings.CELL // 10, 0.95)
    x = embeddings.unit(rng.standard_normal((20, 8)))
    cells = index.order(x, 12)
    d = [embeddings.squared(h, c) for h, c in zip(embeddings.halves(x), index.books, strict=True)]
    whole = (d[0][:, :, None] + d[1][:, None, :]).reshape(20, -1)
    got = np.take_along_axis(whole, cells, 1)
    assert np.allclose(got, np.sort(whole, 1)[:, : cells.shape[1]])


@pytest.mark.parametrize("kind", ["array<double>", "array<float>"])
def test_components_kinds(spark, kind):
    df = spark.sql(f"SELECT 1 AS vec_id, CAST(array(1, 2) AS {kind}) AS embedding UNION ALL SELECT 2, CAST(array(2, 4) AS {kind})")
    assert {r.component_id for r in embeddings.near_duplicates(df).collect()} == {1}


def test_vectors_that_share_a_hash_are_told_apart(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0]), (6, [2.0])], "hash long, embedding array<float>")
    clash = spark.createDataFrame([(5,)], "hash long")
    got = [(r.hash, tuple(r.embedding), r.node) for r in embeddings.with_nodes(df, clash).collect()]
    assert len({n for *_, n in got}) == 3 and {n for h, _, n in got if h == 6} == {6}
    assert len({n for _, e, n in got if e == (0.0, 1.0)}) == 1
