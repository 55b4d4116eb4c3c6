from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest

from sumire.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark, tables):
    """Trained on half of the labels, the chain finds most toxic documents of the other half and hardly any others."""
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    own = [r for r in labels if r["doc_id"] % 2]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chain = toxicity.train(docs, spark.createDataFrame([(r["doc_id"], r["quality"], r["toxic"]) for r in own], "doc_id long, quality int, toxic int"))
    p = {r.doc_id: r["__p"] for r in toxicity.score(docs, chain).select("doc_id", "__p").collect()}
    rest = [r for r in labels if not r["doc_id"] % 2]
    hit = [p[r["doc_id"]][1] >= 0.5 for r in rest if r["toxic"]]
    false = [p[r["doc_id"]][1] >= 0.5 for r in rest if not r["toxic"]]
    assert np.mean(hit) >= 0.8 and np.mean(false) <= 0.005
    assert [c.name for c in chain] == ["low_quality", "toxic"] and len(chain[1].weights) == len(chain[1].at) + toxicity.DENSE + 2


def test_a_later_link_reads_the_earlier_one():
    rng = np.random.default_rng(1)
    first = rng.random(600) < 0.5
    rows = [({b"x"} if f else {b"y"}) | {bytes([65 + int(k)]) for k in rng.integers(0, 20, 3)} for f in first]
    chain = toxicity.fit_chain(rows, np.zeros((600, toxicity.DENSE)), {"a": first.astype(float), "b": first.astype(float)})
    low = chain[1].score({b"x"}, [0] * 4, [0.0])
    high = chain[1].score({b"x"}, [0] * 4, [1.0])
    assert high > low


def test_same_result_again(spark, sf_dir, rows):
    assert rows(toxicity.op10_toxicity(spark, sf_dir)) == rows(toxicity.op10_toxicity(spark, sf_dir))


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, 1), (None, 1, 1), (99, 0, 1)], [(1, 1, 0), (2, 0, 0), (2, 1, 1), (3, 1, 1)]])
def test_odd_labels_and_texts(spark, tables, labels):
    docs = [(1, "fine words"), (2, None), (3, ""), (None, "x" * 300_000), (4, "w " * 200_000), (4, "w"), (4, "w")]
    out = toxicity.op10_toxicity(spark, tables(documents=docs, labels=labels))
    got = out.collect()
    assert len(got) == len(docs) and all(0 <= r.p_toxic <= 1 and r.toxic == (r.p_toxic >= 0.5) for r in got)


def test_empty_documents(spark, tables):
    assert toxicity.op10_toxicity(spark, tables(documents=[], labels=[(1, 1, 1)])).collect() == []


def test_stage_keeps_columns(spark, tables):
    folder = tables(labels=[])
    docs = spark.createDataFrame([(1, "a", "p", "q")], "doc_id int, text string, __p string, __text string")
    out = toxicity.stage_toxicity(spark, docs, folder)
    assert out.dtypes == docs.dtypes and [tuple(r) for r in out.collect()] == [(1, "a", "p", "q")]


def plain_chain(docs: dict, labels: dict) -> dict[int, list[float]]:
    """The chain once more, one row at a time: sorted sample, features counted by hand, logistic regression by gradient steps on its objective."""
    import math
    import re

    def view(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        own, raw = set(words), len((text or "").encode())
        n, size = max(1, len(words)), max(1, raw)
        marks = own | {b"4 " + w[:4] for w in own} | {b"5 " + w[:5] for w in own}
        return marks, [math.log1p(len(words)) / 10, len(own) / n, sum(map(len, words)) / size, min(size / n, 40) / 40]

    def features(views, y):
        p, n, scored = sum(y), len(y) - sum(y), []
        for x in {x for marks, _ in views for x in marks}:
            a = sum(k for (marks, _), k in zip(views, y, strict=True) if x in marks)
            b = sum(1 - k for (marks, _), k in zip(views, y, strict=True) if x in marks)
            odds = math.log((a + 0.5) / (p - a + 0.5)) - math.log((b + 0.5) / (n - b + 0.5))
            if a + b < 3 or abs(odds) < 2:
                continue
            share, g = (a + b) / (p + n), 0.0
            for k, want in ((a, p * share), (b, n * share), (p - a, p * (1 - share)), (n - b, n * (1 - share))):
                g += 2 * k * math.log(k / want) if k else 0
            if g >= 22:
                scored.append((-g, x))
        return [x for _, x in sorted(scored)[:300]]

    def row(view_, names, before):
        return [float(x in view_[0]) for x in names] + view_[1] + before + [1.0]

    def fitted(x, y):
        x, y = np.array(x), np.array(y, float)
        ridge = np.full(x.shape[1], 0.1)
        ridge[-1] = 1e-6
        w = np.zeros(x.shape[1])
        for _ in range(500):  # damped Newton until nothing moves
            p = 1 / (1 + np.exp(-(x @ w)))
            gradient = x.T @ (y - p) - ridge * w
            move = np.linalg.lstsq((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient, rcond=None)[0]
            w = w + move / max(1.0, np.abs(move).max() / 2)
            if np.abs(gradient).max() < 1e-10:
                break
        return w

    def probability(w, r):
        return 1 / (1 + math.exp(-float(np.dot(w, r))))

    ids = [i for i in labels if i in docs]
    views = [view(docs[i]) for i in ids]
    before, models = [[] for _ in ids], []
    for y in ([float(labels[i][0] == 0) for i in ids], [float(labels[i][1] > 0) for i in ids]):
        held = [0.0] * len(ids)
        for k in range(5):
            train = [i for i in range(len(ids)) if i % 5 != k]
            own = [y[i] for i in train]
            if not 0 < sum(own) < len(own):
                share = sum(own) / len(own)
                held = [share if i % 5 == k else h for i, h in enumerate(held)]
                continue
            names = features([views[i] for i in train], own)
            w = fitted([row(views[i], names, before[i]) for i in train], own)
            held = [probability(w, row(views[i], names, before[i])) if i % 5 == k else h for i, h in enumerate(held)]
        names = features(views, y)
        models.append((names, fitted([row(v, names, b) for v, b in zip(views, before, strict=True)], y)))
        before = [[*b, h] for b, h in zip(before, held, strict=True)]
    out = {}
    for i, text in docs.items():
        p: list[float] = []
        for names, w in models:
            p.append(probability(w, row(view(text), names, p)))
        out[i] = p
    return out


def test_against_plain_chain(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    want = plain_chain(docs, {r.doc_id: (r.quality, r.toxic) for r in table})
    got = toxicity.op10_toxicity(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r.p_low_quality - want[r.doc_id][0]) < 1e-4 and abs(r.p_toxic - want[r.doc_id][1]) < 1e-4 and r.toxic == (want[r.doc_id][1] >= 0.5)
