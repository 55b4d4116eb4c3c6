from __future__ import annotations

import hashlib
import random

import pyarrow.parquet as pq

from sumire.llm import linededup


def expected(docs) -> dict:
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        lines = [] if text is None else text.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if not any(x.strip() for x in w):
                continue
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        kept = [x for k, x in enumerate(lines) if k not in gone]
        out[i] = (len(lines), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256("\n".join(kept).encode()).hexdigest(), None if text is None else "\n".join(kept))
    return out


def made():
    rng = random.Random(11)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", "", "dd", "é ü"]) for _ in range(rng.randrange(12)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "\n\n\n\n\n"), (203, "x\ny\nz\n" * 3000), (204, "k" * 100_000), (205, "p\nq\nr"), (206, "p\nq\nr"), (207, "p\nq\nr\n"), (208, " \n\t\n \nu"), (209, " \n\t\n \nu")]
    rng.shuffle(docs)
    return docs


def test_brute_force(spark, tables):
    docs = made()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_spans, r.kept_sha256) for r in linededup.op5_line_dedup(spark, tables(documents=docs)).collect()}
    assert got == {i: x[:4] for i, x in expected(docs).items()}


def test_table_and_sql(spark, sf_dir, duck, rows):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_spans, r.kept_sha256) for r in linededup.op5_line_dedup(spark, sf_dir).collect()}
    assert got == {i: x[:4] for i, x in expected(list(zip(docs["doc_id"], docs["text"], strict=True))).items()}
    assert rows(linededup.op5_line_dedup(spark, sf_dir)) == duck(linededup.SQL["op5_line_dedup"])


def test_stage_keeps_rows_and_columns(spark):
    docs = [*made(), (None, "p\nq\nr\ns")]
    df = spark.createDataFrame([(i, t, "h", 3) for i, t in docs], "doc_id int, text string, __hash string, n_chars int")
    out = linededup.stage_lines(spark, df, "")
    assert out.dtypes == df.dtypes
    got = {r.doc_id: r for r in out.collect()}
    want = expected(docs)
    assert len(got) == len(docs) and {i: r.text for i, r in got.items()} == {i: x[4] for i, x in want.items()}
    assert {r["__hash"] for r in got.values()} == {"h"}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values())


def test_empty_and_repeated_rows(spark, tables):
    assert linededup.op5_line_dedup(spark, tables(documents=[])).collect() == []
    got = linededup.op5_line_dedup(spark, tables(documents=[(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (None, "a\nb\nc")])).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in got), key=repr) == [(1, 3), (1, 3), (2, 3), (None, 0)]


def test_merging_windows():
    assert linededup.keep_lines(list("abcdefgh"), [1, 2, 5]) == (["a"], 1)
    assert linededup.keep_lines(list("abcdefgh"), [0, 5]) == (["d", "e"], 2)
