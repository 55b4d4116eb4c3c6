from __future__ import annotations

import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest

from sumire.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items) -> list[tuple]:
    windows: dict[tuple, set[str]] = {}
    for name, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if name is None else str(name))
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=repr)


def made():
    rng = random.Random(10)
    text = lambda n, k=4: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 12, 13, 14, 30]), rng.choice([2, 4, 8]))) for i in range(30)] + [(90, None), (91, ""), (92, "!?"), (93, "Ünïc Ö x"), (94, "Ünïc Ö x"), (None, "zz zz")]
    docs = [(i, text(rng.randrange(60), rng.choice([2, 4, 8]))) for i in range(150)]
    docs += [(200 + i, text(40, 8) + "; " + items[i][1].upper() + " -- " + text(40, 8)) for i in range(30)]
    docs += [(300, None), (301, ""), (302, "ünïc-ö, X"), (303, "ÜNÏC Ö X"), (None, "zz_zz"), (304, text(80_000, 8)), (305, "a" * 200_000)]
    return docs, items


def test_brute_force(spark, tables):
    docs, items = made()
    assert got(decontaminate.op9_decontaminate(spark, tables(documents=docs, benchmark=items))) == expected(docs, items)


def test_long_items_alone(spark, tables):
    docs, items = made()
    items = [(i, t) for i, t in items if len(words(t)) >= 13]
    assert got(decontaminate.op9_decontaminate(spark, tables(documents=docs, benchmark=items))) == expected(docs, items)


def test_several_automata(spark, tables, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    docs, items = made()
    assert got(decontaminate.op9_decontaminate(spark, tables(documents=docs, benchmark=items))) == expected(docs, items)


def test_sql(spark, sf_dir, duck, rows):
    assert rows(decontaminate.op9_decontaminate(spark, sf_dir)) == duck(decontaminate.SQL["op9_decontaminate"])


def test_table(spark, sf_dir):
    read = lambda n: [tuple(r.values()) for r in pq.read_table(f"{sf_dir}/{n}.parquet").to_pylist()]
    docs, items = [r[:2] for r in read("documents")], read("benchmark")
    assert got(decontaminate.op9_decontaminate(spark, sf_dir)) == expected(docs, items)


@pytest.mark.parametrize(("docs", "items"), [([], []), ([], [(1, "a")]), ([(1, "a"), (2, None)], []), ([(1, "a b a")], [(1, "a")])])
def test_small(spark, tables, docs, items):
    assert got(decontaminate.op9_decontaminate(spark, tables(documents=docs, benchmark=items))) == expected(docs, items)


def test_stage_cuts_spans_and_drops_rows(spark, tables):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    clean, rest = "Clean words alone.", " ".join(f"w{i}x" for i in range(400))
    folder = tables(benchmark=[(1, item)])
    docs = spark.createDataFrame([(1, clean, "a", 5), (2, f"say {item.upper()}, now", "b", 5), (3, f"{rest} ({item}) end", "c", 5), (4, None, "d", 5), (5, "", "e", 5)], "doc_id int, text string, __items string, n_chars int")
    out = {r.doc_id: r for r in decontaminate.stage_decontaminate(spark, docs, folder).collect()}
    assert decontaminate.stage_decontaminate(spark, docs, folder).columns == docs.columns
    assert sorted(out) == [1, 3, 4, 5] and out[1].text == clean and out[3].text == f"{rest} () end"
    assert out[3]["__items"] == "c" and out[3].n_chars == len(out[3].text) and out[4].text is None and out[5].text == ""


def test_stage_in_several_passes(spark, tables, monkeypatch):
    docs, items = made()
    folder = tables(documents=docs, benchmark=items)
    read = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    one = key(decontaminate.stage_decontaminate(spark, read, folder))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    assert key(decontaminate.stage_decontaminate(spark, read, folder)) == one and len(one) < len(docs)
