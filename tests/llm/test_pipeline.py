from __future__ import annotations

import hashlib

import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from sumire.llm import bpe, decontaminate, linededup, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages():
    assert [f for _, f in corpus_pipeline.STAGES] == [toxicity.stage_toxicity, linededup.stage_lines, simhash.stage_simhash, decontaminate.stage_decontaminate, bpe.stage_bpe]


def test_against_one_row_at_a_time(spark, tables, union):
    """Every stage done again in plain Python, given the classifier's verdicts."""
    from test_decontaminate import words
    from test_linededup import expected as lines_of
    from test_wide import alike, plain

    sf = "/root/testdata/sf0.001"
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [tuple(r.values()) for r in pq.read_table(f"{sf}/documents.parquet", columns=COLUMNS).to_pylist()]
    top = max(d[0] for d in docs) + 1
    docs += [(top, "a\nb\nc\nd", "en", "s", 7), (top + 1, "a\nb\nc\ne f g", "en", "s", 11), (top + 2, item, "en", "s", 9), (top + 3, None, None, None, None), (top + 4, "x " * 400 + item, "en", "s", 1)]
    items = [tuple(r.values()) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()] + [(999, item)]
    labels = [tuple(r.values()) for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()]
    folder = tables(documents=docs, benchmark=items, labels=labels)

    toxic = {r.doc_id for r in toxicity.op10_toxicity(spark, folder).where("toxic").collect()}
    left = {d[0]: d[1] for d in docs if d[0] not in toxic}
    left = {i: x[4] for i, x in lines_of(list(left.items())).items()}
    sets = {i: plain(t) for i, t in left.items()}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and alike(a, b):
                union.link(i, j)
    left = {i: t for i, t in left.items() if union.find(i) == i}
    windows = {tuple(w[k : k + min(13, len(w))]) for _, t in items if (w := words(t)) for k in range(len(w) - min(13, len(w)) + 1)}
    kept = {}
    for i, t in left.items():
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not hit:
            kept[i] = t
        elif 20 * len(hit) < len(w):
            kept[i] = None  # cut; its words are compared below
    library = Tokenizer.from_file(bpe.default_vocabulary())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(kept)
    for i, t in kept.items():
        if t is not None or left[i] is None:
            assert got[i].ids == library.encode(t or "", add_special_tokens=False).ids and got[i].n_tokens == len(got[i].ids)
        else:
            text = library.decode(got[i].ids, skip_special_tokens=False)
            found = words(text)
            assert len(found) < len(words(left[i])) and not any(tuple(found[k : k + 13]) in windows for k in range(len(found) - 12))
    assert top + 2 not in got and words(library.decode(got[top + 4].ids)) == ["x"] * 400


def test_stages_keep_the_columns_of_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    ids = docs.where("n_tokens > 0").first()
    assert len(ids.ids) == ids.n_tokens and hashlib.sha256(b"").hexdigest()


def test_empty(spark, tables):
    assert corpus_pipeline.run(spark, tables(documents=[], benchmark=[], labels=[])).collect() == []
