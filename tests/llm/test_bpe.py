from __future__ import annotations

import hashlib
import random

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from sumire.llm import bpe


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_padding()
    t.no_truncation()
    return t


def odd_texts() -> list[str]:
    rng = random.Random(3)
    pools = ["abcdefgh ", "aA0 .,'s\n\t", "éüßñ 漢字かな", "😀🇩🇪👩‍👧 ​  　", "the and ing 's 't 're 've 'll 'd", "\x00\x1c\x1d\x85\xad²½ªº", "١٢٣४५६ ﾃｽﾄ", "<|endoftext|> <|"]
    out = ["", " ", "  ", "\n\n  a", "it's  we'll   They'RE", "a" * 5000, "ab" * 3000, " " * 3000, "=" * 1000 + "x", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>  c", "x\r\ny\r\n\r\n z", "́á", "﻿b", "\U000e0001", "a᠎b", "Ⅷ ⅷ ㊀ ①", "ͅx"]
    for pool in pools:
        out += ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    mixed = "".join(pools)
    out += ["".join(rng.choice(mixed) for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    out += ["".join(chr(rng.choice([rng.randrange(0x20, 0x300), rng.randrange(0x300, 0xD800), rng.randrange(0xE000, 0x11000), rng.randrange(0x10000, 0x20000)])) for _ in range(80)) for _ in range(300)]
    return out


def test_ids_and_texts_as_the_library(library):
    own = bpe.load(bpe.default_vocabulary())
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids, repr(text)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(text)


def test_latin_pieces_are_the_general_ones():
    own, rng = bpe.load(bpe.default_vocabulary()), random.Random(4)
    for _ in range(3000):
        text = "".join(chr(rng.randrange(256)) for _ in range(rng.randrange(40)))
        assert bpe.LATIN.findall(text) == own.pieces.findall(text), repr(text)


def test_memory_of_pieces_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own = bpe.Bpe(bpe.default_vocabulary())
    for text in odd_texts()[:200]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(own.memo) + len(own.memo.old) <= 2 * (5 + 5000)


def test_query(spark, tables, library, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    docs = list(zip(docs["doc_id"], docs["text"], strict=True)) + [(-1, None), (-2, ""), (None, "a b"), (-3, "a b"), (-3, "a b")]
    want = []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.op4_bpe(spark, tables(documents=docs))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_stage_and_round_trip(spark):
    docs = spark.createDataFrame([(1, "Ein Wörtchen 😀", "old"), (2, None, "old"), (3, "", None)], "doc_id int, text string, ids string")
    out = bpe.stage_bpe(spark, docs, "")
    assert out.columns == ["doc_id", "ids", "n_tokens"]
    back = {r.doc_id: (r.text, r.n_tokens) for r in bpe.decode(out).collect()}
    assert back[1][0] == "Ein Wörtchen 😀" and back[2] == ("", 0) and back[3] == ("", 0)
    assert bpe.op4_bpe is not None and bpe.encode(docs.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["a" * 300_000, "abc def, " * 200_000, "漢字" * 100_000, "x1\n\n" * 200_000], ids=["one piece", "words", "wide", "lines"])
def test_very_long_texts(text, library):
    own = bpe.load(bpe.default_vocabulary())
    ids = own.encode(text).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids and own.decode(ids) == text
