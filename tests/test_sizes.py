"""What keeps large tables within bounds: pieces of batches, short ways that give what the long ones give, tasks by size."""

from __future__ import annotations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sumire import queries
from sumire.functions import native
from sumire.functions.markdown import WHITE
from sumire.functions.sentences import CLOSERS, PAIRS, TERMINATORS, split
from sumire.functions.tokens import ODD, Builtin, tokenize, word_tokens
from sumire.operators import lint, rules
from sumire.plans.config import Config
from sumire.sources import files

TEXT = st.lists(st.sampled_from(["が", "は", "を", "私", "情報処理技術者", "ﾃｽﾄ", "word", "word,", "it's", "(x)", "é1", "𠮟𠮟", "😀", "\x01and", "。", "、", ".", "!", '"', "「", "」", " ", "  ", "\n", "しかし", "または", "行くが", "ない", "です", "である", "食べれる", "かも", "​"]), max_size=40).map("".join)


class Other(Builtin):
    """The built-in analyser as if it were another: no short ways."""


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_are_those_of_tokens(text):
    assert Builtin().count(text) == len(tokenize(Builtin(), text))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_short_ways_change_no_finding(text):
    assert rules.lint_rows(text, Config()) == rules.lint_rows(text, Config(), Other())


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_rounds_of_fixes_are_those_of_whole_lints(text):
    source, total = text, 0
    for _ in range(10):
        source, n = rules.apply_fixes(source, rules.lint_text(source, Config()))
        if not n:
            break
        total += n
    assert rules.fix_text(text, Config()) == (source, total, rules.lint_text(source, Config()))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab .。！?"「」()x\n　', max_size=60))
def test_sentences_as_sign_by_sign(text):
    out, stack, start = [], [], 0
    ends = lambda i: text[i] in TERMINATORS or text[i] == "." and (i + 1 == len(text) or text[i + 1] in WHITE)
    for i, c in enumerate(text):
        if c in PAIRS or c == '"' and stack[-1:] != ['"']:
            stack.append(c)
        elif c in CLOSERS and stack[-1:] == [CLOSERS[c]] or c == '"':
            stack.pop()
        elif not stack and ends(i) and not (i + 1 < len(text) and ends(i + 1)):
            out.append(text[start : i + 1])
            start = i + 1
    out = [x.strip(WHITE) for x in [*out, text[start:]]]
    assert [text[a:b] for a, b in split(text)] == [x for x in out if x]


def test_a_tally_counts_what_a_lint_finds(spark):
    docs = spark.createDataFrame([("a", "すごい! すごい!\n\nこれはﾃｽﾄです"), ("b", None), ("c", "a, b, c, d, e")], "path string, source string")
    config = Config.merged({"rules": {"max-comma": {"severity": "warning"}}})
    found = lint.findings(docs, config).groupBy("path", "rule", "severity").count()
    assert sorted(lint.tally(docs, config).selectExpr("path", "inline(counts)").collect()) == sorted(found.collect())
    assert lint.summary(lint.tally(docs, config)).collect() == lint.summary(lint.lint(docs, config)).collect()
    assert lint.summary(lint.tally(docs.limit(0))).first().errors == 0


def test_odd_words_and_the_rest_are_all_words():
    text = "plain words, it's 私が\n x-1 (y) 😀 end"
    assert ODD.findall(text) == ["words,", "it's", "私が", "(y)", "😀"] and [t.surface for t in word_tokens("it's")] == ["it", "'", "s"]


def test_a_batch_is_worked_on_in_pieces():
    texts = ["x" * 1000, None, "", "y" * lint.PIECE, "z" * (2 * lint.PIECE), *["あ" * 1000] * 500]
    b = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["k", "t"])
    parts = list(lint._pieces(b, 1))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b]))
    assert all(p.num_rows == 1 or sum(len(x.encode()) for x in p["t"].to_pylist() if x) <= lint.PIECE for p in parts) and len(parts) > 6
    assert [p.num_rows for p in lint._pieces(b.slice(0, 0), 1)] == [0]


@pytest.fixture
def odd(spark, tmp_path):
    rows = [(1, "a b が, c"), (2, None), (3, ""), (4, "a b が, c"), (5, "情報 and x")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_text_dedup_tokens_counts_and_keeps_every_row(spark, odd):
    d = queries._docs(spark, odd)
    whole = {r.doc_id: r.n for r in lint.tokens(d).selectExpr("doc_id", "size(tokens) AS n").collect()}
    out = queries.text_dedup_tokens(spark, odd)
    assert {r.doc_id: r.n_tokens for r in out.collect()} == whole and whole[2] == whole[3] == 0
    assert "surface" not in out._jdf.queryExecution().toString()  # tokens themselves aren't sent


def test_tasks_follow_the_size_of_a_table(spark, tmp_path, monkeypatch):
    spark.range(60000).selectExpr("id AS doc_id", "sha2(string(id), 512) AS text").repartition(8).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    assert len(d.inputFiles()) >= spark.sparkContext.defaultParallelism
    assert files.spread(d).rdd.getNumPartitions() == d.rdd.getNumPartitions()  # small ones stay
    monkeypatch.setattr(files, "TASK_BYTES", 100_000)
    out, size = files.spread(d), sum(p.stat().st_size for p in (tmp_path / "d").glob("*.parquet"))
    assert size > 4_000_000 and out.rdd.getNumPartitions() == -(-size // 100_000) and out.count() == 60000
    sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) <= 2 * 60000 / len(sizes)


def test_combining_signs_in_a_row_are_all_found(spark):
    texts = ["か\u3099\u3099", "\u3099", "a\u3099\U0001f600\u309a\u309b\n\u3099", "", "\u3099\u3099\u3099"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = [(i, k, t[k - 1 : k + 1]) for i, t in enumerate(texts) for k in range(1, len(t)) if "\u3099" <= t[k] <= "\u309c"]
    assert sorted(tuple(r) for r in native.rule(df, "no-nfd").collect()) == want
    assert df.select(native.count(df["text"], "no-nfd").alias("n")).groupBy().sum("n").first()[0] == len(want) == 8
