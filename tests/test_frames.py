from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sumire.functions import native
from sumire.functions.sentences import split
from sumire.operators import lint, report
from sumire.operators.rules import lint_text
from sumire.plans.config import Config
from sumire.sources.files import from_table, read_files, read_text, token_lines
from sumire.streaming.lint_stream import lint_folder

DOCS = [("a.md", "すごい!\n\nこれはﾃｽﾄです"), ("b.md", "よい。"), ("c.md", ""), ("d.md", None), ("e.md", "x\u200by! " * 2000)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "path string, source string")


def test_findings_are_those_of_one_document(docs):
    got = {}
    for r in lint.findings(docs).collect():
        got.setdefault(r.path, []).append((r.nth, r.rule, list(r.range)))
    for path, source in DOCS:
        assert sorted(got.get(path, [])) == [(n, d["rule"], d["range"]) for n, d in enumerate(lint_text(source or "", Config()))]


def test_nulls_clashing_and_empty(spark, docs):
    odd = docs.selectExpr("path", "source", "1 AS diagnostics", "path AS block_idx", "CAST(NULL AS INT) AS fixed")
    assert lint.lint(odd).count() == 5 and lint.fix(odd).count() == 5 and lint.blocks(odd).count() > 0
    none = docs.limit(0)
    assert lint.findings(none).collect() == [] and lint.summary(lint.lint(none)).first().errors == 0


def test_fix_summary_and_gate(docs):
    out = lint.fix(docs)
    assert {r.path: r.source for r in report.rewritten(out).collect()} == {"a.md": "すごい!\n\nこれはテストです", "e.md": "xy! " * 2000}
    s = lint.summary(out).first()
    assert s.fixed == 2001 and s.errors > 0 and s.warnings == 0
    assert lint.gate(lint.lint(docs), Config()) and not lint.gate(lint.lint(docs), Config.merged({"gate": {"fail-on": "never"}}))


def test_one_round_natively(docs):
    once = {r.path: (r.fixed.source, r.fixed.applied) for r in lint.fix_once(lint.lint(docs)).collect()}
    assert once["a.md"] == ("すごい!\n\nこれはテストです", 1) and once["e.md"][1] == 2000 and once["b.md"] == ("よい。", 0)


def test_reports(docs):
    linted = lint.lint(docs)
    text = report.render(linted)
    assert text.startswith("a.md:1:4: Disallow to use \"!\". [no-exclamation-question-mark]\n")
    whole = json.loads(report.render(linted, "json"))
    assert whole["version"] == 1 and whole["summary"]["errors"] == text.count("\n") and len(whole["files"]) == 5
    assert "fix" not in whole["files"][0]["diagnostics"][0]
    other = json.loads(report.render(linted, "textlint"))
    first = other[0]["messages"][0]
    assert first["ruleId"] == "ja-technical-writing/no-exclamation-question-mark" and first["severity"] == 2
    assert first["index"] == 3 and first["loc"] == {"start": {"line": 1, "column": 4}, "end": {"line": 1, "column": 5}}
    with pytest.raises(ValueError):
        report.render(linted, "xml")


def test_sources(spark, tmp_path):
    (tmp_path / "b.md").write_text("二！\r\n", newline="")
    (tmp_path / "a.md").write_text("一")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    paths = [str(tmp_path / "b.md"), str(tmp_path / "a.md")]
    got = [(r.path, r.source) for r in read_files(spark, paths).orderBy("path_ord").collect()]
    assert got == [(paths[0], "二！\r\n"), (paths[1], "一")]
    with pytest.raises(Exception, match="UTF-8"):
        read_files(spark, [str(tmp_path / "bad.md")]).collect()
    assert read_text(spark, "x", "n").union(read_files(spark, paths)).count() == 3
    assert from_table(spark.range(1).selectExpr("id", "'t' AS text"), "id", "text").first().asDict() == {"path": "0", "source": "t"}
    (tmp_path / "t.txt").write_text("# c\n\n- l\nこれは\n")
    assert [r.text for r in token_lines(spark, str(tmp_path / "t.txt")).collect()] == ["これは"]
    dump = json.loads(report.token_dump(lint.tokens(token_lines(spark, str(tmp_path / "t.txt")))).first().json)
    assert dump[0].split("|")[0] == "これ" and dump[1].split("|")[-1] == "2"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("すごい!\n\n次。")
    q = lint_folder(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("linted").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("linted").first()
    assert r.path.endswith("a.md") and r.diagnostics[0].rule == "no-exclamation-question-mark"


def test_command_line(tmp_path, spark, capsys, monkeypatch):
    from sumire.__main__ import main

    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.md").write_text("これはﾃｽﾄです。\n")
    assert main(["--list-rules"]) == 0 and len(capsys.readouterr().out.split()) == 17
    assert main([]) == 2 and main(["--config", "none.yml", "a.md"]) == 2
    assert main(["a.md"]) == 1 and "no-hankaku-kana" in capsys.readouterr().out
    assert main(["--fix", "a.md"]) == 0 and (tmp_path / "a.md").read_text() == "これはテストです。\n"
    (tmp_path / "sumire.yml").write_text("rules: {nothing: true}")
    assert main(["a.md"]) == 2


ALPHABET = st.text(alphabet="ab 。！?.．!\n　字😀ﾃ\u200b\x01", max_size=60)


@settings(max_examples=5, deadline=None)
@given(st.lists(ALPHABET, min_size=20, max_size=40))
def test_native_sentences_and_spots(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: list(r.s) for r in df.select("id", native.sentences(df["text"]).alias("s")).collect()}
    assert got == {i: [t[a:b] for a, b in split(t)] for i, t in enumerate(texts)}
    marks = native.rule(df, "no-exclamation-question-mark").collect()
    assert sorted((r.id, r.start) for r in marks) == [(i, k) for i, t in enumerate(texts) for k, c in enumerate(t) if c in "!！?？"]
