"""What each rule finds: places are (line, column) or UTF-16 offsets."""

from __future__ import annotations

import pytest

from sumire.functions.markdown import Document
from sumire.functions.sentences import split
from sumire.functions.tokens import Builtin, Token, tokenize
from sumire.operators.rules import apply_fixes, fix_text, lint_text
from sumire.plans.config import Config, ConfigError, matcher


def found(source: str, rule: str, options: object = None, **more) -> list[dict]:
    config = Config.merged({"rules": {rule: options if options is not None else True} | more})
    return [d for d in lint_text(source, config) if d["rule"] == rule]


def starts(source: str, rule: str, options: object = None) -> list[int]:
    return [d["range"][0] for d in found(source, rule, options)]


LONG = "あ" * 101


@pytest.mark.parametrize(
    ("source", "rule", "options", "want"),
    [
        (LONG + "。", "sentence-length", None, [0]),
        ("あ" * 99 + "。", "sentence-length", None, []),
        ("😀" * 51, "sentence-length", None, [0]),
        ("😀" * 51, "sentence-length", {"countBy": "codepoints"}, []),
        (f"[{LONG}](http://a.b)", "sentence-length", None, []),
        (f"「{'あ' * 60}。{'い' * 60}」", "sentence-length", None, [0]),
        ("短い。" + LONG, "sentence-length", None, [3]),
        (LONG, "sentence-length", {"skipPatterns": ["/あ{50}/"]}, []),
        (f"# {LONG}", "sentence-length", None, []),
        (f"> {LONG}", "sentence-length", None, []),
        ("a, b, c, d, e", "max-comma", None, [10]),
        ("a, b, c, d", "max-comma", None, []),
        ("情報処理技術者", "max-kanji-continuous-len", None, [0]),
        ("情報処理技術", "max-kanji-continuous-len", None, []),
        ("*情報処理技術者*", "max-kanji-continuous-len", None, []),
        ("**情報処理技術者**", "max-kanji-continuous-len", None, [2]),
        ("𠮟𠮟𠮟𠮟", "max-kanji-continuous-len", None, [0]),
        ("情報処理技術者", "max-kanji-continuous-len", {"allow": ["情報処理技術者"]}, []),
        ("すごい！ほんと?", "no-exclamation-question-mark", None, [3, 7]),
        ("Yahoo! です!", "no-exclamation-question-mark", None, [9]),
        ("すごい！ほんと?", "no-exclamation-question-mark", {"allowFullWidthExclamation": True}, [7]),
        ("[すごい!](u) *えっ!* **おお!**", "no-exclamation-question-mark", None, [20]),
        ("> あ\u200bい", "no-zero-width-spaces", None, [3]),
        ("a\x01b\tc\x85", "no-invalid-control-character", None, [1, 5]),
        ("か\u3099", "no-nfd", None, [1]),
        ("\u3099か", "no-nfd", None, []),
        ("これはﾃｽﾄです", "no-hankaku-kana", None, [3]),
        ("[ﾃｽﾄ](u)", "no-hankaku-kana", None, []),
        ("これはペンです", "ja-no-mixed-period", None, [6]),
        ("これはペンです。", "ja-no-mixed-period", None, []),
        ("これはペンです.", "ja-no-mixed-period", None, [7]),
        ("This is a pen", "ja-no-mixed-period", None, []),
        ("これは`code`", "ja-no-mixed-period", None, []),
        ("これは**強い**", "ja-no-mixed-period", None, []),
        ("- これはペンです", "ja-no-mixed-period", None, []),
        ("これは、あれで、それも、どれも、よい。", "max-ten", None, [15]),
        ("彼は彼は行く。", "no-doubled-joshi", None, [3]),
        ("彼は走る。彼は行く。", "no-doubled-joshi", None, []),
        ("しかし、行く。しかし、来る。", "no-doubled-conjunction", None, [7]),
        ("見れる。", "no-dropping-the-ra", None, [0]),
        ("行かないことはない。", "no-double-negative-ja", None, [7]),
        ("そうかもしれない。", "ja-no-weak-phrase", None, [2]),
        ("# 題\n\n本文。", "required-headings", {"headings": ["題", "概要"]}, [0]),
        ("> # 概要", "required-headings", {"headings": ["概要"]}, [0]),
        ("だめ、ダメ、だめ", "forbidden", {"patterns": ["だめ"]}, [0, 6]),
        ("abc ABC", "forbidden", {"patterns": ["/B./i"]}, [1, 5]),
        ("サーバとサーバー", "terminology", {"terms": [{"preferred": "サーバー", "avoid": ["/サーバ(?:ー)?/"]}]}, [0]),
    ],
)
def test_places(source, rule, options, want):
    assert starts(source, rule, options) == want


def test_rules_that_wait_for_options_are_off():
    assert not {d["rule"] for d in lint_text("license ! x", Config())} & {"required-headings", "forbidden", "terminology"}


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("これはペンである。これは本です。", {"である"}),
        ("これはペンです。", set()),
        ("- これは本です。", {"ですます"}),
    ],
)
def test_style(body, want):
    got = found(body, "no-mix-dearu-desumasu")
    assert bool(got) == bool(want)
    assert all(any(f'"{w}"調 の箇所' in d["message"] for w in want) for d in got)


def test_positions_in_wide_and_windows_text():
    d = found("😀\r\n漢字!", "no-exclamation-question-mark")[0]
    assert (d["line"], d["column"], d["endLine"], d["endColumn"], d["range"]) == (2, 3, 2, 4, [6, 7])
    assert starts("&amp;!", "no-exclamation-question-mark") == [5]
    assert starts("`a!b`c!", "no-exclamation-question-mark") == [6]


def test_order_and_severity():
    got = lint_text("!\u200b!", Config.merged({"rules": {"no-zero-width-spaces": {"severity": "warning"}}}))
    assert [(d["line"], d["column"]) for d in got] == sorted((d["line"], d["column"]) for d in got)
    assert {d["rule"]: d["severity"] for d in got} == {"no-zero-width-spaces": "warning", "no-exclamation-question-mark": "error"}


@pytest.mark.parametrize(
    ("source", "want", "n"),
    [
        ("あ\u200bい\x01。", "あい。", 2),
        ("これはﾃｽﾄです。", "これはテストです。", 1),
        ("か\u3099。", "が。", 1),
        ("ペンです.", "ペンです。", 1),
        ("😀ﾃｽﾄ。", "😀テスト。", 1),
        ("**ﾊ**ﾟ。", "**ハ**゚。", None),
        ("clean。", "clean。", 0),
    ],
)
def test_fixes(source, want, n):
    out, applied, left = fix_text(source, Config())
    assert (out == want or n is None) and (n is None or applied == n)
    assert fix_text(out, Config())[:2] == (out, 0)


def test_overlapping_fixes_wait():
    f = lambda a, b, t: {"fix": {"range": [a, b], "text": t}}
    assert apply_fixes("abcd", [f(1, 3, "X"), f(2, 4, "Y"), f(0, 1, "Z"), {"fix": None}]) == ("ZXd", 2)
    assert apply_fixes("😀b", [f(2, 3, ""), f(9, 9, "q")]) == ("😀", 1)


def test_blocks():
    kinds = [(b.kind, b.text, b.quoted) for b in Document("# h\n\np *a* `x`\nq\n\n- i\n  - j\n\n> q\n\n| a | b |\n|---|---|\n| c | d |\n\n```\ncode\n```\n").blocks]
    assert kinds == [("Heading", "h", False), ("Paragraph", "p a ー\nq", False), ("ListItem", "i", False), ("ListItem", "j", False), ("Paragraph", "q", True), *(("TableCell", c, False) for c in "abcd")]
    assert [b.text for b in Document("---\ntitle: x\n---\n\ntext ![alt](u) <b>x</b>\n\n<div>\nhtml\n</div>\n").blocks] == ["text  x"]


@pytest.mark.parametrize("text", ["a. b", "「あ。い」う。え", "あ！？い", " \n", "x.y z. (a. b) c.", '"a. b" c. d', "（あ。"])
def test_sentences_cover_the_text(text):
    spans = split(text)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans)
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())


def test_items_end_the_last_ones_paragraph():
    """A list's next item may have any number; an item that would interrupt a paragraph must be the first."""
    of = lambda text: [(b.kind, b.text, b.quoted) for b in Document(text).blocks]
    assert of("1. one\n2. two\nthree") == [("ListItem", "one", False), ("ListItem", "two\nthree", False)]
    assert of("text\n2. two") == [("Paragraph", "text\n2. two", False)]
    assert of("> quoted\n2. two") == [("Paragraph", "quoted", True), ("ListItem", "two", False)]


@pytest.mark.parametrize("end", ["", " ", "\n", "。", " 。 "])
def test_sentences_looked_at_alone_have_the_same_tokens(end):
    from sumire.operators.rules import View

    text = f"彼は行く。 私は a b は、行く。{end}これは。 それも{end}です！ いい. さて"
    block = Document(text).blocks[0]
    own = Builtin()
    whole = tokenize(own, block.text)
    for s in split(block.text):
        assert View(block, own, {}).of(s) == [t for t in whole if s[0] <= t.start < s[1]]


def test_sentence_ends():
    assert [("「あ。い」う。え")[a:b] for a, b in split("「あ。い」う。え")] == ["「あ。い」う。", "え"]
    assert [("a. b.c！？d")[a:b] for a, b in split("a. b.c！？d")] == ["a.", "b.c！？", "d"]


def test_any_backend():
    class Spaces:
        def segment(self, text):
            out, at = [], 0
            for w in text.split(" "):
                out.append(Token(w, at, at + len(w), "助詞" if w == "は" else "名詞"))
                at += len(w) + 1
            return [*out, Token("beyond", 0, 10**6)]

    assert [t.surface for t in tokenize(Spaces(), "a は b")] == ["a", "は", "b"]
    assert tokenize(Spaces(), "a")[0].reading == "*"
    got = lint_text("私 は は", Config(), Spaces())
    assert isinstance(got, list)

    class Broken:
        def segment(self, text):
            raise RuntimeError

    assert tokenize(Broken(), "x") == []


def test_tokens_lie_end_to_end():
    text = "これはテストです。すごいABC漢字かもしれない、行かない。"
    tokens = tokenize(Builtin(), text)
    assert "".join(t.surface for t in tokens) == text and all(text[t.start : t.end] == t.surface for t in tokens)


def test_configuration():
    c = Config.parse("rules:\n  max-comma: {max: 7}\n  max-ten: off\n  no-nfd: false\n  sentence-length: true\ngate:\n  fail-on: warning\n  max-warnings: 2\n")
    assert c.number("max-comma", "max", 4) == 7 and c.enabled("max-ten") and not c.enabled("no-nfd") and c.number("sentence-length", "max", 0) == 100
    assert c.fails(0, 1) and not c.fails(0, 0)
    assert not Config.merged({"gate": {"fail-on": "never"}}).fails(9, 9) and Config.merged({"gate": {"max-warnings": 1}}).fails(0, 2)
    assert not Config.merged({"gate": {"max-warnings": 1}}).fails(0, 2, 5)


@pytest.mark.parametrize(
    "own",
    [
        {"rules": {"sentence": True}},
        {"gate": {"fail-on": "eror"}},
        {"rules": {"forbidden": {"patterns": ["/(/"]}}},
        {"rules": {"forbidden": {"patterns": ["/a/x"]}}},
        {"rules": {"forbidden": {"patterns": ["/(?=a)/"]}}},
        {"rules": {"sentence-length": {"countBy": "bytes"}}},
        {"rules": {"terminology": {"terms": [{"avoid": ["x"]}]}}},
        {"other": 1},
    ],
)
def test_refused_configurations(own):
    with pytest.raises(ConfigError):
        Config.merged(own)


def test_matchers():
    assert matcher("") is None and matcher("a.b").search("a.b") and not matcher("a.b").search("axb")
    assert matcher("/a.b/s").search("a\nb") and not matcher("/a.b/").search("a\nb") and matcher("/x").search("/x")


@pytest.mark.parametrize(
    "source",
    ["> " * 2000 + "x", "- " * 2000 + "x", "\n".join("  " * i + "- x" for i in range(300)), "*_" * 3000 + "x" + "_*" * 3000, "~~a" * 5000, "[" * 20000, "[a](b" * 5000, " ".join("`" * (i % 90 + 1) for i in range(3000)), "a b。\n" * 10000, "漢" * 20000, "あ" * 20000, "「" * 20000, "|" * 20000, "\\*" * 20000],
)
def test_odd_sources_take_linear_time(source):
    import time

    began = time.process_time()
    lint_text(source, Config())
    assert time.process_time() - began < 20


@pytest.mark.parametrize(
    ("source", "flags"),
    [
        ("*a* b", [("a", "e"), (" b", "")]),
        ("**a *b* c** d", [("a ", "s"), ("b", "es"), (" c", "s"), (" d", "")]),
        ("***a** b* c", [("a", "es"), (" b", "e"), (" c", "")]),
        ("*a **b", [("*a **b", "")]),
        ("_a_b_ c", [("a_b", "e"), (" c", "")]),
        ("a*b*c", [("a", ""), ("b", "e"), ("c", "")]),
        ("~~a~~ b", [("a b", "")]),
        ("*a [b*c](u)*", [("a ", "e"), ("b*c", "el")]),
    ],
)
def test_inline(source, flags):
    got: list[tuple[str, str]] = []
    (b,) = Document(source).blocks
    for s in b.segments:
        mark = "e" * s.in_emphasis + "s" * s.in_strong + "l" * s.in_link
        text = b.text[s.start : s.end]
        if got and got[-1][1] == mark:
            got[-1] = (got[-1][0] + text, mark)
        else:
            got.append((text, mark))
    assert got == flags


def test_character_rules_agree_with_built_in_functions(spark, sf_dir):
    """On documents where Markdown plays no part the engine and the built-in functions find the same places."""
    from sumire import queries
    from sumire.functions import native

    docs = {r.doc_id: r.text for r in queries._docs(spark, sf_dir).collect() if r.text}
    plain = {}
    for i, text in docs.items():
        blocks = Document(text).blocks
        if len(blocks) == 1 and blocks[0].kind == "Paragraph" and blocks[0].text == text and all(s.kind == "text" and not (s.in_link or s.in_emphasis or s.in_strong) for s in blocks[0].segments):
            plain[i] = text
    assert len(plain) >= 5
    of = spark.createDataFrame(list(plain.items()), "doc_id long, text string")
    wide = {i: [k for k, c in enumerate(t) if c > "￿"] for i, t in plain.items()}
    total = 0
    for name in native.RULES:
        got = sorted((r.doc_id, r.start + sum(k < r.start for k in wide[r.doc_id])) for r in native.rule(of, name).collect())
        want = sorted((i, d["range"][0]) for i, t in plain.items() for d in found(t, name))
        assert got == want, name
        total += len(got)
    assert total > 20
    commas = sorted((i, d["range"][0]) for i, t in plain.items() if not set(t) & set("「」『』()[]{}\"“”（）") for d in found(t, "max-comma", {"max": 3}))
    whole = [(i, t) for i, t in plain.items() if not set(t) & set("「」『』()[]{}\"“”（）")]
    longs = sum(1 for i, t in whole for d in found(t, "sentence-length"))
    cut = spark.createDataFrame(whole, "doc_id long, text string").select("doc_id", native.F.explode(native.sentences(native.F.col("text"))).alias("s"))
    assert cut.where(native.utf16_length(native.F.col("s")) > 100).count() == longs and cut.where(native.F.regexp_count("s", native.F.lit(",")) > 3).count() == len(commas)
