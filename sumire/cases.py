"""Small documents with known results, and the queries that run the whole engine on them.

Each row of the documents table takes one case in front of its own text, which follows in a fenced block that no rule sees: so
whole tables and texts go through the engine, and what must come out is known and can be written as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumire.operators import lint, report
from sumire.plans.config import RULE_IDS, Config
from sumire.sources.files import spread

FENCE = "~" * 12

CONFIG = {'rules': {'forbidden': {'patterns': ['禁句', '/ng[0-9]+/i']}, 'terminology': {'terms': [{'preferred': 'サーバー', 'avoid': ['/サーバ(?:ー)?/']}]}, 'required-headings': {'headings': ['概要']}, 'no-zero-width-spaces': {'severity': 'warning'}}}

#: The heading that the configuration asks for.
HEAD = "# 概要\n\n"

LINT = [
    HEAD + 'あああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああ。',
    HEAD + '短い。いいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいい',
    HEAD + '[あああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああ](http://a.b)',
    HEAD + '「ああああああああああああああああああああああああああああああああああああああああああああああああああああああああああああ。いいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいいい」',
    HEAD + 'a, b, c, d, e, f',
    HEAD + '情報処理技術者',
    HEAD + '*情報処理技術者* **高等専門学校生**',
    HEAD + '𠮟𠮟𠮟𠮟',
    HEAD + 'すごい！ほんと?',
    HEAD + 'Yahoo! です!',
    HEAD + '[すごい!](u) *えっ!* **おお!**',
    '> あ\u200bい\n\n# 概要\n\n',
    HEAD + 'a\x01b\tc\x85',
    HEAD + 'がと゛。',
    HEAD + 'これはﾃｽﾄです。',
    HEAD + 'これはペンです',
    HEAD + 'これはペンです.',
    HEAD + 'これは`code`',
    '- これはペンです\n- それもペンです\n',
    HEAD + 'これは、あれで、それも、どれも、よい。',
    HEAD + '彼は彼は行く。',
    HEAD + '私が行くが、彼が来るが、それはよい。',
    HEAD + 'しかし、行く。しかし、来る。',
    HEAD + '見れる。食べれる。',
    HEAD + '行かないことはない。',
    HEAD + 'そうかもしれない。そう思う。可能性を示唆している。',
    HEAD + 'これはペンである。これは本です。これは机である。',
    HEAD + '- これは本です。\n- これは本である。\n- それは本である。',
    '# 題\n\n本文。',
    HEAD + '禁句とNG12。',
    HEAD + 'サーバとサーバー。',
    HEAD + '😀\r\n漢字! &amp;!',
    HEAD + '`a!b`c!',
    HEAD + '| a! | b |\n|---|---|\n| c | d? |',
    HEAD + '**ﾊ**ﾟ。',
]
#: (case, nth, rule, severity, message, line, column, end line, end column, start, end in UTF-16, fix from, to, text).
FOUND = [
    (0, 0, 'sentence-length', 'error', 'Line 3 sentence length(102) exceeds the maximum sentence length of 100.\nOver 2 characters.', 3, 1, 3, 103, 6, 108, None, None, None),
    (1, 0, 'sentence-length', 'error', 'Line 3 sentence length(101) exceeds the maximum sentence length of 100.\nOver 1 characters.', 3, 4, 3, 105, 9, 110, None, None, None),
    (1, 1, 'ja-no-mixed-period', 'error', '文末が"。"で終わっていません。', 3, 104, 3, 105, 109, 110, None, None, None),
    (3, 0, 'sentence-length', 'error', 'Line 3 sentence length(123) exceeds the maximum sentence length of 100.\nOver 23 characters.', 3, 1, 3, 124, 6, 129, None, None, None),
    (4, 0, 'max-comma', 'error', 'This sentence exceeds the maximum count of comma. Maximum is 3.', 3, 14, 3, 15, 19, 20, None, None, None),
    (5, 0, 'max-kanji-continuous-len', 'error', '漢字が7つ以上連続しています: 情報処理技術者', 3, 1, 3, 8, 6, 13, None, None, None),
    (5, 1, 'ja-no-mixed-period', 'error', '文末が"。"で終わっていません。', 3, 7, 3, 8, 12, 13, None, None, None),
    (6, 0, 'max-kanji-continuous-len', 'error', '漢字が7つ以上連続しています: 高等専門学校生', 3, 13, 3, 20, 18, 25, None, None, None),
    (7, 0, 'max-kanji-continuous-len', 'error', '漢字が7つ以上連続しています: 𠮟𠮟𠮟𠮟', 3, 1, 3, 9, 6, 14, None, None, None),
    (7, 1, 'ja-no-mixed-period', 'error', '文末が"。"で終わっていません。', 3, 7, 3, 9, 12, 14, None, None, None),
    (8, 0, 'no-exclamation-question-mark', 'error', 'Disallow to use "！".', 3, 4, 3, 5, 9, 10, None, None, None),
    (8, 1, 'no-exclamation-question-mark', 'error', 'Disallow to use "?".', 3, 8, 3, 9, 13, 14, None, None, None),
    (9, 0, 'no-exclamation-question-mark', 'error', 'Disallow to use "!".', 3, 10, 3, 11, 15, 16, None, None, None),
    (10, 0, 'no-exclamation-question-mark', 'error', 'Disallow to use "!".', 3, 21, 3, 22, 26, 27, None, None, None),
    (11, 0, 'no-zero-width-spaces', 'warning', 'Zero width space is disallowed.', 1, 4, 1, 5, 3, 4, 3, 4, ''),
    (12, 0, 'no-invalid-control-character', 'error', 'Found invalid control character(START OF HEADING \\u0001)', 3, 2, 3, 3, 7, 8, 7, 8, ''),
    (12, 1, 'no-invalid-control-character', 'error', 'Found invalid control character(CONTROL \\u0085)', 3, 6, 3, 7, 11, 12, 11, 12, ''),
    (13, 0, 'no-nfd', 'error', 'Disallow to use NFD(well-known as UTF8-MAC 濁点): "が" => "が"', 3, 2, 3, 3, 7, 8, 6, 8, 'が'),
    (13, 1, 'no-nfd', 'error', 'Disallow to use NFD(well-known as UTF8-MAC 濁点): "と゛" => "ど"', 3, 4, 3, 5, 9, 10, 8, 10, 'ど'),
    (14, 0, 'no-hankaku-kana', 'error', 'Disallow to use 半角カタカナ: "ﾃｽﾄ"', 3, 4, 3, 7, 9, 12, 9, 12, 'テスト'),
    (15, 0, 'ja-no-mixed-period', 'error', '文末が"。"で終わっていません。', 3, 7, 3, 8, 12, 13, None, None, None),
    (16, 0, 'ja-no-mixed-period', 'error', '文末が"。"で終わっていません。', 3, 8, 3, 9, 13, 14, 13, 14, '。'),
    (18, 0, 'required-headings', 'error', '必須の見出し "概要" がありません。', 1, 1, 1, 1, 0, 0, None, None, None),
    (18, 1, 'no-mix-dearu-desumasu', 'error', '箇条書き: "である"調 でなければなりません\n=> "である"調 であるべき箇所に、次の "ですます"調 の箇所があります: "です"\nTotal:\nである  : 0\nですます: 2\n', 1, 8, 1, 10, 7, 9, None, None, None),
    (18, 2, 'no-mix-dearu-desumasu', 'error', '箇条書き: "である"調 でなければなりません\n=> "である"調 であるべき箇所に、次の "ですます"調 の箇所があります: "です"\nTotal:\nである  : 0\nですます: 2\n', 2, 8, 2, 10, 17, 19, None, None, None),
    (19, 0, 'max-ten', 'error', '一つの文で"、"を4つ以上使用しています', 3, 16, 3, 17, 21, 22, None, None, None),
    (20, 0, 'no-doubled-joshi', 'error', '一文に二回以上利用されている助詞 "は" がみつかりました。\n\n次の助詞が連続しているため、文を読みにくくしています。\n\n- 彼"は"\n- 彼"は"\n\n同じ助詞を連続して利用しない、文の中で順番を入れ替える、文を分割するなどを検討してください。', 3, 4, 3, 5, 9, 10, None, None, None),
    (21, 0, 'no-doubled-conjunctive-particle-ga', 'error', '文中に逆接の接続助詞 "が" が二回以上使われています。', 3, 5, 3, 6, 10, 11, None, None, None),
    (22, 0, 'no-doubled-conjunction', 'error', '同じ接続詞（しかし）が連続して使われています。', 3, 8, 3, 11, 13, 16, None, None, None),
    (23, 0, 'no-dropping-the-ra', 'error', 'ら抜き言葉を使用しています。', 3, 1, 3, 4, 6, 9, None, None, None),
    (23, 1, 'no-dropping-the-ra', 'error', 'ら抜き言葉を使用しています。', 3, 7, 3, 9, 12, 14, None, None, None),
    (24, 0, 'no-double-negative-ja', 'error', '二重否定: 〜ないことはない', 3, 8, 3, 10, 13, 15, None, None, None),
    (25, 0, 'ja-no-weak-phrase', 'error', '弱い表現: "かもしれない" が使われています。', 3, 3, 3, 7, 8, 12, None, None, None),
    (25, 1, 'ja-no-weak-phrase', 'error', '弱い表現: "思う" が使われています。', 3, 12, 3, 14, 17, 19, None, None, None),
    (26, 0, 'no-mix-dearu-desumasu', 'error', '本文: "ですます"調 でなければなりません\n=> "ですます"調 であるべき箇所に、次の "である"調 の箇所があります: "である。"\nTotal:\nである  : 2\nですます: 1\n', 3, 6, 3, 7, 11, 12, None, None, None),
    (26, 1, 'no-mix-dearu-desumasu', 'error', '本文: "ですます"調 でなければなりません\n=> "ですます"調 であるべき箇所に、次の "である"調 の箇所があります: "である。"\nTotal:\nである  : 2\nですます: 1\n', 3, 21, 3, 22, 26, 27, None, None, None),
    (27, 0, 'no-mix-dearu-desumasu', 'error', '箇条書き: "である"調 でなければなりません\n=> "である"調 であるべき箇所に、次の "ですます"調 の箇所があります: "です。"\nTotal:\nである  : 2\nですます: 1\n', 3, 7, 3, 9, 12, 14, None, None, None),
    (28, 0, 'required-headings', 'error', '必須の見出し "概要" がありません。', 1, 1, 1, 1, 0, 0, None, None, None),
    (29, 0, 'forbidden', 'error', '禁止されている表現 "禁句" が使われています。', 3, 1, 3, 3, 6, 8, None, None, None),
    (29, 1, 'forbidden', 'error', '禁止されている表現 "NG12" が使われています。', 3, 4, 3, 8, 9, 13, None, None, None),
    (30, 0, 'terminology', 'error', '"サーバ" ではなく "サーバー" を使ってください。', 3, 1, 3, 4, 6, 9, 6, 9, 'サーバー'),
    (31, 0, 'no-exclamation-question-mark', 'error', 'Disallow to use "!".', 4, 3, 4, 4, 12, 13, None, None, None),
    (31, 1, 'no-exclamation-question-mark', 'error', 'Disallow to use "!".', 4, 10, 4, 11, 19, 20, None, None, None),
    (32, 0, 'no-exclamation-question-mark', 'error', 'Disallow to use "!".', 3, 7, 3, 8, 12, 13, None, None, None),
    (33, 0, 'no-exclamation-question-mark', 'error', 'Disallow to use "!".', 3, 4, 3, 5, 9, 10, None, None, None),
    (33, 1, 'no-exclamation-question-mark', 'error', 'Disallow to use "?".', 5, 8, 5, 9, 34, 35, None, None, None),
    (34, 0, 'no-hankaku-kana', 'error', 'Disallow to use 半角カタカナ: "ﾊﾟ"', 3, 3, 3, 7, 8, 12, None, None, None),
]
#: (case, source after fixes, fixes applied, findings left) of the cases that fixes change.
FIXED = [
    (11, '> あい\n\n# 概要\n\n', 1, 0),
    (12, '# 概要\n\nab\tc', 2, 0),
    (13, '# 概要\n\nがど。', 2, 0),
    (14, '# 概要\n\nこれはテストです。', 1, 0),
    (16, '# 概要\n\nこれはペンです。', 1, 0),
    (30, '# 概要\n\nサーバーとサーバー。', 1, 0),
]
MARKDOWN = [
    '# h\n\np *a* `x`\nq',
    '- i\n  - j\n\n> q',
    '| a | b |\n|---|---|\n| c | d |',
    '```\ncode\n```\n\nafter',
    '---\ntitle: x\n---\n\ntext ![alt](u) <b>x</b>',
    '<div>\nhtml\n</div>\n\nend',
    'Setext\n======\n\n1. one\n2. two\n\n   more',
    'a  \nb\\\nc &lt;d&gt; \\*e\\*',
    '[link *em*](http://x.y "t") <http://auto.link> ~~del~~',
    '- [x] done\n- [ ] open\n\n[^1]: note text\n\nsee[^1]',
    '> # quoted\n> text. More text!\n>\n> - item',
    '「あ。い」う。え。お',
]
#: (case, block, kind, in a quote, text, segments, sentences).
BLOCKS = [
    (0, 0, 'Heading', False, 'h', 1, 1),
    (0, 1, 'Paragraph', False, 'p a ー\nq', 6, 1),
    (1, 0, 'ListItem', False, 'i', 1, 1),
    (1, 1, 'ListItem', False, 'j', 1, 1),
    (1, 2, 'Paragraph', True, 'q', 1, 1),
    (2, 0, 'TableCell', False, 'a', 1, 1),
    (2, 1, 'TableCell', False, 'b', 1, 1),
    (2, 2, 'TableCell', False, 'c', 1, 1),
    (2, 3, 'TableCell', False, 'd', 1, 1),
    (3, 0, 'Paragraph', False, 'after', 1, 1),
    (4, 0, 'Paragraph', False, 'text  x', 3, 1),
    (5, 0, 'Paragraph', False, 'end', 1, 1),
    (6, 0, 'Heading', False, 'Setext', 1, 1),
    (6, 1, 'ListItem', False, 'one', 1, 1),
    (6, 2, 'ListItem', False, 'two', 1, 1),
    (6, 3, 'ListItem', False, 'more', 1, 1),
    (7, 0, 'Paragraph', False, 'a\nb\nc <d> *e*', 11, 1),
    (8, 0, 'Paragraph', False, 'link em http://auto.link del', 6, 1),
    (9, 0, 'ListItem', False, 'done', 1, 1),
    (9, 1, 'ListItem', False, 'open', 1, 1),
    (9, 2, 'Paragraph', False, 'note text', 1, 1),
    (9, 3, 'Paragraph', False, 'see', 1, 1),
    (10, 0, 'Heading', True, 'quoted', 1, 1),
    (10, 1, 'Paragraph', True, 'text. More text!', 1, 2),
    (10, 2, 'ListItem', True, 'item', 1, 1),
    (11, 0, 'Paragraph', False, '「あ。い」う。え。お', 1, 3),
]
SENTENCES = [
    'これはペンです。',
    '彼は行く。',
    '見れる。',
    '行かない。',
    'しかし、食べれる。',
    'This is ABC.',
    '漢字かもしれない。',
    'テストである。',
]
#: (case, nth, surface, start, part of speech, its detail, base form).
TOKENS = [
    (0, 0, 'これ', 0, '名詞', '代名詞', 'これ'),
    (0, 1, 'は', 2, '助詞', '係助詞', 'は'),
    (0, 2, 'ペン', 3, '名詞', '一般', '*'),
    (0, 3, 'です', 5, '助動詞', '*', 'です'),
    (0, 4, '。', 7, '記号', '句点', '。'),
    (1, 0, '彼', 0, '名詞', '代名詞', '彼'),
    (1, 1, 'は', 1, '助詞', '係助詞', 'は'),
    (1, 2, '行く', 2, '動詞', '自立', '行く'),
    (1, 3, '。', 4, '記号', '句点', '。'),
    (2, 0, '見れる', 0, '動詞', '自立', '見れる'),
    (2, 1, '。', 3, '記号', '句点', '。'),
    (3, 0, '行か', 0, '動詞', '自立', '行く'),
    (3, 1, 'ない', 2, '助動詞', '*', 'ない'),
    (3, 2, '。', 4, '記号', '句点', '。'),
    (4, 0, 'しかし', 0, '接続詞', '*', 'しかし'),
    (4, 1, '、', 3, '記号', '読点', '、'),
    (4, 2, '食べ', 4, '動詞', '自立', '食べる'),
    (4, 3, 'れる', 6, '動詞', '接尾', 'れる'),
    (4, 4, '。', 8, '記号', '句点', '。'),
    (5, 0, 'This', 0, '名詞', '一般', '*'),
    (5, 1, 'is', 5, '名詞', '一般', '*'),
    (5, 2, 'ABC', 8, '名詞', '一般', '*'),
    (5, 3, '.', 11, '名詞', 'サ変接続', '*'),
    (6, 0, '漢字', 0, '名詞', '一般', '*'),
    (6, 1, 'かも', 2, '助詞', '副助詞', 'かも'),
    (6, 2, 'しれ', 4, '動詞', '自立', 'しれる'),
    (6, 3, 'ない', 6, '助動詞', '*', 'ない'),
    (6, 4, '。', 8, '記号', '句点', '。'),
    (7, 0, 'テスト', 0, '名詞', '一般', '*'),
    (7, 1, 'で', 3, '助動詞', '*', 'だ'),
    (7, 2, 'ある', 4, '助動詞', '*', 'ある'),
    (7, 3, '。', 6, '記号', '句点', '。'),
]


def _with_cases(spark: SparkSession, sf_dir: str, cases: list[str]) -> DataFrame:
    """(path, case, source): each document's case, and behind it its own text in a fence."""
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text")
    case = F.pmod(F.col("doc_id"), F.lit(len(cases))).cast("int")
    fence = F.lit(FENCE)
    return d.select(F.col("doc_id").cast("string").alias("path"), case.alias("case"), F.concat(F.element_at(F.array(*map(F.lit, cases)), case + 1), F.lit("\n\n"), fence, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"), fence, F.lit("\n")).alias("source"))


def _linted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.lint(_with_cases(spark, sf_dir, LINT).select("path", "source"), Config.merged(CONFIG))


def case_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lint.findings(_with_cases(spark, sf_dir, LINT), Config.merged(CONFIG))
    long = lambda c: c.cast("long")
    return found.select(
        "path", long(F.col("nth")).alias("nth"), "rule", "severity", "message", *[long(F.col(c)).alias(c) for c in ("line", "column", "endLine", "endColumn")],
        long(F.col("range")[0]).alias("start"), long(F.col("range")[1]).alias("stop"), long(F.col("fix.range")[0]).alias("fix_start"), long(F.col("fix.range")[1]).alias("fix_stop"), F.col("fix.text").alias("fix_text"),
    )


def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule and severity."""
    return lint.findings(_with_cases(spark, sf_dir, LINT), Config.merged(CONFIG)).groupBy("rule", "severity").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_documents"))


def case_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.summary(_linted(spark, sf_dir))


def case_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lint.fix(_with_cases(spark, sf_dir, LINT).select("path", "source"), Config.merged(CONFIG))
    return out.select("path", F.sha2("fixed.source", 256).alias("fixed_sha256"), F.col("fixed.applied").cast("long").alias("applied"), F.size("fixed.diagnostics").cast("long").alias("n_left"))


def case_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sources of the documents that fixes change."""
    return report.rewritten(lint.fix(_with_cases(spark, sf_dir, LINT).select("path", "source"), Config.merged(CONFIG)))


def case_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = report.text_lines(_linted(spark, sf_dir))
    return lines.select("path", F.col("nth").cast("long").alias("nth"), "line")


def case_json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.file_json(_linted(spark, sf_dir))


def case_foreign_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.foreign_json(_linted(spark, sf_dir))


def case_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lint.blocks(_with_cases(spark, sf_dir, MARKDOWN))
    return b.select("path", F.col("block_idx").cast("long").alias("block_idx"), "kind", "in_blockquote", "text", F.size("segments").cast("long").alias("n_segments"), F.size("sentences").cast("long").alias("n_sentences"))


def case_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document's case sentence, with its own text's length beside them."""
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text")
    case = F.pmod(F.col("doc_id"), F.lit(len(SENTENCES))).cast("int")
    d = d.select(F.col("doc_id").cast("string").alias("path"), F.char_length("text").cast("long").alias("n_points"), F.element_at(F.array(*map(F.lit, SENTENCES)), case + 1).alias("text"))
    out = lint.tokens(d).select("path", "n_points", F.posexplode("tokens").alias("nth", "t"))
    return out.select("path", "n_points", F.col("nth").cast("long").alias("nth"), F.col("t.surface").alias("surface"), F.col("t.t_start").cast("long").alias("start"), F.col("t.pos").alias("pos"), F.col("t.pd1").alias("pd1"), F.col("t.base").alias("base"))


def _engine(rule: str) -> Callable[[SparkSession, str], DataFrame]:
    """One rule alone, the others turned off."""
    optional = ("forbidden", "terminology", "required-headings")
    rules = {r: False for r in RULE_IDS if r not in optional} | {rule: CONFIG["rules"].get(rule, True)}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = lint.findings(_with_cases(spark, sf_dir, LINT), Config.merged({"rules": rules}))
        long = lambda c: c.cast("long")
        return found.select("path", long(F.col("nth")).alias("nth"), "rule", "severity", "message", *[long(F.col(c)).alias(c) for c in ("line", "column")], long(F.col("range")[0]).alias("start"), long(F.col("range")[1]).alias("stop"), F.col("fix.text").alias("fix_text"))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (case_findings, case_summary, case_gate, case_fixes, case_rewritten, case_text_report, case_json_report, case_foreign_report, case_blocks, case_tokens)}
QUERIES |= {"engine_" + r.replace("-", "_"): _engine(r) for r in RULE_IDS}


def _value(x: object) -> str:
    if x is None:
        return "NULL"
    if not isinstance(x, str):
        return str(x).lower()
    return "||".join(f"'{p}'" if p.isprintable() else f"chr({ord(p)})" for p in _pieces(x.replace("'", "''"))) or "''"


def _pieces(x: str) -> list[str]:
    """x in runs of printable signs and single others."""
    out: list[str] = []
    for c in x:
        if out and c.isprintable() and out[-1].isprintable():
            out[-1] += c
        else:
            out.append(c)
    return out


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows) + ")"


_DOCS = f"d AS (SELECT CAST(doc_id AS VARCHAR) AS path, doc_id, chr(10) || chr(10) || '{FENCE}' || chr(10) || coalesce(text, '') || chr(10) || '{FENCE}' || chr(10) AS tail FROM documents)"
_FOUND = "WITH " + _values("v", "k, nth, rule, severity, message, line, \"column\", \"endLine\", \"endColumn\", start, stop, fix_start, fix_stop, fix_text", FOUND) + f", {_DOCS}, f AS (SELECT path, nth, rule, severity, message, line, \"column\", \"endLine\", \"endColumn\", start, stop, fix_start, fix_stop, fix_text FROM d JOIN v ON doc_id % {len(LINT)} = k)"
_FIXED = "WITH " + _values("c", "k, source", list(enumerate(LINT))) + ", " + _values("v", "k, source, applied, n_left", FIXED) + ", " + _values("w", "k, n", [(i, sum(r[0] == i for r in FOUND)) for i in range(len(LINT))]) + f", {_DOCS}"
_JSON_FIX = "CASE WHEN fix_text IS NULL THEN '' ELSE ',\"fix\":{\"range\":[' || fix_start || ',' || fix_stop || '],\"text\":' || to_json(fix_text) || '}' END"
_PLACES = "'\"line\":' || line || ',\"column\":' || \"column\""
_OWN = "'{\"rule\":\"' || rule || '\",\"severity\":\"' || severity || '\",\"message\":' || to_json(message) || ',' || " + _PLACES + " || ',\"endLine\":' || \"endLine\" || ',\"endColumn\":' || \"endColumn\" || ',\"range\":[' || start || ',' || stop || ']' || " + _JSON_FIX + " || '}'"
_OTHER = "'{\"type\":\"lint\",\"ruleId\":\"" + report.PREFIX + "' || rule || '\",\"message\":' || to_json(message) || ',\"index\":' || start || ',' || " + _PLACES + " || ',\"range\":[' || start || ',' || stop || '],\"loc\":{\"start\":{' || " + _PLACES + " || '},\"end\":{\"line\":' || \"endLine\" || ',\"column\":' || \"endColumn\" || '}},\"severity\":' || CASE WHEN severity = 'error' THEN 2 ELSE 1 END || " + _JSON_FIX + " || '}'"
_FILE = "SELECT d.path, '{\"%s\":\"' || d.path || '\",\"%s\":[' || coalesce(string_agg(%s, ',' ORDER BY nth), '') || ']}' AS json FROM d LEFT JOIN f ON d.path = f.path GROUP BY d.path"
SQL = {
    "case_findings": f"{_FOUND} SELECT * FROM f",
    "case_summary": f"{_FOUND} SELECT rule, severity, count(*) AS n, count(DISTINCT path) AS n_documents FROM f GROUP BY ALL",
    "case_gate": f"{_FOUND} SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, CAST(0 AS BIGINT) AS fixed FROM f",
    "case_fixes": f"{_FIXED} SELECT path, sha256(coalesce(v.source, c.source) || tail) AS fixed_sha256, coalesce(applied, 0) AS applied, coalesce(n_left, n) AS n_left FROM d JOIN c ON doc_id % {len(LINT)} = c.k JOIN w ON w.k = c.k LEFT JOIN v ON v.k = c.k",
    "case_rewritten": f"{_FIXED} SELECT path, v.source || tail AS source FROM d JOIN v ON doc_id % {len(LINT)} = k",
    "case_text_report": f"{_FOUND} SELECT path, nth, path || ':' || line || ':' || \"column\" || ': ' || split_part(message, chr(10), 1) || ' [' || rule || ']' AS line FROM f",
    "case_json_report": f"{_FOUND} {_FILE % ('path', 'diagnostics', _OWN)}",
    "case_foreign_report": f"{_FOUND} {_FILE % ('filePath', 'messages', _OTHER)}",
    "case_blocks": "WITH " + _values("v", "k, block_idx, kind, in_blockquote, text, n_segments, n_sentences", BLOCKS) + f", {_DOCS} SELECT path, block_idx, kind, in_blockquote, text, n_segments, n_sentences FROM d JOIN v ON doc_id % {len(MARKDOWN)} = k",
    "case_tokens": "WITH " + _values("v", "k, nth, surface, start, pos, pd1, base", TOKENS) + f" SELECT CAST(doc_id AS VARCHAR) AS path, length(text) AS n_points, nth, surface, start, pos, pd1, base FROM documents JOIN v ON doc_id % {len(SENTENCES)} = k",
}
SQL |= {
    "engine_" + r.replace("-", "_"): f"{_FOUND} SELECT path, row_number() OVER (PARTITION BY path ORDER BY nth) - 1 AS nth, rule, severity, message, line, \"column\", start, stop, fix_text FROM f WHERE rule = '{r}'"
    for r in RULE_IDS
}
