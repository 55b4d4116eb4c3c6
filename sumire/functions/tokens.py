"""Morphology: a pluggable backend, and a small built-in one.

The built-in analyser is a lattice over a hand-written closed-class lexicon with character-class guesses for unknown words.
It is a subset: particles, auxiliaries, conjunctions, symbols and common verbs and adjectives. Where a full analyser is
at hand, pass it as a backend; its features have the nine usual columns, missing ones read *.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple, Protocol


class Token(NamedTuple):
    surface: str
    start: int
    end: int
    pos: str = "*"
    pd1: str = "*"
    pd2: str = "*"
    pd3: str = "*"
    ctype: str = "*"
    cform: str = "*"
    base: str = "*"
    reading: str = "*"
    pron: str = "*"

    @property
    def is_joshi(self) -> bool:
        return self.pos.startswith("助詞")

    @property
    def blank(self) -> bool:
        return not self.surface.strip()


class Morphology(Protocol):
    def segment(self, text: str) -> list[Token]: ...


def tokenize(backend: Morphology, text: str) -> list[Token]:
    """The backend's tokens that lie in the text in order; a failure gives none."""
    try:
        found = backend.segment(text)
    except Exception:  # noqa: BLE001  any backend may be plugged in
        return []
    out, at = [], 0
    for t in found:
        if at <= t.start <= t.end <= len(text):
            out.append(t)
            at = t.end
    return out


KATAKANA = str.maketrans({chr(c): chr(c + 0x60) for c in range(0x3041, 0x3097)})
_LEXICON: dict[str, list[tuple[int, tuple[str, ...]]]] = {}


def _add(surface: str, cost: int, pos: str, pd1: str = "*", pd2: str = "*", ctype: str = "*", cform: str = "*", base: str = "", reading: str = "") -> None:
    _LEXICON.setdefault(surface, []).append((cost, (pos, pd1, pd2, "*", ctype, cform, base or surface, reading or surface.translate(KATAKANA), reading or surface.translate(KATAKANA))))


def _fill() -> None:
    for x in "は も こそ さえ しか".split():
        _add(x, 10, "助詞", "係助詞")
    for x in "が を に へ と から より で".split():
        _add(x, 10, "助詞", "格助詞", "一般")
    for x in "として について によって に対して において".split():
        _add(x, 12, "助詞", "格助詞", "連語")
    for x in "て ば ながら ので のに けど けれど けれども し つつ".split():
        _add(x, 14 if x != "し" else 40, "助詞", "接続助詞")
    _add("で", 16, "助詞", "接続助詞", base="で")
    _add("の", 10, "助詞", "連体化")
    for x in "や とか なり".split():
        _add(x, 14, "助詞", "並立助詞")
    for x in "まで だけ ばかり ほど くらい など かも か たり".split():
        _add(x, 14 if x != "か" else 16, "助詞", "副助詞" if x != "か" else "副助詞／並立助詞／終助詞")
    for x in "ね よ ぞ さ な わ".split():
        _add(x, 45, "助詞", "終助詞")
    for s, form in (("です", "基本形"), ("でし", "連用形"), ("でしょ", "未然形")):
        _add(s, 10, "助動詞", ctype="特殊・デス", cform=form, base="です")
    for s, form in (("ます", "基本形"), ("まし", "連用形"), ("ませ", "未然形"), ("ましょ", "未然ウ接続")):
        _add(s, 10, "助動詞", ctype="特殊・マス", cform=form, base="ます")
    for s, form, cost in (("だ", "基本形", 14), ("で", "連用形", 13), ("だっ", "連用タ接続", 14), ("な", "体言接続", 14), ("なら", "仮定形", 14)):
        _add(s, cost, "助動詞", ctype="特殊・ダ", cform=form, base="だ")
    for s, form in (("ある", "基本形"), ("あっ", "連用タ接続"), ("あろ", "未然ウ接続")):
        _add(s, 11, "助動詞", ctype="五段・ラ行アル", cform=form, base="ある")
        _add(s, 14, "動詞", "自立", ctype="五段・ラ行", cform=form, base="ある")
    _add("あり", 14, "動詞", "自立", ctype="五段・ラ行", cform="連用形", base="ある")
    for s, base in (("た", "た"), ("だ", "だ")):
        _add(s, 12 if s == "た" else 18, "助動詞", ctype="特殊・タ", cform="基本形", base=base)
    for s, form in (("ない", "基本形"), ("なく", "連用テ接続"), ("なかっ", "連用タ接続"), ("なけれ", "仮定形"), ("無い", "基本形"), ("無く", "連用テ接続")):
        _add(s, 12, "助動詞", ctype="特殊・ナイ", cform=form, base="無い" if s[0] == "無" else "ない")
        _add(s, 15, "形容詞", "自立", ctype="形容詞・アウオ段", cform=form, base="無い" if s[0] == "無" else "ない")
    _add("ん", 30, "助動詞", ctype="不変化型", cform="基本形")
    _add("う", 30, "助動詞", ctype="不変化型", cform="基本形")
    for s, form in (("れる", "基本形"), ("れ", "連用形"), ("られる", "基本形"), ("られ", "連用形")):
        _add(s, 20, "動詞", "接尾", ctype="一段", cform=form, base="れる" if s[:1] == "れ" else "られる")
    for x in "しかし また そして さらに したがって ただし なお つまり でも だから それから しかも すなわち ところが けれども および 及び あるいは または".split():
        _add(x, 18, "接続詞")
    for x in "たぶん とても もっと そう すぐ 必ず まず".split():
        _add(x, 18, "副詞", "一般")
    _add("どう", 18, "副詞", "助詞類接続")
    for x in "この その あの どの".split():
        _add(x, 14, "連体詞")
    for x in "これ それ あれ どれ ここ そこ 私 彼".split():
        _add(x, 14, "名詞", "代名詞", "一般")
    for x in "こと もの わけ ため よう とき ところ はず".split():
        _add(x, 14, "名詞", "非自立", "一般")
    for x in "可能 性 示唆 たび 箇条書き すべて".split():
        _add(x, 14, "名詞", "接尾" if x == "性" else "一般", reading={"性": "セイ", "可能": "カノウ", "示唆": "シサ"}.get(x, ""))
    _add("し", 12, "動詞", "自立", ctype="サ変・スル", cform="連用形", base="する")
    for s, form in (("する", "基本形"), ("さ", "未然レル接続"), ("すれ", "仮定形"), ("せ", "未然ヌ接続")):
        _add(s, 14, "動詞", "自立", ctype="サ変・スル", cform=form, base="する")
    for s, form in (("いる", "基本形"), ("い", "連用形"), ("いれ", "仮定形")):
        _add(s, 15, "動詞", "非自立", ctype="一段", cform=form, base="いる")
    for s, form in (("おり", "連用形"), ("おる", "基本形")):
        _add(s, 15, "動詞", "非自立", ctype="五段・ラ行", cform=form, base="おる")
    for s, form in (("くる", "基本形"), ("来", "連用形"), ("来る", "基本形"), ("き", "連用形"), ("こ", "未然形")):
        _add(s, 24, "動詞", "自立", ctype="カ変・来ル", cform=form, base="来る")
    for s, form in (("しれる", "基本形"), ("しれ", "未然形")):
        _add(s, 13, "動詞", "自立", ctype="一段", cform=form, base="しれる")
    for x in "来れる 見れる".split():
        for s, form in ((x, "基本形"), (x[:-1], "連用形")):
            _add(s, 12, "動詞", "自立", ctype="一段", cform=form, base=x)
    for x in "食べ 使え 考え 見 出 寝 着 起き 始め 続け 変え 加え 決め 確かめ 入れ 含め 求め 与え 避け 認め 言い切れ いい切れ 言いきれ いいきれ でき 分け 見せ 起こせ".split():
        for s, form in ((x, "未然形"), (x, "連用形"), (x + "る", "基本形"), (x + "れ", "仮定形")):
            _add(s, 15, "動詞", "自立", ctype="一段", cform=form, base=x + "る")
    rows = {"く": "かきくけこい", "ぐ": "がぎぐげごい", "す": "さしすせそし", "つ": "たちつてとっ", "ぶ": "ばびぶべぼん", "む": "まみむめもん", "る": "らりるれろっ", "う": "わいうえおっ"}
    for x in "行く 書く 聞く 置く 動く 働く 探す 示す 話す 試す 直す 持つ 待つ 読む 進む 学ぶ 選ぶ 入る 終わる 限る かぎる 作る なる 送る 取る やる やる 分かる わかる 思う おもう 使う 行う 違う 買う 言う いう".split():
        stem, row = x[:-1], rows[x[-1]]
        past = "っ" if x == "行く" else row[5]
        for end, form in ((row[0], "未然形"), (row[1], "連用形"), (row[2], "基本形"), (row[3], "仮定形"), (row[4], "未然ウ接続"), (past, "連用タ接続")):
            _add(stem + end, 15, "動詞", "自立", ctype="五段", cform=form, base=x)
    for x in "高 低 少な 多 難し 易し 安 遅 速 早 悪 良 よ 長 短 新し 古 大き 小さ 強 弱 すご やす".split():
        for end, form in (("い", "基本形"), ("く", "連用テ接続"), ("かっ", "連用タ接続"), ("けれ", "仮定形")):
            _add(x + end, 15, "形容詞", "自立" if x != "やす" else "非自立", ctype="形容詞", cform=form, base=x + "い")
    for x in "調 的 化 者 上 中 下 内 外 前 後 時 用 側 等".split():
        _add(x, 18, "名詞", "接尾", "一般")
    for x in "。":
        _add(x, 5, "記号", "句点")
    for x in "、":
        _add(x, 5, "記号", "読点")
    for x in "「『（【《〈“":
        _add(x, 5, "記号", "括弧開")
    for x in "」』）】》〉”":
        _add(x, 5, "記号", "括弧閉")
    for x in "！？・…．，":
        _add(x, 5, "記号", "一般")


_fill()


def surfaces(pos: str) -> list[str]:
    """The lexicon's words of a class, longest first."""
    return sorted((x for x, ways in _LEXICON.items() if any(f[0] == pos for _, f in ways)), key=lambda x: (-len(x), x))


_LONGEST = max(map(len, _LEXICON))
RUN = re.compile(r"[㐀-鿿豈-﫿々〇〻\U00020000-\U0002ffff]+|[ァ-ヺー]+|[ｦ-ﾟ]+|[A-Za-z][A-Za-z0-9_-]*|[0-9０-９]+|[^\s\w]+|\w")
#: A word between blanks: a plain one, perhaps with a mark behind it, or any other; and one that isn't a plain one alone.
WORD, NOUN = re.compile(r"(?<!\S)([A-Za-z][A-Za-z0-9_-]*)([.,!?:;]?)(?!\S)|\S+"), ("名詞", "一般", *"*******")
ODD = re.compile(r"(?<!\S)(?![A-Za-z][A-Za-z0-9_-]*(?!\S))\S+")
SPLIT_KANJI = re.compile(r"[㐀-鿿豈-﫿々]")
#: In a word without these there is one way: nothing of the lexicon begins in it, and no run can be cut.
LATTICE = re.compile("[㐀-鿿豈-﫿々" + "".join(re.escape(x) for x in sorted({x[0] for x in _LEXICON})) + "]")
AFTER_END = {"が": "接続助詞", "から": "接続助詞", "と": "接続助詞"}


#: Letters of a run without blanks whose tokens are remembered, and how far from the ends long kanji runs are cut.
SHORT, NEAR = 24, 8


class Builtin:
    """Least-cost path; costs rest on word classes and on a few neighbours that can't be."""

    def segment(self, text: str, start: int = 0, end: int | None = None) -> list[Token]:
        """Tokens of text, or of a part of it that begins and ends at blanks or the text's ends: what lies between blanks is judged by itself."""
        out: list[Token] = []
        add, make = out.append, tuple.__new__
        for m in WORD.finditer(text, start, len(text) if end is None else end):
            at, plain = m.start(), m[1]
            if plain is None:
                word = m[0]
            else:  # nothing in the lexicon begins with such a letter
                end = m.end(1)
                add(make(Token, (plain, at, end, *NOUN)))
                if not (word := m[2]):
                    continue
                at = end
            out += [make(Token, (t[0], t[1] + at, t[2] + at, *t[3:])) for t in word_tokens(word)]
        return out

    def count(self, text: str) -> int:
        """How many tokens segment gives, without making them: a plain word is one."""
        odd = ODD.findall(text)
        return len(text.split()) - len(odd) + sum(map(_count, odd))


def word_tokens(word: str) -> list[Token]:
    """Tokens of a run without blanks, by their places in it; not to be changed."""
    return _short(word) if len(word) <= SHORT else _path(word)


def _count(word: str) -> int:
    return len(word_tokens(word)) if LATTICE.search(word) else len(RUN.findall(word))


def _join(a: tuple[str, ...] | None, b: tuple[str, ...]) -> int:
    """Cost of b behind a."""
    if a is None:
        return 25 if b[0] in ("助詞", "助動詞") or b[1] == "接尾" else 0
    verb_like = a[0] in ("動詞", "形容詞", "助動詞")
    cost = 0
    if b[0] == "助動詞":
        if b[4] == "特殊・マス":
            cost += 0 if a[0] in ("動詞",) and a[5] in ("連用形",) else 40
        elif b[4] == "特殊・タ":
            ok = a[5] in ("連用タ接続", "連用形") and a[4] not in ("特殊・ダ",)
            cost += (0 if ok else 40) + (30 if b[6] == "だ" and not a[4].startswith("五段") else 0)
        elif b[4] == "特殊・ナイ":
            cost += 0 if a[0] == "動詞" and a[5] in ("未然形", "未然ヌ接続") or a[4] == "特殊・マス" else 12
        elif b[4] == "特殊・ダ":
            cost += 0 if a[0] in ("名詞", "副詞") or a[1] == "副助詞" else 14 if a[4] == "特殊・ナイ" or a[0] == "形容詞" else 25
        elif b[4] == "五段・ラ行アル":
            cost += 0 if a[4] == "特殊・ダ" and a[5] == "連用形" else 40
        elif b[4] == "特殊・デス":
            cost += 0 if a[0] in ("名詞", "形容詞", "助動詞", "副詞", "助詞") else 15
        else:
            cost += 0 if a[5] == "未然ウ接続" or a[4] == "特殊・マス" else 40
    elif b[0] == "助詞":
        if b[1] == "接続助詞" and b[6] == "て":
            cost += 0 if a[5] in ("連用形", "連用タ接続", "連用テ接続") else 30
        elif b[1] == "接続助詞" and b[6] == "で":
            cost += 0 if a[5] == "連用タ接続" else 40
        elif b[1] == "格助詞" and verb_like and b[6] == "で":
            cost += 20
    elif b[1] == "接尾" and b[0] == "動詞":
        cost += 0 if a[0] == "動詞" and a[5].startswith("未然") else 60
    elif b[1] == "接尾":
        cost += 0 if a[0] == "名詞" else 30
    elif b[1] == "非自立" and b[0] == "動詞":
        cost += 0 if a[1] == "接続助詞" else 25
    elif b[4] == "サ変・スル":
        cost += 0 if a[0] == "名詞" or a[0] == "助詞" else 20
    elif b[6] in ("ない", "無い") and b[0] == "形容詞":
        cost += -5 if a[0] in ("助詞", "名詞") or a[5] in ("連用テ接続",) else 10
    if a[0] == "動詞" and a[5] == "未然形" and not (b[4] == "特殊・ナイ" or b[1] == "接尾"):
        cost += 40
    if a[0] == "動詞" and a[5] == "連用形" and b[0] in ("名詞",):
        cost += 10
    if a[5] == "連用タ接続" and b[4] not in ("特殊・タ",) and b[6] not in ("て", "で", "たり"):
        cost += 40
    if a[1] == "接尾" and a[0] == "動詞" and a[5] == "連用形" and b[0] == "名詞":
        cost += 20
    return cost


@lru_cache(maxsize=20_000)
def _short(text: str) -> list[Token]:
    return _path(text)


def _guess(head: str, run: str) -> tuple[str, str]:
    """Word class of a run that isn't in the lexicon."""
    if re.match(r"\w", head):
        return "名詞", "一般"
    return ("記号", "括弧開") if run == "(" else ("記号", "括弧閉") if run == ")" else ("名詞", "サ変接続")


def _path(text: str) -> list[Token]:
    n = len(text)
    if not LATTICE.search(text):
        return [Token(m[0], m.start(), m.end(), *_guess(m[0][0], m[0]), *"*******") for m in RUN.finditer(text)]
    # at each place the cheapest way to each kind of token: (cost, number, from, features there, own features)
    best: list[dict[tuple[str, ...] | None, tuple]] = [{} for _ in range(n + 1)]
    best[0][None] = (0, 0, -1, None, None)
    number = 0
    for i in range(n):
        if not best[i]:
            continue
        edges = [(size, cost, f) for size in range(1, min(_LONGEST, n - i) + 1) for cost, f in _LEXICON.get(text[i : i + size], ())]
        m = RUN.match(text, i)
        length, head = (m.end() - i, text[i]) if m else (1, text[i])
        kanji = bool(SPLIT_KANJI.match(head))
        kind = _guess(head, text[i : i + length])
        if not kanji:
            sizes = [length]
        elif length <= 2 * NEAR:
            sizes = range(1, length + 1)
        else:  # longer runs are cut near their ends only
            sizes = [*range(1, NEAR + 1), *range(length - NEAR, length + 1)]
        guess = (*kind, "*", "*", "*", "*", "*", "*", "*")
        for size in sizes:
            edges.append((size, 60 if "ぁ" <= head <= "ゖ" else 22 + (abs(size - 2) * 3 if kanji else 0), guess))
        ways = list(best[i].values())
        for size, cost, f in edges:
            c, _, g = min((c + cost + _join(g, f), k, g) for c, k, _, _, g in ways) if len(ways) > 1 else (ways[0][0] + cost + _join(ways[0][4], f), 0, ways[0][4])
            number += 1
            old = best[i + size].get(f)
            if old is None or c < old[0]:
                best[i + size][f] = (c, number, i, g, f)
    out: list[Token] = []
    at, f = n, min(best[n].values(), key=lambda w: w[:2])[4] if best[n] else None
    while at > 0 and f is not None:
        _, _, before, g, _ = best[at][f]
        out.append(Token(text[before:at], before, at, *f))
        at, f = before, g
    out.reverse()
    for x in range(1, len(out)):
        t = out[x]
        if t.pd1 == "格助詞" and t.surface in AFTER_END and out[x - 1].pos in ("動詞", "形容詞", "助動詞") and out[x - 1].cform == "基本形":
            out[x] = t._replace(pd1="接続助詞", pd2="*")
    return out
