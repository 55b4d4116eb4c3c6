"""The twenty rules, over a parsed document. Offsets are code points of block text until the last step."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import pairwise
from operator import itemgetter

from sumire.functions.markdown import WHITE, Block, Document, utf16
from sumire.functions.sentences import split
from sumire.functions.signs import python_set
from sumire.functions.tokens import ODD, Builtin, Morphology, Token, surfaces, tokenize, word_tokens
from sumire.plans.config import RULE_IDS, Config, matcher

KANJI = python_set("kanji")
KANJI_RUN, JAPANESE = re.compile(f"[{KANJI}]+"), re.compile(f"[{KANJI}ぁ-んァ-ヶ]")
CONTROL, EXCLAIM, ZERO_WIDTH = (re.compile(f"[{python_set(x)}]") for x in ("control", "exclamation", "zero-width"))
COMBINING, HALF_WIDTH = re.compile(f"[{python_set('combining')}]"), re.compile(f"[{python_set('half-width')}]+")
NAMES = "NULL,START OF HEADING,START OF TEXT,END OF TEXT,END OF TRANSMISSION,ENQUIRY,ACKNOWLEDGE,BELL,BACKSPACE,CHARACTER TABULATION,LINE FEED,LINE TABULATION,FORM FEED,CARRIAGE RETURN,SHIFT OUT,SHIFT IN,DATA LINK ESCAPE,DEVICE CONTROL ONE,DEVICE CONTROL TWO,DEVICE CONTROL THREE,DEVICE CONTROL FOUR,NEGATIVE ACKNOWLEDGE,SYNCHRONOUS IDLE,END OF TRANSMISSION BLOCK,CANCEL,END OF MEDIUM,SUBSTITUTE,ESCAPE,INFORMATION SEPARATOR FOUR,INFORMATION SEPARATOR THREE,INFORMATION SEPARATOR TWO,INFORMATION SEPARATOR ONE".split(",")
CONTROL_NAMES = dict(enumerate(NAMES)) | {0x7F: "DELETE"}
SEPARATORS, COMMAS = (".", "．", "。", "?", "!", "？", "！"), ("、", "，")
PROSE, PARAGRAPH, ALL = ("Paragraph", "ListItem"), ("Paragraph",), ("Paragraph", "Heading", "ListItem", "TableCell")
#: Kinds of block that a rule sees, and whether quoted ones too.
SCOPES = {r: (ALL, False) for r in RULE_IDS} | {r: (PROSE, False) for r in ("sentence-length", "max-comma", "max-ten", "no-doubled-joshi", "no-doubled-conjunctive-particle-ga", "no-doubled-conjunction")}
SCOPES |= {r: (ALL, True) for r in ("no-zero-width-spaces", "no-invalid-control-character", "no-double-negative-ja", "ja-no-weak-phrase")}
SCOPES |= {"ja-no-mixed-period": (PARAGRAPH, False), "no-mix-dearu-desumasu": (("Paragraph", "Heading", "ListItem"), False)}

#: Rules that the built-in analyser's tokens can't meet in a text without kana or kanji.
JAPANESE_ONLY = frozenset(("no-doubled-joshi", "no-doubled-conjunctive-particle-ga", "no-doubled-conjunction", "no-dropping-the-ra", "no-double-negative-ja", "ja-no-weak-phrase"))
HIRAGANA = re.compile("[ぁ-ゖ]")
#: The built-in analyser's が is a conjunctive particle only behind another token of its word; its conjunctions are these.
INNER_GA, CONJUNCTION, CONJUNCTIONS = re.compile(r"(?<=\S)が"), re.compile("|".join(surfaces("接続詞"))), re.compile("(?=" + "|".join(surfaces("接続詞")) + ")")
WORDY = re.compile(f"[{KANJI}ぁ-ゖァ-ヺ]")

#: Rules that can offer a fix; every rule.
FIXING, EVERY = frozenset(("no-zero-width-spaces", "no-invalid-control-character", "no-nfd", "no-hankaku-kana", "ja-no-mixed-period", "terminology")), frozenset(RULE_IDS)
WIDE = re.compile("[\U00010000-\U0010ffff]")

Report = tuple  # (start, end, message, fix as (start, end, text) or None)
Found = tuple  # (rule, severity, message, line, column, endLine, endColumn, start, end, fix as (start, end, text) or None)
PLACE = itemgetter(3, 4, 0)


class View:
    """A block with its tokens and sentences, made when a rule first asks."""

    def __init__(self, block: Block, backend: Morphology, memo: dict[str, list[Token]]):
        self.block, self.text, self._backend, self._memo = block, block.text, backend, memo
        self._sentences: list[tuple[int, int]] | None = None
        self._starts: list[int] | None = None
        self._parts: dict[tuple[int, int], list[Token]] = {}

    @property
    def builtin(self) -> bool:
        return type(self._backend) is Builtin

    @property
    def sentences(self) -> list[tuple[int, int]]:
        if self._sentences is None:
            self._sentences = split(self.text)
        return self._sentences

    @property
    def tokens(self) -> list[Token]:
        if (found := self._memo.get(self.text)) is None:
            found = self._memo[self.text] = tokenize(self._backend, self.text)
        return found

    def alone(self, sentence: tuple[int, int]) -> bool:
        """Whether the sentence lies between blanks."""
        a, b = sentence
        return (a == 0 or self.text[a - 1].isspace()) and (b == len(self.text) or self.text[b].isspace())

    def of(self, sentence: tuple[int, int]) -> list[Token]:
        """Tokens that start in the sentence. The built-in analyser looks at the sentence alone where it lies between blanks."""
        a, b = sentence
        if self._starts is None and self.builtin and self.alone(sentence):
            if (found := self._parts.get(sentence)) is None:
                found = self._parts[sentence] = self._backend.segment(self.text, a, b)
            return found
        if self._starts is None:
            self._starts = [t.start for t in self.tokens]
        return self.tokens[bisect_left(self._starts, sentence[0]) : bisect_left(self._starts, sentence[1])]


class Memo(dict):
    """Tokens by text; emptied when the texts have more than LETTERS in all."""

    LETTERS = 1_000_000

    def __init__(self):
        super().__init__()
        self.letters = 0

    def __setitem__(self, text: str, tokens: list[Token]) -> None:
        if self.letters > self.LETTERS:
            self.clear()
            self.letters = 0
        self.letters += len(text)
        super().__setitem__(text, tokens)


def sentence_length(v: View, c: Config, doc: Document) -> list[Report]:
    name, b = "sentence-length", v.block
    if all(s.in_link or s.kind == "break" for s in b.segments):
        return []
    most, skip, size = c.number(name, "max", 100), c.flag(name, "skipUrlStringLink", True), utf16 if c.text(name, "countBy", "codeunits") == "codeunits" else len
    patterns, out = [m for p in c.strings(name, "skipPatterns") if (m := matcher(p))], []
    skip = skip and any(s.url_link for s in b.segments)
    for s, e in v.sentences:
        if 2 * (e - s) <= most and not patterns:  # a sign has two units at most
            continue
        text = b.slice_where(s, e, lambda x: not x.url_link) if skip else v.text[s:e]
        for p in patterns:
            text = p.sub("", text)
        if (n := size(text)) > most:
            line = _line(doc, b.source_start(s))
            out.append((s, e, f"Line {line} sentence length({n}) exceeds the maximum sentence length of {most}.\nOver {n - most} characters.", None))
    return out


def max_comma(v: View, c: Config, doc: Document) -> list[Report]:
    most, out = c.number("max-comma", "max", 4), []
    for s, e in v.sentences if v.text.count(",") > most else ():
        if v.text.count(",", s, e) > most:
            at = v.text.rindex(",", s, e)
            out.append((at, at + 1, f"This sentence exceeds the maximum count of comma. Maximum is {most}.", None))
    return out


def kanji_runs(v: View, c: Config, doc: Document) -> list[Report]:
    name = "max-kanji-continuous-len"
    most, allow = c.number(name, "max", 5), c.strings(name, "allow")
    return [(m.start(), m.end(), f"漢字が{most + 1}つ以上連続しています: {m[0]}", None) for m in KANJI_RUN.finditer(v.text) if utf16(m[0]) > most and m[0] not in allow and not v.block.excluded(m.start())]


def exclamations(v: View, c: Config, doc: Document) -> list[Report]:
    name = "no-exclamation-question-mark"
    flags = {"!": "allowHalfWidthExclamation", "！": "allowFullWidthExclamation", "?": "allowHalfWidthQuestion", "？": "allowFullWidthQuestion"}
    allow, out = (*c.strings(name, "allow"), "Yahoo!"), []
    messages = {x: f'Disallow to use "{x}".' for x, key in flags.items() if not c.flag(name, key, False)}
    excluded = v.block.excluded if v.block.excludes else None
    for m in EXCLAIM.finditer(v.text):
        at = m.start()
        if (message := messages.get(m[0])) and not (excluded and excluded(at)) and not v.text.endswith(allow, 0, at + 1):
            out.append((at, at + 1, message, None))
    return out


def zero_width(v: View, c: Config, doc: Document) -> list[Report]:
    return [(m.start(), m.end(), "Zero width space is disallowed.", (m.start(), m.end(), "")) for m in ZERO_WIDTH.finditer(v.text)]


def controls(v: View, c: Config, doc: Document) -> list[Report]:
    return [(m.start(), m.end(), f"Found invalid control character({CONTROL_NAMES.get(ord(m[0]), 'CONTROL')} \\u{ord(m[0]):04X})", (m.start(), m.end(), "")) for m in CONTROL.finditer(v.text)]


def decomposed(v: View, c: Config, doc: Document) -> list[Report]:
    out = []
    for m in COMBINING.finditer(v.text, 1):
        at = m.start()
        pair, whole = v.text[at - 1 : at + 1], unicodedata.normalize("NFC", v.text[at - 1] + {"゛": "゙", "゜": "゚"}.get(m[0], m[0]))
        out.append((at, at + 1, f'Disallow to use NFD(well-known as UTF8-MAC 濁点): "{pair}" => "{whole}"', (at - 1, at + 1, whole)))
    return out


@lru_cache(maxsize=10_000)
def _widened(text: str) -> tuple[str, str]:
    return f'Disallow to use 半角カタカナ: "{text}"', unicodedata.normalize("NFKC", text)


def half_width(v: View, c: Config, doc: Document) -> list[Report]:
    out = []
    for m in HALF_WIDTH.finditer(v.text):
        if not (v.block.excludes and v.block.excluded(m.start())):
            (a, b), (message, wide) = m.span(), _widened(m[0])
            out.append((a, b, message, (a, b, wide)))
    return out


def mixed_period(v: View, c: Config, doc: Document) -> list[Report]:
    name, b = "ja-no-mixed-period", v.block
    mark, i = c.text(name, "periodMark", "。"), b.last_content()
    if i is None:
        return []
    s = b.segments[i]
    if s.kind != "text" or s.in_link or s.in_emphasis or s.in_strong or not JAPANESE.search(b.last_text_node()):
        return []
    end = len(v.text.rstrip(WHITE))
    last = v.text[end - 1]
    if last in "!?！？)）」』" or last == mark or last in c.strings(name, "allowPeriodMarks"):
        return []
    return [(end - 1, end, f'文末が"{mark}"で終わっていません。', (end - 1, end, mark) if last in ".．" else None)]


def _bracket(pos: str, pd1: str) -> bool:
    return pos == "記号" and pd1 in ("括弧開", "括弧閉")


def max_ten(v: View, c: Config, doc: Document) -> list[Report]:
    name, out = "max-ten", []
    most, strict, touten, kuten = c.number(name, "max", 3), c.flag(name, "strict", False), c.text(name, "touten", "、"), c.text(name, "kuten", "。")
    for s in v.sentences if v.text.count(touten) > most else ():
        if v.text.count(touten, *s) <= most:
            continue
        tokens = v.of(s)
        plain = [not (_bracket(t.pos, t.pd1) or t.surface in "()") for t in tokens]
        count, last = 0, None
        for i, t in enumerate(tokens):
            if t.surface == touten:
                before = next((tokens[k] for k in range(i - 1, -1, -1) if plain[k]), None)
                after = next((tokens[k] for k in range(i + 1, len(tokens)) if plain[k]), None)
                if not strict and before and after and before.pos == after.pos == "名詞":
                    continue
                count, last = count + 1, t
            if t.surface in SEPARATORS or t.surface == kuten:
                count = 0
            if count > most:
                out.append((last.start, last.end, f'一つの文で"{touten}"を{most + 1}つ以上使用しています', None))
                count = 0
    return out


def _merged(tokens: list[Token]) -> list[tuple[Token, str | None]]:
    """Tokens with runs of particles as one, each with the surface before it."""
    out: list[Token] = []
    for t in tokens:
        if t.blank:
            continue
        if out and t.is_joshi and out[-1].is_joshi:
            p = out[-1]
            out[-1] = p._replace(surface=p.surface + t.surface, end=t.end, pos=p.pos + t.pos, pd1=p.pd1 + t.surface)
        else:
            out.append(t)
    return [(t, out[i - 1].surface if i else None) for i, t in enumerate(out)]


def _repeating(v: View) -> list[tuple[int, int]]:
    """Sentences in which a hiragana comes twice."""
    at = [m.start() for m in HIRAGANA.finditer(v.text)]
    out, j = [], 0
    for s in v.sentences if len(at) > 1 else ():
        i = bisect_left(at, s[0], j)
        j = bisect_left(at, s[1], i)
        if j - i > 1 and len({v.text[k] for k in at[i:j]}) < j - i:
            out.append(s)
    return out


def _counted(text: str, sentence: tuple[int, int], counts) -> list[tuple[Token, str | None]]:
    """What counts of _merged's tokens, for the built-in analyser and a sentence between blanks, in which plain words never count: these aren't made."""
    out: list[tuple[Token, str | None]] = []
    before, particle, stop = None, False, sentence[0]  # the token before, whether it is a particle (then it is out's last), where its word ends
    for m in ODD.finditer(text, *sentence):
        at = m.start()
        if at > stop and (plain := text[stop:at].split()):
            before, particle = plain[-1], False
        for t in word_tokens(m[0]):
            if particle and t.is_joshi:
                p = out[-1][0]
                p = p._replace(surface=p.surface + t.surface, end=at + t.end, pos=p.pos + t.pos, pd1=p.pd1 + t.surface)
                out[-1], before = (p, out[-1][1]), p.surface
                continue
            particle = t.is_joshi
            if counts(t):
                out.append((t._replace(start=at + t.start, end=at + t.end), before))
            before = t.surface
        stop = m.end()
    return out


def doubled_joshi(v: View, c: Config, doc: Document) -> list[Report]:
    name, out = "no-doubled-joshi", []
    gap, strict, allow = max(1, c.number(name, "min_interval", 1)), c.flag(name, "strict", False), c.strings(name, "allow")
    separators, commas = c.strings(name, "separatorCharacters", SEPARATORS), c.strings(name, "commaCharacters", COMMAS)
    lean = v.builtin and not any(x[:1].isascii() and x[:1].isalpha() for x in (*separators, *commas))
    counts = lambda t: t.is_joshi or not strict and (_bracket(t.pos, t.pd1) or t.surface in separators or t.surface in commas and t.pos in ("名詞", "記号"))
    for s in _repeating(v) if v.builtin else v.sentences:  # the built-in analyser's particles are hiragana, and the same one must come twice
        if lean and v.alone(s):
            counted = _counted(v.text, s, counts)
        else:
            tokens = v.of(s)
            if sum(t.pos[:2] == "助詞" for t in tokens) < 2:
                continue
            counted = [(t, p) for t, p in _merged(tokens) if counts(t)]
        groups: dict[tuple[str, ...], list[int]] = {}
        for i, (t, _) in enumerate(counted):
            if t.is_joshi:
                groups.setdefault((t.surface, t.pos, t.pd1, t.pd2, t.pd3), []).append(i)
        for key in sorted(groups, key=lambda k: tuple(x.encode() for x in k)):
            at = groups[key]
            surface, _, pd1, _, _ = key
            if len(at) < 2 or surface in allow:
                continue
            if not strict:
                if pd1 == "連体化" or surface == "を" and pd1 == "格助詞" or surface == "て" and pd1 == "接続助詞":
                    continue
                if len(at) == 2 and (pd1 == "並立助詞" or surface == "か" and counted[at[1]][1] == "どう"):
                    continue
            for a, b in pairwise(at):
                if b - a <= gap:
                    word = [(f'{p}"{t.surface}"' if p is not None else f'"{t.surface}"') for t, p in (counted[a], counted[b])]
                    t = counted[b][0]
                    out.append((t.start, t.end, f'一文に二回以上利用されている助詞 "{surface}" がみつかりました。\n\n次の助詞が連続しているため、文を読みにくくしています。\n\n- {word[0]}\n- {word[1]}\n\n' + "同じ助詞を連続して利用しない、" + "文の中で順番を入れ替える、" + "文を分割するなどを検討してください。", None))
    return out


def doubled_ga(v: View, c: Config, doc: Document) -> list[Report]:
    out = []
    for s in v.sentences if v.text.count("が") > 1 and not (v.builtin and len(INNER_GA.findall(v.text)) < 2) else ():
        if v.text.count("が", *s) < 2:
            continue
        groups: list[list[Token]] = [[]]
        for t in v.of(s):
            if t.surface in c.strings("no-doubled-conjunctive-particle-ga", "separatorChars", SEPARATORS):
                groups.append([])
            elif t.pd1 == "接続助詞" and t.surface == "が":
                groups[-1].append(t)
        out += [(g[0].start, g[0].end, '文中に逆接の接続助詞 "が" が二回以上使われています。', None) for g in groups if len(g) > 1]
    return out


def doubled_conjunction(v: View, c: Config, doc: Document) -> list[Report]:
    out, carried = [], None
    if v.builtin and (not CONJUNCTION.search(v.text) or sum(1 for _ in CONJUNCTIONS.finditer(v.text)) < 2):
        return []
    every = [t for t in v.tokens if t.pos == "接続詞"]
    for s in v.sentences if len(every) > 1 else ():
        found = [t for t in every if s[0] <= t.start < s[1] and not (t.start > s[0] and v.text[t.start - 1] in WHITE)]
        if found:
            if carried == found[0].surface:
                out.append((found[0].start, found[0].end, f"同じ接続詞（{found[0].surface}）が連続して使われています。", None))
            carried = found[0].surface
    return out


def _has(**want):
    sets = {k: x if isinstance(x, tuple) else (x,) for k, x in want.items()}
    return lambda t: all(getattr(t, k) in x for k, x in sets.items())


NAI = _has(base=("ない", "無い"))
NAI_ADJ = lambda t: NAI(t) and t.pos == "形容詞"
NAI_AUX = lambda t: NAI(t) and (t.ctype == "特殊・ナイ" or t.pos == "形容詞")
PARTICLE = lambda x: _has(pos="助詞", surface=x)
DA = _has(base="だ", cform="連用形")
RA = [("", [_has(pos="動詞", base=("来れる", "見れる"))]), ("", [_has(pos="動詞", pd1="自立", ctype="一段", cform="未然形"), _has(pos="動詞", pd1="接尾", base="れる")])]
NEGATIVES = [
    (f"{head}{x}{tail}", [*start, PARTICLE(x), end])
    for head, tail, start, end in (
        ("ないこと", "ない", [NAI, _has(pos="名詞", reading="コト")], NAI_AUX),
        ("なく", "ない", [_has(base=("ない", "無い"), surface=("なく", "無く"))], NAI),
        ("ないで", "ない", [NAI, _has(surface="で")], NAI_ADJ),
        ("ないもので", "ない", [NAI, _has(pos="名詞", reading="モノ"), DA], NAI_ADJ),
        ("ないわけで", "ない", [NAI, _has(pos="名詞", reading="ワケ"), DA], NAI_ADJ),
    )
    for x in ("は", "も")
]
NEGATIVES += [
    ("ないとはいいきれない", [NAI, PARTICLE("と"), PARTICLE("は"), _has(base=("言い切れる", "いい切れる", "言いきれる", "いいきれる")), NAI]),
    ("ないとはかぎらない", [NAI, PARTICLE("と"), PARTICLE("は"), _has(base=("限る", "かぎる")), NAI]),
]
MAYBE = _has(surface="かも", pos="助詞", pd1="副助詞")
WEAK = [
    ("かも", [MAYBE, _has(surface="。", pos="記号")]),
    ("かもしれない", [MAYBE, _has(surface="しれ", pos="動詞", base="しれる", cform=("連用形", "未然形"))]),
    ("思う", [_has(surface="思う", pos="動詞", cform="基本形")]),
    ("思います", [_has(surface="思い", pos="動詞", cform="連用形", base="思う"), _has(surface="ます", pos="助動詞", ctype="特殊・マス", cform="基本形")]),
    ("可能性を示唆している", [_has(surface="可能", pos="名詞"), _has(surface="性", pos="名詞"), _has(surface="を", pos="助詞"), _has(surface="示唆", pos="名詞"), _has(surface="し", pos="動詞", base="する"), _has(surface="て", pos="助詞"), _has(surface="いる", pos="動詞", base="いる")]),
]


def _matches(tokens: list[Token], patterns: list, report) -> list[Report]:
    tokens, found = [t for t in tokens if not t.blank], []
    for label, parts in patterns:
        i, k = 0, len(parts)
        while i + k <= len(tokens):
            if all(p(t) for p, t in zip(parts, tokens[i : i + k], strict=True)):
                found.append(report(label, tokens[i : i + k]))
                i += k
            else:
                i += 1
    return sorted(found, key=lambda r: r[0])


def dropped_ra(v: View, c: Config, doc: Document) -> list[Report]:
    return _matches(v.tokens, RA, lambda _, m: (m[-1].start, m[-1].end, "ら抜き言葉を使用しています。", None)) if re.search("れ", v.text) else []


def double_negative(v: View, c: Config, doc: Document) -> list[Report]:
    return _matches(v.tokens, NEGATIVES, lambda x, m: (m[-1].start, m[-1].end, f"二重否定: 〜{x}", None)) if re.search("な[いくか]|無", v.text) else []


def weak_phrase(v: View, c: Config, doc: Document) -> list[Report]:
    return _matches(v.tokens, WEAK, lambda x, m: (m[0].start, m[-1].end, f'弱い表現: "{x}" が使われています。', None)) if re.search("かも|思う|思い|可能", v.text) else []


STYLE_KINDS = (("Paragraph", "本文", "preferInBody"), ("Heading", "見出し", "preferInHeader"), ("ListItem", "箇条書き", "preferInList"))


def _styles(tokens: list[Token], strict: bool) -> list[tuple[str, int, int, str]]:
    out = []
    for i, t in enumerate(tokens):
        after = tokens[i + 1] if i + 1 < len(tokens) else None
        if t.pos == "助動詞" and t.ctype == "特殊・ダ" and t.cform == "連用形" and after and after.ctype == "五段・ラ行アル":
            style = "である"
        elif t.ctype in ("特殊・デス", "特殊・マス") and t.base != "やす" and t.cform == "基本形":
            style = "ですます"
        else:
            continue
        stop = next((k for k in range(i + 1, len(tokens)) if re.search("[、。]", tokens[k].surface) or "特殊" in tokens[k].ctype or tokens[k].pos == "名詞"), None)
        if strict or stop is None or re.search("[!?！？。]", tokens[stop].surface):
            out.append((style, t.start, t.end, "".join(x.surface for x in tokens[i : len(tokens) if stop is None else stop + 1])))
    return out


def mixed_style(views: list[View], c: Config) -> list[tuple[int, Report]]:
    name, out = "no-mix-dearu-desumasu", []
    for kind, label, key in STYLE_KINDS:
        hits = [(n, h) for n, v in enumerate(views) if v.block.kind == kind and not v.block.quoted and ("で" in v.text or "す" in v.text) for h in _styles(v.tokens, c.flag(name, "strict", False))]
        plain, polite = sum(h[0] == "である" for _, h in hits), sum(h[0] == "ですます" for _, h in hits)
        prefer = c.text(name, key, "")
        if prefer in ("である", "ですます"):
            want = prefer
            if not (polite if want == "である" else plain):
                continue
        elif plain and polite:
            want = "である" if plain > polite else "ですます"
        else:
            continue
        other = "ですます" if want == "である" else "である"
        top = f'"{want}"調 でなければなりません\n=> "{want}"調 であるべき箇所に、次の "{other}"調 の箇所があります' if prefer else f'"である"調 と "ですます"調 が混在\n=> "{want}"調 の文体に、次の "{other}"調 の箇所があります'
        out += [(n, (h[1], h[2], f'{label}: {top}: "{h[3]}"\nTotal:\nである  : {plain}\nですます: {polite}\n', None)) for n, h in hits if h[0] == other]
    return out


def missing_headings(views: list[View], c: Config) -> list[Report]:
    seen = {v.text.strip(WHITE) for v in views if v.block.kind == "Heading" and not v.block.quoted}
    return [(0, 0, f'必須の見出し "{h}" がありません。', None) for h in c.strings("required-headings", "headings") if h.strip(WHITE) not in seen]


def forbidden(v: View, c: Config, doc: Document) -> list[Report]:
    found = [(m.start(), m.end(), f'禁止されている表現 "{m[0]}" が使われています。', None) for p in c.strings("forbidden", "patterns") if (r := matcher(p)) for m in r.finditer(v.text)]
    return sorted(found, key=lambda r: r[0])


def terminology(v: View, c: Config, doc: Document) -> list[Report]:
    out = []
    for term in c.terms():
        want = term["preferred"]
        for p in term.get("avoid") or []:
            if isinstance(p, str) and (r := matcher(p)):
                out += [(m.start(), m.end(), f'"{m[0]}" ではなく "{want}" を使ってください。', (m.start(), m.end(), want)) for m in r.finditer(v.text) if m[0] != want]
    return sorted(out, key=lambda r: r[0])


BY_BLOCK = dict(
    zip(
        [r for r in RULE_IDS if r not in ("no-mix-dearu-desumasu", "required-headings")],
        (sentence_length, max_comma, kanji_runs, exclamations, zero_width, controls, decomposed, half_width, mixed_period, max_ten, doubled_joshi, doubled_ga, doubled_conjunction, dropped_ra, double_negative, weak_phrase, forbidden, terminology),
        strict=True,
    )
)


def _line(doc: Document, at: int) -> int:
    return bisect_right(doc.line_starts, at)


def _read(source: str, backend: Morphology, memo: dict) -> tuple[Document, list[View]]:
    doc = Document(source)
    return doc, [View(b, backend, memo) for b in doc.blocks]


def _reports(doc: Document, views: list[View], config: Config, only: frozenset[str]) -> list[tuple[str, int | None, list[Report]]]:
    """What some rules report, by rule and block."""
    wordy = [(n, v) for n, v in enumerate(views) if not v.builtin or WORDY.search(v.text)]
    found: list[tuple[str, int | None, list[Report]]] = []
    for name in RULE_IDS:
        if name not in only or not config.enabled(name):
            continue
        if name == "no-mix-dearu-desumasu":
            found += [(name, n, [r]) for n, r in mixed_style(views, config)]
        elif name == "required-headings":
            found.append((name, None, missing_headings(views, config)))
        else:
            kinds, quoted = SCOPES[name]
            some = wordy if name in JAPANESE_ONLY else enumerate(views)
            found += [(name, n, r) for n, v in some if v.block.kind in kinds and (quoted or not v.block.quoted) if (r := BY_BLOCK[name](v, config, doc))]
    return found


def lint_counts(source: str, config: Config, backend: Morphology | None = None, memo: dict | None = None) -> list[tuple[str, str, int]]:
    """(rule, severity, number of findings) of a document."""
    doc, views = _read(source, backend or Builtin(), Memo() if memo is None else memo)
    counts: dict[str, int] = {}
    for name, _, reports in _reports(doc, views, config, EVERY):
        counts[name] = counts.get(name, 0) + len(reports)
    return [(name, config.severity(name), n) for name, n in counts.items() if n]


def lint_rows(source: str, config: Config, backend: Morphology | None = None, memo: dict | None = None) -> list[Found]:
    """Findings of a document in order of line, column and rule; equals keep the blocks' order. Ranges are UTF-16."""
    doc, views = _read(source, backend or Builtin(), Memo() if memo is None else memo)
    return _placed(source, doc, _reports(doc, views, config, EVERY), config)


def _placed(source: str, doc: Document, found: list[tuple[str, int | None, list[Report]]], config: Config) -> list[Found]:
    """Reports as findings."""
    size, lines = len(source), doc.line_starts
    wide = [] if source.isascii() else [m.start() for m in WIDE.finditer(source)]
    u = lambda i: i + bisect_left(wide, i) if wide else i
    firsts = [u(i) for i in lines] if wide else lines  # of each line, in UTF-16
    out: list[Found] = []
    for name, n, reports in found:
        severity, block = config.severity(name), None if n is None else doc.blocks[n]
        starts, shifts, segments = (block.starts, block.shifts, block.segments) if block else ([], [], [])
        for start, end, message, fix in reports:
            i = bisect_right(starts, start) - 1
            shift = shifts[i] if i >= 0 and start < end <= segments[i].end else None
            if shift is not None:  # within a verbatim segment
                a, b = start + shift, end + shift
            elif block:
                a, b = block.source_start(start), block.source_end(end)
            else:
                a, b = min(start, size), min(end, size)
            if fix and block:
                if shift is not None and segments[i].start <= fix[0] < fix[1] <= segments[i].end:
                    fix = (fix[0] + shift, fix[1] + shift, fix[2])
                else:
                    where = block.fix_range(fix[0], fix[1])
                    fix = (*where, fix[2]) if where else None
            b = max(a, b)
            line = bisect_right(lines, a)
            last = line if line == len(lines) or b < lines[line] else bisect_right(lines, b)
            if wide:
                a, b = a + bisect_left(wide, a), b + bisect_left(wide, b)
            fix = (u(fix[0]), u(fix[1]), fix[2]) if fix else None
            out.append((name, severity, message, line, a - firsts[line - 1] + 1, last, b - firsts[last - 1] + 1, a, b, fix))
    out.sort(key=PLACE)
    return out


def _as_dict(found: Found) -> dict:
    rule, severity, message, line, column, end_line, end_column, a, b, fix = found
    return {"rule": rule, "severity": severity, "message": message, "line": line, "column": column, "endLine": end_line, "endColumn": end_column, "range": [a, b], "fix": {"range": [fix[0], fix[1]], "text": fix[2]} if fix else None}


def lint_text(source: str, config: Config, backend: Morphology | None = None, memo: dict | None = None) -> list[dict]:
    """The findings of lint_rows as dicts."""
    return [_as_dict(r) for r in lint_rows(source, config, backend, memo)]


def apply_fixes(source: str, diagnostics: list[dict]) -> tuple[str, int]:
    """Fixes in order of range, each that begins behind the last one; the rest wait for another round."""
    return _applied(source, [(*d["fix"]["range"], d["fix"]["text"]) for d in diagnostics if d["fix"]])


def _applied(source: str, fixes: list[tuple[int, int, str]]) -> tuple[str, int]:
    if not fixes:
        return source, 0
    raw = source.encode("utf-16-le")
    out, at, n = [], 0, 0
    for a, b, text in sorted(fixes, key=lambda f: f[:2]):
        if at <= a <= b <= len(raw) // 2:
            out += [raw[at * 2 : a * 2], text.encode("utf-16-le")]
            at, n = b, n + 1
    return b"".join([*out, raw[at * 2 :]]).decode("utf-16-le"), n


def fix_rows(source: str, config: Config, backend: Morphology | None = None, rounds: int = 10) -> tuple[str, int, list[Found]]:
    """The text after at most so many rounds of fixes, how many were applied, and what is left. Rounds look for what can be fixed; all rules see the last text only."""
    backend, memo, total = backend or Builtin(), Memo(), 0
    doc, views = _read(source, backend, memo)
    fixable = _reports(doc, views, config, FIXING)
    for _ in range(rounds):
        source, n = _applied(source, [f[-1] for f in _placed(source, doc, fixable, config) if f[-1]])
        if not n:
            break
        total += n
        doc, views = _read(source, backend, memo)
        fixable = _reports(doc, views, config, FIXING)
    return source, total, _placed(source, doc, fixable + _reports(doc, views, config, EVERY - FIXING), config)


def fix_text(source: str, config: Config, backend: Morphology | None = None, rounds: int = 10) -> tuple[str, int, list[dict]]:
    """The result of fix_rows with dicts."""
    source, total, left = fix_rows(source, config, backend, rounds)
    return source, total, [_as_dict(r) for r in left]
