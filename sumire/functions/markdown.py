"""Markdown to blocks of prose: a subset of CommonMark with tables, strikethrough, task lists, footnotes and front matter.

Offsets are code points. A segment ties a run of a block's text to a run of the source.
"""

from __future__ import annotations

import bisect
import re
from html import unescape
from itertools import accumulate
from typing import NamedTuple

WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Segment(NamedTuple):
    start: int
    end: int
    src: int
    src_end: int
    kind: str  # text, code or break
    in_link: bool = False
    url_link: bool = False
    in_emphasis: bool = False
    in_strong: bool = False

    @property
    def verbatim(self) -> bool:
        return self.kind == "text" and self.end - self.start == self.src_end - self.src


def utf16(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


class Block:
    def __init__(self, kind: str, quoted: bool):
        self.kind, self.quoted, self.segments = kind, quoted, []
        self._parts, self._size, self._starts, self._shifts, self._excludes = [], 0, [], [], None

    @property
    def text(self) -> str:
        if len(self._parts) > 1:
            self._parts = ["".join(self._parts)]
        return self._parts[0] if self._parts else ""

    def add(self, text: str, src: int, end: int, kind: str, flags: tuple = (False,) * 4, verbatim: bool = True) -> None:
        if not text:
            return
        at, last = self._size, self.segments[-1] if self.segments else None
        self._parts.append(text)
        self._size += len(text)
        if last and verbatim and kind == "text" and last.verbatim and last.src_end == src and last[5:] == flags:
            self.segments[-1] = last._replace(end=at + len(text), src_end=end)
        else:
            self.segments.append(Segment(at, at + len(text), src, end, kind, *flags))

    @property
    def starts(self) -> list[int]:
        """Where the segments start; one that grows keeps its start."""
        if len(self._starts) != len(self.segments):
            self._starts = [s.start for s in self.segments]
        return self._starts

    @property
    def shifts(self) -> list[int | None]:
        """How far behind its place in the text a verbatim segment lies in the source; None for others."""
        if len(self._shifts) != len(self.segments):
            self._shifts = [s.src - s.start if s.verbatim else None for s in self.segments]
        return self._shifts

    @property
    def excludes(self) -> bool:
        """Whether anything in the whole block is excluded."""
        if self._excludes is None:
            self._excludes = any(s.in_link or s.in_emphasis for s in self.segments)
        return self._excludes

    def at(self, pos: int) -> Segment | None:
        """The last segment that starts at pos or before."""
        i = bisect.bisect_right(self.starts, pos)
        return self.segments[i - 1] if i else None

    def excluded(self, pos: int) -> bool:
        s = self.at(pos)
        return bool(s and (s.in_link or s.in_emphasis))

    def source_start(self, pos: int) -> int:
        s = self.at(pos)
        if s is None:
            return 0
        if pos >= s.end:
            return s.src_end
        return s.src + pos - s.start if s.verbatim or pos == s.start else s.src_end

    def source_end(self, pos: int) -> int:
        i = bisect.bisect_left(self.starts, pos)
        s = self.segments[max(i - 1, 0)] if self.segments else None
        if s is None:
            return 0
        return s.src + pos - s.start if s.verbatim and s.start <= pos <= s.end else s.src_end

    def fix_range(self, start: int, end: int) -> tuple[int, int] | None:
        i = bisect.bisect_right(self.starts, start)
        for s in self.segments[max(i - 2, 0) : i]:
            if s.verbatim and s.start <= start and end <= s.end:
                return s.src + start - s.start, s.src + end - s.start
        return None

    def slice_where(self, start: int, end: int, keep) -> str:
        first, text, out = max(bisect.bisect_right(self.starts, start) - 1, 0), self.text, []
        for i in range(first, len(self.segments)):
            s = self.segments[i]
            if s.start >= end:
                break
            if s.end > start and keep(s):
                out.append(text[max(s.start, start) : min(s.end, end)])
        return "".join(out)

    def last_content(self) -> int | None:
        return next((i for i in range(len(self.segments) - 1, -1, -1) if self.text[self.segments[i].start : self.segments[i].end].strip(WHITE)), None)

    def last_text_node(self) -> str:
        i = self.last_content()
        if i is None:
            return ""
        own, j = self.segments[i], i
        while j and self.segments[j - 1].kind != "code" and (self.segments[j - 1][5:] == own[5:] or self.segments[j - 1].kind == "break"):
            j -= 1
        return self.text[self.segments[j].start : own.end]


FENCE, ATX = re.compile(r" {0,3}(`{3,}|~{3,})([^\n]*)$"), re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)")
RULE, SETEXT = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$"), re.compile(r" {0,3}(=+|-+)[ \t]*$")
QUOTE, ITEM = re.compile(r" {0,3}>[ ]?"), re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
HTML = re.compile(r" {0,3}<(?:(?:script|pre|style|textarea)(?=[\s>]|$)|!--|\?|![A-Za-z]|/?(?:address|article|aside|base|blockquote|body|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|optgroup|option|p|param|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?=[\s/>]|$))", re.I)
HTML_TAG = re.compile(r" {0,3}(?:<[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)\s*$")
ROW, DELIMS = re.compile(r"(?<!\\)\|"), re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
REF = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|\S+)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*(?:\n|$)")
NOTE = re.compile(r" {0,3}\[\^[^\]\s]+\]:[ \t]*")
TASK = re.compile(r"\[[ xX]\](?=[ \t])")
#: Quotes and lists nested deeper than this are read as paragraphs.
DEEPEST = 100

Line = tuple  # (content, source offset of its first code point, offset behind its line end)


class Document:
    def __init__(self, source: str):
        self.source, self.blocks, self.refs, self.depth = source, [], {}, 0
        raw = source.split("\n")
        self.line_starts = [0, *accumulate(len(x) + 1 for x in raw[:-1])]
        if "\r" not in source:
            lines = list(zip(raw, self.line_starts, strict=True))
            lines = lines if raw[-1] else lines[:-1]
        else:
            lines, at = [], 0
            for raw in re.split(r"(?<=\n)|(?<=\r)(?!\n)", source):
                if raw:
                    lines.append((raw.rstrip("\r\n"), at))
                    at += len(raw)
        if lines and re.fullmatch(r"---[ \t]*", lines[0][0]):
            end = next((i for i in range(1, len(lines)) if re.fullmatch(r"(?:---|\.\.\.)[ \t]*", lines[i][0])), None)
            lines = lines[end + 1 :] if end and lines[1][0].strip() else lines
        self._refs(lines)
        self._walk(lines, False, 0)
        self.blocks = [b for b in self.blocks if b.text.strip(WHITE)]

    def _refs(self, lines: list[Line]) -> None:
        for text, _ in lines if "]:" in self.source else ():
            if (m := REF.match(text)) and not m[1].startswith("^"):
                self.refs.setdefault(" ".join(m[1].split()).casefold(), m[2].strip("<>"))

    def _open(self, kind: str, quoted: bool) -> Block:
        self.blocks.append(Block(kind, quoted))
        return self.blocks[-1]

    def _starts(self, text: str, in_paragraph: bool) -> bool:
        """Whether a line begins a block that ends a paragraph."""
        if FENCE.match(text) or ATX.match(text) or RULE.match(text) or QUOTE.match(text) or HTML.match(text):
            return True
        m = ITEM.match(text)
        return bool(m and (not in_paragraph or (text[m.end() :].strip() and (not m[2][0].isdigit() or m[2][:-1] == "1"))))

    def _walk(self, lines: list[Line], quoted: bool, items: int, tight: bool = False) -> None:
        self.depth += 1
        self._blocks(lines, quoted, items, tight, self.depth > DEEPEST)
        self.depth -= 1

    def _blocks(self, lines: list[Line], quoted: bool, items: int, tight: bool, flat: bool) -> None:
        i = 0
        while i < len(lines):
            text, src = lines[i]
            if not text.strip():
                i += 1
                continue
            if (m := FENCE.match(text)) and not (m[1][0] == "`" and "`" in m[2]):
                close = re.compile(r" {0,3}" + re.escape(m[1][0]) + "{" + str(len(m[1])) + r",}[ \t]*$")
                i += 1
                while i < len(lines) and not close.match(lines[i][0]):
                    i += 1
                i += 1
            elif m := ATX.match(text):
                body = text[m.end() :]
                body = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", body).rstrip()
                self._inline(self._open("Heading", quoted), [(body, src + m.end())])
                i += 1
            elif RULE.match(text):
                i += 1
            elif not flat and QUOTE.match(text):
                inner, i = self._quote(lines, i)
                self._walk(inner, True, items)
            elif not flat and ITEM.match(text):
                i = self._list(lines, i, quoted, items)
            elif not flat and (m := NOTE.match(text)):
                inner = [(text[m.end() :], src + m.end())]
                i += 1
                while i < len(lines) and (not lines[i][0].strip() or lines[i][0].startswith("    ")) or i < len(lines) and lines[i][0].strip() and inner[-1][0].strip() and not self._starts(lines[i][0], True):
                    t, s = lines[i]
                    cut = min(4, len(t) - len(t.lstrip(" ")))
                    inner.append((t[cut:], s + cut))
                    i += 1
                self._walk(inner, quoted, items)
            elif HTML.match(text) or HTML_TAG.match(text):
                low = text.lower()
                until = next((e for b, e in (("<!--", "-->"), ("<script", "</script>"), ("<pre", "</pre>"), ("<style", "</style>"), ("<textarea", "</textarea>"), ("<?", "?>")) if low.lstrip().startswith(b)), None)
                while i < len(lines) and (until and until not in lines[i][0].lower() or not until and lines[i][0].strip()):
                    i += 1
                i += bool(until)
            elif text.startswith(("    ", "\t")):
                while i < len(lines) and (lines[i][0].startswith(("    ", "\t")) or not lines[i][0].strip()):
                    i += 1
            elif i + 1 < len(lines) and "|" in text and DELIMS.match(lines[i + 1][0]) and len(self._cells(text)) == len(self._cells(lines[i + 1][0])):
                width, head = len(self._cells(text)), i
                for n in range(head, len(lines)):
                    if n != head + 1:
                        if not lines[n][0].strip() or n > head and self._starts(lines[n][0], False):
                            break
                        for a, b in self._cells(lines[n][0])[:width]:
                            self._inline(self._open("TableCell", quoted), [(lines[n][0][a:b], lines[n][1] + a)])
                    i = n + 1
            else:
                i = self._paragraph(lines, i, quoted, items, tight)

    def _cells(self, text: str) -> list[tuple[int, int]]:
        cuts = [m.start() for m in ROW.finditer(text)]
        a, b = len(text) - len(text.lstrip()), len(text.rstrip())
        edges = [a - 1 if not cuts or cuts[0] != a else a, *(c for c in cuts if c != a and c != b - 1), b - 1 if cuts and cuts[-1] == b - 1 and b - 1 != a else b]
        out = []
        for x, y in zip(edges, edges[1:], strict=False):
            cell = text[x + 1 : y]
            out.append((x + 1 + len(cell) - len(cell.lstrip()), max(x + 1 + len(cell) - len(cell.lstrip()), x + 1 + len(cell.rstrip()))))
        return out

    def _paragraph(self, lines: list[Line], i: int, quoted: bool, items: int, tight: bool) -> int:
        got: list[Line] = []
        kind = "ListItem" if items else "Paragraph"
        while i < len(lines):
            text, src = lines[i]
            if not text.strip() or got and self._starts(text, True) and not (SETEXT.match(text) and text.strip()[0] == "-" and not ITEM.match(text)):
                break
            if got and SETEXT.match(text):
                kind = "Heading"
                i += 1
                break
            cut = len(text) - len(text.lstrip(" \t"))
            got.append((text[cut:], src + cut))
            i += 1
        while got and kind != "Heading" and (m := REF.match(got[0][0])) and not m[1].startswith("^"):
            got = got[1:]
        if got:
            self._inline(self._open(kind, quoted), got)
        return i

    def _lazy(self, inner: list[Line], text: str) -> bool:
        return bool(inner and inner[-1][0].strip() and text.strip() and not self._starts(text, False) and not FENCE.match(inner[-1][0]) and not ATX.match(inner[-1][0]))

    def _quote(self, lines: list[Line], i: int) -> tuple[list[Line], int]:
        inner: list[Line] = []
        while i < len(lines):
            text, src = lines[i]
            if m := QUOTE.match(text):
                inner.append((text[m.end() :], src + m.end()))
            elif self._lazy(inner, text):
                inner.append((text, src))
            else:
                break
            i += 1
        return inner, i

    def _list(self, lines: list[Line], i: int, quoted: bool, items: int) -> int:
        mark = ITEM.match(lines[i][0])[2][-1]
        while i < len(lines):
            text, src = lines[i]
            m = ITEM.match(text)
            if not m or m[2][-1] != mark or RULE.match(text):
                break
            rest = text[m.end() :]
            pad = len(rest) - len(rest.lstrip(" "))
            width = m.end() + (pad if 1 <= pad <= 4 and rest.strip() else 1)
            first = (text[width:], src + width)
            if t := TASK.match(first[0]):
                first = (first[0][t.end() + 1 :], first[1] + t.end() + 1)
            inner = [first]
            i += 1
            while i < len(lines):
                t, s = lines[i]
                indent = len(t) - len(t.lstrip(" "))
                if not t.strip():
                    if not any(x[0].strip() for x in inner):
                        break
                    inner.append((t, s))
                elif indent >= width:
                    inner.append((t[width:], s + width))
                elif t.startswith("\t"):
                    inner.append((t[1:], s + 1))
                elif self._lazy(inner, t):
                    inner.append((t, s))
                else:
                    break
                i += 1
            self._walk(inner, quoted, items + 1, True)
        return i

    def _inline(self, block: Block, lines: list[Line]) -> None:
        Inline(self, block, lines)


SIGNS = re.compile(r"[\\&`<*_~\[\]!\n]")
ESCAPE, ENTITY = re.compile(r"\\([!-/:-@\[-`{-~])"), re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);")
AUTO, TAG = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>"), re.compile(r"<(?:[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?|/[A-Za-z][\w-]*\s*|!--.*?--|\?.*?\?|![A-Za-z][^>]*)>", re.S)
DEST = re.compile(r"\(\s*(<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S)
PUNCT = re.compile(r"[!-/:-@\[-`{-~\u2010-\u2027\u2030-\u205e\u3001-\u3003\u3008-\u3011\u3014-\u301f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


class Inline:
    def __init__(self, doc: Document, block: Block, lines: list[Line]):
        self.raw = "\n".join(t.rstrip(" \t") if n == len(lines) - 1 else t for n, (t, _) in enumerate(lines))
        self.starts = [0, *accumulate(len(t) + 1 for t, _ in lines[:-1])]  # of each line in raw
        self.shifts = [s - a for (_, s), a in zip(lines, self.starts, strict=True)]
        self.doc, self.nodes = doc, []
        self._scan()
        self._emphasis(0)
        self._emit(block)

    def _scan(self) -> None:
        raw, i, text = self.raw, 0, 0
        brackets: list[tuple[int, bool]] = []
        nodes, lone = self.nodes, set()

        def flush(to: int) -> None:
            if to > text:
                nodes.append(["text", text, to])

        while i < len(raw):
            if not (sign := SIGNS.search(raw, i)):
                break
            i = sign.start()
            c, j = raw[i], i + 1
            if c == "\n":
                a = len(raw[:i].rstrip(" ")) if raw[i - 1 : i] == " " else i
                flush(max(a, text))
                nodes.append(["break", max(a, text), j])
            elif c == "\\" and raw[j : j + 1] == "\n":
                flush(i)
                nodes.append(["break", i, j + 1])
                j += 1
            elif c == "\\" and ESCAPE.match(raw, i):
                flush(i)
                nodes.append(["text", i + 1, i + 2])
                j = i + 2
            elif c == "&" and (m := ENTITY.match(raw, i)) and unescape(m[0]) != m[0]:
                flush(i)
                j = m.end()
                nodes.append(["entity", i, j, unescape(m[0])])
            elif c == "`":
                run = re.compile("`+").match(raw, i)[0]
                m = re.compile(r"(?<!`)" + run + r"(?!`)").search(raw, i + len(run)) if len(run) not in lone else None
                if m is None:
                    lone.add(len(run))
                    i += len(run)
                    continue
                flush(i)
                body = raw[i + len(run) : m.start()].replace("\n", " ")
                body = body[1:-1] if body.strip() and body[0] == body[-1] == " " else body
                j = m.end()
                nodes.append(["code", i, j, body])
            elif c == "<" and (m := AUTO.match(raw, i)):
                flush(i)
                j = m.end()
                nodes += [["link", m[1] if ":" in m[1] else "mailto:" + m[1]], ["text", i + 1, j - 1], ["/link"]]
            elif c == "<" and (m := TAG.match(raw, i)):
                flush(i)
                j = m.end()
            elif c in "*_~":
                j = re.compile(re.escape(c) + "+").match(raw, i).end()
                if c == "~" and j - i > 2:
                    i = j
                    continue
                flush(i)
                before, after = raw[i - 1 : i] or " ", raw[j : j + 1] or " "
                white_before, white_after, punct_before, punct_after = before in WHITE, after in WHITE, bool(PUNCT.match(before)), bool(PUNCT.match(after))
                left = not white_after and (not punct_after or white_before or punct_before)
                right = not white_before and (not punct_before or white_after or punct_after)
                opens, closes = (left and (not right or punct_before), right and (not left or punct_after)) if c == "_" else (left, right)
                nodes.append(["delim", i, j, c, opens, closes])
            elif c == "!" and raw[j : j + 1] == "[":
                flush(i)
                brackets.append((len(nodes), True))
                j += 1
                nodes.append(["text", i, j])
            elif c == "[":
                m = re.compile(r"\[\^[^\]\s]+\]").match(raw, i)
                flush(i)
                if m:
                    j = m.end()
                else:
                    brackets.append((len(nodes), False))
                    nodes.append(["text", i, j])
            elif c == "]" and brackets:
                at, image = brackets.pop()
                flush(i)
                dest = None
                if m := DEST.match(raw, j):
                    dest, j = ESCAPE.sub(r"\1", unescape(m[1].strip("<>"))), m.end()
                else:
                    label = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(raw, j)
                    name = label[1] if label and label[1].strip() else raw[nodes[at][2] : i]
                    dest = self.doc.refs.get(" ".join(name.split()).casefold())
                    if dest is not None and label:
                        j = label.end()
                if dest is None:
                    nodes.append(["text", i, i + 1])
                    text = i = i + 1
                    continue
                if image:
                    del nodes[at:]
                else:
                    self._emphasis(at + 1)
                    nodes[at] = ["link", dest]
                    nodes.append(["/link"])
                    brackets = [b for b in brackets if b[1]]
            else:
                i = j
                continue
            text = i = j
        flush(len(raw))

    def _emphasis(self, low: int) -> None:
        """Pairs the delimiters from low on. Openers wait on a stack; below bottom no opener fits a closer of that kind."""
        nodes, stack, bottom = self.nodes, [], {}
        own = [i for i in range(low, len(nodes)) if nodes[i][0] == "delim"]
        for i in own:
            n = nodes[i]
            n += [[], []]  # what it closes, what it opens
            while n[5] and n[2] > n[1]:
                b = n[2] - n[1]
                key = (n[3], n[4], b if n[3] == "~" else b % 3)
                for k in range(len(stack) - 1, bottom.get(key, 0) - 1, -1):
                    o = nodes[stack[k]]
                    a = o[2] - o[1]
                    if o[3] == n[3] and not (n[3] == "~" and a != b or (o[5] or n[4]) and (a + b) % 3 == 0 and (a % 3 or b % 3)):
                        break
                else:
                    bottom[key] = len(stack)
                    break
                use = a if n[3] == "~" else 2 if a >= 2 and b >= 2 else 1
                name = "strike" if n[3] == "~" else "strong" if use == 2 else "emphasis"
                o[2] -= use
                n[1] += use
                o[7].append(name)
                n[6].append(name)
                del stack[k + (o[2] > o[1]) :]
                for x in bottom:
                    bottom[x] = min(bottom[x], k)
            if n[4] and n[2] > n[1]:
                stack.append(i)
        for i in own:
            nodes[i][0] = "done"

    def _emit(self, block: Block) -> None:
        depth = {"link": 0, "emphasis": 0, "strong": 0, "strike": 0}
        dest, url, size, starts, shifts = "", False, len(self.raw), self.starts, self.shifts

        def at(i: int) -> int:
            i = min(i, size)
            return i + shifts[bisect.bisect_right(starts, i) - 1]

        nodes: list[list] = []
        for n in self.nodes:
            if n[0] == "done":
                nodes += [["/" + x] for x in n[6]]
                nodes += [["text", n[1], n[2]]] if n[2] > n[1] else []
                nodes += [[x] for x in reversed(n[7])]
            else:
                nodes.append(n)
        for n in nodes:
            kind = n[0]
            if kind in depth:
                depth[kind] += 1
                dest = n[1] if kind == "link" else dest
            elif kind[0] == "/":
                depth[kind[1:]] -= 1
                url = False if kind == "/link" else url
            elif kind == "break":
                block.add("\n", at(n[1]), at(n[2]), "break", verbatim=False)
            elif kind in ("text", "entity", "code"):
                body = self.raw[n[1] : n[2]] if kind == "text" else "ー" * max(1, utf16(n[3])) if kind == "code" else n[3]
                if kind != "code":
                    url = depth["link"] > 0 and body == dest
                flags = (depth["link"] > 0, url, depth["emphasis"] > 0, depth["strong"] > 0)
                end = at(n[2] - 1) + 1 if n[2] > n[1] else at(n[2])
                block.add(body, at(n[1]), end, "code" if kind == "code" else "text", flags, kind == "text")
