"""Sentences of a block's text: terminators outside brackets and quotes end them, line ends don't."""

from __future__ import annotations

import re

from .markdown import WHITE

TERMINATORS = "。！？!?．"
PAIRS = dict(zip("「『（([{【《〈“", "」』）)]}】》〉”", strict=True))
CLOSERS = {b: a for a, b in PAIRS.items()}
#: Brackets, quotes, and runs of what ends a sentence outside these.
MARKS = re.compile("[" + re.escape("".join(PAIRS) + "".join(CLOSERS)) + f'"]|(?:[{TERMINATORS}]|\\.(?=[{WHITE}]|\\Z))+')


def split(text: str) -> list[tuple[int, int]]:
    """Trimmed [start, end) of each sentence, without empty ones."""
    out, stack, start = [], [], 0

    def push(a: int, b: int) -> None:
        while a < b and text[a] in WHITE:
            a += 1
        while a < b and text[b - 1] in WHITE:
            b -= 1
        if a < b:
            out.append((a, b))

    for m in MARKS.finditer(text):
        c = m[0]
        if c in PAIRS:
            stack.append(c)
        elif c in CLOSERS:
            if stack and stack[-1] == CLOSERS[c]:
                stack.pop()
        elif c == '"':
            if stack and stack[-1] == '"':
                stack.pop()
            else:
                stack.append('"')
        elif not stack:
            push(start, m.end())
            start = m.end()
    push(start, len(text))
    return out
