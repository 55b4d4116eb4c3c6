from __future__ import annotations

import re
from collections import Counter

import pytest

from sumire.llm import licenses
from sumire.llm.licenses import ALIKE, TEMPLATES, normal


def dice(a: list[bytes], b: list[bytes]) -> float:
    x, y = Counter(zip(a, a[1:], strict=False)), Counter(zip(b, b[1:], strict=False))
    return 2 * sum((x & y).values()) / max(1, len(a) + len(b) - 2)


def expected(text: str | None):
    lines = re.split("\r\n|\r|\n", text or "")
    parts: list[list[str]] = [[]]
    for x in lines:
        if re.search("[A-Za-z0-9]", x):
            parts[-1].append(x)
        elif parts[-1]:
            parts.append([])
    parts = ["\n".join(p) for p in parts if p]
    units = [(0, text or ""), *((1, x) for x in lines), *((3, y) for x in lines for y in re.split("[.!?]+[ \t]+", x))]
    units += [(2, "\n".join(parts[i : i + k])) for i in range(len(parts)) for k in range(1, 7) if i + k <= len(parts)]
    units = [(kind, x.encode()) for kind, x in units]
    best, lines = None, 0
    for kind, x in units:
        w = normal(x)
        scores = [(-d, name) for name, t in TEMPLATES if len(w) > 1 and (d := dice(w, normal(t.encode()))) >= ALIKE]
        if scores:
            lines += kind == 1
            best = min([min(scores), *([best] if best else [])])
    return (best[1], pytest.approx(-best[0]), lines) if best else (None, None, 0)


def texts():
    out = [None, "", "word", "two words", "a" * 100_000, "w x " * 50_000]
    for _, t in TEMPLATES:
        w = t.split()
        out += [t, t.lower(), "some text before\n\n" + t + "\n\nand after", "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)), " ".join(w[: len(w) * 3 // 4]), " ".join(w[: len(w) // 2]), t.replace("copies", "items"), f"{t}\n{t}"]
    gpl, mit = next(t for n, t in TEMPLATES if n == "gpl"), TEMPLATES[0][1]
    code = "\n".join(f"x{i} = f(y{i})" for i in range(40))
    cut = lambda t: [" ".join(t.split()[i : i + 11]) for i in range(0, len(t.split()), 11)]
    notice = re.sub(r"\. (This|You)", r".\n\n\1", gpl)
    out += [f"{notice}\n\n{code}", "\r\n".join([*cut(mit), "", "", *code.split("\n")]), "/*\n" + "\n".join(" * " + x for x in cut(mit)) + "\n */\n" + code, code + "\n#\n" + "\n".join("# " + x for x in cut(notice)) + "\n#\n" + code]
    out += ["We wrote this. Released under the MIT License. It is good.", "\r".join(cut(mit)), "a\n\n" * 50 + gpl + "\n\nb" * 50]
    return out


def test_licences_within_longer_texts(spark, tables):
    made = texts()[-7:]
    got = {r.doc_id: r.license for r in licenses.op1_license_scan(spark, tables(documents=list(enumerate(made)))).collect()}
    assert [got[i] for i in range(7)] == ["gpl", "mit", "mit", "gpl", "mit", "mit", "gpl"]


def test_brute_force(spark, tables):
    made = texts()
    got = {r.doc_id: (r.license, r.dice, r.n_lines) for r in licenses.op1_license_scan(spark, tables(documents=list(enumerate(made)))).collect()}
    for i, t in enumerate(made):
        assert got[i] == expected(t), t[:200] if t else t


def test_sql(spark, sf_dir, tables, duck, rows):
    assert rows(licenses.op1_license_scan(spark, sf_dir)) == duck(licenses.SQL["op1_license_scan"])
    folder = tables(documents=list(enumerate(texts())))
    assert rows(licenses.op1_license_scan(spark, folder)) == duck(licenses.SQL["op1_license_scan"], folder)


def test_empty(spark, tables):
    assert licenses.op1_license_scan(spark, tables(documents=[])).collect() == []
    assert [tuple(r) for r in licenses.op1_license_scan(spark, tables(documents=[(None, "Licensed under CC BY 4.0."), (None, None)])).collect()] == [(None, "cc-by", 1.0, 1), (None, None, None, 0)]
