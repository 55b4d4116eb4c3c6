"""Lint, fix, summary and gate over a DataFrame of documents (path, source).

A document is one row and no rule looks across documents, so a lint is one Arrow map without a shuffle; rules that the
configuration turns off are not run. Sorting and numbering within a document happen inside its row.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumire.functions.markdown import Document, utf16
from sumire.functions.sentences import split
from sumire.functions.tokens import Builtin, Morphology, Token, tokenize
from sumire.operators.rules import Found, Memo, apply_fixes, fix_rows, lint_counts, lint_rows
from sumire.plans.config import Config

FIX = "struct<range:array<int>,text:string>"
DIAGNOSTIC = f"struct<rule:string,severity:string,message:string,line:int,column:int,endLine:int,endColumn:int,range:array<int>,fix:{FIX}>"
COUNT = "struct<rule:string,severity:string,n:int>"
BLOCK = "struct<block_idx:int,kind:string,text:string,in_blockquote:boolean,segments:array<struct<text_start:int,text_end:int,src_start:int,src_end:int,kind:string,in_link:boolean,url_link:boolean,in_emphasis:boolean,in_strong:boolean>>,sentences:array<struct<s_start:int,s_end:int>>>"
TOKEN = "struct<surface:string,t_start:int,t_end:int,pos:string,pd1:string,pd2:string,pd3:string,ctype:string,cform:string,base:string,reading:string,pron:string>"


#: Bytes of text that a kernel takes at a time; a longer text goes alone.
PIECE = 1 << 18


def _pieces(b: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with at most PIECE bytes in column at, or one row."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(b.column(at)).to_pylist()):
        if size + (n or 0) > PIECE and i > start:
            yield b.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    yield b.slice(start)


def _arrow(df: DataFrame, column: str, added: str, work) -> DataFrame:
    """df and a column of the given type, made from the strings of another; null strings are empty documents.

    work gets the column's Arrow type and gives a function from texts to an array. It gets PIECE bytes of a batch at a time, so a task never holds what a whole batch of texts gives.
    """
    df = df.drop(added.split(" ", 1)[0])
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    name, kind = added.split(" ", 1)
    spark_type = _parse_datatype_string(kind)
    schema, at = StructType([*df.schema.fields, StructField(name, spark_type)]), df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_type(spark_type)
        call = work(arrow)
        for part in (p for b in batches for p in _pieces(b, at)):
            gc.disable()  # a piece makes no cycles; what it makes would be looked through again and again
            try:
                made = call([x or "" for x in part.column(at).to_pylist()])
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays([*part.columns, made if isinstance(made, pa.Array) else pa.array(made, arrow)], [*part.schema.names, name])

    return df.mapInArrow(run, schema)


def _lists(kind: pa.ListType, lists: list[list[tuple]], build) -> pa.Array:
    """An array of lists of structs; build gives the structs' columns for all of them in a row."""
    rows = [r for x in lists for r in x]
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, lists))], pa.int32()), _structs(kind.value_type, build(rows)), type=kind)


def _structs(kind: pa.StructType, columns: list, mask: list[bool] | None = None) -> pa.Array:
    fields = [kind.field(i) for i in range(kind.num_fields)]
    made = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in zip(fields, columns, strict=True)]
    return pa.StructArray.from_arrays(made, fields=fields, mask=None if mask is None else pa.array(mask, pa.bool_()))


def _ranges(kind: pa.ListType, a: list[int], b: list[int]) -> pa.Array:
    both = [0] * (2 * len(a))
    both[::2], both[1::2] = a, b
    return pa.ListArray.from_arrays(pa.array(range(0, len(both) + 1, 2), pa.int32()), pa.array(both, pa.int32()), type=kind)


def _diagnostics(kind: pa.ListType, found: list[list[Found]]) -> pa.Array:
    """Findings of documents as an array of the type of diagnostics."""
    fix, span = kind.value_type.field("fix").type, kind.value_type.field("range").type

    def build(rows: list[Found]) -> list:
        rule, severity, message, line, column, end_line, end_column, a, b, fixes = map(list, zip(*rows, strict=True)) if rows else [[]] * 10
        own = [f or (0, 0, "") for f in fixes]
        patches = _structs(fix, [_ranges(span, [f[0] for f in own], [f[1] for f in own]), [f[2] for f in own]], [f is None for f in fixes])
        return [rule, severity, message, line, column, end_line, end_column, _ranges(span, a, b), patches]

    return _lists(kind, found, build)


def lint(df: DataFrame, config: Config | None = None, backend: Morphology | None = None) -> DataFrame:
    """df (path, source, and any more) with diagnostics: the document's findings in order."""
    config = (config or Config()).checked()

    def work(arrow: pa.DataType):
        memo = Memo()

        def call(texts: list[str]) -> pa.Array:
            return _diagnostics(arrow, [lint_rows(x, config, backend, memo) for x in texts])

        return call

    return _arrow(df, "source", f"diagnostics array<{DIAGNOSTIC}>", work)


def tally(df: DataFrame, config: Config | None = None, backend: Morphology | None = None) -> DataFrame:
    """df with counts: how many findings of each rule a document has. As lint, but findings themselves aren't placed, made or sent."""
    config = (config or Config()).checked()

    def work(arrow: pa.DataType):
        memo = Memo()
        return lambda texts: _lists(arrow, [lint_counts(x, config, backend, memo) for x in texts], lambda rows: list(map(list, zip(*rows, strict=True))) or [[]] * 3)

    return _arrow(df, "source", f"counts array<{COUNT}>", work)


def findings(df: DataFrame, config: Config | None = None, backend: Morphology | None = None) -> DataFrame:
    """A row (path, nth, and the finding's fields) for each finding; nth is its place in the document."""
    found = lint(df.select("path", "source"), config, backend)
    return found.select("path", F.posexplode("diagnostics").alias("nth", "d")).select("path", "nth", "d.*")


def fix(df: DataFrame, config: Config | None = None, backend: Morphology | None = None) -> DataFrame:
    """df with fixed (source after up to ten rounds of fixes, applied in number, diagnostics left)."""
    config = (config or Config()).checked()

    def work(arrow: pa.DataType):
        def call(texts: list[str]) -> pa.Array:
            out = [fix_rows(x, config, backend) for x in texts]
            return _structs(arrow, [[x[0] for x in out], [x[1] for x in out], _diagnostics(arrow.field("diagnostics").type, [x[2] for x in out])])

        return call

    return _arrow(df, "source", f"fixed struct<source:string,applied:int,diagnostics:array<{DIAGNOSTIC}>>", work)


def fix_once(df: DataFrame) -> DataFrame:
    """df (source, diagnostics) with the source after one round, by built-in functions: fixes in order, each behind the last."""
    fixes = F.expr("array_sort(transform(filter(diagnostics, d -> d.fix is not null), d -> struct(d.fix.range[0] AS a, d.fix.range[1] AS b, d.fix.text AS text)))")
    fold = """aggregate(__fixes, struct(0 AS at, CAST('' AS BINARY) AS out, 0 AS n),
      (s, f) -> IF(f.a >= s.at AND f.b >= f.a AND f.b <= octet_length(__utf16) DIV 2,
        struct(f.b AS at, concat(s.out, substring(__utf16, 2 * s.at + 1, 2 * (f.a - s.at)), encode(f.text, 'UTF-16BE')) AS out, s.n + 1 AS n), s),
      s -> struct(decode(concat(s.out, substring(__utf16, 2 * s.at + 1)), 'UTF-16BE') AS source, s.n AS applied))"""
    return df.withColumn("__fixes", fixes).withColumn("__utf16", F.encode("source", "UTF-16BE")).withColumn("fixed", F.expr(fold)).drop("__fixes", "__utf16")


def blocks(df: DataFrame) -> DataFrame:
    """A row (path, and the block's fields) for each block of prose; offsets are code points."""

    def work(_: pa.DataType):
        def one(text: str) -> list[dict]:
            return [
                {
                    "block_idx": i,
                    "kind": b.kind,
                    "text": b.text,
                    "in_blockquote": b.quoted,
                    "segments": [{"text_start": s.start, "text_end": s.end, "src_start": s.src, "src_end": s.src_end, "kind": s.kind, "in_link": s.in_link, "url_link": s.url_link, "in_emphasis": s.in_emphasis, "in_strong": s.in_strong} for s in b.segments],
                    "sentences": [{"s_start": a, "s_end": e} for a, e in split(b.text)],
                }
                for i, b in enumerate(Document(text).blocks)
            ]

        return lambda texts: [one(x) for x in texts]

    return _arrow(df.select("path", "source"), "source", f"blocks array<{BLOCK}>", work).select("path", F.inline("blocks"))


def tokens(df: DataFrame, column: str = "text", backend: Morphology | None = None) -> DataFrame:
    """df with tokens of a text column. Distinct texts go through the analyser once a task."""

    def work(arrow: pa.DataType):
        memo = Memo()
        own = backend or Builtin()

        def one(text: str) -> list[Token]:
            if text not in memo:
                memo[text] = tokenize(own, text)
            return memo[text]

        return lambda texts: _lists(arrow, [one(x) for x in texts], lambda rows: list(map(list, zip(*rows, strict=True))) or [[]] * 12)

    return _arrow(df, column, f"tokens array<{TOKEN}>", work)


def token_counts(df: DataFrame, column: str = "text", backend: Morphology | None = None) -> DataFrame:
    """df with n_tokens, how many tokens a text column has: the size of what tokens gives, which isn't made or sent."""

    def work(_: pa.DataType):
        one = (lambda x: len(tokenize(backend, x))) if backend else Builtin().count
        return lambda texts: [one(x) for x in texts]

    return _arrow(df, column, "n_tokens int", work)


def summary(linted: DataFrame) -> DataFrame:
    """One row: errors, warnings, and fixes applied, of a lint's diagnostics, a tally's counts or a fix's diagnostics."""
    fixed = "fixed" in linted.columns
    if fixed or "diagnostics" in linted.columns:
        found = F.col("fixed.diagnostics") if fixed else F.col("diagnostics")
        of = lambda kind: F.size(F.filter(found, lambda d: d["severity"] == kind))
    else:
        of = lambda kind: F.aggregate("counts", F.lit(0), lambda n, c: n + F.when(c["severity"] == kind, c["n"]).otherwise(0))
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)).cast("long")
    return linted.agg(total(of("error")).alias("errors"), total(of("warning")).alias("warnings"), (total("fixed.applied") if fixed else F.lit(0).cast("long")).alias("fixed"))


def gate(linted: DataFrame, config: Config, max_warnings: int | None = None) -> bool:
    """Whether the gate fails."""
    r = summary(linted).first()
    return config.fails(r.errors, r.warnings, max_warnings)


def utf16_length(text: Column) -> Column:
    return F.char_length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


__all__ = ["apply_fixes", "blocks", "findings", "fix", "fix_once", "gate", "lint", "summary", "tally", "token_counts", "tokens", "utf16", "utf16_length"]
