"""Line dedup: windows of three consecutive lines that occur before are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Scratch, fresh, table

WINDOW = 3


def _windows(docs: DataFrame) -> DataFrame:
    """(id, th, pos, k1, k2): every window of three lines that aren't all blank, by two hashes of its lines' hashes."""
    lines = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines"))
    hashed = lines.select("id", "th", F.expr("transform(lines, x -> xxhash64(x))").alias("h"), F.expr("transform(lines, x -> x rlike '\\\\S')").alias("full")).where(F.size("h") >= WINDOW)
    made = hashed.select("id", "th", F.explode(F.expr("transform(sequence(0, size(h) - 3), i -> struct(i AS pos, xxhash64(h[i], h[i + 1], h[i + 2]) AS k1, xxhash64(h[i + 2], h[i], h[i + 1], 1) AS k2, full[i] or full[i + 1] or full[i + 2] AS full))")).alias("w"))
    return made.where("w.full").select("id", "th", "w.pos", "w.k1", "w.k2")


def covered(docs: DataFrame) -> DataFrame:
    """(id, th, starts): the starts of the windows of a row that have occurred before, by doc_id, hash of the text and place.

    Rows alike in doc_id and text are one document, so they get the same starts; null ids come first.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    first = F.min(F.struct("id", "th", "pos")).alias("first")
    repeated = scratch.save(_windows(docs).groupBy("k1", "k2").agg(first, F.max(F.struct("id", "th", "pos")).alias("last")).where("first < last").drop("last"))
    later = _windows(docs).join(repeated, ["k1", "k2"]).where(F.struct("id", "th", "pos") > F.col("first"))
    return scratch.save(later.groupBy("id", "th").agg(F.collect_set("pos").alias("starts")))


def keep_lines(lines: list[str], starts: list[int]) -> tuple[list[str], int]:
    """Lines outside the merged windows, and how many removed runs there are."""
    kept, runs, end = [], 0, 0
    last = 0
    for s in sorted(starts):
        if s > end or not runs:
            runs += 1
            kept += lines[last:s]
        end = s + WINDOW
        last = end
    return kept + lines[last:], runs


def _with_starts(docs: DataFrame) -> DataFrame:
    """docs and, as its last column, starts of windows that go, null where nothing is removed."""
    own, i, h, starts = fresh(docs, "__hash", "__id", "__th", "__starts")
    found = covered(docs).select(F.col("id").alias(i), F.col("th").alias(h), F.col("starts").alias(starts))
    d = docs.withColumn(own, F.xxhash64("text"))
    found = found.hint("merge")  # starts grow with the documents, so they are never broadcast
    return d.join(found, (d["doc_id"].cast("long").eqNullSafe(found[i])) & (d[own] == found[h]), "left").select(*[d[c] for c in docs.columns], found[starts])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated windows' lines taken out of text; every row stays, be its text empty then. n_chars follows the text.

    Null texts stay null; texts of fewer than three lines, and windows of blank lines alone, stay.
    """
    names, at, schema = docs.columns, docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, starts = list(b.columns[:-1]), b.column(len(names)).to_pylist()
            if any(starts):
                columns[at] = pa.array([("\n".join(keep_lines(x.split("\n"), s)[0]) if s else x) for x, s in zip(columns[at].to_pylist(), starts, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    out = _with_starts(docs).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in names else out


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (0 for null), n_removed, n_spans (removed runs) and kept_sha256 (of the kept lines joined by line ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines = [] if x is None else x.split("\n")
                kept, n = keep_lines(lines, s) if s else (lines, 0)
                rows.append((len(lines), len(lines) - len(kept), n, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(4))], ["doc_id", "n_lines", "n_removed", "n_spans", "kept_sha256"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_starts(docs).mapInArrow(run, "doc_id long, n_lines long, n_removed long, n_spans long, kept_sha256 string")


SQL = {
    "op5_line_dedup": r"""
WITH l AS (SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(string_split(text, chr(10)), []) AS lines FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM l),
w AS (SELECT doc_id, i, line, lead(line) OVER p AS l2, lead(line, 2) OVER p AS l3 FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, line || chr(10) || l2 || chr(10) || l3 AS key FROM w WHERE l3 IS NOT NULL AND regexp_matches(line || l2 || l3, '\S')),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS nth FROM k),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM o, (SELECT unnest([0, 1, 2]) AS j) WHERE nth > 1),
r AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE p IS DISTINCT FROM i - 1) AS n_spans FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c) GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT l.doc_id, CAST(n_lines AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM l LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
