"""Reports of a lint: text, JSON, and the JSON of another well-known linter; rewritten files; token dumps."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumire.operators.lint import summary

PREFIX = "ja-technical-writing/"


def text_lines(linted: DataFrame) -> DataFrame:
    """(path, nth, line): path:line:column: the message's first line [rule]."""
    each = linted.select("path", F.posexplode("diagnostics").alias("nth", "d"))
    return each.select("path", "nth", F.concat("path", F.lit(":"), F.col("d.line").cast("string"), F.lit(":"), F.col("d.column").cast("string"), F.lit(": "), F.split("d.message", "\n")[0], F.lit(" ["), F.col("d.rule"), F.lit("]")).alias("line"))


def _foreign(d: Column) -> Column:
    place = lambda line, column: F.struct(d[line].alias("line"), d[column].alias("column"))
    return F.struct(
        F.lit("lint").alias("type"),
        F.concat(F.lit(PREFIX), d["rule"]).alias("ruleId"),
        d["message"].alias("message"),
        d["range"][0].alias("index"),
        d["line"].alias("line"),
        d["column"].alias("column"),
        d["range"].alias("range"),
        F.struct(place("line", "column").alias("start"), place("endLine", "endColumn").alias("end")).alias("loc"),
        F.when(d["severity"] == "error", 2).otherwise(1).alias("severity"),
        d["fix"].alias("fix"),
    )


def foreign_json(linted: DataFrame) -> DataFrame:
    """(path, json) with one object a document: filePath and messages."""
    return linted.select("path", F.to_json(F.struct(F.col("path").alias("filePath"), F.transform("diagnostics", _foreign).alias("messages"))).alias("json"))


def file_json(linted: DataFrame) -> DataFrame:
    """(path, json) with one object a document: path and diagnostics; a missing fix is left out."""
    return linted.select("path", F.to_json(F.struct("path", "diagnostics")).alias("json"))


def render(linted: DataFrame, style: str = "text") -> str:
    """A whole report, for as many documents as a driver can hold; write the DataFrames above for more."""
    order = ["path_ord"] if "path_ord" in linted.columns else ["path"]
    found = linted.withColumn("diagnostics", F.col("fixed.diagnostics")) if "fixed" in linted.columns else linted
    rows = found.select(*{*order, "path"}, "diagnostics").orderBy(*order, "path")
    if style == "text":
        lines = rows.select(*order, F.posexplode("diagnostics").alias("nth", "d"), "path")
        lines = lines.select(*order, "nth", F.format_string("%s:%d:%d: %s [%s]", "path", "d.line", "d.column", F.split("d.message", "\n")[0], "d.rule").alias("line"))
        return "".join(r.line + "\n" for r in lines.orderBy(*order, "nth").toLocalIterator())
    if style == "json":
        files = [json.loads(r.json) for r in rows.select(F.to_json(F.struct("path", "diagnostics")).alias("json")).toLocalIterator()]
        return json.dumps({"version": 1, "files": files, "summary": summary(linted).first().asDict()}, ensure_ascii=False, indent=2) + "\n"
    if style == "textlint":
        return "[" + ",".join(r.json for r in rows.select(F.to_json(F.struct(F.col("path").alias("filePath"), F.transform("diagnostics", _foreign).alias("messages"))).alias("json")).toLocalIterator()) + "]\n"
    raise ValueError(f"unknown format {style}")


def rewritten(fixed: DataFrame) -> DataFrame:
    """(path, source) of the documents that fixes changed; write them to a new folder."""
    return fixed.where("fixed.source <> source").select("path", F.col("fixed.source").alias("source"))


def token_dump(tokens: DataFrame) -> DataFrame:
    """(json): an array of surface|pos|details|conjugation|base|start a text; starts are code points."""
    row = lambda t: F.concat_ws("|", t["surface"], t["pos"], t["pd1"], t["pd2"], t["pd3"], t["ctype"], t["cform"], t["base"], t["t_start"].cast("string"))
    return tokens.select(F.to_json(F.transform("tokens", row)).alias("json"))
