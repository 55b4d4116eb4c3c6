"""The character rules on built-in functions, for text that is one plain paragraph a row.

Positions come from the matches and the gaps between them, so a rule is one projection and one generator over the scan: no
Python, no shuffle. Every function takes the text column and gives an array of (start, end, message) in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signs import java_set

KANJI = f"[{java_set('kanji')}]+"
SENTENCE = "(?s).*?(?:[。！？!?．]|\\.(?=\\p{IsWhite_Space}|\\z))+|(?s).+\\z"
RULES = {
    "max-kanji-continuous-len": KANJI,
    "no-exclamation-question-mark": f"[{java_set('exclamation')}]",
    "no-zero-width-spaces": f"[{java_set('zero-width')}]",
    "no-invalid-control-character": f"[{java_set('control')}]",
    "no-nfd": f"(?s)(?<=.)[{java_set('combining')}]",
    "no-hankaku-kana": f"[{java_set('half-width')}]+",
}


def spots(text: Column, pattern: str) -> Column:
    """(start, surface) of every match of a pattern that never matches nothing."""
    p = F.lit(pattern)
    made = F.struct(F.regexp_extract_all(text, p, 0).alias("m"), F.split(text, pattern, -1).alias("g"))
    fold = F.aggregate(
        F.zip_with(made["m"], F.slice(made["g"], 1, F.greatest(F.size(made["m"]), F.lit(1))), lambda m, g: F.struct(m.alias("m"), g.alias("g"))),
        F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,surface:string>>)").alias("out")),
        lambda s, x: F.struct((s["at"] + F.char_length(x["g"]) + F.char_length(x["m"])).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + F.char_length(x["g"])).alias("start"), x["m"].alias("surface")))).alias("out")),
        lambda s: s["out"],
    )
    return F.when(F.size(made["m"]) > 0, fold).otherwise(F.expr("CAST(array() AS array<struct<start:int,surface:string>>)"))


def utf16_length(text: Column) -> Column:
    return F.char_length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def count(text: Column, name: str) -> Column:
    """How many findings a rule has in a text."""
    if name == "max-kanji-continuous-len":
        return F.size(F.filter(F.regexp_extract_all(text, F.lit(KANJI), 0), lambda m: utf16_length(m) > 6))
    return F.regexp_count(text, F.lit(RULES[name]))


def rule(df: DataFrame, name: str, text: str = "text", most: int = 6) -> DataFrame:
    """df's columns but the text, and (start, surface) of each of a rule's findings; rows that can't have one leave before the generator."""
    pattern = RULES[name]
    found = df.where(F.col(text).rlike(pattern)).withColumn("__f", F.explode(spots(F.col(text), pattern)))
    keep = utf16_length(F.col("__f.surface")) > most if name == "max-kanji-continuous-len" else F.lit(True)
    surface = F.substring(text, F.col("__f.start"), F.lit(2)) if name == "no-nfd" else F.col("__f.surface")  # with the sign before it
    return found.where(keep).select(*[c for c in df.columns if c != text], F.col("__f.start").alias("start"), surface.alias("surface"))


def sentences(text: Column) -> Column:
    """Trimmed sentences of a text without brackets or quotes."""
    trim = "^\\p{IsWhite_Space}+|\\p{IsWhite_Space}+\\z"
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), 0), lambda s: F.regexp_replace(s, trim, "")), lambda s: s != "")
