"""From raw documents to token ids: each stage works on all that its forerunner kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sumire.llm._shared import Scratch, table
from sumire.llm.bpe import stage_bpe
from sumire.llm.decontaminate import stage_decontaminate
from sumire.llm.linededup import stage_lines
from sumire.llm.simhash import stage_simhash
from sumire.llm.toxicity import stage_toxicity

#: Each function takes (spark, docs, sf_dir) and returns documents; the last returns their token ids.
STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_lines),
    ("simhash", stage_simhash),
    ("decontaminate", stage_decontaminate),
    ("bpe", stage_bpe),
]

#: SQL can't express the classifiers, the fingerprints' hash or the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
