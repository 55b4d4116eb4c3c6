"""The subpackage's queries and, where SQL expresses one, its SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, decontaminate, embeddings, htmltext, licenses, linededup, simhash, suffixdedup, toxicity, urlfilter

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_simhash": simhash.op2_simhash,
    "op3_url_filter": urlfilter.op3_url_filter,
    "op4_bpe": bpe.op4_bpe,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_suffix_array": suffixdedup.op6_suffix_array,
    "op7_html": htmltext.op7_html,
    "op8_embeddings": embeddings.op8_embeddings,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_toxicity": toxicity.op10_toxicity,
    "pipeline": corpus_pipeline.run,
}
SQL = licenses.SQL | urlfilter.SQL | linededup.SQL | decontaminate.SQL
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
