"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from isotherm.llm import (
    collocations, decontaminate, html_text, langid, lines, mixing, neardup, periods, pii, quality, secrets, setsketch, warc,
)

Q = {
    "op1_secrets": secrets.op1_secrets,
    "op2_ngram_jaccard_join": neardup.op2_ngram_jaccard_join,
    "op3_language_id": langid.op3_language_id,
    "op4_html_text": html_text.op4_html_text,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_pii": pii.op7_pii,
    "op8_warc_index": warc.op8_warc_index,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_periodic_runs": periods.op11_periodic_runs,
    "op12_setsketch_near_dedup": setsketch.op12_setsketch_near_dedup,
    "op13_collocations": collocations.op13_collocations,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op6_mixing": mixing.SQL,
    "op8_warc_index": warc.SQL,
    "op9_decontamination": decontaminate.SQL,
    "op13_collocations": collocations.SQL,
}


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict:
    return dict(SQL)
