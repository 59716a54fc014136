"""Registered queries of this package and their DuckDB oracles (where SQL can express them)."""

from __future__ import annotations

import corpus_pipeline
from ledgerline.llm import (decontaminate, fingerprints, line_dedup, mixing, periodic_runs, quality, quality_rules, secrets, simhash, spelling, token_output,
                            toxicity, url_rules)

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_secrets": secrets.op3_secrets,
    "op4_url_rules": url_rules.op4_url_rules,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_simhash": simhash.op6_simhash,
    "op7_quality": quality.op7_quality,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_spelling": spelling.op13_spelling,
    "fingerprint_classes": fingerprints.fingerprint_classes,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op4_url_rules": url_rules.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
}
