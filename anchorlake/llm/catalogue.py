"""Importing this module registers every query of the package."""

import corpus_pipeline
from anchorlake.llm import (  # noqa: F401
    alignment,
    decontamination,
    fill_middle,
    language_id,
    near_duplicates,
    packing,
    personal_data,
    preference_pairs,
    prefix_counts,
    quality_rules,
    quality_score,
    source_mix,
    warc_derivatives,
)
from anchorlake.llm.registry import ORACLES, QUERIES  # noqa: F401

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
