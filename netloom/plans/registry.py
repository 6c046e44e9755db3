"""Names of all queries outside the llm subpackage, with their DuckDB twins."""

from __future__ import annotations

from netloom.plans import evaluation_queries, experiment_queries, flow_queries, matrix_queries, profile_queries, sequence_queries, source_queries, window_queries

MODULES = [flow_queries, sequence_queries, window_queries, evaluation_queries, matrix_queries, profile_queries, experiment_queries, source_queries]
QUERIES: dict = {}
ORACLES: dict = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES


def flagship(spark, sf_dir):
    """Packets to sessions to features to the first matching rule."""
    return QUERIES["q_detect"](spark, sf_dir)
