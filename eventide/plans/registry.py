"""All registered queries and their oracles."""

from __future__ import annotations

from eventide.plans import q_core, q_features, q_models, q_pit, q_registry, q_sources, q_stats, q_trades

_MODULES = (q_core, q_pit, q_features, q_trades, q_stats, q_registry, q_sources, q_models)


def queries():
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}


def flagship(spark, sf_dir):
    return q_core.event_study_by_outcome(spark, sf_dir, key="p_type")
