"""The registry exposes every planned report key, each with an oracle unless
it is model-dependent."""

from __future__ import annotations

from tidemark.plans import registry as entry

PLANNED = """funnel_by_device funnel_sessions funnel_sessions_ios funnel_sessions_channel retention_by_channel
retention_grid retention_validation business_kpis business_kpis_filtered topline_kpis filter_options
acquisition_share table_counts sessions_built user_active_days user_segments experiment_assignment orders_built
segment_performance segment_by_channel ab_results ab_raw ab_lift ab_significance device_checkout device_leakage
past_purchases cart_features label_distribution stratified_split integrity_audit briefing_context
model_metrics cart_risk_scores""".split()
MODEL_DEPENDENT = {"model_metrics", "cart_risk_scores"}


def test_planned_keys_are_registered():
    assert set(PLANNED) <= set(entry.queries())


def test_deterministic_keys_have_oracle_sql():
    for key in entry.queries():
        if key not in MODEL_DEPENDENT:
            assert key in entry.oracle_sql(), key
            assert entry.oracle_sql()[key].strip(), key
