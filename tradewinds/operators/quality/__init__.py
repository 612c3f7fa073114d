"""Data-quality operators: each takes DataFrames and returns a small report or a listing.

Totals are computed in one pass per table, and rows are collapsed per key before any shuffle.
"""

from tradewinds.operators.quality.cohorts import (
    calendar_boundary_checks,
    constant_within_group,
    last_cumulative_equals_total,
    month0_invariants,
    month_axis_completeness,
    monotone_cumulative,
    ratio_recompute,
    sequence_gap,
    sum_identity,
)
from tradewinds.operators.quality.keys import (
    composite_unique_profile,
    critical_null_summary,
    duplicate_key_groups,
    pk_null_summary,
    pk_uniqueness_summary,
    unique_key_profile,
)
from tradewinds.operators.quality.layers import (
    copy_mismatch,
    grand_total_reconcile,
    row_count_reconcile,
    view_vs_source,
)
from tradewinds.operators.quality.references import (
    anomaly_attribution,
    coverage_pct,
    cross_table_event_order,
    event_gap_histogram,
    orphan_count,
    orphan_drilldown,
    orphan_values,
    referential_summary,
)
from tradewinds.operators.quality.rules import (
    buyer_flag_invariants,
    count_violations,
    derived_consistency,
    domain_range_rules,
    event_order_anomalies,
    flag_counts,
    flag_rule_consistency,
    flag_snapshot,
    geo_out_of_bounds,
    kpi_range_report,
    negative_values,
    status_time_contradictions,
)
from tradewinds.operators.quality.values import (
    count_of_counts,
    mode_confidence,
    mode_confidence_summary,
    multi_mapped_keys,
    multi_mapped_values,
    normalisation_effect,
    null_blank_counts,
    numeric_profile,
    parse_failure_counts,
    row_filter_listing,
    string_shape,
    top_n_groups,
    value_distribution,
    value_share,
)

__all__ = [name for name in globals() if not name.startswith("_")]
