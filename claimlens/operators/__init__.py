"""Reusable DataFrame operators the reports are built from."""

from claimlens.operators.aggregate import (  # noqa: F401
    count_by,
    outcome_rate,
    reaggregate,
    share_of_total,
    summary_stats,
)
from claimlens.operators.joins import preagg_left_join  # noqa: F401
from claimlens.operators.monthly import dual_date_monthly, month_pair_sums, sums_by_month  # noqa: F401
from claimlens.operators.numbering import number_rows, range_sizes, row_numbers, with_total  # noqa: F401
from claimlens.operators.profile import distinct_count, row_count, row_counts, table_profile  # noqa: F401
from claimlens.operators.quality import (  # noqa: F401
    Rule,
    cascade_delete,
    check_fk,
    check_unique,
    duplicate_keys,
    foreign_key_counts,
    key_violations,
    not_null_rules,
    orphan_counts,
    orphans,
    quarantine,
    tag_failures,
    violation_counts,
    violation_report,
    violations,
    write_quarantined,
)
from claimlens.operators.ranking import (  # noqa: F401
    dimension_usage,
    top_k,
    top_k_with_lookup,
    top_per_group,
)
