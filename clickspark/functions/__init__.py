from clickspark.functions.numeric import (  # noqa: F401
    round_sql, round_np, ratio_or_null, ratio_or_zero, qcut_bucket,
    minute_boundaries, micros, seconds_between, whole_days_between,
    exact_sum, exact_avg, exact_parts, merge_parts, exact_value, ordered_key, flag, count_when,
)
