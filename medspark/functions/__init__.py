"""Column expressions: missing-value rules, scalar helpers, dose conversion."""

from medspark.functions.dose import (strength_per_single, volume_ddd, volume_mg,
                                     volume_singles)
from medspark.functions.scalars import (array_total, availability_flag, code_label,
                                        count_positive, extract_after, if_missing,
                                        month_label, month_start, parse_digits_date,
                                        percent_1dp, replace_first, sign_label,
                                        snake_case, snake_case_names, thousands,
                                        title_case, zero_unless)
from medspark.functions.semantics import (MISSING_LABEL, agg_sum, blank_to_null,
                                          count_distinct_na, cumsum_strict,
                                          dense_rank_na_last, exact_sum, explicit_missing, first_by,
                                          nan_to_null, null_safe_condition,
                                          round_half_even, running, safe_div, sum_na_rm,
                                          sum_sql, sum_strict, to_units, window_sum)

__all__ = [n for n in dir() if not n.startswith("_")]
