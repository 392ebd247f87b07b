"""Column -> Column functions."""

from quarry.functions.scalars import *  # noqa: F401,F403
from quarry.functions.scalars import (SEASONS, all_of, any_of, avg_where, bands, clock_text,  # noqa: F401
                                      cut, cv, elapsed, eq_ci, first_token, fiscal_year_bounds,
                                      flag, hour_bin, in_fiscal_year, in_range, label_at, ne,
                                      not_sentinel, parse_clock, parse_percent, parse_tenure,
                                      parse_ts, ratio, round_bin, round_to, season, speed, to_type,
                                      date_parts, century_pivot)
