from tablescout.functions.columns import (
    boolean_columns,
    correlation,
    day_of,
    epoch_seconds,
    nan_to_null,
    normalise_name,
    numeric_columns,
    parse_date,
    parse_measure,
    row_digest,
    string_columns,
    strip,
    temporal_columns,
)
from tablescout.functions.names import name_similarity
from tablescout.functions.quantiles import column_quantiles, group_quantiles
from tablescout.functions.tails import chi2_sf, f_sf, t_ppf, t_two_sided

__all__ = [
    "boolean_columns", "chi2_sf", "column_quantiles", "correlation", "day_of", "epoch_seconds", "f_sf",
    "group_quantiles", "name_similarity", "nan_to_null", "normalise_name", "numeric_columns",
    "parse_date", "parse_measure", "row_digest", "string_columns", "strip", "t_ppf", "t_two_sided",
    "temporal_columns",
]
