"""Column selection by type and scalar expressions shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Date layouts tried in this order when text is turned into a timestamp.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def temporal_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType))]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def normalise_name(name: str) -> str:
    return re.sub(r"[ -]", "_", name.strip())


def strip(column: Column | str) -> Column:
    """Text without the white space at its ends, tabs and line ends included."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL mean the same missing value from here on."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats})


def day_of(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("date")


def epoch_seconds(column: Column | str) -> Column:
    """Seconds since 1970-01-01 of the wall-clock reading, whatever the session time zone."""
    column = F.col(column) if isinstance(column, str) else column
    days = F.datediff(day_of(column), F.lit("1970-01-01").cast("date")).cast("double")
    seconds = F.hour(column) * 3600 + F.minute(column) * 60
    return days * 86400 + seconds + F.date_part(F.lit("SECOND"), column).cast("double")


def parse_measure(column: Column | str) -> Column:
    """Text such as ``$1,234.50`` or ``12%`` to a number; anything unreadable to NULL."""
    column = F.col(column) if isinstance(column, str) else column
    number = strip(F.translate(column.cast("string"), "$,%", "")).try_cast("double")
    return F.when(~F.isnan(number), number)


def parse_date(column: Column | str, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """Text to a timestamp by the first layout that fits; anything unreadable to NULL."""
    column = F.col(column) if isinstance(column, str) else column
    text = strip(column.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def row_digest(columns: Iterable[str]) -> Column:
    """A 256-bit digest of whole rows.

    Each field enters with its length, so neighbouring fields cannot run into each other, and NULL
    differs from every text.  Comparing digests moves 32 bytes per row instead of the row itself.
    """
    parts = []
    for name in columns:
        text = F.col("`" + name.replace("`", "``") + "`").cast("string")
        parts.append(F.when(text.isNull(), F.lit("-;")).otherwise(
            F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows that have both values; NULL when a side does not vary.

    ``corr`` divides by zero there, which is an error under ANSI rules.
    """
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))
