"""Cell-level expressions: missing values, text, numbers and dates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabcast.functions import sql
from tabcast.functions.words import MISSING_LABEL

# Date formats tried in order; a text must match the pattern and then parse.
DATE_FORMATS = (
    ("yyyy-MM-dd", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$"),
    ("yyyy/MM/dd", r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$"),
    ("dd/MM/yyyy", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"),
    ("MM/dd/yyyy", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"),
    ("dd-MM-yyyy", r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$"),
    ("yyyyMMdd", r"^[0-9]{8}$"),
)

UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "quarter": 91, "year": 365}
UNIT_MONTHS = {"month": 1, "quarter": 3, "year": 12}

_DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_date_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, _DATE_TYPES)


def is_integer_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INTEGER_TYPES)


def is_number_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere in this library."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select([F.nanvl(F.col(c), F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])


def spaced_name(name: str) -> str:
    return name.lower().translate(str.maketrans("_-", "  "))


def normalise_text(value: Column) -> Column:
    return F.lower(F.trim(value))


def compact(text: str) -> str:
    """SQL stand-in for a text in distinct counts: long texts shuffle as a SHA-256 of the whole text."""
    return f"if(length({text}) > 64, sha2({text}, 256), {text})"


def to_number(value: Column) -> Column:
    """Number or null, never an error."""
    number = value.try_cast("double")
    return F.nanvl(number, F.lit(None))


def parse_sql(text: str, fmt: str, pattern: str) -> str:
    """SQL timestamp of a text that matches one format, else null."""
    parsed = f"cast(try_to_timestamp({text}, {sql.text(fmt)}) as timestamp_ntz)"
    return f"case when {text} rlike {sql.text(pattern)} then {parsed} end"


def formats_sql(text: str) -> str:
    """SQL number with a bit for each date format that a text parses by; null for null.

    All formats start with a digit, so most plain texts are done after one look.
    """
    bits = " | ".join(f"if(({parse_sql(text, *f)}) is not null, {1 << i}, 0)" for i, f in enumerate(DATE_FORMATS))
    return f"case when {text} is null then null when ascii({text}) between 48 and 57 then {bits} else 0 end"


def parse_date(value: Column, formats=DATE_FORMATS) -> Column:
    """Timestamp (without zone) by the first format that fits, or null."""
    tries = [
        F.when(value.rlike(pattern), F.try_to_timestamp(value, F.lit(fmt)).cast("timestamp_ntz"))
        for fmt, pattern in formats
    ]
    return F.coalesce(*tries)


def whole_year(value: Column) -> Column:
    """True for a number that can be read as a calendar year."""
    return value.between(1000, 2999) & (value == F.floor(value))


def as_timestamp(value: Column, dtype: T.DataType) -> Column:
    """A date column of any storage type as a timestamp; years become 1 January."""
    if is_date_type(dtype):
        return value.cast("timestamp_ntz")
    if is_number_type(dtype):
        year = F.when(whole_year(value), value.cast("int"))
        return F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return parse_date(value.cast("string"))


def date_parts(stamp: Column) -> dict[str, Column]:
    """Year, month, day of week from Monday = 0, day of year; missing gives 0."""
    parts = {
        "year": F.year(stamp),
        "month": F.month(stamp),
        "dayofweek": F.weekday(stamp),
        "dayofyear": F.dayofyear(stamp),
    }
    return {name: F.coalesce(part, F.lit(0)) for name, part in parts.items()}


def shift_periods(start: Column, step: Column, unit: str, calendar: bool = False) -> Column:
    """Date ``step`` periods after ``start``; plain units have fixed day lengths."""
    if calendar and unit in UNIT_MONTHS:
        return F.add_months(start, step * UNIT_MONTHS[unit])
    return F.date_add(start, (step * UNIT_DAYS[unit]).cast("int"))


def label_text(value: Column) -> Column:
    """Text form of a value for the encoders."""
    return F.coalesce(value.cast("string"), F.lit(MISSING_LABEL))


def linspace(low: Column, high: Column, step: Column, steps: int) -> Column:
    if steps == 1:
        return low.cast("double")
    return low + step * ((high - low) / F.lit(float(steps - 1)))
