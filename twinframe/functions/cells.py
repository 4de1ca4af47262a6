"""Typing of single cells: missing tokens, numbers, categories, decimals, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a missing cell, a number and a boolean in loose text.
MISSING_TOKENS = ("null", "continuous", "nan", "n/a", "undefined")
NUMBER_PATTERN = r"^-?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
STAMP_PATTERN = r"^\d{4}-[01]\d-[0-3]\dT[0-2]\d:[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-][0-2]\d:[0-5]\d)$"
NUMBER_STARTS = tuple("0123456789.-")
BOOLEAN_CELLS = ("true", "TRUE", "false", "FALSE")
NUMBER_LIMIT = float(2**53)

# The white space that is ignored around a token.
WHITE_SPACE = (
    " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_LONGEST_TOKEN = max(len(token) for token in MISSING_TOKENS)


def clean_text(cell: Column) -> Column:
    """NULL for empty cells and missing-value tokens, else the text unchanged."""
    token = F.btrim(cell, F.lit(WHITE_SPACE))
    # the length test spares long texts the change of case
    missing = (F.octet_length(token) <= _LONGEST_TOKEN) & F.lower(token).isin(*MISSING_TOKENS)
    return F.when((cell != "") & ~missing, cell)


def parse_number(cell: Column) -> Column:
    """The double a text cell spells, NULL when it is no plain finite number."""
    token = F.btrim(cell, F.lit(WHITE_SPACE))
    # the first character spares long texts the pattern
    spelled = F.substring(token, 1, 1).isin(*NUMBER_STARTS) & token.rlike(NUMBER_PATTERN)
    number = F.when(spelled, token.try_cast("double"))
    return F.when(F.abs(number) < NUMBER_LIMIT, number)


def number_text(number: Column) -> Column:
    """One text per number, so that ``1``, ``1.0`` and ``1e0`` are one category."""
    integral = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(integral, number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def parse_stamp(cell: Column) -> Column:
    """Milliseconds since 1970 of a full ISO time stamp with an offset; NULL for other texts and days that don't exist."""
    # the pattern comes after the length: most cells are no stamps
    full = F.octet_length(cell).between(17, 64) & cell.rlike(STAMP_PATTERN)
    # seconds may be left out: the minutes end at the sixteenth character
    seconds = F.when(F.substring(cell, 17, 1) == ":", cell).otherwise(F.concat(F.left(cell, F.lit(16)), F.lit(":00"), F.substr(cell, F.lit(17))))
    return F.unix_millis(F.when(full, seconds).try_cast("timestamp"))


def stamp_text(millis: Column) -> Column:
    """One text per instant, in UTC whatever the session's time zone."""
    day = 86_400_000
    within = F.pmod(millis, F.lit(day))
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(millis / day).cast("int")).cast("string")
    parts = [F.floor(within / 3_600_000), F.floor(within / 60_000) % 60, F.floor(within / 1000) % 60, within % 1000]
    return F.concat(date, F.format_string("T%02d:%02d:%02d.%03dZ", *parts))


def canonical_text(cell: Column, number: Column | None = None) -> Column:
    """The category a cleaned text cell stands for: equal numbers, truth values and instants have one text.

    ``number`` is what the cell spells, if that is a column already.
    """
    truth = F.when(cell.isin(*BOOLEAN_CELLS), F.lower(cell))
    number = parse_number(cell) if number is None else number
    return F.coalesce(number_text(number), truth, stamp_text(parse_stamp(cell)), cell)


def is_numeric_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def valid_number(name: str, data_type: T.DataType) -> Column:
    """A numeric column as double with NaN turned into NULL."""
    value = F.col(f"`{name}`").cast("double")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return value


def category_text(name: str, data_type: T.DataType) -> Column:
    """Any column as category text; NULL (and NaN) stay NULL, -0.0 equals 0.0."""
    column = F.col(f"`{name}`")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        column = F.when(column == 0, F.lit(0.0)).when(~F.isnan(column), column)
    return column.cast("string")


def decimal_places(number: Column) -> Column:
    """Digits after the point in the shortest decimal text of a number."""
    places = F.when(number.isNull() | (number == F.floor(number)), 0)
    # n / 10^p is the nearest double to a text with p digits: no text is needed to find few digits
    small = F.abs(number) < 1e11
    for p in range(1, 5):
        places = places.when(small & (F.rint(number * 10.0**p) / 10.0**p == number), p)
    text = number.cast("string")
    plain = F.rtrim(number.try_cast(T.DecimalType(38, 18)).cast("string"), F.lit("0"))  # for 1.0E-7 and such
    return places.when(~text.contains("E"), F.length(text) - F.instr(text, ".")).otherwise(
        F.coalesce(F.length(plain) - F.instr(plain, "."), F.lit(0))
    )


def round_half_up(number: Column) -> Column:
    """Round to an integer with ties towards plus infinity (-2.5 gives -2)."""
    # doubles of 2**52 and more hold no fraction, and floor() would overflow bigint
    return F.when(F.abs(number) < 2.0**52, F.floor(number + 0.5).cast("double")).otherwise(number)


def round_to_places(number: Column, places: int) -> Column:
    factor = F.lit(float(10**places))
    return round_half_up(number * factor) / factor
