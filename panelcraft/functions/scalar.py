"""Column -> Column helpers (projections and scalar functions).

Everything here is a built-in Spark expression, so it stays inside
whole-stage code generation. ANSI mode is on by default in Spark 4, so any
division or cast that can fail on real data uses a ``try_*`` form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_integral(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, IntegralType)


# ---------------------------------------------------------------- P1 / P2 / P3
def month_floor(c: ColumnOrName) -> Column:
    """Truncate a date or timestamp to the first day of its month (DATE)."""
    return F.trunc(_c(c).cast("date"), "MM")


def with_calendar_parts(
    df: DataFrame,
    month: str = "month",
    year_col: str = "year",
    month_col: str | None = None,
    quarter_col: str = "quarter",
) -> DataFrame:
    """Add integer year, (optional) month-of-year and quarter columns."""
    cols = {year_col: F.year(month), quarter_col: F.quarter(month)}
    if month_col:
        cols[month_col] = F.month(month)
    return df.withColumns(cols)


def year_of(c: ColumnOrName) -> Column:
    return F.year(_c(c))


# ------------------------------------------------------------------------- P4
# The unit suffix the capital text may carry (ten thousand).
AMOUNT_UNIT = "万"
# A plain decimal number: optional sign, digits with an optional fraction, or a bare fraction.
NUMERIC_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"


def parse_amount(c: ColumnOrName, unit: str = AMOUNT_UNIT, scale: int | None = None) -> Column:
    """Parse money text that may carry a unit suffix; NULL when unparseable.

    With ``scale`` the result is a BIGINT fixed-point value (``10**scale``
    units per whole), exact for inputs with at most ``scale`` decimals.
    """
    text = F.trim(F.regexp_replace(_c(c).cast("string"), unit, ""))
    ok = text.rlike(NUMERIC_PATTERN)
    if scale is None:
        return F.when(ok, text.try_cast("double"))
    as_dec = text.try_cast(f"decimal(38,{scale})")
    fixed = (as_dec * F.lit(10**scale)).try_cast("bigint")
    return F.when(ok, fixed)


def to_fixed(c: ColumnOrName, scale: int = 2) -> Column:
    """DOUBLE with at most ``scale`` decimals -> exact BIGINT units of 10**-scale."""
    return F.round(_c(c) * F.lit(10**scale)).cast("bigint")


# ------------------------------------------------------------------ P5 / P6
def row_key(id_col: ColumnOrName, year: ColumnOrName, quarter: ColumnOrName) -> Column:
    """``id || year || two-digit quarter`` as a string key."""
    return F.concat(
        _c(id_col).cast("bigint").cast("string"),
        _c(year).cast("int").cast("string"),
        F.lpad(_c(quarter).cast("int").cast("string"), 2, "0"),
    )


def parse_row_key(sid: ColumnOrName) -> dict[str, Column]:
    """Split a row key from the right, so ids of any width parse."""
    s = _c(sid).cast("string")
    n = F.length(s)
    return {
        "id": F.substring(s, F.lit(1), n - 6).try_cast("bigint"),
        "year": F.substring(s, n - 5, F.lit(4)).try_cast("int"),
        "quarter": F.substring(s, n - 1, F.lit(2)).try_cast("int"),
    }


# ------------------------------------------------------------------ P7 / P8
def tag_split(year: ColumnOrName, quarter: ColumnOrName, target_year: int, target_quarter: int) -> Column:
    """'predict' for the target period, else 'valid'."""
    return F.when(
        (_c(year) == F.lit(target_year)) & (_c(quarter) == F.lit(target_quarter)), F.lit("predict")
    ).otherwise(F.lit("valid"))


def in_period(year: ColumnOrName, quarter: ColumnOrName, target_year: int, target_quarter: int) -> Column:
    return (_c(year) == F.lit(target_year)) & (_c(quarter) == F.lit(target_quarter))


# ------------------------------------------------------------- P11 .. P14
def residual(label: ColumnOrName, prediction: ColumnOrName) -> dict[str, Column]:
    err = _c(label) - _c(prediction)
    return {"error": err, "error_abs": F.abs(err)}


def ratio(numerator: ColumnOrName, denominator: ColumnOrName, scale: float = 1.0) -> Column:
    """``numerator / scale / denominator``; NULL (not inf) on a zero denominator."""
    num = _c(numerator) if scale == 1.0 else _c(numerator) / F.lit(scale)
    return F.try_divide(num, _c(denominator))


def log1p(c: ColumnOrName) -> Column:
    return F.log1p(_c(c))


def square(c: ColumnOrName) -> Column:
    return F.pow(_c(c), F.lit(2))


# ------------------------------------------------------------------------- S4
def parse_compact_month(c: ColumnOrName) -> Column:
    """'yyyyMM' text or integer -> DATE at month start; NULL when unparseable."""
    return F.try_to_date(_c(c).cast("string"), "yyyyMM")
