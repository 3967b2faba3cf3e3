"""The quarterly panel (flagship): interval facts -> one row per (id, year, quarter).

Steps (reference order kept): monthly panel (J1 J2 A1 J3 J4 J5) -> calendar
parts (P2) -> mask the target quarter (O5) -> fill gaps with the id's mean
(W1) -> quarterly roll-up (A4) -> seasonal and yearly means (W2 W3) -> row
key (P5).

Every step after the monthly panel is keyed by id first, so the whole chain
runs on the single id partitioning produced by ``monthly_panel``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.functions.scalar import row_key
from panelcraft.functions.scalar import with_calendar_parts
from panelcraft.operators.features import group_mean
from panelcraft.operators.impute import fill_group_mean
from panelcraft.operators.impute import mask_period
from panelcraft.operators.monthly import PointFacts
from panelcraft.operators.monthly import monthly_panel
from panelcraft.operators.rollup import rollup_period

# Fixed-point resolution of money in plans: 10**-8 currency units (cents x 10**6).
MONEY_SCALE = 8


def to_money_fixed(c: Column | str, decimals: int = 2) -> Column:
    """DOUBLE money with ``decimals`` decimals -> BIGINT in 10**-MONEY_SCALE units (exact)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col * F.lit(10**decimals)).cast("bigint") * F.lit(10 ** (MONEY_SCALE - decimals))


def from_fixed(c: Column | str, scale: int = MONEY_SCALE) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col / F.lit(float(10**scale))


def quarterly_from_monthly(
    monthly: DataFrame,
    *,
    value: str | None = None,
    fill_cols: list[str] = (),
    sum_cols: list[str] = (),
    mode_cols: list[str] = (),
    mask: tuple[int, int] | None = None,
    means: dict[str, tuple[str, list[str]]] | None = None,
    id_col: str = "id",
) -> DataFrame:
    """O5 -> W1 -> A4 -> W2/W3 -> P5 on a monthly (id, month) panel.

    ``value`` is masked (when ``mask`` is given) and filled; ``fill_cols``
    are filled; ``sum_cols`` are summed without filling (gaps count as 0);
    ``mode_cols`` roll up by their most frequent monthly value.
    """
    m = with_calendar_parts(monthly, "month")
    head = [value] if value else []
    if mask is not None and value:
        m = mask_period(m, [value], "year", "quarter", mask[0], mask[1])
    m = fill_group_mean(m, [*head, *fill_cols], [id_col])
    q = rollup_period(m, [id_col, "year", "quarter"], [*head, *fill_cols, *sum_cols], list(mode_cols))
    if means:
        q = group_mean(q, means)
    return q.withColumn("sid", row_key(id_col, "year", "quarter"))


def quarterly_panel(
    intervals: DataFrame,
    *,
    id_col: str,
    start: str,
    end: str,
    amount: str,
    lo: str,
    hi: str,
    mask: tuple[int, int] | None = None,
    points: list[PointFacts] | None = None,
    fill_points: list[str] = (),
    value: str = "y",
) -> DataFrame:
    monthly = monthly_panel(
        intervals, id_col=id_col, start=start, end=end, amount=amount, lo=lo, hi=hi, value=value, points=points
    )
    return quarterly_from_monthly(
        monthly,
        value=value,
        fill_cols=list(fill_points),
        mask=mask,
        means={"y_avg": (value, ["id", "quarter"]), "year_y_avg": (value, ["id", "year"])},
    )
