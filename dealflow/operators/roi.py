"""ROI snapshot over a scored deal table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import round_money, round_ratio
from ..functions.loan import ROI_FIELDS, roi_columns

DEFAULT_EXIT_CAP = 0.065
DEFAULT_SELLING_COST = 0.02

_RATIO_FIELDS = {"cash_on_cash"}


def roi_snapshot(scored: DataFrame, noi_col: str = "predicted_noi_next12",
                 exit_cap_rate=DEFAULT_EXIT_CAP, selling_cost_pct=DEFAULT_SELLING_COST,
                 keep: tuple[str, ...] = ("deal_id",), rounded: bool = False) -> DataFrame:
    """Append the seven ROI columns to every row of ``scored`` (narrow, no shuffle).

    ``exit_cap_rate`` / ``selling_cost_pct`` may be literals or column names.
    """
    def as_col(x):
        return F.col(x) if isinstance(x, str) else F.lit(float(x))

    cols = roi_columns("purchase_price", noi_col, "ltv", "interest_rate", "amort_years",
                       as_col(exit_cap_rate), as_col(selling_cost_pct))
    out = []
    for name in ROI_FIELDS:
        c = cols[name]
        if rounded:
            c = round_ratio(c) if name in _RATIO_FIELDS else round_money(c)
        out.append(c.alias(name))
    noi = F.col(noi_col)
    return scored.select(*keep, (round_money(noi) if rounded else noi).alias(noi_col), *out)
