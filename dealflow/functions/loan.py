"""Loan and ROI column functions.

Every function maps Columns to a Column, so it runs inside whole-stage
codegen on any deal table without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import div_or_inf, floor_zero, safe_div


def _col(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def _payment_factor(r: Column, n: Column) -> Column:
    """Monthly payment per unit of principal ``r(1+r)^n / ((1+r)^n - 1)``."""
    growth = F.pow(F.lit(1.0) + r, n)
    return (r * growth, growth - F.lit(1.0))


def annual_debt_service(loan, annual_rate, amort_years) -> Column:
    """Annualised payment of a fully amortising monthly loan.

    loan <= 0 -> 0; zero rate -> straight line ``loan / years``.
    """
    loan, rate, years = _col(loan), _col(annual_rate), _col(amort_years)
    r = rate / F.lit(12.0)
    n = (years * F.lit(12)).cast("double")
    num, den = _payment_factor(r, n)
    monthly = safe_div(loan * num, den)
    return (F.when(loan <= 0, F.lit(0.0))
            .when(r == 0, safe_div(loan, years.cast("double")))
            .otherwise(monthly * F.lit(12.0)))


def remaining_balance(loan, annual_rate, amort_years, months_paid) -> Column:
    """R2: principal left after ``months_paid`` monthly payments (floored at 0)."""
    loan, rate, years = _col(loan), _col(annual_rate), _col(amort_years)
    months = _col(months_paid)
    r = rate / F.lit(12.0)
    n = years * F.lit(12)
    k = F.least(F.greatest(months.cast("int"), F.lit(0)), n.cast("int")).cast("double")
    n_d = n.cast("double")
    straight = floor_zero(loan - loan * safe_div(k, n_d))
    num, den = _payment_factor(r, n_d)
    pmt = safe_div(loan * num, den)
    grown = F.pow(F.lit(1.0) + r, k)
    bal = loan * grown - pmt * safe_div(grown - F.lit(1.0), r)
    return (F.when(loan <= 0, F.lit(0.0))
            .when(r == 0, straight)
            .otherwise(floor_zero(bal)))


ROI_FIELDS = (
    "loan_amount",
    "equity_required",
    "annual_debt_service",
    "annual_cash_flow",
    "cash_on_cash",
    "estimated_exit_value",
    "estimated_exit_proceeds_after_debt_and_costs",
)


def roi_columns(purchase_price, noi_next12, ltv, interest_rate, amort_years,
                exit_cap_rate, selling_cost_pct) -> dict[str, Column]:
    """One-year ROI snapshot as seven named Columns.

    Proceeds subtract the *original* loan (no paydown), as the reference does.
    """
    price, noi = _col(purchase_price), _col(noi_next12)
    ltv, rate, years = _col(ltv), _col(interest_rate), _col(amort_years)
    cap, sell = _col(exit_cap_rate), _col(selling_cost_pct)
    loan = price * ltv
    equity = price - loan
    ads = annual_debt_service(loan, rate, years)
    cash_flow = noi - ads
    exit_value = div_or_inf(noi, cap)
    proceeds = exit_value - exit_value * sell - loan
    return {
        "loan_amount": loan,
        "equity_required": equity,
        "annual_debt_service": ads,
        "annual_cash_flow": cash_flow,
        "cash_on_cash": div_or_inf(cash_flow, equity),
        "estimated_exit_value": exit_value,
        "estimated_exit_proceeds_after_debt_and_costs": proceeds,
    }
