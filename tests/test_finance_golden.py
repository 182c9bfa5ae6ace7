"""Golden values (FIXTURES.md section 4) for the loan, ROI, underwriting and pro forma operators."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from dealflow.functions.irr import irr
from dealflow.functions.loan import annual_debt_service, remaining_balance, roi_columns
from dealflow.operators.payloads import DEAL_PAYLOAD, INST_PAYLOAD
from dealflow.operators.proforma import proforma
from dealflow.operators.underwrite import underwrite

REL = 1e-6


def close(a, b, rel=REL, abs_=1e-4):
    return math.isclose(a, b, rel_tol=rel, abs_tol=abs_)


def test_debt_service_and_balance(spark):
    df = spark.range(1).select(
        annual_debt_service(F.lit(16_250_000.0), F.lit(0.062), F.lit(25)).alias("ads"),
        annual_debt_service(F.lit(16_250_000.0), F.lit(0.0), F.lit(25)).alias("ads0"),
        remaining_balance(F.lit(16_250_000.0), F.lit(0.062), F.lit(25), F.lit(60)).alias("b60"),
        remaining_balance(F.lit(16_250_000.0), F.lit(0.062), F.lit(25), F.lit(300)).alias("b300"),
        annual_debt_service(F.lit(-5.0), F.lit(0.062), F.lit(25)).alias("neg"),
    ).first()
    assert close(df.ads, 1280335.0874853714)
    assert df.ads0 == 650000.0
    assert close(df.b60, 14655510.302701421)
    assert abs(df.b300) <= 1e-6
    assert df.neg == 0.0


@pytest.mark.parametrize("noi,cf,coc,exit_v,proceeds", [
    (123456.0, -1156879.0874853714, -0.13221475285547102, 1899323.0769230768, -14388663.384615384),
    (1_000_000.0, -280335.0874853714, -0.03203829571261387, 15384615.384615384, -1173076.923076924),
    (2_000_000.0, 719664.9125146286, 0.08224741857310042, 30769230.769230768, 13903846.153846152),
])
def test_roi_snapshot(spark, noi, cf, coc, exit_v, proceeds):
    cols = roi_columns(F.lit(25e6), F.lit(noi), F.lit(0.65), F.lit(0.062), F.lit(25), F.lit(0.065), F.lit(0.02))
    r = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    assert close(r.annual_cash_flow, cf)
    assert close(r.cash_on_cash, coc)
    assert close(r.estimated_exit_value, exit_v)
    assert close(r.estimated_exit_proceeds_after_debt_and_costs, proceeds)


def test_irr_alone(spark):
    df = spark.createDataFrame([([-1e6, 1e5, 1e5, 1e5, 1e5, 1.5e6],), ([-5e5, -2e4, 3e4, 4e4, 5e4, 9e5],)],
                               "cfs array<double>")
    got = [r.x for r in df.select(irr("cfs").alias("x")).collect()]
    assert close(got[0], 0.15835347503800715, rel=1e-12)
    assert close(got[1], 0.15360678385065002, rel=1e-12)


def _deal_df(spark, **over):
    d = dict(DEAL_PAYLOAD, **over)
    cols = {k: v for k, v in d.items() if k not in ("units",)}
    return spark.createDataFrame([cols])


def test_underwrite_golden(spark):
    df = _deal_df(spark).withColumn("predicted_noi_next12", F.lit(2_000_000.0))
    r = underwrite(df).first()
    s = r.summary
    assert close(s.exit_value, 34631040.30769231)
    assert close(s.net_sale_proceeds, 19282909.19883704)
    assert close(s.irr_5yr, 0.24224650363144384, rel=1e-9)
    assert close(r.schedule[0].dscr, 1.5620910647134407)
    assert close(r.schedule[4].dscr, 1.7581472553572577)
    assert len(r.cash_flows) == 6


def test_proforma_golden(spark):
    r = proforma(_deal_df(spark), INST_PAYLOAD).first()
    sch = r.schedule
    for got, want in zip([x.occupancy for x in sch], [0.95, 0.87, 0.92, 0.97, 0.97]):
        assert close(got, want)
    for got, want in zip([x.noi for x in sch], [1030000, 880520, 1024510.6, 1176296.928, 1212410.91744]):
        assert close(got, want)
    for got, want in zip([x.debt_rate for x in sch], [0.062, 0.062, 0.077, 0.075, 0.075]):
        assert close(got, want)
    for got, want in zip([x.debt_service for x in sch],
                         [1007500, 1280335.087485, 1466495.835812, 908525.153952, 908525.153952]):
        assert close(got, want)
    for got, want in zip([x.loan_balance_end_year for x in sch],
                         [16250000, 15969276.758655, 15786195.155585, 10100044.619971, 9943721.748016]):
        assert close(got, want)
    assert close(sch[2].refi_cash_out, -5643540.215585)
    assert sch[1].refi_cash_out is None and sch[3].refi_value is None
    for got, want in zip(r.cash_flows, [-8750000, 22500, -649815.0875, -6085525.4514, 267771.774, 8639590.1553]):
        assert close(got, want)
    s = r.summary
    assert close(s.exit_value, 18652475.65292308)
    assert close(s.net_sale_proceeds, 8335704.391848711)
    assert close(s.irr, -0.1442050082196196, rel=1e-9)
    assert close(s.min_dscr, 0.6877262121507394)
    assert close(s.debt_yield_year1, 0.06338461538461539)
    assert close(s.breakeven_occupancy_year1, 0.9397727272727273)
    assert close(s.ltv_at_exit, 0.5331046630508589)
    assert close(s.cash_on_cash_year1, 0.0025714285714285713)


def test_proforma_without_shocks_or_refi(spark):
    a = replace(INST_PAYLOAD, occupancy_shock_year=None, rate_shock_year=None, refi_year=None)
    s = proforma(_deal_df(spark), a).first().summary
    assert close(s.net_sale_proceeds, 3264409.8578563444)
    assert close(s.irr, -0.2026708596500707, rel=1e-9)
    assert close(s.min_dscr, 0.8647111297827722)
    assert close(s.ltv_at_exit, 0.8049878504816722)
