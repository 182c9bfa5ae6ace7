"""Registered portfolio queries over the driver tables and their DuckDB oracles.

Every query reads whole tables (through the ``deals`` view or the text
tables) and returns a flat DataFrame.  Money is rounded to 2 decimals and
ratios to 6 with the same binary rounding on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.roi import roi_snapshot
from ..session import pin_session
from ..sources.tables import deals, with_deals
from . import sqlgen as q

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_session(spark)
    return deals(spark, sf_dir)


# ---------------------------------------------------------------------------
# ROI snapshot with the realised NOI as the anchor prediction
# ---------------------------------------------------------------------------

_ROI_SQL = with_deals(f"""
SELECT deal_id,
       {q.money('noi_next12')} AS predicted_noi_next12,
       {q.money('purchase_price * ltv')} AS loan_amount,
       {q.money('purchase_price - purchase_price * ltv')} AS equity_required,
       {q.money(q.ads('purchase_price * ltv', 'interest_rate', 'amort_years'))} AS annual_debt_service,
       {q.money('noi_next12 - ' + q.ads('purchase_price * ltv', 'interest_rate', 'amort_years'))} AS annual_cash_flow,
       {q.ratio(q.inf_div('noi_next12 - ' + q.ads('purchase_price * ltv', 'interest_rate', 'amort_years'),
                          'purchase_price - purchase_price * ltv'))} AS cash_on_cash,
       {q.money(q.inf_div('noi_next12', '6.5e-2'))} AS estimated_exit_value,
       {q.money(q.inf_div('noi_next12', '6.5e-2') + ' - ' + q.inf_div('noi_next12', '6.5e-2') + ' * 2e-2 - purchase_price * ltv')}
         AS estimated_exit_proceeds_after_debt_and_costs
FROM deals
""")


@register("roi_snapshot", _ROI_SQL)
def q_roi_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _deals(spark, sf_dir).withColumnRenamed("noi_next12", "predicted_noi_next12")
    return roi_snapshot(d, rounded=True)


# ---------------------------------------------------------------------------
# U1-U6 simple underwriting, R4 IRR (hold 5, growth 3%, exit cap 6.5%, 2% selling)
# ---------------------------------------------------------------------------

def _uw_ctes(hold: int = 5, growth: str = "3e-2", cap: str = "6.5e-2", sell: str = "2e-2") -> str:
    return f"""
uw0 AS (
  SELECT deal_id, noi_next12 AS noi1, purchase_price * ltv AS loan,
         purchase_price - purchase_price * ltv AS equity, interest_rate AS rate, amort_years AS amort
  FROM deals),
uw1 AS (
  SELECT *, {q.ads('loan', 'rate', 'amort')} AS ads,
         list_transform(range(1, {hold} + 1), lambda y: noi1 * pow(1e0 + {growth}, y - 1)) AS noi
  FROM uw0),
uw2 AS (
  SELECT *, {q.inf_div('noi[len(noi)]', cap)} AS exit_value,
         {q.balance('loan', 'rate', 'amort', f'{hold} * 12')} AS bal
  FROM uw1),
uw3 AS (
  SELECT *, exit_value * {sell} AS selling, exit_value - exit_value * {sell} - bal AS net FROM uw2),
uw AS (
  SELECT *, list_concat([-equity], list_transform(noi, lambda n, i:
           CASE WHEN i = len(noi) THEN (n - ads) + net ELSE n - ads END)) AS cfs
  FROM uw3)
"""


def _uw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.partitioning import spread
    from ..operators.underwrite import underwrite
    d = _deals(spark, sf_dir).withColumnRenamed("noi_next12", "predicted_noi_next12")
    return underwrite(spread(d))


_UW_SUMMARY_SQL = with_deals(f"""
SELECT deal_id,
       {q.money('loan')} AS loan_amount, {q.money('equity')} AS equity_required,
       {q.money('ads')} AS annual_debt_service, {q.money('exit_value')} AS exit_value,
       {q.money('selling')} AS selling_costs, {q.money('bal')} AS remaining_loan_balance_at_sale,
       {q.money('net')} AS net_sale_proceeds, {q.ratio(q.irr('cfs'))} AS irr_5yr,
       {q.ratio(q.inf_div('noi[1] - ads', 'equity'))} AS cash_on_cash_year1
FROM uw
""", _uw_ctes())


@register("underwrite_summary", _UW_SUMMARY_SQL)
def q_underwrite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.common import round_money, round_ratio
    s = _uw(spark, sf_dir).select("deal_id", "summary.*")
    ratios = {"irr_5yr", "cash_on_cash_year1"}
    return s.select("deal_id", *[(round_ratio(F.col(c)) if c in ratios else round_money(F.col(c))).alias(c)
                                 for c in s.columns if c != "deal_id"])


_UW_SCHEDULE_SQL = with_deals(f"""
SELECT deal_id, CAST(y AS INTEGER) AS year, {q.money('noi[y]')} AS noi, {q.money('ads')} AS debt_service,
       {q.money('noi[y] - ads')} AS cash_flow, {q.ratio(q.inf_div('noi[y]', 'ads'))} AS dscr
FROM uw, range(1, 6) t(y)
""", _uw_ctes())


@register("underwrite_schedule", _UW_SCHEDULE_SQL)
def q_underwrite_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.common import round_money, round_ratio
    from ..operators.underwrite import schedule_long
    s = schedule_long(_uw(spark, sf_dir))
    return s.select("deal_id", "year", round_money(F.col("noi")).alias("noi"),
                    round_money(F.col("debt_service")).alias("debt_service"),
                    round_money(F.col("cash_flow")).alias("cash_flow"),
                    round_ratio(F.col("dscr")).alias("dscr"))


_IRR_SQL = with_deals(f"""
SELECT deal_id, CAST(periods AS BIGINT) AS periods, {q.ratio(q.irr('cfs'))} AS irr
FROM regrouped
""", _uw_ctes(), """
long_cf AS (SELECT deal_id, t.i - 1 AS t, cfs[t.i] AS cf FROM uw, range(1, len(cfs) + 1) t(i)),
regrouped AS (SELECT deal_id, list(cf ORDER BY t) AS cfs, count(*) AS periods FROM long_cf GROUP BY deal_id)
""")


@register("irr_portfolio", _IRR_SQL)
def q_irr_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 on a long (deal, t, cash flow) table: regroup in period order, then solve."""
    from ..functions.common import round_ratio
    from ..operators.cashflows import irr_from_long
    long_cf = _uw(spark, sf_dir).select("deal_id", F.posexplode("cash_flows").alias("t", "cf"))
    out = irr_from_long(long_cf, key="deal_id", period="t", amount="cf")
    return out.select("deal_id", "periods", round_ratio(F.col("irr")).alias("irr"))


# ---------------------------------------------------------------------------
# I1-I16 institutional pro forma with the reference's institutional payload
# ---------------------------------------------------------------------------

_PF_SRC = """
pf_src AS (
  SELECT deal_id, purchase_price AS price, ltv, interest_rate AS rate0, amort_years AS amort0,
         gross_rent_t12 AS rent1, opex_t12 AS opex1, occupancy_t12 AS occ1, gross_leasable_sqft AS sqft
  FROM deals)
"""


def _pf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.partitioning import spread
    from ..operators.payloads import INST_PAYLOAD
    from ..operators.proforma import proforma
    return proforma(spread(_deals(spark, sf_dir)), INST_PAYLOAD)


def _pf_oracle(body: str) -> str:
    from ..operators.payloads import INST_PAYLOAD_SQL
    return with_deals(body, _PF_SRC, q.proforma_ctes("pf_src", ["deal_id"], INST_PAYLOAD_SQL), recursive=True)


_PF_MONEY = ("loan_amount", "equity_required", "exit_value", "selling_costs",
             "remaining_loan_balance_at_sale", "net_sale_proceeds")
_PF_RATIO = ("irr", "cash_on_cash_year1", "min_dscr", "debt_yield_year1",
             "breakeven_occupancy_year1", "ltv_at_exit")

_PF_SUMMARY_SQL = _pf_oracle(f"""
SELECT sm.deal_id,
       {', '.join(q.money('sm.' + c) + ' AS ' + c for c in _PF_MONEY)},
       {q.ratio(q.irr('c.cfs'))} AS irr,
       {q.ratio('sm.cash_on_cash_year1')} AS cash_on_cash_year1,
       {q.ratio('c.min_dscr')} AS min_dscr,
       {q.ratio('sm.debt_yield_year1')} AS debt_yield_year1,
       {q.ratio('sm.breakeven_occupancy_year1')} AS breakeven_occupancy_year1,
       {q.ratio('sm.ltv_at_exit')} AS ltv_at_exit
FROM pf_sum sm JOIN pf_cf c ON sm.deal_id = c.deal_id
""")


@register("proforma_summary", _PF_SUMMARY_SQL)
def q_proforma_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.common import round_money, round_ratio
    s = _pf(spark, sf_dir).select("deal_id", "summary.*")
    return s.select("deal_id", *[round_money(F.col(c)).alias(c) for c in _PF_MONEY],
                    *[round_ratio(F.col(c)).alias(c) for c in _PF_RATIO])


_PF_SCHED_MONEY = ("gross_rent", "effective_rent", "opex", "taxes", "insurance", "capex_reserve",
                   "replacement_capex", "value_add_capex", "noi", "debt_service", "cash_flow",
                   "loan_balance_end_year", "refi_value", "refi_new_loan", "refi_payoff", "refi_cost",
                   "refi_cash_out")
_PF_SCHED_RATIO = ("occupancy", "dscr", "debt_rate")

_PF_SCHEDULE_SQL = _pf_oracle(f"""
SELECT deal_id, CAST(year AS INTEGER) AS year,
       {', '.join(q.money(c) + ' AS ' + c for c in _PF_SCHED_MONEY)},
       {', '.join(q.ratio(c) + ' AS ' + c for c in _PF_SCHED_RATIO)}
FROM pf_rows
""")


@register("proforma_schedule", _PF_SCHEDULE_SQL)
def q_proforma_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.common import round_money, round_ratio
    from ..operators.proforma import schedule_long
    s = schedule_long(_pf(spark, sf_dir))
    return s.select("deal_id", "year", *[round_money(F.col(c)).alias(c) for c in _PF_SCHED_MONEY],
                    *[round_ratio(F.col(c)).alias(c) for c in _PF_SCHED_RATIO])


# ---------------------------------------------------------------------------
# Scenario grids (reference smoke-test axes, per deal)
#   simple: prices [0.96 p, p] x exit caps [6.25%, 6.75%], max 50, by cash_on_cash
#   institutional: + rent growth [2%, 3%], occupancy drops [0, 10%], rate shock
#   [0, 150] bps -> 32 combinations, max 40, top 5 by irr, institutional payload
# ---------------------------------------------------------------------------

def _grid_deals(spark: SparkSession, sf_dir: str, institutional: bool) -> DataFrame:
    return _grid_axes(_deals(spark, sf_dir), institutional)


def _grid_axes(d: DataFrame, institutional: bool) -> DataFrame:
    axes = {
        "purchase_prices": F.array(F.col("purchase_price") * F.lit(0.96), F.col("purchase_price")),
        "exit_cap_rates": F.array(F.lit(0.0625), F.lit(0.0675)),
    }
    if institutional:
        axes.update({
            "rent_growths": F.array(F.lit(0.02), F.lit(0.03)),
            "occupancy_shock_drops": F.array(F.lit(0.0), F.lit(0.10)),
            "rate_shock_bps_values": F.array(F.lit(0.0), F.lit(150.0)),
        })
    return d.withColumns(axes)


_WS_MONEY = ("purchase_price", "predicted_noi_next12", "loan_amount", "equity_required", "annual_debt_service",
             "annual_cash_flow", "estimated_exit_value", "estimated_exit_proceeds_after_debt_and_costs")
_WS_RATIO = ("ltv", "interest_rate", "exit_cap_rate", "selling_cost_pct", "cash_on_cash")


@register("whatif_simple")
def q_whatif_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.common import round_money, round_ratio
    from ..operators.scenario import column_predictor, whatif_simple
    d = _grid_deals(spark, sf_dir, institutional=False)
    out = whatif_simple(d, column_predictor(F.col("noi_next12")), max_scenarios=50, sort_by="cash_on_cash")
    return out.select("deal_id", "rank", "scenario_ix", "grid_size", "truncated", "amort_years",
                      *[round_money(F.col(c)).alias(c) for c in _WS_MONEY],
                      *[round_ratio(F.col(c)).alias(c) for c in _WS_RATIO])


def _ws_sql() -> str:
    ads = q.ads("pp * ltv", "interest_rate", "amort_years")
    ev = q.inf_div("noi_next12", "ec")
    coc = q.inf_div(f"noi_next12 - {ads}", "pp - pp * ltv")
    return with_deals(f"""
SELECT deal_id, CAST(row_number() OVER (PARTITION BY deal_id ORDER BY isnan(coc_raw), coc_raw DESC NULLS LAST, ix)
                AS INTEGER) AS rank,
       ix AS scenario_ix, grid_size, grid_size > 50 AS truncated, amort_years,
       {q.money('pp')} AS purchase_price, {q.money('noi_next12')} AS predicted_noi_next12,
       {q.money('pp * ltv')} AS loan_amount, {q.money('pp - pp * ltv')} AS equity_required,
       {q.money(ads)} AS annual_debt_service, {q.money(f'noi_next12 - {ads}')} AS annual_cash_flow,
       {q.money(ev)} AS estimated_exit_value,
       {q.money(f'{ev} - {ev} * 2e-2 - pp * ltv')} AS estimated_exit_proceeds_after_debt_and_costs,
       {q.ratio('ltv')} AS ltv, {q.ratio('interest_rate')} AS interest_rate, {q.ratio('ec')} AS exit_cap_rate,
       {q.ratio('2e-2')} AS selling_cost_pct, {q.ratio('coc_raw')} AS cash_on_cash
FROM (
  SELECT g.*, {coc} AS coc_raw FROM (
    SELECT a.*, pl[i1 + 1] AS pp, el[i4 + 1] AS ec, i1 * len(el) + i4 AS ix,
           CAST(len(pl) * len(el) AS BIGINT) AS grid_size
    FROM (SELECT *, list_sort(list_distinct([purchase_price * 96e-2, purchase_price])) AS pl,
                    list_sort(list_distinct([625e-4, 675e-4])) AS el FROM deals) a,
         range(0, len(a.pl)) r1(i1), range(0, len(a.el)) r4(i4)
  ) g WHERE ix < 50
)
""")


ORACLES["whatif_simple"] = _ws_sql()

_WI_MONEY = ("purchase_price", "predicted_noi_next12", "loan_amount", "equity_required", "exit_value",
             "selling_costs", "remaining_loan_balance_at_sale", "net_sale_proceeds", "capex_reserve_per_sqft",
             "replacement_capex_per_sqft", "rate_shock_bps")
_WI_RATIO = ("ltv", "interest_rate", "exit_cap_rate", "rent_growth", "occupancy_shock_drop", "irr",
             "cash_on_cash_year1", "min_dscr", "debt_yield_year1", "breakeven_occupancy_year1", "ltv_at_exit")


def _by_parts(c) -> Column:
    """``c`` by way of a lambda: Spark compiles a projection with one in methods of its own, where the roundings of a wide row would else be one method too long to be compiled."""
    return F.get(F.transform(F.array(c), lambda x: x), F.lit(0))


def _topn_columns() -> list:
    from ..functions.common import round_money, round_ratio
    # a row without a scenario has rank 0 and scenario -1
    return [_by_parts(F.coalesce("rank", F.lit(0))).alias("rank"), F.coalesce("scenario_ix", F.lit(-1).cast("bigint")).alias("scenario_ix"), "grid_size",
            F.coalesce("truncated", F.lit(False)).alias("truncated"), *[round_money(F.col(c)).alias(c) for c in _WI_MONEY],
            *[round_ratio(F.col(c)).alias(c) for c in _WI_RATIO]]


@register("whatif_inst_topn")
def q_whatif_inst_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's outcome; one that can't be underwritten has a row with the reason."""
    from ..operators.payloads import INST_PAYLOAD
    from ..operators.scenario import column_predictor, whatif_inst
    from ..operators.validate import validate
    d = validate(_grid_axes(_intake(spark, sf_dir), institutional=True))
    res = whatif_inst(d, column_predictor(F.col("noi_next12")), INST_PAYLOAD,
                      max_scenarios=40, top_n=5, sort_by="irr", errors="errors")
    return res.outcomes.select("deal_id", "status", "error", *_topn_columns())


def _wi_parts(anchor: str, rel: str = "deals", cap: str = "40", top: str = "5", by: str = "irr_raw", join: str = "") -> tuple[str, str, str]:
    """Source CTE, pro forma CTEs and body of the top-n query over ``rel``; ``anchor`` is the prediction in terms of wi_src ``s``."""
    from ..operators.payloads import INST_PAYLOAD_SQL
    knobs = dict(INST_PAYLOAD_SQL, exit_cap="s.ec", rent_growth="s.rg", shock_drop="s.od", bps="s.bps")
    by_key = "NULL" if by == "irr_raw" else "d.sort_by"
    src = f"""
wi_src AS (
  SELECT deal_id, ix, cap, top, by_key, grid_size, noi_next12, price, ltv, rate0, amort0, rent1, opex1, occ1, sqft, ec, rg, od, bps
  FROM (
    SELECT d.deal_id, {cap} AS cap, {top} AS top, {by_key} AS by_key, d.noi_next12, d.ltv, d.interest_rate AS rate0, d.amort_years AS amort0,
           d.gross_rent_t12 AS rent1, d.opex_t12 AS opex1, d.occupancy_t12 AS occ1, d.gross_leasable_sqft AS sqft,
           [d.purchase_price * 96e-2, d.purchase_price][i1 + 1] AS price,
           [625e-4, 675e-4][i4 + 1] AS ec, [2e-2, 3e-2][i5 + 1] AS rg, [0e0, 10e-2][i8 + 1] AS od,
           [0e0, 150e0][i9 + 1] AS bps,
           (((i1 * 2 + i4) * 2 + i5) * 2 + i8) * 2 + i9 AS ix, CAST(32 AS BIGINT) AS grid_size
    FROM {rel} d, range(0, 2) a(i1), range(0, 2) b(i4), range(0, 2) c(i5), range(0, 2) e(i8), range(0, 2) f(i9)
  ) WHERE ix < cap)
"""
    body = f"""
SELECT * EXCLUDE (irr_raw, top) FROM (
  SELECT sm.deal_id, 'ok' AS status, NULL::VARCHAR AS error,
         CAST(row_number() OVER (PARTITION BY sm.deal_id ORDER BY isnan({by}), {by} DESC NULLS LAST, sm.ix)
              AS INTEGER) AS rank,
         sm.ix AS scenario_ix, s.grid_size, s.grid_size > s.cap AS truncated,
         {q.money('s.price')} AS purchase_price, {q.money(anchor)} AS predicted_noi_next12,
         {', '.join(q.money('sm.' + c) + ' AS ' + c for c in _PF_MONEY)},
         {q.money('25e-2')} AS capex_reserve_per_sqft, {q.money('15e-2')} AS replacement_capex_per_sqft,
         {q.money('s.bps')} AS rate_shock_bps,
         {q.ratio('s.ltv')} AS ltv, {q.ratio('s.rate0')} AS interest_rate, {q.ratio('s.ec')} AS exit_cap_rate,
         {q.ratio('s.rg')} AS rent_growth, {q.ratio('s.od')} AS occupancy_shock_drop,
         {q.ratio('irr_raw')} AS irr, {q.ratio('sm.cash_on_cash_year1')} AS cash_on_cash_year1,
         {q.ratio('c.min_dscr')} AS min_dscr, {q.ratio('sm.debt_yield_year1')} AS debt_yield_year1,
         {q.ratio('sm.breakeven_occupancy_year1')} AS breakeven_occupancy_year1,
         {q.ratio('sm.ltv_at_exit')} AS ltv_at_exit, irr_raw, s.top
  FROM pf_sum sm
  JOIN (SELECT *, {q.irr('cfs')} AS irr_raw FROM pf_cf) c ON sm.deal_id = c.deal_id AND sm.ix = c.ix
  JOIN wi_src s ON sm.deal_id = s.deal_id AND sm.ix = s.ix {join}
  WHERE irr_raw IS NOT NULL
) WHERE rank <= top
"""
    return src, q.proforma_ctes("wi_src", ["deal_id", "ix"], knobs), body


def _wi_sql() -> str:
    src, pf, body = _wi_parts("s.noi_next12")
    empty = ", ".join(f"NULL AS {c}" for c in (*_WI_MONEY, *_WI_RATIO))
    order = ("gross_leasable_sqft", "purchase_price", "noi_t12", "opex_t12", "gross_rent_t12")
    return with_deals(f"""
SELECT * FROM ({body})
UNION ALL BY NAME
SELECT deal_id, 'invalid' AS status, '{'; '.join(f'{c} is required' for c in order)}' AS error, 0 AS rank, CAST(-1 AS BIGINT) AS scenario_ix,
       CAST(32 AS BIGINT) AS grid_size, false AS truncated, {empty}
FROM intake WHERE gross_rent_t12 IS NULL
""", src, pf, recursive=True)


ORACLES["whatif_inst_topn"] = _wi_sql()


# ---------------------------------------------------------------------------
# P1-P5 quarantine over a dirty deals view; P11 ROI from feature maps
#   dirty: ltv := 1.5 when k%13=0, amort_years := 0 when k%17=0,
#          property_type := NULL when k%19=0 (k = order key); all rows kept
# ---------------------------------------------------------------------------

def _order_key() -> "F.Column":
    return F.substring("deal_id", 2, 9).cast("bigint")


def _intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import intake
    pin_session(spark)
    return intake(spark, sf_dir)


def dirty_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a request; those without lineitems lack price, size and income."""
    k = _order_key()
    d = _intake(spark, sf_dir)
    return d.withColumns({
        "ltv": F.when(k % 13 == 0, F.lit(1.5)).otherwise(F.col("ltv")),
        "amort_years": F.when(k % 17 == 0, F.lit(0)).otherwise(F.col("amort_years")),
        "property_type": F.when(k % 19 == 0, F.lit(None).cast("string")).otherwise(F.col("property_type")),
    })


_DIRTY_SQL = """
dirty AS (
  SELECT * REPLACE (
    CASE WHEN CAST(substr(deal_id, 2) AS BIGINT) % 13 = 0 THEN 1.5e0 ELSE ltv END AS ltv,
    CASE WHEN CAST(substr(deal_id, 2) AS BIGINT) % 17 = 0 THEN 0 ELSE amort_years END AS amort_years,
    CASE WHEN CAST(substr(deal_id, 2) AS BIGINT) % 19 = 0 THEN NULL ELSE property_type END AS property_type)
  FROM intake)
"""


@register("validate_quarantine")
def q_validate_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.validate import validate
    v = validate(dirty_deals(spark, sf_dir))
    return v.select("deal_id", "status", F.size("errors").cast("int").alias("n_errors"),
                    F.array_join("errors", "; ").alias("errors"),
                    F.col("exit_cap_rate").alias("exit_cap_rate"),
                    F.col("selling_cost_pct").alias("selling_cost_pct"))


ORACLES["validate_quarantine"] = with_deals("""
SELECT deal_id, CASE WHEN len(errs) = 0 THEN 'accepted' ELSE 'quarantined' END AS status,
       CAST(len(errs) AS INTEGER) AS n_errors, array_to_string(errs, '; ') AS errors,
       6.5e-2 AS exit_cap_rate, 2e-2 AS selling_cost_pct
FROM (
  SELECT deal_id, list_filter([
      CASE WHEN property_type IS NULL THEN 'property_type is required' END,
      CASE WHEN city IS NULL THEN 'city is required' END,
      CASE WHEN state IS NULL THEN 'state is required' END,
      CASE WHEN zip IS NULL THEN 'zip is required' END,
      CASE WHEN year_built IS NULL THEN 'year_built is required' END,
      CASE WHEN gross_leasable_sqft IS NULL THEN 'gross_leasable_sqft is required' END,
      CASE WHEN purchase_price IS NULL THEN 'purchase_price is required' END,
      CASE WHEN noi_t12 IS NULL THEN 'noi_t12 is required' END,
      CASE WHEN occupancy_t12 IS NULL THEN 'occupancy_t12 is required' END,
      CASE WHEN opex_t12 IS NULL THEN 'opex_t12 is required' END,
      CASE WHEN gross_rent_t12 IS NULL THEN 'gross_rent_t12 is required' END,
      CASE WHEN ltv IS NULL THEN 'ltv is required' END,
      CASE WHEN interest_rate IS NULL THEN 'interest_rate is required' END,
      CASE WHEN amort_years IS NULL THEN 'amort_years is required' END,
      CASE WHEN ltv < 0 OR ltv > 1 OR isnan(ltv) THEN 'ltv must be between 0.0 and 1.0' END,
      CASE WHEN interest_rate < 0 OR interest_rate > 1 OR isnan(interest_rate)
           THEN 'interest_rate must be between 0.0 and 1.0' END,
      CASE WHEN amort_years < 1 OR amort_years > 40 THEN 'amort_years must be between 1 and 40' END
    ], x -> x IS NOT NULL) AS errs
  FROM dirty)
""", _DIRTY_SQL).replace("x -> x IS NOT NULL", "lambda x: x IS NOT NULL")


@register("conditional_roi_map")
def q_conditional_roi_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROI only when the feature map carries all four financing inputs.

    Maps: amort_years key absent when k%7=0, ltv value null when k%11=0.
    """
    from ..functions.common import round_money, round_ratio
    from ..functions.loan import roi_columns
    from ..operators.validate import roi_inputs_from_map
    k = _order_key()
    d = _deals(spark, sf_dir)
    base = ["purchase_price", F.col("purchase_price").cast("string"),
            "ltv", F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("ltv").cast("string")),
            "interest_rate", F.col("interest_rate").cast("string")]
    full = F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in base],
                        F.lit("amort_years"), F.col("amort_years").cast("string"))
    short = F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in base])
    feats = d.select("deal_id", F.col("noi_next12").alias("predicted_noi_next12"),
                     F.when(k % 7 == 0, short).otherwise(full).alias("features"))
    typed, complete = roi_inputs_from_map(F.col("features"))
    roi = roi_columns(typed["purchase_price"], F.col("predicted_noi_next12"), typed["ltv"],
                      typed["interest_rate"], typed["amort_years"], F.lit(0.065), F.lit(0.02))
    return feats.select(
        "deal_id", complete.alias("has_roi"), round_money(F.col("predicted_noi_next12")).alias("predicted_noi_next12"),
        *[F.when(complete, round_money(roi[c])).alias(c) for c in
          ("loan_amount", "annual_debt_service", "annual_cash_flow", "estimated_exit_value")],
        F.when(complete, round_ratio(roi["cash_on_cash"])).alias("cash_on_cash"),
    )


def _crm_sql() -> str:
    pp, ltv, ir, am = ("TRY_CAST(m['purchase_price'] AS DOUBLE)", "TRY_CAST(m['ltv'] AS DOUBLE)",
                       "TRY_CAST(m['interest_rate'] AS DOUBLE)", "CAST(TRY_CAST(m['amort_years'] AS DOUBLE) AS INTEGER)")
    ads = q.ads(f"{pp} * {ltv}", ir, am)
    ok = f"({pp} IS NOT NULL AND {ltv} IS NOT NULL AND {ir} IS NOT NULL AND {am} IS NOT NULL)"
    return with_deals(f"""
SELECT deal_id, {ok} AS has_roi, {q.money('noi_next12')} AS predicted_noi_next12,
       CASE WHEN {ok} THEN {q.money(f'{pp} * {ltv}')} END AS loan_amount,
       CASE WHEN {ok} THEN {q.money(ads)} END AS annual_debt_service,
       CASE WHEN {ok} THEN {q.money(f'noi_next12 - {ads}')} END AS annual_cash_flow,
       CASE WHEN {ok} THEN {q.money(q.inf_div('noi_next12', '6.5e-2'))} END AS estimated_exit_value,
       CASE WHEN {ok} THEN {q.ratio(q.inf_div(f'noi_next12 - {ads}', f'{pp} - {pp} * {ltv}'))} END AS cash_on_cash
FROM (
  SELECT deal_id, noi_next12,
         CASE WHEN CAST(substr(deal_id, 2) AS BIGINT) % 7 = 0
              THEN MAP {{'purchase_price': CAST(purchase_price AS VARCHAR), 'ltv': lv,
                         'interest_rate': CAST(interest_rate AS VARCHAR)}}
              ELSE MAP {{'purchase_price': CAST(purchase_price AS VARCHAR), 'ltv': lv,
                         'interest_rate': CAST(interest_rate AS VARCHAR), 'amort_years': CAST(amort_years AS VARCHAR)}}
         END AS m
  FROM (SELECT *, CASE WHEN CAST(substr(deal_id, 2) AS BIGINT) % 11 = 0 THEN NULL
                       ELSE CAST(ltv AS VARCHAR) END AS lv FROM deals))
""")


ORACLES["conditional_roi_map"] = _crm_sql()


# ---------------------------------------------------------------------------
# Requests with knobs of their own (P1-P5, W2, W5, W9, W11, W12, I1-I16):
# every order asks with its own horizon, growth, shocks, refinancing, limits
# and ranking key, some of them outside the rules (k = order key).
# ---------------------------------------------------------------------------

#: name -> (Spark SQL and DuckDB expression over k, the order key as BIGINT)
_KNOBS = {
    "exit_cap_rate": "CASE WHEN k % 43 = 0 THEN 0e0 ELSE 5e-2 + (k % 30) * 1e-3 END",
    "selling_cost_pct": "(k % 7) * 5e-3",
    "hold_years": "CAST(CASE WHEN k % 37 = 0 THEN 31 ELSE 1 + k % 12 END AS INTEGER)",
    "interest_only_years": "CAST(k % 4 AS INTEGER)",
    "rent_growth": "(k % 13 - 2) * 1e-2",
    "opex_inflation": "CASE WHEN k % 5 = 0 THEN NULL ELSE (k % 5) * 1e-2 END",
    "occupancy_target": "8e-1 + (k % 16) * 1e-2",
    "occupancy_reversion_years": "CAST(1 + k % 5 AS INTEGER)",
    "taxes_year1": "(k % 9) * 1e4",
    "reassess_year": "CAST(1 + k % 4 AS INTEGER)",
    "reassess_taxes": "k % 2 = 0",
    "capex_reserve_per_sqft": "(k % 3) * 1e-1",
    "occupancy_shock_year": "CAST(CASE WHEN k % 3 = 0 THEN NULL ELSE 1 + k % 5 END AS INTEGER)",
    "occupancy_shock_drop": "CASE WHEN k % 47 = 0 THEN 12e-1 ELSE (k % 5) * 5e-2 END",
    "occupancy_recovery_years": "CAST(1 + k % 3 AS INTEGER)",
    "rate_shock_year": "CAST(CASE WHEN k % 4 = 1 THEN NULL ELSE 1 + k % 6 END AS INTEGER)",
    "rate_shock_bps": "(k % 4) * 5e1",
    "refi_year": "CAST(CASE WHEN k % 4 = 0 THEN NULL ELSE 1 + k % 9 END AS INTEGER)",
    "refi_ltv": "(k % 6) * 1e-1",
    "refi_rate": "(k % 2) * 55e-3",
    "refi_amort_years": "CAST(20 + k % 11 AS INTEGER)",
    "max_scenarios": "CAST((k % 23) * 30 AS INTEGER)",
    "top_n": "CAST(1 + k % 3 AS INTEGER)",
    "sort_by": "CASE k % 7 WHEN 0 THEN 'irr' WHEN 1 THEN 'min_dscr' WHEN 2 THEN 'debt_yield_year1' WHEN 3 THEN 'net_sale_proceeds' "
               "WHEN 4 THEN 'cash_on_cash_year1' WHEN 5 THEN 'best' END",
}
_K_SQL = "CAST(substr(deal_id, 2) AS BIGINT)"


def _varied(df: DataFrame) -> DataFrame:
    """The knobs, a year map as text (one in 29 with a bad year) and an axis that one in 41 leaves empty."""
    d = df.withColumn("k", _order_key()).withColumns({n: F.expr(e) for n, e in _KNOBS.items()})
    return d.withColumns({
        "value_add_capex": F.when(F.col("k") % 29 == 0, F.create_map(F.lit("soon"), F.lit("1000"))).when(
            F.col("k") % 3 == 0, F.create_map(F.lit("2"), F.lit("25000"), F.lit("4"), (F.col("k") % 100 * 100).cast("string"))),
        "rent_growths": F.when(F.col("k") % 41 == 0, F.array().cast("array<double>")).when(F.col("k") % 2 == 0, F.array(F.lit(0.02), F.lit(0.04))),
    }).drop("k")


def _varied_ctes(src: str = "intake") -> str:
    return f"""
varied AS (
  SELECT *, {', '.join(f'{e} AS {n}' for n, e in _KNOBS.items())},
         CASE WHEN k % 29 = 0 THEN NULL WHEN k % 3 = 0 THEN MAP {{2: 25000e0, 4: CAST(k % 100 * 100 AS DOUBLE)}} END AS years,
         CASE WHEN k % 41 = 0 THEN []::DOUBLE[] WHEN k % 2 = 0 THEN [2e-2, 4e-2] END AS rent_growths
  FROM (SELECT *, {_K_SQL} AS k FROM {src}))"""


def _rules_sql(ranges, extra: tuple = ()) -> str:
    from ..operators.validate import REQUIRED_FIELDS, range_message
    checks = [f"CASE WHEN {c} IS NULL THEN '{c} is required' END" for c in REQUIRED_FIELDS]
    for name, low, high, _default in ranges:
        bad = " OR ".join([f"{name} < {low}"] * (low is not None) + [f"{name} > {high}"] * (high is not None))
        checks.append(f"CASE WHEN {bad} THEN '{range_message(name, low, high)}' END")
    return f"list_filter([{', '.join((*checks, *extra))}], lambda x: x IS NOT NULL)"


def _rules_for(kind: str) -> str:
    from ..operators import validate as v
    known = {*_KNOBS, "ltv", "interest_rate", "amort_years"}
    inst = [r for r in (*v.DEAL_RANGES, *v.INST_RANGES) if r[0] in known]
    capex = "CASE WHEN k % 29 = 0 THEN 'value_add_capex: keys are years and values are amounts' END"
    if kind == "underwriting":
        return _rules_sql([*v.DEAL_RANGES, *[r for r in v.UNDERWRITE_RANGES if r[0] in known]])
    if kind == "simple grid":
        return _rules_sql([*v.DEAL_RANGES, *v.GRID_RANGES])
    if kind == "institutional":
        return _rules_sql(inst, (capex,))
    return _rules_sql([*inst, *v.INST_GRID_RANGES], (
        capex, "CASE WHEN len(rent_growths) = 0 THEN 'rent_growths: given, but without a value' END",
        "CASE WHEN sort_by NOT IN ('irr', 'min_dscr', 'debt_yield_year1', 'net_sale_proceeds', 'cash_on_cash_year1') "
        "THEN 'sort_by: none of cash_on_cash_year1, debt_yield_year1, irr, min_dscr, net_sale_proceeds' END"))


_REQUEST_KINDS = ("underwriting", "simple grid", "institutional", "institutional grid")


@register("validate_requests", with_deals(" UNION ALL ".join(f"""
SELECT deal_id, '{kind}' AS request, CASE WHEN len(errs) = 0 THEN 'accepted' ELSE 'quarantined' END AS status, array_to_string(errs, '; ') AS errors
FROM (SELECT deal_id, {_rules_for(kind)} AS errs FROM varied)""" for kind in _REQUEST_KINDS), _varied_ctes()))
def q_validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1-P5 for each kind of request: rules on knobs, limits, ranking key, axes and year map; every order is there."""
    from ..operators.validate import validate_institutional, validate_simple_grid, validate_underwriting
    d = _varied(_intake(spark, sf_dir))
    kinds = dict(zip(_REQUEST_KINDS, (validate_underwriting, validate_simple_grid, validate_institutional,
                                      lambda x: validate_institutional(x, grid=True))))
    out = None
    for kind, check in kinds.items():
        own = check(d).select("deal_id", F.lit(kind).alias("request"), "status", F.array_join("errors", "; ").alias("errors"))
        out = own if out is None else out.unionByName(own)
    return out


def _outcome_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty orders with limits and a ranking key of their own; the rules on required fields only, so amort_years 0 reaches the grid."""
    from ..operators.validate import validate
    k = _order_key()
    keys = F.array(*[F.lit(x) for x in ("irr", "min_dscr", "debt_yield_year1", "net_sale_proceeds", "cash_on_cash_year1")])
    d = _grid_axes(dirty_deals(spark, sf_dir), institutional=True).withColumns({
        "cap": (k % 45).cast("int"), "top": (1 + k % 3).cast("int"),
        "sort_by": F.when(k % 31 == 0, F.lit("best")).otherwise(F.get(keys, (k % 5).cast("int")))})
    return validate(d, ranges=())


@register("whatif_inst_outcomes")
def q_whatif_inst_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request's outcome under its own cap, top-n and ranking key: ok, invalid, too_big or all_failed."""
    from ..operators.payloads import INST_PAYLOAD
    from ..operators.scenario import column_predictor, whatif_inst
    res = whatif_inst(_outcome_requests(spark, sf_dir), column_predictor(F.col("noi_next12")), INST_PAYLOAD,
                      max_scenarios=F.col("cap"), top_n=F.col("top"), sort_by=F.col("sort_by"), errors="errors")
    error = F.col("error")
    samples = (F.length(error) - F.length(F.replace(error, F.lit('"scenario_ix"'), F.lit("")))) / 13
    return res.outcomes.select("deal_id", "status", F.substring_index("error", ": {", 1).alias("error"),
                               F.coalesce(samples, F.lit(0)).cast("int").alias("error_samples"), *_topn_columns())


def _outcomes_sql() -> str:
    from ..operators.validate import REQUIRED_FIELDS
    keys = "['irr', 'min_dscr', 'debt_yield_year1', 'net_sale_proceeds', 'cash_on_cash_year1']"
    rules = [f"CASE WHEN {c} IS NULL THEN '{c} is required' END" for c in REQUIRED_FIELDS]
    rules += ["CASE WHEN cap < 1 THEN 'max_scenarios: from 1 to 500' END",
              f"CASE WHEN sort_by = 'best' THEN 'sort_by: none of {', '.join(sorted(x.strip(chr(39)) for x in keys[1:-1].split(', ')))}' END"]
    asked = f"""
asked AS (
  SELECT *, CASE WHEN len(errs) > 0 THEN 'invalid' WHEN 32 > 5 * cap THEN 'too_big' WHEN amort_years = 0 THEN 'all_failed' ELSE 'ok' END AS status
  FROM (SELECT *, list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL) AS errs FROM (
    SELECT *, CAST(k % 45 AS BIGINT) AS cap, 1 + k % 3 AS top, CASE WHEN k % 31 = 0 THEN 'best' ELSE ({keys})[k % 5 + 1] END AS sort_by
    FROM (SELECT *, {_K_SQL} AS k FROM dirty)))),
able AS (SELECT * FROM asked WHERE status = 'ok')"""
    by = ("(CASE s.by_key WHEN 'min_dscr' THEN c.min_dscr WHEN 'debt_yield_year1' THEN sm.debt_yield_year1 "
          "WHEN 'net_sale_proceeds' THEN sm.net_sale_proceeds WHEN 'cash_on_cash_year1' THEN sm.cash_on_cash_year1 ELSE irr_raw END)")
    src, pf, body = _wi_parts("s.noi_next12", rel="able", cap="d.cap", top="d.top", by=by)
    empty = ", ".join(f"NULL AS {c}" for c in (*_WI_MONEY, *_WI_RATIO))
    return with_deals(f"""
SELECT *, 0 AS error_samples FROM ({body})
UNION ALL BY NAME
SELECT deal_id, status, CASE status WHEN 'invalid' THEN array_to_string(errs, '; ')
         WHEN 'too_big' THEN 'grid of 32 scenarios; ' || (5 * cap) || ' are allowed, so shorten the axes'
         ELSE 'no scenario could be computed; the first errors' END AS error,
       CASE WHEN status = 'all_failed' THEN least(5, cap, 32) ELSE 0 END AS error_samples,
       0 AS rank, CAST(-1 AS BIGINT) AS scenario_ix, CAST(32 AS BIGINT) AS grid_size, false AS truncated, {empty}
FROM asked WHERE status <> 'ok'
""", _DIRTY_SQL, asked, src, pf, recursive=True)


ORACLES["whatif_inst_outcomes"] = _outcomes_sql()


_VARIED_KNOBS_SQL = {
    "hold": "s.hold_years", "exit_cap": "s.exit_cap_rate", "sell": "s.selling_cost_pct", "io_years": "s.interest_only_years",
    "rent_growth": "s.rent_growth", "opex_infl": "coalesce(s.opex_inflation, 3e-2)", "occ_target": "s.occupancy_target",
    "reversion": "s.occupancy_reversion_years", "taxes1": "s.taxes_year1", "reassess": "s.reassess_taxes", "reassess_year": "s.reassess_year",
    "reserve_psf": "s.capex_reserve_per_sqft", "value_add": "s.years", "shock_year": "s.occupancy_shock_year", "shock_drop": "s.occupancy_shock_drop",
    "recovery": "s.occupancy_recovery_years", "rate_shock_year": "s.rate_shock_year", "bps": "s.rate_shock_bps", "refi_year": "s.refi_year",
    "refi_ltv": "s.refi_ltv", "refi_rate": "s.refi_rate", "refi_amort": "s.refi_amort_years",
}
_VARIED_SRC = f"""
pf_src AS (
  SELECT *, purchase_price AS price, interest_rate AS rate0, amort_years AS amort0, gross_rent_t12 AS rent1, opex_t12 AS opex1,
         occupancy_t12 AS occ1, gross_leasable_sqft AS sqft
  FROM varied WHERE len({_rules_for('institutional')}) = 0)"""


def _assumption_columns(**more):
    """The institutional knobs as columns of the request."""
    from dataclasses import fields

    from ..operators.proforma import InstAssumptions
    return InstAssumptions(**{f.name: f.name for f in fields(InstAssumptions) if f.name != "extra"} | more)


@register("proforma_varied", with_deals(f"""
SELECT sm.deal_id, {', '.join(q.money('sm.' + c) + ' AS ' + c for c in _PF_MONEY)},
       {q.ratio('sm.cash_on_cash_year1')} AS cash_on_cash_year1, {q.ratio('c.min_dscr')} AS min_dscr,
       {q.ratio('sm.debt_yield_year1')} AS debt_yield_year1, {q.ratio('sm.breakeven_occupancy_year1')} AS breakeven_occupancy_year1,
       {q.ratio('sm.ltv_at_exit')} AS ltv_at_exit
FROM pf_sum sm JOIN pf_cf c ON sm.deal_id = c.deal_id
""", _varied_ctes(), _VARIED_SRC, q.proforma_ctes("pf_src", ["deal_id"], _VARIED_KNOBS_SQL), recursive=True))
def q_proforma_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: accepted institutional requests, each with its own horizon, interest-only years, shocks, refinancing and reassessment.

    The rate of return is left to ``proforma_summary``: some of these requests have none, and
    where Newton's method runs away the last bit of a power decides where to.
    """
    from ..functions.common import round_money, round_ratio
    from ..operators.partitioning import spread
    from ..operators.proforma import proforma
    from ..operators.validate import validate_institutional
    accepted = validate_institutional(_varied(_intake(spark, sf_dir))).filter("status = 'accepted'")
    s = proforma(spread(accepted), _assumption_columns()).select("deal_id", "summary.*")
    return s.select("deal_id", *[round_money(F.col(c)).alias(c) for c in _PF_MONEY],
                    *[round_ratio(F.col(c)).alias(c) for c in _PF_RATIO if c != "irr"])


# ---------------------------------------------------------------------------
# T1-T4 splits and folds, A1-A4 aggregates (naive predictor: noi_t12)
# ---------------------------------------------------------------------------

def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.split import time_split
    return time_split(_deals(spark, sf_dir))


_SPLIT_CTE = """
ordered AS (SELECT *, row_number() OVER (ORDER BY asof_date, deal_id) - 1 AS row_ix, count(*) OVER () AS n FROM deals),
cut AS (SELECT GREATEST(1, LEAST(CAST(floor(max(n) * (1e0 - 2e-1)) AS BIGINT), max(n) - 1)) AS cut FROM ordered),
split AS (SELECT o.*, CASE WHEN o.row_ix < c.cut THEN 'train' ELSE 'test' END AS split FROM ordered o, cut c)
"""
_FOLD_CTE = """
ntr AS (SELECT count(*) AS n_train FROM split WHERE split = 'train'),
kk AS (SELECT n_train, GREATEST(2, LEAST(8, n_train - 1)) AS k FROM ntr),
bounds AS (SELECT f AS fold, n_train - (k - f + 1) * (n_train // (k + 1)) AS vs,
                  n_train - (k - f) * (n_train // (k + 1)) AS ve
           FROM kk, range(1, k + 1) t(f)),
folds AS (SELECT s.*, b.fold, CASE WHEN s.row_ix < b.vs THEN 'train' ELSE 'val' END AS role
          FROM split s JOIN bounds b ON s.row_ix < b.ve WHERE s.split = 'train')
"""


@register("time_split", with_deals("SELECT deal_id, CAST(asof_date AS VARCHAR) AS asof_date, CAST(row_ix AS BIGINT) AS row_ix, split FROM split",
                                   _SPLIT_CTE))
def q_time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("deal_id", F.col("asof_date").cast("string").alias("asof_date"), "row_ix", "split")


@register("ts_folds", with_deals("SELECT deal_id, CAST(row_ix AS BIGINT) AS row_ix, CAST(fold AS INTEGER) AS fold, role "
                                 "FROM folds", _SPLIT_CTE, _FOLD_CTE))
def q_ts_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.split import walk_forward
    return walk_forward(_split(spark, sf_dir)).select("deal_id", "row_ix", F.col("fold").cast("int"), "role")


def _metric_sql(e: str, y: str, n: str, rounded: bool = True) -> str:
    r = q.ratio if rounded else (lambda x: x)
    return (f"{r(f'avg(abs({e}))')} AS mae, {r(f'sqrt(avg(({e}) * ({e})))')} AS rmse, "
            f"{r(f'CASE WHEN {n} >= 2 AND var_pop({y}) <> 0 THEN 1e0 - avg(({e}) * ({e})) / var_pop({y}) END')} AS r2")


_FOLD_REPORT_SQL = with_deals(f"""
SELECT CAST(fold AS INTEGER) AS fold, CAST(count_if(role = 'train') AS BIGINT) AS train_n,
       CAST(count_if(role = 'val') AS BIGINT) AS val_n,
       CAST(min(CASE WHEN role = 'train' THEN asof_date END) AS VARCHAR) AS train_start,
       CAST(max(CASE WHEN role = 'train' THEN asof_date END) AS VARCHAR) AS train_end,
       CAST(min(CASE WHEN role = 'val' THEN asof_date END) AS VARCHAR) AS val_start,
       CAST(max(CASE WHEN role = 'val' THEN asof_date END) AS VARCHAR) AS val_end,
       {_metric_sql("CASE WHEN role = 'val' THEN noi_next12 - noi_t12 END", "CASE WHEN role = 'val' THEN noi_next12 END",
                    "CAST(count_if(role = 'val') AS DOUBLE)")}
FROM folds GROUP BY fold
""", _SPLIT_CTE, _FOLD_CTE)


def _fold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.split import fold_report, walk_forward
    return fold_report(walk_forward(_split(spark, sf_dir)), pred_col="noi_t12")


@register("fold_report", _FOLD_REPORT_SQL)
def q_fold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.common import round_ratio
    r = _fold_report(spark, sf_dir)
    return r.select(F.col("fold").cast("int"), "train_n", "val_n",
                    *[F.col(c).cast("string").alias(c) for c in ("train_start", "train_end", "val_start", "val_end")],
                    *[round_ratio(F.col(c)).alias(c) for c in ("mae", "rmse", "r2")])


_PROFILE_STATS = ("target_mean", "target_std", "target_min", "target_p25", "target_p50", "target_p75", "target_max")


@register("split_profile", with_deals(f"""
SELECT split, count(*) AS rows, CAST(min(asof_date) AS VARCHAR) AS date_min, CAST(max(asof_date) AS VARCHAR) AS date_max,
       count(noi_next12) AS target_count,
       {q.money('avg(noi_next12)')} AS target_mean, {q.money('stddev_samp(noi_next12)')} AS target_std,
       {q.money('min(noi_next12)')} AS target_min,
       {q.money('quantile_cont(noi_next12, 0.25)')} AS target_p25,
       {q.money('quantile_cont(noi_next12, 0.5)')} AS target_p50,
       {q.money('quantile_cont(noi_next12, 0.75)')} AS target_p75,
       {q.money('max(noi_next12)')} AS target_max
FROM split GROUP BY split
""", _SPLIT_CTE))
def q_split_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.common import round_money
    from ..operators.split import split_profile
    p = split_profile(_split(spark, sf_dir))
    return p.select("split", "rows", F.col("date_min").cast("string").alias("date_min"),
                    F.col("date_max").cast("string").alias("date_max"), "target_count",
                    *[round_money(F.col(c)).alias(c) for c in _PROFILE_STATS])


@register("regression_metrics", with_deals(f"""
SELECT split, 'naive_t12' AS model, count(*) AS n,
       {_metric_sql('noi_next12 - noi_t12', 'noi_next12', 'CAST(count(*) AS DOUBLE)')}
FROM split GROUP BY split
""", _SPLIT_CTE))
def q_regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 per split for the naive predictor (next-12 NOI = trailing NOI)."""
    from ..functions.common import round_ratio
    from ..operators.metrics import regression_metrics
    m = regression_metrics(_split(spark, sf_dir), "noi_next12", "noi_t12", by=("split",))
    return m.select("split", F.lit("naive_t12").alias("model"), "n",
                    *[round_ratio(F.col(c)).alias(c) for c in ("mae", "rmse", "r2")])


@register("cv_summary", with_deals(f"""
SELECT 'naive_t12' AS model, {q.ratio('avg(mae)')} AS mae_mean, {q.ratio('stddev_samp(mae)')} AS mae_std,
       {q.ratio('avg(rmse)')} AS rmse_mean, {q.ratio('stddev_samp(rmse)')} AS rmse_std
FROM fr
""", _SPLIT_CTE, _FOLD_CTE, f"""
fr AS (SELECT fold, {_metric_sql("CASE WHEN role = 'val' THEN noi_next12 - noi_t12 END",
                                 "CASE WHEN role = 'val' THEN noi_next12 END",
                                 "CAST(count_if(role = 'val') AS DOUBLE)", rounded=False)} FROM folds GROUP BY fold)
"""))
def q_cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: mean and sample std of the fold metrics per model."""
    from ..functions.common import round_ratio
    r = _fold_report(spark, sf_dir).withColumn("model", F.lit("naive_t12"))
    s = r.groupBy("model").agg(F.avg("mae").alias("mae_mean"), F.stddev_samp("mae").alias("mae_std"),
                               F.avg("rmse").alias("rmse_mean"), F.stddev_samp("rmse").alias("rmse_std"))
    return s.select("model", *[round_ratio(F.col(c)).alias(c) for c in ("mae_mean", "mae_std", "rmse_mean", "rmse_std")])


@register("dataset_profile", with_deals("""
SELECT count(*) AS row_count, CAST(18 AS INTEGER) AS n_columns,
       'deal_id,asof_date,property_type,city,state,zip,year_built,gross_leasable_sqft,units,purchase_price,noi_t12,occupancy_t12,opex_t12,gross_rent_t12,ltv,interest_rate,amort_years,noi_next12' AS columns,
       CAST(min(asof_date) AS VARCHAR) AS asof_date_min, CAST(max(asof_date) AS VARCHAR) AS asof_date_max
FROM deals
"""))
def q_dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.metrics import dataset_profile
    p = dataset_profile(_deals(spark, sf_dir)).drop("generated_at_utc")
    return p.withColumns({c: F.col(c).cast("string") for c in ("asof_date_min", "asof_date_max")})


_DEAL_TEXT = ("deal_id", "asof_date", "property_type", "city", "state", "zip", "year_built", "amort_years")
_DEAL_NUMBERS = ("gross_leasable_sqft", "units", "purchase_price", "noi_t12", "occupancy_t12", "opex_t12", "gross_rent_t12",
                 "ltv", "interest_rate", "noi_next12")


def _fingerprint_sql() -> str:
    texts = [f"CAST({c} AS VARCHAR)" for c in _DEAL_TEXT]
    texts += [f"CAST(CAST(floor({c} * 1e4 + 0.5e0) AS BIGINT) AS VARCHAR)" for c in _DEAL_NUMBERS]
    row = " || ".join(f"coalesce(length({t}) || ':' || {t}, 'null;')" for t in texts)
    return with_deals(f"""
SELECT count(*) AS n_rows,
       CAST(sum(CAST(('0x' || substr(sha256({row}), 1, 15))::UBIGINT AS DECIMAL(38,0))) AS VARCHAR) AS fingerprint
FROM deals
""")


@register("row_fingerprint", _fingerprint_sql())
def q_row_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 (table form) over all 18 columns; numbers enter with four decimals, which both engines form alike."""
    from ..operators.metrics import table_fingerprint
    cols = [F.col(c) for c in _DEAL_TEXT] + [F.floor(F.col(c) * 1e4 + 0.5).cast("bigint") for c in _DEAL_NUMBERS]
    return table_fingerprint(_deals(spark, sf_dir), cols)


# ---------------------------------------------------------------------------
# X1, X2, X3-X5, X7 over `documents`
#   files: document d is stored as doc_<d><ext>, ext by language
#          (en .txt, fr .md, de .log, other .pdf = not a text format)
#   path lists by d % 4: none | comma list | ';' and newline list | JSON list
# ---------------------------------------------------------------------------

_WS_SQL = r"[\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_WS_SQL}', ' ', 'g'))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import read_table
    pin_session(spark)
    return read_table(spark, sf_dir, "documents")


def _doc_paths(doc_id) -> "F.Column":
    d = F.col(doc_id) if isinstance(doc_id, str) else doc_id

    def p(off, ext):
        return F.concat(F.lit("doc_"), (d + off).cast("string"), F.lit(ext))
    m = d % 4
    return (F.when(m == 1, F.concat(p(1, ".txt"), F.lit(", "), p(2, ".md")))
            .when(m == 2, F.concat(p(1, ".log"), F.lit(";"), p(3, ".txt"), F.lit("\n"), p(0, ".csv")))
            .when(m == 3, F.concat(F.lit('["'), p(2, ".txt"), F.lit('", " '), p(0, ".md"), F.lit(' ", "notes_'),
                                   d.cast("string"), F.lit('"]'))))


_DOC_PATHS_SQL = """
CASE doc_id % 4
  WHEN 1 THEN 'doc_' || (doc_id + 1) || '.txt, doc_' || (doc_id + 2) || '.md'
  WHEN 2 THEN 'doc_' || (doc_id + 1) || '.log;doc_' || (doc_id + 3) || '.txt' || chr(10) || 'doc_' || doc_id || '.csv'
  WHEN 3 THEN '["doc_' || (doc_id + 2) || '.txt", " doc_' || doc_id || '.md ", "notes_' || doc_id || '"]'
END"""

_PARSE_SQL = """
CASE WHEN raw IS NULL OR trim(raw) = '' THEN []::VARCHAR[]
     WHEN trim(raw) LIKE '[%]' AND json_valid(trim(raw)) AND json_type(trim(raw)) = 'ARRAY'
       THEN list_filter(list_transform(json_extract_string(trim(raw), '$[*]'), lambda x: trim(x)), lambda x: x <> '')
     ELSE list_filter(list_transform(string_split(replace(replace(trim(raw), chr(10), ','), ';', ','), ','),
                                     lambda x: trim(x)), lambda x: x <> '')
END"""


@register("normalize_text", f"""
SELECT doc_id, {_norm_sql('text')} AS text_norm, CAST(length({_norm_sql('text')}) AS INTEGER) AS n_chars
FROM documents
""")
def q_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import normalize_text
    n = normalize_text(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", n.alias("text_norm"), F.length(n).alias("n_chars"))


@register("path_list", f"""
SELECT doc_id, CAST(len(p) AS INTEGER) AS n_paths, array_to_string(p, '|') AS paths
FROM (SELECT doc_id, {_PARSE_SQL} AS p FROM (SELECT doc_id, {_DOC_PATHS_SQL} AS raw FROM documents))
""")
def q_path_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import parse_document_paths
    p = parse_document_paths(_doc_paths("doc_id"))
    return _docs(spark, sf_dir).select("doc_id", F.size(p).alias("n_paths"), F.array_join(p, "|").alias("paths"))


def _doc_files(docs: DataFrame) -> DataFrame:
    ext = (F.when(F.col("lang") == "en", F.lit(".txt")).when(F.col("lang") == "fr", F.lit(".md"))
           .when(F.col("lang") == "de", F.lit(".log")).otherwise(F.lit(".pdf")))
    return docs.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ext).alias("path"), "text")


@register("combine_text", f"""
WITH files AS (
  SELECT 'doc_' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.md' WHEN 'de' THEN '.log'
                                       ELSE '.pdf' END AS path, text FROM documents),
rows AS (SELECT doc_id, source, {_PARSE_SQL} AS p FROM (SELECT doc_id, source, {_DOC_PATHS_SQL} AS raw FROM documents)),
refs AS (SELECT doc_id, unnest(p) AS path, generate_subscripts(p, 1) AS pos FROM rows),
st AS (
  SELECT r.doc_id, r.pos,
         CASE WHEN f.path IS NULL THEN 'missing'
              WHEN lower(regexp_extract(r.path, '(\\.[^./\\\\]+)$', 1)) NOT IN ('.txt', '.md', '.csv', '.json', '.log')
                THEN 'unsupported' ELSE 'ok' END AS status,
         {_norm_sql('f.text')} AS t
  FROM refs r LEFT JOIN files f ON r.path = f.path),
agg AS (
  SELECT doc_id, count(*) AS n_paths, count_if(status = 'ok') AS n_docs_ok,
         string_agg(CASE WHEN status = 'ok' AND t <> '' THEN left(t, 50000) END, ' ' ORDER BY pos) AS docs_text
  FROM st GROUP BY doc_id),
comb AS (
  SELECT r.doc_id, CAST(coalesce(a.n_paths, 0) AS INTEGER) AS n_paths, CAST(coalesce(a.n_docs_ok, 0) AS BIGINT) AS n_docs_ok,
         left(concat_ws(' ', nullif({_norm_sql('r.source')}, ''), a.docs_text), 50000) AS txt
  FROM rows r LEFT JOIN agg a ON r.doc_id = a.doc_id)
SELECT doc_id, n_paths, n_docs_ok, CAST(length(txt) AS INTEGER) AS text_len, sha256(txt) AS text_sha256 FROM comb
""".replace("\\\\.", "\\."))
def q_combine_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document row, notes (``source``) + referenced documents, lenient."""
    from ..operators.documents import combine_text
    docs = _docs(spark, sf_dir)
    rows = docs.select("doc_id", "source", _doc_paths("doc_id").alias("document_paths"))
    c = combine_text(rows, _doc_files(docs), "doc_id", "source", "document_paths")
    t = F.col("unstructured_text")
    return c.select("doc_id", F.col("n_paths").cast("int"), F.col("n_docs_ok").cast("long"),
                    F.length(t).alias("text_len"), F.sha2(t, 256).alias("text_sha256"))


_TFIDF_SQL = f"""
WITH tok AS (SELECT doc_id, regexp_extract_all(lower({_norm_sql('text')}), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM documents),
grams AS (SELECT doc_id, unnest(list_concat(t, CASE WHEN len(t) >= 2 THEN
            list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE []::VARCHAR[] END)) AS term FROM tok),
counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term),
stats AS (SELECT term, count(*) AS df, sum(tf) AS ctf FROM counts GROUP BY term HAVING count(*) >= 2),
vocab AS (SELECT term, df FROM stats ORDER BY ctf DESC, term ASC LIMIT 4000),
nd AS (SELECT count(*) AS n FROM documents),
w AS (SELECT c.doc_id, c.term, c.tf * (ln((1e0 + nd.n) / (1e0 + v.df)) + 1e0) AS w
      FROM counts c JOIN vocab v ON c.term = v.term, nd),
nw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)
""".replace("\\\\p", "\\p")


@register("tfidf_matrix", _TFIDF_SQL + f"SELECT doc_id, term, {q.ratio('weight')} AS weight FROM nw")
def q_tfidf_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sparse matrix, a row for each document and vocabulary term in it."""
    from ..functions.common import round_ratio
    from ..operators.tfidf import tfidf
    w = tfidf(_docs(spark, sf_dir), "doc_id", "text")
    return w.select("doc_id", "term", round_ratio(F.col("weight")).alias("weight"))


@register("tfidf_top_terms", _TFIDF_SQL + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term ASC) AS rank FROM nw)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, {q.ratio('weight')} AS weight FROM rk WHERE rank <= 5
""")
def q_tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.common import round_ratio
    from ..operators.tfidf import tfidf, top_terms
    w = tfidf(_docs(spark, sf_dir), "doc_id", "text")
    t = top_terms(w, "doc_id", 5)
    return t.select("doc_id", "rank", "term", round_ratio(F.col("weight")).alias("weight"))


# ---------------------------------------------------------------------------
# F1, F2, F4 fit statistics on the train split
# ---------------------------------------------------------------------------

NUMERIC_FEATURES = ("year_built", "gross_leasable_sqft", "units", "purchase_price", "noi_t12", "occupancy_t12",
                    "opex_t12", "gross_rent_t12", "ltv", "interest_rate", "amort_years")
CATEGORICAL_FEATURES = ("property_type", "city", "state", "zip")


@register("impute_scale_stats")
def q_impute_scale_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.common import round_ratio
    from ..operators.features import categorical_modes, numeric_stats
    train = _split(spark, sf_dir).filter(F.col("split") == "train")
    num = numeric_stats(train, NUMERIC_FEATURES).select(
        "feature", F.lit("numeric").alias("kind"), *[round_ratio(F.col(c)).alias(c) for c in ("median", "mean", "scale")],
        F.lit(None).cast("string").alias("mode"))
    cat = categorical_modes(train, CATEGORICAL_FEATURES).select(
        "feature", F.lit("categorical").alias("kind"), *[F.lit(None).cast("double").alias(c) for c in
                                                          ("median", "mean", "scale")], "mode")
    return num.unionByName(cat)


def _impute_sql() -> str:
    nums = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM train" for c in NUMERIC_FEATURES)
    cats = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM train" for c in CATEGORICAL_FEATURES)
    return with_deals(f"""
SELECT feature, 'numeric' AS kind, {q.ratio('med')} AS median,
       {q.ratio('avg(coalesce(value, med))')} AS mean,
       {q.ratio('CASE WHEN stddev_pop(coalesce(value, med)) = 0 THEN 1e0 ELSE stddev_pop(coalesce(value, med)) END')} AS scale,
       NULL::VARCHAR AS mode
FROM nl JOIN (SELECT feature, quantile_cont(value, 0.5) AS med FROM nl GROUP BY feature) m USING (feature)
GROUP BY feature, med
UNION ALL
SELECT feature, 'categorical', NULL, NULL, NULL, first(value ORDER BY n DESC, value ASC) FROM (
  SELECT feature, value, count(*) AS n FROM cl WHERE value IS NOT NULL GROUP BY feature, value)
  GROUP BY feature
""", _SPLIT_CTE, f"train AS (SELECT * FROM split WHERE split = 'train')", f"nl AS ({nums})", f"cl AS ({cats})")


ORACLES["impute_scale_stats"] = _impute_sql()


# ---------------------------------------------------------------------------
# F6-F14 models.  The ridge candidate is checked against normal equations in
# SQL; no SQL engine fits the trees (rows-only checks).
# ---------------------------------------------------------------------------

_MODEL_COLUMNS = ", ".join((*CATEGORICAL_FEATURES, *NUMERIC_FEATURES))
_FIT_TRAIN = f"SELECT 0 AS grp, row_ix AS rid, {_MODEL_COLUMNS}, noi_next12 AS y FROM split WHERE split = 'train'"


def _ridge_sql(body: str, fit: str = _FIT_TRAIN, score: str = _FIT_TRAIN.replace("'train'", "'test'"), more: tuple = (), first: tuple = ()) -> str:
    return with_deals(body, _SPLIT_CTE, *first, *q.ridge_ctes(fit, score, CATEGORICAL_FEATURES, NUMERIC_FEATURES), *more, recursive=True)


def _train_test(spark: SparkSession, sf_dir: str):
    s = _split(spark, sf_dir)
    return s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")


@register("model_holdout_metrics", _ridge_sql(f"""
SELECT 'ridge' AS model, count(*) AS n, {_metric_sql('y - pred', 'y', 'CAST(count(*) AS DOUBLE)')} FROM rg_pred
"""))
def q_model_holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ridge candidate on the chronological holdout."""
    from ..functions.common import round_ratio
    from ..operators.models import fit_candidate
    from ..operators.metrics import regression_metrics
    train, test = _train_test(spark, sf_dir)
    model = fit_candidate("ridge", train, CATEGORICAL_FEATURES, NUMERIC_FEATURES)
    m = regression_metrics(model(test), "noi_next12", "predicted_noi_next12")
    return m.select(F.lit("ridge").alias("model"), "n", *[round_ratio(F.col(c)).alias(c) for c in ("mae", "rmse", "r2")])


@register("model_comparison")
def q_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge vs gradient-boosted trees on the chronological holdout."""
    from ..operators.models import holdout_compare
    train, test = _train_test(spark, sf_dir)
    _fitted, metrics = holdout_compare(train, test, CATEGORICAL_FEATURES, NUMERIC_FEATURES)
    return metrics.select("model", "candidate_order", "n", "mae", "rmse", "r2", "best")


@register("cv_backtest")
def q_cv_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """walk-forward backtest of the tree candidate over the train split's folds."""
    from ..operators.models import walk_forward_backtest
    return walk_forward_backtest(_split(spark, sf_dir), CATEGORICAL_FEATURES, NUMERIC_FEATURES, model="gbt")


@register("ridge_backtest", _ridge_sql(f"""
SELECT 'ridge' AS model, CAST(grp AS INTEGER) AS split, any_value(train_n) AS train_n, count(*) AS val_n,
       {_metric_sql('y - pred', 'y', 'CAST(count(*) AS DOUBLE)')}
FROM rg_pred JOIN (SELECT grp AS g, count(*) AS train_n FROM rg_fit GROUP BY grp) ON grp = g GROUP BY grp
""", *[f"SELECT fold AS grp, row_ix AS rid, {_MODEL_COLUMNS}, noi_next12 AS y FROM folds WHERE role = '{r}'" for r in ("train", "val")],
                                       first=(_FOLD_CTE,)))
def q_ridge_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 for the ridge candidate: all folds from one table of statistics."""
    from ..functions.common import round_ratio
    from ..operators.models import walk_forward_backtest
    cv = walk_forward_backtest(_split(spark, sf_dir), CATEGORICAL_FEATURES, NUMERIC_FEATURES, model="ridge")
    return cv.select("model", "split", "train_n", "val_n", *[round_ratio(F.col(c)).alias(c) for c in ("mae", "rmse", "r2")])


IMPORTANCE_REPEATS, IMPORTANCE_SEED = 10, 42


def _importance_sql() -> str:
    from ..operators.permute import permuted_sql, round_keys
    features = (*CATEGORICAL_FEATURES, *NUMERIC_FEATURES)
    draws = ", ".join(f"('{f}', {r}, {round_keys(IMPORTANCE_SEED, f, r)}::BIGINT[][])" for f in features for r in range(IMPORTANCE_REPEATS))
    return _ridge_sql(f"""
SELECT feature, {q.whole('avg(d)')} AS importance_mean, {q.whole('stddev_pop(d)')} AS importance_std, any_value(n) AS n_test FROM (
  SELECT e.feature, e.repeat, avg(abs(e.y - e.pred + o.part - g.part)) - any_value(b.mae) AS d, any_value(b.n) AS n
  FROM moved e JOIN rg_part o ON o.rid = e.rid AND o.col = e.feature
  JOIN numbered s ON s.pos = e.source JOIN rg_part g ON g.rid = s.rid AND g.col = e.feature, base b
  GROUP BY e.feature, e.repeat)
GROUP BY feature
""", more=(
        """numbered AS MATERIALIZED (SELECT p.*, row_number() OVER (ORDER BY d.deal_id) - 1 AS pos, count(*) OVER () AS n
           FROM rg_pred p JOIN split d ON p.rid = d.row_ix)""",
        "base AS (SELECT avg(abs(y - pred)) AS mae, count(*) AS n FROM rg_pred)",
        f"draws AS (SELECT * FROM (VALUES {draws}) t(feature, repeat, keys))",
        f"moved AS MATERIALIZED (SELECT rid, y, pred, feature, repeat, {permuted_sql('pos', 'n', 'keys')} AS source FROM numbered, draws)"))


@register("feature_importance", _importance_sql())
def q_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation importance (10 repeats, seed 42, MAE) of the ridge model."""
    from ..functions.common import round_to
    from ..operators.models import fit_candidate, permutation_importance
    train, test = _train_test(spark, sf_dir)
    m = fit_candidate("ridge", train, CATEGORICAL_FEATURES, NUMERIC_FEATURES)
    imp = permutation_importance(m, test, [*CATEGORICAL_FEATURES, *NUMERIC_FEATURES], IMPORTANCE_REPEATS, IMPORTANCE_SEED)
    return imp.orderBy(F.col("importance_mean").desc(), F.col("feature")).select(
        "feature", round_to(F.col("importance_mean"), 0).alias("importance_mean"), round_to(F.col("importance_std"), 0).alias("importance_std"), "n_test")


@register("ridge_coefficients", _ridge_sql(f"""
SELECT name AS feature, {q.rnd('w', 1)} AS coefficient FROM rg_w ORDER BY {q.rnd('abs(w)', 1)} DESC, name LIMIT 50
"""))
def q_ridge_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-50 ridge coefficients by absolute value."""
    from ..functions.common import round_to
    from ..operators.models import fit_candidate, ridge_coefficients
    train, _test = _train_test(spark, sf_dir)
    top = ridge_coefficients(fit_candidate("ridge", train, CATEGORICAL_FEATURES, NUMERIC_FEATURES), spark)
    return top.select("feature", round_to(F.col("coefficient"), 1).alias("coefficient"))


# ---------------------------------------------------------------------------
# E1, E3, E6, F10, W7 with the ridge model behind the predictions.  Amounts are in
# whole units: sums of doubles in another order differ by some 1e-7 of a unit.
# ---------------------------------------------------------------------------

def _model(spark: SparkSession, sf_dir: str):
    from ..operators.models import fit_candidate
    train, _test = _train_test(spark, sf_dir)
    return fit_candidate("ridge", train, CATEGORICAL_FEATURES, NUMERIC_FEATURES)


_SCORE_ALL = f"SELECT 0 AS grp, {_K_SQL} AS rid, {_MODEL_COLUMNS}, noi_next12 AS y FROM deals"
_ROI_OUT = ("loan_amount", "equity_required", "annual_debt_service", "annual_cash_flow", "estimated_exit_value",
            "estimated_exit_proceeds_after_debt_and_costs")


def _roi_sql(pred: str, price: str, cap: str) -> dict[str, str]:
    ads, ev = q.ads(f"{price} * ltv", "interest_rate", "amort_years"), q.inf_div(pred, cap)
    return {"loan_amount": f"{price} * ltv", "equity_required": f"{price} - {price} * ltv", "annual_debt_service": ads,
            "annual_cash_flow": f"{pred} - {ads}", "estimated_exit_value": ev,
            "estimated_exit_proceeds_after_debt_and_costs": f"{ev} - {ev} * 2e-2 - {price} * ltv",
            "cash_on_cash": q.inf_div(f"{pred} - {ads}", f"{price} - {price} * ltv")}


_SCORE_ROI = _roi_sql("pred", "purchase_price", "65e-3")


@register("score_deals", _ridge_sql(f"""
SELECT d.deal_id, CASE WHEN p.rid IS NULL THEN 'quarantined' ELSE 'accepted' END AS status,
       CASE WHEN p.rid IS NULL THEN 'gross_leasable_sqft is required; purchase_price is required; noi_t12 is required; opex_t12 is required; gross_rent_t12 is required' ELSE '' END AS errors,
       {q.whole('pred')} AS predicted_noi_next12,
       {', '.join(f'CASE WHEN p.rid IS NOT NULL THEN {q.whole(_SCORE_ROI[c])} END AS {c}' for c in _ROI_OUT)},
       CASE WHEN p.rid IS NOT NULL THEN {q.ratio(_SCORE_ROI['cash_on_cash'])} END AS cash_on_cash
FROM (SELECT *, {_K_SQL} AS k FROM intake) d LEFT JOIN rg_pred p ON p.rid = d.k
""", score=_SCORE_ALL))
def q_score_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order validated, scored by the ridge model and given its ROI."""
    from ..functions.common import round_ratio, round_to
    from ..streaming.scoring import score_requests
    out = score_requests(_intake(spark, sf_dir), _model(spark, sf_dir))
    return out.select("deal_id", "status", "errors", *[round_to(F.col(c), 0).alias(c) for c in ("predicted_noi_next12", *_ROI_OUT)],
                      round_ratio(F.col("cash_on_cash")).alias("cash_on_cash"))


_SCENARIO_SCORES = f"""SELECT 0 AS grp, {_K_SQL} * 10 + i AS rid, {', '.join(CATEGORICAL_FEATURES)},
  {', '.join('purchase_price * (CASE WHEN i = 0 THEN 96e-2 ELSE 1e0 END) AS purchase_price' if c == 'purchase_price' else c for c in NUMERIC_FEATURES)},
  noi_next12 AS y FROM deals, range(0, 2) t(i)"""


def _simple_model_sql() -> str:
    roi = _roi_sql("pred", "pp", "ec")
    return _ridge_sql(f"""
SELECT deal_id, CAST(row_number() OVER (PARTITION BY deal_id ORDER BY isnan(sort_raw), sort_raw DESC NULLS LAST, ix) AS INTEGER) AS rank, ix AS scenario_ix,
       grid_size, grid_size > cap AS truncated, {q.whole('pp')} AS purchase_price, {q.whole('pred')} AS predicted_noi_next12,
       {', '.join(f'{q.whole(roi[c])} AS {c}' for c in _ROI_OUT)}, {q.ratio('ec')} AS exit_cap_rate, {q.ratio(roi['cash_on_cash'])} AS cash_on_cash
FROM (
  SELECT *, CASE sort_by WHEN 'annual_cash_flow' THEN {roi['annual_cash_flow']} WHEN 'estimated_exit_proceeds'
              THEN {roi['estimated_exit_proceeds_after_debt_and_costs']} ELSE {roi['cash_on_cash']} END AS sort_raw
  FROM (
    SELECT d.*, p.pred, d.purchase_price * (CASE WHEN i1 = 0 THEN 96e-2 ELSE 1e0 END) AS pp,
           CASE WHEN k % 3 = 0 THEN 5e-2 + (k % 30) * 1e-3 ELSE [625e-4, 675e-4][i4 + 1] END AS ec, i1 * n4 + i4 AS ix, CAST(2 * n4 AS BIGINT) AS grid_size
    FROM (SELECT *, {_K_SQL} AS k, 1 + {_K_SQL} % 5 AS cap, CASE WHEN {_K_SQL} % 3 = 0 THEN 1 ELSE 2 END AS n4,
                 CASE {_K_SQL} % 4 WHEN 0 THEN 'annual_cash_flow' WHEN 1 THEN 'estimated_exit_proceeds' WHEN 2 THEN 'else' ELSE 'cash_on_cash' END AS sort_by
          FROM deals) d, range(0, 2) a(i1), range(0, n4) b(i4)
    JOIN rg_pred p ON p.rid = k * 10 + i1)
  WHERE ix < cap)
""", score=_SCENARIO_SCORES)


@register("whatif_simple_model", _simple_model_sql())
def q_whatif_simple_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple grid with the model's anchors; cap, ranking key and exit cap are each request's own."""
    from ..functions.common import round_ratio, round_to
    from ..operators.scenario import whatif_simple
    k = _order_key()
    d = _grid_deals(spark, sf_dir, institutional=False).withColumns({
        "own_cap": 0.05 + (k % 30) * 0.001, "cap": 1 + k % 5,
        "by": F.when(k % 4 == 0, "annual_cash_flow").when(k % 4 == 1, "estimated_exit_proceeds").when(k % 4 == 2, "else").otherwise("cash_on_cash"),
        "exit_cap_rates": F.when(k % 3 != 0, F.col("exit_cap_rates"))})
    out = whatif_simple(d, _model(spark, sf_dir), max_scenarios=F.col("cap"), sort_by=F.col("by"), base_exit_cap_rate=F.col("own_cap"))
    return out.select("deal_id", "rank", "scenario_ix", "grid_size", "truncated", *[round_to(F.col(c), 0).alias(c) for c in (
        "purchase_price", "predicted_noi_next12", *_ROI_OUT)], *[round_ratio(F.col(c)).alias(c) for c in ("exit_cap_rate", "cash_on_cash")])


def _inst_model_sql() -> str:
    src, pf, body = _wi_parts("p.pred", join=f"JOIN rg_pred p ON p.rid = CAST(substr(s.deal_id, 2) AS BIGINT) * 10 + sm.ix // 16")
    keep = ("purchase_price", "predicted_noi_next12", "net_sale_proceeds", "irr", "min_dscr", "exit_cap_rate", "rent_growth")
    amounts = keep[:3]
    return _ridge_sql(f"SELECT deal_id, rank, scenario_ix, grid_size, {', '.join(q.whole(c) + ' AS ' + c for c in amounts)}, {', '.join(keep[3:])} FROM ({body})", score=_SCENARIO_SCORES, more=(src, pf))


@register("whatif_inst_model", _inst_model_sql())
def q_whatif_inst_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The institutional grid with the model's anchors, each (price, ltv, rate) scored once."""
    from ..functions.common import round_money, round_ratio, round_to
    from ..operators.payloads import INST_PAYLOAD
    from ..operators.scenario import whatif_inst
    model = _model(spark, sf_dir)
    # a plain transformer, as any pyspark.ml model is: its anchors are packed into the request's row
    res = whatif_inst(_grid_deals(spark, sf_dir, institutional=True), lambda df: model.transform(df), INST_PAYLOAD, max_scenarios=40, top_n=5)
    return res.scenarios.select("deal_id", _by_parts(F.col("rank")).alias("rank"), "scenario_ix", "grid_size", *[round_to(round_money(F.col(c)), 0).alias(c) for c in (
        "purchase_price", "predicted_noi_next12", "net_sale_proceeds")], *[round_ratio(F.col(c)).alias(c) for c in (
            "irr", "min_dscr", "exit_cap_rate", "rent_growth")])


# ---------------------------------------------------------------------------
# E8 streaming scoring: dirty deals written as JSON request files by Spark,
# consumed by a file stream (availableNow), naive anchor = trailing NOI
# ---------------------------------------------------------------------------

@register("stream_scoring")
def q_stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.common import round_money, round_ratio
    from ..operators.scenario import column_predictor
    from ..streaming.scoring import scratch_root, start_scoring_stream
    root = scratch_root(spark, "stream-scoring")
    reqs = dirty_deals(spark, sf_dir).withColumn("asof_date", F.col("asof_date").cast("string")).drop("noi_next12")
    reqs.write.mode("overwrite").json(f"{root}/in")
    qry = start_scoring_stream(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint",
                               column_predictor(F.col("noi_t12")))
    qry.awaitTermination()
    out = spark.read.parquet(f"{root}/out").drop("batch_id")
    money = ("predicted_noi_next12", "loan_amount", "equity_required", "annual_debt_service", "annual_cash_flow",
             "estimated_exit_value", "estimated_exit_proceeds_after_debt_and_costs")
    return out.select("deal_id", "status", "errors", *[round_money(F.col(c)).alias(c) for c in money],
                      round_ratio(F.col("cash_on_cash")).alias("cash_on_cash"))


def _stream_sql() -> str:
    ads = q.ads("purchase_price * ltv", "interest_rate", "amort_years")
    ok = "status = 'accepted'"
    ev = q.inf_div("noi_t12", "6.5e-2")
    v = ORACLES["validate_quarantine"]
    return f"""
WITH v AS ({v}),
d AS ({with_deals("SELECT * FROM dirty", _DIRTY_SQL)})
SELECT v.deal_id, v.status, v.errors,
       CASE WHEN {ok} THEN {q.money('noi_t12')} END AS predicted_noi_next12,
       CASE WHEN {ok} THEN {q.money('purchase_price * ltv')} END AS loan_amount,
       CASE WHEN {ok} THEN {q.money('purchase_price - purchase_price * ltv')} END AS equity_required,
       CASE WHEN {ok} THEN {q.money(ads)} END AS annual_debt_service,
       CASE WHEN {ok} THEN {q.money(f'noi_t12 - {ads}')} END AS annual_cash_flow,
       CASE WHEN {ok} THEN {q.money(ev)} END AS estimated_exit_value,
       CASE WHEN {ok} THEN {q.money(f'{ev} - {ev} * 2e-2 - purchase_price * ltv')} END
         AS estimated_exit_proceeds_after_debt_and_costs,
       CASE WHEN {ok} THEN {q.ratio(q.inf_div(f'noi_t12 - {ads}', 'purchase_price - purchase_price * ltv'))} END
         AS cash_on_cash
FROM v JOIN d ON v.deal_id = d.deal_id
"""


ORACLES["stream_scoring"] = _stream_sql()


def _request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a JSON line: some with wrong types, a list for a text, a missing field, or cut off in the middle (k = order key)."""
    k = _order_key()
    rows = _intake(spark, sf_dir).select("deal_id", "property_type", "city", "state", "zip", "year_built", "gross_leasable_sqft", "purchase_price",
                                         "noi_t12", "occupancy_t12", "opex_t12", "gross_rent_t12", "ltv", "interest_rate", "amort_years")
    line = F.to_json(F.struct(*rows.columns))
    text = F.when(k % 19 == 0, F.expr("substring(line, 1, length(line) div 2)")).when(k % 31 == 0, F.concat(F.lit("["), F.col("line"), F.lit("]"))) \
        .when(k % 13 == 0, F.regexp_replace("line", '"ltv":[^,}]*', '"ltv":"much"')) \
        .when(k % 17 == 0, F.regexp_replace("line", '"amort_years":[^,}]*', '"amort_years":25.5')) \
        .when(k % 29 == 0, F.regexp_replace("line", '"city":[^,}]*,', "")).otherwise(F.col("line"))
    return rows.withColumn("line", line).select(text.alias("value"))


@register("request_rejects", with_deals("""
SELECT CASE WHEN broken THEN NULL ELSE deal_id END AS deal_id,
       CASE WHEN broken THEN 'not a JSON object' ELSE array_to_string(list_filter([
         CASE WHEN wrong = 'ltv' THEN 'ltv: not a number' END, CASE WHEN wrong = 'amort' THEN 'amort_years: not a whole number' END,
         CASE WHEN wrong = 'city' THEN 'city is required' END,
         CASE WHEN rent IS NULL THEN 'gross_leasable_sqft is required; purchase_price is required; noi_t12 is required; opex_t12 is required; gross_rent_t12 is required' END
       ], lambda x: x IS NOT NULL), '; ') END AS errors
FROM (SELECT deal_id, gross_rent_t12 AS rent, k % 19 = 0 OR k % 31 = 0 AS broken,
             CASE WHEN k % 13 = 0 THEN 'ltv' WHEN k % 17 = 0 THEN 'amort' WHEN k % 29 = 0 THEN 'city' END AS wrong
      FROM (SELECT *, CAST(substr(deal_id, 2) AS BIGINT) AS k FROM intake))
WHERE broken OR wrong IS NOT NULL OR rent IS NULL
"""))
def q_request_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines through the stream; what is rejected comes back with its reasons, broken lines included."""
    from ..operators.scenario import column_predictor
    from ..streaming.scoring import scratch_root, start_scoring_stream
    root = scratch_root(spark, "request-rejects")
    _request_lines(spark, sf_dir).write.text(f"{root}/in")
    start_scoring_stream(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", column_predictor(F.col("noi_t12"))).awaitTermination()
    return spark.read.parquet(f"{root}/out").filter("status = 'quarantined'").select("deal_id", "errors")


_FILE_EXT_SQL = "CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.md' WHEN 'de' THEN '.LOG' ELSE '.pdf' END"


@register("document_status", f"""
WITH files AS (SELECT '/deals/docs/doc_' || doc_id || {_FILE_EXT_SQL} AS path, text FROM documents),
refs AS (SELECT doc_id, unnest(['../docs/./doc_' || doc_id || {_FILE_EXT_SQL}, 'file:/deals/docs/doc_' || (doc_id + 1) || '.txt', 'notes/' || doc_id]) AS path,
                unnest(['/deals/docs/doc_' || doc_id || {_FILE_EXT_SQL}, '/deals/docs/doc_' || (doc_id + 1) || '.txt', '/deals/inbox/notes/' || doc_id]) AS full_path
         FROM documents)
SELECT r.doc_id, r.path, CASE WHEN f.path IS NULL THEN 'missing' WHEN f.path LIKE '%.pdf' THEN 'unsupported' ELSE 'ok' END AS status,
       CASE WHEN f.path IS NOT NULL AND f.path NOT LIKE '%.pdf' THEN CAST(length({_norm_sql('f.text')}) AS INTEGER) ELSE -1 END AS n_chars
FROM refs r LEFT JOIN files f ON r.full_path = f.path
""")
def q_document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References relative to a base folder, with dots and schemes, against the files: ok, missing or unsupported."""
    from ..operators.documents import document_status
    docs = _docs(spark, sf_dir)
    d = F.col("doc_id")
    ext = (F.when(F.col("lang") == "en", F.lit(".txt")).when(F.col("lang") == "fr", F.lit(".md")).when(F.col("lang") == "de", F.lit(".LOG"))
           .otherwise(F.lit(".pdf")))
    files = docs.select(F.concat(F.lit("file:///deals/docs/doc_"), d, ext).alias("path"), "text")
    refs = docs.select("doc_id", F.explode(F.array(F.concat(F.lit("../docs/./doc_"), d, ext), F.concat(F.lit("file:/deals/docs/doc_"), d + 1, F.lit(".txt")),
                                                   F.concat(F.lit("notes/"), d))).alias("path"))
    st = document_status(refs, files, base_path="/deals/inbox")
    return st.select("doc_id", "path", "status", F.coalesce(F.length("doc_text"), F.lit(-1)).alias("n_chars"))
