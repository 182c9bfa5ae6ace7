"""SQL text helpers for the DuckDB oracles.

These only format oracle SQL strings (the independent check of each Spark
plan); nothing here is executed by Spark.
"""

from __future__ import annotations


def rnd(expr: str, decimals: int, max_sig: int = 9) -> str:
    """Same rounding as ``functions.common.round_to`` (decimals, capped sig. digits)."""
    x = f"({expr})"
    big = f"abs({x}) >= {10.0 ** (max_sig - decimals)!r}"
    d_big = f"({max_sig - 1} - CAST(floor(log10(abs({x}))) AS INTEGER))"
    up = f"pow(10e0, GREATEST({d_big}, 0))"
    down = f"pow(10e0, GREATEST(-{d_big}, 0))"
    big_val = (f"CASE WHEN {d_big} >= 0 THEN floor({x} * {up} + 0.5e0) / {up} "
               f"ELSE floor({x} / {down} + 0.5e0) * {down} END")
    scale = f"{10 ** decimals}e0"
    return (f"(CASE WHEN NOT isfinite({x}) THEN {x} WHEN {big} THEN {big_val} "
            f"ELSE floor({x} * {scale} + 0.5e0) / {scale} END)")


def money(expr: str) -> str:
    """Same rounding as ``functions.common.round_money``."""
    x = f"({expr})"
    return f"(CASE WHEN abs({x}) < {2.0 ** 53 / 100!r} THEN floor({x} * 100e0 + 0.5e0) / 100e0 ELSE {x} END)"


def whole(expr: str) -> str:
    return rnd(expr, 0)


def ratio(expr: str) -> str:
    return rnd(expr, 6)


def ads(loan: str, rate: str, years: str) -> str:
    """Annual debt service (R1) in SQL."""
    r = f"(({rate}) / 12e0)"
    n = f"(({years}) * 12)"
    p = f"pow(1e0 + {r}, {n})"
    return (f"(CASE WHEN ({loan}) <= 0 THEN 0e0 WHEN {r} = 0 THEN ({loan}) / ({years}) "
            f"ELSE ({loan}) * ({r} * {p}) / ({p} - 1e0) * 12e0 END)")


def balance(loan: str, rate: str, years: str, months: str) -> str:
    """Remaining balance (R2) in SQL."""
    r = f"(({rate}) / 12e0)"
    n = f"(({years}) * 12)"
    k = f"LEAST(GREATEST(({months}), 0), {n})"
    p = f"pow(1e0 + {r}, {n})"
    pk = f"pow(1e0 + {r}, {k})"
    pmt = f"(({loan}) * ({r} * {p}) / ({p} - 1e0))"
    straight = f"GREATEST(({loan}) - ({loan}) * ({k} / {n}), 0e0)"
    amort = f"GREATEST(({loan}) * {pk} - {pmt} * (({pk} - 1e0) / {r}), 0e0)"
    return (f"(CASE WHEN ({loan}) <= 0 THEN 0e0 WHEN {r} = 0 THEN {straight} "
            f"ELSE {amort} END)")


def inf_div(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN ({num}) / ({den}) ELSE 'inf'::DOUBLE END)"


def irr(cfs: str, steps: int = 100) -> str:
    """Newton IRR over a DOUBLE[] expression with the reference's stop rules.

    State is a 3-element list [r, done, ok]; ``list_reduce`` with an initial
    value walks ``steps`` Newton iterations.
    """
    n = f"len({cfs})"
    base = "(1e0 + s[1])"
    npv = f"list_sum(list_transform({cfs}, lambda c, j: c / pow({base}, j - 1)))"
    dnpv = (f"list_sum(list_transform({cfs}, lambda c, j: CASE WHEN j > 1 THEN "
            f"(-(j - 1) * c) / pow({base}, j) ELSE 0e0 END))")
    newr = f"(s[1] - ({npv}) / ({dnpv}))"
    pmax = f"pow(abs({base}), {n})"
    body = (
        f"CASE WHEN s[2] = 1 THEN s "
        f"WHEN {n} >= 2 AND ({pmax} = 0 OR isinf({pmax})) THEN [s[1], 1e0, 0e0] "
        f"WHEN abs({dnpv}) < 1e-12 THEN [s[1], 1e0, 1e0] "
        f"WHEN NOT isfinite({newr}) THEN [s[1], 1e0, 1e0] "
        f"WHEN abs({newr} - s[1]) < 1e-10 THEN [{newr}, 1e0, 1e0] "
        f"ELSE [{newr}, 0e0, 1e0] END"
    )
    red = f"list_reduce(range(0, {steps}), lambda s, i: {body}, [0.12e0, 0e0, 1e0])"
    return f"(CASE WHEN ({red})[3] = 1 THEN ({red})[1] END)"


def clamp01(x: str) -> str:
    return f"GREATEST(0e0, LEAST(1e0, {x}))"


# Institutional knob names -> SQL expression; values are SQL text (literals or
# columns of the source relation ``s``).
INST_DEFAULTS = {
    "hold": "5", "exit_cap": "6.5e-2", "sell": "2e-2", "io_years": "0",
    "rent_growth": "3e-2", "opex_infl": "3e-2", "occ_target": "95e-2", "reversion": "2",
    "taxes1": "0e0", "ins1": "0e0", "taxes_infl": "3e-2", "ins_infl": "4e-2",
    "reassess": "false", "reassess_rate": "2e-2", "reassess_year": "1",
    "reserve_psf": "0e0", "repl_psf": "0e0", "value_add": "NULL::MAP(INTEGER, DOUBLE)",
    "shock_year": "NULL::INTEGER", "shock_drop": "0e0", "recovery": "2",
    "rate_shock_year": "NULL::INTEGER", "bps": "0e0",
    "refi_year": "NULL::INTEGER", "refi_ltv": "0e0", "refi_rate": "0e0", "refi_amort": "30", "refi_cost": "1e-2",
}


def proforma_ctes(src: str, keys: list[str], knobs: dict[str, str]) -> str:
    """Recursive CTE ``pf_y`` (one row per key and year) walking the year loop.

    ``src`` must expose the key columns and price, ltv, rate0, amort0, rent1,
    opex1, occ1, sqft.  The state carried from year to year is the active
    loan, its base rate and term, months amortised and the IO horizon, exactly
    like the reference's loop -- deliberately not the closed form the Spark
    plan uses, so the check is independent.
    """
    k = dict(INST_DEFAULTS, **knobs)
    key_sel = ", ".join(f"s.{c}" for c in keys)
    on = " AND ".join(f"y.{c} = s.{c}" for c in keys)

    def occ_base(year: str) -> str:
        return (f"(CASE WHEN {k['reversion']} <= 1 THEN {k['occ_target']} WHEN {year} <= 1 THEN s.occ1 "
                f"WHEN {year} >= {k['reversion']} THEN {k['occ_target']} "
                f"ELSE s.occ1 + (({k['occ_target']} - s.occ1) / ({k['reversion']} - 1)) * ({year} - 1) END)")

    sy, drop, rec = k["shock_year"], k["shock_drop"], f"GREATEST(1, {k['recovery']})"
    shocked = clamp01(f"{occ_base(sy)} - {drop}")
    return f"""
pf_y AS (
  SELECT {key_sel}, 0 AS year,
         s.price * s.ltv AS cur_loan, s.rate0 AS cur_rate, s.amort0 AS cur_amort, 0 AS months,
         LEAST(GREATEST({k['io_years']}, 0), {k['hold']}) AS io,
         NULL::DOUBLE AS occupancy, NULL::DOUBLE AS gross_rent, NULL::DOUBLE AS effective_rent,
         NULL::DOUBLE AS opex, NULL::DOUBLE AS taxes, NULL::DOUBLE AS insurance,
         NULL::DOUBLE AS capex_reserve, NULL::DOUBLE AS replacement_capex, NULL::DOUBLE AS value_add_capex,
         NULL::DOUBLE AS noi, NULL::DOUBLE AS debt_service, NULL::DOUBLE AS cash_flow, NULL::DOUBLE AS dscr,
         NULL::DOUBLE AS debt_rate, NULL::DOUBLE AS loan_balance_end_year,
         NULL::DOUBLE AS refi_value, NULL::DOUBLE AS refi_new_loan, NULL::DOUBLE AS refi_payoff,
         NULL::DOUBLE AS refi_cost, NULL::DOUBLE AS refi_cash_out, NULL::DOUBLE AS equity_cf
  FROM {src} s
  UNION ALL
  SELECT {key_sel}, Y AS year,
         CASE WHEN is_refi THEN new_loan ELSE y.cur_loan END AS cur_loan,
         CASE WHEN is_refi THEN (CASE WHEN {k['refi_rate']} > 0 THEN {k['refi_rate']} ELSE yr_rate END)
              ELSE y.cur_rate END AS cur_rate,
         CASE WHEN is_refi THEN {k['refi_amort']} ELSE y.cur_amort END AS cur_amort,
         CASE WHEN is_refi THEN 0 ELSE months_now END AS months,
         CASE WHEN is_refi THEN 0 ELSE y.io END AS io,
         occ AS occupancy, gross AS gross_rent, eff AS effective_rent, opex_y AS opex, taxes_y AS taxes,
         ins_y AS insurance, reserve AS capex_reserve, repl AS replacement_capex, va AS value_add_capex,
         noi_y AS noi, ds AS debt_service, cf AS cash_flow,
         CASE WHEN ds > 0 THEN noi_y / ds ELSE 'inf'::DOUBLE END AS dscr,
         yr_rate AS debt_rate, bal_end AS loan_balance_end_year,
         CASE WHEN is_refi THEN refi_val END AS refi_value,
         CASE WHEN is_refi THEN new_loan END AS refi_new_loan,
         CASE WHEN is_refi THEN bal_end END AS refi_payoff,
         CASE WHEN is_refi THEN new_loan * {k['refi_cost']} END AS refi_cost,
         CASE WHEN is_refi THEN new_loan - bal_end - new_loan * {k['refi_cost']} END AS refi_cash_out,
         cf + CASE WHEN is_refi THEN new_loan - bal_end - new_loan * {k['refi_cost']} ELSE 0e0 END AS equity_cf
  FROM (
    SELECT y.*, y.year + 1 AS Y,
           {occ_base('(y.year + 1)')} AS ob,
           CASE WHEN {sy} IS NULL OR {sy} = 0 OR {drop} <= 0 OR (y.year + 1) < {sy} THEN ob
                WHEN (y.year + 1) = {sy} THEN {clamp01(f'ob - {drop}')}
                WHEN (y.year + 1) - {sy} >= {rec} THEN {k['occ_target']}
                ELSE {clamp01(f"{shocked} + (({k['occ_target']} - {shocked}) / {rec}) * ((y.year + 1) - {sy})")} END AS occ_s,
           {clamp01('occ_s')} AS occ,
           s.rent1 * pow(1e0 + {k['rent_growth']}, y.year) AS gross,
           gross * occ AS eff,
           s.opex1 * pow(1e0 + {k['opex_infl']}, y.year) AS opex_y,
           (CASE WHEN {k['reassess']} AND (y.year + 1) >= {k['reassess_year']} THEN s.price * {k['reassess_rate']}
                 ELSE {k['taxes1']} END) * pow(1e0 + {k['taxes_infl']}, y.year) AS taxes_y,
           {k['ins1']} * pow(1e0 + {k['ins_infl']}, y.year) AS ins_y,
           {k['reserve_psf']} * s.sqft AS reserve,
           {k['repl_psf']} * s.sqft AS repl,
           COALESCE(({k['value_add']})[CAST(y.year + 1 AS INTEGER)], 0e0) AS va,
           eff - opex_y - taxes_y - ins_y - reserve - repl AS noi_y,
           CASE WHEN {k['rate_shock_year']} IS NOT NULL AND {k['rate_shock_year']} <> 0
                     AND (y.year + 1) >= {k['rate_shock_year']} AND {k['bps']} <> 0
                THEN y.cur_rate + {k['bps']} / 10000e0 ELSE y.cur_rate END AS yr_rate,
           CASE WHEN (y.year + 1) <= y.io THEN y.cur_loan * yr_rate
                ELSE {ads('y.cur_loan', 'yr_rate', 'y.cur_amort')} END AS ds,
           y.months + CASE WHEN (y.year + 1) > y.io THEN 12 ELSE 0 END AS months_now,
           CASE WHEN months_now > 0 THEN {balance('y.cur_loan', 'yr_rate', 'y.cur_amort', 'months_now')}
                ELSE y.cur_loan END AS bal_end,
           noi_y - ds - va AS cf,
           ({k['refi_year']} IS NOT NULL AND {k['refi_year']} <> 0 AND {k['refi_ltv']} <> 0
             AND (y.year + 1) = {k['refi_year']} AND {k['refi_ltv']} > 0) AS is_refi,
           {inf_div('noi_y', k['exit_cap'])} AS refi_val,
           refi_val * {k['refi_ltv']} AS new_loan
    FROM pf_y y JOIN {src} s ON {on}
    WHERE y.year < {k['hold']}
  ) y JOIN {src} s ON {on}
),
pf_rows AS (SELECT * FROM pf_y WHERE year >= 1),
pf_last AS (
  SELECT {', '.join('p.' + c for c in keys)}, p.noi AS noi_exit, p.loan_balance_end_year AS bal_sale
  FROM pf_rows p JOIN {src} s ON {' AND '.join(f'p.{c} = s.{c}' for c in keys)} WHERE p.year = {k['hold']}),
pf_first AS (SELECT * FROM pf_rows WHERE year = 1),
pf_sum AS (
  SELECT {', '.join('l.' + c for c in keys)},
         s.price * s.ltv AS loan_amount, s.price - s.price * s.ltv AS equity_required,
         {inf_div('l.noi_exit', k['exit_cap'])} AS exit_value,
         {inf_div('l.noi_exit', k['exit_cap'])} * {k['sell']} AS selling_costs,
         l.bal_sale AS remaining_loan_balance_at_sale,
         {inf_div('l.noi_exit', k['exit_cap'])} - {inf_div('l.noi_exit', k['exit_cap'])} * {k['sell']} - l.bal_sale
           AS net_sale_proceeds,
         {inf_div('f.cash_flow', 's.price - s.price * s.ltv')} AS cash_on_cash_year1,
         {inf_div('f.noi', 's.price * s.ltv')} AS debt_yield_year1,
         {clamp01(inf_div('f.opex + f.taxes + f.insurance + f.capex_reserve + f.replacement_capex + f.debt_service', 'f.gross_rent'))}
           AS breakeven_occupancy_year1,
         CASE WHEN {inf_div('l.noi_exit', k['exit_cap'])} > 0 AND isfinite({inf_div('l.noi_exit', k['exit_cap'])})
              THEN l.bal_sale / {inf_div('l.noi_exit', k['exit_cap'])} ELSE 'inf'::DOUBLE END AS ltv_at_exit
  FROM pf_last l JOIN {src} s ON {' AND '.join(f'l.{c} = s.{c}' for c in keys)}
       JOIN pf_first f ON {' AND '.join(f'l.{c} = f.{c}' for c in keys)}
),
pf_cf AS (
  SELECT {', '.join('p.' + c for c in keys)},
         list_concat([-(s.price - s.price * s.ltv)],
                      list(p.equity_cf + CASE WHEN p.year = {k['hold']} THEN sm.net_sale_proceeds ELSE 0e0 END
                           ORDER BY p.year)) AS cfs,
         min(p.dscr) AS min_dscr
  FROM pf_rows p JOIN {src} s ON {' AND '.join(f'p.{c} = s.{c}' for c in keys)}
       JOIN pf_sum sm ON {' AND '.join(f'p.{c} = sm.{c}' for c in keys)}
  GROUP BY {', '.join('p.' + c for c in keys)}, s.price, s.ltv
)
"""


def ridge_ctes(fit: str, score: str, cats, nums, alpha: str = "1e0") -> list[str]:
    """CTEs of ridge models by normal equations, eliminated in a recursive CTE.

    ``fit`` and ``score`` are queries with grp (a model for each), rid, the
    columns and y.  Results: rg_w (grp, name, w, mu), rg_pred (grp, rid, y, pred) and rg_part (grp, rid, col,
    part: what a column adds).  Numeric columns are imputed, centred and scaled row by row.
    """
    med = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in nums)
    modes = [f"rg_mode_{c} AS (SELECT grp, first(v ORDER BY n DESC, v) AS m FROM (SELECT grp, {c} AS v, count(*) AS n FROM rg_fit "
             f"WHERE {c} IS NOT NULL GROUP BY grp, {c}) GROUP BY grp)" for c in cats]
    stat = ", ".join(f"avg({c}) AS mu_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1e0 ELSE stddev_pop({c}) END AS sd_{c}" for c in nums)

    def imputed(rel: str) -> str:
        return (f"SELECT f.grp, f.rid, f.y, {', '.join(f'coalesce(CAST(f.{c} AS DOUBLE), m.{c}) AS {c}' for c in nums)}, "
                f"{', '.join(f'coalesce(f.{c}, o_{c}.m) AS {c}' for c in cats)} FROM {rel} f JOIN rg_med m ON f.grp = m.grp "
                + " ".join(f"LEFT JOIN rg_mode_{c} o_{c} ON f.grp = o_{c}.grp" for c in cats))

    def long(rel: str) -> str:
        return " UNION ALL ".join(
            [f"SELECT grp, rid, '{c}' AS col, '{c}_' || {c} AS name, 1e0 AS z FROM {rel}" for c in cats]
            + [f"SELECT r.grp, rid, '{c}', '{c}', ({c} - mu_{c}) / sd_{c} FROM {rel} r JOIN rg_stat s ON r.grp = s.grp" for c in nums])

    return [
        f"rg_fit AS ({fit})", f"rg_score AS ({score})", f"rg_med AS (SELECT grp, {med} FROM rg_fit GROUP BY grp)", *modes,
        f"rg_imp AS ({imputed('rg_fit')})", f"rg_stat AS (SELECT grp, count(*) AS n, avg(y) AS ybar, {stat} FROM rg_imp GROUP BY grp)",
        f"rg_long AS ({long('rg_imp')})",
        """rg_feat AS (SELECT l.grp, name, row_number() OVER (PARTITION BY l.grp ORDER BY name) AS j, sum(z) / any_value(s.n) AS mu
            FROM rg_long l JOIN rg_stat s ON l.grp = s.grp GROUP BY l.grp, name)""",
        "rg_x AS MATERIALIZED (SELECT l.grp, l.rid, f.j, l.z FROM rg_long l JOIN rg_feat f ON l.grp = f.grp AND l.name = f.name)",
        "rg_pair AS (SELECT a.grp, a.j AS i, b.j AS j, sum(a.z * b.z) AS s FROM rg_x a JOIN rg_x b ON a.grp = b.grp AND a.rid = b.rid GROUP BY ALL)",
        """rg_xy AS (SELECT x.grp, x.j, sum(x.z * (r.y - s.ybar)) AS v FROM rg_x x JOIN rg_imp r ON x.grp = r.grp AND x.rid = r.rid
            JOIN rg_stat s ON x.grp = s.grp GROUP BY ALL)""",
        f"""rg_full AS (SELECT a.grp, a.j AS i, b.j AS j, coalesce(p.s, 0e0) - t.n * a.mu * b.mu + CASE WHEN a.j = b.j THEN {alpha} ELSE 0e0 END AS v
            FROM rg_feat a JOIN rg_feat b ON a.grp = b.grp JOIN rg_stat t ON a.grp = t.grp
            LEFT JOIN rg_pair p ON p.grp = a.grp AND p.i = a.j AND p.j = b.j)""",
        """rg_row AS (SELECT f.grp, i, list_append(list(f.v ORDER BY f.j), any_value(y.v)) AS r FROM rg_full f
            JOIN rg_xy y ON f.grp = y.grp AND f.i = y.j GROUP BY f.grp, i)""",
        """rg_ge AS (SELECT grp, 0 AS k, list(r ORDER BY i) AS m, count(*) AS d FROM rg_row GROUP BY grp
            UNION ALL
            SELECT grp, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN r ELSE
                     list_transform(r, lambda x, j: x - r[k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END), d FROM rg_ge WHERE k < d)""",
        """rg_w AS MATERIALIZED (SELECT g.grp, f.name, f.mu, g.m[f.j][g.d + 1] / g.m[f.j][f.j] AS w FROM rg_ge g JOIN rg_feat f ON g.grp = f.grp
            WHERE g.k = g.d)""",
        f"rg_simp AS ({imputed('rg_score')})", f"rg_slong AS ({long('rg_simp')})",
        "rg_b AS (SELECT s.grp, s.ybar - (SELECT sum(w * mu) FROM rg_w w WHERE w.grp = s.grp) AS b FROM rg_stat s)",
        """rg_pred AS MATERIALIZED (SELECT s.grp, s.rid, any_value(s.y) AS y, any_value(b.b) + coalesce(sum(w.w * l.z), 0e0) AS pred
            FROM rg_simp s JOIN rg_b b ON s.grp = b.grp JOIN rg_slong l ON s.grp = l.grp AND s.rid = l.rid
            LEFT JOIN rg_w w ON l.grp = w.grp AND l.name = w.name GROUP BY s.grp, s.rid)""",
        """rg_part AS (SELECT l.grp, l.rid, l.col, coalesce(w.w * l.z, 0e0) AS part FROM rg_slong l
            LEFT JOIN rg_w w ON l.grp = w.grp AND l.name = w.name)""",
    ]
