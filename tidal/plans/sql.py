"""DuckDB oracle SQL building blocks (independent formulations of the views)."""

NATION_MONTH = """
nation_month AS (
  SELECT n.n_name AS key,
         CAST((year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) - 1 AS INTEGER) AS period,
         CAST(sum(CAST(round(l.l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l.l_discount) * 100) AS BIGINT)) AS DOUBLE) / 10000 AS value
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2)"""

SUPPLIER_MONTH = """
supplier_raw AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS key, year(l_shipdate) * 12 + month(l_shipdate) AS m, sum(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2),
supplier_month AS (
  SELECT key, CAST(m - (SELECT max(m) FROM supplier_raw) + 68 AS INTEGER) AS period, value FROM supplier_raw)"""

SUPPLIER_MONTH_ZERO = SUPPLIER_MONTH + """,
supplier_span AS (SELECT key, min(period) AS lo, max(period) AS hi FROM supplier_month GROUP BY key),
supplier_month_zero AS (
  SELECT s.key, CAST(g.period AS INTEGER) AS period, coalesce(m.value, 0.0) AS value
  FROM supplier_span s, LATERAL (SELECT unnest(range(s.lo, s.hi + 1)) AS period) g
  LEFT JOIN supplier_month m ON m.key = s.key AND m.period = g.period)"""


def seq_product(src: str, factor: str, out: str, floor: bool, rec: str,
                start: float = 100.0) -> str:
    """Step-by-step compounding (recursive CTE ``rec``) over ``src`` rows numbered ``rn``."""
    step = f"r.{out} * s.{factor}"
    if floor:
        step = f"CASE WHEN {step} <= 0 THEN 0.0 ELSE {step} END"
    return f"""{rec} AS (
  SELECT key, rn, {start} * {factor} AS {out} FROM {src} WHERE rn = 1
  UNION ALL
  SELECT s.key, s.rn, {step} FROM {rec} r JOIN {src} s ON s.key = r.key AND s.rn = r.rn + 1)"""


def index_chain(src: str, value: str = "value", prefix: str = "ix") -> str:
    """Relative index (positive baseline, zero -> NULL), % change, floored price, inflation.

    Produces CTE ``{prefix}`` with all source columns plus ofr, ofr_change,
    price_index, inflation_pct.
    """
    return f"""
{prefix}_base AS (
  SELECT key, arg_min({value}, period) FILTER (WHERE {value} > 0) AS base FROM {src} GROUP BY key),
{prefix}_ofr AS (
  SELECT s.*, CASE WHEN b.base IS NOT NULL AND s.{value} <> 0 THEN s.{value} / b.base * 100 END AS ofr
  FROM {src} s LEFT JOIN {prefix}_base b ON s.key = b.key),
{prefix}_chg AS (
  SELECT *, CASE WHEN lag(ofr) OVER (PARTITION BY key ORDER BY period) <> 0
                 THEN (ofr - lag(ofr) OVER (PARTITION BY key ORDER BY period))
                      / lag(ofr) OVER (PARTITION BY key ORDER BY period) * 100 END AS ofr_change
  FROM {prefix}_ofr),
{prefix}_fac AS (
  SELECT *, coalesce(1 + 0.5 * (ofr_change / 100), 1.0) AS factor,
         row_number() OVER (PARTITION BY key ORDER BY period) AS rn
  FROM {prefix}_chg),
{seq_product(prefix + '_fac', 'factor', 'price_index', floor=True, rec=prefix + '_rec')},
{prefix}_px AS (
  SELECT f.* EXCLUDE (factor, rn), r.price_index
  FROM {prefix}_fac f JOIN {prefix}_rec r ON f.key = r.key AND f.rn = r.rn),
{prefix} AS (
  SELECT *, CASE WHEN lag(price_index) OVER (PARTITION BY key ORDER BY period) <> 0
                 THEN (price_index - lag(price_index) OVER (PARTITION BY key ORDER BY period))
                      / lag(price_index) OVER (PARTITION BY key ORDER BY period) * 100 END AS inflation_pct
  FROM {prefix}_px)"""


def finite(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN {x} END"


def slope(y: str, x: str) -> str:
    yf = finite(y)
    return (f"coalesce(CASE WHEN regr_count({yf}, {x}) >= 2 THEN regr_slope({yf}, {x}) END, 0.0)")


def fsum(y: str) -> str:
    return f"coalesce(sum(coalesce({finite(y)}, 0.0)), 0.0)"

PREDICTIONS = SUPPLIER_MONTH + """,
pred_keys AS (SELECT DISTINCT key FROM supplier_month),
pred_axis AS (SELECT unnest(range(lo, 76)) AS period FROM (SELECT min(period) AS lo FROM supplier_month)),
pred_grid AS (
  SELECT k.key, CAST(g.period AS INTEGER) AS period, m.value
  FROM pred_keys k CROSS JOIN pred_axis g
  LEFT JOIN supplier_month m ON m.key = k.key AND m.period = g.period),
pred_imp AS (
  SELECT *, CASE WHEN period <= 50 THEN coalesce(value, avg(CASE WHEN period <= 50 THEN value END) OVER (PARTITION BY key)) END AS imp
  FROM pred_grid),
predictions AS (
  SELECT key, period,
         value AS actual,
         CASE WHEN period <= 50 THEN lag(imp) OVER (PARTITION BY key ORDER BY period)
              ELSE max(CASE WHEN period = 50 THEN imp END) OVER (PARTITION BY key) END AS forecast
  FROM pred_imp)"""


def feature_chain(src: str, prefix: str = "fc") -> str:
    """Feature rules (non-zero baseline, zeros kept, x/0 = +-inf, no floor), sequential price."""
    return f"""
{prefix}_b AS (SELECT key, arg_min(value, period) FILTER (WHERE value <> 0) AS base FROM {src} GROUP BY key),
{prefix}_o AS (SELECT s.*, CASE WHEN b.base IS NOT NULL THEN s.value / b.base * 100 END AS ofr
               FROM {src} s LEFT JOIN {prefix}_b b ON s.key = b.key),
{prefix}_c AS (SELECT *, CASE WHEN lag(ofr) OVER (PARTITION BY key ORDER BY period) = 0
                              THEN CASE WHEN ofr > 0 THEN 'inf'::DOUBLE WHEN ofr < 0 THEN '-inf'::DOUBLE END
                              ELSE (ofr / lag(ofr) OVER (PARTITION BY key ORDER BY period) - 1) * 100 END AS ofr_change
               FROM {prefix}_o),
{prefix}_f AS (SELECT *, coalesce(1 + 0.5 * (ofr_change / 100), 1.0) AS factor,
                      row_number() OVER (PARTITION BY key ORDER BY period) AS rn FROM {prefix}_c),
{seq_product(prefix + '_f', 'factor', 'price_index', False, prefix + '_r')},
{prefix} AS (SELECT f.* EXCLUDE (factor, rn), r.price_index
             FROM {prefix}_f f JOIN {prefix}_r r ON f.key = r.key AND f.rn = r.rn)"""
