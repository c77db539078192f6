"""The same results in plain SQL for DuckDB, written apart from the operators."""

from __future__ import annotations

PANEL = """panel AS (
  SELECT CAST(l_shipdate AS DATE) AS date, 'T' || l_linenumber AS ticker,
         100 + CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 5000.0::DOUBLE AS price
  FROM lineitem GROUP BY 1, 2
), days AS (SELECT date, row_number() OVER (ORDER BY date) AS rn FROM (SELECT DISTINCT date FROM panel)),
tickers AS (SELECT DISTINCT ticker FROM panel),
grid AS (SELECT d.date, t.ticker, p.price FROM days d CROSS JOIN tickers t LEFT JOIN panel p ON p.date = d.date AND p.ticker = t.ticker),
rf AS (SELECT date, (2.0::DOUBLE + 0.01::DOUBLE * (rn % 50)) / 100 / 252 AS rf FROM days),
full_days AS (SELECT date FROM panel GROUP BY date HAVING count(*) = (SELECT count(*) FROM tickers)),
complete AS (SELECT p.* FROM panel p JOIN full_days USING (date))"""

RATES = """rates AS (
  SELECT date, 'EURUSD=X' AS pair, 1.1::DOUBLE + 0.0001::DOUBLE * (rn % 100) AS rate FROM days
  UNION ALL SELECT date, 'CHFUSD=X', 1.05::DOUBLE - 0.0001::DOUBLE * (rn % 70) FROM days
  UNION ALL SELECT date, 'CHFEUR=X', 0.95::DOUBLE + 0.0002::DOUBLE * (rn % 30) FROM days)"""

HOLIDAYS = """all_days AS (
  SELECT CAST(d AS DATE) AS d, month(d) AS m, day(d) AS n, isodow(d) AS w
  FROM (SELECT unnest(generate_series(date_trunc('month', (SELECT min(date) FROM {days}))::TIMESTAMP, last_day((SELECT max(date) FROM {days}))::TIMESTAMP, INTERVAL 1 DAY)) AS d)
), fixed AS (
  SELECT CAST(make_date(y, f.m, f.n) AS DATE) AS real
  FROM (SELECT unnest(generate_series(1980, 2060)) AS y) ys, (VALUES (1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0)) AS f(m, n, since) WHERE y >= since
), observed AS (
  SELECT CASE isodow(real) WHEN 6 THEN real - 1 WHEN 7 THEN real + 1 ELSE real END AS d FROM fixed
), open_days AS (
  SELECT d FROM all_days
  WHERE w <= 5 AND d NOT IN (SELECT d FROM observed)
    AND NOT (w = 1 AND m = 1 AND ceil(n / 7.0) = 3) AND NOT (w = 1 AND m = 2 AND ceil(n / 7.0) = 3) AND NOT (w = 1 AND m = 5 AND n > 24)
    AND NOT (w = 1 AND m = 9 AND n <= 7) AND NOT (w = 1 AND m = 10 AND ceil(n / 7.0) = 2) AND NOT (w = 4 AND m = 11 AND ceil(n / 7.0) = 4)
), starts AS (SELECT min(d) AS date FROM open_days GROUP BY date_trunc('month', d)),
ends AS (SELECT max(d) AS date FROM open_days GROUP BY date_trunc('month', d))"""

BACKTEST = """two AS (
  SELECT date, max(price) FILTER (ticker = 'T1') AS p1, max(price) FILTER (ticker = 'T2') AS p2 FROM panel WHERE ticker IN ('T1', 'T2') GROUP BY date HAVING count(*) = 2
), """ + HOLIDAYS.format(days="two") + """, steps AS (
  SELECT row_number() OVER (ORDER BY date) - 1 AS t, date, p1, p2, coalesce(lag(p1) OVER (ORDER BY date), p1) AS b1, coalesce(lag(p2) OVER (ORDER BY date), p2) AS b2,
         date IN (SELECT date FROM starts) AS hit
  FROM two
), bt AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(NULL AS DATE) AS date, 1e6::DOUBLE AS cash, 0::DOUBLE AS u1, 0::DOUBLE AS u2, 1e6::DOUBLE AS nav, 0::DOUBLE AS cost, 0::DOUBLE AS p1, 0::DOUBLE AS p2, 0::DOUBLE AS moved
  UNION ALL
  SELECT t, date, cash - c - (n1 - u1) * p1 - (n2 - u2) * p2, n1, n2, cash - c - (n1 - u1) * p1 - (n2 - u2) * p2 + n1 * p1 + n2 * p2, c, p1, p2, abs(n1 - u1) * p1 + abs(n2 - u2) * p2
  FROM (SELECT s.t, s.date, b.cash, b.u1, b.u2, s.p1, s.p2, n.n1, n.n2, (abs(n.n1 - b.u1) * s.p1 + abs(n.n2 - b.u2) * s.p2) * 0.001::DOUBLE AS c
        FROM bt b JOIN steps s ON s.t = b.t + 1,
             LATERAL (SELECT CASE WHEN s.hit THEN b.nav * 0.6::DOUBLE / s.b1 ELSE b.u1 END AS n1, CASE WHEN s.hit THEN b.nav * 0.4::DOUBLE / s.b2 ELSE b.u2 END AS n2) n)
), nav AS (SELECT * FROM bt WHERE t >= 0),
held AS (
  SELECT date, nav, 'T1' AS ticker, u1 AS units, p1 AS price, u1 * p1 / nav AS weight FROM nav
  UNION ALL SELECT date, nav, 'T2', u2, p2, u2 * p2 / nav FROM nav
), rets AS (
  SELECT n.date, nav, nav / lag(nav) OVER (ORDER BY n.date) - 1 AS ret, nav / lag(nav) OVER (ORDER BY n.date) - 1 - rf AS excess FROM nav n JOIN rf ON rf.date = n.date
), dd AS (
  SELECT date, level, level / max(level) OVER (ORDER BY date) - 1 AS drawdown
  FROM (SELECT date, product(1 + coalesce(excess, 0)) OVER (ORDER BY date) AS level FROM rets)
)"""

ASSETS = """assets(ticker, name, asset_class, currency, description) AS (VALUES
  ('T1', 'Stocks', 'Equity', 'USD', 'Broad stock basket'), ('T2', 'Bonds', 'Rates', 'USD', 'Government bond basket'),
  ('T3', 'Corporates', 'Credit', 'EUR', 'Corporate bond basket'), ('T4', 'Materials', 'Commodities', 'CHF', 'Commodity basket'),
  ('T5', 'Currencies', 'FX', 'USD', 'Currency basket'), ('T6', 'Cheap stocks', 'Equity', 'EUR', 'Value stock basket'), ('T7', 'Winners', 'Equity', 'CHF', 'Momentum stock basket'))"""


def x(name: str, digits: int = 6, value: str | None = None) -> str:
    return f"round({value or name}, {digits}) + 0.0::DOUBLE AS {name}"


D = "CAST(date AS VARCHAR) AS date"
W = "OVER (PARTITION BY ticker ORDER BY date)"


def of(body: str, *parts: str) -> str:
    return f"WITH RECURSIVE {', '.join([PANEL, *parts])}\n{body}"


def grid_returns(value: str, digits: int = 8) -> str:
    return of(f"SELECT {D}, ticker, {x('ret', digits, value)} FROM grid")


def pairs(source: str, value: str) -> str:
    return f"pairs AS (SELECT a.date, a.ticker AS i, b.ticker AS j, a.{value} AS x, b.{value} AS y FROM {source} a JOIN {source} b ON a.date = b.date)"


_LOG = f"logs AS (SELECT date, ticker, ln(price / lag(price) {W}) AS ret FROM complete), live AS (SELECT * FROM logs WHERE ret IS NOT NULL)"
_EX = f"""raw_ex AS (SELECT date, ticker, ln(price / lag(price) {W}) AS r1, ln(price / lag(price, 5) {W}) AS r5 FROM {{source}}),
counted AS (SELECT *, sum((r1 IS NULL)::INT) {W} AS k1, sum((r5 IS NULL)::INT) {W} AS k5 FROM raw_ex),
ex AS (SELECT c.date, ticker, CASE WHEN r1 IS NULL AND k1 <= 5 THEN 0.0::DOUBLE ELSE r1 END - ln(1 + rf) AS ex1, CASE WHEN r5 IS NULL AND k5 <= 5 THEN 0.0::DOUBLE ELSE r5 END - 5 * ln(1 + rf) AS exw FROM counted c JOIN rf ON rf.date = c.date)"""

#: Running moments by series: state by ticker, one step for each row.
_EWMA = """ordered AS (SELECT ticker, date, ret, row_number() OVER (PARTITION BY ticker ORDER BY date) AS t FROM live),
begin AS (SELECT ticker, avg(ret) AS m, var_pop(ret) AS v FROM ordered WHERE t <= 63 GROUP BY ticker),
ew AS (
  SELECT CAST(0 AS BIGINT) AS t, ticker, CAST(NULL AS DATE) AS date, 0::DOUBLE AS clipped, m, v, v AS sq FROM begin
  UNION ALL
  SELECT t, ticker, date, c, (1 - 0.96875::DOUBLE) * c + 0.96875::DOUBLE * m, CASE WHEN vol > 1e-8 THEN 0.96875::DOUBLE * v + (1 - 0.96875::DOUBLE) * c * c ELSE v END, 0.96875::DOUBLE * sq + (1 - 0.96875::DOUBLE) * c * c
  FROM (SELECT o.t, o.ticker, o.date, e.m, e.v, e.sq, sqrt(e.v) AS vol, CASE WHEN sqrt(e.v) > 1e-8 THEN greatest(least(o.ret, 5 * sqrt(e.v)), -5 * sqrt(e.v)) ELSE 0 END AS c
        FROM ew e JOIN ordered o ON o.ticker = e.ticker AND o.t = e.t + 1)
)"""
_EWCOV = """ordered AS (SELECT date, i, j, x * y AS xy, x, y, row_number() OVER (PARTITION BY i, j ORDER BY date) AS t FROM pairs),
begin AS (SELECT i, j, covar_samp(x, y) AS c FROM ordered WHERE t <= 63 GROUP BY i, j),
ew AS (
  SELECT CAST(0 AS BIGINT) AS t, i, j, CAST(NULL AS DATE) AS date, c FROM begin
  UNION ALL
  SELECT o.t, o.i, o.j, o.date, (1 - 0.96875::DOUBLE) * xy + 0.96875::DOUBLE * e.c FROM ew e JOIN ordered o ON o.i = e.i AND o.j = e.j AND o.t = e.t + 1
)"""
_SIMPLE = """simple AS (SELECT date, 'T1' AS ticker, p1 / lag(p1) OVER (ORDER BY date) - 1 AS ret FROM two UNION ALL SELECT date, 'T2', p2 / lag(p2) OVER (ORDER BY date) - 1 FROM two),
live AS (SELECT * FROM simple WHERE ret IS NOT NULL)"""
_RISK = """sx AS (SELECT h.date, i AS label, sum(cov * h.weight) AS sx FROM cov c JOIN held h ON h.date = c.date AND h.ticker = c.j GROUP BY 1, 2),
vols AS (SELECT s.date, CASE WHEN sum(weight * sx) > 0 THEN sqrt(sum(weight * sx)) END AS vol FROM sx s JOIN held h ON h.date = s.date AND h.ticker = s.label GROUP BY s.date),
rc AS (SELECT s.date, s.label, h.weight AS exposure, vol, sx / vol AS mctr, h.weight * sx / vol AS ctr, h.weight * sx / vol / vol AS ctr_pct
       FROM sx s JOIN held h ON h.date = s.date AND h.ticker = s.label JOIN vols v ON v.date = s.date)"""
_ASSET_COV = f"""{_SIMPLE}, {pairs('live', 'ret')},
cov AS (SELECT date, i, j, CASE WHEN count(*) OVER w = 63 THEN covar_samp(x, y) OVER w END AS cov FROM pairs WINDOW w AS (PARTITION BY i, j ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
{_RISK}"""
#: Covariances of what _EWMA has cut and centred.
_EWFULL = """used AS (SELECT e.t, e.ticker, e.date, o.ret, e.clipped - e.m AS u FROM ew e JOIN ordered o ON o.ticker = e.ticker AND o.t = e.t WHERE e.t > 0),
duo AS (SELECT a.t, a.date, a.ticker AS i, b.ticker AS j, a.ret AS x, b.ret AS y, a.u * b.u AS uv FROM used a JOIN used b ON a.date = b.date),
opening AS (SELECT i, j, covar_samp(x, y) AS c FROM duo WHERE t <= 63 GROUP BY i, j),
ewc AS (
  SELECT CAST(0 AS BIGINT) AS t, i, j, CAST(NULL AS DATE) AS date, c FROM opening
  UNION ALL
  SELECT d.t, d.i, d.j, d.date, (1 - 0.96875::DOUBLE) * d.uv + 0.96875::DOUBLE * e.c FROM ewc e JOIN duo d ON d.i = e.i AND d.j = e.j AND d.t = e.t + 1
)"""
_RC = f"SELECT {D}, label, {x('exposure')}, {x('vol', 6, 'vol * sqrt(252.0::DOUBLE)')}, {x('mctr', 6, 'mctr * sqrt(252.0::DOUBLE)')}, {x('ctr', 6, 'ctr * sqrt(252.0::DOUBLE)')}, {x('ctr_pct')} FROM rc"
_FIT = f"""lv AS (
  SELECT date, ln(price / lag(price, 5) OVER (ORDER BY date)) AS f FROM complete WHERE ticker = 'T1'
), nv AS (
  SELECT date, ln(nav / lag(nav, 5) OVER (ORDER BY date)) AS p FROM nav JOIN full_days USING (date)
), fit AS (
  SELECT date, coalesce(p - 5 * ln(1 + rf), 0) AS y, coalesce(f - 5 * ln(1 + rf), 0) AS x FROM lv JOIN nv USING (date) JOIN rf USING (date)
)"""
_MONTHS = """months AS (SELECT date_trunc('month', date) AS m, product(1 + excess) - 1 AS ret FROM rets WHERE excess IS NOT NULL GROUP BY 1),
spine AS (SELECT unnest(generate_series((SELECT min(m) FROM months)::TIMESTAMP, (SELECT max(m) FROM months)::TIMESTAMP, INTERVAL 1 MONTH)) AS m),
monthly AS (SELECT year(s.m) AS year, month(s.m) AS month, coalesce(ret, 0) AS ret FROM spine s LEFT JOIN months o ON o.m = s.m)"""
_SUMMARY = """ranked AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS k, max(date) OVER () AS last FROM rets),
figures AS (
  SELECT min(date) AS d0, max(date) AS d1, avg(excess) / stddev_samp(excess) * sqrt(252.0::DOUBLE) AS sharpe, stddev_samp(ret) * sqrt(252.0::DOUBLE) AS vol,
         pow(max_by(nav, date) / min_by(nav, date), 252.0::DOUBLE / date_diff('day', min(date), max(date))) - 1 AS cagr,
         CASE WHEN count(*) FILTER (date >= date_trunc('year', last)) >= 2 THEN max_by(nav, date) / min_by(nav, date) FILTER (date >= date_trunc('year', last)) - 1 END AS ytd,
         max_by(nav, date) / min_by(nav, date) FILTER (k <= 63) - 1 AS m3, max_by(nav, date) / min_by(nav, date) FILTER (k <= 126) - 1 AS m6, max_by(nav, date) / min_by(nav, date) FILTER (k <= 252) - 1 AS y1
  FROM ranked
), runs AS (SELECT count(*) FILTER (drawdown < 0) AS n FROM (SELECT drawdown, sum((drawdown >= 0)::INT) OVER (ORDER BY date) AS g FROM dd) GROUP BY g),
lines AS (
  SELECT 1 AS ord, 'Start Period' AS metric, CAST(d0 AS VARCHAR) AS day, CAST(NULL AS DOUBLE) AS value FROM figures
  UNION ALL SELECT 2, 'End Period', CAST(d1 AS VARCHAR), NULL FROM figures UNION ALL SELECT 3, 'Sharpe', NULL, sharpe FROM figures
  UNION ALL SELECT 4, 'Max drawdown', NULL, (SELECT min(drawdown) FROM dd) UNION ALL SELECT 5, 'Longest drawdown (days)', NULL, (SELECT max(n) FROM runs)
  UNION ALL SELECT 6, 'YTD', NULL, ytd FROM figures UNION ALL SELECT 7, '3M', NULL, m3 FROM figures UNION ALL SELECT 8, '6M', NULL, m6 FROM figures UNION ALL SELECT 9, '1Y', NULL, y1 FROM figures
  UNION ALL SELECT 10, 'Annualized Return (CAGR)', NULL, cagr FROM figures UNION ALL SELECT 11, 'Annualized Historical Volatility', NULL, vol FROM figures
)"""
_PX = f"SELECT {D}, ticker, {x('price', 9)} FROM "
_WIDE = ", ".join(f"round(max(price) FILTER (ticker = 'T{k}'), 9) + 0.0::DOUBLE AS T{k}" for k in range(1, 8))
_MASK = f"SELECT {D}, date IN (SELECT date FROM {{}}) AS is_rebal FROM days"
_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

SQL: dict[str, str] = {
    "panel_prices": of(_PX + "panel"),
    "panel_wide_pivot": of(f"SELECT {D}, {_WIDE} FROM panel GROUP BY date"),
    "panel_unpivot": of(_PX + "panel"),
    "panel_complete_dates": of(_PX + "complete"),
    "panel_clamp": of(_PX + "panel WHERE date BETWEEN DATE '1990-01-01' AND DATE '1997-12-31'"),
    "panel_ffill5": of(_PX + "(SELECT date, ticker, last_value(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS price FROM grid)"),
    "ffill_bfill": of(
        _PX + f"(SELECT date, ticker, coalesce(last_value(price IGNORE NULLS) {W}, first_value(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM grid)"
    ),
    "fill_budget0": of(_PX + f"(SELECT date, ticker, CASE WHEN price IS NULL AND sum((price IS NULL)::INT) {W} <= 5 THEN 0 ELSE price END AS price FROM grid)"),
    "input_validation": of(
        """, wanted AS (SELECT s.date, w.ticker, w.weight FROM starts s JOIN days d ON d.date = s.date, (VALUES ('T1', 0.6), ('T2', 0.5), ('T9', -0.1)) AS w(ticker, weight))
SELECT 'price missing or not finite' AS problem, count(*) FILTER (price IS NULL) AS rows FROM grid
UNION ALL SELECT 'price not positive', count(*) FILTER (price <= 0) FROM grid
UNION ALL SELECT 'weight missing or not finite', 0 UNION ALL SELECT 'weight negative', count(*) FILTER (weight < 0) FROM wanted
UNION ALL SELECT 'weight without price', count(*) FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM tickers t WHERE t.ticker = w.ticker)
UNION ALL SELECT 'price without weight', count(*) FROM tickers WHERE ticker NOT IN ('T1', 'T2', 'T9')""",
        HOLIDAYS.format(days="days"),
    ).replace("\n,", ","),
    "returns_log": grid_returns(f"ln(price / lag(price) {W})"),
    "returns_simple": grid_returns(f"price / lag(price) {W} - 1"),
    "returns_5d": grid_returns(f"ln(price / lag(price, 5) {W})"),
    "pct_change_pad": of(
        f"SELECT {D}, ticker, {x('ret', 8, f'f / lag(f) {W} - 1')} FROM (SELECT date, ticker, last_value(price IGNORE NULLS) {W} AS f FROM grid)"
    ),
    "index_log": of(f"SELECT {D}, ticker, {x('level', 6, f'CASE WHEN r IS NOT NULL THEN exp(sum(r) {W}) END')} FROM (SELECT date, ticker, ln(price / lag(price) {W}) AS r FROM grid)"),
    "index_simple": of(f"SELECT {D}, ticker, {x('level', 6, f'CASE WHEN r IS NOT NULL THEN product(1 + r) {W} END')} FROM (SELECT date, ticker, price / lag(price) {W} - 1 AS r FROM grid)"),
    "excess_returns_1d_5d": of(f"SELECT {D}, ticker, {x('ex1', 8)}, {x('exw', 8)} FROM ex", _EX.format(source="grid")),
    "fx_normalize": of(
        f"""SELECT CAST(p.date AS VARCHAR) AS date, p.ticker, {x('price', 6, "CASE a.currency WHEN 'EUR' THEN price WHEN 'CHF' THEN price * c.rate ELSE price / e.rate END")}
FROM panel p JOIN assets a USING (ticker) JOIN rates c ON c.date = p.date AND c.pair = 'CHFEUR=X' JOIN rates e ON e.date = p.date AND e.pair = 'EURUSD=X'""",
        RATES,
        ASSETS,
    ),
    "fx_triangulate": of(
        f"""SELECT {D}, {x('price', 9, 'price / coalesce(a, b)')} FROM (
  SELECT p.date, price, last_value(rate IGNORE NULLS) OVER (ORDER BY p.date) AS a, first_value(rate IGNORE NULLS) OVER (ORDER BY p.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
  FROM panel p LEFT JOIN rates r ON r.date = p.date AND r.pair = 'CHFUSD=X' AND day(r.date) > 5 WHERE ticker = 'T5')""",
        RATES,
    ),
    "risk_free_daily": of(
        f"""SELECT {D}, 'USD' AS base, {x('rf', 8)} FROM rf
UNION ALL SELECT {D}, CASE ticker WHEN 'T3' THEN 'EUR' ELSE 'CHF' END, round(coalesce(f / lag(f) {W} - 1, 0), 8) + 0.0::DOUBLE
FROM (SELECT date, ticker, last_value(price IGNORE NULLS) {W} AS f FROM grid WHERE ticker IN ('T3', 'T4'))"""
    ),
    "rebal_month_start": of(_MASK.format("starts"), HOLIDAYS.format(days="days")),
    "rebal_month_end": of(_MASK.format("ends"), HOLIDAYS.format(days="days")),
    "buy_and_hold_mask": of(f"SELECT {D}, date = (SELECT min(date) FROM days JOIN starts USING (date)) AS is_rebal FROM days", HOLIDAYS.format(days="days")),
    "target_weights": of(f"SELECT {D}, ticker, {x('weight', 4)} FROM (SELECT date, 'T1' AS ticker, 0.6::DOUBLE AS weight FROM steps WHERE hit UNION ALL SELECT date, 'T2', 0.4 FROM steps WHERE hit)", BACKTEST),
    "backtest_nav": of(f"SELECT {D}, {x('nav', 4)}, {x('cash', 4)} FROM nav", BACKTEST),
    "backtest_weights": of(f"SELECT {D}, ticker, {x('units', 4)}, {x('weight')} FROM held", BACKTEST),
    "backtest_costs": of(f"SELECT {D}, {x('cost', 4)} FROM nav WHERE cost > 0", BACKTEST),
    "backtest_turnover": of(f"SELECT {D}, {x('turnover', 6, 'moved / nav')}, {x('gross', 6, '(abs(u1) * p1 + abs(u2) * p2) / nav')} FROM nav", BACKTEST),
    "weight_deviation_by_class": of(
        f"""SELECT {D}, series, {x('value')} FROM (
  SELECT h.date, asset_class AS series, sum(weight - CASE WHEN h.date >= (SELECT min(date) FROM steps WHERE hit) THEN CASE ticker WHEN 'T1' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END ELSE 0 END) AS value
  FROM held h JOIN assets USING (ticker) GROUP BY 1, 2 UNION ALL SELECT date, 'Upper corridor', 0.02 FROM nav UNION ALL SELECT date, 'Lower corridor', -0.02 FROM nav)""",
        BACKTEST,
        ASSETS,
    ),
    "perf_summary": of(f"SELECT CAST(ord AS BIGINT) AS ord, metric, day, {x('value')} FROM lines WHERE value IS NOT NULL OR day IS NOT NULL OR metric IN ('Sharpe', 'Max drawdown')", BACKTEST, _SUMMARY),
    "ytd_trailing_returns": of(f"SELECT {x('ytd')}, {x('m3')}, {x('m6')}, {x('y1')} FROM figures", BACKTEST, _SUMMARY),
    "cagr_vol": of(f"SELECT {x('cagr')}, {x('vol')} FROM figures", BACKTEST, _SUMMARY),
    "sharpe": of(f"SELECT {x('sharpe')} FROM figures", BACKTEST, _SUMMARY),
    "drawdown_series": of(f"SELECT {D}, {x('level')}, {x('drawdown')} FROM dd", BACKTEST),
    "max_drawdown": of(f"SELECT {x('max_dd', 6, 'min(drawdown)')} FROM dd", BACKTEST),
    "longest_drawdown": of("SELECT max(n) AS longest FROM (SELECT count(*) FILTER (d < 0) AS n FROM (SELECT d, sum((d >= 0)::INT) OVER (ORDER BY date) AS g FROM (SELECT date, round(drawdown, 9) AS d FROM dd)) GROUP BY g)", BACKTEST),
    "current_drawdown": of(f"SELECT {x('current', 6, 'max_by(nav, date) / max(nav) - 1')} FROM nav", BACKTEST),
    "rolling_vol_126": of(
        f"SELECT {D}, {x('vol', 6, 'CASE WHEN count(*) OVER w = 126 THEN stddev_samp(excess) OVER w * sqrt(252.0::DOUBLE) END')} FROM rets WHERE excess IS NOT NULL WINDOW w AS (ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)",
        BACKTEST,
    ),
    "monthly_return_matrix": of(f"SELECT year, month, {x('ret')} FROM monthly", BACKTEST, _MONTHS),
    "monthly_return_wide": of("SELECT year, " + ", ".join(f"round(max(ret) FILTER (month = {k}), 6) + 0.0::DOUBLE AS {n}" for k, n in enumerate(_NAMES, 1)) + " FROM monthly GROUP BY year", BACKTEST, _MONTHS),
    "universe_table": of(
        """SELECT ticker, asset_class, currency, printf('%.1f%%', 100 * a) AS weight_start, printf('%.1f%%', 100 * b) AS weight_end, description
FROM (SELECT ticker, max(weight) FILTER (k = least(2, n)) AS a, max(weight) FILTER (k = n) AS b FROM (SELECT ticker, weight, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM held) GROUP BY ticker) JOIN assets USING (ticker)""",
        BACKTEST,
        ASSETS,
    ),
    "weights_nonzero_latest": of(f"SELECT ticker, printf('%.4f%%', 100 * weight) AS shown, {x('weight')} FROM held WHERE date = (SELECT max(date) FROM held) AND weight <> 0", BACKTEST),
    "formatted_summary": of(
        "SELECT CAST(ord AS BIGINT) AS ord, metric, CASE WHEN day IS NOT NULL THEN day WHEN metric = 'Sharpe' THEN printf('%.2f', value) WHEN metric LIKE '%(days)' THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE printf('%.2f%%', 100 * value) END AS shown FROM lines WHERE value IS NOT NULL OR day IS NOT NULL",
        BACKTEST,
        _SUMMARY,
    ),
    "sample_cov_rolling": of(
        f"SELECT {D}, i, j, {x('cov', 4, 'CASE WHEN count(*) OVER w = 63 THEN covar_samp(x, y) OVER w * 2520000.0::DOUBLE END')} FROM pairs WINDOW w AS (PARTITION BY i, j ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)",
        _LOG,
        pairs("live", "ret"),
    ),
    "factor_corr": of(f"SELECT i, j, {x('corr', 6, 'corr(x, y)')} FROM pairs GROUP BY i, j", _LOG, pairs("live", "ret")),
    "ewma_moments": of(f"SELECT {D}, ticker, {x('clipped', 8)}, {x('mean', 8, 'm')}, {x('vol', 8, 'sqrt(sq)')} FROM ew WHERE t > 0", _LOG, _EWMA),
    "ewma_cov_noclip": of(f"SELECT {D}, i, j, {x('cov', 4, 'CASE WHEN t > 63 THEN c * 2520000.0::DOUBLE END')} FROM ew WHERE t > 0", _LOG, pairs("live", "ret"), _EWCOV),
    "risk_asset_latest": of(_RC + " WHERE date = (SELECT max(date) FROM held)", BACKTEST, _ASSET_COV),
    "risk_asset_rebal": of(_RC + " WHERE date IN (SELECT date FROM steps WHERE hit)", BACKTEST, _ASSET_COV),
    "risk_by_class": of(
        f"SELECT {D}, asset_class, {x('ctr_pct', 6, 'sum(ctr_pct)')} FROM rc JOIN assets ON assets.ticker = rc.label WHERE date = (SELECT max(date) FROM held) GROUP BY date, asset_class", BACKTEST, _ASSET_COV, ASSETS
    ),
    "residualize_two_parent": of(
        f"""SELECT CAST(y.date AS VARCHAR) AS date, {x('ret', 8, 'y.ex1 - (ay * bb - by_ * ab) / (aa * bb - ab * ab) * a.ex1 - (by_ * aa - ay * ab) / (aa * bb - ab * ab) * b.ex1')}
FROM ex y JOIN ex a ON a.date = y.date AND a.ticker = 'T1' JOIN ex b ON b.date = y.date AND b.ticker = 'T2'
LEFT JOIN (SELECT date, max(c) FILTER (i = 'T1' AND j = 'T1') + 1e-7 AS aa, max(c) FILTER (i = 'T2' AND j = 'T2') + 1e-7 AS bb, max(c) FILTER (i = 'T1' AND j = 'T2') AS ab,
                  max(c) FILTER (i = 'T1' AND j = 'T3') AS ay, max(c) FILTER (i = 'T2' AND j = 'T3') AS by_
           FROM (SELECT date, i, j, CASE WHEN count(*) OVER w = 63 THEN covar_samp(x, y) OVER w END AS c FROM pairs WINDOW w AS (PARTITION BY i, j ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) GROUP BY date) k ON k.date = y.date
WHERE y.ticker = 'T3'""",
        _EX.format(source="complete"),
        pairs("ex", "exw"),
    ),
    "beta_full_single": of(f"SELECT {x('beta', 6, 'regr_slope(y, x)')}, {x('alpha', 6, 'regr_intercept(y, x)')}, {x('rsq', 6, 'regr_r2(y, x)')} FROM fit HAVING count(*) > 0", BACKTEST, _FIT),
    "beta_rolling_single": of(
        f"SELECT {D}, {x('beta', 6, 'CASE WHEN count(*) OVER w = 120 THEN covar_samp(y, x) OVER w / var_samp(x) OVER w END')} FROM fit WINDOW w AS (ORDER BY date ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)", BACKTEST, _FIT
    ),
    "ewma_cov_full": of(f"SELECT {D}, i, j, {x('cov', 4, 'CASE WHEN t > 63 THEN c * 2520000.0::DOUBLE END')} FROM ewc WHERE t > 0", _LOG, _EWMA, _EWFULL),
    "risk_asset_ewma": of(_RC, BACKTEST, _SIMPLE, _EWMA, _EWFULL, "cov AS (SELECT date, i, j, CASE WHEN t > 63 THEN c END AS cov FROM ewc WHERE t > 0)", _RISK),
    "benchmark_excess": of(
        f"SELECT CAST(r.date AS VARCHAR) AS date, {x('excess', 8)}, {x('benchmark', 8, 'coalesce(b, 0) - rf')} FROM rets r JOIN rf ON rf.date = r.date LEFT JOIN (SELECT date, price / lag(price) OVER (ORDER BY date) - 1 AS b FROM panel WHERE ticker = 'T6') k ON k.date = r.date",
        BACKTEST,
    ),
    "latest_cov_matrix": of(
        f"SELECT {D}, i AS label, " + ", ".join(f"round(max(cov) FILTER (j = 'T{k}') * 2520000.0::DOUBLE, 4) + 0.0::DOUBLE AS T{k}" for k in range(1, 8)) + " FROM cov WHERE date = (SELECT max(date) FROM cov) GROUP BY date, i",
        _LOG,
        pairs("live", "ret"),
        "cov AS (SELECT date, i, j, CASE WHEN count(*) OVER w = 63 THEN covar_samp(x, y) OVER w END AS cov FROM pairs WINDOW w AS (PARTITION BY i, j ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))",
    ),
    "risk_ranked": of(f"SELECT row_number() OVER (ORDER BY ctr_pct DESC NULLS LAST, label) AS rank, label, coalesce(ctr_pct >= 0.05, false) AS labelled, {x('ctr_pct')} FROM rc WHERE date = (SELECT max(date) FROM held)", BACKTEST, _ASSET_COV),
    "risk_markdown": of(
        """SELECT '| label | exposure | mctr | ctr | ctr_pct |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY ctr_pct DESC NULLS LAST, label) AS "table"
FROM (SELECT label, ctr_pct, printf('| %s | %.4f | %.4f | %.4f | %.4f |', label, exposure, mctr * sqrt(252.0::DOUBLE), ctr * sqrt(252.0::DOUBLE), ctr_pct) AS line FROM rc WHERE date = (SELECT max(date) FROM held))""",
        BACKTEST,
        _ASSET_COV,
    ),
    "monthly_range": of(f"SELECT {x('low', 6, '-far')}, {x('high', 6, 'far')} FROM (SELECT greatest(abs(least(min(ret), 0)), greatest(max(ret), 0)) AS far FROM monthly)", BACKTEST, _MONTHS),
    "monthly_cells": of(f"SELECT row_number() OVER (ORDER BY year DESC, month) AS place, year, month, {x('ret')} FROM monthly", BACKTEST, _MONTHS),
    "risk_free_notes": of(
        """SELECT base, CASE base WHEN 'usd' THEN 'Risk-free rate: ^IRX (base currency usd)' WHEN 'xyz' THEN 'The risk-free rate follows the base currency (xyz)'
  ELSE 'Risk-free rate: ' || p.ticker || ', ' || a.description || ' (base currency ' || base || ')' END AS note
FROM (SELECT DISTINCT lower(currency) AS base FROM assets JOIN tickers USING (ticker) UNION ALL SELECT 'xyz') b LEFT JOIN (VALUES ('eur', 'T3'), ('chf', 'T4')) AS p(k, ticker) ON p.k = b.base LEFT JOIN assets a ON a.ticker = p.ticker""",
        ASSETS,
    ),
    "backtest_cost_note": of(f"SELECT {D}, printf('Transaction costs: %.1f bps per trade', cost / moved * 10000) AS note, {x('cost', 4)} FROM nav WHERE cost > 0", BACKTEST),
    "period_rules": of(
        """SELECT CAST(CAST(m AS DATE) AS VARCHAR) AS asked, CAST(least(CAST(m AS DATE), fin - 1277) AS VARCHAR) AS start, CAST(fin AS VARCHAR) AS "end"
FROM (SELECT date_trunc('month', date) AS m, greatest(max(date), DATE '1995-06-01') AS fin FROM panel GROUP BY 1)"""
    ),
    "ticker_union": of("SELECT ticker FROM tickers UNION SELECT 'T' || k FROM (SELECT unnest(range(1, 8)) AS k)"),
    "present_factors": of("SELECT CAST(place AS BIGINT) AS place, factor FROM (VALUES (3, 'ForeignCurrency', 'T5'), (4, 'Commodities', 'T4'), (5, 'Credit', 'T3'), (6, 'Rates', 'T2'), (7, 'Equity', 'T1')) AS f(place, factor, ticker) JOIN tickers USING (ticker)"),
    "analysis_summary": of(
        f"SELECT CAST(ord AS BIGINT) AS ord, metric, day, {x('value')} FROM lines WHERE value IS NOT NULL OR day IS NOT NULL OR metric IN ('Sharpe', 'Max drawdown')",
        RATES,
        f"euro AS (SELECT date, coalesce(f / lag(f) OVER (ORDER BY date) - 1, 0) AS rf FROM (SELECT date, last_value(price IGNORE NULLS) {W} AS f FROM grid WHERE ticker = 'T3'))",
        "local AS (SELECT p.date, ticker, price / rate AS price FROM panel p JOIN rates r ON r.date = p.date AND pair = 'EURUSD=X')",
        BACKTEST.replace("FROM panel WHERE ticker IN", "FROM local WHERE ticker IN").replace("IN (SELECT date FROM starts)", "IN (SELECT date FROM ends)").replace("0.6::DOUBLE", "0.5::DOUBLE").replace("0.4::DOUBLE", "0.5::DOUBLE").replace("JOIN rf ON rf.date", "JOIN euro rf ON rf.date"),
        _SUMMARY,
    ),
}
