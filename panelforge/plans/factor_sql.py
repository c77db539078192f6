"""The factor queries in plain SQL for DuckDB: weighted covariances, eliminations and robust regressions, written apart from the operators."""

from __future__ import annotations

import re

from panelforge.plans.sql import _EWFULL, _EWMA, _EX, _RISK, _SUMMARY, BACKTEST, D, of, pairs, x

_FACTORS = """factors(k, factor, ticker, n, note) AS (VALUES
  (1, 'Equity', 'T1', 0, 'top level'), (2, 'Rates', 'T2', 0, 'top level'), (3, 'Credit', 'T3', 2, 'without Equity, Rates'), (4, 'Commodities', 'T4', 2, 'without Equity, Rates'), (5, 'ForeignCurrency', 'T5', 2, 'without Equity, Rates'),
  (6, 'Value', 'T6', 4, 'without Equity, Rates, Credit, Commodities'), (7, 'Momentum', 'T7', 4, 'without Equity, Rates, Credit, Commodities'))"""


def weighted(tag: str, source: str, span: int, alone: bool = False) -> str:
    """The table {tag}ewc (t, date, i, j, c) of source (date, ticker, ret): running covariances, or variances alone."""
    text = f"{_EWMA}, {_EWFULL}".replace("0.96875::DOUBLE", f"(1 - 2::DOUBLE / {span + 1})").replace("<= 63", f"<= {span}").replace("FROM live", f"FROM {source}")
    text = text.replace("JOIN used b ON a.date = b.date", "JOIN used b ON a.date = b.date AND a.ticker = b.ticker" if alone else "JOIN used b ON a.date = b.date")
    return re.sub(r"\b(ordered|begin|ew|used|duo|opening|ewc)\b", rf"{tag}\1", text)


def eliminated(tag: str, source: str, keys: str, steps: int) -> str:
    """Gauss-Jordan on the matrix m of each row of source: {tag}1 to {tag}{steps}, one pivot each."""
    step = """{tag}{k} AS (
  SELECT {keys}, CASE WHEN len(m) < {k} THEN m ELSE list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda v: v / m[{k}][{k}]) ELSE list_transform(r, lambda v, j: v - r[{k}] / m[{k}][{k}] * m[{k}][j]) END) END AS m
  FROM {source})"""
    return ", ".join(step.format(tag=tag, k=k, keys=keys, source=f"{tag}{k - 1}" if k > 1 else source) for k in range(1, steps + 1))


#: raw: excess returns, the children's less what their parents explain.
_RAW = f"""{_EX.format(source='complete')}, over_week AS (SELECT date, ticker, exw AS ret FROM ex WHERE exw IS NOT NULL),
{weighted('a', 'over_week', 120)}, {_FACTORS},
squares AS (SELECT date, list(s ORDER BY i) AS s FROM (SELECT date, i, list(c ORDER BY j) AS s FROM aewc WHERE t > 120 GROUP BY date, i) GROUP BY date),
asked AS (
  SELECT date, k, n, list_transform(range(1, n + 1), lambda a: list_append(list_transform(range(1, n + 1), lambda b: s[a][b] + CASE WHEN a = b THEN 1e-7::DOUBLE ELSE 0 END), s[a][k])) AS m
  FROM squares, factors WHERE n > 0
), {eliminated('solved', 'asked', 'date, k, n', 4)},
day_rets AS (SELECT date, list(ex1 ORDER BY ticker) AS r FROM ex GROUP BY date),
raw AS (
  SELECT d.date, f.factor, f.n, CASE WHEN f.n = 0 THEN r[f.k] ELSE r[f.k] - list_sum(list_transform(m, lambda v, i: v[f.n + 1] * r[i])) END AS ret
  FROM day_rets d CROSS JOIN factors f LEFT JOIN solved4 s ON s.date = d.date AND s.k = f.k
)"""
#: made: scaled total returns; lev: their levels.
_MADE = f"""{_RAW}, whole_raw AS (SELECT date, factor AS ticker, ret FROM raw WHERE date IN (SELECT date FROM raw GROUP BY date HAVING count(ret) = 7)),
{weighted('b', 'whole_raw', 60, alone=True)},
vol AS (SELECT date, i AS factor, nullif(sqrt(c * 252), 0) AS vol FROM bewc WHERE t > 60),
made AS (
  SELECT date, factor, CASE WHEN n = 0 THEN ret + free WHEN dead THEN ret ELSE ret * 0.15::DOUBLE / vol + free END AS ret
  FROM (SELECT r.date, r.factor, n, ret, vol, ln(1 + rf) AS free, count(vol) OVER (PARTITION BY r.factor) = 0 AS dead FROM raw r LEFT JOIN vol v ON v.date = r.date AND v.factor = r.factor LEFT JOIN rf ON rf.date = r.date)
), lev AS (SELECT date, factor, CASE WHEN ret IS NOT NULL THEN exp(sum(ret) OVER (PARTITION BY factor ORDER BY date)) END AS level FROM made)"""
#: obs: by date the constant, the seven factors by name, and the portfolio.
_OBS = f"""{_MADE}, own AS (SELECT date, nav FROM nav WHERE date IN (SELECT date FROM lev)),
series AS (SELECT date, factor AS s, level AS v FROM lev WHERE date IN (SELECT date FROM own) UNION ALL SELECT date, 'nav', nav FROM own),
weekly AS (SELECT s.date, s, ln(v / lag(v, 5) OVER (PARTITION BY s ORDER BY s.date)) - 5 * ln(1 + coalesce(rf, 0)) AS w FROM series s LEFT JOIN rf ON rf.date = s.date),
filled AS (SELECT date, s, CASE WHEN w IS NULL AND sum((w IS NULL)::INT) OVER (PARTITION BY s ORDER BY date) <= 5 THEN 0 ELSE w END AS w, row_number() OVER (PARTITION BY s ORDER BY date) - 1 AS k FROM weekly),
obs AS (SELECT k, list_concat([1::DOUBLE], list(w ORDER BY s = 'nav', s)) AS z FROM filled GROUP BY k HAVING count(w) = count(*)),
terms AS (SELECT row_number() OVER (ORDER BY factor) + 1 AS a, factor AS term FROM factors UNION ALL SELECT 1, 'const')"""
_WINDOWS = """lost AS (SELECT k, s, sum((w IS NULL)::INT) OVER (PARTITION BY s ORDER BY k ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS n FROM filled),
fits_at AS (SELECT k AS e FROM lost WHERE k >= 120 GROUP BY k HAVING max(n) <= 12),
member AS (SELECT e, o.k, z FROM fits_at f JOIN obs o ON o.k BETWEEN e - 120 AND e - 1)"""
_ONE = "member AS (SELECT (SELECT max(k) FROM filled) AS e, k, z FROM obs)"
#: fit: least squares in each window with Newey-West errors of five lags; the influence of a row on a coefficient is its score times the inverse.
_FITS = f"""sums AS (SELECT e, a, b, sum(z[a] * z[b]) AS q FROM member, range(1, 9) p(a), range(1, 10) q(b) GROUP BY e, a, b),
normal AS (
  SELECT e, list(list_concat(r, list_transform(range(1, 9), lambda j: CASE WHEN j = a THEN 1::DOUBLE ELSE 0 END)) ORDER BY a) AS m
  FROM (SELECT e, a, list(q ORDER BY b) AS r FROM sums GROUP BY e, a) WHERE e IN (SELECT e FROM member GROUP BY e HAVING count(*) > 8) GROUP BY e
), {eliminated('inv', 'normal', 'e', 8)},
rests AS (SELECT e, k, z, m, z[9] - list_sum(list_transform(m, lambda r, i: r[9] * z[i])) AS rest FROM member JOIN inv8 USING (e)),
influence AS (SELECT e, k, a, rest * list_sum(list_transform(m[a], lambda v, i: CASE WHEN i > 9 THEN v * z[i - 9] ELSE 0 END)) AS h FROM rests, range(1, 9) p(a)),
spread AS (
  SELECT e, a, sum(h * (h + 2 * (coalesce(h1, 0) * 5 + coalesce(h2, 0) * 4 + coalesce(h3, 0) * 3 + coalesce(h4, 0) * 2 + coalesce(h5, 0)) / 6)) AS s
  FROM (SELECT e, a, h, lag(h) OVER o AS h1, lag(h, 2) OVER o AS h2, lag(h, 3) OVER o AS h3, lag(h, 4) OVER o AS h4, lag(h, 5) OVER o AS h5 FROM influence WINDOW o AS (PARTITION BY e, a ORDER BY k)) GROUP BY e, a
), quality AS (SELECT e, sum(rest * rest) AS sse, var_pop(z[9]) * count(*) AS total, count(*) AS n FROM rests GROUP BY e),
coefs AS (
  SELECT e, a, m[a][9] AS beta, m[a][9] / sqrt(greatest(s, 0)) AS t_stat, CASE WHEN total > 0 THEN 1 - sse / total END AS rsq, sse / (n - 8) AS resid_var
  FROM inv8 JOIN spread USING (e) JOIN quality USING (e)
), fit AS (SELECT date, k, term, beta, t_stat, rsq, resid_var FROM (SELECT DISTINCT k, date FROM filled) d CROSS JOIN terms t LEFT JOIN coefs c ON c.e = d.k AND c.a = t.a)"""
_ROLLING = (BACKTEST, _OBS, _WINDOWS, _FITS)
_FIT = f"SELECT {D}, term, {x('beta')}, {x('t_stat', 2)}, {x('rsq')}, {x('resid_var', 8)} FROM fit"
_LATEST = f"""last_betas AS (
  SELECT factor, beta, t_stat, abs(t_stat) >= 1.96 AS significant, CASE WHEN beta >= 0 THEN 'pos' ELSE 'neg' END || CASE WHEN abs(t_stat) >= 1.96 THEN '_sig' ELSE '_nonsig' END AS color_key, note
  FROM fit JOIN factors ON factor = term WHERE beta IS NOT NULL AND date = (SELECT max(date) FROM fit WHERE beta IS NOT NULL)
)"""
_DAILY = """one_day AS (SELECT date, factor, ln(level / lag(level) OVER (PARTITION BY factor ORDER BY date)) AS f FROM lev WHERE date IN (SELECT date FROM own)),
own_day AS (SELECT o.date, ln(nav / lag(nav) OVER (ORDER BY o.date)) AS p, ln(1 + rf) AS free FROM own o JOIN rf ON rf.date = o.date),
parts AS (SELECT o.date, factor, beta * (f - free) AS contrib, p, free FROM fit b JOIN one_day d ON d.date = b.date AND d.factor = term JOIN own_day o ON o.date = b.date),
whole AS (SELECT date, any_value(p) AS p, any_value(free) AS free, coalesce(sum(contrib), 0) AS c FROM parts GROUP BY date),
daily AS (
  SELECT date, factor AS component, contrib FROM parts UNION ALL SELECT date, 'RiskFree', free FROM whole
  UNION ALL SELECT date, 'Residual', p - free - c FROM whole UNION ALL SELECT date, 'Total', p FROM whole
), trended AS (
  SELECT date, component, CASE WHEN count(contrib) OVER w = 126 THEN exp(sum(contrib) OVER w) - 1 END AS contrib FROM daily WINDOW w AS (PARTITION BY component ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)
)"""
_FACTOR_RISK = f"""steps_of AS (SELECT date, factor AS ticker, level / lag(level) OVER (PARTITION BY factor ORDER BY date) - 1 AS ret FROM lev),
whole_steps AS (SELECT * FROM steps_of WHERE date IN (SELECT date FROM steps_of GROUP BY date HAVING count(ret) = 7)),
{weighted('c', 'whole_steps', 63)}, cov AS (SELECT date, i, j, CASE WHEN t > 63 THEN c END AS cov FROM cewc WHERE t > 0),
exposed AS (SELECT date, term AS ticker, beta AS weight FROM fit WHERE term <> 'const' AND beta IS NOT NULL),
{_RISK.replace('held h', 'exposed h')},
split AS (
  SELECT date, s AS systematic_vol, i AS idio_vol, CASE WHEN s * s + i * i > 0 THEN s * s / (s * s + i * i) ELSE 0 END AS systematic_share, CASE WHEN s * s + i * i > 0 THEN i * i / (s * s + i * i) ELSE 0 END AS idio_share
  FROM (SELECT v.date, vol * sqrt(252::DOUBLE) AS s, sqrt(resid_var) * sqrt(252::DOUBLE / 5) AS i FROM vols v JOIN fit f ON f.date = v.date AND term = 'const')
)"""
#: The same with covariances of the last 63 rows.
_SAMPLE_RISK = f"""{_FACTOR_RISK[: _FACTOR_RISK.index(weighted('c', 'whole_steps', 63))]}{pairs('whole_steps', 'ret')},
cov AS (SELECT date, i, j, CASE WHEN count(*) OVER w = 63 THEN covar_samp(x, y) OVER w END AS cov FROM pairs WINDOW w AS (PARTITION BY i, j ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
{_FACTOR_RISK[_FACTOR_RISK.index('exposed AS') :]}"""
_LAST = "WHERE date = (SELECT max(date) FROM exposed)"
_A = "sqrt(252.0::DOUBLE)"

SQL: dict[str, str] = {
    "residualize_four_parent": of(f"SELECT {D}, factor, {x('ret', 8)} FROM raw", _RAW),
    "factor_construction_full": of(f"SELECT {D}, factor, {x('ret', 8)} FROM made", _MADE),
    "factor_index": of(f"SELECT {D}, factor, {x('level')} FROM lev", _MADE),
    "beta_full_multi": of(f"{_FIT} WHERE k = (SELECT max(k) FROM filled)", BACKTEST, _OBS, _ONE, _FITS),
    "beta_rolling_multi_hac": of(_FIT, *_ROLLING),
    "rolling_beta_view": of(f"SELECT {D}, term AS factor, {x('beta')}, {x('t_stat', 2)} FROM fit WHERE term <> 'const' AND beta IS NOT NULL", *_ROLLING),
    "latest_beta_table": of(f"SELECT factor, significant, color_key, note, {x('beta')}, {x('t_stat', 2)} FROM last_betas", *_ROLLING, _LATEST),
    "betas_by_size": of(f"SELECT row_number() OVER (ORDER BY beta DESC, factor) AS place, factor, {x('beta')} FROM last_betas", *_ROLLING, _LATEST),
    "attribution_daily": of(f"SELECT {D}, component, {x('contrib', 8)} FROM daily", *_ROLLING, _DAILY),
    "attribution_trend": of(
        f"SELECT {D}, component, CASE component WHEN 'Total' THEN '0' WHEN 'RiskFree' THEN '2' WHEN 'Residual' THEN '3' ELSE '1' || component END AS place, {x('contrib', 8)} FROM trended", *_ROLLING, _DAILY
    ),
    "trend_percentiles": of(
        f"SELECT {x('low', 8, 'CASE WHEN p[1] < p[2] THEN p[1] ELSE p[1] - 1e-6 END')}, {x('high', 8, 'CASE WHEN p[1] < p[2] THEN p[2] ELSE p[2] + 1e-6 END')} FROM (SELECT quantile_cont(contrib, [0.03, 0.97]) AS p FROM trended HAVING count(*) > 0)", *_ROLLING, _DAILY
    ),
    "factor_risk_latest": of(f"SELECT {D}, label, {x('exposure')}, {x('vol', 6, f'vol * {_A}')}, {x('mctr', 6, f'mctr * {_A}')}, {x('ctr', 6, f'ctr * {_A}')}, {x('ctr_pct')} FROM rc {_LAST}", *_ROLLING, _FACTOR_RISK),
    "factor_risk_sample": of(f"SELECT {D}, label, {x('exposure')}, {x('vol', 6, f'vol * {_A}')}, {x('mctr', 6, f'mctr * {_A}')}, {x('ctr', 6, f'ctr * {_A}')}, {x('ctr_pct')} FROM rc {_LAST}", *_ROLLING, _SAMPLE_RISK),
    "factor_risk_rebal": of(f"SELECT {D}, label, {x('exposure')}, {x('vol', 6, f'vol * {_A}')}, {x('mctr', 6, f'mctr * {_A}')}, {x('ctr', 6, f'ctr * {_A}')}, {x('ctr_pct')} FROM rc WHERE date IN (SELECT date FROM steps WHERE hit)", *_ROLLING, _FACTOR_RISK),
    "variance_split": of(f"SELECT {D}, {x('systematic_vol')}, {x('idio_vol')}, {x('systematic_share')}, {x('idio_share')} FROM split", *_ROLLING, _FACTOR_RISK),
    "context_snapshot": of(
        f"""SELECT 'all' AS panel_id, '{{"summary_stats":{{' || (SELECT string_agg('"' || metric || '":"' || CASE WHEN day IS NOT NULL THEN day WHEN value IS NULL THEN '' WHEN metric = 'Sharpe' THEN printf('%.2f', value) WHEN metric LIKE '%(days)' THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE printf('%.2f%%', 100 * value) END || '"', ',' ORDER BY metric)
  FROM lines WHERE value IS NOT NULL OR day IS NOT NULL OR metric IN ('Sharpe', 'Max drawdown'))
 || '}},"current_drawdown":"' || (SELECT printf('%.2f%%', 100 * (max_by(nav, date) / max(nav) - 1)) FROM nav)
 || coalesce('","weights":{{' || (SELECT string_agg('"' || ticker || '":"' || printf('%.4f%%', 100 * weight) || '"', ',' ORDER BY ticker) FROM held WHERE date = (SELECT max(date) FROM held) AND weight <> 0) || '}}', '"')
 || coalesce(',"factor_exposures":{{' || (SELECT string_agg('"' || factor || '":"' || printf('%.2f (t=%.1f)', beta, t_stat) || CASE WHEN significant THEN ' (Sig)' ELSE '' END || '"', ',' ORDER BY factor) FROM last_betas) || '}}', '')
 || coalesce(',"variance":{{' || (SELECT '"systematic":"' || printf('%.1f%%', 100 * systematic_share) || '","idiosyncratic":"' || printf('%.1f%%', 100 * idio_share) || '"' FROM split {_LAST}) || '}}', '') || '}}' AS json""",
        *_ROLLING, _LATEST, _FACTOR_RISK, _SUMMARY,
    ),
}
