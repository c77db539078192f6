"""Least squares with autocorrelation-robust errors."""

from __future__ import annotations

import numpy as np


def ols_hac(x: np.ndarray, y: np.ndarray, max_lags: int = 5) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(coefficients, t statistics, R squared, residual variance) of y on a constant and x, rows with a missing value left out.

    Errors are Newey-West's with Bartlett weights and without small-sample correction.
    """
    full = np.column_stack([np.ones(len(y)), x])
    keep = ~(np.isnan(full).any(axis=1) | np.isnan(y))
    full, y = full[keep], y[keep]
    n, k = full.shape
    if n <= k:
        nan = np.full(k, np.nan)
        return nan, nan, np.nan, np.nan
    inverse = np.linalg.pinv(full.T @ full)
    beta = inverse @ full.T @ y
    rest = y - full @ beta
    scores = full * rest[:, None]
    middle = scores.T @ scores
    for lag in range(1, max_lags + 1):
        cross = scores[lag:].T @ scores[:-lag]
        middle += (1 - lag / (max_lags + 1)) * (cross + cross.T)
    errors = np.sqrt(np.maximum(np.diag(inverse @ middle @ inverse), 0))
    total = ((y - y.mean()) ** 2).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        return beta, beta / errors, 1 - (rest @ rest) / total if total > 0 else np.nan, (rest @ rest) / (n - k)


#: Normal equations (of columns scaled to length one) worse than this go to ols_hac(), which has a pseudo-inverse.
WORST_CONDITION = 1e8


def rolling_ols_hac(x: np.ndarray, y: np.ndarray, lookback: int, max_lags: int = 5, missing_share: float = 0.10) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ols_hac over the lookback rows before each row; NaN for the first rows and where a column lacks more than missing_share of its window.

    All windows are fitted together: their normal equations are differences of running sums of products, their errors sums of
    lagged products of each row's influence on the coefficients. Windows with a missing value or with columns that nearly
    depend on each other are fitted one by one.
    """
    rows, k = len(y), x.shape[1] + 1
    beta, t = np.full((rows, k), np.nan), np.full((rows, k), np.nan)
    r2, var = np.full(rows, np.nan), np.full(rows, np.nan)
    lost = np.isnan(np.column_stack([x, y])).astype(int)
    sums = np.vstack([np.zeros((1, lost.shape[1]), int), lost.cumsum(axis=0)])
    ends = np.arange(lookback, rows)
    missing = sums[ends] - sums[ends - lookback]
    ends = ends[(missing.max(axis=1) <= missing_share * lookback)] if len(ends) else ends
    clean = (sums[ends] - sums[ends - lookback]).max(axis=1) == 0 if len(ends) else np.zeros(0, bool)
    together = ends[clean] if lookback > k else ends[:0]
    if len(together):
        full = np.nan_to_num(np.column_stack([np.ones(rows), x, y]))
        products = np.vstack([np.zeros((1, k + 1, k + 1)), np.cumsum(full[:, :, None] * full[:, None, :], axis=0)])
        moments = products[together] - products[together - lookback]
        scale = np.sqrt(np.maximum(np.einsum("tii->ti", moments)[:, :k], 1e-300))
        scaled = moments[:, :k, :k] / scale[:, :, None] / scale[:, None, :]
        roots = np.linalg.eigvalsh(scaled)
        good = roots[:, 0] * WORST_CONDITION > roots[:, -1]
        together, moments, scale, scaled = together[good], moments[good], scale[good], scaled[good]
    if len(together):
        inverse = np.linalg.inv(scaled) / scale[:, :, None] / scale[:, None, :]
        fit = np.einsum("tij,tj->ti", inverse, moments[:, :k, k])
        # a view: no window is copied until it is multiplied
        windows = np.lib.stride_tricks.sliding_window_view(full, lookback, axis=0)[together - lookback]
        rest = windows[:, k, :] - np.einsum("til,ti->tl", windows[:, :k, :], fit)
        pull = np.einsum("tij,tjl->til", inverse, windows[:, :k, :]) * rest[:, None, :]
        square = (pull * pull).sum(axis=2)
        for lag in range(1, max_lags + 1):
            square += 2 * (1 - lag / (max_lags + 1)) * (pull[:, :, lag:] * pull[:, :, :-lag]).sum(axis=2)
        left, target = (rest * rest).sum(axis=1), windows[:, k, :]
        total = ((target - target.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            beta[together], t[together] = fit, fit / np.sqrt(np.maximum(square, 0))
            r2[together] = np.where(total > 0, 1 - left / total, np.nan)
        var[together] = left / (lookback - k)
    for end in np.setdiff1d(ends, together):
        beta[end], t[end], r2[end], var[end] = ols_hac(x[end - lookback : end], y[end - lookback : end], max_lags)
    return beta, t, r2, var


def residuals(sigma_xx: np.ndarray, sigma_xy: np.ndarray, y: np.ndarray, x: np.ndarray, ridge: float = 1e-7) -> np.ndarray:
    """By row y less what x explains with the row's own covariances; NaN where these are missing."""
    out = np.full(len(y), np.nan)
    live = ~(np.isnan(sigma_xx).any(axis=(1, 2)) | np.isnan(sigma_xy).any(axis=1))
    if live.any():
        k = sigma_xx.shape[1]
        beta = np.linalg.solve(sigma_xx[live] + ridge * np.eye(k), sigma_xy[live][..., None])[..., 0]
        out[live] = y[live] - (beta * x[live]).sum(axis=1)
    return out
