"""The array kernels against loops that follow the definitions step by step."""

import numpy as np
import pytest

from panelforge.kernels import ewma, regression

RNG = np.random.default_rng(7)


def loop_ewma(rets, span, clip, demean):
    decay, rows, n = 1 - 2 / (1 + span), *rets.shape
    first = rets[: min(span, rows)]
    mean, vol = first.mean(0), first.std(0)
    cov = np.cov(first, rowvar=False).reshape(n, n) if n > 1 else np.array([[first.var()]])
    var, out = vol**2, np.full((rows, n, n), np.nan)
    for t in range(rows):
        r = rets[t].copy()
        if clip:
            for k in range(n):
                s = np.sqrt(var[k])
                if s > 1e-8:
                    if abs(r[k] / s) > 5:
                        r[k] = np.sign(r[k]) * 5 * s
                    var[k] = decay * var[k] + (1 - decay) * r[k] ** 2
                else:
                    r[k] = 0
        mean = (1 - decay) * r + decay * mean
        d = r - mean if demean else r
        for i in range(n):
            for j in range(n):
                cov[i, j] = (1 - decay) * d[i] * d[j] + decay * cov[i, j]
        if t >= len(first):
            out[t] = cov
    return out


def loop_clip(rets, decay, var, sigmas=5.0):
    out = []
    for r in rets:
        vol = np.sqrt(var)
        if vol > 1e-8:
            r = np.sign(r) * min(abs(r), sigmas * vol)
            var = decay * var + (1 - decay) * r**2
        else:
            r = 0.0
        out.append(r)
    return out, var


@pytest.mark.parametrize("decay", [0.0, 0.5, 0.97, 0.999])
@pytest.mark.parametrize("size", [1e-12, 1e-8, 1e-3, 10.0])
def test_clip_and_its_map(decay, size):
    rng = np.random.default_rng(int(decay * 1000))
    for kind in range(4):
        rets = (rng.standard_t(2, 150) * size).tolist()
        if kind == 1:
            rets[30:] = [0.0] * 120  # falls silent
        if kind == 2:
            rets = [0.0] * 150
        if kind == 3:
            rets[::7] = [1e6 * size] * len(rets[::7])
        whole = ewma.ClipMap(rets, decay)
        assert len(whole.lines) <= len(rets) + 1
        for var in (0.0, 1e-17, 1e-16, 2e-16, 1e-15, 1e-12, 1e-9, size**2, 1.0, 1e8):
            out, end = ewma.clip(rets, decay, var)
            want, last = loop_clip(rets, decay, var)
            assert np.allclose(out, want, rtol=1e-12, atol=0) and end == pytest.approx(last, rel=1e-12)
            assert whole(var) == pytest.approx(end, rel=1e-9)
            # two blocks put together are the whole
            assert ewma.ClipMap(rets[70:], decay)(ewma.ClipMap(rets[:70], decay)(var)) == pytest.approx(end, rel=1e-9)


def test_lower_envelope():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lines = [(float(a), float(b)) for a, b in zip(rng.integers(1, 9, 8), rng.integers(0, 9, 8), strict=True)]
        kept = ewma.lower(lines, 0.25)
        assert [x[0] for x in kept] == sorted({x[0] for x in kept}, reverse=True)
        for v in np.linspace(0.26, 12, 60):
            assert min(s * v + c for s, c in kept) == pytest.approx(min(s * v + c for s, c in lines))


def loop_ols(x, y, lags):
    keep = ~(np.isnan(x).any(1) | np.isnan(y))
    x, y = np.column_stack([np.ones(keep.sum()), x[keep]]), y[keep]
    n, k = x.shape
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    s = np.zeros((k, k))
    for a in range(n):
        for b in range(max(0, a - lags), min(n, a + lags + 1)):
            s += (1 - abs(a - b) / (lags + 1)) * e[a] * e[b] * np.outer(x[a], x[b])
    inv = np.linalg.inv(x.T @ x)
    return beta, beta / np.sqrt(np.diag(inv @ s @ inv)), 1 - e @ e / ((y - y.mean()) ** 2).sum(), e @ e / (n - k)


def test_ols_hac():
    x = RNG.normal(size=(120, 7))
    y = x @ RNG.normal(size=7) + RNG.normal(size=120)
    x[5, 2] = y[60] = np.nan
    for a, b in zip(regression.ols_hac(x, y), loop_ols(x, y, 5), strict=True):
        assert np.allclose(a, b, rtol=1e-9)
    constant = np.column_stack([x[:, 0], np.ones(120)])
    assert np.isfinite(regression.ols_hac(constant, y)[0]).all()
    assert np.isnan(regression.ols_hac(x[:5], y[:5])[0]).all()


def test_rolling_windows_end_before_their_date():
    x = RNG.normal(size=(200, 2))
    y = np.where(np.arange(200) >= 150, 3, 1) * x[:, 0]
    beta, _, _, _ = regression.rolling_ols_hac(x, y, 120)
    assert np.isnan(beta[:120]).all() and beta[150, 1] == pytest.approx(1) and beta[151, 1] != pytest.approx(1)
    x[0:12, 1] = np.nan
    assert np.isfinite(regression.rolling_ols_hac(x, y, 120)[0][120]).all()
    x[12, 1] = np.nan
    assert np.isnan(regression.rolling_ols_hac(x, y, 120)[0][120]).all() and np.isfinite(regression.rolling_ols_hac(x, y, 120)[0][121]).all()


@pytest.mark.parametrize("lost", [0, 4])
def test_windows_together_are_the_single_ones(lost):
    x = RNG.normal(0, 0.01, size=(300, 5))
    x[:, 4] = np.where(np.arange(300) < 150, x[:, 3], x[:, 4])  # two factors that are one for half the time
    y = x @ RNG.normal(size=5) + RNG.normal(0, 0.003, size=300)
    y[200:260] = 0.001  # and a target that stands still
    x[RNG.integers(0, 300, lost), 1] = np.nan
    found = regression.rolling_ols_hac(x, y, 40)
    for end in range(300):
        want = regression.ols_hac(x[end - 40 : end], y[end - 40 : end]) if end >= 40 else [np.nan] * 4
        for k, (a, b) in enumerate(zip(found, want, strict=True)):
            if 240 <= end <= 260 and k:
                continue  # nothing left to explain: errors are rounding
            assert np.allclose(a[end], b, rtol=1e-6, atol=1e-12, equal_nan=True), (end, k)
    assert np.isnan(regression.rolling_ols_hac(x[:30], y[:30], 40)[0]).all()


def test_residuals():
    x = RNG.normal(size=(500, 4))
    y = x @ np.array([2.0, 3.0, -1.0, 0.5])
    cov = np.cov(np.column_stack([x, y]), rowvar=False)
    xx, xy = np.repeat(cov[None, :4, :4], 500, 0), np.repeat(cov[None, :4, 4], 500, 0)
    xx[3] = np.nan
    out = regression.residuals(xx, xy, y, x)
    assert np.isnan(out[3]) and np.abs(np.delete(out, 3)).max() < 1e-5
