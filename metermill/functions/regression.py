"""One short series at a time: regression with ARMA errors by two least-squares
steps (Hannan and Rissanen, 1982).  Called inside grouped tasks."""

from __future__ import annotations

import math

import numpy as np

SEASON = 12
START = 13  # months lost to the longest lag
MIN_MONTHS = 36  # the shortest history that gets a model


def difference(x: np.ndarray, d: int, sd: int) -> np.ndarray:
    for _ in range(sd):
        x = x[SEASON:] - x[:-SEASON]
    for _ in range(d):
        x = x[1:] - x[:-1]
    return x


def _polynomial(d: int, sd: int) -> np.ndarray:
    p = np.array([1.0])
    for _ in range(d):
        p = np.convolve(p, [1.0, -1.0])
    for _ in range(sd):
        p = np.convolve(p, np.r_[1.0, np.zeros(SEASON - 1), -1.0])
    return p


def seasonal_difference(y: np.ndarray, months: np.ndarray) -> int:
    """1 if the season explains most of the detrended variance."""
    kernel = np.r_[0.5, np.ones(SEASON - 1), 0.5] / SEASON
    if len(y) < 3 * SEASON:
        return 0
    h = SEASON // 2
    dev = y[h:-h] - np.convolve(y, kernel, mode="valid")
    m = months[h:-h]
    season = np.array([dev[m == k].mean() if (m == k).any() else 0.0 for k in range(1, 13)])
    rest = dev - season[m - 1]
    total = dev.var()
    return int(total > 0 and 1 - rest.var() / total > 0.64)


def plain_difference(y: np.ndarray) -> int:
    """1 if the KPSS level test rejects stationarity at 5 %."""
    n = len(y)
    e = y - y.mean()
    lags = int(4 * (n / 100) ** 0.25)
    v = e @ e / n + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    return int(v > 0 and (np.cumsum(e) ** 2).sum() / (n * n * v) > 0.463)


def _ols(z: np.ndarray, a: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, z, rcond=None)[0] if a.shape[1] else np.zeros(0)


def _lagged(x: np.ndarray, lags: list[int]) -> np.ndarray:
    cols = [np.r_[np.zeros(k), x[:-k]] for k in lags]
    return np.column_stack(cols) if cols else np.zeros((len(x), 0))


def _stable(lags: list[int], coefs: np.ndarray, sign: float) -> bool:
    if not lags:
        return True
    p = np.zeros(max(lags) + 1)
    p[0] = 1.0
    for k, c in zip(lags, coefs):
        p[k] += sign * c
    return bool(np.all(np.abs(np.roots(p)) < 0.995))


def fit(y: np.ndarray, x: np.ndarray, months: np.ndarray, d_opts, sd_opts, constant: bool) -> dict | None:
    """Best specification by AICc, or None if nothing can be fitted."""
    if not (np.isfinite(y).all() and np.isfinite(x).all()):
        return None
    sd = sd_opts[0] if len(sd_opts) == 1 else seasonal_difference(y, months)
    base = difference(y, 0, sd)
    d = d_opts[0] if len(d_opts) == 1 else plain_difference(base)
    z, zx = difference(y, d, sd), difference(x, d, sd)
    n = len(z)
    if len(y) < MIN_MONTHS or z.std() == 0:  # the trials below skip what the months left cannot support
        return None
    has_const = constant and d + sd <= 1
    fixed = np.column_stack([np.ones(n), zx]) if has_const else zx
    u = z - fixed @ _ols(z, fixed)
    m = min(START, n // 5)
    far = _lagged(u, list(range(1, m + 1)))
    e = np.r_[np.zeros(m), (u - far @ _ols(u[m:], far[m:]))[m:]]
    trials = []
    for p in range(3):
        for q in range(3):
            for sp in range(2):
                for sq in range(2):
                    ar = [*range(1, p + 1), *([SEASON] if sp else [])]
                    ma = [*range(1, q + 1), *([SEASON] if sq else [])]
                    a = np.column_stack([fixed, _lagged(u, ar), _lagged(e, ma)])[START:]
                    b = _ols(z[START:], a)
                    r = z[START:] - a @ b
                    t, k = len(r), len(b) + 1
                    s = max(float(r @ r), 1e-12)
                    if t - k - 1 <= 0:
                        continue
                    aicc = t * math.log(s / t) + 2 * k + 2 * k * (k + 1) / (t - k - 1)
                    trials.append((aicc, p, q, sp, sq, ar, ma, b, r, a))
    for aicc, p, q, sp, sq, ar, ma, b, r, a in sorted(trials, key=lambda v: v[:5]):
        f = fixed.shape[1]
        ba, bm = b[f : f + len(ar)], b[f + len(ar) :]
        if not (_stable(ar, ba, -1.0) and _stable(ma, bm, 1.0)):
            continue
        dof = max(len(r) - len(b), 1)
        sigma2 = float(r @ r) / dof
        cov = np.linalg.pinv(a.T @ a) * sigma2
        se = np.sqrt(np.clip(np.diag(cov), 0, None))
        c0 = 1 if has_const else 0
        beta = b[c0:f]
        with np.errstate(divide="ignore", invalid="ignore"):
            tval = beta / se[c0:f]
        pval = [math.erfc(abs(v) / math.sqrt(2)) if np.isfinite(v) else float("nan") for v in tval]
        return {
            "order": (p, d, q, sp, sd, sq), "const": float(b[0]) if has_const else 0.0, "has_const": has_const,
            "beta": beta, "p_value": pval, "ar": (ar, ba), "ma": (ma, bm), "aicc": float(aicc), "sigma2": sigma2,
            "u": z - fixed @ b[:f], "e": np.r_[np.zeros(START), r],
        }
    return None


def spec_text(m: dict, n_reg: int) -> str:
    p, d, q, sp, sd, sq = m["order"]
    text = f"ARIMA({p},{d},{q})"
    if sp or sd or sq:
        text += f"({sp},{sd},{sq})[{SEASON}]"
    if m["has_const"]:
        text += " w/ drift" if d + sd else " w/ mean"
    return ("LM w/ " + text + " errors") if n_reg else text


def predict(state: dict, x_future: np.ndarray) -> np.ndarray:
    """Mean forecasts on the original scale (log-normal second-order term)."""
    d, sd = state["d"], state["sd"]
    poly = _polynomial(d, sd)
    y, u, e = list(state["y_tail"]), list(state["u_tail"]), list(state["e_tail"])
    xs = np.vstack([state["x_tail"], x_future]) if x_future.shape[1] else np.zeros((len(y) + len(x_future), 0))
    ar, ma = state["ar"], state["ma"]
    t0, h = len(y), len(x_future)
    out = []
    for k in range(h):
        mu = sum(c * u[-lag] for lag, c in ar) + sum(c * e[-lag] for lag, c in ma if lag <= len(e))
        u.append(mu)
        e.append(0.0)
        w = state["const"] + mu
        if xs.shape[1]:
            dx = sum(c * xs[t0 + k - i] for i, c in enumerate(poly) if c)
            w += float(dx @ state["beta"])
        val = w - sum(c * y[-i] for i, c in enumerate(poly) if i and c)
        y.append(val)
        out.append(val)
    phi = np.zeros(SEASON + 1)
    phi[0] = 1.0
    for lag, c in ar:
        phi[lag] -= c
    full = np.convolve(phi, poly)
    theta = dict(ma)
    psi = np.zeros(h)
    for k in range(h):
        v = 1.0 if k == 0 else theta.get(k, 0.0)
        psi[k] = v - sum(full[i] * psi[k - i] for i in range(1, min(k, len(full) - 1) + 1))
    var = state["sigma2"] * np.cumsum(psi**2)
    with np.errstate(over="ignore"):
        return np.exp(np.array(out)) * (1 + var / 2)


def chi2_upper(x: float, k: float) -> float:
    """P(X > x) for a chi-square with k degrees of freedom."""
    a, x = k / 2.0, x / 2.0
    if x <= 0 or a <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * scale
    b = x + 1 - a
    c, dd = 1e300, 1.0 / b
    f = dd
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        dd = 1.0 / (an * dd + b or 1e-300)
        c = b + an / c or 1e-300
        step = dd * c
        f *= step
        if abs(step - 1) < 1e-15:
            break
    return f * scale
