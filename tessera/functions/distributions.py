"""Probability distributions: densities as Column expressions, the others as vectorised functions.

Distribution functions come from the incomplete gamma and beta functions (series and continued fractions over whole
batches), quantiles from a bracketing search on the distribution function. Each distinct row of a batch is evaluated once.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import LIBRARY, d

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erf = np.vectorize(math.erf, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_normal_quantile = np.vectorize(NormalDist().inv_cdf, otypes=[float])


LARGE = 4000.0


def _gamma_p_large(a, x):
    """The incomplete gamma function for a large a, by the uniform asymptotic expansion with its first two terms."""
    mu = x / a - 1
    eta = np.sign(mu) * np.sqrt(2 * np.maximum(mu - np.log1p(mu), 0))
    near = np.abs(eta) < 1e-2
    safe, m = np.where(near, 1.0, eta), np.where(near, 1.0, mu)
    first = np.where(near, -1 / 3 + eta / 12 - 2 * eta**2 / 135 + eta**3 / 864, 1 / m - 1 / safe)
    second = np.where(near, -1 / 540 - eta / 288 + eta**2 / 378, 1 / safe**3 - 1 / m**3 - 1 / m**2 - 1 / (12 * m))
    rest = np.exp(-a * eta**2 / 2) / np.sqrt(2 * math.pi * a) * (first + second / a)
    return np.clip(0.5 * _erfc(-eta * np.sqrt(a / 2)) - rest, 0, 1)


def gamma_p(a, x):
    """Regularised lower incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    on = x > 0
    large = on & (a > LARGE)
    out[large] = _gamma_p_large(a[large], x[large])
    on &= ~large
    a, x = a[on], x[on]
    front = np.exp(a * np.log(x) - x - _lgamma(a)) if len(a) else a
    low = x < a + 1
    near, far = np.flatnonzero(low), np.flatnonzero(~low)
    value = np.empty(x.shape)
    u, v = a[near], x[near]
    term = 1 / np.where(u > 0, u, 1)
    series = term.copy()
    for n in range(1, 600):
        term = term * v / (u + n)
        series += term
        if not len(term) or np.max(np.abs(term)) < 1e-17:
            break
    value[near] = front[near] * series
    tiny = 1e-300
    u, v = a[far], x[far]
    b = v + 1 - u
    c, dd = np.full(v.shape, 1 / tiny), 1 / np.where(b == 0, tiny, b)
    h = dd.copy()
    for n in range(1, 600):
        an = -n * (n - u)
        b = b + 2
        dd = 1 / np.where(np.abs(an * dd + b) < tiny, tiny, an * dd + b)
        c = np.where(np.abs(b + an / c) < tiny, tiny, b + an / c)
        h = h * dd * c
        if not len(h) or np.nanmax(np.abs(dd * c - 1), initial=0) < 4e-16:  # a last place more or less is no progress
            break
    value[far] = 1 - front[far] * h
    out[on] = value
    return np.clip(out, 0, 1)


def beta_i(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) + _lgamma(p + q) - _lgamma(p) - _lgamma(q)) / p
    tiny = 1e-300
    c, dd = np.ones(y.shape), 1 - (p + q) * y / (p + 1)
    dd = 1 / np.where(np.abs(dd) < tiny, tiny, dd)
    h = dd.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            dd = 1 + num * dd
            dd = 1 / np.where(np.abs(dd) < tiny, tiny, dd)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * dd * c
        if not h.size or np.nanmax(np.abs(dd * c - 1), initial=0) < 1e-15:
            break
    value = np.where(y <= 0, 0.0, front * h)
    return np.clip(np.where(swap, 1 - value, value), 0, 1)


def once_each(f):
    """f of columns, evaluated once for each distinct row of them."""

    def run(*columns):
        columns = np.broadcast_arrays(*(np.asarray(c, float) for c in columns))
        vary = [c for c in columns if c.size and not (c == c.flat[0]).all()]
        if not columns[0].size or columns[0].ndim != 1:
            return f(*columns)
        if not vary:
            first, back = np.zeros(1, int), np.zeros(len(columns[0]), int)
        elif len(vary) == 1:
            _, first, back = np.unique(vary[0], return_index=True, return_inverse=True)
        else:
            _, first, back = np.unique(np.stack(vary, 1), axis=0, return_index=True, return_inverse=True)
        return np.asarray(f(*(c[first] for c in columns)))[np.ravel(back)]

    return run


def _grown(cdf, x, params, wrong, step):
    """Ends of brackets, moved on by `step` where they are wrong."""
    on = np.arange(len(x))
    for _ in range(1100):
        on = on[wrong(cdf(x[on], *(v[on] for v in params)), on)]
        if not len(on):
            break
        x[on] = step(x[on])
    return x


def quantile(cdf, p, low, high, whole=False, params=()):
    """The smallest x with cdf(x, *params) >= p; the upper end grows until it is enough. Whole numbers are bisected; others
    go by inverse quadratic interpolation, where it may be trusted, else by bisection (Chandrupatla), until the ends of
    the bracket are neighbours. Only rows that aren't done are evaluated.
    """
    p, *params = (np.array(v, float) for v in np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, float)) for v in (p, *params))))
    hi = _grown(cdf, np.full(p.shape, float(high)), params, lambda got, on: got < np.minimum(p[on], 1 - 1e-15), lambda x: x * 2 + 1)
    if low == -np.inf:
        lo = _grown(cdf, -np.maximum(np.abs(hi), 1), params, lambda got, on: got > p[on], lambda x: x * 2)
    else:
        lo = np.full(p.shape, float(low))
    on = np.arange(len(p))
    if whole:
        while len(on):
            mid = np.floor((lo[on] + hi[on]) / 2)
            enough = cdf(mid, *(v[on] for v in params)) >= p[on]
            hi[on], lo[on] = np.where(enough, mid, hi[on]), np.where(enough, lo[on], mid + 1)
            on = on[(lo[on] < hi[on]) & np.isfinite(hi[on])]
        return hi
    out, goal = hi.copy(), p
    x1, x2 = lo, hi
    f1, f2 = cdf(lo, *params) - p, np.maximum(cdf(hi, *params) - p, 0)
    x3, f3, t = x2, f2, np.full(p.shape, 0.5)
    for turn in range(1200):
        x = x1 + t * (x2 - x1)
        f = cdf(x, *params) - goal
        same = (f >= 0) == (f1 >= 0)
        x3, f3, x2, f2 = np.where(same, x1, x2), np.where(same, f1, f2), np.where(same, x2, x1), np.where(same, f2, f1)
        stuck, x1, f1 = (x == x1) | (x == x2) | (x == x3), x, f
        top = np.where(f1 >= 0, x1, x2)
        out[on] = top
        width = np.abs(x2 - x1)
        more = ~((width <= 4e-16 * np.abs(top)) | stuck & (width <= 1e-15 * np.abs(top)) | ~(width > 0))
        if not more.any():
            break
        on, goal, x1, x2, x3, f1, f2, f3, width, top, *params = (v[more] for v in (on, goal, x1, x2, x3, f1, f2, f3, width, top, *params))
        with np.errstate(all="ignore"):
            xi, phi = (x1 - x2) / (x3 - x2), (f1 - f2) / (f3 - f2)
            t = f1 / (f2 - f1) * f3 / (f2 - f3) + (x3 - x1) / (x2 - x1) * f1 / (f3 - f1) * f2 / (f3 - f2)
            trusted = (phi * phi < xi) & ((1 - phi) ** 2 < 1 - xi) & np.isfinite(t) & (turn < 60)
            least = np.minimum(2e-16 * np.abs(top) / width, 0.5)
        t = np.where(trusted, np.clip(t, least, 1 - least), 0.5)
    return out


def _normal(x, mu, s):
    return 0.5 * _erfc((mu - x) / (s * math.sqrt(2)))


def _t(x, n):
    tail = 0.5 * beta_i(n / 2, 0.5, n / (n + x * x))
    middle = 0.5 + 0.5 * np.sign(x) * beta_i(0.5, n / 2, x * x / (n + x * x))
    return np.where(x * x < n, middle, np.where(x > 0, 1 - tail, tail))


def _hyper(x, m, n, k):
    m, n, k, top = (np.asarray(v, float) for v in (m, n, k, np.floor(x)))
    ln = lambda a, b: _lgamma(a + 1) - _lgamma(b + 1) - _lgamma(a - b + 1)
    out = np.zeros(np.broadcast(top, m).shape)
    for j in range(int(np.max(np.minimum(m, k), initial=0)) + 1):
        ok = (j <= top) & (j <= m) & (k - j <= n) & (k - j >= 0)
        jj = np.where(ok, j, np.maximum(0, np.minimum(m, k)))
        safe = np.where(ok, jj, 0)
        rest = np.clip(k - safe, 0, n)
        out += np.where(ok, np.exp(ln(m, np.minimum(safe, m)) + ln(n, rest) - ln(m + n, np.minimum(k, m + n))), 0)
    return np.minimum(out, 1)


#: Distribution functions of x and the parameters, the support's lower end, whether values are whole numbers.
CDFS = {
    "gaussian": (_normal, -np.inf, False),
    "exponential": (lambda x, r: np.where(x > 0, -np.expm1(-r * np.maximum(x, 0)), 0), 0, False),
    "chi2": (lambda x, k: gamma_p(k / 2, x / 2), 0, False),
    "poisson": (lambda x, r: np.where(x < 0, 0, 1 - gamma_p(np.floor(np.maximum(x, 0)) + 1, r)), 0, True),
    "gamma": (lambda x, a, s: gamma_p(a, x / s), 0, False),
    "beta": (lambda x, a, b: beta_i(a, b, x), 0, False),
    "cauchy": (lambda x, m, s: 0.5 + np.arctan((x - m) / s) / math.pi, -np.inf, False),
    "f": (lambda x, a, b: np.where(x > 0, beta_i(a / 2, b / 2, a * np.maximum(x, 0) / (a * np.maximum(x, 0) + b)), 0), 0, False),
    "lognormal": (lambda x, m, s: np.where(x > 0, _normal(np.log(np.where(x > 0, x, 1)), m, s), 0), 0, False),
    "t": (_t, -np.inf, False),
    "binomial": (lambda x, n, p: np.where(x < 0, 0, np.where(np.floor(x) >= n, 1, beta_i(np.maximum(n - np.floor(x), 1e-9), np.maximum(np.floor(x), 0) + 1, 1 - p))), 0, True),
    "uniform": (lambda x, a, b: np.clip((x - a) / (b - a), 0, 1), -np.inf, False),
    "geometric": (lambda x, p: np.where(x < 0, 0, 1 - (1 - p) ** (np.floor(x) + 1)), 0, True),
    "hypergeometric": (_hyper, 0, True),
    "weibull": (lambda x, k, s: np.where(x > 0, -np.expm1(-((np.maximum(x, 0) / s) ** k)), 0), 0, False),
    "negativeBinomial": (lambda x, n, p: np.where(x < 0, 0, beta_i(n, np.floor(np.maximum(x, 0)) + 1, p)), 0, True),
}
#: Quantiles that have a closed form.
CLOSED = {
    "gaussian": lambda p, m, s: m + s * _normal_quantile(p),
    "lognormal": lambda p, m, s: np.exp(m + s * _normal_quantile(p)),
    "exponential": lambda p, r: -np.log1p(-p) / r,
    "cauchy": lambda p, m, s: m + s * np.tan(math.pi * (p - 0.5)),
    "weibull": lambda p, k, s: s * (-np.log1p(-p)) ** (1 / k),
}
_EDGES = {"gaussian": (-np.inf, np.inf), "cauchy": (-np.inf, np.inf), "t": (-np.inf, np.inf), "beta": (0.0, 1.0)}


def _cdf_udf(f):
    f = once_each(f)

    @F.pandas_udf(T.DoubleType())
    def one(x: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float), a.to_numpy(float)))

    @F.pandas_udf(T.DoubleType())
    def two(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float), a.to_numpy(float), b.to_numpy(float)))

    @F.pandas_udf(T.DoubleType())
    def three(x: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float), a.to_numpy(float), b.to_numpy(float), c.to_numpy(float)))

    return lambda x, *p: {1: one, 2: two, 3: three}[len(p)](d(x), *map(d, p))


def _quantile_of(name):
    cdf, low, whole = CDFS[name]

    def f(p, *params):
        edge_low, edge_high = _EDGES.get(name, (float(low), np.inf))
        if name == "uniform":
            return params[0] + np.clip(p, 0, 1) * (params[1] - params[0])
        if name == "binomial":
            edge_high = params[0]
        inner = np.clip(p, 1e-300, 1 - 1e-16)
        out = CLOSED[name](inner, *params) if name in CLOSED else quantile(once_each(cdf) if whole else cdf, inner, low, 1.0, whole, params)
        return np.where(np.isnan(p), np.nan, np.where(p <= 0, edge_low, np.where(p >= 1, edge_high, out)))

    return f


def _params(args):
    """A record of mean and variance may stand for the two parameters of a normal distribution."""
    return (args[0]["mean"], F.sqrt(args[0]["variance"])) if len(args) == 1 else args


def ln_choose(n, k):
    from .scalar import ln_gamma

    return ln_gamma(n + 1) - ln_gamma(k + 1) - ln_gamma(n - k + 1)


def _density(name):
    from .scalar import ln_gamma

    ln, exp, half = F.ln, F.exp, 0.5
    pos = lambda x, v: F.when(x > 0, v).otherwise(F.lit(0.0))
    count = lambda x, v: F.when(x >= 0, v).otherwise(F.lit(0.0))
    return {
        "exponential": lambda x, r: F.when(x >= 0, r * exp(-r * x)).otherwise(F.lit(0.0)),
        "chi2": lambda x, k: pos(x, exp((k / 2 - 1) * ln(x) - x / 2 - k / 2 * math.log(2) - ln_gamma(k / 2))),
        "poisson": lambda x, r: count(x, exp(x * ln(r) - r - ln_gamma(x + 1))),
        "gamma": lambda x, a, s: pos(x, exp((a - 1) * ln(x) - x / s - a * ln(s) - ln_gamma(a))),
        "beta": lambda x, a, b: F.when((x > 0) & (x < 1), exp((a - 1) * ln(x) + (b - 1) * ln(1 - x) + ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b))).otherwise(F.lit(0.0)),
        "cauchy": lambda x, m, s: 1 / (math.pi * s * (1 + F.pow((x - m) / s, F.lit(2)))),
        "f": lambda x, a, b: pos(x, exp(a / 2 * ln(a) + b / 2 * ln(b) + (a / 2 - 1) * ln(x) - (a + b) / 2 * ln(b + a * x) + ln_gamma((a + b) / 2) - ln_gamma(a / 2) - ln_gamma(b / 2))),
        "lognormal": lambda x, m, s: pos(x, exp(-half * F.pow((ln(x) - m) / s, F.lit(2))) / (x * s * math.sqrt(2 * math.pi))),
        "t": lambda x, n: exp(ln_gamma((n + 1) / 2) - ln_gamma(n / 2) - half * ln(n * math.pi) - (n + 1) / 2 * F.log1p(x * x / n)),
        "binomial": lambda x, n, p: F.when((x >= 0) & (x <= n), exp(ln_choose(n, x) + x * ln(p) + (n - x) * F.log1p(-p))).otherwise(F.lit(0.0)),
        "uniform": lambda x, a, b: F.when((x >= a) & (x <= b), 1 / (b - a)).otherwise(F.lit(0.0)),
        "geometric": lambda x, p: count(x, p * F.pow(1 - p, x)),
        "hypergeometric": lambda x, m, n, k: F.when((x >= 0) & (x <= m) & (x <= k) & (k - x <= n), exp(ln_choose(m, x) + ln_choose(n, k - x) - ln_choose(m + n, k))).otherwise(F.lit(0.0)),
        "weibull": lambda x, k, s: pos(x, k / s * F.pow(x / s, k - 1) * exp(-F.pow(x / s, k))),
        "negativeBinomial": lambda x, n, p: count(x, exp(ln_choose(x + n - 1, x) + n * ln(p) + x * F.log1p(-p))),
    }[name]


def _with_doubles(f):
    return lambda *args: f(*map(d, args))


for _name, (_f, _, _) in CDFS.items():
    if _name != "gaussian":
        LIBRARY[f"prob.dist.{_name}PDF"] = _with_doubles(_density(_name))
        LIBRARY[f"prob.dist.{_name}CDF"] = _cdf_udf(_f)
        LIBRARY[f"prob.dist.{_name}QF"] = _cdf_udf(_quantile_of(_name))


def gaussian_ll(x, *args):
    mu, s = _params(args)
    return -F.pow((d(x) - mu) / s, F.lit(2)) / 2 - F.ln(s * math.sqrt(2 * math.pi))


def gaussian_cdf(x, *args):
    from .numeric import normal_cdf

    mu, s = _params(args)
    return normal_cdf((d(x) - mu) / s)


LIBRARY["prob.dist.gaussianLL"] = gaussian_ll
LIBRARY["prob.dist.gaussianCDF"] = gaussian_cdf
LIBRARY["prob.dist.gaussianQF"] = lambda p, *args: _cdf_udf(_quantile_of("gaussian"))(p, *_params(args))
