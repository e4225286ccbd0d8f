"""Distribution tails and quantiles that Spark lacks, in NumPy.

Everything is vectorised; ``*_col`` wrappers evaluate over Arrow batches.
Tails are computed directly, not as one minus a distribution function, so
small p-values keep their digits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def lgamma(x: np.ndarray | float) -> np.ndarray:
    """log Gamma for positive x: recurrence up to 10, then Stirling's series."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    while True:
        low = y < 10
        if not low.any():
            break
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    series = sum(c / y ** (2 * k + 1) for k, c in enumerate(_STIRLING))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    keep = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1 / keep(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / keep(1 + step * d)
            c = keep(1 + step / c)
            delta = c * d
            h = h * delta
        if np.all(np.abs(delta - 1) < 1e-15):
            break
    return h


def betainc(a: np.ndarray | float, b: np.ndarray | float, x: np.ndarray | float) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b); NaN where an argument is."""
    a, b, x = np.broadcast_arrays(np.asarray(a, np.float64), np.asarray(b, np.float64), np.asarray(x, np.float64))
    good = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    aa, bb, xx = np.where(good, a, 1.0), np.where(good, b, 1.0), np.where(good, x, 0.5)
    inner = np.clip(xx, 1e-320, 1 - 1e-16)
    front = np.exp(lgamma(aa + bb) - lgamma(aa) - lgamma(bb) + aa * np.log(inner) + bb * np.log1p(-inner))
    swap = inner >= (aa + 1) / (aa + bb + 2)
    p, q, z = np.where(swap, bb, aa), np.where(swap, aa, bb), np.where(swap, 1 - inner, inner)
    part = front * _beta_fraction(p, q, z) / p
    out = np.where(swap, 1 - part, part)
    out = np.where(xx <= 0, 0.0, np.where(xx >= 1, 1.0, out))
    return np.where(good, out, np.nan)


def t_two_sided(t: np.ndarray | float, dof: np.ndarray | float) -> np.ndarray:
    """P(|T| >= |t|) of Student's t."""
    t, dof = np.asarray(t, np.float64), np.asarray(dof, np.float64)
    return np.where(np.isinf(t), 0.0, betainc(dof / 2, 0.5, dof / (dof + np.where(np.isinf(t), 0.0, t) ** 2)))


def t_sf(t: np.ndarray | float, dof: np.ndarray | float) -> np.ndarray:
    half = t_two_sided(t, dof) / 2
    return np.where(np.asarray(t) >= 0, half, 1 - half)


def f_sf(f: np.ndarray | float, d1: np.ndarray | float, d2: np.ndarray | float) -> np.ndarray:
    """P(F >= f) of the F distribution."""
    f, d1, d2 = (np.asarray(v, np.float64) for v in (f, d1, d2))
    return np.where(np.isinf(f), 0.0, betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.where(np.isinf(f), 0.0, f))))


def erf(x: np.ndarray | float) -> np.ndarray:
    """Error function by the incomplete-gamma series and continued fraction."""
    x = np.asarray(x, np.float64)
    a = np.abs(x)
    s = np.minimum(a, 3.0)
    term, total = s.copy(), s.copy()
    for k in range(1, 80):
        term = term * (-s * s) / k
        total = total + term / (2 * k + 1)
    near = 2 / np.sqrt(np.pi) * total
    z = np.maximum(a, 3.0)
    frac = np.zeros_like(z)
    for k in range(60, 0, -1):
        frac = (k / 2) / (z + frac)
    far = 1 - np.exp(-z * z) / np.sqrt(np.pi) / (z + frac)
    return np.sign(x) * np.where(a < 3, near, far)


def norm_cdf(x: np.ndarray | float) -> np.ndarray:
    return 0.5 * (1 + erf(np.asarray(x, np.float64) / np.sqrt(2)))


def _bisect(cdf, p: np.ndarray, lo: float, hi: float, steps: int = 200) -> np.ndarray:  # noqa: ANN001
    a, b = np.full_like(p, lo), np.full_like(p, hi)
    for _ in range(steps):
        mid = (a + b) / 2
        low = cdf(mid) < p
        a, b = np.where(low, mid, a), np.where(low, b, mid)
    return (a + b) / 2


# Wichura's AS 241, numerators and denominators for the middle, the tails and the far tails.
_AS241 = (
    ((2509.0809287301227, 33430.57558358813, 67265.7709270087, 45921.95393154987, 13731.69376550946, 1971.5909503065513, 133.14166789178438, 3.3871328727963665),
     (5226.495278852854, 28729.085735721943, 39307.89580009271, 21213.794301586597, 5394.196021424751, 687.1870074920579, 42.31333070160091, 1.0)),
    ((0.0007745450142783414, 0.022723844989269184, 0.2417807251774506, 1.2704582524523684, 3.6478483247632045, 5.769497221460691, 4.630337846156546, 1.4234371107496835),
     (1.0507500716444169e-09, 0.0005475938084995345, 0.015198666563616457, 0.14810397642748008, 0.6897673349851, 1.6763848301838038, 2.053191626637759, 1.0)),
    ((2.0103343992922881e-07, 2.7115555687434876e-05, 0.0012426609473880784, 0.026532189526576124, 0.29656057182850487, 1.7848265399172913, 5.463784911164114, 6.657904643501103),
     (2.0442631033899397e-15, 1.421511758316446e-07, 1.8463183175100548e-05, 0.0007868691311456133, 0.014875361290850615, 0.1369298809227358, 0.599832206555888, 1.0)),
)


def norm_ppf(p: np.ndarray | float) -> np.ndarray:
    """Quantiles of the normal distribution, to about 16 digits; what is not between 0 and 1 is bisected."""
    p = np.asarray(p, np.float64)
    flat = np.atleast_1d(p).ravel()
    q = flat - 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = np.sqrt(-np.log(np.where(q <= 0, flat, 1 - flat)))
        middle = np.abs(q) <= 0.425
        out = np.empty_like(flat)
        for held, r, (above, below) in zip((middle, ~middle & (tail <= 5), ~middle & (tail > 5)), (0.180625 - q * q, tail - 1.6, tail - 5), _AS241, strict=True):
            out[held] = np.polyval(above, r[held]) / np.polyval(below, r[held])
    out = np.where(middle, out * q, np.where(q < 0, -out, out))
    odd = ~((flat > 0) & (flat < 1))
    out[odd] = _bisect(norm_cdf, flat[odd], -40, 40)
    return out.reshape(p.shape)


def t_ppf(p: np.ndarray | float, dof: np.ndarray | float) -> np.ndarray:
    p, dof = np.broadcast_arrays(np.asarray(p, np.float64), np.asarray(dof, np.float64))
    # on the arctangent scale the support is bounded
    u = _bisect(lambda v: 1 - t_sf(np.tan(v), dof), np.atleast_1d(p).astype(float), -np.pi / 2 + 1e-12, np.pi / 2 - 1e-12)
    return np.tan(u).reshape(p.shape)


def beta_ppf(p: np.ndarray | float, a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray:
    p, a, b = np.broadcast_arrays(np.asarray(p, np.float64), np.asarray(a, np.float64), np.asarray(b, np.float64))
    return _bisect(lambda v: betainc(a, b, v), np.atleast_1d(p).astype(float), 0.0, 1.0, 80).reshape(p.shape)


def studentized_range_sf(q: np.ndarray | float, k: int, dof: np.ndarray | float, points: int = 96) -> np.ndarray:
    """P(Q >= q) of the studentised range of k means, by Gauss-Legendre quadrature.

    The inner integral is the range's distribution for known variance, the
    outer one averages it over the chi distribution of the scale.
    """
    q, dof = np.broadcast_arrays(np.atleast_1d(np.asarray(q, np.float64)), np.atleast_1d(np.asarray(dof, np.float64)))
    node, weight = np.polynomial.legendre.leggauss(points)
    z, wz = node * 8, weight * 8
    phi, cap = np.exp(-z * z / 2) / np.sqrt(2 * np.pi), norm_cdf(z)
    s, ws = (node + 1) * 1.5 + 1e-9, weight * 1.5  # scale from 0 to 3
    out = np.empty(q.shape)
    for i, (qi, v) in enumerate(zip(q.ravel(), dof.ravel(), strict=True)):
        logf = np.log(2) + v / 2 * np.log(v / 2) - lgamma(v / 2) + (v - 1) * np.log(s) - v * s * s / 2
        spread = cap[None, :] - norm_cdf(z[None, :] - (qi * s)[:, None])
        inner = k * (phi[None, :] * np.clip(spread, 0, 1) ** (k - 1)) @ wz
        out.ravel()[i] = 1 - float((np.exp(logf) * ws) @ inner)
    return np.clip(out, 0, 1)


def _column(f, *args: Column) -> Column:  # noqa: ANN001
    """A vectorised function over Arrow batches; nulls come in as NaN, NaN goes out as null."""

    def batch(*series: pd.Series) -> pd.Series:
        return pd.Series(f(*(s.to_numpy(float) for s in series)))

    spread = [
        lambda a: batch(a),
        lambda a, b: batch(a, b),
        lambda a, b, c: batch(a, b, c),
    ][len(args) - 1]
    spread.__annotations__ = dict.fromkeys(["a", "b", "c"][: len(args)], pd.Series) | {"return": pd.Series}
    return F.nanvl(F.pandas_udf(spread, "double")(*args), F.lit(None).cast("double"))


def t_p_col(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t; null where an argument is null or NaN."""
    return _column(t_two_sided, t, dof)


def f_p_col(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_sf, f, d1, d2)


def betainc_col(a: Column, b: Column, x: Column) -> Column:
    return _column(betainc, a, b, x)


def beta_ppf_col(p: Column, a: Column, b: Column) -> Column:
    return _column(beta_ppf, p, a, b)


def t_ppf_col(p: Column, dof: Column) -> Column:
    return _column(t_ppf, p, dof)


def norm_ppf_col(p: Column) -> Column:
    return _column(norm_ppf, p)


def studentized_range_col(q: Column, k: int, dof: Column) -> Column:
    return _column(lambda a, b: studentized_range_sf(a, k, b), q, dof)
