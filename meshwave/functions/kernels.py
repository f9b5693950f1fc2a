"""Stationary covariance kernels written once for Spark columns and NumPy arrays, with analytic gradients and parameter algebra.

A kernel takes lags (one entry for each axis) and a mapping of parameter values; entries may be columns, arrays or numbers, so a table
of parameter rows is a vectorised model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = math.inf
EPS = 1e-6


class ColumnMath:
    exp, sqrt, cos, sin, log, abs = staticmethod(F.exp), staticmethod(F.sqrt), staticmethod(F.cos), staticmethod(F.sin), staticmethod(F.log), staticmethod(F.abs)

    @staticmethod
    def where(cond, a, b):
        as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
        return F.when(cond, as_col(a)).otherwise(as_col(b))


class ArrayMath:
    exp, sqrt, cos, sin, log, abs, where = staticmethod(np.exp), staticmethod(np.sqrt), staticmethod(np.cos), staticmethod(np.sin), staticmethod(np.log), staticmethod(np.abs), staticmethod(np.where)


def math_of(*values):
    return ColumnMath if any(isinstance(v, Column) for v in values) else ArrayMath


@dataclass(frozen=True)
class Param:
    """A parameter: default, bounds, and whether it is fixed at a value or tied to another one."""

    name: str
    default: float
    low: float
    high: float
    fixed: float | None = None
    link: str | None = None

    @property
    def free(self) -> bool:
        return self.fixed is None and self.link is None


@dataclass(frozen=True)
class Kernel:
    """Base: subclasses give `own` parameters, _cov and _grad; children's parameters follow their parent's, depth first."""

    changes: tuple[Param, ...] = field(default=(), kw_only=True)

    @property
    def vectorised(self) -> bool:
        """Whether parameters may be arrays, one value a field."""
        parts = [*getattr(self, "parts", ()), *([self.base] if isinstance(getattr(self, "base", None), Kernel) else [])]
        return all(k.vectorised for k in parts)

    def declared(self) -> list[Param]:
        raise NotImplementedError

    @property
    def params(self) -> list[Param]:
        changed = {p.name: p for p in self.changes}
        return [changed.get(p.name, p) for p in self.declared()]

    @property
    def free(self) -> list[Param]:
        return [p for p in self.params if p.free]

    def bounds(self) -> list[tuple[float, float]]:
        return [(p.low, p.high) for p in self.free]

    def defaults(self) -> dict[str, float]:
        return {p.name: p.default for p in self.params}

    def vector(self, theta: dict) -> list[float]:
        return [theta[p.name] for p in self.free]

    def theta(self, values=(), **given) -> dict:
        """Full parameter mapping from a vector of the free ones, or by name; fixed and linked ones are filled in."""
        out = self.defaults() | dict(zip((p.name for p in self.free), values, strict=False)) | given
        for p in self.params:
            if p.fixed is not None:
                out[p.name] = p.fixed
        for p in self.params:
            if p.link is not None:
                out[p.name] = out[p.link]
        return out

    def _changed(self, name: str, **what) -> Kernel:
        old = {p.name: p for p in self.params}[name]
        return replace(self, changes=tuple(p for p in self.changes if p.name != name) + (replace(old, **what),))

    def fix(self, name: str, value: float) -> Kernel:
        return self._changed(name, fixed=value)

    def tie(self, name: str, to: str) -> Kernel:
        """Let one parameter follow another, which must be there and not follow this one."""
        if to not in self.defaults() or to == name:
            raise ValueError(f"no parameter {to} to follow")
        return self._changed(name, link=to)

    def bound(self, name: str, low: float, high: float) -> Kernel:
        """Tighten the bounds; wider ones are refused."""
        old = {p.name: p for p in self.params}[name]
        if low < old.low or high > old.high or low > high:
            raise ValueError(f"bounds of {name} can only be tightened: {old.low}, {old.high}")
        return self._changed(name, low=low, high=high)

    def cov(self, lags: list, theta: dict):
        return self._cov(lags, theta, math_of(*lags, *theta.values()))

    def grad(self, lags: list, theta: dict, name: str):
        """Derivative by a parameter; linked parameters add theirs to the one they follow."""
        xp = math_of(*lags, *theta.values())
        out = self._grad(lags, theta, name, xp)
        for p in self.params:
            if p.link == name:
                out = out + self._grad(lags, theta, p.name, xp)
        return out

    def _pull(self, lags: list, t: dict, xp):
        """Radius times the slope by the radius; kernels of the radius over rho have it from their slope by rho."""
        return self._grad(lags, t, "rho", xp) * (-t["rho"])

    def __add__(self, other: Kernel) -> Kernel:
        return Sum((self, other))


def _square(lags):
    total = lags[0] * lags[0]
    for x in lags[1:]:
        total = total + x * x
    return total


def _scale(name: str, default: float = 1.0) -> Param:
    return Param(name, default, 0.0, INF)


class _Radial(Kernel):
    def declared(self):
        return [_scale("rho"), _scale("sigma")]

    def _cov(self, lags, t, xp):
        return t["sigma"] * t["sigma"] * self._shape(xp.sqrt(_square(lags)), t, xp)

    def _grad(self, lags, t, name, xp):
        r = xp.sqrt(_square(lags))
        if name == "sigma":
            return 2.0 * t["sigma"] * self._shape(r, t, xp)
        return t["sigma"] * t["sigma"] * self._slope(r, t, name, xp)


@dataclass(frozen=True)
class Exponential(_Radial):
    def _shape(self, r, t, xp):
        return xp.exp(-r / t["rho"])

    def _slope(self, r, t, name, xp):
        return r / (t["rho"] * t["rho"]) * xp.exp(-r / t["rho"])


@dataclass(frozen=True)
class SquaredExponential(_Radial):
    def _shape(self, r, t, xp):
        return xp.exp(-(r * r) / (2.0 * t["rho"] * t["rho"]))

    def _slope(self, r, t, name, xp):
        return r * r / (t["rho"] * t["rho"] * t["rho"]) * self._shape(r, t, xp)


@dataclass(frozen=True)
class Matern32(_Radial):
    def _shape(self, r, t, xp):
        u = math.sqrt(3.0) * r / t["rho"]
        return (1.0 + u) * xp.exp(-u)

    def _slope(self, r, t, name, xp):
        return 3.0 * r * r / (t["rho"] * t["rho"] * t["rho"]) * xp.exp(-math.sqrt(3.0) * r / t["rho"])


@dataclass(frozen=True)
class Matern52(_Radial):
    def _shape(self, r, t, xp):
        u = math.sqrt(5.0) * r / t["rho"]
        return (1.0 + u + u * u / 3.0) * xp.exp(-u)

    def _slope(self, r, t, name, xp):
        u = math.sqrt(5.0) * r / t["rho"]
        return u * u * (1.0 + u) * xp.exp(-u) / (3.0 * t["rho"])


@dataclass(frozen=True)
class RationalQuadratic(_Radial):
    def declared(self):
        return [_scale("rho"), _scale("alpha"), _scale("sigma")]

    def _base(self, r, t):
        return 1.0 + r * r / (2.0 * t["rho"] * t["rho"] * t["alpha"])

    def _shape(self, r, t, xp):
        return xp.exp(-t["alpha"] * xp.log(self._base(r, t)))

    def _slope(self, r, t, name, xp):
        a = self._base(r, t)
        if name == "rho":
            return r * r / (t["rho"] * t["rho"] * t["rho"]) * xp.exp(-(t["alpha"] + 1.0) * xp.log(a))
        return self._shape(r, t, xp) * (r * r / (2.0 * t["rho"] * t["rho"] * t["alpha"] * a) - xp.log(a))


@dataclass(frozen=True)
class Nugget(Kernel):
    """A share of the variance moves to lag 0."""

    base: Kernel = field(default_factory=Exponential)

    def declared(self):
        return [Param("nugget", 0.0, 0.0, 1.0), *self.base.params]

    def _parts(self, lags, xp, at):
        zero = _square(lags) == 0
        return zero, at([x * 0.0 for x in lags]), at(lags)

    def _cov(self, lags, t, xp):
        zero, c0, c = self._parts(lags, xp, lambda x: self.base._cov(x, t, xp))
        return xp.where(zero, t["nugget"] * c0, 0.0) + (1.0 - t["nugget"]) * c

    def _grad(self, lags, t, name, xp):
        if name == "nugget":
            zero, c0, c = self._parts(lags, xp, lambda x: self.base._cov(x, t, xp))
            return xp.where(zero, c0, 0.0) - c
        zero, g0, g = self._parts(lags, xp, lambda x: self.base._grad(x, t, name, xp))
        return xp.where(zero, t["nugget"] * g0, 0.0) + (1.0 - t["nugget"]) * g

    def _pull(self, lags, t, xp):
        return (1.0 - t["nugget"]) * self.base._pull(lags, t, xp)


@dataclass(frozen=True)
class Anisotropic(Kernel):
    """Two axes, turned by phi and stretched by eta and 1 / eta."""

    base: Kernel = field(default_factory=Exponential)

    def declared(self):
        return [Param("eta", 1.0, 0.0, INF), Param("phi", 0.0, -math.pi / 2, math.pi / 2), *self.base.params]

    def _turn(self, lags, t, xp):
        c, s = xp.cos(t["phi"]), xp.sin(t["phi"])
        return t["eta"] * (c * lags[0] - s * lags[1]), (s * lags[0] + c * lags[1]) / t["eta"]

    def _cov(self, lags, t, xp):
        return self.base._cov(list(self._turn(lags, t, xp)), t, xp)

    def _grad(self, lags, t, name, xp):
        u, v = self._turn(lags, t, xp)
        if name not in ("eta", "phi"):
            return self.base._grad([u, v], t, name, xp)
        # chain rule through the radius; bases here depend on lags by it alone
        du, dv = (u / t["eta"], -v / t["eta"]) if name == "eta" else (-t["eta"] * t["eta"] * v, u / (t["eta"] * t["eta"]))
        r2 = u * u + v * v
        slope = self.base._pull([u, v], t, xp)
        return xp.where(r2 > 0, slope * (u * du + v * dv) / xp.where(r2 > 0, r2, 1.0), 0.0)


@dataclass(frozen=True)
class Sum(Kernel):
    """A sum of kernels; parameters of the i-th are named m<i>_<name>. Sums of sums are flattened."""

    parts: tuple[Kernel, ...] = ()

    def __post_init__(self):
        flat = tuple(q for p in self.parts for q in (p.parts if isinstance(p, Sum) and not p.changes else (p,)))
        object.__setattr__(self, "parts", flat)

    def declared(self):
        return [replace(p, name=f"m{i}_{p.name}", link=f"m{i}_{p.link}" if p.link else None) for i, k in enumerate(self.parts) for p in k.params]

    def _of(self, t, i):
        return {k[len(f"m{i}_") :]: v for k, v in t.items() if k.startswith(f"m{i}_")}

    def _cov(self, lags, t, xp):
        total = None
        for i, k in enumerate(self.parts):
            c = k._cov(lags, self._of(t, i), xp)
            total = c if total is None else total + c
        return total

    def _grad(self, lags, t, name, xp):
        head, _, inner = name.partition("_")
        i = int(head[1:])
        return self.parts[i]._grad(lags, self._of(t, i), inner, xp)

    def _pull(self, lags, t, xp):
        total = None
        for i, k in enumerate(self.parts):
            c = k._pull(lags, self._of(t, i), xp)
            total = c if total is None else total + c
        return total


@dataclass(frozen=True)
class Separable(Kernel):
    """A product of one-axis kernels, parameters named m<i>_<name>."""

    parts: tuple[Kernel, ...] = ()
    declared = Sum.declared
    _of = Sum._of

    def _cov(self, lags, t, xp):
        total = None
        for i, (k, x) in enumerate(zip(self.parts, lags, strict=True)):
            c = k._cov([x], self._of(t, i), xp)
            total = c if total is None else total * c
        return total

    def _grad(self, lags, t, name, xp):
        head, _, inner = name.partition("_")
        total = None
        for i, (k, x) in enumerate(zip(self.parts, lags, strict=True)):
            c = k._grad([x], self._of(t, i), inner, xp) if i == int(head[1:]) else k._cov([x], self._of(t, i), xp)
            total = c if total is None else total * c
        return total


@dataclass(frozen=True)
class BivariateUniform(Kernel):
    """Two variates of one kernel: [[1, r f], [r f, f^2]] times it; cov and grad give the four entries."""

    base: Kernel = field(default_factory=SquaredExponential)

    def declared(self):
        return [Param("r", 0.0, -0.99, 0.99), Param("f", 1.0, 0.01, 100.0), *self.base.params]

    def factors(self, t) -> dict:
        return {(0, 0): 1.0, (0, 1): t["r"] * t["f"], (1, 0): t["r"] * t["f"], (1, 1): t["f"] * t["f"]}

    def cov(self, lags, t) -> dict:
        c = self.base._cov(lags, t, math_of(*lags, *t.values()))
        return {ab: c * x for ab, x in self.factors(t).items()}

    def _entries(self, lags, t, name) -> dict:
        xp = math_of(*lags, *t.values())
        if name in ("r", "f"):
            c = self.base._cov(lags, t, xp)
            cross, own = (t["f"], 0.0) if name == "r" else (t["r"], 2.0 * t["f"])
            return {(0, 0): c * 0.0, (0, 1): c * cross, (1, 0): c * cross, (1, 1): c * own}
        g = self.base._grad(lags, t, name, xp)
        return {ab: g * x for ab, x in self.factors(t).items()}

    def grad(self, lags, t, name) -> dict:
        out = self._entries(lags, t, name)
        for p in self.params:
            if p.link == name:
                more = self._entries(lags, t, p.name)
                out = {ab: c + more[ab] for ab, c in out.items()}
        return out


# ------------------------------------------------------------------ spectral models


def spectral_matern(freqs: list, rho: float, nu: float):
    """Spectral density of the unit-variance Matern model; rho and nu are numbers."""
    d = len(freqs)
    front = 2.0**d * math.pi ** (d / 2) * math.gamma(nu + d / 2) * (2 * nu) ** nu / (math.gamma(nu) * rho ** (2 * nu))
    base = 2 * nu / rho**2 + 4 * math.pi**2 * _square(freqs)
    power = -(nu + d / 2)
    return front * (F.pow(base, F.lit(power)) if isinstance(base, Column) else base**power)


def spectral_acv(density, shape: tuple[int, ...], delta: tuple[float, ...]) -> np.ndarray:
    """Autocovariance on lags 0..n-1, -(n-1)..-1 from a density on the half-step torus of 3 n + 1 points, scaled by the cell size."""
    m = [3 * n + 1 for n in shape]
    f = np.meshgrid(*(np.fft.fftfreq(k, d / 2) for k, d in zip(m, delta, strict=True)), indexing="ij")
    out = np.fft.fftn(density(list(f))).real / np.prod([k * d / 2 for k, d in zip(m, delta, strict=True)])
    for axis, n in enumerate(shape):
        lags = np.concatenate([np.arange(n), np.arange(-(n - 1), 0)]) * 2
        out = np.take(out, lags % m[axis], axis)
    return out


class _Numeric(Kernel):
    """Kernels on arrays alone, one parameter row at a time, with gradients by central differences."""

    vectorised = False

    def _grad(self, lags, t, name, xp):
        step = 1e-5 * max(abs(t[name]), 1e-2)
        up, down = (self._cov(lags, t | {name: t[name] + d}, xp) for d in (step, -step))
        return (up - down) / (2 * step)


@dataclass(frozen=True)
class Spectral(_Numeric):
    """A model given by its density: density(frequencies, theta) of any number of axes; lags must be those of a grid, 0..n-1, -(n-1)..-1."""

    density: object = None
    own: tuple[Param, ...] = ()

    def declared(self):
        return list(self.own)

    def _cov(self, lags, t, xp):
        lags = [np.asarray(x, float) for x in lags]
        size = np.broadcast_shapes(*(x.shape for x in lags))
        if len(size) != len(lags) or any(n % 2 == 0 for n in size):
            raise ValueError("a spectral model needs the lags of a grid")
        delta = tuple(float(np.moveaxis(np.broadcast_to(x, size), a, 0)[1].flat[0]) if size[a] > 1 else 1.0 for a, x in enumerate(lags))
        return spectral_acv(lambda f: self.density(f, t), tuple((n + 1) // 2 for n in size), delta)


def spectral_matern_kernel() -> Spectral:
    """The Matern model by its density: rho, nu and sigma are parameters like any other."""
    own = (Param("rho", 1.0, 0.01, 1e3), Param("nu", 1.5, 0.1, 20.0), Param("sigma", 1.0, 0.0, INF))
    return Spectral(lambda f, t: t["sigma"] ** 2 * spectral_matern(f, t["rho"], t["nu"]), own)


@dataclass(frozen=True)
class Matern(_Numeric):
    """The general Matern model: rho, sigma and nu are parameters."""

    def declared(self):
        return [_scale("rho"), _scale("sigma"), Param("nu", 1.5, 0.05, 20.0)]

    def _cov(self, lags, t, xp):
        r, back = np.unique(np.sqrt(_square([np.asarray(x, float) for x in lags])), return_inverse=True)
        return matern(r, t["rho"], t["sigma"], t["nu"], closed=False)[back].reshape(np.broadcast_shapes(*(np.shape(x) for x in lags)))

    def _grad(self, lags, t, name, xp):
        return 2.0 * self._cov(lags, t, xp) / t["sigma"] if name == "sigma" else super()._grad(lags, t, name, xp)


# ------------------------------------------------------------------ older forms kept under their own names


def old_exponential(lags, rho, sigma, xp=None):
    return Exponential().cov(lags, {"rho": rho, "sigma": sigma})


def old_anisotropic_exponential(lags, rho1, rho2, theta, sigma):
    xp = math_of(*lags)
    x = (lags[0] * math.cos(theta) - lags[1] * math.sin(theta)) / rho1
    y = (lags[0] * math.sin(theta) + lags[1] * math.cos(theta)) / rho2
    return sigma * sigma * xp.exp(-xp.sqrt(x * x + y * y))


def old_line_exponential(x, rho):
    xp = math_of(x)
    return xp.exp(-xp.abs(x) / rho)


def old_line_squared(x, rho):
    return math_of(x).exp(-(x * x) / (rho * rho))


def old_separable(lags, rho, squared: bool = False):
    one = old_line_squared if squared else old_line_exponential
    return one(lags[0], rho) * one(lags[1], rho)


def old_matern32(lags, rho):
    """Unit variance: sigma never counted here."""
    return Matern32().cov(lags, {"rho": rho, "sigma": 1.0})


def old_squared_exponential(lags, rho, sigma):
    c = SquaredExponential().cov(lags, {"rho": rho, "sigma": sigma})
    return c + math_of(*lags).where(_square(lags) == 0, 0.001, 0.0)


def bessel_k(nu: float, x: np.ndarray) -> np.ndarray:
    """K_nu by the integral over exp(-x cosh t) cosh(nu t), trapezoid rule."""
    t = np.linspace(0, 30, 6001)
    x = np.asarray(x, float)[..., None]
    with np.errstate(over="ignore", under="ignore"):
        y = np.exp(-x * np.cosh(t) + nu * t) / 2 + np.exp(-x * np.cosh(t) - nu * t) / 2
    return (y[..., 1:] + y[..., :-1]).sum(-1) * (t[1] - t[0]) / 2


def matern(r: np.ndarray, rho: float, sigma: float, nu: float, closed: bool = True) -> np.ndarray:
    """General Matern; closed at half-integer nu up to 5/2 (unless told not to), else by quadrature."""
    r = np.asarray(r, float)
    half = {0.5: Exponential, 1.5: Matern32, 2.5: Matern52}.get(nu)
    if half and closed:
        return half().cov([r], {"rho": rho, "sigma": sigma})
    u = math.sqrt(2 * nu) * np.where(r > 0, r, 1.0) / rho
    return np.where(r > 0, sigma**2 * 2 ** (1 - nu) / math.gamma(nu) * u**nu * bessel_k(nu, u), sigma**2)
