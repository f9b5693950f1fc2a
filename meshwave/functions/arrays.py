"""The spectral operators on dense NumPy arrays, for use inside one task: one field, one parameter row or one simulation at a time."""

from __future__ import annotations

import math

import numpy as np


def periodogram(z: np.ndarray, g: np.ndarray | None = None, double: bool = False) -> np.ndarray:
    x = z if g is None else z * g
    return np.abs(np.fft.fftn(x, [2 * n for n in x.shape] if double else x.shape, axes=range(x.ndim))) ** 2 / z.size


def cross_periodogram(z: np.ndarray, g: np.ndarray | None = None) -> np.ndarray:
    """z: shape + (p,); result shape + (p, p)."""
    x = z if g is None else z * g
    j = np.fft.fftn(x, axes=tuple(range(z.ndim - 1)))
    return j[..., :, None] * np.conj(j[..., None, :]) / math.prod(z.shape[:-1])


def spatial_kernel(g: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
    """Linear correlation sum of g(s + t) h(s) over N on lags 0..n-1, -(n-1)..-1."""
    size = [2 * n - 1 for n in g.shape]
    a = np.fft.fftn(g, size, axes=range(g.ndim))
    b = a if h is None else np.fft.fftn(h, size, axes=range(g.ndim))
    return np.fft.ifftn(a * np.conj(b)).real / g.size


def offset_kernel(g: np.ndarray, offset: tuple[int, ...]) -> np.ndarray:
    """Sum of g(s) g(s + t) exp(-2 pi i m s / n) over N."""
    size = [2 * n - 1 for n in g.shape]
    turn = sum(m * i / n for m, i, n in zip(offset, np.indices(g.shape), g.shape, strict=True))
    return np.fft.ifftn(np.fft.fftn(g, size, axes=range(g.ndim)) * np.conj(np.fft.fftn(g * np.exp(2j * np.pi * turn), size, axes=range(g.ndim)))) / g.size


def lag_grids(shape: tuple[int, ...], delta: tuple[float, ...] | None = None) -> list[np.ndarray]:
    """Lags 0..n-1, -(n-1)..-1 of each axis, as a mesh."""
    delta = delta or (1.0,) * len(shape)
    return np.meshgrid(*(np.concatenate([np.arange(n), np.arange(1 - n, 0)]) * d for n, d in zip(shape, delta, strict=True)), indexing="ij")


def torus_lags(shape: tuple[int, ...], delta: tuple[float, ...] | None = None) -> list[np.ndarray]:
    """Distances around the grid's own torus, as a mesh."""
    delta = delta or (1.0,) * len(shape)
    return np.meshgrid(*(np.minimum(np.arange(n), n - np.arange(n)) * d for n, d in zip(shape, delta, strict=True)), indexing="ij")


def fold(x: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sum lags 0..n-1, -(n-1)..-1 that are equal modulo n, axis by axis."""
    for axis, n in enumerate(shape):
        pos, neg = np.split(x, [n], axis)
        pad = [(0, 0)] * x.ndim
        pad[axis] = (1, 0)
        x = pos + np.pad(neg, pad)
    return x


def transform_lags(x: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of x(t) exp(-2 pi i k t / n)."""
    return np.fft.fftn(fold(x, shape), axes=tuple(range(len(shape))))


def expected(cov: np.ndarray, cg: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    return transform_lags(cov * cg, shape).real


class Field:
    """What does not depend on parameters: the periodogram and the folded spatial kernel's lags."""

    def __init__(self, z: np.ndarray, g: np.ndarray, delta: tuple[float, ...] | None = None):
        self.shape, self.delta = z.shape, delta
        self.p = periodogram(z, g)
        self.cg = spatial_kernel(g)
        self.lags = lag_grids(z.shape, delta)

    def e(self, kernel, theta: dict) -> np.ndarray:
        return expected(np.broadcast_to(kernel.cov(self.lags, theta), self.cg.shape), self.cg, self.shape)

    def de(self, kernel, theta: dict, names: list[str]) -> list[np.ndarray]:
        return [expected(np.broadcast_to(kernel.grad(self.lags, theta, g), self.cg.shape), self.cg, self.shape) for g in names]

    def value(self, kernel, theta: dict) -> float:
        e = self.e(kernel, theta)
        return float(np.mean(np.log(e) + self.p / e)) if (e > 0).all() else math.inf

    def value_and_score(self, kernel, theta: dict, names: list[str]) -> tuple[float, np.ndarray]:
        e = self.e(kernel, theta)
        if not (e > 0).all():
            return math.inf, np.zeros(len(names))
        return float(np.mean(np.log(e) + self.p / e)), np.array([np.mean((e - self.p) * d / e**2) for d in self.de(kernel, theta, names)])


class Fields:
    """Many fields of one grid at once: z and g are (fields, *shape). Parameters are one number each or one a field."""

    def __init__(self, z: np.ndarray, g: np.ndarray, delta: tuple[float, ...] | None = None):
        self.shape = z.shape[1:]
        axes = tuple(range(1, z.ndim))
        self.p = np.abs(np.fft.fftn(z * g, axes=axes)) ** 2 / math.prod(self.shape)
        masks, self.of = np.unique(g.reshape(len(g), -1), axis=0, return_inverse=True)
        self.cg = np.stack([spatial_kernel(m.reshape(self.shape)) for m in masks])  # one for each mask
        self.of = self.of.ravel()
        self.lags = [x[None] for x in lag_grids(self.shape, delta)]

    def _spread(self, theta: dict) -> dict:
        return {k: np.asarray(v, float).reshape(-1, *(1,) * len(self.shape)) if np.ndim(v) else v for k, v in theta.items()}

    def _expected(self, cov: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The transform of cov times each field's kernel, lags folded."""
        x = cov * self.cg[self.of[at]]
        for axis, n in enumerate(self.shape, 1):
            pos, neg = np.split(x, [n], axis)
            pad = [(0, 0)] * x.ndim
            pad[axis] = (1, 0)
            x = pos + np.pad(neg, pad)
        return np.fft.fftn(x, axes=tuple(range(1, x.ndim))).real

    def e(self, kernel, theta: dict, at: np.ndarray) -> np.ndarray:
        return self._expected(kernel.cov(self.lags, self._spread(theta)), at)

    def value_and_score(self, kernel, theta: dict, names: list[str], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and gradients of the fields `at`, with their parameters."""
        t, p = self._spread(theta), self.p[at]
        e = self._expected(kernel.cov(self.lags, t), at)
        axes = tuple(range(1, e.ndim))
        ok = (e > 0).all(axes)
        e = np.where(e > 0, e, 1.0)
        value = np.where(ok, np.mean(np.log(e) + p / e, axes), math.inf)
        slope = (e - p) / e**2
        return value, np.stack([np.mean(slope * self._expected(kernel.grad(self.lags, t, n), at), axes) for n in names], 1)


class VectorField:
    """A field of several variates: z and g are shape + (p,)."""

    def __init__(self, z: np.ndarray, g: np.ndarray, delta: tuple[float, ...] | None = None):
        self.shape, self.p = z.shape[:-1], z.shape[-1]
        self.i = cross_periodogram(z, g)
        self.cg = {(a, b): spatial_kernel(g[..., a], g[..., b]) for a in range(self.p) for b in range(self.p)}
        self.lags = lag_grids(self.shape, delta)

    def _matrix(self, entries: dict) -> np.ndarray:
        out = np.empty((*self.shape, self.p, self.p), complex)
        for ab, c in entries.items():
            out[..., ab[0], ab[1]] = transform_lags(np.broadcast_to(c, self.cg[ab].shape) * self.cg[ab], self.shape)
        return out

    def e(self, model, theta: dict) -> np.ndarray:
        return self._matrix(model.cov(self.lags, theta))

    def value_and_score(self, model, theta: dict, names: list[str]) -> tuple[float, np.ndarray]:
        """Mean of log det E + tr E^-1 I, and its gradient; infinite where E is not positive."""
        e = self.e(model, theta)
        sign, log = np.linalg.slogdet(e)
        if not (sign.real > 0).all() or not (np.einsum("...ii->...i", e).real > 0).all():
            return math.inf, np.zeros(len(names))
        inv = np.linalg.inv(e)
        q = inv @ self.i
        value = float(np.mean(log + np.einsum("...ii->...", q).real))
        score = []
        for n in names:
            t = inv @ self._matrix(model.grad(self.lags, theta, n))
            score.append(float(np.mean(np.einsum("...ii->...", t) - np.einsum("...ij,...ji->...", t, q)).real))
        return value, np.array(score)


# ------------------------------------------------------------------ simulation


def embedding(kernel, theta: dict, shape: tuple[int, ...], delta: tuple[float, ...] | None = None, tolerance: float = 1e-2, doublings: int = 4, approximate: bool = False) -> tuple[np.ndarray, float]:
    """(eigenvalues of the circulant embedding, their least). Clamped at 0; where one lies below -tolerance the torus is doubled, a few
    times, or taken as it is (approximate)."""
    grown = shape
    for _ in range(doublings + 1):
        lam = np.fft.fftn(np.broadcast_to(kernel.cov(lag_grids(grown, delta), theta), [2 * n - 1 for n in grown])).real
        least = float(lam.min())
        if least > -tolerance or approximate:
            return np.maximum(lam, 0.0), least
        grown = tuple(2 * n for n in grown)
    raise ValueError(f"the embedding is not positive: {least}")


def simulate(lam: np.ndarray, shape: tuple[int, ...], rng: np.random.Generator) -> np.ndarray:
    """A Gaussian field of the embedding's covariance, cropped to the shape."""
    noise = rng.standard_normal(lam.shape) + 1j * rng.standard_normal(lam.shape)
    x = np.fft.fftn(np.sqrt(lam) * noise).real / math.sqrt(lam.size)
    return x[tuple(slice(0, n) for n in shape)]


def simulate_multivariate(cov: dict, p: int, shape: tuple[int, ...], rng: np.random.Generator) -> np.ndarray:
    """p variates of lag covariances cov[a, b] (on the torus): the root of each frequency's matrix, negative eigenvalues at 0."""
    size = cov[0, 0].shape
    spec = np.empty((*size, p, p), complex)
    for (a, b), c in cov.items():
        spec[..., a, b] = np.fft.fftn(c)
    spec = (spec + np.conj(np.swapaxes(spec, -1, -2))) / 2
    value, vector = np.linalg.eigh(spec)
    noise = rng.standard_normal((*size, p)) + 1j * rng.standard_normal((*size, p))
    y = np.einsum("...ij,...j->...i", vector * np.sqrt(np.maximum(value, 0))[..., None, :], noise)
    x = np.fft.fftn(y, axes=tuple(range(len(size)))).real / math.sqrt(math.prod(size))
    return x[tuple(slice(0, n) for n in shape)]


# ------------------------------------------------------------------ covariances of the transform


def dft_diagonal(cov: np.ndarray, g: np.ndarray, offset: tuple[int, ...]) -> np.ndarray:
    """E[J(k) conj J(k - m)] for the k with k and k - m both in range; J over the root of N."""
    full = transform_lags(cov * offset_kernel(g, offset), g.shape)
    return full[tuple(slice(max(0, m), min(n, n + m)) for m, n in zip(offset, g.shape, strict=True))]


def shifted(x: np.ndarray, offset: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(x at k, x at k - m) for the k with both in range."""
    at = tuple(slice(max(0, m), min(n, n + m)) for m, n in zip(offset, x.shape, strict=True))
    back = tuple(slice(max(0, -m), min(n, n - m)) for m, n in zip(offset, x.shape, strict=True))
    return x[at], x[back]


def offset_sum(f: np.ndarray, f2: np.ndarray, cov: np.ndarray, g: np.ndarray, offset: tuple[int, ...]) -> float:
    """Sum over k of f(k) f2(k - m) |E[J(k) conj J(k - m)]|^2."""
    return float(np.sum(shifted(f, offset)[0] * shifted(f2, offset)[1] * np.abs(dft_diagonal(cov, g, offset)) ** 2))


def exact_score_covariance(cov: np.ndarray, g: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """2 / N^2 times the sums of w_a(k) w_b(k') |covariance of the transform at (k, k')|^2: an offset and its opposite have the same terms
    turned, so half of the offsets are enough."""
    j = np.zeros((len(weights), len(weights)))
    for at in np.ndindex(*(2 * n - 1 for n in g.shape)):
        m = tuple(x - (n - 1) for x, n in zip(at, g.shape, strict=True))
        back = tuple(-x for x in m)
        if m < back:
            continue
        k2 = np.abs(dft_diagonal(cov, g, m)) ** 2
        for a, x in enumerate(weights):
            for b, y in enumerate(weights):
                total = np.sum(shifted(x, m)[0] * shifted(y, m)[1] * k2)
                j[a, b] += total
                if m != back:
                    j[b, a] += total
    return j * 2 / g.size**2


# ------------------------------------------------------------------ special functions


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


# ------------------------------------------------------------------ optimisers


def clamp(x: np.ndarray, bounds: list[tuple[float, float]]) -> np.ndarray:
    """Into the bounds; open ends at 0 and infinity give way a little."""
    return np.array([min(max(v, lo + 1e-6 if math.isfinite(lo) else v), hi - 1e-6 if math.isfinite(hi) else 1e6) for v, (lo, hi) in zip(x, bounds, strict=True)])


def minimise(fun, x0: np.ndarray, bounds: list[tuple[float, float]], max_iter: int = 100, trace=None) -> tuple[np.ndarray, float, int, bool]:
    """Projected L-BFGS (memory 8) with backtracking; fun gives (value, gradient). Returns x, value, iterations, converged."""
    x = clamp(np.asarray(x0, float), bounds)
    f, g = fun(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for it in range(max_iter):
        at_edge = (clamp(x - 1e-8 * np.sign(g), bounds) == x) & (g != 0)
        free = np.where(at_edge, 0.0, g)
        if np.abs(free).max(initial=0.0) < 1e-7:
            return x, f, it, True
        q, alphas = free.copy(), []
        for s, y in reversed(steps):
            a = s @ q / (s @ y)
            alphas.append(a)
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= s @ y / (y @ y)
        else:
            q *= min(1.0, 0.1 * max(np.abs(x).max(), 1.0) / max(np.abs(q).max(), 1e-12))
        for (s, y), a in zip(steps, reversed(alphas), strict=True):
            q += s * (a - y @ q / (s @ y))
        if q @ free <= 0:
            q, steps = free, []
        t = 1.0
        while True:
            new = clamp(x - t * q, bounds)
            fn, gn = fun(new)
            if math.isfinite(fn) and fn <= f - 1e-4 * (free @ (x - new)):
                break
            t /= 2
            if t < 1e-12:
                return x, f, it, np.abs(free).max() < 1e-4
        s, y = new - x, gn - g
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps[-7:], (s, y)]
        if trace:
            trace(it, new, fn)
        done = abs(f - fn) < 1e-12 * max(abs(f), 1)
        x, f, g = new, fn, gn
        if done:
            return x, f, it + 1, True
    return x, f, max_iter, False


def minimise_many(fun, x0: np.ndarray, bounds: list[tuple[float, float]], max_iter: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Projected BFGS with backtracking for many problems at once: x0 is (problems, parameters), fun(x, at) gives the values and gradients
    of the problems `at`. Each problem's steps are its own. Returns x, values, iterations, converged."""
    low = np.array([lo + 1e-6 if math.isfinite(lo) else -math.inf for lo, _ in bounds])
    high = np.array([hi - 1e-6 if math.isfinite(hi) else 1e6 for _, hi in bounds])
    x = np.clip(np.asarray(x0, float), low, high)
    n, k = x.shape
    f, g = fun(x, np.arange(n))
    inverse = np.zeros((n, k, k))
    fresh = np.ones(n, bool)  # the inverse Hessian is not known yet
    rounds, good, live = np.zeros(n, np.int64), np.zeros(n, bool), np.arange(n)
    for _ in range(max_iter):
        edge = ((np.clip(x[live] - 1e-8 * np.sign(g[live]), low, high)) == x[live]) & (g[live] != 0)
        free = np.where(edge, 0.0, g[live])
        flat = np.abs(free).max(1, initial=0.0) < 1e-7
        good[live[flat]] = True
        live, free, edge = live[~flat], free[~flat], edge[~flat]
        if not len(live):
            break
        first = np.minimum(1.0, 0.1 * np.maximum(np.abs(x[live]).max(1), 1.0) / np.maximum(np.abs(free).max(1), 1e-12))
        inverse[live[fresh[live]]] = (np.eye(k)[None] * first[:, None, None])[fresh[live]]
        step = np.where(edge, 0.0, np.einsum("bij,bj->bi", inverse[live], free))
        up = np.einsum("bi,bi->b", step, free) <= 0
        step[up] = free[up] * first[up, None]
        fresh[live[up]] = True
        t, new, value, slope = np.ones(len(live)), x[live].copy(), f[live].copy(), g[live].copy()
        todo, stuck = np.arange(len(live)), np.zeros(len(live), bool)
        while len(todo):
            tried = np.clip(x[live[todo]] - t[todo, None] * step[todo], low, high)
            v, s = fun(tried, live[todo])
            ok = np.isfinite(v) & (v <= f[live[todo]] - 1e-4 * np.einsum("bi,bi->b", free[todo], x[live[todo]] - tried))
            new[todo[ok]], value[todo[ok]], slope[todo[ok]] = tried[ok], v[ok], s[ok]
            todo = todo[~ok]
            t[todo] /= 2
            small = t[todo] < 1e-12
            stuck[todo[small]] = True
            todo = todo[~small]
        good[live[stuck]] = np.abs(free[stuck]).max(1, initial=0.0) < 1e-4
        s, y = new - x[live], slope - g[live]
        sy, yy = np.einsum("bi,bi->b", s, y), np.einsum("bi,bi->b", y, y)
        turn = (sy > 1e-12 * yy) & ~stuck
        if turn.any():
            at, sv, yv, c = live[turn], s[turn], y[turn], sy[turn]
            h = np.where(fresh[at][:, None, None], np.eye(k)[None] * (c / yy[turn])[:, None, None], inverse[at])
            left = np.eye(k)[None] - sv[:, :, None] * yv[:, None, :] / c[:, None, None]
            inverse[at] = left @ h @ np.swapaxes(left, 1, 2) + sv[:, :, None] * sv[:, None, :] / c[:, None, None]
            fresh[at] = False
        done = np.abs(f[live] - value) < 1e-12 * np.maximum(np.abs(f[live]), 1)
        x[live], f[live], g[live] = new, value, slope
        rounds[live[~stuck]] += 1
        good[live[done & ~stuck]] = True
        live = live[~stuck & ~done]
    return x, f, rounds, good


def nelder_mead(fun, x0: np.ndarray, bounds: list[tuple[float, float]], max_iter: int = 400) -> tuple[np.ndarray, float, int, bool]:
    n = len(x0)
    sim = [clamp(np.asarray(x0, float), bounds)]
    for i in range(n):
        y = sim[0].copy()
        y[i] = y[i] * 1.1 if y[i] else 0.1
        sim.append(clamp(y, bounds))
    val = [fun(x) for x in sim]
    for it in range(max_iter):
        order = np.argsort(val, kind="stable")
        sim, val = [sim[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) < 1e-12 * max(abs(val[0]), 1) and max(np.abs(s - sim[0]).max() for s in sim) < 1e-7:
            return sim[0], val[0], it, True
        mid = np.mean(sim[:-1], 0)
        r = clamp(2 * mid - sim[-1], bounds)
        fr = fun(r)
        if fr < val[0]:
            e = clamp(3 * mid - 2 * sim[-1], bounds)
            fe = fun(e)
            sim[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            sim[-1], val[-1] = r, fr
        else:
            c = clamp((mid + (r if fr < val[-1] else sim[-1])) / 2, bounds)
            fc = fun(c)
            if fc < min(fr, val[-1]):
                sim[-1], val[-1] = c, fc
            else:
                sim = [sim[0]] + [clamp((s + sim[0]) / 2, bounds) for s in sim[1:]]
                val = [val[0]] + [fun(s) for s in sim[1:]]
    return sim[0], val[0], max_iter, False


def gauss_newton(residual, x0: np.ndarray, bounds: list[tuple[float, float]], max_iter: int = 60) -> tuple[np.ndarray, float, int, bool]:
    """Levenberg-Marquardt with scaled parameters; residual gives (r, jacobian)."""
    x, damp = clamp(np.asarray(x0, float), bounds), 1e-2
    r, j = residual(x)
    f = float(r @ r)
    for it in range(max_iter):
        a, b = j.T @ j, j.T @ r
        new = clamp(x - np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), b), bounds)
        rn, jn = residual(new)
        fn = float(rn @ rn)
        if math.isfinite(fn) and fn < f:
            done = f - fn < 1e-12 * f
            x, r, j, f, damp = new, rn, jn, fn, max(damp / 5, 1e-12)
            if done:
                return x, f, it + 1, True
        else:
            damp *= 5
            if damp > 1e12:
                return x, f, it, True
    return x, f, max_iter, False


def differential_evolution(fun, bounds: list[tuple[float, float]], rng: np.random.Generator, generations: int = 60, size: int = 20) -> tuple[np.ndarray, float]:
    """A seeded population search, for starts without a guess; infinite bounds count as 100 from their finite end."""
    lo = np.array([a if math.isfinite(a) else -100.0 for a, _ in bounds]) + 1e-6
    hi = np.array([b if math.isfinite(b) else max(a, 0.0) + 100.0 for a, b in bounds]) - 1e-6
    x = lo + (hi - lo) * rng.random((size, len(lo)))
    f = np.array([fun(v) for v in x])
    for _ in range(generations):
        for i in range(size):
            a, b, c = x[rng.choice(size, 3, replace=False)]
            y = np.where(rng.random(len(lo)) < 0.8, np.clip(a + 0.7 * (b - c), lo, hi), x[i])
            fy = fun(y)
            if fy < f[i]:
                x[i], f[i] = y, fy
    best = int(np.argmin(f))
    return x[best], float(f[best])


def _box(bounds: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds without infinite ends, which count as 100 from the finite one."""
    lo = np.array([a if math.isfinite(a) else -100.0 for a, _ in bounds]) + 1e-6
    hi = np.array([b if math.isfinite(b) else max(a, 0.0) + 100.0 for a, b in bounds]) - 1e-6
    return lo, hi


def dual_annealing(fun, bounds: list[tuple[float, float]], rng: np.random.Generator, steps: int = 600) -> tuple[np.ndarray, float]:
    """A seeded walk of Cauchy steps that grow shorter with the temperature; worse places are taken by its odds, and the best is kept."""
    lo, hi = _box(bounds)
    x = lo + (hi - lo) * rng.random(len(lo))
    f = fun(x)
    best, low = x, f
    for i in range(steps):
        heat = 0.5 ** (8 * i / steps)
        y = x + (hi - lo) * 0.2 * heat * np.tan(np.pi * (np.clip(rng.random(len(lo)), 0.02, 0.98) - 0.5))
        y = lo + np.abs((y - lo + (hi - lo)) % (2 * (hi - lo)) - (hi - lo))  # reflected into the box
        fy = fun(y)
        if fy <= f or rng.random() < math.exp(-min((fy - f) / (0.05 * heat), 700.0)):
            x, f = y, fy
            if f < low:
                best, low = x, f
    return best, float(low)


def divide_rectangles(fun, bounds: list[tuple[float, float]], rng: np.random.Generator | None = None, evaluations: int = 400) -> tuple[np.ndarray, float]:
    """DIRECT: rectangles on the lower hull of (size, value) are cut in three along their longest sides; nothing is drawn."""
    lo, hi = _box(bounds)
    at = lambda c: lo + (hi - lo) * c
    n = len(lo)
    centers, sides = [np.full(n, 0.5)], [np.zeros(n, int)]
    values = [fun(at(centers[0]))]
    while len(values) < evaluations:
        size = np.array([np.linalg.norm(3.0 ** -s) for s in sides])
        value = np.where(np.isfinite(values), values, 1e300)
        chosen = []
        for s in np.unique(size.round(12))[::-1]:  # of each size the best, as long as values fall
            k = np.flatnonzero(np.isclose(size, s))
            k = int(k[np.argmin(value[k])])
            if not chosen or value[k] < value[chosen[-1]] - 1e-12:
                chosen.append(k)
        for k in chosen:
            for axis in np.flatnonzero(sides[k] == sides[k].min()):
                sides[k] = sides[k] + (np.arange(n) == axis)
                for step in (1, -1):
                    c = centers[k] + step * 3.0 ** -sides[k][axis] * (np.arange(n) == axis)
                    centers.append(c)
                    sides.append(sides[k].copy())
                    values.append(fun(at(c)))
    best = int(np.argmin(values))
    return at(centers[best]), float(values[best])
