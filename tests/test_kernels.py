import math

import numpy as np
import pytest
from meshwave.functions import arrays
from meshwave.functions import kernels as K

ALL = [K.Exponential(), K.SquaredExponential(), K.Matern32(), K.Matern52(), K.RationalQuadratic(), K.Nugget(K.SquaredExponential()), K.Anisotropic(K.Matern32()), K.Exponential() + K.Nugget(K.Matern52()), K.Separable((K.Exponential(), K.RationalQuadratic()))]


@pytest.mark.parametrize("kernel", ALL, ids=lambda k: type(k).__name__)
def test_gradients_by_differences(kernel):
    rng = np.random.default_rng(1)
    lags = [np.concatenate([[0.0], rng.normal(size=20)]) * 3 for _ in range(2)]
    t = kernel.theta() | {p.name: 0.3 + 0.7 * rng.random() for p in kernel.params}
    for p in kernel.params:
        h = 1e-6
        slope = (kernel.cov(lags, t | {p.name: t[p.name] + h}) - kernel.cov(lags, t | {p.name: t[p.name] - h})) / (2 * h)
        np.testing.assert_allclose(kernel.grad(lags, t, p.name), slope, atol=1e-7)


def test_known_values():
    t = {"rho": 5.0, "sigma": 1.41}
    np.testing.assert_allclose(K.Exponential().cov([np.array([0.0, 1.0]), np.zeros(2)], t), [1.9881, 1.62771861], rtol=1e-8)
    np.testing.assert_allclose(K.SquaredExponential().cov([np.array([0.0, 1.0]), np.zeros(2)], t), [1.9881, 1.94873298], rtol=1e-8)
    k = K.Nugget(K.SquaredExponential())
    np.testing.assert_allclose(k.cov([np.array([0.0, 1.0, 2.0])], {"nugget": 0.1, "rho": 12.0, "sigma": 1.0}), [1, 0.89688042, 0.88758641], rtol=1e-7)


def test_parameters():
    k = K.Exponential() + K.Nugget(K.SquaredExponential())
    assert [p.name for p in k.params] == ["m0_rho", "m0_sigma", "m1_nugget", "m1_rho", "m1_sigma"]
    assert len((k + K.Matern32()).parts) == 3
    fixed = K.Exponential().fix("sigma", 2.0)
    assert [p.name for p in fixed.free] == ["rho"] and fixed.theta([3.0]) == {"rho": 3.0, "sigma": 2.0}
    tied = K.RationalQuadratic().tie("alpha", "rho")
    assert tied.theta([2.0, 1.0]) == {"rho": 2.0, "alpha": 2.0, "sigma": 1.0}
    lags, t, h = [np.array([0.5, 2.0])], tied.theta([1.5, 1.0]), 1e-6
    slope = (tied.cov(lags, tied.theta([1.5 + h, 1.0])) - tied.cov(lags, tied.theta([1.5 - h, 1.0]))) / (2 * h)
    np.testing.assert_allclose(tied.grad(lags, t, "rho"), slope, atol=1e-8)
    tight = K.Exponential().bound("rho", 1, 10)
    assert tight.bounds()[0] == (1, 10)
    with pytest.raises(ValueError):
        tight.bound("rho", 0.5, 10)
    with pytest.raises(ValueError):
        K.Exponential().tie("rho", "nu")


def test_general_matern_meets_closed_forms():
    r = np.array([0.0, 0.3, 1.0, 4.0])
    for nu, k in ((0.5, K.Exponential()), (1.5, K.Matern32()), (2.5, K.Matern52())):
        near = K.matern(r, 2.0, 1.3, nu + 1e-7)
        np.testing.assert_allclose(near, k.cov([r], {"rho": 2.0, "sigma": 1.3}), rtol=1e-5)


def test_spectral_matern_is_its_kernel_and_knows_the_step():
    for delta in (1.0, 2.0):
        c = K.spectral_acv(lambda f: K.spectral_matern(f, 6.0, 1.5), (64,), (delta,))
        want = K.Matern32().cov([np.arange(0, 20) * delta], {"rho": 6.0, "sigma": 1.0})
        np.testing.assert_allclose(c[:20], want, atol=0.01)


def test_bivariate_gradients():
    m, lags, h = K.BivariateUniform(K.Matern32()), [np.array([0.0, 1.0, 2.5])], 1e-6
    t = {"r": 0.3, "f": 1.5, "rho": 2.0, "sigma": 1.2}
    for n in t:
        up, down, g = m.cov(lags, t | {n: t[n] + h}), m.cov(lags, t | {n: t[n] - h}), m.grad(lags, t, n)
        for ab in g:
            np.testing.assert_allclose(g[ab], (up[ab] - down[ab]) / (2 * h), atol=1e-7)


def test_chi_square_tail():
    assert math.isclose(arrays.chi2_tail(9.0, 9), 0.4372741889, rel_tol=1e-8)
    assert math.isclose(arrays.chi2_tail(1.0, 2), math.exp(-0.5), rel_tol=1e-12)
