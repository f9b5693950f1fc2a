import numpy as np
import pytest
from meshwave.functions import arrays
from meshwave.functions import kernels as K
from meshwave.operators import fields as W
from meshwave.operators import grid as G
from meshwave.operators import likelihood as L
from meshwave.operators import spectral as S
from pyspark.sql import functions as F

RNG = np.random.default_rng(0)


def table(spark, z, g):
    rows = [(*map(int, i), float(z[i]), float(g[i])) for i in np.ndindex(*z.shape)]
    return spark.createDataFrame(rows, ", ".join(f"i{a} int" for a in range(z.ndim)) + ", z double, g double")


def as_array(df, shape, value, axis="k"):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r[f"{axis}{a}"] for a in range(len(shape)))] = r[value]
    return out


@pytest.mark.parametrize("shape", [(12,), (6, 5), (4, 3, 5)])
def test_relational_plans_equal_fast_transforms(spark, shape):
    z, g = RNG.normal(size=shape), (RNG.random(shape) > 0.3).astype(float)
    grid, df = G.GridSpec(shape), table(spark, z, g)
    np.testing.assert_allclose(as_array(S.periodogram(df, grid, []), shape, "p"), arrays.periodogram(z, g), atol=1e-10)
    f = arrays.Field(z, g)
    kernel = S.spatial_kernel(df, grid, [])
    e = S.expected_periodogram(kernel, grid, [], K.Exponential(), {"rho": 2.0, "sigma": 1.3}, ["rho"])
    np.testing.assert_allclose(as_array(e, shape, "e"), f.e(K.Exponential(), {"rho": 2.0, "sigma": 1.3}), atol=1e-10)
    np.testing.assert_allclose(as_array(e, shape, "de_rho"), f.de(K.Exponential(), {"rho": 2.0, "sigma": 1.3}, ["rho"])[0], atol=1e-10)
    big = as_array(W.large_dft(df, grid, F.col("z") * F.col("g")), shape, "re")
    np.testing.assert_allclose(big, np.fft.fftn(z * g).real, atol=1e-10)


def test_kernel_of_ones_and_identities():
    np.testing.assert_allclose(arrays.spatial_kernel(np.ones(10)), [1, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], atol=1e-12)
    z, g = RNG.normal(size=(7, 6)), (RNG.random((7, 6)) > 0.4).astype(float)
    assert np.isclose(arrays.periodogram(z, g).sum(), ((z * g) ** 2).sum())
    f = arrays.Field(z, g)
    assert np.isclose(f.e(K.Matern32(), {"rho": 2.0, "sigma": 1.5}).mean(), 2.25 * g.sum() / 42)


def test_expectation_of_simulated_periodograms():
    shape, t = (16, 12), {"rho": 3.0, "sigma": 1.0}
    g = np.ones(shape)
    g[:4] = 0
    lam, _ = arrays.embedding(K.Exponential(), t, shape)
    mean = np.mean([arrays.periodogram(arrays.simulate(lam, shape, np.random.default_rng([4, i])), g) for i in range(6000)], 0)
    np.testing.assert_allclose(mean, arrays.Field(np.zeros(shape), g).e(K.Exponential(), t), rtol=0.1)


def test_known_fisher(spark):
    f = arrays.Field(np.zeros((67, 192)), np.ones((67, 192)))
    t = {"rho": 30.0, "sigma": 1.41}
    e, de = f.e(K.Exponential(), t), f.de(K.Exponential(), t, ["rho", "sigma"])
    h = np.array([[np.mean(a * b / e**2) for b in de] for a in de])
    np.testing.assert_allclose(h, [[1.03736229e-3, -4.49238561e-2], [-4.49238561e-2, 2.01197123]], rtol=1e-6)


def test_score_by_differences_and_recovery():
    t, shape = {"rho": 5.0, "sigma": 1.0}, (64, 64)
    lam, _ = arrays.embedding(K.Exponential(), t, shape)
    f = arrays.Field(arrays.simulate(lam, shape, np.random.default_rng(3)), np.ones(shape))
    value, s = f.value_and_score(K.Exponential(), t, ["rho", "sigma"])
    for i, n in enumerate(("rho", "sigma")):
        d = (f.value(K.Exponential(), t | {n: t[n] + 1e-5}) - f.value(K.Exponential(), t | {n: t[n] - 1e-5})) / 2e-5
        assert np.isclose(s[i], d, rtol=1e-4)
    k = K.Exponential().fix("sigma", 1.0)
    x, *_ = arrays.minimise(lambda v: f.value_and_score(k, k.theta(v), ["rho"]), np.array([1.0]), k.bounds())
    assert abs(x[0] - 5) < 0.75
    y, *_ = arrays.nelder_mead(lambda v: f.value(k, k.theta(v)), np.array([1.0]), k.bounds())
    assert np.isclose(x[0], y[0], rtol=1e-4)
    w, _ = arrays.differential_evolution(lambda v: f.value(k, k.theta(v)), [(0.1, 30.0)], np.random.default_rng(0), 15)
    assert abs(w[0] - x[0]) < 0.5


def test_exact_and_sampled_score_covariance(spark):
    grid, t = G.GridSpec((16, 16)), {"rho": 2.0, "sigma": 1.0}
    g = np.ones(grid.shape)
    exact = {(r["i"], r["j"]): r["value"] for r in W.jmatrix(spark, grid, g, K.Exponential(), t, ["rho", "sigma"]).collect()}
    sample = {(r["i"], r["j"]): r["value"] for r in W.jmatrix_sample(spark, grid, g, K.Exponential(), t, ["rho", "sigma"], 4000, 1).collect()}
    for ij in exact:
        assert np.isclose(exact[ij], sample[ij], rtol=0.15, atol=2e-4)


def test_fit_methods_agree(spark):
    grid, t = G.GridSpec((24, 20)), {"rho": 3.0, "sigma": 1.0}
    sims = W.simulate(spark, grid, K.Exponential(), t, 3, 5)
    k = K.Exponential().bound("rho", 0.1, 30)
    fits = {m: {r["sim_id"]: r["theta"]["rho"] for r in W.fit(sims, grid, ["sim_id"], k, method=m).collect()} for m in ("lbfgs", "nelder-mead", "evolution")}
    for s in range(3):
        assert np.isclose(fits["lbfgs"][s], fits["nelder-mead"][s], rtol=1e-3)
        assert np.isclose(fits["lbfgs"][s], fits["evolution"][s], rtol=1e-3)
    again = W.simulate(spark.newSession(), grid, K.Exponential(), t, 3, 5).repartition(7).groupBy("sim_id").agg(F.sum("z").alias("z"))
    assert {r["sim_id"]: round(r["z"], 9) for r in again.collect()} == {r["sim_id"]: round(r["z"], 9) for r in sims.groupBy("sim_id").agg(F.sum("z").alias("z")).collect()}


def test_bivariate_score_and_simulation(spark):
    grid, t = G.GridSpec((8, 8)), {"r": 0.3, "f": 1.5, "rho": 1.0, "sigma": 1.0}
    m = K.BivariateUniform(K.Exponential())
    field = W.simulate_bivariate(spark, grid, m, t, 1, 2).drop("sim_id").cache()
    cross, kernel = S.cross_periodogram(field, grid, []), S.spatial_kernel(field, grid, [], variates=True)
    names = list(t)
    got = L.bivariate_whittle(cross, S.expected_bivariate(kernel, grid, [], m, t, names), grid, [], [], names).first()
    for n in names:
        a, b = (L.bivariate_whittle(cross, S.expected_bivariate(kernel, grid, [], m, t | {n: t[n] + h}), grid, [], []).first()["ll"] for h in (1e-4, -1e-4))
        assert np.isclose(got[f"s_{n}"], (a - b) / 2e-4, rtol=1e-3, atol=1e-6)


def test_kriging_returns_observations(spark):
    pts = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 2.0, -1.0)], "k int, x0 double, y double")
    new = spark.createDataFrame([(1, 7, 1.0), (1, 8, 50.0), (2, 9, 0.0)], "k int, pt_id long, x0 double")
    got = {r["pt_id"]: r for r in W.krige(pts, new, ["k"], 1, K.Exponential(), {"rho": 2.0, "sigma": 1.0}).collect()}
    assert np.isclose(got[7]["mean"], 2.0) and np.isclose(got[7]["variance"], 0, atol=1e-9)
    assert abs(got[8]["mean"]) < 1e-6 and np.isclose(got[8]["variance"], 1)
    assert got[9]["mean"] == 0


def test_embedding_doubles_or_raises():
    lam, least = arrays.embedding(K.SquaredExponential(), {"rho": 20.0, "sigma": 1.0}, (64, 64))
    assert least > -1e-2 and lam.shape[0] > 127
    with pytest.raises(ValueError):
        arrays.embedding(K.Matern32(), {"rho": 30.0, "sigma": 1.0}, (16, 16), doublings=0)


def test_grid_checks(spark):
    with pytest.raises(ValueError):
        G.GridSpec((3, 0))
    grid = G.GridSpec((4, 5), (1.0, 2.0))
    assert grid.n_points == 20 and grid.extent == (4.0, 10.0) and grid.separate([0]).shape == (4, 1)
    mask = G.cells(spark, grid).withColumn("g", F.lit(1.0))
    assert G.check_mask(mask, grid) is mask
    with pytest.raises(ValueError):
        G.check_mask(mask.union(mask.limit(1)), grid)


def test_strategy():
    assert [W.strategy(G.GridSpec(s), n) for s, n in (((30, 24), 5), ((64,), 2000), ((1 << 13, 1 << 13), 1))] == ["relational", "task", "rows"]


def test_image_mask_and_theta_files(spark, tmp_path):
    from meshwave.sources import fields as src

    with open(tmp_path / "m.bmp", "wb") as f:  # 2 x 2, 24 bits: bottom row black and white, top row white and black
        body = bytes([0, 0, 0, 255, 255, 255, 0, 0]) + bytes([255, 255, 255, 0, 0, 0, 0, 0])
        f.write(b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(4) + len(body).to_bytes(4, "little") + bytes(16))
        f.write(body)
    got = as_array(src.image_mask(spark, str(tmp_path / "m.bmp")), (2, 2), "g", "i")
    np.testing.assert_array_equal(got, [[1, 0], [0, 1]])
    src.write_theta(spark.createDataFrame([(0, 1.5)], "theta_id int, rho double"), str(tmp_path / "t"), "json")
    assert src.read_theta(spark, str(tmp_path / "t"), "json").first()["rho"] == 1.5


def test_fields_together_are_each_alone():
    """Batched values, slopes and fits equal those of single fields, with masks of their own."""
    shape, kernel = (9, 7), K.Exponential().bound("rho", 0.05, 20)
    lam, _ = arrays.embedding(kernel, {"rho": 2.0, "sigma": 1.3}, shape)
    z = np.stack([arrays.simulate(lam, shape, np.random.default_rng([9, i])) for i in range(12)])
    g = np.stack([np.ones(shape) if i % 2 else (np.arange(63).reshape(shape) % 5 > 0).astype(float) for i in range(12)])
    many, names = arrays.Fields(z, g), ["rho", "sigma"]
    x = np.linspace([0.5, 0.5], [4.0, 2.0], 12)
    value, slope = many.value_and_score(kernel, kernel.theta(list(x.T)), names, np.arange(12))
    found, ll, _, ok = arrays.minimise_many(lambda x, i: many.value_and_score(kernel, kernel.theta(list(x.T)), names, i), np.ones((12, 2)), kernel.bounds())
    for i in range(12):
        one = arrays.Field(z[i], g[i])
        v, s = one.value_and_score(kernel, kernel.theta(x[i]), names)
        assert np.isclose(value[i], v) and np.allclose(slope[i], s)
        y, low, *_ = arrays.minimise(lambda t: one.value_and_score(kernel, kernel.theta(t), names), np.ones(2), kernel.bounds())
        assert ok[i] and abs(low - ll[i]) < 1e-8 and np.allclose(y, found[i], rtol=1e-3)


def test_searches_find_the_least_place():
    rng = np.random.default_rng(0)
    for search in (arrays.differential_evolution, arrays.dual_annealing, arrays.divide_rectangles):
        x, f = search(lambda v: float((v[0] - 3) ** 2 + 10 * np.sin(v[1] - 1) ** 2 + 0.1 * (v[1] - 1) ** 2), [(0, 10), (-5, 8)], rng)
        assert f < 0.3 and abs(x[0] - 3) < 0.6, search


def test_several_variates_and_their_fit(spark):
    """The value of two variates equals the relational plan's; a fit recovers the parameters, tied and fixed ones included; three variates
    of one kernel have a value that is the sum over independent ones."""
    shape, t = (24, 20), {"r": 0.4, "f": 1.5, "rho": 3.0, "sigma": 1.0}
    grid, model = G.GridSpec(shape), K.BivariateUniform(K.Exponential().bound("rho", 0.05, 30))
    df = W.simulate_bivariate(spark, grid, model, t, 6, 2)
    mask = F.when((F.col("i0") + F.col("var")) % 4 > 0, 1.0).otherwise(0.0)
    masked = df.withColumn("g", mask)
    one = masked.where("sim_id = 0")
    pdf = one.toPandas()
    z, g = (np.stack([W.dense(pdf[pdf["var"] == v], grid, c) for v in (0, 1)], -1) for c in ("z", "g"))
    ll = L.bivariate_whittle(S.cross_periodogram(one, grid, []), S.expected_bivariate(S.spatial_kernel(one, grid, [], variates=True), grid, [], model, t, ["r", "rho"]), grid, [], [], ["r", "rho"]).first()
    value, score = arrays.VectorField(z, g).value_and_score(model, t, ["r", "rho"])
    assert np.isclose(value, ll["ll"]) and np.allclose(score, [ll["s_r"], ll["s_rho"]])
    fits = W.fit_several(masked, grid, ["sim_id"], model.fix("sigma", 1.0)).collect()
    mean = {k: np.mean([r["theta"][k] for r in fits]) for k in t}
    assert all(r["converged"] and r["score"] < 1e-4 for r in fits) and abs(mean["r"] - 0.4) < 0.1 and abs(mean["f"] - 1.5) < 0.2 and 1.5 < mean["rho"] < 5

    class Three:
        def cov(self, lags, theta):
            c = K.Exponential().cov(lags, theta)
            return {(a, b): c * (a == b) for a in range(3) for b in range(3)}

    z3, g3 = np.stack([z[..., 0], z[..., 1], z[..., 0]], -1), np.stack([g[..., 0], g[..., 1], g[..., 0]], -1)
    apart = sum(arrays.Field(z3[..., v], g3[..., v]).value(K.Exponential(), {"rho": 2.0, "sigma": 1.0}) for v in range(3))
    assert np.isclose(arrays.VectorField(z3, g3).value_and_score(Three(), {"rho": 2.0, "sigma": 1.0}, [])[0], apart)


def test_estimator_covariance_from_a_fit(spark):
    """The covariance that a fit reports is near the spread of fits of simulated fields."""
    grid, kernel = G.GridSpec((64,)), K.Exponential().bound("rho", 0.05, 40)
    df = W.simulate(spark, grid, kernel, {"rho": 4.0, "sigma": 1.0}, 300, 5)
    fits = W.fit(df, grid, ["sim_id"], kernel, covariance=True).collect()
    spread = np.var([r["theta"]["sigma"] for r in fits])
    assert 0.5 < np.median([r["covariance"]["sigma|sigma"] for r in fits]) / spread < 2


def test_spectral_and_general_matern_models(spark):
    """Models given by a density, and the general Matern, have expected periodograms and can be fitted."""
    lags = arrays.lag_grids((48, 40))
    near = K.spectral_matern_kernel().cov(lags, {"rho": 6.0, "nu": 1.5, "sigma": 1.0})
    assert np.abs(near - K.Matern32().cov(lags, {"rho": 6.0, "sigma": 1.0})).max() < 0.03  # the density's torus is half as wide again
    grid = G.GridSpec((96,))
    df = W.simulate(spark, grid, K.Matern32(), {"rho": 5.0, "sigma": 1.0}, 3, 4)
    for kernel in (K.Matern().fix("nu", 1.5).bound("rho", 0.2, 40), K.spectral_matern_kernel().fix("nu", 1.5).bound("rho", 0.2, 40)):
        for r, q in zip(sorted(W.fit(df, grid, ["sim_id"], kernel).collect()), sorted(W.fit(df, grid, ["sim_id"], K.Matern32().bound("rho", 0.2, 40)).collect()), strict=True):
            assert abs(r["ll"] - q["ll"]) < 0.05 and abs(r["theta"]["rho"] / q["theta"]["rho"] - 1) < 0.25


def test_exact_score_covariance_is_the_plan(spark):
    g = (np.arange(30).reshape(6, 5) % 4 > 0).astype(float)
    grid, t, names = G.GridSpec((6, 5)), {"rho": 2.0, "sigma": 1.0}, ["rho", "sigma"]
    f = arrays.Field(np.zeros(grid.shape), g)
    e, de = f.e(K.Exponential(), t), f.de(K.Exponential(), t, names)
    got = arrays.exact_score_covariance(K.Exponential().cov(f.lags, t), g, [d / e**2 for d in de])
    for r in W.jmatrix(spark, grid, g, K.Exponential(), t, names).collect():
        assert np.isclose(got[names.index(r["i"]), names.index(r["j"])], r["value"])


def test_kriging_by_neighbours(spark):
    """With as many neighbours as points the answer is the whole system's; with few it is near; too many points raise."""
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(0, float(a), float(b), float(np.sin(a) + b)) for a, b in rng.uniform(0, 6, (80, 2))], "k int, x0 double, x1 double, y double")
    new = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 6, (10, 2)))], "k int, pt_id long, x0 double, x1 double")
    run = lambda **o: {r["pt_id"]: r["mean"] for r in W.krige(pts, new, ["k"], 2, K.Exponential(), {"rho": 2.0, "sigma": 1.0}, **o).collect()}
    whole, same, few = run(), run(neighbours=80), run(neighbours=16)
    assert all(np.isclose(whole[i], same[i]) and abs(whole[i] - few[i]) < 0.2 for i in whole)
    with pytest.raises(Exception, match="neighbours"):
        run(most=50)


def test_kept_plans_are_found_again(spark, small):
    from meshwave.sources import fields as src

    per = lambda: S.periodogram(src.event_fields(spark, small, "click"), src.EVENTS, [])
    first = S.kept(per())
    assert S.kept(per()) is first and S.kept(per().where("k0 > 2")) is not first and first.is_cached
    S.forget()
    assert not first.is_cached


def test_npy_round_trip(spark, tmp_path):
    from meshwave.sources import fields as src

    grid = G.GridSpec((5, 4))
    df = W.simulate(spark, grid, K.Exponential(), {"rho": 2.0, "sigma": 1.0}, 3, 1)
    assert src.write_npy(df, grid, "sim_id", "z", f"file:{tmp_path}/out").count() == 3
    back = {(r["name"], r["i0"], r["i1"]): r["z"] for r in src.read_npy(spark, f"{tmp_path}/out", 2).collect()}
    assert back == {(str(r["sim_id"]), r["i0"], r["i1"]): r["z"] for r in df.collect()}


def test_approximate_embedding_and_strategy():
    rough = K.SquaredExponential()
    lam, least = arrays.embedding(rough, {"rho": 12.0, "sigma": 1.0}, (10, 10), approximate=True)
    assert least < -0.01 and (lam >= 0).all() and lam.shape == (19, 19)
    assert [W.strategy(G.GridSpec(s), f, r) for s, f, r in (((30, 24), 1, 20), ((30, 24), 1, 100), ((64,), 2000, 1), ((8192, 8192), 1, 1))] == ["relational", "task", "task", "rows"]
