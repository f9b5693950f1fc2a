"""Whole-field operators: many fields, parameter rows or simulations in parallel, each on arrays inside one task; and one field too large
for a task, transformed by rows and then by columns.

A field in one task needs its N cells in memory; small fields go together, BATCH_CELLS of cells at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwave.functions import arrays
from meshwave.operators.grid import GridSpec

#: Cells times parameter rows up to which relational plans are used where nothing else decides, and cells up to which a field goes into one task.
RELATIONAL, ONE_TASK = 1 << 15, 1 << 24
#: Cells up to which fields travel as arrays and are fitted together, cells of those that a task works on at a time, and cells up to which
#: sums over all pairs of frequencies are exact.
ARRAYS, BATCH_CELLS, EXACT = 1 << 16, 1 << 18, 4096
#: Parameter rows that a task takes for a field.
SLICE = 64


def strategy(grid: GridSpec, fields: int = 1, rows: int = 1) -> str:
    """'relational', 'task' (arrays inside a task for each field) or 'rows' (row and column transforms of one large field)."""
    if grid.n_points * rows <= RELATIONAL and fields <= 16:
        return "relational"
    return "task" if grid.n_points <= ONE_TASK else "rows"


def dense(pdf: pd.DataFrame, grid: GridSpec, value: str) -> np.ndarray:
    out = np.zeros(grid.shape)
    out[tuple(pdf[f"i{a}"].to_numpy() for a in range(grid.ndim))] = pdf[value].to_numpy()
    return out


def _keys(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _long(x: np.ndarray, names: list[str], axis: str = "k") -> dict:
    at = np.indices(x.shape).reshape(x.ndim, -1)
    return {f"{axis}{a}": at[a].astype(np.int32) for a in range(x.ndim)} | {names[0]: x.ravel()}


def periodograms(field: DataFrame, grid: GridSpec, keys: list[str]) -> DataFrame:
    """keys, k0.., p for each field (keys, i0.., z, g), by one fast Fourier transform a field."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = arrays.periodogram(dense(pdf, grid, "z"), dense(pdf, grid, "g"))
        return pd.DataFrame({k: pdf[k].iloc[0] for k in keys} | _long(p, ["p"]))

    schema = _keys(field, keys) + "".join(f", k{a} int" for a in range(grid.ndim)) + ", p double"
    return field.groupBy(*keys).applyInPandas(run, schema)


def as_arrays(field: DataFrame, grid: GridSpec, keys: list[str]) -> DataFrame:
    """keys, z, g (arrays over the grid, row by row; absent cells 0) of fields (keys, i0.., z, g): one shuffle, arrays built in the JVM."""
    at = F.lit(0)
    for a, n in enumerate(grid.shape):
        at = at * n + F.col(f"i{a}")
    cells = field.groupBy(*keys).agg(F.collect_list(F.struct(at.alias("at"), F.col("z").cast("double").alias("z"), F.col("g").cast("double").alias("g"))).alias("cells"))
    return cells.select(*keys, F.transform("cells", lambda c: c["at"]).alias("at"), F.transform("cells", lambda c: c["z"]).alias("z"), F.transform("cells", lambda c: c["g"]).alias("g"))


def _dense_batch(batch: pa.RecordBatch, grid: GridSpec) -> tuple[np.ndarray, np.ndarray]:
    """(z, g) of all fields of a batch, (fields, *shape): z alone as whole arrays, nulls being missing cells; or with at and g, by cell."""
    n, cells = batch.num_rows, grid.n_points
    z, g = np.zeros((n, cells)), np.zeros((n, cells))
    values = batch.column("z")
    size = np.diff(np.asarray(values.offsets))
    flat = values.flatten()
    if "at" in batch.schema.names:
        row = np.repeat(np.arange(n), size)
        at = np.asarray(batch.column("at").flatten())
        z[row, at], g[row, at] = np.asarray(flat, float), np.asarray(batch.column("g").flatten(), float)
    else:
        if (size != cells).any():
            raise ValueError(f"vectors must have {cells} elements")
        there = flat.is_valid().to_numpy(zero_copy_only=False)
        z[:] = np.where(there, np.asarray(flat.fill_null(0).cast(pa.float64())), 0.0).reshape(n, cells)
        g[:] = there.reshape(n, cells)
    return z.reshape(n, *grid.shape), g.reshape(n, *grid.shape)


def _fit_one(f: arrays.Field, kernel, start: dict, method: str, max_iter: int, seed: int, mark: int):
    names, bounds = [p.name for p in kernel.free], kernel.bounds()
    x0 = np.array(kernel.vector(kernel.theta(**start)))
    value = lambda x: f.value(kernel, kernel.theta(x))
    both = lambda x: f.value_and_score(kernel, kernel.theta(x), names)
    if method in ("evolution", "annealing", "direct"):
        rng = np.random.default_rng([seed, mark])
        found, _ = {"evolution": arrays.differential_evolution, "annealing": arrays.dual_annealing, "direct": arrays.divide_rectangles}[method](value, bounds, rng)
        return min((arrays.minimise(both, x, bounds, max_iter) for x in (found, x0)), key=lambda r: r[1])
    if method == "nelder-mead":
        return arrays.nelder_mead(value, x0, bounds, max_iter * 4)
    if method == "least-squares":

        def residual(x):
            e = f.e(kernel, kernel.theta(x))
            de = f.de(kernel, kernel.theta(x), names)
            return (f.p / e - 1).ravel(), np.stack([(-f.p / e**2 * d).ravel() for d in de], 1)

        x, _, n, ok = arrays.gauss_newton(residual, x0, bounds, max_iter)
        return x, value(x), n, ok
    return arrays.minimise(both, x0, bounds, max_iter)


def estimator_covariance(f: arrays.Field, g: np.ndarray, kernel, theta: dict, seed: int = 0, n_sims: int = 400) -> np.ndarray:
    """H^-1 J H^-1 at theta for the free parameters: J exact on grids of up to EXACT / 4 cells, else from simulated scores."""
    names = [p.name for p in kernel.free]
    e, de = f.e(kernel, theta), f.de(kernel, theta, names)
    h = np.array([[np.mean(a * b / e**2) for b in de] for a in de])
    if e.size <= EXACT // 4:
        j = arrays.exact_score_covariance(np.broadcast_to(kernel.cov(f.lags, theta), f.cg.shape), g, [d / e**2 for d in de])
    else:
        lam, _ = arrays.embedding(kernel, theta, f.shape, f.delta)
        rng = [np.random.default_rng([seed, i]) for i in range(n_sims)]
        scores = [[np.mean((e - p) * d / e**2) for d in de] for p in (arrays.periodogram(arrays.simulate(lam, f.shape, r), g) for r in rng)]
        j = np.atleast_2d(np.cov(np.array(scores).T))
    return sandwich(h, j)


FIT = "theta map<string,double>, ll double, n_iter int, converged boolean"


def fit(field: DataFrame, grid: GridSpec, keys: list[str], kernel, start: dict | None = None, method: str = "lbfgs", max_iter: int = 100, seed: int = 0, covariance: bool = False, taper: np.ndarray | None = None) -> DataFrame:
    """keys, theta (map), ll, n_iter, converged, and covariance (map of "a|b", if asked for): parameters of each field (keys, i0.., z, g) by
    the spectral likelihood. taper: weights over the grid, times g.

    method: lbfgs (with gradients; small fields together), nelder-mead, least-squares (the relative residuals of the periodogram),
    evolution, annealing and direct (searches, seeded by the field's key; then lbfgs from what they find and from the start, and
    the better of both).
    """
    if grid.n_points <= ARRAYS:
        return fit_vectors(as_arrays(field, grid, keys), grid, keys, kernel, start, method, max_iter, seed, covariance, taper)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = dense(pdf, grid, "g") * (1.0 if taper is None else taper)
        f = arrays.Field(dense(pdf, grid, "z"), g, grid.delta)
        x, ll, n, ok = _fit_one(f, kernel, start or {}, method, max_iter, seed, _mark(pdf[keys[0]].iloc[0] if keys else 0))
        theta = {k: float(v) for k, v in kernel.theta(x).items()}
        more = {"covariance": [_named(estimator_covariance(f, g, kernel, theta, seed), kernel)]} if covariance else {}
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"theta": [theta], "ll": [ll], "n_iter": [n], "converged": [bool(ok)]} | more)

    schema = (_keys(field, keys) + ", " if keys else "") + FIT + (", covariance map<string,double>" if covariance else "")
    return field.groupBy(*keys).applyInPandas(run, schema)


def _mark(key: object) -> int:
    return int(pd.util.hash_array(np.array([str(key)], dtype=object))[0])


def _named(matrix: np.ndarray, kernel) -> dict[str, float]:
    names = [p.name for p in kernel.free]
    return {f"{a}|{b}": float(matrix[i, j]) for i, a in enumerate(names) for j, b in enumerate(names)}


def fit_vectors(rows: DataFrame, grid: GridSpec, keys: list[str], kernel, start: dict | None = None, method: str = "lbfgs", max_iter: int = 100, seed: int = 0, covariance: bool = False, taper: np.ndarray | None = None) -> DataFrame:
    """As fit, for fields that are arrays already: rows (keys, z: an array of all cells, nulls being missing ones; or at, z, g of
    as_arrays). No shuffle, and no Python call a field: fields of a batch take their steps together."""
    names = [p.name for p in kernel.free]
    columns = [*keys, *(c for c in ("at", "z", "g") if c in rows.columns)]
    together = method == "lbfgs" and kernel.vectorised
    each = max(1, BATCH_CELLS // grid.n_points)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, each):
                batch = whole.slice(at, each)
                z, g = _dense_batch(batch, grid)
                if taper is not None:
                    g = g * taper
                n = len(z)
                if together:
                    f = arrays.Fields(z, g, grid.delta)
                    x0 = np.tile(np.array(kernel.vector(kernel.theta(**(start or {})))), (n, 1))
                    x, ll, count, ok = arrays.minimise_many(lambda x, i, f=f: f.value_and_score(kernel, kernel.theta(list(x.T)), names, i), x0, kernel.bounds(), max_iter)
                else:
                    key = batch.column(keys[0]).to_pylist() if keys else [0] * n
                    found = [_fit_one(arrays.Field(z[i], g[i], grid.delta), kernel, start or {}, method, max_iter, seed, _mark(key[i])) for i in range(n)]
                    x, ll, count, ok = (np.array([r[c] for r in found]) for c in range(4))
                theta = [{k: float(v) for k, v in kernel.theta(r).items()} for r in x]
                kind = pa.map_(pa.string(), pa.float64())
                cols = [*(batch.column(k) for k in keys), pa.array([list(t.items()) for t in theta], kind), pa.array(ll.astype(float)), pa.array(count.astype(np.int32)), pa.array(ok.astype(bool))]
                if covariance:
                    cols.append(pa.array([list(_named(estimator_covariance(arrays.Field(z[i], g[i], grid.delta), g[i], kernel, theta[i], seed), kernel).items()) for i in range(n)], kind))
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "theta", "ll", "n_iter", "converged", *["covariance"] * covariance])

    schema = (_keys(rows, keys) + ", " if keys else "") + FIT + (", covariance map<string,double>" if covariance else "")
    return rows.select(*columns).mapInArrow(run, schema)


def fit_several(field: DataFrame, grid: GridSpec, keys: list[str], model, start: dict | None = None, max_iter: int = 100, variates: int = 2) -> DataFrame:
    """keys, theta (map), ll, n_iter, converged, score (the largest slope at the end, bounds aside): a model of several variates, as the
    bivariate one, for each field (keys, var, i0.., z, g). The variates may have masks of their own; parameters may be fixed, tied and
    bounded. One field is in a task at a time."""
    names = [p.name for p in model.free]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, g = (np.stack([dense(pdf[pdf["var"] == v], grid, c) for v in range(variates)], -1) for c in ("z", "g"))
        f = arrays.VectorField(z, g, grid.delta)
        both = lambda x: f.value_and_score(model, model.theta(x), names)
        x, ll, n, ok = arrays.minimise(both, np.array(model.vector(model.theta(**(start or {})))), model.bounds(), max_iter)
        slope = both(x)[1]
        inside = arrays.clamp(x - 1e-8 * np.sign(slope), model.bounds()) != x
        theta = {k: float(v) for k, v in model.theta(x).items()}
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"theta": [theta], "ll": [ll], "n_iter": [n], "converged": [bool(ok)], "score": [float(np.abs(slope[inside]).max(initial=0.0))]})

    schema = (_keys(field, keys) + ", " if keys else "") + FIT + ", score double"
    return field.groupBy(*keys).applyInPandas(run, schema)


def scan(field: DataFrame, grid: GridSpec, keys: list[str], kernel, theta: DataFrame) -> DataFrame:
    """keys, theta_id, ll: each field's value at each row of a theta table (theta_id and parameters), by fast transforms in tasks.

    Fields become arrays once; parameter rows are dealt by a hash to slices of about SLICE rows, and a task takes a field and a slice:
    the slices, not the rows, multiply the fields.
    """
    names = [p.name for p in kernel.params]
    count = theta.count()
    slices = max(1, -(-count // SLICE))
    table = theta.select("theta_id", *names, F.pmod(F.xxhash64("theta_id"), F.lit(slices)).cast("int").alias("_slice"))
    packed = table.groupBy("_slice").agg(F.collect_list(F.struct("theta_id", *(F.col(n).cast("double").alias(n) for n in names))).alias("_rows"))
    packed = F.broadcast(packed) if count <= 100_000 else packed
    spread = as_arrays(field, grid, keys).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    if slices > 1:
        spread = spread.repartition(*keys, "_slice")
    kind = theta.schema["theta_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                z, g = _dense_batch(batch.slice(i, 1), grid)
                rows = batch.column("_rows")[i].values
                t = {n: np.asarray(rows.field(n)) for n in names}
                f = arrays.Fields(z, g, grid.delta)
                out = []
                each = max(1, BATCH_CELLS // grid.n_points) if kernel.vectorised else 1
                for a in range(0, len(rows), each):
                    part = {n: v[a : a + each] if kernel.vectorised else float(v[a]) for n, v in t.items()}
                    e = f.e(kernel, part, np.zeros(min(each, len(rows) - a), np.int64))
                    axes = tuple(range(1, e.ndim))
                    ok = (e > 0).all(axes)
                    e = np.where(e > 0, e, 1.0)
                    out.append(np.where(ok, np.mean(np.log(e) + f.p / e, axes), math.inf))
                n = len(rows)
                yield pa.RecordBatch.from_arrays([*(pa.array(batch.column(k).slice(i, 1).to_pylist() * n, batch.schema.field(k).type) for k in keys), rows.field("theta_id"), pa.array(np.concatenate(out))], names=[*keys, "theta_id", "ll"])

    schema = (_keys(field, keys) + ", " if keys else "") + f"theta_id {kind}, ll double"
    return spread.join(packed, "_slice").select(*keys, "at", "z", "g", "_rows").mapInArrow(run, schema)


def values(field: DataFrame, grid: GridSpec, keys: list[str], kernel, theta: DataFrame) -> DataFrame:
    """keys, theta_id, ll: the likelihood values by the plan that strategy() names."""
    from meshwave.operators import likelihood, spectral

    plan = strategy(grid, 1 if not keys else 17, theta.count())
    if plan == "task":
        return scan(field, grid, keys, kernel, theta)
    if plan == "rows":
        return large_values(field, grid, keys, kernel, theta)
    e = spectral.expected_periodogram(spectral.spatial_kernel(field, grid, keys), grid, keys, kernel, theta)
    return likelihood.whittle(spectral.periodogram(field, grid, keys), e, grid, keys, [*keys, "theta_id"])


def large_values(field: DataFrame, grid: GridSpec, keys: list[str], kernel, theta: DataFrame) -> DataFrame:
    """keys, theta_id, ll of fields too large for a task: transforms of lines for the field, its spatial kernel and the expected
    periodogram; what is joined are frequencies and lags, dealt by their places. Parameter rows are broadcast (checked: at most 10,000)."""
    if theta.count() > 10_000:
        raise ValueError("parameter rows of large fields go in parts of at most 10,000")
    n = F.lit(float(grid.n_points))
    size = tuple(2 * k - 1 for k in grid.shape)
    padded = GridSpec(size, grid.delta)
    ks, ts = grid.axes("k"), grid.axes("t")
    j = large_dft(field, grid, F.col("z") * F.col("g"), keys=keys)
    per = j.select(*keys, *ks, ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / n).alias("p"))
    m = large_dft(field, padded, F.col("g"), keys=keys)
    power = m.select(*keys, *(F.col(f"k{a}").alias(f"i{a}") for a in range(grid.ndim)), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("w"))
    back = large_dft(power, padded, F.col("w"), keys=keys)
    lag = [F.when(F.col(f"k{a}") < k, F.col(f"k{a}")).otherwise(F.col(f"k{a}") - (2 * k - 1)).alias(f"t{a}") for a, k in enumerate(grid.shape)]
    cg = back.select(*keys, *lag, (F.col("re") / F.lit(float(padded.n_points)) / n).alias("cg"))
    t = {p.name: F.col(p.name) for p in kernel.params}
    cov = cg.crossJoin(F.broadcast(theta)).select(*keys, "theta_id", *(F.pmod(F.col(x), F.lit(k)).alias(f"i{a}") for a, (x, k) in enumerate(zip(ts, grid.shape, strict=True))), (kernel.cov([F.col(x) * F.lit(d) for x, d in zip(ts, grid.delta, strict=True)], t) * F.col("cg")).alias("c"))
    folded = cov.groupBy(*keys, "theta_id", *grid.axes("i")).agg(F.sum("c").alias("c"))
    e = large_dft(folded, grid, F.col("c"), keys=[*keys, "theta_id"]).select(*keys, "theta_id", *ks, F.col("re").alias("e"))
    return per.join(e, [*keys, *ks]).groupBy(*keys, "theta_id").agg((F.sum(F.log("e") + F.col("p") / F.col("e")) / n).alias("ll"))


def simulate(spark: SparkSession, grid: GridSpec, kernel, theta: dict, n_sims: int, seed: int, mask: np.ndarray | None = None) -> DataFrame:
    """sim_id, i0.., z, g: independent Gaussian fields; a field depends on (seed, sim_id) alone, however tasks are dealt. The embedding is
    computed in each task."""

    def run(batches):
        lam = None
        for pdf in batches:
            for sim in pdf["id"]:
                if lam is None:
                    lam, _ = arrays.embedding(kernel, theta, grid.shape, grid.delta)
                z = arrays.simulate(lam, grid.shape, np.random.default_rng([seed, int(sim)]))
                rows = pd.DataFrame({"sim_id": np.int64(sim)} | _long(z, ["z"], "i"))
                rows["g"] = 1.0 if mask is None else mask.ravel()
                rows["z"] *= rows["g"]
                yield rows

    return spark.range(n_sims).mapInPandas(run, "sim_id long, " + "".join(f"i{a} int, " for a in range(grid.ndim)) + "z double, g double")


def simulated_values(spark: SparkSession, grid: GridSpec, kernel, truth: dict, theta: dict, n_sims: int, seed: int) -> DataFrame:
    """sim_id, ll: one likelihood evaluation of each of n_sims fields, simulated and scored inside a task; only the values leave it."""

    def run(batches):
        lam = field = None
        for pdf in batches:
            out = []
            for sim in pdf["id"]:
                if lam is None:
                    lam, _ = arrays.embedding(kernel, truth, grid.shape, grid.delta)
                    field = arrays.Field(np.zeros(grid.shape), np.ones(grid.shape), grid.delta)
                    e = field.e(kernel, theta)
                p = arrays.periodogram(arrays.simulate(lam, grid.shape, np.random.default_rng([seed, int(sim)])))
                out.append((int(sim), float(np.mean(np.log(e) + p / e))))
            yield pd.DataFrame(out, columns=["sim_id", "ll"])

    return spark.range(n_sims).mapInPandas(run, "sim_id long, ll double")


def simulate_several(spark: SparkSession, grid: GridSpec, model, theta: dict, n_sims: int, seed: int, variates: int = 2, periodic: bool = False, spectral: bool = False) -> DataFrame:
    """sim_id, var, i0.., z, g: fields of a model of several variates. periodic: covariances wrap around the grid itself, so opposite
    edges fit. spectral: re and im of the transform at k0.. instead of z and g."""

    def run(batches):
        lags = arrays.torus_lags(grid.shape, grid.delta) if periodic else arrays.lag_grids(grid.shape, grid.delta)
        cov = model.cov(lags, theta)
        for pdf in batches:
            for sim in pdf["id"]:
                z = arrays.simulate_multivariate(cov, variates, grid.shape, np.random.default_rng([seed, int(sim)]))
                for v in range(variates):
                    head = {"sim_id": np.int64(sim), "var": np.int32(v)}
                    if spectral:
                        j = np.fft.fftn(z[..., v]) / math.sqrt(grid.n_points)
                        yield pd.DataFrame(head | _long(j.real, ["re"]) | {"im": j.imag.ravel()})
                    else:
                        yield pd.DataFrame(head | _long(z[..., v], ["z"], "i") | {"g": 1.0})

    axis, tail = ("k", "re double, im double") if spectral else ("i", "z double, g double")
    return spark.range(n_sims).mapInPandas(run, "sim_id long, var int, " + "".join(f"{axis}{a} int, " for a in range(grid.ndim)) + tail)


def simulate_bivariate(spark: SparkSession, grid: GridSpec, model, theta: dict, n_sims: int, seed: int, periodic: bool = False, spectral: bool = False) -> DataFrame:
    """As simulate_several, of two variates."""
    return simulate_several(spark, grid, model, theta, n_sims, seed, 2, periodic, spectral)


def simulate_separable(spark: SparkSession, grid: GridSpec, kernel, theta: dict, n_sims: int, seed: int, terms: int = 100) -> DataFrame:
    """sim_id, i0.., z, g: means of products of one-axis draws, times the root of their number."""

    def run(batches):
        roots = []
        for a, part in enumerate(kernel.parts):
            own = {k[len(f"m{a}_") :]: v for k, v in theta.items() if k.startswith(f"m{a}_")}
            roots.append(arrays.embedding(part, own, (grid.shape[a],), (grid.delta[a],))[0])
        for pdf in batches:
            for sim in pdf["id"]:
                rng = np.random.default_rng([seed, int(sim)])
                z = np.zeros(grid.shape)
                for _ in range(terms):
                    term = np.ones((1,) * grid.ndim)
                    for a, lam in enumerate(roots):
                        term = term * arrays.simulate(lam, (grid.shape[a],), rng).reshape([-1 if b == a else 1 for b in range(grid.ndim)])
                    z += term
                yield pd.DataFrame({"sim_id": np.int64(sim)} | _long(z / math.sqrt(terms), ["z"], "i") | {"g": 1.0})

    return spark.range(n_sims).mapInPandas(run, "sim_id long, " + "".join(f"i{a} int, " for a in range(grid.ndim)) + "z double, g double")


def large_dft(field: DataFrame, grid: GridSpec, value: Column, keys: list[str] = ()) -> DataFrame:
    """keys, k0.., re, im of fields too large for a task: a fast transform of each line of the last axis, a shuffle that turns lines, the next
    axis, and so on. Each task holds lines, whose length is one axis'."""
    keys = list(keys)
    now = field.select(*keys, *grid.axes("i"), value.alias("re"), F.lit(0.0).alias("im"))
    kinds = "".join(f"`{k}` {field.schema[k].dataType.simpleString()}, " for k in keys)

    def lines(a: int, line: list[str]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.zeros(grid.shape[a], complex)
            x[pdf[f"i{a}"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
            y = np.fft.fft(x)
            return pd.DataFrame({c: pdf[c].iloc[0] for c in line} | {f"k{a}": np.arange(len(y), dtype=np.int32), "re": y.real, "im": y.imag})

        return run

    for a in reversed(range(grid.ndim)):
        line = [f"i{b}" if b < a else f"k{b}" for b in range(grid.ndim) if b != a]
        now = now.groupBy(*keys, *line).applyInPandas(lines(a, [*keys, *line]), kinds + "".join(f"{c} int, " for c in line) + f"k{a} int, re double, im double")
    return now.select(*keys, *grid.axes("k"), "re", "im")


# ------------------------------------------------------------------ uncertainty


def offsets(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """m0.., all frequency offsets from -(n - 1) to n - 1."""
    from meshwave.operators.grid import one_row, span

    return span(one_row(spark), **{f"m{a}": (1 - n, n - 1) for a, n in enumerate(grid.shape)})


def exact_sums(spark: SparkSession, grid: GridSpec, g: np.ndarray, kernel, theta: dict, weights: dict[str, np.ndarray], relation: bool = False) -> DataFrame:
    """i, j, total: sum over pairs of frequencies of w_i(k) w_j(k') |covariance of the transform at (k, k')|^2, for all pairs of
    weights (arrays over the grid's frequencies). Offsets are tasks: one transform each gives every (i, j). relation: the unconjugated
    covariance, by k' = -k'."""
    names = list(weights)
    if grid.n_points > ONE_TASK >> 4:
        raise ValueError("weights and mask of so large a grid do not go to each task; take jmatrix_sample")
    handed = spark.sparkContext.broadcast((g, weights))  # some arrays of the grid, whose size is checked

    def flip(x: np.ndarray) -> np.ndarray:
        for axis in range(x.ndim):
            x = np.roll(np.flip(x, axis), 1, axis)
        return x

    def run(batches):
        mask, w = handed.value
        c = np.broadcast_to(kernel.cov(arrays.lag_grids(grid.shape, grid.delta), theta), [2 * n - 1 for n in grid.shape])
        for pdf in batches:
            totals = np.zeros((len(names), len(names)))
            for m in pdf.to_numpy():
                m = tuple(int(x) for x in m)
                k2 = np.abs(arrays.dft_diagonal(c, mask, m)) ** 2
                for i, a in enumerate(names):
                    for j, b in enumerate(names):
                        right = flip(w[b]) if relation else w[b]
                        totals[i, j] += np.sum(arrays.shifted(w[a], m)[0] * arrays.shifted(right, m)[1] * k2)
            yield pd.DataFrame([(a, b, totals[i, j]) for i, a in enumerate(names) for j, b in enumerate(names)], columns=["i", "j", "v"])

    parts = offsets(spark, grid)
    n = math.prod(2 * k - 1 for k in grid.shape)
    return parts.repartition(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 8 + 1))).mapInPandas(run, "i string, j string, v double").groupBy("i", "j").agg(F.sum("v").alias("total"))


def jmatrix(spark: SparkSession, grid: GridSpec, g: np.ndarray, kernel, theta: dict, names: list[str]) -> DataFrame:
    """i, j, value: covariance of the score, 2 / N^2 times the exact sums of de / e^2; on grids of over EXACT cells, whose sums cost the
    square of the cells, the sample covariance of simulated scores."""
    if grid.n_points > EXACT:
        return jmatrix_sample(spark, grid, g, kernel, theta, names)
    f = arrays.Field(np.zeros(grid.shape), g, grid.delta)
    e = f.e(kernel, theta)
    w = {n: d / e**2 for n, d in zip(names, f.de(kernel, theta, names), strict=True)}
    sums = exact_sums(spark, grid, g, kernel, theta, w)
    return sums.select("i", "j", (F.col("total") * F.lit(2.0 / grid.n_points**2)).alias("value"))


def jmatrix_sample(spark: SparkSession, grid: GridSpec, g: np.ndarray, kernel, theta: dict, names: list[str], n_sims: int = 1000, seed: int = 0) -> DataFrame:
    """i, j, value: sample covariance of simulated scores."""
    def run(batches):
        e = None
        for pdf in batches:
            rows = []
            for sim in pdf["id"]:
                if e is None:
                    lam, _ = arrays.embedding(kernel, theta, grid.shape, grid.delta)
                    f = arrays.Field(np.zeros(grid.shape), g, grid.delta)
                    e, de = f.e(kernel, theta), f.de(kernel, theta, names)
                p = arrays.periodogram(arrays.simulate(lam, grid.shape, np.random.default_rng([seed, int(sim)])), g)
                rows.append([np.mean((e - p) * d / e**2) for d in de])
            yield pd.DataFrame(rows, columns=[f"s_{n}" for n in names])

    scores = spark.range(n_sims).mapInPandas(run, ", ".join(f"s_{n} double" for n in names))
    wide = scores.agg(*(F.covar_samp(f"s_{a}", f"s_{b}").alias(f"{a}|{b}") for a in names for b in names))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"`{a}|{b}`").alias("value")) for a in names for b in names))).alias("r")).select("r.*")


def jmatrix_sample_bivariate(spark: SparkSession, grid: GridSpec, model, theta: dict, names: list[str], n_sims: int = 400, seed: int = 0) -> DataFrame:
    """i, j, value: sample covariance of simulated scores of a bivariate model on a full grid."""
    cg, lags = arrays.spatial_kernel(np.ones(grid.shape)), arrays.lag_grids(grid.shape, grid.delta)

    def spectrum(entries: dict) -> np.ndarray:
        out = np.empty((*grid.shape, 2, 2), complex)
        for (a, b), c in entries.items():
            out[..., a, b] = arrays.transform_lags(np.broadcast_to(c, cg.shape) * cg, grid.shape)
        return out

    inv = np.linalg.inv(spectrum(model.cov(lags, theta)))
    turned = [inv @ spectrum(model.grad(lags, theta, n)) for n in names]
    handed = spark.sparkContext.broadcast((inv, turned))

    def run(batches):
        inv_here, t_here = handed.value
        cov = model.cov(lags, theta)
        for pdf in batches:
            rows = []
            for sim in pdf["id"]:
                z = arrays.simulate_multivariate(cov, 2, grid.shape, np.random.default_rng([seed, int(sim)]))
                q = inv_here @ arrays.cross_periodogram(z)
                rows.append([float(np.mean(np.trace(t, axis1=-2, axis2=-1) - np.trace(t @ q, axis1=-2, axis2=-1)).real) for t in t_here])
            yield pd.DataFrame(rows, columns=[f"s_{n}" for n in names])

    scores = spark.range(n_sims).mapInPandas(run, ", ".join(f"s_{n} double" for n in names))
    wide = scores.agg(*(F.covar_samp(f"s_{a}", f"s_{b}").alias(f"{a}|{b}") for a in names for b in names))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"`{a}|{b}`").alias("value")) for a in names for b in names))).alias("r")).select("r.*")


def sandwich(h: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Covariance of the estimates: H^-1 J H^-1."""
    inv = np.linalg.inv(h)
    return inv @ j @ inv


# ------------------------------------------------------------------ tests and interpolation


def gof_statistic(u: np.ndarray, bins: int = 10, fixed: bool = False) -> float:
    """Chi-square of binned residuals u in [0, 1); bins behind the last occupied one count only if fixed."""
    count = np.bincount(np.minimum(np.floor(u.ravel() * bins).astype(int), bins - 1), minlength=bins if fixed else 0)
    want = u.size / len(count)
    return float(((count - want) ** 2 / want).sum())


def gof_pvalue(field: DataFrame, grid: GridSpec, keys: list[str], kernel, theta: dict, n_sims: int = 200, bins: int = 10, refit: bool = False, seed: int = 0) -> DataFrame:
    """keys, statistic, p_chi2, p_sim: the share of simulated fields (with the field's mask; refitted if asked) of at least its statistic."""
    lam, _ = arrays.embedding(kernel, theta, grid.shape, grid.delta)
    names = [p.name for p in kernel.free]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, g = dense(pdf, grid, "z"), dense(pdf, grid, "g")

        def statistic(values: np.ndarray) -> float:
            f = arrays.Field(values, g, grid.delta)
            t = theta
            if refit:
                x, *_ = arrays.minimise(lambda v: f.value_and_score(kernel, kernel.theta(v), names), np.array(kernel.vector(kernel.theta(**theta))), kernel.bounds(), 30)
                t = kernel.theta(x)
            return gof_statistic(1 - np.exp(-f.p / f.e(kernel, t)), bins)

        own = statistic(z)
        sims = [statistic(arrays.simulate(lam, grid.shape, np.random.default_rng([seed, s])) * g) for s in range(n_sims)]
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"statistic": [own], "p_chi2": [arrays.chi2_tail(own, bins - 1)], "p_sim": [float(np.mean(np.array(sims) >= own))]})

    return field.groupBy(*keys).applyInPandas(run, _keys(field, keys) + ", statistic double, p_chi2 double, p_sim double")


def generalized_chi2(spark: SparkSession, weights: list[float], observed: float, n: int = 1000, seed: int = 0) -> DataFrame:
    """p_value, q95: of sums of weighted squares of normals."""
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        r = F.randn(seed * 1000 + i)
        total = total + F.lit(float(w)) * r * r
    draws = spark.range(n, numPartitions=16).select(total.alias("x"))  # draws depend on the number of partitions, which is the same for all n
    return draws.agg(F.avg((F.col("x") >= F.lit(float(observed))).cast("double")).alias("p_value"), F.percentile("x", 0.95).alias("q95"))


def likelihood_ratio(field: DataFrame, grid: GridSpec, keys: list[str], kernel, null: dict, max_iter: int = 60, n_draws: int = 1000, seed: int = 0) -> DataFrame:
    """keys, lkh_ratio, max_eig, p_value, test_result (true: not rejected at 5 %): the full model against one with the parameters of `null` fixed.

    The ratio is the gain in the summed value, N times the mean's; its law is a weighted sum of squares with the eigenvalues of
    W = N / 2 J (H^-1 - padded inverse of the null's H); J is exact on the grid.
    """
    names = [p.name for p in kernel.free]
    small = kernel
    for k, v in null.items():
        small = small.fix(k, v)
    kept = [n for n in names if n not in null]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, g = dense(pdf, grid, "z"), dense(pdf, grid, "g")
        f = arrays.Field(z, g, grid.delta)
        out = []
        for k in (kernel, small):
            own = [p.name for p in k.free]
            x, ll, *_ = arrays.minimise(lambda v, k=k, own=own: f.value_and_score(k, k.theta(v), own), np.array(k.vector(k.theta())), k.bounds(), max_iter)
            out.append((k.theta(x), ll))
        (theta, ll), (_, ll0) = out
        e, de = f.e(kernel, theta), f.de(kernel, theta, names)
        h = np.array([[np.mean(a * b / e**2) for b in de] for a in de])
        j = arrays.exact_score_covariance(np.broadcast_to(kernel.cov(f.lags, theta), f.cg.shape), g, [d / e**2 for d in de])
        pad = np.zeros_like(h)
        at = [names.index(n) for n in kept]
        if at:
            pad[np.ix_(at, at)] = np.linalg.inv(h[np.ix_(at, at)])
        eig = np.linalg.eigvals(z.size / 2 * j @ (np.linalg.inv(h) - pad)).real
        ratio = z.size * (ll0 - ll)
        draws = (np.random.default_rng([seed, 7]).standard_normal((n_draws, len(eig))) ** 2) @ np.maximum(eig, 0)
        p = float(np.mean(draws >= ratio))
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"lkh_ratio": [ratio], "max_eig": [float(eig.max())], "p_value": [p], "test_result": [p > 0.05]})

    return field.groupBy(*keys).applyInPandas(run, _keys(field, keys) + ", lkh_ratio double, max_eig double, p_value double, test_result boolean")


def krige(points: DataFrame, targets: DataFrame, keys: list[str], ndim: int, kernel, theta: dict, neighbours: int | None = None, most: int = 4000) -> DataFrame:
    """keys, pt_id, mean, variance at targets (keys, pt_id, x0..) from points (keys, x0.., y).

    A key's points fit a task. All of them enter one solve, of at most `most` points (more raise); with `neighbours`, each target has the
    nearest so many, by squares of space: a target's cost then does not grow with the points.
    """
    xs = [f"x{d}" for d in range(ndim)]
    diff = lambda p, q: [p[:, None, d] - q[None, :, d] for d in range(ndim)]

    def solved(a: np.ndarray, y: np.ndarray, b: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
        if not len(a):
            return np.zeros(len(b)), np.full(len(b), prior)
        cross = kernel.cov(diff(b, a), theta)
        w = np.linalg.solve(kernel.cov(diff(a, a), theta), cross.T)
        return w.T @ y, prior - np.sum(cross.T * w, 0)

    def run(obs: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if not len(new):
            return pd.DataFrame(columns=[*keys, "pt_id", "mean", "variance"])
        a, b, y = obs[xs].to_numpy(float), new[xs].to_numpy(float), obs["y"].to_numpy(float)
        prior = float(np.broadcast_to(kernel.cov([np.zeros(1)] * ndim, theta), 1)[0])
        if neighbours is None:
            if len(a) > most:
                raise ValueError(f"{len(a)} points in one system; give a number of neighbours")
            mean, var = solved(a, y, b, prior)
        else:
            mean, var = np.zeros(len(b)), np.zeros(len(b))
            for i in range(len(b)):
                far = ((a - b[i]) ** 2).sum(1)
                near = np.sort(np.argpartition(far, neighbours - 1)[:neighbours]) if len(a) > neighbours else np.arange(len(a))
                mean[i : i + 1], var[i : i + 1] = solved(a[near], y[near], b[i : i + 1], prior)
        return pd.DataFrame({k: new[k].to_numpy() for k in keys} | {"pt_id": new["pt_id"].to_numpy(), "mean": mean, "variance": np.maximum(var, 0)})

    # renamed columns: both sides may come from one table
    points, targets = (t.select(*(F.col(c).alias(c) for c in t.columns)).toDF(*t.columns) for t in (points, targets))
    return points.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInPandas(run, _keys(targets, keys) + ", pt_id long, mean double, variance double")
