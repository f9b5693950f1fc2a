"""Spectral operators as DataFrame plans: discrete Fourier transforms axis by axis, spatial kernels, periodograms and their expectations.

Fields are tables (keys, i0.., z, g); absent cells have g = 0. Sums over an axis are group-bys with map-side combining, so a transform
costs N times the sum of the axes' lengths and moves one partial sum for each key, line and frequency.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwave.operators.grid import GridSpec, lags

TAU = 2 * math.pi


def phase(k: Column, t: Column, n: int) -> Column:
    """2 pi k t / n, the product reduced by whole turns first."""
    return F.lit(TAU / n) * F.pmod(k * t, F.lit(n))


def dft(table: DataFrame, keys: list[str], sizes: dict[str, tuple[str, int, int]], re: Column, im: Column | None = None) -> DataFrame:
    """Sum of (re + i im) exp(-2 pi i k t / n) over axes: sizes maps an index column t to (frequency column k, n, number of frequencies).

    One axis after the other, the last first; result: keys, the frequency columns, re, im.
    """
    rest = list(sizes)
    now = table.withColumn("_re", re).withColumn("_im", im if im is not None else F.lit(0.0))
    done: list[str] = []
    real = im is None
    while rest:
        t = rest.pop()
        k, n, count = sizes[t]
        now = now.withColumn(k, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        a = phase(F.col(k), F.col(t), n)
        c, s = F.cos(a), F.sin(a)
        if real:
            sums = (F.sum(F.col("_re") * c), F.sum(-F.col("_re") * s))
        else:
            sums = (F.sum(F.col("_re") * c + F.col("_im") * s), F.sum(F.col("_im") * c - F.col("_re") * s))
        real = False
        done.append(k)
        now = now.groupBy(*keys, *rest, *done).agg(sums[0].alias("_re"), sums[1].alias("_im"))
    order = [k for k, _, _ in sizes.values()]
    return now.select(*keys, *order, F.col("_re").alias("re"), F.col("_im").alias("im"))


def field_dft(field: DataFrame, grid: GridSpec, keys: list[str], taper: Column | None = None, double: bool = False) -> DataFrame:
    """Transform of g * taper * z, without a norm. double: at twice the frequencies, as of a field padded with zeros."""
    f = 2 if double else 1
    w = F.col("z") * F.col("g")
    return dft(field, keys, {f"i{a}": (f"k{a}", f * n, f * n) for a, n in enumerate(grid.shape)}, w if taper is None else w * taper)


def periodogram(field: DataFrame, grid: GridSpec, keys: list[str], taper: Column | None = None, double: bool = False, normalise: str = "cells") -> DataFrame:
    """keys, k0.., p: squared modulus of the transform over the number of cells, or over the sum of squared g ('observed')."""
    out = field_dft(field, grid, keys, taper, double)
    square = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    ks = grid.axes("k")
    if normalise == "cells":
        return out.select(*keys, *ks, (square / F.lit(float(grid.n_points))).alias("p"))
    g = F.col("g") if taper is None else F.col("g") * taper
    total = field.groupBy(*keys).agg(F.sum(g * g).alias("_n"))
    return out.join(F.broadcast(total), keys).select(*keys, *ks, (square / F.col("_n")).alias("p"))


def cross_periodogram(field: DataFrame, grid: GridSpec, keys: list[str], taper: Column | None = None) -> DataFrame:
    """For fields with a variate column `var`: keys, k0.., a, b, re, im of J_a conj(J_b) / N."""
    j = field_dft(field, grid, [*keys, "var"], taper)
    ks = [*keys, *grid.axes("k")]
    a = j.select(*ks, F.col("var").alias("a"), F.col("re").alias("_ra"), F.col("im").alias("_ia"))
    b = j.select(*ks, F.col("var").alias("b"), F.col("re").alias("_rb"), F.col("im").alias("_ib"))
    n = F.lit(float(grid.n_points))
    return a.join(b, ks).select(*ks, "a", "b", ((F.col("_ra") * F.col("_rb") + F.col("_ia") * F.col("_ib")) / n).alias("re"), ((F.col("_ia") * F.col("_rb") - F.col("_ra") * F.col("_ib")) / n).alias("im"))


#: Results kept by what they compute: the plan's hash, and the plans that share it.
_KEPT: dict[int, list[DataFrame]] = {}


def kept(df: DataFrame) -> DataFrame:
    """df, persisted on executors; a frame that computes the same from the same tables is found again and not computed twice."""
    for other in _KEPT.setdefault(df.semanticHash(), []):
        if other.sparkSession is df.sparkSession and other.sameSemantics(df):
            return other
    _KEPT[df.semanticHash()].append(df)
    return df.persist()


def forget() -> None:
    """Unpersist all that kept() holds."""
    for group in _KEPT.values():
        for df in group:
            df.unpersist()
    _KEPT.clear()


# ------------------------------------------------------------------ spatial kernels

#: Cells from which spatial kernels of two or more axes come from transforms, not from pairs of cells.
PAIRS = 1024


def spatial_kernel(mask: DataFrame, grid: GridSpec, keys: list[str], taper: Column | None = None, variates: bool = False) -> DataFrame:
    """keys, t0.., cg: sum of g(s) g(s + t) over N. variates: also a and b, the variates at s + t and at s (column `var`).

    Small grids: pairs of cells meet through the lines of the last axis; lags without a pair have no row. Grids of over PAIRS cells and
    two or more axes: the squared transform at 2 n - 1 frequencies, transformed back; all lags have a row, and the cost is cells times the
    sum of the axes' lengths.
    """
    if grid.n_points > PAIRS and grid.ndim > 1 and not variates:
        return _kernel_by_transforms(mask, grid, keys, taper)
    g = F.col("g") if taper is None else F.col("g") * taper
    last = grid.ndim - 1
    heads = [f"i{a}" for a in range(last)]
    by = [*keys, *heads] + (["var"] if variates else [])
    lines = mask.groupBy(*by).agg(F.collect_list(F.struct(F.col(f"i{last}").alias("i"), g.alias("g"))).alias("line")) if by else mask.agg(F.collect_list(F.struct(F.col(f"i{last}").alias("i"), g.alias("g"))).alias("line"))
    ends = lambda tag: [F.col(h).alias(f"_{tag}{h}") for h in heads] + ([F.col("var").alias(tag)] if variates else [])
    a, b = lines.select(*keys, *ends("a"), F.col("line").alias("_la")), lines.select(*keys, *ends("b"), F.col("line").alias("_lb"))
    both = a.join(b, keys) if keys else a.crossJoin(b)
    shifts = [(F.col(f"_ai{d}") - F.col(f"_bi{d}")).alias(f"t{d}") for d in range(last)]
    extra = ["a", "b"] if variates else []
    pairs = both.select(*keys, *shifts, *extra, F.explode("_la").alias("_x"), "_lb").select(*keys, *(f"t{d}" for d in range(last)), *extra, "_x", F.explode("_lb").alias("_y"))
    rows = pairs.withColumn(f"t{last}", F.col("_x.i") - F.col("_y.i")).withColumn("_p", F.col("_x.g") * F.col("_y.g"))
    return rows.groupBy(*keys, *grid.axes("t"), *extra).agg((F.sum("_p") / F.lit(float(grid.n_points))).alias("cg"))


def _kernel_by_transforms(mask: DataFrame, grid: GridSpec, keys: list[str], taper: Column | None = None) -> DataFrame:
    size = [2 * n - 1 for n in grid.shape]
    g = F.col("g") if taper is None else F.col("g") * taper
    j = dft(mask, keys, {f"i{a}": (f"k{a}", m, m) for a, m in enumerate(size)}, g)
    power = j.select(*keys, *grid.axes("k"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("w"))
    back = dft(power, keys, {f"k{a}": (f"_t{a}", m, m) for a, m in enumerate(size)}, F.col("w"))
    lag = [F.when(F.col(f"_t{a}") < n, F.col(f"_t{a}")).otherwise(F.col(f"_t{a}") - (2 * n - 1)).alias(f"t{a}") for a, n in enumerate(grid.shape)]
    return back.select(*keys, *lag, (F.col("re") / F.lit(float(math.prod(size) * grid.n_points))).alias("cg"))


def full_kernel(table: DataFrame, grid: GridSpec) -> DataFrame:
    """Lags with cg of the full grid in closed form: product of 1 - |t| / n."""
    out = F.lit(1.0)
    for a, n in enumerate(grid.shape):
        out = out * (1.0 - F.abs(F.col(f"t{a}")) / F.lit(float(n)))
    return table.withColumn("cg", out)


def offset_kernel(mask: DataFrame, grid: GridSpec, keys: list[str], offset: tuple[int, ...], taper: Column | None = None) -> DataFrame:
    """keys, t0.., re, im: sum of g(s) g(s + t) exp(-2 pi i m s / n) over N."""
    g = F.col("g") if taper is None else F.col("g") * taper
    turn = F.lit(0.0)
    for a, (n, m) in enumerate(zip(grid.shape, offset, strict=True)):
        turn = turn + F.lit(TAU / n) * F.pmod(F.lit(m) * F.col(f"i{a}"), F.lit(n))
    own = mask.select(*keys, *grid.axes("i"), g.alias("g"), F.cos(turn).alias("c"), F.sin(turn).alias("s"))
    there = own.select(*keys, *(F.col(f"i{a}").alias(f"_j{a}") for a in range(grid.ndim)), F.col("g").alias("_g"))
    both = own.join(there, keys) if keys else own.crossJoin(there)
    both = both.withColumns({f"t{a}": F.col(f"_j{a}") - F.col(f"i{a}") for a in range(grid.ndim)})
    w, n = F.col("g") * F.col("_g"), F.lit(float(grid.n_points))
    return both.groupBy(*keys, *grid.axes("t")).agg((F.sum(w * F.col("c")) / n).alias("re"), (F.sum(-w * F.col("s")) / n).alias("im"))


def fold(table: DataFrame, grid: GridSpec, keys: list[str], value: str) -> DataFrame:
    """Sum a lag table over lags equal modulo the shape: keys, t0.. in 0..n-1, value. Any number of axes."""
    at = {f"t{a}": F.pmod(F.col(f"t{a}"), F.lit(n)) for a, n in enumerate(grid.shape)}
    return table.withColumns(at).groupBy(*keys, *grid.axes("t")).agg(F.sum(value).alias(value))


# ------------------------------------------------------------------ covariances on lags and points


def lag_columns(grid: GridSpec) -> list[Column]:
    return [F.col(f"t{a}") * F.lit(d) for a, d in enumerate(grid.delta)]


def theta_columns(kernel, given: dict | None = None) -> dict:
    """Parameter mapping for a kernel: columns of a theta table by name, or the given numbers."""
    return {p.name: (F.lit(float(given[p.name])) if given is not None else F.col(p.name)) for p in kernel.params}


def autocovariance(table: DataFrame, grid: GridSpec, kernel, theta: dict | None = None, grads: list[str] = ()) -> DataFrame:
    """table (t0..) with c and, for each name of grads, c_<name>; theta: numbers, or None for columns of the table."""
    t = theta_columns(kernel, theta)
    h = lag_columns(grid)
    return table.withColumn("c", kernel.cov(h, t)).withColumns({f"c_{g}": kernel.grad(h, t, g) for g in grads}) if grads else table.withColumn("c", kernel.cov(h, t))


def covariance_matrix(cells: DataFrame, grid: GridSpec, kernel, theta: dict) -> DataFrame:
    """a_id, b_id, c: covariances of all pairs of cells (pt_id, i0.., g), times both masks."""
    side = lambda tag: cells.select(F.col("pt_id").alias(f"{tag}_id"), *(F.col(f"i{d}").alias(f"_{tag}{d}") for d in range(grid.ndim)), F.col("g").alias(f"_g{tag}"))
    both = side("a").crossJoin(side("b"))
    h = [(F.col(f"_a{d}") - F.col(f"_b{d}")) * F.lit(s) for d, s in enumerate(grid.delta)]
    return both.select("a_id", "b_id", (kernel.cov(h, theta_columns(kernel, theta)) * F.col("_ga") * F.col("_gb")).alias("c"))


# ------------------------------------------------------------------ expected periodograms


def expected(cov: DataFrame, grid: GridSpec, keys: list[str], values: list[str], double: bool = False, complex_: bool = False) -> DataFrame:
    """keys, k0.., and for each name in values the real part of sum_t value(t) exp(-2 pi i k t / n) (and <name>_im, if complex_).

    cov: keys, t0.., the values: c_g(t) times a covariance or its derivative. Lags are folded first, so each axis sums n terms.
    double: twice the frequencies in each axis.
    """
    f = 2 if double else 1
    wide = GridSpec(tuple(f * n for n in grid.shape), grid.delta)
    at = {f"t{a}": F.pmod(F.col(f"t{a}"), F.lit(n)) for a, n in enumerate(wide.shape)}
    stacked = cov.select(*keys, *(c.alias(n) for n, c in at.items()), F.explode(F.array(*(F.struct(F.lit(v).alias("_v"), F.col(v).alias("_c")) for v in values))).alias("_s")).select(*keys, *at, "_s.*")
    folded = stacked.groupBy(*keys, "_v", *at).agg(F.sum("_c").alias("_c"))
    out = dft(folded, [*keys, "_v"], {f"t{a}": (f"k{a}", n, n) for a, n in enumerate(wide.shape)}, F.col("_c"))
    pick = lambda v, c: F.sum(F.when(F.col("_v") == v, F.col(c)))
    return out.groupBy(*keys, *grid.axes("k")).agg(*(pick(v, "re").alias(v) for v in values), *((pick(v, "im").alias(f"{v}_im") for v in values) if complex_ else ()))


def expected_periodogram(kernel_table: DataFrame, grid: GridSpec, keys: list[str], kernel, theta: DataFrame | dict, grads: list[str] = (), double: bool = False) -> DataFrame:
    """keys (and theta_id for a theta table), k0.., e and de_<name>: the model's expected periodogram under kernel_table (keys, t0.., cg).

    A theta table (theta_id and parameter columns) is the vectorised model: rows are independent, and only parameter values differ in
    the plan's data, so one plan serves all.
    """
    if isinstance(theta, dict):
        cov = autocovariance(kernel_table, grid, kernel, theta, list(grads))
    else:
        cov = autocovariance(kernel_table.crossJoin(F.broadcast(theta)), grid, kernel, None, list(grads))
        keys = [*keys, "theta_id"]
    names = {"e": "c"} | {f"de_{g}": f"c_{g}" for g in grads}
    cov = cov.select(*keys, *grid.axes("t"), *((F.col(c) * F.col("cg")).alias(n) for n, c in names.items()))
    return expected(cov, grid, keys, list(names), double)


def expected_bivariate(kernel_table: DataFrame, grid: GridSpec, keys: list[str], model, theta: DataFrame | dict, grads: list[str] = ()) -> DataFrame:
    """keys, k0.., a, b, e, e_im (and de_<name>, de_<name>_im): p = 2; kernel_table has a and b."""
    h = lag_columns(grid)
    if isinstance(theta, dict):
        t, table = theta_columns(model, theta), kernel_table
    else:
        t, table, keys = theta_columns(model), kernel_table.crossJoin(F.broadcast(theta)), [*keys, "theta_id"]

    def pick(entries: dict) -> Column:
        out = F.lit(None).cast("double")
        for (a, b), c in entries.items():
            out = F.when((F.col("a") == a) & (F.col("b") == b), c).otherwise(out)
        return out * F.col("cg")

    names = {"e": pick(model.cov(h, t))} | {f"de_{g}": pick(model.grad(h, t, g)) for g in grads}
    cov = table.select(*keys, "a", "b", *grid.axes("t"), *(c.alias(n) for n, c in names.items()))
    return expected(cov, grid, [*keys, "a", "b"], list(names), complex_=True)


def expected_separable(spark, grid: GridSpec, kernel, theta: dict, grads: list[str] = ()) -> DataFrame:
    """Full grid and a product kernel: the product of one-axis expected periodograms (and its gradient by the product rule)."""
    out = None
    for a, part in enumerate(kernel.parts):
        line = GridSpec((grid.shape[a],), (grid.delta[a],))
        own = {k[len(f"m{a}_") :]: v for k, v in theta.items() if k.startswith(f"m{a}_")}
        mine = [g for g in grads if g.startswith(f"m{a}_")]
        table = full_kernel(lags(spark, line), line)
        e = expected_periodogram(table, line, [], part, own, [g[len(f"m{a}_") :] for g in mine])
        e = e.select(F.col("k0").alias(f"k{a}"), F.col("e").alias(f"_e{a}"), *(F.col(f"de_{g[len(f'm{a}_') :]}").alias(f"_d_{g}") for g in mine))
        out = e if out is None else out.crossJoin(e)
    product = F.lit(1.0)
    for a in range(grid.ndim):
        product = product * F.col(f"_e{a}")

    def slope(g: str) -> Column:
        own = int(g.partition("_")[0][1:])
        value = F.col(f"_d_{g}")
        for a in range(grid.ndim):
            if a != own:
                value = value * F.col(f"_e{a}")
        return value

    return out.select(*grid.axes("k"), product.alias("e"), *(slope(g).alias(f"de_{g}") for g in grads))


# ------------------------------------------------------------------ covariances of the transform


def dft_covariance(cells: DataFrame, grid: GridSpec, kernel, theta: dict, relation: bool = False) -> DataFrame:
    """k0.., l0.., re, im: E[J(k) conj J(l)] over the number of cells, or without the conjugate (relation), for all pairs of frequencies of a
    masked grid (cells: i0.., g): the covariance matrix of the cells, transformed on either side. The result has cells squared rows."""
    at = F.lit(0).cast("long")
    for a, n in enumerate(grid.shape):
        at = at * n + F.col(f"i{a}")
    m = covariance_matrix(cells.withColumn("pt_id", at), grid, kernel, theta)

    def axes(c: str, name: str) -> list[Column]:
        out, rest = [], F.col(c)
        for a in reversed(range(grid.ndim)):
            n = grid.shape[a]
            out.append(F.pmod(rest, F.lit(n)).cast("int").alias(f"{name}{a}"))
            rest = F.floor(rest / n)
        return out[::-1]

    m = m.select(*axes("a_id", "i"), *axes("b_id", "j"), "c")
    one = dft(m, grid.axes("j"), {f"i{a}": (f"k{a}", n, n) for a, n in enumerate(grid.shape)}, F.col("c"))
    # the conjugate side: conj(dft(conj))
    sign, n = 1.0 if relation else -1.0, F.lit(float(grid.n_points))
    two = dft(one.withColumn("im", F.lit(sign) * F.col("im")), grid.axes("k"), {f"j{a}": (f"l{a}", n, n) for a, n in enumerate(grid.shape)}, F.col("re"), F.col("im"))
    return two.select(*grid.axes("k"), *grid.axes("l"), (F.col("re") / n).alias("re"), (F.lit(sign) * F.col("im") / n).alias("im"))


def dft_diagonal(mask: DataFrame, grid: GridSpec, kernel, theta: dict, offset: tuple[int, ...], relation: bool = False) -> DataFrame:
    """k0.., re, im: the transform's covariance at pairs (k, k - m), or its relation at pairs k + k' = m, from the offset kernel."""
    cov = autocovariance(offset_kernel(mask, grid, [], offset), grid, kernel, theta)
    at = {f"t{a}": F.pmod(F.col(f"t{a}"), F.lit(n)) for a, n in enumerate(grid.shape)}
    cov = cov.select(*grid.axes("t"), (F.col("re") * F.col("c")).alias("re"), (F.col("im") * F.col("c")).alias("im")).withColumns(at)
    cov = cov.groupBy(*grid.axes("t")).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    out = dft(cov, [], {f"t{a}": (f"k{a}", n, n) for a, n in enumerate(grid.shape)}, F.col("re"), F.col("im"))
    for a, (m, n) in enumerate(zip(offset, grid.shape, strict=True)):
        k = F.col(f"k{a}")
        lo, hi = (max(m - n + 1, 0), min(m, n - 1)) if relation else (max(0, m), min(n, n + m) - 1)
        out = out.where((k >= lo) & (k <= hi))
    return out


def correlation_squares(dft_cov: DataFrame, grid: GridSpec) -> DataFrame:
    """k0.., l0.., k2: squared modulus of dft_covariance over the product of the variances."""
    ks, ls = grid.axes("k"), grid.axes("l")
    same = F.lit(True)
    for k, x in zip(ks, ls, strict=True):
        same = same & (F.col(k) == F.col(x))
    own = dft_cov.where(same)
    both = dft_cov.join(own.select(*ks, F.col("re").alias("_v")), ks).join(own.select(*(F.col(k).alias(x) for k, x in zip(ks, ls, strict=True)), F.col("re").alias("_u")), ls)
    return both.select(*ks, *ls, ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("_v") * F.col("_u"))).alias("k2"))
