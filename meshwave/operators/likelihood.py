"""The bias-corrected spectral likelihood on tables of periodograms (p) and expected periodograms (e, de_<name>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwave.operators.grid import GridSpec


def whittle_term(p: Column | None = None, e: Column | None = None) -> Column:
    p, e = (F.col("p"), F.col("e")) if e is None else (p, e)
    return F.log(e) + p / e


def whittle(per: DataFrame, ep: DataFrame, grid: GridSpec, keys: list[str], by: list[str], mask: Column | None = None, strict: bool = False) -> DataFrame:
    """by, ll: the mean over frequencies of log e + p / e. mask: a column of weights over k0..; the sum is still over N, unless strict:
    then over the frequencies kept, which are filtered before the join."""
    ks = grid.axes("k")
    if mask is not None and strict:
        per, mask = per.where(mask > 0), None
        return per.join(ep, [*keys, *ks]).groupBy(*by).agg(F.avg(whittle_term()).alias("ll"))
    term = whittle_term() if mask is None else whittle_term() * mask
    return per.join(ep, [*keys, *ks]).groupBy(*by).agg((F.sum(term) / F.lit(float(grid.n_points))).alias("ll"))


def score(per: DataFrame, ep: DataFrame, grid: GridSpec, keys: list[str], by: list[str], names: list[str], mask: Column | None = None) -> DataFrame:
    """by, ll and s_<name>: value and gradient in one aggregation; a mask weighs both."""
    n = F.lit(float(grid.n_points))
    w = F.lit(1.0) if mask is None else mask
    slopes = [(F.sum(w * (F.col("e") - F.col("p")) * F.col(f"de_{g}") / (F.col("e") * F.col("e"))) / n).alias(f"s_{g}") for g in names]
    return per.join(ep, [*keys, *grid.axes("k")]).groupBy(*by).agg((F.sum(w * whittle_term()) / n).alias("ll"), *slopes)


def expected_value(truth: DataFrame, ep: DataFrame, grid: GridSpec, keys: list[str], by: list[str], mean: bool = False) -> DataFrame:
    """by, ll: the sum (or mean) over frequencies of log e + e_true / e; truth has e_true."""
    term = whittle_term(F.col("e_true"), F.col("e"))
    return truth.join(ep, [*keys, *grid.axes("k")]).groupBy(*by).agg((F.avg(term) if mean else F.sum(term)).alias("ll"))


def fisher(ep: DataFrame, grid: GridSpec, by: list[str], names: list[str]) -> DataFrame:
    """by, i, j, h: (1/N) sum of de_i de_j / e^2, the upper triangle from one aggregation and its mirror."""
    n = F.lit(float(grid.n_points))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    wide = ep.groupBy(*by).agg(*((F.sum(F.col(f"de_{a}") * F.col(f"de_{b}") / (F.col("e") * F.col("e"))) / n).alias(f"{a}|{b}") for a, b in pairs))
    name_of = {frozenset(p): f"`{p[0]}|{p[1]}`" for p in pairs}
    entries = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(name_of[frozenset((a, b))]).alias("h")) for a in names for b in names]
    return wide.select(*by, F.explode(F.array(*entries)).alias("_h")).select(*by, "_h.*")


def least_squares(per: DataFrame, ep: DataFrame, grid: GridSpec, keys: list[str], by: list[str]) -> DataFrame:
    """by, loss: the sum of (p / e - 1)^2."""
    r = F.col("p") / F.col("e") - 1.0
    return per.join(ep, [*keys, *grid.axes("k")]).groupBy(*by).agg(F.sum(r * r).alias("loss"))


def amplitude(per: DataFrame, ep: DataFrame, grid: GridSpec, keys: list[str], by: list[str]) -> DataFrame:
    """by, sigma: the amplitude in closed form, from e at amplitude 1."""
    return per.join(ep, [*keys, *grid.axes("k")]).groupBy(*by).agg(F.sqrt(F.avg(F.col("p") / F.col("e"))).alias("sigma"))


def residuals(per: DataFrame, ep: DataFrame, grid: GridSpec, keys: list[str]) -> DataFrame:
    """keys, k0.., u: 1 - exp(-p / e), uniform under the model."""
    return per.join(ep, [*keys, *grid.axes("k")]).select(*keys, *grid.axes("k"), (1.0 - F.exp(-F.col("p") / F.col("e"))).alias("u"))


def chi_square(u: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """by, bins, statistic: chi-square of binned residuals; bins behind the last occupied one do not count."""
    n = u.groupBy(*by, F.least(F.floor(F.col("u") * float(bins)).cast("int"), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    t = n.groupBy(*by).agg((F.max("bin") + 1).alias("bins"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum("n").alias("total"))
    return t.select(*by, F.col("bins").cast("int").alias("bins"), (F.col("sq") * F.col("bins") / F.col("total") - F.col("total")).alias("statistic"))


# ------------------------------------------------------------------ two variates


def _wide(table: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """One row for each frequency: <value>_<ab> for the four entries."""
    cols = []
    for v in values:
        for a in (0, 1):
            for b in (0, 1):
                cols.append(F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col(v))).alias(f"{v}_{a}{b}"))
    return table.groupBy(*on).agg(*cols)


def _c(m: str, a: int, b: int, part: str) -> Column:
    return F.col(f"{m}{part}_{a}{b}")


def _times(x: dict, y: dict) -> dict:
    """Product of two 2 x 2 complex matrices of columns."""
    out = {}
    for i in (0, 1):
        for j in (0, 1):
            re = im = F.lit(0.0)
            for k in (0, 1):
                (a, b), (c, d) = x[i, k], y[k, j]
                re, im = re + a * c - b * d, im + a * d + b * c
            out[i, j] = (re, im)
    return out


def _entries(name: str, im: str = "_im") -> dict:
    return {(a, b): (F.col(f"{name}_{a}{b}"), F.col(f"{name}{im}_{a}{b}")) for a in (0, 1) for b in (0, 1)}


def _inverse(e: dict) -> tuple[dict, Column]:
    """Inverse and determinant of a Hermitian 2 x 2 matrix."""
    det = e[0, 0][0] * e[1, 1][0] - (e[0, 1][0] * e[0, 1][0] + e[0, 1][1] * e[0, 1][1])
    return {(0, 0): (e[1, 1][0] / det, F.lit(0.0)), (1, 1): (e[0, 0][0] / det, F.lit(0.0)), (0, 1): (-e[0, 1][0] / det, -e[0, 1][1] / det), (1, 0): (-e[1, 0][0] / det, -e[1, 0][1] / det)}, det


def _trace(m: dict) -> Column:
    return m[0, 0][0] + m[1, 1][0]


def bivariate_whittle(cross: DataFrame, ep: DataFrame, grid: GridSpec, keys: list[str], by: list[str], names: list[str] = ()) -> DataFrame:
    """by, ll (mean of log det E + tr E^-1 I) and s_<name>: mean of tr E^-1 dE - tr E^-1 dE E^-1 I."""
    on = [*keys, *grid.axes("k")]
    pw = _wide(cross.withColumnsRenamed({"re": "p", "im": "p_im"}), on, ["p", "p_im"])
    ew = _wide(ep, [*dict.fromkeys([*on, *by])], ["e", "e_im", *(x for g in names for x in (f"de_{g}", f"de_{g}_im"))])
    inv, det = _inverse(_entries("e"))
    i_p = _times(inv, _entries("p"))
    aggs = [F.avg(F.log(det) + _trace(i_p)).alias("ll")]
    for g in names:
        i_d = _times(inv, _entries(f"de_{g}"))
        aggs.append(F.avg(_trace(i_d) - _trace(_times(i_d, i_p))).alias(f"s_{g}"))
    return pw.join(ew, on).groupBy(*by).agg(*aggs)


def bivariate_fisher(ep: DataFrame, grid: GridSpec, by: list[str], names: list[str]) -> DataFrame:
    """by, i, j, h: mean of tr E^-1 dE_i E^-1 dE_j."""
    ew = _wide(ep, [*by, *grid.axes("k")], ["e", "e_im", *(x for g in names for x in (f"de_{g}", f"de_{g}_im"))])
    inv, _ = _inverse(_entries("e"))
    turned = {g: _times(inv, _entries(f"de_{g}")) for g in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    wide = ew.groupBy(*by).agg(*(F.avg(_trace(_times(turned[a], turned[b]))).alias(f"{a}|{b}") for a, b in pairs))
    name_of = {frozenset(p): f"`{p[0]}|{p[1]}`" for p in pairs}
    entries = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(name_of[frozenset((a, b))]).alias("h")) for a in names for b in names]
    return wide.select(*by, F.explode(F.array(*entries)).alias("_h")).select(*by, "_h.*")
