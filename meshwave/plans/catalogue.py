"""Registered queries of the random-field engine and their SQL. Results round to six digits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwave.functions import arrays
from meshwave.functions import kernels as K
from meshwave.operators import fields as W
from meshwave.operators import grid as G
from meshwave.operators import likelihood as L
from meshwave.operators import spectral as S
from meshwave.plans import sql as Q
from meshwave.sources import fields as src

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
GRID, COARSE = src.EVENTS, G.GridSpec((6, 8))
EXP, SQ = {"rho": 2.0, "sigma": 1.0}, {"rho": 2.0, "sigma": 1.0}
rnd = Q.rnd


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return put


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def click(spark, d) -> DataFrame:
    return src.event_fields(spark, d, "click")


def checker() -> Column:
    return F.when((F.col("i0") + F.col("i1")) % 3 != 0, 1.0).otherwise(0.0)


def coarse_mask() -> np.ndarray:
    return (np.add.outer(np.arange(6), np.arange(8)) % 3 != 0).astype(float)


COARSE_SQL = "m as (select cast(i0 as int) as i0, cast(i1 as int) as i1, case when (i0 + i1) % 3 <> 0 then 1e0 else 0e0 end as g from range(6) x(i0), range(8) y(i1))"

# ------------------------------------------------------------------ grids and masks


@query(f"with {Q.EVENTS} select field_id, i0, i1, {rnd('f.z')} as z, n as n_rows from f join raw using (field_id, i0, i1)")
def grid_events(spark, d):
    n = src.event_cells(spark, d, "count").select("field_id", "i0", "i1", F.col("z").cast("long").alias("n_rows"))
    return src.event_fields(spark, d).join(n, ["field_id", "i0", "i1"]).select("field_id", "i0", "i1", r6("z").alias("z"), "n_rows")


@query(f"with {Q.EVENTS}, {Q.CELLS} select t.field_id, i0, i1 from (select distinct field_id from f) t, cells where not exists (select 1 from f where f.field_id = t.field_id and f.i0 = cells.i0 and f.i1 = cells.i1)")
def grid_missing_cells(spark, d):
    field = src.event_fields(spark, d)
    return G.missing_cells(field, GRID, field.select("field_id").distinct())


@query(f"with {Q.CELLS} select i0, i1, case when (i0 - 14e0) * (i0 - 14e0) + (i1 - 11.5e0) * (i1 - 11.5e0) <= 100e0 then 1e0 else 0e0 end as g from cells")
def grid_circle_mask(spark, d):
    return G.cells(spark, GRID).withColumn("g", G.circle_mask((14, 11.5), 20))


@query(f"with {Q.CELLS} select i0, i1, case when ((i0 * 7919 + i1 * 104729) % 1000) / 1000e0 >= 0.3e0 then 1e0 else 0e0 end as g from cells")
def grid_bernoulli_mask(spark, d):
    return G.cells(spark, GRID).withColumn("g", G.bernoulli_mask(0.3))


@query(f"with {Q.CELLS} select i0, i1, case when (i0 - 14e0) * (i0 - 14e0) + (i1 - 11.5e0) * (i1 - 11.5e0) <= 100e0 and ((i0 * 7919 + i1 * 104729) % 1000) / 1000e0 >= 0.3e0 then 1e0 else 0e0 end as g from cells")
def mask_product(spark, d):
    return G.mask_product(grid_circle_mask(spark, d), grid_bernoulli_mask(spark, d), 2)


@query(f"with {Q.CELLS} select i0, i1, case when i0 * i0 + (i1 - 3) * (i1 - 3) <= 16e0 then 0e0 else 1e0 end as g from cells")
def grid_hole_mask(spark, d):
    return G.cells(spark, GRID).withColumn("g", G.hole_mask((0, 3), 8))


@query("select cast(i0 as int) as i0, cast(i1 as int) as i1, case when (floor(i0 * 30 / 12e0) - 14e0) * (floor(i0 * 30 / 12e0) - 14e0) + (floor(i1 * 24 / 10e0) - 11.5e0) * (floor(i1 * 24 / 10e0) - 11.5e0) <= 100e0 then 1e0 else 0e0 end as g from range(12) x(i0), range(10) y(i1)")
def mask_resampled(spark, d):
    return G.resample(grid_circle_mask(spark, d), GRID, G.GridSpec((12, 10)))


@query(f"with {Q.CELLS} select i0, i1, i0 * 1e0 as x0, i1 * 0.5e0 as x1 from cells")
def grid_points(spark, d):
    return G.points(spark, G.GridSpec((30, 24), (1.0, 0.5)))


@query(f"with {Q.LAGS} select t0, t1, t0 * 1e0 as h0, t1 * 0.5e0 as h1 from lags")
def lags_unique(spark, d):
    return G.lags(spark, G.GridSpec((30, 24), (1.0, 0.5)))


@query("with p as (select cast(i0 * 8 + i1 as bigint) as pt_id, i0 * 1e0 as x0, i1 * 0.5e0 as x1 from range(6) x(i0), range(8) y(i1)) select a.pt_id as a_id, b.pt_id as b_id, a.x0 - b.x0 as h0, a.x1 - b.x1 as h1 from p a, p b")
def lag_matrix(spark, d):
    p = G.points(spark, G.GridSpec((6, 8), (1.0, 0.5))).withColumn("pt_id", (F.col("i0") * 8 + F.col("i1")).cast("long"))
    return G.lag_matrix(p, p, 2)


@query(f"with {Q.KK} select k0, k1, {rnd('(case when k0 < 15 then k0 else k0 - 30 end) / 30e0')} as f0, {rnd('(case when k1 < 12 then k1 else k1 - 24 end) / 12e0')} as f1 from kk")
def fourier_freqs(spark, d):
    return rounded(G.frequencies(spark, G.GridSpec((30, 24), (1.0, 0.5))), "f0", "f1")


@query(f"select cast(k0 as int) as k0, cast(k1 as int) as k1, {rnd('(case when k0 < 30 then k0 else k0 - 59 end) / 59e0')} as f0, {rnd('(case when k1 < 24 then k1 else k1 - 47 end) / 47e0')} as f1 from range(59) x(k0), range(47) y(k1)")
def fourier_freqs2(spark, d):
    return rounded(G.frequencies(spark, GRID, doubled=True), "f0", "f1")


@query(f"with {Q.CLICK} select i0, i1, {rnd('z * ' + Q.HANN)} as z, {rnd(Q.HANN)} as taper from c")
def tapered_field(spark, d):
    return click(spark, d).select("i0", "i1", r6(F.col("z") * G.hann(GRID)).alias("z"), r6(G.hann(GRID)).alias("taper"))


# ------------------------------------------------------------------ spatial kernels


@query(f"with {Q.EVENTS} select field_id, a.i0 - b.i0 as t0, a.i1 - b.i1 as t1, {rnd('sum(a.g * b.g) / 720e0')} as cg from f a join f b using (field_id) group by all")
def spatial_kernel_2d(spark, d):
    return rounded(S.spatial_kernel(src.event_fields(spark, d), GRID, ["field_id"]), "cg")


@query(f"with {Q.CLICK}, k as ({Q.kernel_of('c', Q.HANN)}) select t0, t1, {rnd('cg')} as cg from k")
def spatial_kernel_tapered(spark, d):
    return rounded(S.spatial_kernel(click(spark, d), GRID, [], G.hann(GRID)), "cg")


@query(f"with {Q.PAIR} select a.var as a, b.var as b, a.i0 - b.i0 as t0, a.i1 - b.i1 as t1, {rnd('sum(a.g * b.g) / 720e0')} as cg from v a, v b group by all")
def spatial_kernel_bivariate(spark, d):
    return rounded(S.spatial_kernel(src.event_pair(spark, d), GRID, [], variates=True), "cg")


ORDERS_SQL = "o as (select cast(date_diff('day', timestamp '1995-01-01', date_trunc('day', o_orderdate)) as int) as i0, count(*) as n from orders group by 1 having i0 between 0 and 2404)"


@query(f"with {ORDERS_SQL} select a.i0 - b.i0 as t0, {rnd('count(*) / 2405e0')} as cg from o a, o b group by all")
def spatial_kernel_1d(spark, d):
    return rounded(S.spatial_kernel(src.order_field(spark, d), src.ORDERS, []), "cg")


LINES_SQL = """lr as (select cast(l_quantity as int) - 1 as i0, cast(round(l_discount * 100) as int) as i1, cast(round(l_tax * 100) as int) as i2, avg(l_extendedprice) as z
from lineitem where cast(l_quantity as int) between 1 and 50 and cast(round(l_discount * 100) as int) between 0 and 10 and cast(round(l_tax * 100) as int) between 0 and 8 group by all),
l as (select i0, i1, i2, (z - m) / s as z from lr, (select avg(z) as m, stddev_pop(z) as s from lr))"""


@query(f"""with {LINES_SQL}, n as (select a.i0 - b.i0 as t0, a.i1 - b.i1 as t1, a.i2 - b.i2 as t2, count(*) as n from l a, l b group by all),
h as (select cast(t0 as int) as t0, cast(t1 as int) as t1, cast(t2 as int) as t2 from range(-49, 50) x(t0), range(-10, 11) y(t1), range(-8, 9) w(t2))
select t0, t1, t2, {rnd('coalesce(n, 0) / 4950e0')} as cg from h left join n using (t0, t1, t2)""")
def spatial_kernel_3d(spark, d):
    return rounded(S.spatial_kernel(src.line_field(spark, d), src.LINES, []), "cg")


@query(f"with {Q.CLICK}, k as ({Q.kernel_of('c')}) select cast((t0 + 30) % 30 as int) as t0, cast((t1 + 24) % 24 as int) as t1, {rnd('sum(cg)')} as cg from k group by all")
def kernel_folded(spark, d):
    return rounded(S.fold(S.spatial_kernel(click(spark, d), GRID, []), GRID, [], "cg"), "cg")


@query(f"with {COARSE_SQL} select b.i0 - a.i0 as t0, b.i1 - a.i1 as t1, {rnd('sum(a.g * b.g * cos(2e0 * pi() * (a.i0 / 6e0 + 2e0 * a.i1 / 8e0))) / 48e0')} as re, {rnd('-sum(a.g * b.g * sin(2e0 * pi() * (a.i0 / 6e0 + 2e0 * a.i1 / 8e0))) / 48e0')} as im from m a, m b group by all")
def kernel_offset(spark, d):
    return rounded(S.offset_kernel(G.cells(spark, COARSE).withColumn("g", checker()), COARSE, [], (1, 2)), "re", "im")


# ------------------------------------------------------------------ covariance kernels on lags


def on_lags(spark) -> DataFrame:
    return G.lags(spark, G.GridSpec((10, 8), (1.0, 0.5)))


LAG_SQL = "h as (select cast(t0 as int) as t0, cast(t1 as int) as t1, t0 * 1e0 as h0, t1 * 0.5e0 as h1 from range(-9, 10) x(t0), range(-7, 8) y(t1)), th as (select cast(i as int) as theta_id, 1e0 + i as rho, 0.5e0 + 0.25e0 * i as sigma, 0.75e0 + 0.5e0 * i as alpha from range(4) t(i))"


def thetas(spark) -> DataFrame:
    i = F.col("id")
    return spark.range(4).select(i.cast("int").alias("theta_id"), (1.0 + i).alias("rho"), (0.5 + 0.25 * i).alias("sigma"), (0.75 + 0.5 * i).alias("alpha"))


def kernel_query(kernel: K.Kernel, name: str):
    def run(spark, d):
        t = {p.name: F.col(p.name) for p in kernel.params}
        h = [F.col("h0"), F.col("h1")]
        grads = {f"d_{p.name}": r6(kernel.grad(h, t, p.name)) for p in kernel.params}
        return on_lags(spark).crossJoin(F.broadcast(thetas(spark))).select("theta_id", "t0", "t1", r6(kernel.cov(h, t)).alias("c"), *(c.alias(n) for n, c in grads.items()))

    own = [p.name for p in kernel.params]
    slopes = "".join(f", {rnd(Q.slope(name, p))} as d_{p}" for p in own)
    query(f"with {LAG_SQL} select theta_id, t0, t1, {rnd(Q.cov(name))} as c{slopes} from h, th", f"kernel_{name}")(run)


for _k, _n in ((K.Exponential(), "exponential"), (K.SquaredExponential(), "squared"), (K.Matern32(), "matern32"), (K.Matern52(), "matern52"), (K.RationalQuadratic(), "rational")):
    kernel_query(_k, _n)


@query(f"""with {LAG_SQL} select theta_id, t0, t1, {rnd(f"(case when t0 = 0 and t1 = 0 then 0.1e0 * sigma * sigma else 0e0 end) + 0.9e0 * {Q.cov('squared')}")} as c,
{rnd(f"(case when t0 = 0 and t1 = 0 then sigma * sigma else 0e0 end) - {Q.cov('squared')}")} as d_nugget, {rnd(f"0.9e0 * {Q.slope('squared', 'rho')}")} as d_rho from h, th""")
def kernel_nugget(spark, d):
    k = K.Nugget(K.SquaredExponential())
    t, h = {"nugget": F.lit(0.1), "rho": F.col("rho"), "sigma": F.col("sigma")}, [F.col("h0"), F.col("h1")]
    return on_lags(spark).crossJoin(F.broadcast(thetas(spark))).select("theta_id", "t0", "t1", r6(k.cov(h, t)).alias("c"), r6(k.grad(h, t, "nugget")).alias("d_nugget"), r6(k.grad(h, t, "rho")).alias("d_rho"))


ANISO = "sqrt(power(1.5e0 * (cos(0.4e0) * h0 - sin(0.4e0) * h1), 2) + power((sin(0.4e0) * h0 + cos(0.4e0) * h1) / 1.5e0, 2))"
ANISO_D = "(case when t0 = 0 and t1 = 0 then 0e0 else -sigma * sigma / rho * exp(-{r} / rho) * (1.5e0 * power(cos(0.4e0) * h0 - sin(0.4e0) * h1, 2) - power(sin(0.4e0) * h0 + cos(0.4e0) * h1, 2) / power(1.5e0, 3)) / {r} end)".replace("{r}", ANISO)


@query(f"with {LAG_SQL} select theta_id, t0, t1, {rnd(Q.cov('exponential', r=ANISO))} as c, {rnd(ANISO_D)} as d_eta from h, th")
def kernel_anisotropic(spark, d):
    k = K.Anisotropic(K.Exponential())
    t, h = {"eta": F.lit(1.5), "phi": F.lit(0.4), "rho": F.col("rho"), "sigma": F.col("sigma")}, [F.col("h0"), F.col("h1")]
    return on_lags(spark).crossJoin(F.broadcast(thetas(spark))).select("theta_id", "t0", "t1", r6(k.cov(h, t)).alias("c"), r6(k.grad(h, t, "eta")).alias("d_eta"))


@query(f"with {LAG_SQL} select theta_id, t0, t1, {rnd(Q.cov('exponential') + ' + ' + Q.cov('squared', '(2e0 * rho)', '1e0'))} as c, {rnd('2e0 * ' + Q.cov('squared', '(2e0 * rho)', '1e0'))} as d_m1_sigma from h, th")
def kernel_sum(spark, d):
    k = K.Exponential() + K.SquaredExponential()
    t = {"m0_rho": F.col("rho"), "m0_sigma": F.col("sigma"), "m1_rho": 2 * F.col("rho"), "m1_sigma": F.lit(1.0)}
    h = [F.col("h0"), F.col("h1")]
    return on_lags(spark).crossJoin(F.broadcast(thetas(spark))).select("theta_id", "t0", "t1", r6(k.cov(h, t)).alias("c"), r6(k.grad(h, t, "m1_sigma")).alias("d_m1_sigma"))


@query(f"with {LAG_SQL} select theta_id, t0, t1, {rnd('sigma * sigma * exp(-abs(h0) / rho) * 1e0 * exp(-h1 * h1 / 8e0)')} as c from h, th")
def kernel_separable(spark, d):
    k = K.Separable((K.Exponential(), K.SquaredExponential()))
    t = {"m0_rho": F.col("rho"), "m0_sigma": F.col("sigma"), "m1_rho": F.lit(2.0), "m1_sigma": F.lit(1.0)}
    return on_lags(spark).crossJoin(F.broadcast(thetas(spark))).select("theta_id", "t0", "t1", r6(k.cov([F.col("h0"), F.col("h1")], t)).alias("c"))


@query(f"""with {LAG_SQL}, ab as (select cast(a as int) as a, cast(b as int) as b from range(2) x(a), range(2) y(b))
select theta_id, t0, t1, a, b, {rnd('(case when a = b and a = 0 then 1e0 when a = b then 2.25e0 else 0.45e0 end) * ' + Q.cov('squared'))} as c, {rnd('(case when a = b then 0e0 else 1.5e0 end) * ' + Q.cov('squared'))} as d_r from h, th, ab""")
def kernel_bivariate(spark, d):
    m = K.BivariateUniform(K.SquaredExponential())
    t = {"r": F.lit(0.3), "f": F.lit(1.5), "rho": F.col("rho"), "sigma": F.col("sigma")}
    h = [F.col("h0"), F.col("h1")]
    c, g = m.cov(h, t), m.grad(h, t, "r")
    rows = F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(c[a, b]).alias("c"), r6(g[a, b]).alias("d_r")) for a in (0, 1) for b in (0, 1))))
    return on_lags(spark).crossJoin(F.broadcast(thetas(spark))).select("theta_id", "t0", "t1", rows)


SDF = "4e0 * pi() * gamma(2.5e0) * power(3e0, 1.5e0) / (gamma(1.5e0) * power(4e0, 3)) * power(3e0 / 16e0 + 4e0 * pi() * pi() * ({f2}), -2.5e0)"


@query(f"with {Q.KK}, ff as (select k0, k1, (case when k0 < 15 then k0 else k0 - 30 end) / 30e0 as f0, (case when k1 < 12 then k1 else k1 - 24 end) / 24e0 as f1 from kk) select k0, k1, {rnd(SDF.format(f2='f0 * f0 + f1 * f1'))} as s from ff")
def spectral_matern_sdf(spark, d):
    return G.frequencies(spark, GRID).select("k0", "k1", r6(K.spectral_matern([F.col("f0"), F.col("f1")], 4.0, 1.5)).alias("s"))


@query(f"""with ff as (select k, (case when k < 49 then k else k - 97 end) / (97 * 0.5e0) as f from range(97) t(k)),
s as (select k, 2e0 * sqrt(pi()) * gamma(2e0) * power(3e0, 1.5e0) / (gamma(1.5e0) * power(4e0, 3)) * power(3e0 / 16e0 + 4e0 * pi() * pi() * f * f, -2e0) as s from ff),
t as (select cast(t as int) as t0 from range(-31, 32) u(t))
select t0, {rnd('sum(s * cos(2e0 * pi() * k * 2 * t0 / 97e0)) / 48.5e0')} as c from s, t group by all""")
def spectral_matern_acv(spark, d):
    """A one-axis grid of 32, by a transform in one task: 97 numbers."""

    def run(batches):
        for _ in batches:
            c = K.spectral_acv(lambda f: K.spectral_matern(f, 4.0, 1.5), (32,), (1.0,))
            t = np.concatenate([np.arange(32), np.arange(-31, 0)])
            yield pd.DataFrame({"t0": t.astype(np.int32), "c": c})

    return rounded(spark.range(1, numPartitions=1).mapInPandas(run, "t0 int, c double"), "c")


@query(f"""with {LAG_SQL} select t0, t1, {rnd('exp(-sqrt(h0 * h0 + h1 * h1) / 3e0) * 4e0')} as exponential, {rnd('exp(-sqrt(power((h0 * cos(0.3e0) - h1 * sin(0.3e0)) / 2e0, 2) + power((h0 * sin(0.3e0) + h1 * cos(0.3e0)) / 5e0, 2)))')} as anisotropic,
{rnd('exp(-abs(h0) / 3e0)')} as line, {rnd('exp(-h0 * h0 / 9e0)')} as line_squared, {rnd('exp(-abs(h0) / 3e0) * exp(-abs(h1) / 3e0)')} as separable, {rnd('exp(-(h0 * h0 + h1 * h1) / 9e0)')} as separable_squared,
{rnd('(1e0 + sqrt(3e0) * ' + Q.R + ' / 3e0) * exp(-sqrt(3e0) * ' + Q.R + ' / 3e0)')} as matern32, {rnd('4e0 * exp(-(h0 * h0 + h1 * h1) / 18e0) + (case when t0 = 0 and t1 = 0 then 0.001e0 else 0e0 end)')} as squared from h""")
def kernels_old(spark, d):
    h = [F.col("h0"), F.col("h1")]
    forms = {
        "exponential": K.old_exponential(h, F.lit(3.0), F.lit(2.0)), "anisotropic": K.old_anisotropic_exponential(h, 2.0, 5.0, 0.3, F.lit(1.0)), "line": K.old_line_exponential(h[0], 3.0), "line_squared": K.old_line_squared(h[0], 3.0),
        "separable": K.old_separable(h, 3.0), "separable_squared": K.old_separable(h, 3.0, True), "matern32": K.old_matern32(h, F.lit(3.0)), "squared": K.old_squared_exponential(h, F.lit(3.0), F.lit(2.0)),
    }
    return on_lags(spark).select("t0", "t1", *(r6(c).alias(n) for n, c in forms.items()))


@query(f"with {LAG_SQL} select t0, t1, {rnd('2.25e0 * (1e0 + sqrt(3e0) * ' + Q.R + ' / 3e0) * exp(-sqrt(3e0) * ' + Q.R + ' / 3e0)')} as c from h")
def kernel_matern_general(spark, d):
    """By quadrature of the Bessel function, at an order where a closed form can check it."""

    @F.pandas_udf("double")
    def value(h0: pd.Series, h1: pd.Series) -> pd.Series:
        return pd.Series(K.matern(np.hypot(h0, h1).to_numpy(), 3.0, 1.5, 1.5, closed=False))

    return on_lags(spark).select("t0", "t1", r6(value("h0", "h1")).alias("c"))


@query(f"with {COARSE_SQL}, p as (select cast(i0 * 8 + i1 as bigint) as id, * from m) select a.id as a_id, b.id as b_id, {rnd('exp(-sqrt(cast((a.i0 - b.i0) * (a.i0 - b.i0) + (a.i1 - b.i1) * (a.i1 - b.i1) as double)) / 2e0) * a.g * b.g')} as c from p a, p b")
def covariance_matrix(spark, d):
    cells = G.cells(spark, COARSE).withColumn("g", checker()).withColumn("pt_id", (F.col("i0") * 8 + F.col("i1")).cast("long"))
    return rounded(S.covariance_matrix(cells, COARSE, K.Exponential(), EXP), "c")


PTS = "p as (select vec_id, cast(embedding[1] as double) as x0, cast(embedding[2] as double) as x1, cast(embedding[3] as double) as x2 from embeddings), a as (select vec_id as a_id, x0, x1, x2 from p where vec_id % 100 = 0), b as (select vec_id as b_id, x0 as y0, x1 as y1, x2 as y2 from p)"


@query(f"with {PTS} select a_id, b_id, {rnd('exp(-(power(x0 - y0, 2) + power(x1 - y1, 2) + power(x2 - y2, 2)) / 2e0)')} as c from a, b")
def covariance_points(spark, d):
    """Vectors whose id is divisible by 100 against all, in three dimensions."""
    p = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("pt_id"), *(F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(3)))
    h = G.lag_matrix(p.where("pt_id % 100 = 0"), p, 3)
    return h.select("a_id", "b_id", r6(K.SquaredExponential().cov([F.col(f"h{i}") for i in range(3)], {"rho": F.lit(1.0), "sigma": F.lit(1.0)})).alias("c"))


# ------------------------------------------------------------------ periodograms


@query(f"with {Q.EVENTS}, {Q.KK}, p as ({Q.per_of('f', extra='field_id')}) select field_id, k0, k1, {rnd('p')} as p from p")
def periodogram_2d(spark, d):
    return rounded(S.periodogram(src.event_fields(spark, d), GRID, ["field_id"]), "p")


@query(f"with {Q.CLICK}, {Q.KK}, p as ({Q.per_of('c', Q.HANN)}) select k0, k1, {rnd('p')} as p from p")
def periodogram_hann(spark, d):
    return rounded(S.periodogram(click(spark, d), GRID, [], G.hann(GRID)), "p")


VEC = f"""e as (select vec_id, cast(generate_subscripts(embedding, 1) - 1 as int) as i0, cast(unnest(embedding) as double) as z from embeddings),
p as (select vec_id, cast(k as int) as k0, (power(sum(z * cos({Q.TAU} * ((k * i0) % 64) / 64e0)), 2) + power(sum(z * sin({Q.TAU} * ((k * i0) % 64) / 64e0)), 2)) / 64e0 as p from e, range(64) t(k) group by all)"""


@query(f"with {VEC} select vec_id, k0, {rnd('p')} as p from p")
def periodogram_1d_embeddings(spark, d):
    """One plan for all vectors, without Python."""
    return rounded(S.periodogram(src.vector_fields(spark, d), G.GridSpec((64,)), ["vec_id"]), "p")


@query(f"with {VEC} select vec_id, k0, {rnd('p')} as p from p")
def periodogram_fft_embeddings(spark, d):
    """The same by a fast transform a vector."""
    return rounded(W.periodograms(src.vector_fields(spark, d), G.GridSpec((64,)), ["vec_id"]), "p")


@query(f"""with {LINES_SQL}, kk as (select cast(k0 as int) as k0, cast(k1 as int) as k1, cast(k2 as int) as k2 from range(50) x(k0), range(11) y(k1), range(9) w(k2)),
j as (select k0, k1, k2, z, {Q.TAU} * (k0 * i0 / 50e0 + k1 * i1 / 11e0 + k2 * i2 / 9e0) as a from l, kk)
select k0, k1, k2, {rnd('(power(sum(z * cos(a)), 2) + power(sum(z * sin(a)), 2)) / 4950e0')} as p from j group by all""")
def periodogram_3d(spark, d):
    return rounded(S.periodogram(src.line_field(spark, d), src.LINES, []), "p")


@query(f"with {Q.CLICK}, kk as (select cast(k0 as int) as k0, cast(k1 as int) as k1 from range(60) x(k0), range(48) y(k1)) select k0, k1, {rnd('(power(sum(z * cos(a)), 2) + power(sum(z * sin(a)), 2)) / 720e0')} as p from (select k0, k1, z, {Q.TAU} * (k0 * i0 / 60e0 + k1 * i1 / 48e0) as a from c, kk) group by all")
def periodogram_nofold(spark, d):
    return rounded(S.periodogram(click(spark, d), GRID, [], double=True), "p")


@query(f"with {Q.CLICK}, {Q.KK}, p as ({Q.per_of()}) select k0, k1, {rnd('p * 720e0 / (select count(*) from c)')} as p from p")
def periodogram_observed(spark, d):
    return rounded(S.periodogram(click(spark, d), GRID, ["field_id"], normalise="observed").drop("field_id"), "p")


PAIR_DFT = f"j as (select var, k0, k1, sum(z * cos(a)) as re, -sum(z * sin(a)) as im from (select var, k0, k1, z, {Q.ANGLE} as a from v, kk) group by all)"


@query(f"with {Q.PAIR}, {Q.KK}, {PAIR_DFT} select var, k0, k1, {rnd('re')} as re, {rnd('im')} as im from j")
def multivariate_dft(spark, d):
    return rounded(S.field_dft(src.event_pair(spark, d), GRID, ["var"]), "re", "im")


@query(f"with {Q.PAIR}, {Q.KK}, {PAIR_DFT} select x.k0, x.k1, x.var as a, y.var as b, {rnd('(x.re * y.re + x.im * y.im) / 720e0')} as re, {rnd('(x.im * y.re - x.re * y.im) / 720e0')} as im from j x join j y on x.k0 = y.k0 and x.k1 = y.k1")
def cross_periodogram(spark, d):
    return rounded(S.cross_periodogram(src.event_pair(spark, d), GRID, []), "re", "im")


@query(f"with {Q.CLICK}, {Q.KK} select k0, k1, {rnd('sum(z * cos(a))')} as re, {rnd('-sum(z * sin(a))')} as im from (select k0, k1, z, {Q.ANGLE} as a from c, kk) group by all")
def dft_rows_columns(spark, d):
    """The plan for a field too large for one task."""
    return rounded(W.large_dft(click(spark, d), GRID, F.col("z")), "re", "im")


# ------------------------------------------------------------------ expected periodograms


def click_kernel(spark, d, taper=None) -> DataFrame:
    return S.spatial_kernel(click(spark, d), GRID, [], taper)


BASE = f"with {Q.CLICK}, {Q.KK}, cg as ({Q.kernel_of('c')})"


def ep_query(name: str, kernel: K.Kernel, theta: dict, expr: str):
    def run(spark, d):
        return rounded(S.expected_periodogram(click_kernel(spark, d), GRID, [], kernel, theta), "e")

    query(f"{BASE}, e as ({Q.ep_of({'e': expr})}) select k0, k1, {rnd('e')} as e from e", f"expected_periodogram_{name}")(run)


ep_query("exponential", K.Exponential(), EXP, Q.cov("exponential", "2e0", "1e0"))
ep_query("squared", K.SquaredExponential(), SQ, Q.cov("squared", "2e0", "1e0"))
ep_query("matern32", K.Matern32(), EXP, Q.cov("matern32", "2e0", "1e0"))
ep_query("nugget", K.Nugget(K.Exponential()), EXP | {"nugget": 0.2}, f"(case when t0 = 0 and t1 = 0 then 0.2e0 else 0e0 end) + 0.8e0 * {Q.cov('exponential', '2e0', '1e0')}")


@query(f"with {Q.CLICK}, {Q.KK}, cg as ({Q.kernel_of('c', Q.HANN)}), e as ({Q.ep_of({'e': Q.cov('exponential', '2e0', '1e0')})}) select k0, k1, {rnd('e')} as e from e")
def expected_periodogram_tapered(spark, d):
    return rounded(S.expected_periodogram(click_kernel(spark, d, G.hann(GRID)), GRID, [], K.Exponential(), EXP), "e")


@query(f"with {Q.CLICK}, kk as (select cast(k0 as int) as k0, cast(k1 as int) as k1 from range(60) x(k0), range(48) y(k1)), cg as ({Q.kernel_of('c')}), e as ({Q.ep_of({'e': Q.cov('exponential', '2e0', '1e0')}, angle=f'{Q.TAU} * (k0 * t0 / 60e0 + k1 * t1 / 48e0)')}) select k0, k1, {rnd('e')} as e from e")
def expected_periodogram_nofold(spark, d):
    return rounded(S.expected_periodogram(click_kernel(spark, d), GRID, [], K.Exponential(), EXP, double=True), "e")


@query(f"with {Q.KK}, {Q.LAGS}, cg as (select t0, t1, (1e0 - abs(t0) / 30e0) * (1e0 - abs(t1) / 24e0) as cg from lags), e as ({Q.ep_of({'e': 'exp(-abs(t0) / 3e0) * exp(-t1 * t1 / 8e0)', 'de_m0_rho': 'abs(t0) / 9e0 * exp(-abs(t0) / 3e0) * exp(-t1 * t1 / 8e0)'})}) select k0, k1, {rnd('e')} as e, {rnd('de_m0_rho')} as de_m0_rho from e")
def expected_periodogram_separable(spark, d):
    k = K.Separable((K.Exponential(), K.SquaredExponential()))
    out = S.expected_separable(spark, GRID, k, {"m0_rho": 3.0, "m0_sigma": 1.0, "m1_rho": 2.0, "m1_sigma": 1.0}, ["m0_rho"])
    return rounded(out, "e", "de_m0_rho")


GRADS = {"e": Q.cov("exponential", "2e0", "1e0"), "de_rho": Q.slope("exponential", "rho", "2e0", "1e0"), "de_sigma": Q.slope("exponential", "sigma", "2e0", "1e0")}
GRAD_SQL = f"{BASE}, e as ({Q.ep_of(GRADS)})"


def click_gradient(spark, d) -> DataFrame:
    return S.expected_periodogram(click_kernel(spark, d), GRID, [], K.Exponential(), EXP, ["rho", "sigma"])


@query(f"{GRAD_SQL} select k0, k1, {rnd('e')} as e, {rnd('de_rho')} as de_rho, {rnd('de_sigma')} as de_sigma from e")
def ep_gradient(spark, d):
    return rounded(click_gradient(spark, d), "e", "de_rho", "de_sigma")


TH_SQL = "th as (select cast(i as int) as theta_id, 0.5e0 + 0.25e0 * i as rho, 1e0 as sigma from range(20) t(i))"


def theta_scan(spark, n: int = 20) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("theta_id"), (0.5 + 0.25 * F.col("id")).alias("rho"), F.lit(1.0).alias("sigma"))


SCAN_SQL = f"{BASE}, {TH_SQL}, e as ({Q.ep_of({'e': Q.cov('exponential')}, by='theta_id')})"


@query(f"{SCAN_SQL} select theta_id, k0, k1, {rnd('e')} as e from e")
def ep_theta_scan(spark, d):
    return rounded(S.expected_periodogram(click_kernel(spark, d), GRID, [], K.Exponential(), theta_scan(spark)), "e")


PAIR_KERNEL = "cg as (select a.var as a, b.var as b, a.i0 - b.i0 as t0, a.i1 - b.i1 as t1, sum(a.g * b.g) / 720e0 as cg from v a, v b group by all)"
FACT = "(case when a = 0 and b = 0 then 1e0 when a = b then 2.25e0 else 0.45e0 end)"
D_R = "(case when a = b then 0e0 else 1.5e0 end)"
D_F = "(case when a = 0 and b = 0 then 0e0 when a = b then 3e0 else 0.3e0 end)"
BI = {"r": 0.3, "f": 1.5, "rho": 1.0, "sigma": 1.0}
BI_MODEL = K.BivariateUniform(K.Exponential())


def pair_ep(values: dict[str, str]) -> str:
    base = Q.on_lags(Q.cov("exponential", "1e0", "1e0"))
    sums = ", ".join(f"sum(cg * {f} * {base} * cos({Q.LAG_ANGLE})) as {n}, -sum(cg * {f} * {base} * sin({Q.LAG_ANGLE})) as {n}_im" for n, f in values.items())
    return f"e as (select a, b, k0, k1, {sums} from cg, kk group by all)"


def pair_expected(spark, d, grads=()) -> DataFrame:
    return S.expected_bivariate(S.spatial_kernel(src.event_pair(spark, d), GRID, [], variates=True), GRID, [], BI_MODEL, BI, list(grads))


@query(f"with {Q.PAIR}, {Q.KK}, {PAIR_KERNEL}, {pair_ep({'e': FACT})} select a, b, k0, k1, {rnd('e')} as e, {rnd('e_im')} as e_im from e")
def expected_periodogram_bivariate(spark, d):
    return rounded(pair_expected(spark, d), "e", "e_im")


# ------------------------------------------------------------------ likelihood

PER = f"p as ({Q.per_of()})"


def click_per(spark, d) -> DataFrame:
    return S.periodogram(click(spark, d), GRID, [])


@query(f"{BASE}, {PER}, e as ({Q.ep_of({'e': Q.cov('exponential', '2e0', '1e0')})}) select cast(count(*) as bigint) as n, {rnd('avg(ln(e) + p / e)')} as ll from p join e using (k0, k1)")
def whittle(spark, d):
    """The flagship: gridding, periodogram, spatial kernel, expected periodogram, value."""
    e = S.expected_periodogram(click_kernel(spark, d), GRID, [], K.Exponential(), EXP)
    return click_per(spark, d).join(e, ["k0", "k1"]).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(L.whittle_term())).alias("ll"))


@query(f"{SCAN_SQL.replace('range(20)', 'range(100)')}, {PER} select theta_id, {rnd('avg(ln(e) + p / e)')} as ll from p join e using (k0, k1) group by all")
def whittle_theta_scan(spark, d):
    """100 parameter rows, by the plan that the sizes ask for."""
    return rounded(W.values(click(spark, d), GRID, ["field_id"], K.Exponential(), theta_scan(spark, 100)).select("theta_id", "ll"), "ll")


@query(f"{SCAN_SQL}, {PER} select theta_id, {rnd('avg(ln(e) + p / e)')} as ll from p join e using (k0, k1) group by all")
def whittle_scan_sums(spark, d):
    """20 rows by relational sums."""
    e = S.expected_periodogram(click_kernel(spark, d), GRID, [], K.Exponential(), theta_scan(spark))
    return rounded(L.whittle(click_per(spark, d), e, GRID, [], ["theta_id"]), "ll")


@query(f"{SCAN_SQL}, {PER} select theta_id, {rnd('avg(ln(e) + p / e)')} as ll from p join e using (k0, k1) group by all")
def whittle_scan_fft(spark, d):
    """The same by fast transforms in tasks."""
    return rounded(W.scan(click(spark, d), GRID, ["field_id"], K.Exponential(), theta_scan(spark)).select("theta_id", "ll"), "ll")


@query(f"{SCAN_SQL}, {PER} select theta_id, {rnd('avg(ln(e) + p / e)')} as ll from p join e using (k0, k1) where theta_id < 3 group by all")
def whittle_scan_lines(spark, d):
    """Three rows by transforms of lines, the plan of fields too large for a task."""
    return rounded(W.large_values(click(spark, d), GRID, ["field_id"], K.Exponential(), theta_scan(spark, 3)).select("theta_id", "ll"), "ll")


@query(f"{SCAN_SQL}, {PER}, w as (select theta_id, avg(ln(e) + p / e) as ll from p join e using (k0, k1) group by all) select theta_id, {rnd('ll')} as ll from w order by w.ll, theta_id limit 1")
def argmin_theta(spark, d):
    e = S.expected_periodogram(click_kernel(spark, d), GRID, [], K.Exponential(), theta_scan(spark))
    w = L.whittle(click_per(spark, d), e, GRID, [], ["theta_id"])
    return w.agg(F.min(F.struct("ll", "theta_id")).alias("m")).select("m.theta_id", r6("m.ll").alias("ll"))


LOW = "(case when (k0 <= 7 or k0 >= 23) and (k1 <= 6 or k1 >= 18) then 1e0 else 0e0 end)"


def low_pass() -> Column:
    return F.when(((F.col("k0") <= 7) | (F.col("k0") >= 23)) & ((F.col("k1") <= 6) | (F.col("k1") >= 18)), 1.0).otherwise(0.0)


@query(f"{GRAD_SQL}, {PER} select {rnd(f'sum({LOW} * (ln(e) + p / e)) / 720e0')} as ll, {rnd(f'sum({LOW} * (ln(e) + p / e)) / sum({LOW})')} as ll_strict from p join e using (k0, k1)")
def whittle_freq_mask(spark, d):
    e, p = S.expected_periodogram(click_kernel(spark, d), GRID, [], K.Exponential(), EXP), click_per(spark, d)
    a = L.whittle(p, e, GRID, [], [], low_pass())
    b = L.whittle(p, e, GRID, [], [], low_pass(), strict=True)
    return rounded(a.crossJoin(b.withColumnRenamed("ll", "ll_strict")), "ll", "ll_strict")


@query(f"{GRAD_SQL}, {PER} select {rnd('avg(ln(e) + p / e)')} as ll, {rnd('avg((e - p) * de_rho / (e * e))')} as s_rho, {rnd('avg((e - p) * de_sigma / (e * e))')} as s_sigma from p join e using (k0, k1)")
def whittle_score(spark, d):
    return rounded(L.score(click_per(spark, d), click_gradient(spark, d), GRID, [], [], ["rho", "sigma"]), "ll", "s_rho", "s_sigma")


@query(f"{SCAN_SQL}, t as (select k0, k1, e as e_true from e where theta_id = 6) select theta_id, {rnd('sum(ln(e) + e_true / e)')} as ll from e join t using (k0, k1) group by all")
def whittle_expected(spark, d):
    k = click_kernel(spark, d)
    e = S.expected_periodogram(k, GRID, [], K.Exponential(), theta_scan(spark))
    truth = S.expected_periodogram(k, GRID, [], K.Exponential(), EXP).withColumnRenamed("e", "e_true")
    return rounded(L.expected_value(truth, e, GRID, [], ["theta_id"]), "ll")


FISHER_SQL = "h as (select 'rho' as i, 'rho' as j, avg(de_rho * de_rho / (e * e)) as h from e union all select 'rho', 'sigma', avg(de_rho * de_sigma / (e * e)) from e union all select 'sigma', 'rho', avg(de_rho * de_sigma / (e * e)) from e union all select 'sigma', 'sigma', avg(de_sigma * de_sigma / (e * e)) from e)"


@query(f"{GRAD_SQL}, {FISHER_SQL} select i, j, {rnd('h')} as h from h")
def fisher(spark, d):
    return rounded(L.fisher(click_gradient(spark, d), GRID, [], ["rho", "sigma"]), "h")


@query(f"{SCAN_SQL}, {PER} select theta_id, {rnd('sum(power(p / e - 1e0, 2)) / 720e0')} as loss from p join e using (k0, k1) group by all")
def least_squares_objective(spark, d):
    e = S.expected_periodogram(click_kernel(spark, d), GRID, [], K.Exponential(), theta_scan(spark))
    return L.least_squares(click_per(spark, d), e, GRID, [], ["theta_id"]).withColumn("loss", r6(F.col("loss") / 720.0))


@query(f"{SCAN_SQL}, {PER} select theta_id, {rnd('sqrt(avg(p / e))')} as sigma from p join e using (k0, k1) group by all")
def sigma_profile(spark, d):
    e = S.expected_periodogram(click_kernel(spark, d), GRID, [], K.Exponential(), theta_scan(spark))
    return rounded(L.amplitude(click_per(spark, d), e, GRID, [], ["theta_id"]), "sigma")


PAIR_LL = """x as (select k0, k1, max(case when a = 0 and b = 0 then e end) as e00, max(case when a = 1 and b = 1 then e end) as e11, max(case when a = 0 and b = 1 then e end) as er, max(case when a = 0 and b = 1 then e_im end) as ei from e group by all),
y as (select p.k0, p.k1, max(case when p.var = 0 and q.var = 0 then (p.re * q.re + p.im * q.im) / 720e0 end) as p00, max(case when p.var = 1 and q.var = 1 then (p.re * q.re + p.im * q.im) / 720e0 end) as p11,
 max(case when p.var = 0 and q.var = 1 then (p.re * q.re + p.im * q.im) / 720e0 end) as pr, max(case when p.var = 0 and q.var = 1 then (p.im * q.re - p.re * q.im) / 720e0 end) as pi from j p join j q on p.k0 = q.k0 and p.k1 = q.k1 group by all)"""


@query(f"with {Q.PAIR}, {Q.KK}, {PAIR_DFT}, {PAIR_KERNEL}, {pair_ep({'e': FACT})}, {PAIR_LL} select {rnd('avg(ln(e00 * e11 - er * er - ei * ei) + (e11 * p00 + e00 * p11 - 2e0 * (er * pr + ei * pi)) / (e00 * e11 - er * er - ei * ei))')} as ll from x join y using (k0, k1)")
def bivariate_whittle(spark, d):
    return rounded(L.bivariate_whittle(S.cross_periodogram(src.event_pair(spark, d), GRID, []), pair_expected(spark, d), GRID, [], []), "ll")


@query(f"""with {Q.PAIR}, {Q.KK}, {PAIR_DFT}, {PAIR_KERNEL}, rr as (select cast(i as int) as theta_id, -0.9e0 + 0.018e0 * i as r from range(100) t(i)),
e0 as (select a, b, k0, k1, sum(cg * {Q.on_lags(Q.cov('exponential', '1e0', '1e0'))} * cos({Q.LAG_ANGLE})) as e, -sum(cg * {Q.on_lags(Q.cov('exponential', '1e0', '1e0'))} * sin({Q.LAG_ANGLE})) as e_im from cg, kk group by all),
e as (select a, b, k0, k1, e, e_im from e0), {PAIR_LL},
w as (select theta_id, e00, e11, r * er as er, r * ei as ei, p00, p11, pr, pi from x join y using (k0, k1), rr)
select theta_id, {rnd('avg(ln(e00 * e11 - er * er - ei * ei) + (e11 * p00 + e00 * p11 - 2e0 * (er * pr + ei * pi)) / (e00 * e11 - er * er - ei * ei))')} as ll from w group by all""")
def profile_correlation(spark, d):
    """The bivariate value over a table of correlations: one plan."""
    theta = spark.range(100).select(F.col("id").cast("int").alias("theta_id"), (F.lit(-0.9) + 0.018 * F.col("id")).alias("r"), F.lit(1.0).alias("f"), F.lit(1.0).alias("rho"), F.lit(1.0).alias("sigma"))
    pair = src.event_pair(spark, d)
    e = S.expected_bivariate(S.spatial_kernel(pair, GRID, [], variates=True), GRID, [], BI_MODEL, theta)
    return rounded(L.bivariate_whittle(S.cross_periodogram(pair, GRID, []), e, GRID, [], ["theta_id"]), "ll")


@query("with full_model as (select 0.3e0 as r, 1.5e0 as f) select 'r' as i, 'r' as j, round(2 * (1 + r * r) / power(1 - r * r, 2), 6) + 0e0 as h from full_model union all select 'r', 'f', round(-2 * r / (f * (1 - r * r)), 6) + 0e0 from full_model union all select 'f', 'r', round(-2 * r / (f * (1 - r * r)), 6) + 0e0 from full_model union all select 'f', 'f', round(2 * (2 - r * r) / (f * f * (1 - r * r)), 6) + 0e0 from full_model")
def bivariate_fisher(spark, d):
    """On a full grid, where it has a closed form that no grid or base kernel enters."""
    full = S.full_kernel(G.lags(spark, COARSE), COARSE)
    both = full.crossJoin(G.span(G.one_row(spark), a=(0, 1), b=(0, 1)))
    ep = S.expected_bivariate(both, COARSE, [], BI_MODEL, BI, ["r", "f"])
    return rounded(L.bivariate_fisher(ep, COARSE, [], ["r", "f"]), "h")


# ------------------------------------------------------------------ uncertainty, on the coarse grid

COV_DFT = f"""{COARSE_SQL}, ks as (select cast(k0 as int) as k0, cast(k1 as int) as k1 from range(6) x(k0), range(8) y(k1)),
half as (select b.i0 as j0, b.i1 as j1, k0, k1, sum(a.g * b.g * exp(-sqrt(cast((a.i0 - b.i0) * (a.i0 - b.i0) + (a.i1 - b.i1) * (a.i1 - b.i1) as double)) / 2e0) * cos({Q.TAU} * (k0 * a.i0 / 6e0 + k1 * a.i1 / 8e0))) as re,
 -sum(a.g * b.g * exp(-sqrt(cast((a.i0 - b.i0) * (a.i0 - b.i0) + (a.i1 - b.i1) * (a.i1 - b.i1) as double)) / 2e0) * sin({Q.TAU} * (k0 * a.i0 / 6e0 + k1 * a.i1 / 8e0))) as im from m a, m b, ks group by all),
dft as (select h.k0, h.k1, q.k0 as l0, q.k1 as l1, sum(re * cos(t) {{s}} im * sin(t)) / 48e0 as re, sum(im * cos(t) {{o}} re * sin(t)) / 48e0 as im
 from (select h.*, q.k0 as q0, q.k1 as q1, {Q.TAU} * (q.k0 * h.j0 / 6e0 + q.k1 * h.j1 / 8e0) as t from half h, ks q) h join ks q on q.k0 = q0 and q.k1 = q1 group by all)"""
COV_SQL, REL_SQL = COV_DFT.format(s="-", o="+"), COV_DFT.format(s="+", o="-")


def coarse(spark) -> DataFrame:
    return G.cells(spark, COARSE).withColumn("g", checker())


def coarse_dft(spark, relation: bool) -> DataFrame:
    return S.dft_covariance(coarse(spark), COARSE, K.Exponential(), EXP, relation)


@query(f"with {COV_SQL} select k0, k1, l0, l1, {rnd('re')} as re, {rnd('im')} as im from dft")
def dft_cov_matrix(spark, d):
    return rounded(coarse_dft(spark, False), "re", "im")


@query(f"with {REL_SQL} select k0, k1, l0, l1, {rnd('re')} as re, {rnd('im')} as im from dft")
def dft_rel_matrix(spark, d):
    return rounded(coarse_dft(spark, True), "re", "im")


def diagonal(spark, offset: tuple[int, int], relation: bool) -> DataFrame:
    return S.dft_diagonal(coarse(spark), COARSE, K.Exponential(), EXP, offset, relation)


@query(f"with {COV_SQL} select k0, k1, {rnd('re')} as re, {rnd('im')} as im, {rnd('re * re + im * im')} as abs2 from dft where l0 = k0 - 1 and l1 = k1 - 2")
def dft_cov_diagonal(spark, d):
    return rounded(diagonal(spark, (1, 2), False).withColumn("abs2", F.col("re") * F.col("re") + F.col("im") * F.col("im")), "re", "im", "abs2")


@query(f"with {REL_SQL} select k0, k1, {rnd('re')} as re, {rnd('im')} as im, {rnd('re * re + im * im')} as abs2 from dft where k0 + l0 = 3 and k1 + l1 = 4")
def dft_cov_antidiagonal(spark, d):
    return rounded(diagonal(spark, (3, 4), True).withColumn("abs2", F.col("re") * F.col("re") + F.col("im") * F.col("im")), "re", "im", "abs2")


WEIGHT = {"rho": np.fromfunction(lambda a, b: 1 + 0.1 * a + 0.05 * b, (6, 8)), "sigma": np.fromfunction(lambda a, b: 0.5 + 0.02 * a * b, (6, 8))}


@query(f"with {COV_SQL}, w as (select k0, k1, 1e0 + 0.1e0 * k0 + 0.05e0 * k1 as rho, 0.5e0 + 0.02e0 * k0 * k1 as sigma from ks), s as (select re * re + im * im as k2, x.rho as xr, x.sigma as xs, y.rho as yr, y.sigma as ys from dft join w x on x.k0 = dft.k0 and x.k1 = dft.k1 join w y on y.k0 = l0 and y.k1 = l1) select 'rho' as i, 'rho' as j, {rnd('sum(k2 * xr * yr)')} as total from s union all select 'rho', 'sigma', {rnd('sum(k2 * xr * ys)')} from s union all select 'sigma', 'rho', {rnd('sum(k2 * xs * yr)')} from s union all select 'sigma', 'sigma', {rnd('sum(k2 * xs * ys)')} from s")
def exact_summation1(spark, d):
    return rounded(W.exact_sums(spark, COARSE, coarse_mask(), K.Exponential(), EXP, WEIGHT), "total")


@query(f"with {REL_SQL}, w as (select k0, k1, 1e0 + 0.1e0 * k0 + 0.05e0 * k1 as rho from ks), s as (select re * re + im * im as k2, x.rho as xr, y.rho as yr from dft join w x on x.k0 = dft.k0 and x.k1 = dft.k1 join w y on y.k0 = l0 and y.k1 = l1) select 'rho' as i, 'rho' as j, {rnd('sum(k2 * xr * yr)')} as total from s")
def exact_summation2(spark, d):
    return rounded(W.exact_sums(spark, COARSE, coarse_mask(), K.Exponential(), EXP, {"rho": WEIGHT["rho"]}, relation=True), "total")


@query(f"with {COV_SQL} select x.k0, x.k1, x.l0, x.l1, {rnd('(x.re * x.re + x.im * x.im) / (p.re * q.re)')} as k2 from dft x join dft p on p.k0 = x.k0 and p.k1 = x.k1 and p.l0 = x.k0 and p.l1 = x.k1 join dft q on q.k0 = x.l0 and q.k1 = x.l1 and q.l0 = x.l0 and q.l1 = x.l1")
def normalised_matrix(spark, d):
    return rounded(S.correlation_squares(coarse_dft(spark, False), COARSE), "k2")


_RC = "exp(-sqrt(cast(t0 * t0 + t1 * t1 as double)) / 2e0)"
J_SQL = f"""{COV_SQL}, ck as (select a.i0 - b.i0 as t0, a.i1 - b.i1 as t1, sum(a.g * b.g) / 48e0 as cg from m a, m b group by all),
e as (select k0, k1, sum(cg * {_RC} * cos({Q.TAU} * (k0 * t0 / 6e0 + k1 * t1 / 8e0))) as e, sum(cg * sqrt(cast(t0 * t0 + t1 * t1 as double)) / 4e0 * {_RC} * cos({Q.TAU} * (k0 * t0 / 6e0 + k1 * t1 / 8e0))) as d_rho from ck, ks group by all),
w as (select k0, k1, d_rho / (e * e) as wr, 2e0 * e / (e * e) as ws from e),
s as (select re * re + im * im as k2, x.wr as xr, x.ws as xs, y.wr as yr, y.ws as ys from dft join w x on x.k0 = dft.k0 and x.k1 = dft.k1 join w y on y.k0 = l0 and y.k1 = l1),
jj as (select 2e0 / 2304e0 * sum(k2 * xr * yr) as rr, 2e0 / 2304e0 * sum(k2 * xr * ys) as rs, 2e0 / 2304e0 * sum(k2 * xs * ys) as ss from s)"""


@query(f"with {J_SQL} select 'rho' as i, 'rho' as j, {rnd('rr')} as value from jj union all select 'rho', 'sigma', {rnd('rs')} from jj union all select 'sigma', 'rho', {rnd('rs')} from jj union all select 'sigma', 'sigma', {rnd('ss')} from jj")
def jmatrix(spark, d):
    return rounded(W.jmatrix(spark, COARSE, coarse_mask(), K.Exponential(), EXP, ["rho", "sigma"]), "value")


@query(f"""with {J_SQL}, hh as (select avg(d_rho * d_rho / (e * e)) as a, avg(d_rho * 2e0 * e / (e * e)) as b, avg(4e0 * e * e / (e * e)) as c from e), inv as (select c / (a * c - b * b) as p, -b / (a * c - b * b) as q, a / (a * c - b * b) as r from hh)
select 'rho' as i, 'rho' as j, {rnd('p * (rr * p + rs * q) + q * (rs * p + ss * q)')} as value from jj, inv union all select 'rho', 'sigma', {rnd('p * (rr * q + rs * r) + q * (rs * q + ss * r)')} from jj, inv
union all select 'sigma', 'rho', {rnd('p * (rr * q + rs * r) + q * (rs * q + ss * r)')} from jj, inv union all select 'sigma', 'sigma', {rnd('q * (rr * q + rs * r) + r * (rs * q + ss * r)')} from jj, inv""")
def sandwich(spark, d):
    """Covariance of the estimates: a 2 x 2 product on the driver."""
    names = ["rho", "sigma"]
    j = {(r["i"], r["j"]): r["value"] for r in W.jmatrix(spark, COARSE, coarse_mask(), K.Exponential(), EXP, names).collect()}
    f = arrays.Field(np.zeros(COARSE.shape), coarse_mask())
    e, de = f.e(K.Exponential(), EXP), f.de(K.Exponential(), EXP, names)
    h = np.array([[np.mean(a * b / e**2) for b in de] for a in de])
    out = W.sandwich(h, np.array([[j[a, b] for b in names] for a in names]))
    return rounded(spark.createDataFrame([(a, b, float(out[x, y])) for x, a in enumerate(names) for y, b in enumerate(names)], "i string, j string, value double"), "value")


def sampled_jmatrix(spark, d):
    return W.jmatrix_sample(spark, G.GridSpec((16, 16)), np.ones((16, 16)), K.Exponential(), EXP, ["rho", "sigma"], 1000, 3)


query(name="jmatrix_sample")(sampled_jmatrix)


@query()
def jmatrix_sample_bivariate(spark, d):
    return W.jmatrix_sample_bivariate(spark, G.GridSpec((16, 16)), K.BivariateUniform(K.Exponential()), {"r": 0.3, "f": 1.5, "rho": 2.0, "sigma": 1.0}, ["r", "f"], 400, 3)


# ------------------------------------------------------------------ diagnostics, tests, interpolation


def residuals(spark, d) -> DataFrame:
    return L.residuals(click_per(spark, d), S.expected_periodogram(click_kernel(spark, d), GRID, [], K.Exponential(), EXP), GRID, [])


EXP_E = f"e as ({Q.ep_of({'e': Q.cov('exponential', '2e0', '1e0')})})"


@query(f"{BASE}, {PER}, {EXP_E} select k0, k1, {rnd('1e0 - exp(-p / e)')} as u from p join e using (k0, k1)")
def gof_residuals(spark, d):
    return rounded(residuals(spark, d), "u")


@query(f"{BASE}, {PER}, {EXP_E}, u as (select least(cast(floor((1e0 - exp(-p / e)) * 10e0) as int), 9) as bin from p join e using (k0, k1)), n as (select bin, count(*) as n from u group by all), t as (select max(bin) + 1 as bins from n) select cast(bins as int) as bins, {rnd('sum(power(n - 720e0 / bins, 2) / (720e0 / bins)) + (bins - count(*)) * 720e0 / bins')} as statistic from n, t group by bins")
def gof_chi2(spark, d):
    return rounded(L.chi_square(residuals(spark, d), []), "statistic")


GOF_SQL = ORACLE_SQL["gof_chi2"].replace("select cast(bins as int) as bins, ", "select ")


@query(GOF_SQL)
def gof_statistic(spark, d):
    """The same statistic as the simulation test has it, inside a task."""
    return rounded(W.gof_pvalue(click(spark, d), GRID, ["field_id"], K.Exponential(), EXP, 1).select("statistic"), "statistic")


@query()
def gof_pvalue(spark, d):
    return W.gof_pvalue(click(spark, d), GRID, ["field_id"], K.Exponential(), EXP, 200)


@query()
def generalized_chi2(spark, d):
    return W.generalized_chi2(spark, [1.0, 0.5, 0.25], 3.0)


@query()
def likelihood_ratio_test(spark, d):
    """Unit amplitude against a free one, on all days and hours of each event type."""
    return W.likelihood_ratio(src.event_fields(spark, d), GRID, ["field_id"], K.Exponential().bound("rho", 0.05, 10), {"sigma": 1.0})


@query(f"""with {Q.CLICK}, {Q.CELLS}, miss as (select i0, i1 from cells where not exists (select 1 from c where c.i0 = cells.i0 and c.i1 = cells.i1)),
q as (select miss.i0, miss.i1, l.z as zl, r.z as zr from miss join c l on l.i0 = miss.i0 and l.i1 = miss.i1 - 1 join c r on r.i0 = miss.i0 and r.i1 = miss.i1 + 1)
select i0, i1, {rnd('exp(-0.5e0) * (zl + zr) / (1e0 + exp(-1e0))')} as mean from q""")
def kriging_two_neighbours(spark, d):
    """A missing hour from the hours around it."""
    field = click(spark, d).select("i0", "i1", "z")
    miss = G.missing_cells(field, GRID).withColumn("pt_id", (F.col("i0") * 24 + F.col("i1")).cast("long"))
    around = [miss.join(field.select("i0", (F.col("i1") - s).alias("i1"), F.col("z").alias("y")), ["i0", "i1"]).select("pt_id", F.lit(float(s)).alias("x0"), "y") for s in (-1, 1)]
    points = around[0].union(around[1]).withColumnRenamed("pt_id", "cell")
    whole = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("cell")
    out = W.krige(points.join(whole, "cell"), whole.select("cell", F.col("cell").alias("pt_id"), F.lit(0.0).alias("x0")), ["cell"], 1, K.Exponential(), EXP)
    return out.select(F.floor(F.col("pt_id") / 24).cast("int").alias("i0"), F.pmod("pt_id", F.lit(24)).cast("int").alias("i1"), r6("mean").alias("mean"))


@query()
def kriging_full(spark, d):
    field = src.event_fields(spark, d)
    x = [F.col("i0").cast("double").alias("x0"), F.col("i1").cast("double").alias("x1")]
    miss = G.missing_cells(field, GRID, field.select("field_id").distinct())
    obs = field.select("field_id", *x, F.col("z").alias("y"))
    return W.krige(obs, miss.select("field_id", (F.col("i0") * 24 + F.col("i1")).cast("long").alias("pt_id"), *x), ["field_id"], 2, K.Nugget(K.Exponential()), EXP | {"nugget": 0.1})


# ------------------------------------------------------------------ simulation and fits


@query()
def simulate_field(spark, d):
    return W.simulate(spark, GRID, K.Exponential(), EXP, 8, 11)


@query()
def whittle_simulated_512(spark, d):
    """Likelihood evaluations on a 512 x 512 grid, range 5: one a field."""
    return W.simulated_values(spark, G.GridSpec((512, 512)), K.Exponential(), {"rho": 5.0, "sigma": 1.0}, {"rho": 5.0, "sigma": 1.0}, 8, 3)


@query()
def simulate_bivariate(spark, d):
    return W.simulate_bivariate(spark, GRID, K.BivariateUniform(K.SquaredExponential()), {"r": 0.4, "f": 1.5, "rho": 3.0, "sigma": 1.0}, 4, 5)


@query()
def simulate_separable(spark, d):
    return W.simulate_separable(spark, GRID, K.Separable((K.Exponential(), K.Exponential())), {"m0_rho": 3.0, "m0_sigma": 1.0, "m1_rho": 2.0, "m1_sigma": 1.0}, 4, 5)


@query(f"with l as (select k0, k1, sum(exp(-sqrt(cast(t0 * t0 + t1 * t1 as double)) / 2e0) * cos({Q.TAU} * (k0 * t0 / 11e0 + k1 * t1 / 15e0))) as lam from range(-5, 6) x(t0), range(-7, 8) y(t1), range(11) u(k0), range(15) w(k1) group by all) select {rnd('min(lam)')} as least from l")
def embedding_spectrum_min(spark, d):
    torus = G.GridSpec((11, 15))
    cov = S.autocovariance(G.lags(spark, COARSE), COARSE, K.Exponential(), EXP)
    out = S.dft(cov, [], {"t0": ("k0", 11, 11), "t1": ("k1", 15, 15)}, F.col("c"))
    assert torus.n_points == 165
    return out.agg(r6(F.min("re")).alias("least"))


VECTOR, LINE = G.GridSpec((64,)), K.Exponential().bound("rho", 0.05, 50)


@query()
def fit_events(spark, d):
    return W.fit(src.event_fields(spark, d), GRID, ["field_id"], K.Exponential().bound("rho", 0.05, 50))


@query()
def fit_events_least_squares(spark, d):
    return W.fit(src.event_fields(spark, d), GRID, ["field_id"], K.Exponential().bound("rho", 0.05, 50), method="least-squares")


@query()
def fit_all_embeddings(spark, d):
    return W.fit_vectors(src.vectors(spark, d), VECTOR, ["vec_id"], LINE)


# ------------------------------------------------------------------ statements about results that SQL cannot compute

TYPES = "(select distinct event_type as field_id from events)"


@query(f"select field_id, true as converged, true as least from {TYPES}")
def fit_events_least(spark, d):
    """Each fit has a value no larger than at parameters one percent around it, as the scan has them."""
    field, fits = src.event_fields(spark, d), fit_events(spark, d)
    near = [(0.0, 0.0), (0.01, 0.0), (-0.01, 0.0), (0.0, 0.01), (0.0, -0.01)]
    rows = fits.select("field_id", "converged", "theta", F.posexplode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in near))).alias("i", "by"))
    # at its bound a parameter does not go on
    rho = F.least(F.greatest(F.col("theta")["rho"] * (1 + F.col("by.a")), F.lit(0.050001)), F.lit(49.999999))
    theta = rows.select(F.struct("field_id", "i").alias("theta_id"), rho.alias("rho"), (F.col("theta")["sigma"] * (1 + F.col("by.b"))).alias("sigma"))
    ll = W.scan(field, GRID, ["field_id"], K.Exponential(), theta.withColumn("theta_id", F.concat_ws("|", "theta_id.field_id", "theta_id.i")))
    own = ll.where(F.substring_index("theta_id", "|", 1) == F.col("field_id")).groupBy("field_id").agg(F.max(F.when(F.col("theta_id").endswith("|0"), F.col("ll"))).alias("at"), F.min("ll").alias("low"))
    return own.join(fits.select("field_id", "converged"), "field_id").select("field_id", "converged", (F.col("at") <= F.col("low") + 1e-9).alias("least"))


METHODS = ["nelder-mead", "evolution", "annealing", "direct"]


@query(f"select m as method, field_id, true as no_worse from {TYPES}, (values {', '.join(f'({m!r})' for m in METHODS)}) t(m)")
def fit_searches_no_worse(spark, d):
    """No optimiser ends above the value that the gradient method finds from its fixed start; where there are several minima a search may
    end below it."""
    field, kernel = src.event_fields(spark, d), LINE.bound("sigma", 0.01, 20)
    first = W.fit(field, GRID, ["field_id"], kernel).select("field_id", F.col("ll").alias("best"))
    out = None
    for m in METHODS:
        one = W.fit(field, GRID, ["field_id"], kernel, method=m).select(F.lit(m).alias("method"), "field_id", "ll")
        out = one if out is None else out.union(one)
    return out.join(first, "field_id").select("method", "field_id", (F.col("ll") <= F.col("best") + 1e-5).alias("no_worse"))


@query("select vec_id, true as improved from embeddings")
def fit_embeddings_improve(spark, d):
    """No fit is worse than its start, whose values come from relational sums."""
    e = S.expected_periodogram(S.full_kernel(G.lags(spark, VECTOR), VECTOR), VECTOR, [], K.Exponential(), {"rho": 1.0, "sigma": 1.0})
    per = S.periodogram(src.vector_fields(spark, d), VECTOR, ["vec_id"])
    start = per.join(F.broadcast(e), "k0").groupBy("vec_id").agg(F.avg(L.whittle_term()).alias("start"))
    return fit_all_embeddings(spark, d).join(start, "vec_id").select("vec_id", (F.col("converged") & (F.col("ll") <= F.col("start") + 1e-9)).alias("improved"))


@query(f"select field_id, true as positive, true as symmetric from {TYPES}")
def fit_covariances(spark, d):
    """Estimator covariances from the fits themselves: positive and symmetric."""
    out = W.fit(src.event_fields(spark, d), GRID, ["field_id"], LINE, covariance=True)
    c = F.col("covariance")
    return out.select("field_id", ((c["rho|rho"] > 0) & (c["rho|rho"] * c["sigma|sigma"] > c["rho|sigma"] * c["rho|sigma"])).alias("positive"), (F.abs(c["rho|sigma"] - c["sigma|rho"]) <= 1e-6 * F.sqrt(c["rho|rho"] * c["sigma|sigma"])).alias("symmetric"))


PAIR_MODEL = K.BivariateUniform(K.Exponential().bound("rho", 0.05, 50)).bound("f", 0.05, 20)


@query("select true as converged, true as stationary, true as improved")
def fit_pair(spark, d):
    """The bivariate fit of clicks and views: converged, without a slope, no worse than its start."""
    pair = src.event_pair(spark, d)
    start = L.bivariate_whittle(S.cross_periodogram(pair, GRID, []), S.expected_bivariate(S.spatial_kernel(pair, GRID, [], variates=True), GRID, [], PAIR_MODEL, {"r": 0.0, "f": 1.0, "rho": 1.0, "sigma": 1.0}), GRID, [], []).withColumnRenamed("ll", "start")
    out = W.fit_several(pair, GRID, [], PAIR_MODEL).crossJoin(F.broadcast(start))  # a row each
    return out.select("converged", (F.col("score") < 1e-4).alias("stationary"), (F.col("ll") <= F.col("start") + 1e-9).alias("improved"))


SIDE = G.GridSpec((16, 16))


@query("select i, j, true as close from (values ('rho'), ('sigma')) a(i), (values ('rho'), ('sigma')) b(j)")
def jmatrix_sample_close(spark, d):
    """The sampled score covariance against the exact one, within a quarter."""
    exact = W.jmatrix(spark, SIDE, np.ones(SIDE.shape), K.Exponential(), EXP, ["rho", "sigma"]).withColumnRenamed("value", "exact")
    return sampled_jmatrix(spark, d).join(exact, ["i", "j"]).select("i", "j", (F.abs(F.col("value") / F.col("exact") - 1) < 0.25).alias("close"))


@query("select i, j, true as close from (values ('f'), ('r')) a(i), (values ('f'), ('r')) b(j)")
def jmatrix_sample_pair_close(spark, d):
    """On a full grid and nearly without correlation in space, so that frequencies are independent, the sampled score covariance of the
    correlation and scale is near 2 / N times their information (frequencies come in pairs)."""
    t = {"r": 0.3, "f": 1.5}
    r, f, n = t["r"], t["f"], SIDE.n_points
    want = {("r", "r"): 2 * (1 + r * r) / (1 - r * r) ** 2, ("r", "f"): -2 * r / (f * (1 - r * r)), ("f", "r"): -2 * r / (f * (1 - r * r)), ("f", "f"): 2 * (2 - r * r) / (f * f * (1 - r * r))}
    known = spark.createDataFrame([(a, b, 2 * v / n, 2 * math.sqrt(want[a, a] * want[b, b]) / n) for (a, b), v in want.items()], "i string, j string, want double, scale double")
    got = W.jmatrix_sample_bivariate(spark, SIDE, K.BivariateUniform(K.Exponential()), t | {"rho": 0.3, "sigma": 1.0}, ["r", "f"], 1000, 3)
    return got.join(known, ["i", "j"]).select("i", "j", (F.abs(F.col("value") - F.col("want")) < 0.25 * F.col("scale")).alias("close"))


@query("select cast(46080 as bigint) as n, true as unit_variance, true as correlated")
def simulated_moments(spark, d):
    """64 simulated fields: variance 1 and the correlation of neighbours."""
    z = W.simulate(spark, GRID, K.Exponential(), EXP, 64, 11)
    beside = z.select("sim_id", "i0", (F.col("i1") - 1).alias("i1"), F.col("z").alias("y"))
    m = z.join(beside, ["sim_id", "i0", "i1"], "left").agg(F.count("z").alias("n"), F.avg(F.col("z") * F.col("z")).alias("v"), F.avg(F.col("z") * F.col("y")).alias("c"))
    return m.select("n", (F.abs(F.col("v") - 1) < 0.06).alias("unit_variance"), (F.abs(F.col("c") - math.exp(-0.5)) < 0.06).alias("correlated"))


@query("select cast(v as int) as var, cast(46080 as bigint) as n, true as variance from range(2) t(v)")
def simulated_pair_moments(spark, d):
    z = W.simulate_bivariate(spark, GRID, K.BivariateUniform(K.Exponential()), {"r": 0.4, "f": 1.5, "rho": 2.0, "sigma": 1.0}, 64, 5)
    m = z.groupBy("var").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("z") * F.col("z")).alias("v"))
    return m.select("var", "n", (F.abs(F.col("v") / F.when(F.col("var") == 0, 1.0).otherwise(2.25) - 1) < 0.08).alias("variance"))


@query("select cast(v as int) as var, true as unit_mean, cast(720 as bigint) as cells from range(2) t(v)")
def simulated_pair_spectra(spark, d):
    """Periodic fields by their transforms: over many fields, squared transforms at a frequency have the torus's spectrum as mean."""
    t = {"r": 0.4, "f": 1.5, "rho": 2.0, "sigma": 1.0}
    out = W.simulate_bivariate(spark, GRID, K.BivariateUniform(K.Exponential()), t, 64, 6, periodic=True, spectral=True)
    lam = np.maximum(np.fft.fftn(K.Exponential().cov(arrays.torus_lags(GRID.shape), EXP)).real, 0)
    spectrum = spark.createDataFrame([(int(a), int(b), float(lam[a, b])) for a, b in np.ndindex(*GRID.shape)], "k0 int, k1 int, lam double")
    p = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("lam") * F.when(F.col("var") == 0, 1.0).otherwise(2.25))
    return out.join(spectrum, ["k0", "k1"]).groupBy("var").agg((F.abs(F.avg(p) - 1) < 0.03).alias("unit_mean"), F.countDistinct("k0", "k1").alias("cells"))


@query("select true as variance, cast(46080 as bigint) as n")
def simulated_separable_moments(spark, d):
    z = W.simulate_separable(spark, GRID, K.Separable((K.Exponential(), K.Exponential())), {"m0_rho": 3.0, "m0_sigma": 1.0, "m1_rho": 2.0, "m1_sigma": 1.0}, 64, 5)
    return z.agg((F.abs(F.avg(F.col("z") * F.col("z")) - 1) < 0.1).alias("variance"), F.count(F.lit(1)).alias("n"))


@query("select cast(64 as bigint) as n, true as expected")
def whittle_simulated_expected(spark, d):
    """Mean value of simulated fields at the truth: one more than the mean log of the expected periodogram."""
    grid, t = G.GridSpec((64, 64)), {"rho": 5.0, "sigma": 1.0}
    e = S.expected_periodogram(S.full_kernel(G.lags(spark, grid), grid), grid, [], K.Exponential(), t).agg(F.avg(F.log("e")).alias("log_e"))
    return W.simulated_values(spark, grid, K.Exponential(), t, t, 64, 3).crossJoin(F.broadcast(e)).agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("ll") - F.max("log_e") - 1) < 0.01).alias("expected"))


@query("select true as p_value, true as q95")
def generalized_chi2_known(spark, d):
    """One weight: a chi-square of one degree."""
    out = W.generalized_chi2(spark, [1.0], 3.841459, 20_000)
    return out.select((F.abs(F.col("p_value") - 0.05) < 0.01).alias("p_value"), (F.abs(F.col("q95") - 3.841459) < 0.3).alias("q95"))


@query(f"select field_id, true as gains, true as share, true as verdict from {TYPES}")
def likelihood_ratio_sound(spark, d):
    """The larger model is never worse, and the verdict is the p-value's."""
    out = likelihood_ratio_test(spark, d)
    return out.select("field_id", (F.col("lkh_ratio") > -1e-6).alias("gains"), F.col("p_value").between(0, 1).alias("share"), (F.col("test_result") == (F.col("p_value") > 0.05)).alias("verdict"))


@query(ORACLE_SQL["embedding_spectrum_min"])
def embedding_least(spark, d):
    """The same least eigenvalue as the sampler's own check has it."""

    def run(batches):
        for _ in batches:
            yield pd.DataFrame({"least": [arrays.embedding(K.Exponential(), EXP, COARSE.shape, approximate=True)[1]]})

    return rounded(spark.range(1, numPartitions=1).mapInPandas(run, "least double"), "least")


@query(f"{GRAD_SQL}, {PER} select {rnd(f'sum({LOW} * (e - p) * de_rho / (e * e)) / 720e0')} as s_rho, {rnd(f'sum({LOW} * (e - p) * de_sigma / (e * e)) / 720e0')} as s_sigma from p join e using (k0, k1)")
def whittle_masked_score(spark, d):
    return rounded(L.score(click_per(spark, d), click_gradient(spark, d), GRID, [], [], ["rho", "sigma"], low_pass()).select("s_rho", "s_sigma"), "s_rho", "s_sigma")


@query("select name, true as matches from (values ('r'), ('f'), ('rho'), ('sigma')) t(name)")
def bivariate_score(spark, d):
    """Slopes of the bivariate value against differences of values."""
    names, h = ["r", "f", "rho", "sigma"], 1e-5
    pair, t = src.event_pair(spark, d), {"r": 0.3, "f": 1.5, "rho": 2.0, "sigma": 1.0}
    kernel, cross = S.spatial_kernel(pair, GRID, [], variates=True), S.cross_periodogram(pair, GRID, [])
    model = K.BivariateUniform(K.Exponential())
    rows = [(f"{n}{s}", *(v + (h if k == n else 0) * (1 if s == "+" else -1) for k, v in t.items())) for n in names for s in "+-"]
    ll = L.bivariate_whittle(cross, S.expected_bivariate(kernel, GRID, [], model, spark.createDataFrame(rows, "theta_id string, r double, f double, rho double, sigma double")), GRID, [], ["theta_id"])
    slope = L.bivariate_whittle(cross, S.expected_bivariate(kernel, GRID, [], model, t, names), GRID, [], [], names)
    by = ll.groupBy(F.expr("substring(theta_id, 1, length(theta_id) - 1)").alias("name")).agg(((F.max(F.when(F.col("theta_id").endswith("+"), F.col("ll"))) - F.max(F.when(F.col("theta_id").endswith("-"), F.col("ll")))) / (2 * h)).alias("change"))
    long = slope.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"s_{n}").alias("s")) for n in names))).alias("x")).select("x.*")
    return by.join(long, "name").select("name", (F.abs(F.col("change") - F.col("s")) < 1e-5 * (1 + F.abs("s"))).alias("matches"))


SLOPES = {
    "anisotropic": K.Anisotropic(K.Exponential()), "anisotropic_sum": K.Anisotropic(K.Sum((K.Exponential(), K.Matern32()))), "anisotropic_nugget": K.Anisotropic(K.Nugget(K.SquaredExponential())),
    "nested": K.Nugget(K.Sum((K.Matern52(), K.RationalQuadratic()))), "separable": K.Separable((K.Matern32(), K.SquaredExponential())),
}
SLOPE_ROWS = [(n, p.name) for n, k in SLOPES.items() for p in k.params]


@query("select kernel, parameter, true as matches from (values " + ", ".join(str(x) for x in SLOPE_ROWS) + ") t(kernel, parameter)")
def kernel_slopes(spark, d):
    """Every slope of composed kernels against differences, on lags, as columns."""
    lags, h, out = on_lags(spark), 1e-6, None
    for name, kernel in SLOPES.items():
        t = {p.name: 0.7 + 0.1 * i if p.name.split("_")[-1] not in ("nugget", "phi") else 0.2 for i, p in enumerate(kernel.params)}
        col = lambda **more: {k: F.lit(float(v)) for k, v in (t | more).items()}  # noqa: B023, E731
        at = [F.col("h0"), F.col("h1")]
        checks = [F.max(F.abs(kernel.grad(at, col(), p.name) - (kernel.cov(at, col(**{p.name: t[p.name] + h})) - kernel.cov(at, col(**{p.name: t[p.name] - h}))) / (2 * h))).alias(p.name) for p in kernel.params]
        one = lags.agg(*checks).select(F.explode(F.array(*(F.struct(F.lit(name).alias("kernel"), F.lit(p.name).alias("parameter"), (F.col(p.name) < 1e-6).alias("matches")) for p in kernel.params))).alias("x")).select("x.*")
        out = one if out is None else out.union(one)
    return out


def _parameters() -> list[tuple]:
    k = (K.RationalQuadratic().bound("rho", 0.5, 8).tie("alpha", "rho") + K.Nugget(K.Exponential()).fix("nugget", 0.25))
    whole = k.theta([2.0, 1.5, 3.0, 4.0])
    return [(p.name, float(p.default), whole[p.name], p.free, float(p.low), -1.0 if math.isinf(p.high) else float(p.high), -1.0 if p.fixed is None else p.fixed, p.link or "") for p in k.params]


@query("""select * from (values ('m0_rho', 1e0, 2e0, true, 5e-1, 8e0, -1e0, ''), ('m0_alpha', 1e0, 2e0, false, 0e0, -1e0, -1e0, 'm0_rho'), ('m0_sigma', 1e0, 1.5e0, true, 0e0, -1e0, -1e0, ''),
('m1_nugget', 0e0, 2.5e-1, false, 0e0, 1e0, 2.5e-1, ''), ('m1_rho', 1e0, 3e0, true, 0e0, -1e0, -1e0, ''), ('m1_sigma', 1e0, 4e0, true, 0e0, -1e0, -1e0, '')) t(name, start, value, free, low, high, fixed, link)""")
def kernel_parameters(spark, d):
    """Declared, bounded, tied and fixed parameters of a sum, and the mapping that a vector of the free ones gives; -1 where there is no
    upper bound or fixed value."""
    return spark.createDataFrame(_parameters(), "name string, start double, value double, free boolean, low double, high double, fixed double, link string")


@query("select cast(720 as bigint) as n_points, cast(30 as double) as extent0, cast(12 as double) as extent1, cast(24 as bigint) as n_line, cast(720 as bigint) as full_cells")
def grid_facts(spark, d):
    """Numbers of a grid, of one of its axes taken apart, and its full mask."""
    grid = G.GridSpec((30, 24), (1.0, 0.5))
    line = grid.separate([1])
    full = G.check_mask(G.cells(spark, grid).withColumn("g", G.full_mask()), grid).agg(F.sum("g").cast("long").alias("full_cells"))
    return full.select(F.lit(grid.n_points).cast("long").alias("n_points"), F.lit(grid.extent[0]).alias("extent0"), F.lit(grid.extent[1]).alias("extent1"), F.lit(line.n_points).cast("long").alias("n_line"), "full_cells")
