"""SQL (DuckDB) for the registered queries, in direct sums: no transform by axes, no folding, no closed kernels."""

from __future__ import annotations

TAU = "2e0 * pi()"


def rnd(x: str) -> str:
    return f"round({x}, 6) + 0e0"


EVENTS = """
b as (select event_type as field_id, cast(date_diff('day', timestamp '2024-01-01', date_trunc('day', ts)) as int) as i0,
             cast(extract(hour from ts) as int) as i1, value from events),
raw as (select field_id, i0, i1, avg(value) as z, count(*) as n from b where i0 between 0 and 29 group by all),
st as (select field_id, avg(z) as m, stddev_pop(z) as s from raw group by all),
f as (select field_id, i0, i1, (z - m) / s as z, 1e0 as g from raw join st using (field_id))"""

CLICK = EVENTS + ",\nc as (select i0, i1, z, g from f where field_id = 'click')"
PAIR = EVENTS + ",\nv as (select case field_id when 'click' then 0 else 1 end as var, i0, i1, z, g from f where field_id in ('click', 'view'))"
KK = "kk as (select cast(k0 as int) as k0, cast(k1 as int) as k1 from range(30) x(k0), range(24) y(k1))"
CELLS = "cells as (select cast(i0 as int) as i0, cast(i1 as int) as i1 from range(30) x(i0), range(24) y(i1))"
LAGS = "lags as (select cast(t0 as int) as t0, cast(t1 as int) as t1 from range(-29, 30) x(t0), range(-23, 24) y(t1))"
HANN = "(0.5e0 - 0.5e0 * cos(2e0 * pi() * i0 / 29e0)) * (0.5e0 - 0.5e0 * cos(2e0 * pi() * i1 / 23e0))"
ANGLE = f"{TAU} * (((k0 * i0) % 30) / 30e0 + ((k1 * i1) % 24) / 24e0)"
LAG_ANGLE = f"{TAU} * (k0 * t0 / 30e0 + k1 * t1 / 24e0)"


def kernel_of(source: str, weight: str = "g") -> str:
    return f"select a.i0 - b.i0 as t0, a.i1 - b.i1 as t1, sum(a.w * b.w) / 720e0 as cg from (select i0, i1, {weight} as w from {source}) a, (select i0, i1, {weight} as w from {source}) b group by all"


def per_of(source: str = "c", weight: str = "1e0", extra: str = "") -> str:
    e = f"{extra}, " if extra else ""
    return f"select {e}k0, k1, (power(sum(z * w * cos(a)), 2) + power(sum(z * w * sin(a)), 2)) / 720e0 as p from (select {e}k0, k1, z, {weight} as w, {ANGLE} as a from {source}, kk) group by all"


R = "sqrt(cast(h0 * h0 + h1 * h1 as double))"


def cov(name: str, rho: str = "rho", sigma: str = "sigma", alpha: str = "alpha", r: str = R) -> str:
    u3, u5 = f"(sqrt(3e0) * {r} / {rho})", f"(sqrt(5e0) * {r} / {rho})"
    return {
        "exponential": f"{sigma} * {sigma} * exp(-{r} / {rho})",
        "squared": f"{sigma} * {sigma} * exp(-power({r}, 2) / (2e0 * {rho} * {rho}))",
        "matern32": f"{sigma} * {sigma} * (1e0 + {u3}) * exp(-{u3})",
        "matern52": f"{sigma} * {sigma} * (1e0 + {u5} + power({u5}, 2) / 3e0) * exp(-{u5})",
        "rational": f"{sigma} * {sigma} * power(1e0 + power({r}, 2) / (2e0 * {rho} * {rho} * {alpha}), -{alpha})",
    }[name]


def slope(name: str, by: str, rho: str = "rho", sigma: str = "sigma", alpha: str = "alpha", r: str = R) -> str:
    """The derivative of cov(name) by a parameter."""
    if by == "sigma":
        return f"2e0 * ({cov(name, rho, sigma, alpha, r)}) / {sigma}"
    u5 = f"(sqrt(5e0) * {r} / {rho})"
    a = f"(1e0 + power({r}, 2) / (2e0 * {rho} * {rho} * {alpha}))"
    s2 = f"{sigma} * {sigma}"
    return {
        ("exponential", "rho"): f"{s2} * {r} / power({rho}, 2) * exp(-{r} / {rho})",
        ("squared", "rho"): f"{s2} * power({r}, 2) / power({rho}, 3) * exp(-power({r}, 2) / (2e0 * {rho} * {rho}))",
        ("matern32", "rho"): f"3e0 * {s2} * power({r}, 2) / power({rho}, 3) * exp(-sqrt(3e0) * {r} / {rho})",
        ("matern52", "rho"): f"{s2} * power({u5}, 2) * (1e0 + {u5}) * exp(-{u5}) / (3e0 * {rho})",
        ("rational", "rho"): f"{s2} * power({r}, 2) / power({rho}, 3) * power({a}, -{alpha} - 1e0)",
        ("rational", "alpha"): f"{s2} * power({a}, -{alpha}) * (power({r}, 2) / (2e0 * {rho} * {rho} * {alpha} * {a}) - ln({a}))",
    }[name, by]


def on_lags(expr: str) -> str:
    """An expression of h0, h1 on lags t0, t1 of unit steps."""
    return expr.replace("h0", "t0").replace("h1", "t1")


def ep_of(values: dict[str, str], kernel: str = "cg", by: str = "", angle: str = LAG_ANGLE, freqs: str = "kk") -> str:
    """Direct expected periodogram of expressions of t0, t1 (and a theta table in `by`)."""
    e = f"{by}, " if by else ""
    source = f"{kernel} x, {freqs}" + (", th" if by else "")
    sums = ", ".join(f"sum(cg * ({on_lags(v)}) * cos({angle})) as {n}" for n, v in values.items())
    return f"select {e}k0, k1, {sums} from {source} group by all"
