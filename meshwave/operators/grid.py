"""Grids as tables: cells, masks, points, lags and frequencies of up to three (or more) axes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """Shape, step and number of variates of a regular grid."""

    shape: tuple[int, ...]
    delta: tuple[float, ...] = ()
    nvars: int = 1

    def __post_init__(self):
        object.__setattr__(self, "shape", tuple(int(n) for n in self.shape))
        object.__setattr__(self, "delta", tuple(float(d) for d in self.delta) or (1.0,) * len(self.shape))
        if len(self.delta) != len(self.shape) or min(self.shape, default=0) < 1 or min(self.delta) <= 0 or self.nvars < 1:
            raise ValueError(f"not a grid: {self}")

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def n_points(self) -> int:
        return math.prod(self.shape)

    @property
    def extent(self) -> tuple[float, ...]:
        return tuple(n * d for n, d in zip(self.shape, self.delta, strict=True))

    @property
    def image_extent(self) -> tuple[float, ...]:
        return tuple(x for e in self.extent for x in (0.0, e))

    def axes(self, name: str) -> list[str]:
        return [f"{name}{a}" for a in range(self.ndim)]

    def separate(self, dims: list[int]) -> GridSpec:
        """The grid along these axes; the others have one cell."""
        return GridSpec(tuple(n if a in dims else 1 for a, n in enumerate(self.shape)), self.delta, self.nvars)


def span(df: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """df with a column for each name, over all combinations of the inclusive integer ranges."""
    for name, (lo, hi) in ranges.items():
        df = df.withColumn(name, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return df


def one_row(spark: SparkSession) -> DataFrame:
    return spark.range(1).drop("id")


def cells(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """i0, i1, ...: all cells."""
    return span(one_row(spark), **{f"i{a}": (0, n - 1) for a, n in enumerate(grid.shape)})


def points(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """Cells with their places x0, x1, ..."""
    return cells(spark, grid).withColumns({f"x{a}": F.col(f"i{a}") * F.lit(d) for a, d in enumerate(grid.delta)})


def lags(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """t0, t1, ... from -(n - 1) to n - 1, and h0, h1, ...: times the step."""
    out = span(one_row(spark), **{f"t{a}": (1 - n, n - 1) for a, n in enumerate(grid.shape)})
    return out.withColumns({f"h{a}": F.col(f"t{a}") * F.lit(d) for a, d in enumerate(grid.delta)})


def frequency(k: Column, n: int, delta: float) -> Column:
    """Cycles a unit of the k-th frequency of n, negative ones in the upper half."""
    return F.when(k < (n + 1) // 2, k).otherwise(k - n) / F.lit(n * delta)


def frequencies(spark: SparkSession, grid: GridSpec, doubled: bool = False) -> DataFrame:
    """k0, ... and f0, ...; doubled: on the 2 n - 1 lags."""
    sizes = [2 * n - 1 if doubled else n for n in grid.shape]
    out = span(one_row(spark), **{f"k{a}": (0, n - 1) for a, n in enumerate(sizes)})
    return out.withColumns({f"f{a}": frequency(F.col(f"k{a}"), n, d) for a, (n, d) in enumerate(zip(sizes, grid.delta, strict=True))})


def lag_matrix(points_a: DataFrame, points_b: DataFrame, ndim: int) -> DataFrame:
    """All pairs of two small point tables (a_id, x0..; b_id, x0..): h0, ... = a - b. Output is the product of the sizes by its nature."""
    a = points_a.select(F.col("pt_id").alias("a_id"), *(F.col(f"x{d}").alias(f"_a{d}") for d in range(ndim)))
    b = points_b.select(F.col("pt_id").alias("b_id"), *(F.col(f"x{d}").alias(f"_b{d}") for d in range(ndim)))
    return a.crossJoin(b).select("a_id", "b_id", *((F.col(f"_a{d}") - F.col(f"_b{d}")).alias(f"h{d}") for d in range(ndim)))


# ------------------------------------------------------------------ masks: columns of 0 and 1 on cells


def full_mask() -> Column:
    return F.lit(1.0)


def circle_mask(center: tuple[float, ...], diameter: float) -> Column:
    total = sum(((F.col(f"i{a}") - F.lit(float(c))) * (F.col(f"i{a}") - F.lit(float(c))) for a, c in enumerate(center)), F.lit(0.0))
    return F.when(total <= F.lit(diameter * diameter / 4.0), 1.0).otherwise(0.0)


def hole_mask(center: tuple[float, ...], diameter: float) -> Column:
    """Everything but a disc."""
    return 1.0 - circle_mask(center, diameter)


def bernoulli_mask(p: float, seed: int | None = None) -> Column:
    """1 with probability 1 - p. With a seed: Spark's generator; without: a fixed hash of two axes, the same everywhere."""
    u = F.rand(seed) if seed is not None else F.pmod(F.col("i0") * 7919 + F.col("i1") * 104729, F.lit(1000)) / F.lit(1000.0)
    return F.when(u >= F.lit(float(p)), 1.0).otherwise(0.0)


def mask_product(a: DataFrame, b: DataFrame, ndim: int) -> DataFrame:
    keys = [f"i{d}" for d in range(ndim)]
    return a.select(*keys, F.col("g").alias("_a")).join(b.select(*keys, F.col("g").alias("_b")), keys).select(*keys, (F.col("_a") * F.col("_b")).alias("g"))


def hann(grid: GridSpec) -> Column:
    """Product of Hann windows along the axes."""
    out = F.lit(1.0)
    for a, n in enumerate(grid.shape):
        out = out * (0.5 - 0.5 * F.cos(F.lit(2 * math.pi / max(n - 1, 1)) * F.col(f"i{a}")))
    return out


def resample(mask: DataFrame, source: GridSpec, target: GridSpec) -> DataFrame:
    """Nearest-neighbour resampling of a mask (i0.., g): target cell i takes source cell floor(i n0 / n)."""
    wanted = cells(mask.sparkSession, target)
    at = wanted.withColumns({f"s{a}": F.floor(F.col(f"i{a}") * F.lit(m) / F.lit(float(n))).cast("int") for a, (m, n) in enumerate(zip(source.shape, target.shape, strict=True))})
    src = mask.select(*(F.col(f"i{a}").cast("int").alias(f"s{a}") for a in range(source.ndim)), "g")
    return at.join(src, source.axes("s"), "left").select(*target.axes("i"), F.coalesce("g", F.lit(0.0)).alias("g"))


def check_mask(mask: DataFrame, grid: GridSpec) -> DataFrame:
    """The mask, if all its cells lie in the grid and none repeats; raises otherwise."""
    outside = None
    for a, n in enumerate(grid.shape):
        bad = (F.col(f"i{a}") < 0) | (F.col(f"i{a}") >= n)
        outside = bad if outside is None else outside | bad
    if mask.where(outside).head(1) or mask.groupBy(*grid.axes("i")).count().where("count > 1").head(1):
        raise ValueError("the mask does not fit the grid")
    return mask


def grid_rows(rows: DataFrame, grid: GridSpec, keys: list[str], value: Column, how: str = "avg") -> DataFrame:
    """Bin rows with cell columns i0.. into cells: keys, i0.., z; rows outside the grid are left out, empty cells are absent."""
    inside = rows
    for a, n in enumerate(grid.shape):
        inside = inside.where((F.col(f"i{a}") >= 0) & (F.col(f"i{a}") < n))
    agg = {"avg": F.avg, "sum": F.sum, "count": F.count}[how]
    return inside.groupBy(*keys, *grid.axes("i")).agg(agg(value).cast("double").alias("z"))


def standardise(field: DataFrame, keys: list[str], ndim: int) -> DataFrame:
    """z less its mean over its standard deviation (population), by keys; g = 1 for observed cells."""
    stats = field.groupBy(*keys).agg(F.avg("z").alias("_m"), F.stddev_pop("z").alias("_s")) if keys else field.agg(F.avg("z").alias("_m"), F.stddev_pop("z").alias("_s"))
    joined = field.join(F.broadcast(stats), keys) if keys else field.crossJoin(stats)
    return joined.select(*keys, *(f"i{a}" for a in range(ndim)), ((F.col("z") - F.col("_m")) / F.col("_s")).alias("z"), F.lit(1.0).alias("g"))


def missing_cells(field: DataFrame, grid: GridSpec, keys: DataFrame | None = None) -> DataFrame:
    """Cells of the grid (for each row of keys) that the field lacks."""
    wanted = cells(field.sparkSession, grid)
    on = grid.axes("i")
    if keys is not None:
        wanted, on = keys.crossJoin(wanted), [*keys.columns, *on]
    return wanted.join(field, on, "left_anti")
