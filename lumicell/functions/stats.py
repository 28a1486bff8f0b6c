"""Statistics as columns and small frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def variance(s1: Column, s2: Column, n: Column, ddof: int = 0) -> Column:
    """Variance from sums over stored values, n counting the zeros too; never negative."""
    centred = F.greatest(s2 - s1 * s1 / n, F.lit(0.0))
    return F.when(n > ddof, centred / (n - ddof))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.when(b != 0, a / b)


def nearest(x: Column, digits: int) -> Column:
    """x >= 0 rounded by binary arithmetic, as DuckDB does; F.round goes by the decimal digits and differs where they end in 5."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by the rational approximation with
    the five published coefficients (absolute error below 1e-7)."""
    # fixed values: Abramowitz and Stegun 26.2.17
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    return F.least(F.lit(1.0), 2 * F.exp(-x * x / 2) / 2.5066282746310002 * poly)


def adjust_bh(df: DataFrame, p: str, out: str, by: list[str], tie: list[str]) -> DataFrame:
    """Benjamini-Hochberg values of p within each group; ties in p are ordered by `tie`."""
    order = Window.partitionBy(*by).orderBy(F.col(p), *tie)
    back = Window.partitionBy(*by).orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(back))).drop("_r", "_n")


def zero_aware_median(values: DataFrame, by: list[str], n: str) -> DataFrame:
    """Median of `value` per group of non-negative stored values, where `n` (a column of
    values) counts all members of the group and those not stored are zero."""
    ranked = values.where("value > 0").withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("value"))).withColumn("_nnz", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    place = F.col("_k") + F.col(n) - F.col("_nnz")  # rank among all, zeros first
    lower, upper = F.floor((F.col(n) + 1) / 2), F.floor(F.col(n) / 2) + 1
    at = lambda k: F.coalesce(F.max(F.when(place == k, F.col("value"))), F.lit(0.0))
    return ranked.groupBy(*by).agg(((at(lower) + at(upper)) / 2).alias("median"))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series at x + 7, seven factors taken off (error below 1e-11)."""
    # fixed values: the first coefficients of Stirling's series
    c = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)
    z = x + 7
    series = sum((k / F.pow(z, F.lit(2 * i + 1)) for i, k in enumerate(c)), F.lit(0.0))
    taken = sum((F.log(x + i) for i in range(7)), F.lit(0.0))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - taken


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def gamma_p(a: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma function by its series; terms grow with x."""
    steps = F.sequence(F.lit(1), (F.lit(60) + F.ceil(3 * x)).cast("int"))
    one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    total = F.aggregate(steps, one, lambda acc, n: F.struct((acc["t"] * x / (a + n)).alias("t"), (acc["s"] + acc["t"] * x / (a + n)).alias("s")), lambda acc: acc["s"])
    return F.when(x <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.exp(a * F.log(x) - x - log_gamma(a + 1.0)) * total))


def chi2_tail(x: Column, df: Column) -> Column:
    """P(chi-squared with df degrees of freedom > x)."""
    return 1 - gamma_p(df / 2.0, x / 2.0)


def poisson_tail(k: Column, mean: Column) -> Column:
    """P(Poisson >= k), k >= 1."""
    return gamma_p(k, mean)


def hypergeometric_tail(a: Column, m: Column, k: Column, n: Column) -> Column:
    """P(overlap >= a) of m drawn and k marked out of n: Fisher's one-sided test."""
    whole = log_choose(n, m)
    return F.least(F.lit(1.0), F.aggregate(F.sequence(a, F.least(m, k)), F.lit(0.0), lambda s, i: s + F.exp(log_choose(k, i) + log_choose(n - k, m - i) - whole)))
