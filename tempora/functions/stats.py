"""Exact statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z = 1.96
Z_POWER_80, Z_POWER_OTHER = 0.84, 1.28


def wilson(correct: Column, total: Column) -> tuple[Column, Column]:
    """Wilson interval of a share, in per cent; (0, 0) for no trials."""
    n = total.cast("double")
    p = correct / n
    centre, spread = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    scale = 100 / (1 + Z * Z / n)
    zero = F.lit(0.0)
    return F.when(total <= 0, zero).otherwise(F.greatest(zero, (centre - spread) * scale)), F.when(total <= 0, zero).otherwise(F.least(F.lit(100.0), (centre + spread) * scale))


def binomial_tail(m: Column, k: Column) -> Column:
    """Share of subsets of ``m`` with ``k`` members or fewer, summed in log space."""
    start = F.struct((-m * F.log(F.lit(2.0))).alias("log"), F.exp(-m * F.log(F.lit(2.0))).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((m - i + 1).cast("double") / i)
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, step, lambda a: a["sum"])


def mcnemar(b01: Column, b10: Column) -> Column:
    """Exact two-sided p of discordant counts; one where there are none."""
    m = (b01 + b10).cast("long")
    return F.when(m == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(m, F.least(b01, b10))))


def paired_mde(discordant: Column, n: Column, power: float = 0.8) -> Column:
    """Least detectable difference of a paired comparison, in points."""
    z = Z_POWER_80 if power == 0.8 else Z_POWER_OTHER
    return (Z + z) * F.sqrt(discordant.cast("double")) / n * 100


def expected_mde(n: Column, discordance: float = 0.24, power: float = 0.8) -> Column:
    """Least detectable difference of a paired comparison of ``n``, in points, before any discordance is known."""
    z = Z_POWER_80 if power == 0.8 else Z_POWER_OTHER
    return (Z + z) * F.sqrt(F.lit(discordance) / F.greatest(n, F.lit(1))) * 100


def holm(rows: DataFrame, p: str, group: list[str], tie: str) -> DataFrame:
    """Adjusted p (``p_holm``) by Holm's step-down rule in each group."""
    every, order = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(p, tie)
    scaled = F.least(F.lit(1.0), (F.count(F.lit(1)).over(every) - F.row_number().over(order) + 1) * F.col(p))
    return rows.withColumn("_s", scaled).withColumn("p_holm", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def selection_band(n: int, k: int, share: Column) -> Column:
    """Mean accuracy of the best of ``k`` systems that all have this true share: exact."""
    start = F.struct((n * F.log(1 - share)).alias("log"), F.exp(n * F.log(1 - share)).alias("cdf"), F.lit(0.0).alias("below"))

    def step(a: Column, x: Column) -> Column:
        log = a["log"] + F.log((n - x + 1).cast("double") / x * share / (1 - share))
        return F.struct(log.alias("log"), (a["cdf"] + F.exp(log)).alias("cdf"), (a["below"] + F.pow(F.least(F.lit(1.0), a["cdf"]), F.lit(float(k)))).alias("below"))

    below = F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda a: a["below"])
    return (n - below) / n


def selection_quantile(n: int, k: int, share: Column, q: float = 0.95) -> Column:
    """Accuracy that the best of ``k`` such systems stays at or under with probability ``q``: exact."""
    start = F.struct((n * F.log(1 - share)).alias("log"), F.exp(n * F.log(1 - share)).alias("cdf"), F.lit(0).alias("under"))

    def step(a: Column, x: Column) -> Column:
        log = a["log"] + F.log((n - x + 1).cast("double") / x * share / (1 - share))
        under = a["under"] + F.when(F.round(F.pow(F.least(F.lit(1.0), a["cdf"]), F.lit(float(k))), 9) < q, 1).otherwise(0)
        return F.struct(log.alias("log"), (a["cdf"] + F.exp(log)).alias("cdf"), under.alias("under"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda a: a["under"]) / F.lit(n)
