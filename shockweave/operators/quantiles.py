"""Exact nearest-rank quantiles per group, by radix selection.

The value at rank ``round_half_even((n - 1) q)`` has no built-in: the
discrete percentile rounds differently. Values are non-negative, and ``n`` may
include zeros that are known by number only.

Non-negative doubles are in the order of their 64 bits read as a whole number. Three
passes fix 21 bits each: values that begin with the bits found so far are counted by their
next bits, in partial sums, and the count that covers the rank gives those bits. What a
task holds is at most 2^21 counts of a group, never its values, whatever their number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGIT_BITS = 21
PASSES = 3
# Fixed values of the double format: bits of the fraction, of the exponent all set, and its offset.
FRACTION, TOP_EXPONENT, OFFSET = 52, 2047, 1023


def double_bits(v: Column) -> Column:
    """The bits of a non-negative double as a whole number, by exact scaling with powers of two."""
    power = lambda e: F.pow(F.lit(2.0), e)
    guess = F.floor(F.log2(v))
    exponent = F.when(power(guess) > v, guess - 1).when(power(guess + 1) <= v, guess + 1).otherwise(guess)
    unit = F.lit(2.0**FRACTION)
    normal = F.shiftleft((exponent + OFFSET).cast("long"), FRACTION) + ((v / power(exponent) - 1) * unit).cast("long")
    tiny = (v * unit * F.lit(2.0 ** (OFFSET - 1))).cast("long")  # below the normal range, in units of the least double
    top = F.shiftleft(F.lit(TOP_EXPONENT).cast("long"), FRACTION)
    return (
        F.when(F.isnan(v), top + 1)
        .when(v == float("inf"), top)
        .when(v < 2.0 ** (1 - OFFSET), tiny)
        .otherwise(normal)
    )


def double_of(bits: Column) -> Column:
    """The double with these bits."""
    exponent = F.shiftright(bits, FRACTION)
    fraction = (bits - F.shiftleft(exponent, FRACTION)).cast("double")
    scale = F.pow(F.lit(2.0), exponent - OFFSET)
    return (
        F.when(exponent == 0, fraction / 2.0**FRACTION / 2.0 ** (OFFSET - 1))
        .when((exponent == TOP_EXPONENT) & (fraction > 0), F.lit(float("nan")))
        .when(exponent == TOP_EXPONENT, F.lit(float("inf")))
        .otherwise((1 + fraction / 2.0**FRACTION) * scale)
    )


def beside(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of its group's row of ``table``.

    Without keys ``table`` is one row and comes in as a scalar subquery, so nothing is joined.
    """
    if keys:
        return df.join(table, list(keys))
    one = table.select(F.struct(*table.columns).alias("_one")).scalar()
    return df.withColumn("_one", one).select(*df.columns, "_one.*")


def _next_digits(values: DataFrame, found: DataFrame, keys: list[str], names: Sequence[str], level: int) -> DataFrame:
    """``found`` with DIGIT_BITS more bits of every quantile, and its rank among the values that begin so."""
    below = DIGIT_BITS * (PASSES - 1 - level)
    head = F.shiftright("_bits", below + DIGIT_BITS)
    digit = F.shiftright("_bits", below).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
    inside = {n: (head == F.col(f"_at_{n}")) if level else F.col(f"_rank_{n}") >= 0 for n in names}
    counts = (
        beside(values, found, keys)
        .groupBy(*keys, digit.alias("_digit"))
        .agg(*[F.count_if(c).alias(f"_c_{n}") for n, c in inside.items()])
        .filter(" or ".join(f"_c_{n} > 0" for n in names))
    )
    before = W.partitionBy(*keys).orderBy("_digit").rowsBetween(W.unboundedPreceding, -1)
    running = counts.select("*", *[F.coalesce(F.sum(f"_c_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names])
    placed = beside(running, found, keys)

    def covering(n: str) -> Column:
        rank, start = F.col(f"_rank_{n}"), F.col(f"_b_{n}")
        return (rank >= start) & (rank < start + F.col(f"_c_{n}"))

    chosen = []
    for n in names:
        bits = F.shiftleft(F.coalesce(f"_at_{n}", F.lit(0).cast("long")), DIGIT_BITS) + F.col("_digit")
        chosen.append(F.max(F.when(covering(n), bits)).alias(f"_at_{n}"))
        chosen.append(F.max(F.when(covering(n), F.col(f"_rank_{n}") - F.col(f"_b_{n}"))).alias(f"_rank_{n}"))
    return placed.groupBy(*keys).agg(*chosen)


def nearest_quantiles(
    values: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    zeros: DataFrame | None = None,
) -> DataFrame:
    """``(keys, <name>...)``: a column for each of ``quantiles``; ``zeros`` holds (keys, n_zeros).

    ``values`` is read once to count and once in each pass and should be a written table.
    A quantile that falls on a zero known by number only, or of no values, is 0.
    """
    keys, names = list(keys), list(quantiles)
    v = values.select(*keys, double_bits(F.col(value).cast("double")).alias("_bits"))
    counted = v.groupBy(*keys).agg(F.count("*").alias("_n"))
    counted = beside(counted, zeros.select(*keys, "n_zeros"), keys) if zeros is not None else counted.withColumn("n_zeros", F.lit(0))
    rank = lambda q: F.bround((F.col("_n") + F.col("n_zeros") - 1) * F.lit(float(q))).cast("long") - F.col("n_zeros")
    found = counted.select(
        *keys,
        *[F.lit(None).cast("long").alias(f"_at_{n}") for n in names],
        *[rank(q).alias(f"_rank_{n}") for n, q in quantiles.items()],
    )
    for level in range(PASSES):
        found = _next_digits(v, found, keys, names, level)
    result = [F.coalesce(double_of(F.col(f"_at_{n}")), F.lit(0.0)).alias(n) for n in names]
    if not keys:
        return found.select(*result)
    return counted.select(*keys).join(found.select(*keys, *result), keys, "left").na.fill(0.0, names)
