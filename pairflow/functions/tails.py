"""Tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms of the two expansions, enough for 12 digits on either side of MEET.
SERIES, FRACTION, MEET = 60, 150, 2.5


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0: a series for small z, a continued fraction for large z.

    erf(z) = 2/sqrt(pi) exp(-z^2) (z + 2 z^3 / 3 + 4 z^5 / 15 + ...), each term 2 z^2 / (2n + 1) times the last;
    erfc(z) = exp(-z^2)/sqrt(pi) / (z + (1/2) / (z + (2/2) / (z + (3/2) / (z + ...)))), folded from the inside.
    """
    bell = F.exp(-z * z)
    start = F.struct(z.alias("term"), z.alias("total"))

    def next_term(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2.0 * z * z / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES)), start, next_term, lambda acc: acc["total"])
    inner = F.aggregate(F.sequence(F.lit(FRACTION), F.lit(1)), F.lit(0.0), lambda acc, k: k / 2.0 / (z + acc))
    return F.when(z < MEET, 1 - 2 / math.sqrt(math.pi) * bell * series).otherwise(bell / math.sqrt(math.pi) / (z + inner))


def chi_square_tail(statistic: Column) -> Column:
    """Probability that a chi-square variable of one degree of freedom exceeds the statistic."""
    return erfc(F.sqrt(statistic / 2))
