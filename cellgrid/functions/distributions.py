"""Distributions, the error function and counting functions as column builders.

All stay in the JVM: sums and series are folds over sequences. Probabilities are summed from the logarithm of
their first term by the ratio of neighbours, so large arguments neither overflow nor lose the sum. Arguments
outside a function's domain give null. A `cumulative` argument that is not 0 asks for the sum or integral.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellgrid.functions.registry import FUNCTIONS, define, truncated

#: Terms of the error function's series, and depth of its continued fraction; both are exact to a double there.
_TERMS, _DEPTH, _TURN = 70, 90, 2.5
_SQRT_2, _SQRT_PI = math.sqrt(2.0), math.sqrt(math.pi)


def _steps(low: Column, high: Column) -> Column:
    """low, low + 1 .. high - 1."""
    return F.when(high > low, F.sequence(low.cast("long"), high.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


def _sum(log_first: Column, low: Column, high: Column, log_ratio) -> Column:
    """Terms low .. high, the first given by its logarithm and each next one by log_ratio(index before)."""
    first = F.struct(log_first.alias("log"), F.exp(log_first).alias("total"))

    def add(state, i):
        log = state["log"] + log_ratio(i.cast("double"))
        return F.struct(log.alias("log"), (state["total"] + F.exp(log)).alias("total"))

    return F.aggregate(_steps(low, high), first, add, lambda s: s["total"])


def _log_choose(n: Column, k: Column) -> Column:
    return F.aggregate(_steps(F.lit(0.0), k), F.lit(0.0), lambda t, i: t + F.log((n - i) / (i + 1)))


def _log_factorial(k: Column) -> Column:
    return F.aggregate(_steps(F.lit(0.0), k), F.lit(0.0), lambda t, i: t + F.log(i + 1.0))


def _binomial(n: Column, p: Column, low: Column, high: Column) -> Column:
    inner = _sum(_log_choose(n, low) + low * F.log(p) + (n - low) * F.log(1 - p), low, high, lambda i: F.log((n - i) / (i + 1)) + F.log(p) - F.log(1 - p))
    sure = F.when(p == 0, (low == 0).cast("double")).otherwise((high == n).cast("double"))
    return F.when((p < 0) | (p > 1) | (low < 0) | (high > n) | (low > high), None).when((p == 0) | (p == 1), sure).otherwise(F.least(inner, F.lit(1.0)))


@define("BINOM.DIST", "BINOMDIST")
def binomial(k, n, p, cumulative):
    k, n = truncated(k), truncated(n)
    return _binomial(n, p, F.when(cumulative != 0, F.least(k, F.lit(0.0))).otherwise(k), k)


@define("BINOM.DIST.RANGE")
def binomial_range(n, p, low, high=None):
    low = truncated(low)
    return _binomial(truncated(n), p, low, low if high is None else truncated(high))


@define("POISSON.DIST", "POISSON")
def poisson(k, mean, cumulative):
    k = truncated(k)
    low = F.when(cumulative != 0, 0.0).otherwise(k)
    inner = _sum(low * F.log(mean) - mean - _log_factorial(low), low, k, lambda i: F.log(mean) - F.log(i + 1))
    return F.when((k < 0) | (mean < 0), None).when(mean == 0, (low == 0).cast("double")).otherwise(F.least(inner, F.lit(1.0)))


@define("NEGBINOM.DIST")
def negative_binomial(failures, successes, p, cumulative):
    f, s = truncated(failures), truncated(successes)
    low = F.when(cumulative != 0, 0.0).otherwise(f)
    inner = _sum(_log_choose(low + s - 1, low) + s * F.log(p) + low * F.log(1 - p), low, f, lambda i: F.log((s + i) / (i + 1)) + F.log(1 - p))
    return F.when((f < 0) | (s < 1) | (p <= 0) | (p > 1), None).when(p == 1, (low == 0).cast("double")).otherwise(F.least(inner, F.lit(1.0)))


@define("NEGBINOMDIST")
def negative_binomial_term(failures, successes, p):
    return negative_binomial(failures, successes, p, F.lit(0.0))


@define("HYPGEOM.DIST")
def hypergeometric(k, n, good, total, cumulative):
    k, n, good, total = map(truncated, (k, n, good, total))
    least = F.greatest(F.lit(0.0), n - (total - good))
    low = F.when(cumulative != 0, least).otherwise(k)
    first = _log_choose(good, low) + _log_choose(total - good, n - low) - _log_choose(total, n)
    inner = _sum(first, low, k, lambda i: F.log((good - i) * (n - i) / ((i + 1) * (total - good - n + i + 1))))
    return F.when((k < least) | (k > n) | (k > good) | (n > total) | (good > total) | (n < 0) | (good < 0), None).otherwise(F.least(inner, F.lit(1.0)))


@define("HYPGEOMDIST")
def hypergeometric_term(k, n, good, total):
    return hypergeometric(k, n, good, total, F.lit(0.0))


@define("EXPON.DIST", "EXPONDIST")
def exponential(x, rate, cumulative):
    return F.when((x >= 0) & (rate > 0), F.when(cumulative != 0, -F.expm1(-rate * x)).otherwise(rate * F.exp(-rate * x)))


@define("WEIBULL.DIST", "WEIBULL")
def weibull(x, shape, scale, cumulative):
    power = F.pow(x / scale, shape)
    density = shape / scale * F.pow(x / scale, shape - 1) * F.exp(-power)
    return F.when((x >= 0) & (shape > 0) & (scale > 0), F.when(cumulative != 0, -F.expm1(-power)).otherwise(density))


def _erf_near(x: Column) -> Column:
    """The series of positive terms, for arguments up to _TURN in size."""
    first = F.struct(x.alias("term"), x.alias("total"))

    def add(state, i):
        term = state["term"] * (2 * x * x) / (2 * i + 1)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), first, add, lambda s: s["total"]) * F.exp(-x * x) * (2 / _SQRT_PI)


def _erfc_far(x: Column) -> Column:
    """The continued fraction, for arguments from _TURN on."""
    below = F.aggregate(F.sequence(F.lit(_DEPTH), F.lit(1), F.lit(-1)), x, lambda t, i: x + (i / 2.0) / t)
    return F.exp(-x * x) / _SQRT_PI / below


def erfc(x: Column) -> Column:
    return F.when(x >= _TURN, _erfc_far(x)).when(x <= -_TURN, 2.0 - _erfc_far(-x)).otherwise(1.0 - _erf_near(x))


@define("ERF.PRECISE")
def erf(x):
    return F.when(x >= _TURN, 1.0 - _erfc_far(x)).when(x <= -_TURN, _erfc_far(-x) - 1.0).otherwise(_erf_near(x))


@define("ERF")
def erf_between(low, high=None):
    return erf(low) if high is None else erf(high) - erf(low)


define("ERFC", "ERFC.PRECISE")(erfc)


def normal(z: Column) -> Column:
    """The chance of a standard normal value up to z."""
    return erfc(-z / _SQRT_2) / 2.0


def _density(z: Column) -> Column:
    return F.exp(-z * z / 2.0) / (_SQRT_2 * _SQRT_PI)


def normal_inverse(p: Column) -> Column:
    """Newton's steps from a rational start in the lower tail, mirrored for the upper one."""
    low = F.least(p, 1.0 - p)
    t = F.sqrt(-2.0 * F.log(low))
    # fixed values: the published rational start of Hastings, exact to 0.00045
    start = -(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1.0 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t))
    z = F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, lambda z, _: z - (normal(z) - low) / _density(z))
    return F.when((p > 0) & (p < 1), F.when(p == 0.5, 0.0).when(p < 0.5, z).otherwise(-z))


@define("NORM.S.DIST")
def standard_normal(z, cumulative):
    return F.when(cumulative != 0, normal(z)).otherwise(_density(z))


@define("NORM.DIST", "NORMDIST")
def normal_of(x, mean, deviation, cumulative):
    z = (x - mean) / deviation
    return F.when(deviation > 0, F.when(cumulative != 0, normal(z)).otherwise(_density(z) / deviation))


@define("LOGNORM.DIST")
def log_normal(x, mean, deviation, cumulative):
    z = (F.log(x) - mean) / deviation
    return F.when((x > 0) & (deviation > 0), F.when(cumulative != 0, normal(z)).otherwise(_density(z) / (deviation * x)))


define("NORMSDIST")(normal)
define("GAUSS")(lambda z: erf(z / _SQRT_2) / 2.0)
define("NORM.S.INV", "NORMSINV")(normal_inverse)
define("NORM.INV", "NORMINV")(lambda p, mean, deviation: F.when(deviation > 0, mean + deviation * normal_inverse(p)))
define("LOGNORMDIST")(lambda x, mean, deviation: log_normal(x, mean, deviation, F.lit(1.0)))
define("LOGNORM.INV", "LOGINV")(lambda p, mean, deviation: F.when(deviation > 0, F.exp(mean + deviation * normal_inverse(p))))
define("CONFIDENCE.NORM", "CONFIDENCE")(lambda alpha, deviation, n: F.when((deviation > 0) & (truncated(n) >= 1), -normal_inverse(alpha / 2.0) * deviation / F.sqrt(truncated(n))))


@define("COMBINA")
def choose_repeated(n, k):
    n, k = truncated(n), truncated(k)
    product = F.aggregate(_steps(F.lit(0.0), k), F.lit(1.0), lambda t, i: t * (n + k - 1 - i) / (i + 1))
    return F.when((n < 0) | (k < 0), None).when((n == 0) & (k == 0), 1.0).otherwise(F.round(product))


def _to_step(turn, x, step):
    step = F.lit(1.0) if step is None else F.abs(step)
    return F.when(step == 0, 0.0).otherwise(turn(x / step) * step)


define("CEILING.PRECISE", "ISO.CEILING")(lambda x, step=None: _to_step(F.ceil, x, step))
define("FLOOR.PRECISE")(lambda x, step=None: _to_step(F.floor, x, step))

# functions that change by themselves
define("TODAY")(lambda: F.datediff(F.current_date(), F.lit("1899-12-30").cast("date")).cast("double"))
define("NOW")(lambda: FUNCTIONS["TODAY"]() + (F.hour(F.current_timestamp()) * 3600 + F.minute(F.current_timestamp()) * 60 + F.second(F.current_timestamp())) / 86400.0)
define("RAND")(lambda: F.rand())
define("RANDBETWEEN")(lambda low, high: F.when(F.ceil(low) <= F.floor(high), F.floor(F.ceil(low) + F.rand() * (F.floor(high) - F.ceil(low) + 1))).cast("double"))

