"""Spreadsheet functions as column builders: name -> callable over Columns.

Numbers are doubles. A function that has no value for its arguments gives null; `error` columns are
the compiler's concern. Rounding is half away from zero, MOD takes the divisor's sign, text
positions count from 1, dates are DATE columns.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS: dict = {}


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def define(*names: str):
    def keep(f):
        for name in names:
            FUNCTIONS[name] = lambda *a, f=f: f(*map(_col, a))
        return f

    return keep


def _family(**given) -> None:
    for name, f in given.items():
        FUNCTIONS[name.replace("__", ".")] = lambda *a, f=f: f(*map(_col, a))


def truncated(x: Column, digits: Column | int = 0) -> Column:
    scale = F.pow(F.lit(10.0), digits)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def rounded(x: Column, digits: Column | int = 0) -> Column:
    """Half away from zero, of the number as its decimal digits show it."""
    scale = F.pow(F.lit(10.0), digits)
    near = F.abs(x) * scale
    return F.signum(x) * F.floor(near * (1 + 2.0**-51) + 0.5) / scale


def modulo(x: Column, y: Column) -> Column:
    return F.when(y != 0, x - y * F.floor(x / y))


# mathematics and trigonometry
_family(
    ABS=F.abs, SIGN=F.signum, SQRT=lambda x: F.when(x >= 0, F.sqrt(x)), EXP=F.exp, LN=lambda x: F.when(x > 0, F.log(x)), LOG10=lambda x: F.when(x > 0, F.log10(x)),
    POWER=lambda x, y: F.when(~((x == 0) & (y <= 0)) & ~((x < 0) & (y != F.floor(y))), F.pow(x, y)), PI=lambda: F.lit(math.pi),
    INT=F.floor, TRUNC=truncated, ROUND=rounded, ROUNDUP=lambda x, d=0: F.signum(x) * F.ceil(F.abs(x) * F.pow(F.lit(10.0), _col(d))) / F.pow(F.lit(10.0), _col(d)), ROUNDDOWN=truncated,
    MOD=modulo, QUOTIENT=lambda x, y: F.when(y != 0, truncated(x / y)), EVEN=lambda x: F.signum(x) * 2 * F.ceil(F.abs(x) / 2),
    ODD=lambda x: F.when(x == 0, 1.0).otherwise(F.signum(x) * (2 * F.ceil((F.abs(x) + 1) / 2) - 1)), MROUND=lambda x, m: F.when(m == 0, 0.0).when(x * m >= 0, m * rounded(x / m)),
    CEILING__MATH=lambda x, s=1.0: _col(s) * F.ceil(x / _col(s)), FLOOR__MATH=lambda x, s=1.0: _col(s) * F.floor(x / _col(s)), CEILING=lambda x, s: F.when(s == 0, 0.0).otherwise(s * F.ceil(x / s)),
    FLOOR=lambda x, s: F.when(s != 0, s * F.floor(x / s)), SUMSQ=lambda *x: reduce(lambda a, b: a + b, [v * v for v in x]), PRODUCT=lambda *x: reduce(lambda a, b: a * b, x),
    SIN=F.sin, COS=F.cos, TAN=F.tan, COT=lambda x: F.when(x != 0, 1 / F.tan(x)), SEC=lambda x: 1 / F.cos(x), CSC=lambda x: F.when(x != 0, 1 / F.sin(x)),
    ASIN=lambda x: F.when(F.abs(x) <= 1, F.asin(x)), ACOS=lambda x: F.when(F.abs(x) <= 1, F.acos(x)), ATAN=F.atan, ATAN2=lambda x, y: F.when((x != 0) | (y != 0), F.atan2(y, x)),
    ACOT=lambda x: F.lit(math.pi / 2) - F.atan(x), SINH=F.sinh, COSH=F.cosh, TANH=F.tanh, ASINH=F.asinh, ACOSH=lambda x: F.when(x >= 1, F.acosh(x)), ATANH=lambda x: F.when(F.abs(x) < 1, F.atanh(x)),
    COTH=lambda x: F.when(x != 0, 1 / F.tanh(x)), SECH=lambda x: 1 / F.cosh(x), CSCH=lambda x: F.when(x != 0, 1 / F.sinh(x)), ACOTH=lambda x: F.when(F.abs(x) > 1, 0.5 * F.log((x + 1) / (x - 1))),
    DEGREES=F.degrees, RADIANS=F.radians, SQRTPI=lambda x: F.when(x >= 0, F.sqrt(x * math.pi)),
    FACT=lambda n: F.when((n >= 0) & (n < 171), F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(n).cast("int"), F.lit(1))), F.lit(1.0), lambda a, i: a * i)),
    FACTDOUBLE=lambda n: F.when(n >= -1, F.aggregate(F.filter(F.sequence(F.lit(1), F.greatest(F.floor(n).cast("int"), F.lit(1))), lambda i: (i % 2) == (F.floor(n).cast("int") % 2)), F.lit(1.0), lambda a, i: a * i)),
    COMBIN=lambda n, k: F.when((k >= 0) & (n >= k), rounded(F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(1.0), lambda a, i: F.when(k.cast("int") == 0, a).otherwise(a * (n - k + i) / i)))),
    PERMUT=lambda n, k: F.when((k >= 0) & (n >= k), F.when(k == 0, 1.0).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(k.cast("int") - 1, F.lit(0))), F.lit(1.0), lambda a, i: a * (n - i)))),
    BITAND=lambda a, b: a.cast("long").bitwiseAND(b.cast("long")), BITOR=lambda a, b: a.cast("long").bitwiseOR(b.cast("long")), BITXOR=lambda a, b: a.cast("long").bitwiseXOR(b.cast("long")),
    BITLSHIFT=lambda a, n: (a.cast("double") * F.pow(F.lit(2.0), n)).cast("long"), BITRSHIFT=lambda a, n: F.floor(a / F.pow(F.lit(2.0), n)).cast("long"),
    DELTA=lambda a, b=0: F.when(a == _col(b), 1).otherwise(0), GESTEP=lambda a, s=0: F.when(a >= _col(s), 1).otherwise(0),
)
FUNCTIONS["BASE"] = lambda x, base, width=1: F.call_function("lpad", F.conv(_col(x).cast("long").cast("string"), 10, base), F.greatest(F.lit(width), F.length(F.conv(_col(x).cast("long").cast("string"), 10, base))), F.lit("0"))
FUNCTIONS["DECIMAL"] = lambda t, base: F.conv(F.upper(_col(t)), base, 10).cast("double")
FUNCTIONS["LOG"] = lambda x, b=10: F.when(_col(x) > 0, F.log10(_col(x)) if b == 10 else F.log(_col(x)) / F.log(_col(b)))
for _name, _from, _to in (("DEC2BIN", 10, 2), ("DEC2HEX", 10, 16), ("DEC2OCT", 10, 8), ("BIN2DEC", 2, 10), ("HEX2DEC", 16, 10), ("OCT2DEC", 8, 10), ("BIN2HEX", 2, 16), ("HEX2BIN", 16, 2), ("BIN2OCT", 2, 8), ("OCT2BIN", 8, 2), ("HEX2OCT", 16, 8), ("OCT2HEX", 8, 16)):
    FUNCTIONS[_name] = lambda x, a=_from, b=_to: F.conv((_col(x).cast("long") if a == 10 else _col(x)).cast("string"), a, b)


def find(part: Column, text: Column, start: Column | int = 1) -> Column:
    found = F.call_function("locate", part, text, _col(start).cast("int"))
    return F.when(found > 0, found)


def proper(t: Column) -> Column:
    """A letter after anything that is no letter is upper case, others are lower."""
    letters = F.split(F.lower(t), "")
    step = lambda a, c: F.struct(F.concat(a["t"], F.when(a["w"], c).otherwise(F.upper(c))).alias("t"), c.rlike(r"^\p{L}$").alias("w"))
    return F.aggregate(letters, F.struct(F.lit("").alias("t"), F.lit(False).alias("w")), step)["t"]


_family(
    LEN=F.char_length, UPPER=F.upper, LOWER=F.lower, PROPER=proper, LEFT=lambda t, n=1: F.substring(t, F.lit(1), _col(n).cast("int")),
    RIGHT=lambda t, n=1: F.when(_col(n) > 0, F.right(t, _col(n).cast("int"))).otherwise(""), MID=lambda t, s, n: F.when((s >= 1) & (n >= 0), F.substring(t, s.cast("int"), n.cast("int"))),
    CONCATENATE=lambda *x: F.concat(*x), CONCAT=lambda *x: F.concat(*x), REPT=lambda t, n: F.when(n >= 0, F.call_function("repeat", t, n.cast("int"))),
    TRIM=lambda t: F.regexp_replace(F.trim(t), " +", " "), CLEAN=lambda t: F.regexp_replace(t, r"[\x00-\x1f]", ""), EXACT=lambda a, b: a == b,
    FIND=find, SEARCH=lambda p, t, s=1: find(F.lower(p), F.lower(t), s), SUBSTITUTE=lambda t, a, b: F.replace(t, a, b),
    REPLACE=lambda t, s, n, new: F.concat(F.substring(t, F.lit(1), s.cast("int") - 1), new, F.call_function("substring", t, (s + n).cast("int"))),
    CHAR=lambda n: F.char(n.cast("int")), CODE=F.ascii, UNICHAR=lambda n: F.char(n.cast("int")), UNICODE=F.ascii, T=lambda t: t, VALUE=lambda t: t.try_cast("double"),
    TEXTAFTER=lambda t, d: F.when(F.call_function("instr", t, d) > 0, F.call_function("substring", t, F.call_function("instr", t, d) + F.char_length(d))),
    REGEXTEST=lambda t, p: F.call_function("rlike", t, p), REGEXREPLACE=lambda t, p, r: F.regexp_replace(t, p, r), REGEXEXTRACT=lambda t, p: F.nullif(F.call_function("regexp_substr", t, p), F.lit("")),
    FIXED=lambda x, d=2: F.format_number(x, 2), DOLLAR=lambda x, d=2: F.concat(F.when(x < 0, "-$").otherwise("$"), F.format_number(F.abs(x), 2)), ENCODEURL=lambda t: F.replace(F.replace(F.replace(F.url_encode(t), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")),
)
FUNCTIONS["TEXTJOIN"] = lambda d, skip, *x: F.array_join(F.filter(F.array(*map(_col, x)), lambda v: F.lit(not skip) | (F.coalesce(v, F.lit("")) != "")), d, "")
FUNCTIONS["TEXTBEFORE"] = lambda t, d: F.when(F.call_function("instr", _col(t), _col(d)) > 0, F.split_part(_col(t), _col(d), F.lit(1)))
FUNCTIONS["NUMBERVALUE"] = lambda t, dec=".", group=",": F.replace(F.replace(_col(t), F.lit(group), F.lit("")), F.lit(dec), F.lit(".")).try_cast("double")

# dates; serials count days from 1899-12-30
_EPOCH = "1899-12-30"


def serial(d: Column) -> Column:
    return F.datediff(d, F.lit(_EPOCH).cast("date")).cast("double")


def networkdays(a: Column, b: Column) -> Column:
    """Days from a to b, both included, without Saturdays and Sundays; negative if b is before a. In closed form."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    before = lambda d: (lambda n: F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5)))(F.datediff(d, F.lit("1900-01-01").cast("date")))  # noqa: E731  1900-01-01 is a Monday
    n = before(F.date_add(hi, 1)) - before(lo)
    return F.when(a <= b, n).otherwise(-n)


def days360(a: Column, b: Column) -> Column:
    """US method without the end-of-February rule."""
    da, db = F.least(F.dayofmonth(a), F.lit(30)), F.dayofmonth(b)
    db = F.when((db == 31) & (da == 30), 30).otherwise(db)
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + db - da


_family(
    DATE=lambda y, m, d: F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), (m - 1).cast("int")), (d - 1).cast("int")), YEAR=F.year, MONTH=F.month, DAY=F.dayofmonth,
    HOUR=F.hour, MINUTE=F.minute, SECOND=F.second, WEEKDAY=F.dayofweek, ISOWEEKNUM=F.weekofyear, EDATE=lambda d, n: F.add_months(d, n.cast("int")), EOMONTH=lambda d, n: F.last_day(F.add_months(d, n.cast("int"))),
    DAYS=lambda b, a: F.datediff(b, a), DAYS360=days360, NETWORKDAYS=networkdays, DATEVALUE=lambda t: serial(t.try_cast("date")), YEARFRAC=lambda a, b: F.abs(days360(F.least(a, b), F.greatest(a, b))) / 360,
    WEEKNUM=lambda d: F.floor((F.dayofyear(d) + F.dayofweek(F.trunc(d, "year")) - 2) / 7).cast("int") + 1, DATEDIF=lambda a, b, u=None: F.floor(F.months_between(b, a)), TIME=lambda h, m, s: F.pmod((h * 3600 + m * 60 + s) / 86400, F.lit(1.0)),
)

# logic and information
_family(
    IF=lambda c, a, b=False: F.when(c, a).otherwise(_col(b)), IFS=lambda *x: reduce(lambda w, i: w.when(x[i], x[i + 1]) if w is not None else F.when(x[i], x[i + 1]), range(0, len(x), 2), None),
    AND=lambda *x: reduce(lambda a, b: a & b, x), OR=lambda *x: reduce(lambda a, b: a | b, x), NOT=lambda x: ~x, XOR=lambda *x: reduce(lambda a, b: a != b, x), TRUE=lambda: F.lit(True), FALSE=lambda: F.lit(False),
    SWITCH=lambda e, *x: reduce(lambda w, i: w.when(e == x[i], x[i + 1]) if w is not None else F.when(e == x[i], x[i + 1]), range(0, len(x) - len(x) % 2, 2), None).otherwise(x[-1] if len(x) % 2 else F.lit(None)),
    CHOOSE=lambda i, *x: F.try_element_at(F.array(*x), i.cast("int")), IFERROR=lambda x, y: F.coalesce(x, y), IFNA=lambda x, y: F.coalesce(x, y), ISBLANK=lambda x: x.isNull(), ISNUMBER=lambda x: x.try_cast("double").isNotNull(),
    ISEVEN=lambda x: F.pmod(truncated(x), F.lit(2.0)) == 0, ISODD=lambda x: F.pmod(truncated(x), F.lit(2.0)) == 1, N=lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)),
)

# finance: rates per period, payments at the period's end unless `due` is 1


def _annuity(rate: Column, n: Column) -> Column:
    return F.when(rate == 0, n).otherwise((F.pow(1 + rate, n) - 1) / rate)


def pmt(rate, n, pv, fv=0.0, due=0.0):
    rate, n, pv, fv, due = map(_col, (rate, n, pv, fv, due))
    return -(pv * F.pow(1 + rate, n) + fv) / ((1 + rate * due) * _annuity(rate, n))


def future(rate, n, payment, pv=0.0, due=0.0):
    rate, n, payment, pv, due = map(_col, (rate, n, payment, pv, due))
    return -(pv * F.pow(1 + rate, n) + payment * (1 + rate * due) * _annuity(rate, n))


def present(rate, n, payment, fv=0.0, due=0.0):
    rate, n, payment, fv, due = map(_col, (rate, n, payment, fv, due))
    return -(fv + payment * (1 + rate * due) * _annuity(rate, n)) / F.pow(1 + rate, n)


def ipmt(rate, k, n, pv):
    rate, k, n, pv = map(_col, (rate, k, n, pv))
    return future(rate, k - 1, pmt(rate, n, pv), pv) * rate


FUNCTIONS |= {"PMT": pmt, "FV": future, "PV": present, "IPMT": ipmt, "PPMT": lambda r, k, n, pv: pmt(r, n, pv) - ipmt(r, k, n, pv)}
_family(
    SLN=lambda cost, salvage, life: (cost - salvage) / life, SYD=lambda cost, salvage, life, per: (cost - salvage) * (life - per + 1) * 2 / (life * (life + 1)),
    DDB=lambda cost, salvage, life, per, factor=2.0: F.greatest(F.lit(0.0), F.least(cost * _col(factor) / life * F.pow(1 - _col(factor) / life, per - 1), cost * F.pow(1 - _col(factor) / life, per - 1) - salvage)),
    DB=lambda cost, salvage, life, per: (lambda r: cost * r * F.pow(1 - r, per - 1))(F.round(1 - F.pow(salvage / cost, 1 / life), 3)), EFFECT=lambda r, n: F.pow(1 + r / n, n) - 1, NOMINAL=lambda r, n: n * (F.pow(1 + r, 1 / n) - 1),
    NPER=lambda r, p, pv: F.when(r == 0, -pv / p).otherwise(F.log(p / (p + pv * r)) / F.log(1 + r)), RRI=lambda n, pv, fv: F.pow(fv / pv, 1 / n) - 1, PDURATION=lambda r, pv, fv: (F.log(fv) - F.log(pv)) / F.log(1 + r), DISC=lambda price, redemption, frac: (redemption - price) / redemption / frac,
    DOLLARDE=lambda x, f: truncated(x) + (x - truncated(x)) * F.pow(F.lit(10.0), F.ceil(F.log10(f))) / f, ISPMT=lambda r, k, n, pv: pv * r * (k / n - 1),
)
FUNCTIONS["NPV"] = lambda rate, *flows: reduce(lambda a, b: a + b, [_col(f) / F.pow(1 + _col(rate), F.lit(i)) for i, f in enumerate(flows, 1)])

# transforms; the distributions are in `cellgrid.functions.distributions`
_SQRT_2PI = math.sqrt(2 * math.pi)
_family(
    STANDARDIZE=lambda x, m, s: (x - m) / s, PHI=lambda x: F.exp(-x * x / 2) / _SQRT_2PI, FISHER=lambda x: F.when(F.abs(x) < 1, 0.5 * F.log((1 + x) / (1 - x))), FISHERINV=lambda y: (F.exp(2 * y) - 1) / (F.exp(2 * y) + 1),
)

#: Aggregates: name -> builder over one numeric column (or two).
AGGREGATES = {
    "SUM": F.sum, "AVERAGE": F.avg, "COUNT": F.count, "COUNTA": F.count, "MAX": F.max, "MIN": F.min, "MEDIAN": F.median, "PRODUCT": F.product, "STDEV.S": F.stddev_samp, "STDEV": F.stddev_samp,
    "STDEV.P": F.stddev_pop, "STDEVP": F.stddev_pop, "VAR.S": F.var_samp, "VAR": F.var_samp, "VAR.P": F.var_pop, "VARP": F.var_pop, "SUMSQ": lambda x: F.sum(_col(x) * _col(x)), "DEVSQ": lambda x: F.var_pop(x) * F.count(x),
    "GEOMEAN": lambda x: F.exp(F.avg(F.log(_col(x)))), "HARMEAN": lambda x: 1 / F.avg(1 / _col(x)), "CORREL": F.corr, "PEARSON": F.corr, "COVARIANCE.P": F.covar_pop, "COVARIANCE.S": F.covar_samp, "SLOPE": F.regr_slope,
    "INTERCEPT": F.regr_intercept, "RSQ": F.regr_r2, "SUMPRODUCT": lambda x, y: F.sum(_col(x) * _col(y)), "SUMX2MY2": lambda x, y: F.sum(_col(x) * _col(x) - _col(y) * _col(y)), "SUMX2PY2": lambda x, y: F.sum(_col(x) * _col(x) + _col(y) * _col(y)),
    "SUMXMY2": lambda x, y: F.sum((_col(x) - _col(y)) * (_col(x) - _col(y))), "KURT.P": F.kurtosis, "SKEW.P": F.skewness, "MODE.SNGL": lambda x: F.mode(x, True), "COUNTUNIQUE": F.count_distinct,
}
FUNCTIONS |= {k: v for k, v in AGGREGATES.items() if k not in FUNCTIONS}
#: Operators over whole tables (`cellgrid.operators`): supported, though no expression over the columns of a row.
BY_OPERATOR = (
    "VLOOKUP SUMIF SUMIFS COUNTIF COUNTIFS AVERAGEIF AVERAGEIFS MAXIFS MINIFS AGGREGATE SUBTOTAL GROUPBY PIVOTBY DSUM DCOUNT DGET MMULT"
).split()


#: About a value and its error together: code is in `cellgrid.formula.compiler`.
BY_COMPILER = "ERROR.TYPE ISERR ISERROR ISLOGICAL ISNA ISNONTEXT ISTEXT NA TYPE".split()


def supported() -> list[str]:
    """The names of all functions that have code."""
    return sorted({*FUNCTIONS, *BY_OPERATOR, *BY_COMPILER})
