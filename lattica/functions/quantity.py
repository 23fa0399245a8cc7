"""Element-wise algebra on quantities: a value column, perhaps a variance column, and a unit that is checked at once.

Variances follow first-order Gaussian propagation without correlations. Comparisons are IEEE comparisons (NaN equals nothing),
integer division by zero gives 0 and true division follows IEEE, whatever the session's ANSI mode.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..units import DEG, ONE, RAD, Unit, UnitError, unit_of

NAN, INF = float("nan"), float("inf")


class DTypeError(TypeError):
    pass


class VariancesError(RuntimeError):
    pass


@dataclass(frozen=True)
class Quantity:
    value: Column
    variance: Column | None = None
    unit: Unit | None = ONE
    dtype: str = "float64"  # float64, float32, int64, int32, bool, string, datetime

    @property
    def is_float(self) -> bool:
        return self.dtype.startswith("float")

    def __add__(self, other): return add(self, quantity(other))
    def __sub__(self, other): return subtract(self, quantity(other))
    def __mul__(self, other): return multiply(self, quantity(other))
    def __truediv__(self, other): return divide(self, quantity(other))
    def __floordiv__(self, other): return floor_divide(self, quantity(other))
    def __mod__(self, other): return mod(self, quantity(other))
    def __pow__(self, other): return pow(self, other)
    def __radd__(self, other): return add(quantity(other), self)
    def __rsub__(self, other): return subtract(quantity(other), self)
    def __rmul__(self, other): return multiply(quantity(other), self)
    def __rtruediv__(self, other): return divide(quantity(other), self)
    def __neg__(self): return negative(self)
    def __abs__(self): return absolute(self)
    def __lt__(self, other): return less(self, quantity(other))
    def __gt__(self, other): return greater(self, quantity(other))
    def __le__(self, other): return less_equal(self, quantity(other))
    def __ge__(self, other): return greater_equal(self, quantity(other))
    def __invert__(self): return logical_not(self)
    def __and__(self, other): return logical_and(self, other)
    def __or__(self, other): return logical_or(self, other)
    def __xor__(self, other): return logical_xor(self, other)


def quantity(x: object, unit: str | Unit | None = ONE) -> Quantity:
    """A plain number is dimensionless, a boolean or string has no unit."""
    if isinstance(x, Quantity):
        return x
    if isinstance(x, bool):
        return Quantity(F.lit(x), None, None, "bool")
    if isinstance(x, int):
        return Quantity(F.lit(x).cast("long"), None, unit_of(unit), "int64")
    if isinstance(x, str):
        return Quantity(F.lit(x), None, None, "string")
    return Quantity(F.lit(float(x)), None, unit_of(unit), "float64")


def _same(a: Quantity, b: Quantity, what: str) -> None:
    if a.unit != b.unit:
        raise UnitError(f"{what} needs equal units, not {a.unit} and {b.unit}")


def _wider(a: str, b: str) -> str:
    if "string" in (a, b) or "bool" in (a, b) and a != b:
        raise DTypeError(f"cannot combine {a} and {b}")
    for kind in ("float64", "float32", "int64", "int32"):
        if kind in (a, b):
            return "float64" if kind == "float32" and "int64" in (a, b) else kind
    return a


def _var(*terms: Column | None) -> Column | None:
    there = [t for t in terms if t is not None]
    return sum(there[1:], there[0]) if there else None


def _scaled(variance: Column | None, factor: Column) -> Column | None:
    return None if variance is None else variance * factor


def _no_variance(*xs: Quantity) -> None:
    if any(x.variance is not None for x in xs):
        raise VariancesError("this operation has no rule for variances")


def _float(x: Column) -> Column:
    return x.cast("double")


def _ieee_quotient(a: Column, b: Column) -> Column:
    """True division by IEEE rules: x/0 is an infinity with x's sign (and that of a negative zero), 0/0 is NaN."""
    a, b = _float(a), _float(b)
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when((a > 0) == (F.atan2(b, F.lit(-1.0)) > 0), F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def add(a: Quantity, b: Quantity) -> Quantity:
    if {a.dtype, b.dtype} == {"datetime", "int64"} or "datetime" not in (a.dtype, b.dtype):
        _same(a, b, "add")
    else:
        raise DTypeError(f"cannot add {a.dtype} and {b.dtype}")
    kind = "datetime" if "datetime" in (a.dtype, b.dtype) else _wider(a.dtype, b.dtype)
    return Quantity(a.value + b.value, _var(a.variance, b.variance), a.unit, kind)


def subtract(a: Quantity, b: Quantity) -> Quantity:
    _same(a, b, "subtract")
    if a.dtype == "datetime":
        return Quantity(a.value - b.value, None, a.unit, "int64" if b.dtype == "datetime" else "datetime")
    return Quantity(a.value - b.value, _var(a.variance, b.variance), a.unit, _wider(a.dtype, b.dtype))


def _product_unit(a: Quantity, b: Quantity, divide_: bool = False) -> Unit | None:
    if (a.unit is None) != (b.unit is None):
        raise UnitError("a quantity without unit combines only with another one")
    return None if a.unit is None else a.unit / b.unit if divide_ else a.unit * b.unit


def multiply(a: Quantity, b: Quantity) -> Quantity:
    return Quantity(a.value * b.value, _var(_scaled(a.variance, b.value * b.value), _scaled(b.variance, a.value * a.value)), _product_unit(a, b), _wider(a.dtype, b.dtype))


def divide(a: Quantity, b: Quantity) -> Quantity:
    ratio = _ieee_quotient(a.value, b.value)
    square = _float(b.value) * _float(b.value)
    variance = None
    if a.variance is not None or b.variance is not None:
        variance = _ieee_quotient(_var(a.variance, _scaled(b.variance, ratio * ratio)), square)
    return Quantity(ratio, variance, _product_unit(a, b, True), "float32" if a.dtype == b.dtype == "float32" else "float64")


def _floor_quotient(a: Column, b: Column, integer: bool) -> Column:
    if integer:  # towards minus infinity, 0 for a zero divisor; exact beyond 2 ** 53
        rest = F.try_mod(a, b)
        down = F.when((rest != 0) & ((rest < 0) != (b < 0)), F.lit(1)).otherwise(F.lit(0))
        return F.when(b == 0, F.lit(0).cast("long")).otherwise((F.call_function("div", a, F.nullif(b, F.lit(0))) - down).cast("long"))
    ratio = _ieee_quotient(a, b)
    return F.when(F.isnan(ratio) | (F.abs(ratio) == INF), ratio).otherwise(ratio - F.pmod(ratio, F.lit(1.0)))


def floor_divide(a: Quantity, b: Quantity) -> Quantity:
    _no_variance(a, b)
    kind = _wider(a.dtype, b.dtype)
    return Quantity(_floor_quotient(a.value, b.value, kind.startswith("int")), None, _product_unit(a, b, True), kind)


def mod(a: Quantity, b: Quantity) -> Quantity:
    """The remainder with the divisor's sign; 0 for a zero integer divisor, NaN for a zero float one."""
    _no_variance(a, b)
    _same(a, b, "mod")
    kind, x, y = _wider(a.dtype, b.dtype), a.value, b.value
    rest = F.try_mod(x, y)
    value = F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest)
    return Quantity(F.when(y == 0, F.lit(0) if kind.startswith("int") else F.lit(NAN)).otherwise(value), None, a.unit, kind)


def negative(a: Quantity) -> Quantity:
    return replace(a, value=-a.value)


def absolute(x: Quantity) -> Quantity:
    return replace(x, value=F.abs(x.value))


def reciprocal(x: Quantity) -> Quantity:
    if not x.is_float:
        raise DTypeError("reciprocal needs floating-point values")
    return divide(Quantity(F.lit(1.0)), x)


def pow(base: Quantity, exponent: float | int | Quantity) -> Quantity:
    if isinstance(exponent, Quantity):
        if base.unit != ONE or exponent.unit != ONE:
            raise UnitError("a column as exponent needs dimensionless operands")
        _no_variance(exponent)
        e, unit = exponent.value, ONE
    else:
        e, unit = F.lit(exponent), base.unit ** exponent if base.unit is not None else None
    variance = None if base.variance is None else F.when(e == 0, F.lit(0.0)).otherwise(base.variance * F.pow(_float(e) * F.pow(base.value, e - 1), 2))
    value = F.pow(base.value, e)
    return Quantity(value if base.is_float or not isinstance(exponent, int) else value.cast("long"), variance, unit, base.dtype)


def sqrt(x: Quantity) -> Quantity:
    variance = None if x.variance is None else F.when(x.variance == 0, F.lit(0.0)).otherwise(_ieee_quotient(x.variance * 0.25, x.value))
    return Quantity(F.sqrt(_float(x.value)), variance, None if x.unit is None else x.unit ** 0.5, "float64")


def _dimensionless(x: Quantity, name: str) -> None:
    if x.unit != ONE:
        raise UnitError(f"{name} needs a dimensionless quantity, not {x.unit}")


def exp(x: Quantity) -> Quantity:
    _dimensionless(x, "exp")
    value = F.exp(x.value)
    return Quantity(value, _scaled(x.variance, value * value))


def _logarithm(x: Quantity, name: str, scale: float) -> Quantity:
    _dimensionless(x, name)
    v = _float(x.value)
    inside = F.ln(v) if name == "log" else F.log10(v)
    value = F.when(F.isnan(v) | (v < 0), F.lit(NAN)).when(v == 0, F.lit(-INF)).otherwise(inside)
    return Quantity(value, None if x.variance is None else _ieee_quotient(x.variance, v * v * scale))


def log(x: Quantity) -> Quantity:
    return _logarithm(x, "log", 1.0)


def log10(x: Quantity) -> Quantity:
    return _logarithm(x, "log10", math.log(10) ** 2)


def round(x: Quantity, decimals: int = 0) -> Quantity:
    """To even at a half."""
    factor = 10.0**decimals
    return replace(x, value=F.rint(x.value * factor) / factor if decimals else F.rint(x.value), variance=None)


def floor(x: Quantity) -> Quantity:
    return replace(x, value=F.when(F.isnan(x.value) | (F.abs(x.value) == INF), x.value).otherwise(F.floor(x.value)).cast("double"), variance=None) if x.is_float else x


def ceil(x: Quantity) -> Quantity:
    return replace(x, value=F.when(F.isnan(x.value) | (F.abs(x.value) == INF), x.value).otherwise(F.ceil(x.value)).cast("double"), variance=None) if x.is_float else x


def nan_to_num(x: Quantity, nan: float | None = None, posinf: float | None = None, neginf: float | None = None) -> Quantity:
    value = x.value
    for test, to in ((F.isnan(x.value), nan), (x.value == INF, posinf), (x.value == -INF, neginf)):
        value = value if to is None else F.when(test, F.lit(to)).otherwise(value)
    return replace(x, value=value)


def _angle(x: Quantity, name: str) -> Quantity:
    if x.unit == DEG:
        return multiply(x, Quantity(F.lit(math.pi / 180), None, RAD / DEG))
    if x.unit != RAD:
        raise UnitError(f"{name} needs an angle, not {x.unit}")
    return x


def _function(name: str, value, slope, taken: str = "one", given: Unit = ONE):
    """An element-wise function with the derivative that its variance needs."""

    def apply(x: Quantity) -> Quantity:
        if taken == "angle":
            x = _angle(x, name)
        else:
            _dimensionless(x, name)
        v = _float(x.value)
        return Quantity(value(v), None if x.variance is None else x.variance * F.pow(slope(v), 2), given)

    apply.__name__ = name
    return apply


_inside = lambda f: lambda v: F.when((v < -1) | (v > 1), F.lit(NAN)).otherwise(f(v))
sin = _function("sin", F.sin, F.cos, "angle")
cos = _function("cos", F.cos, F.sin, "angle")
tan = _function("tan", F.tan, lambda v: 1 / F.pow(F.cos(v), 2), "angle")
asin = _function("asin", _inside(F.asin), lambda v: 1 / F.sqrt(1 - v * v), given=RAD)
acos = _function("acos", _inside(F.acos), lambda v: 1 / F.sqrt(1 - v * v), given=RAD)
atan = _function("atan", F.atan, lambda v: 1 / (1 + v * v), given=RAD)
sinh = _function("sinh", F.sinh, F.cosh)
cosh = _function("cosh", F.cosh, F.sinh)
tanh = _function("tanh", F.tanh, lambda v: 1 - F.pow(F.tanh(v), 2))
asinh = _function("asinh", F.asinh, lambda v: 1 / F.sqrt(v * v + 1))
acosh = _function("acosh", F.acosh, lambda v: 1 / F.sqrt(v * v - 1))
atanh = _function("atanh", F.atanh, lambda v: 1 / (1 - v * v))


def atan2(y: Quantity, x: Quantity) -> Quantity:
    _same(y, x, "atan2")
    _no_variance(y, x)
    return Quantity(F.atan2(y.value, x.value), None, RAD)


def sinc(x: Quantity) -> Quantity:
    if x.unit not in (RAD, ONE):
        raise UnitError(f"sinc needs an angle or a dimensionless quantity, not {x.unit}")
    _no_variance(x)
    return Quantity(F.when(x.value == 0, F.lit(1.0)).otherwise(F.try_divide(F.sin(x.value), x.value)))


def _erf_column(v: Column, complement: bool) -> Column:
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def run(s):  # Spark has no error function: Arrow batches through the C library's
        return s.map(math.erfc if complement else math.erf, na_action="ignore")

    return run(v)


def erf(x: Quantity) -> Quantity:
    _dimensionless(x, "erf")
    _no_variance(x)
    return Quantity(_erf_column(_float(x.value), False))


def erfc(x: Quantity) -> Quantity:
    _dimensionless(x, "erfc")
    _no_variance(x)
    return Quantity(_erf_column(_float(x.value), True))


def _compare(name: str, test, on_nan: bool = False):
    def apply(x: Quantity, y: Quantity) -> Quantity:
        x, y = quantity(x), quantity(y)
        _same(x, y, name)
        result = test(x.value, y.value)
        if x.is_float or y.is_float:
            odd = F.isnan(_float(x.value)) | F.isnan(_float(y.value))
            result = F.when(odd, F.lit(on_nan)).otherwise(result)
        return Quantity(result, None, None, "bool")

    apply.__name__ = name
    return apply


less = _compare("less", lambda x, y: x < y)
greater = _compare("greater", lambda x, y: x > y)
less_equal = _compare("less_equal", lambda x, y: x <= y)
greater_equal = _compare("greater_equal", lambda x, y: x >= y)
equal = _compare("equal", lambda x, y: x == y)
not_equal = _compare("not_equal", lambda x, y: x != y, True)


def isclose(x: Quantity, y: Quantity, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Quantity:
    """``|x - y| <= atol + rtol |y|``; infinities are close to their like only. With variances, standard deviations are close too."""
    _same(x, y, "isclose")
    test = lambda a, b: F.when(F.isnan(a) | F.isnan(b), (F.isnan(a) & F.isnan(b)) if equal_nan else F.lit(False)).when((F.abs(a) == INF) | (F.abs(b) == INF), a == b).otherwise(F.abs(a - b) <= atol + rtol * F.abs(b))
    close = test(_float(x.value), _float(y.value))
    if (x.variance is None) != (y.variance is None):
        raise VariancesError("only one operand has variances")
    if x.variance is not None:
        close = close & test(F.sqrt(x.variance), F.sqrt(y.variance))
    return Quantity(close, None, None, "bool")


def _logical(name: str, rule):
    def apply(*xs: Quantity) -> Quantity:
        xs = [quantity(x) for x in xs]
        if any(x.dtype != "bool" or x.unit is not None for x in xs):
            raise DTypeError(f"{name} needs booleans without unit")
        return Quantity(rule(*(x.value for x in xs)), None, None, "bool")

    apply.__name__ = name
    return apply


logical_not = _logical("logical_not", lambda x: ~x)
logical_and = _logical("logical_and", lambda x, y: x & y)
logical_or = _logical("logical_or", lambda x, y: x | y)
logical_xor = _logical("logical_xor", lambda x, y: x != y)


def _predicate(test):
    return lambda x: Quantity(test(x.value) if x.is_float else F.lit(False), None, None, "bool")


isnan = _predicate(F.isnan)
isinf = _predicate(lambda v: F.abs(v) == INF)
isposinf = _predicate(lambda v: v == INF)
isneginf = _predicate(lambda v: v == -INF)


def isfinite(x: Quantity) -> Quantity:
    return Quantity(~F.isnan(x.value) & (F.abs(x.value) != INF) if x.is_float else F.lit(True), None, None, "bool")


def where(condition: Quantity, x: Quantity, y: Quantity) -> Quantity:
    if condition.dtype != "bool" or condition.unit is not None:
        raise DTypeError("the condition has to be boolean, without unit")
    _same(x, y, "where")
    variance = None
    if x.variance is not None and y.variance is not None:
        variance = F.when(condition.value, x.variance).otherwise(y.variance)
    return Quantity(F.when(condition.value, x.value).otherwise(y.value), variance, x.unit, x.dtype)


def values(x: Quantity) -> Quantity:
    return replace(x, variance=None)


def _variance_of(x: Quantity) -> Column:
    if x.variance is None:
        raise VariancesError("there are no variances")
    return x.variance


def variances(x: Quantity) -> Quantity:
    return Quantity(_variance_of(x), None, None if x.unit is None else x.unit * x.unit)


def stddevs(x: Quantity) -> Quantity:
    return Quantity(F.sqrt(_variance_of(x)), None, x.unit)


#: Spark's names of the types.
SPARK = {"float64": "double", "float32": "float", "int64": "bigint", "int32": "int", "bool": "boolean", "string": "string", "datetime": "bigint"}
KINDS = {"double": "float64", "float": "float32", "bigint": "int64", "int": "int32", "boolean": "bool", "string": "string", "timestamp": "datetime", "timestamp_ntz": "datetime"}


def astype(x: Quantity, dtype: str) -> Quantity:
    if dtype not in SPARK:
        raise DTypeError(f"no such dtype: {dtype}")
    if dtype.startswith("int") and x.variance is not None:
        raise VariancesError("integers have no variances")
    return replace(x, value=x.value.cast(SPARK[dtype]), dtype=dtype)


def to_unit(x: Quantity, unit: str | Unit) -> Quantity:
    """Integers are rounded, halves away from zero; a datetime does not go to or from calendar-sized units."""
    unit = unit_of(unit)
    if x.unit is None:
        raise UnitError("a quantity without unit has nothing to convert")
    factor = x.unit.factor_to(unit)
    if factor == 1:
        return replace(x, unit=unit)
    if x.dtype == "datetime" and max(x.unit.scale, unit.scale) >= 86400:
        raise UnitError("datetimes convert between units below a day only")
    if x.dtype in ("int64", "int32", "datetime"):
        exact = x.value * int(factor) if factor == int(factor) else None
        scaled = _float(x.value) * factor
        value = exact if exact is not None else F.when(scaled < 0, -F.floor(-scaled + 0.5)).otherwise(F.floor(scaled + 0.5)).cast("long")
        return replace(x, value=value, unit=unit)
    return replace(x, value=x.value * factor, variance=_scaled(x.variance, F.lit(factor * factor)), unit=unit)


def to(x: Quantity, unit: str | Unit | None = None, dtype: str | None = None) -> Quantity:
    """Both conversions, in the order that loses less: to floats before, to integers after the unit."""
    if dtype and dtype.startswith("float"):
        x = astype(x, dtype)
    x = to_unit(x, unit) if unit is not None else x
    return astype(x, dtype) if dtype and not dtype.startswith("float") else x
