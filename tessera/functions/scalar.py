"""Core operators, mathematics, special functions, strings, expressions, parsing, casts, bytes, enums, time, imputation."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import LIBRARY, Const, d, define_all, fail, guard, i, lam, let, trait

def _inf() -> Column:
    return F.lit(float("inf"))


def _nan() -> Column:
    return F.lit(float("nan"))


def divide(x, y):
    x, y = d(x), d(y)
    by_zero = F.when(F.isnan(x) | (x == 0), _nan()).when((x > 0) != y.cast("string").startswith("-"), _inf()).otherwise(-_inf())
    return F.when(y == 0, by_zero).otherwise(x / y)


def floor_divide(x, y):
    return guard(y == 0, 18040, "integer division by zero", F.call_function("div", x, y))


def _kinds(*xs) -> set[str]:
    return {t.simpleString() for x in xs if (t := trait(x, "_type")) is not None}


def _by_zero(k, n, code, value):
    """Whole numbers have no remainder by zero; that of real ones is not a number."""
    real = _kinds(k, n) & {"float", "double"}
    return F.when(n == 0, _nan() if real else fail(code, "integer division by zero")).otherwise(value)


def modulo(k, n):
    return _by_zero(k, n, 18060, ((k % n) + n) % n)


def remainder(k, n):
    return _by_zero(k, n, 18070, k % n)


def power(x, y):
    """Of whole numbers a whole number, or an error where it doesn't fit."""
    value, kinds = F.pow(x, y), _kinds(x, y)
    if not kinds or not kinds <= {"int", "bigint"}:
        return value
    kind, limit = ("bigint", 2.0**63) if "bigint" in kinds else ("int", 2.0**31)
    return guard((value >= limit) | (value < -limit), 18080, "int overflow", value.cast(kind))


def negative(x) -> Column:
    """Whether the sign is minus, also that of zero."""
    return (x < 0) | ((x == 0) & d(x).cast("string").startswith("-"))


define_all("", {
    "+": lambda x, y: x + y,
    "-": lambda x, y: x - y,
    "*": lambda x, y: x * y,
    "/": divide,
    "//": floor_divide,
    "u-": lambda x: -x,
    "%": modulo,
    "%%": remainder,
    "**": power,
    "cmp": lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0),
    "==": lambda x, y: x.eqNullSafe(y),
    "!=": lambda x, y: ~x.eqNullSafe(y),
    ">=": lambda x, y: x >= y,
    ">": lambda x, y: x > y,
    "<": lambda x, y: x < y,
    "<=": lambda x, y: x <= y,
    "max": lambda x, y: F.when(x >= y, x).otherwise(y),
    "min": lambda x, y: F.when(x < y, x).otherwise(y),
    "&&": lambda x, y: F.when(x, y).otherwise(F.lit(False)),
    "||": lambda x, y: F.when(x, F.lit(True)).otherwise(y),
    "^^": lambda x, y: x != y,
    "!": lambda x: ~x,
    "&&&": lambda x, y: x & y,
    "|||": lambda x, y: x | y,
    "!!!": lambda x: ~x,
    "&": lambda x, y: x.bitwiseAND(y),
    "|": lambda x, y: x.bitwiseOR(y),
    "^": lambda x, y: x.bitwiseXOR(y),
    "~": lambda x: F.bitwise_not(x),
})


def half_even(x):
    return F.rint(d(x))


def log_base(x, base):
    return guard(base <= 0, 27140, "base must be positive", F.ln(d(x)) / F.ln(d(base)))


def _domain(f, bad):
    """Outside of the domain the result is not a number rather than null."""
    return lambda x: F.when(bad(d(x)), _nan()).otherwise(f(d(x)))


def _ln(x, f=F.ln, at=0.0):
    x = d(x)
    return F.when(x == at, -_inf()).when(x < at, _nan()).otherwise(f(x))


define_all("m.", {
    "pi": lambda: F.lit(math.pi),
    "e": lambda: F.lit(math.e),
    "abs": lambda x: F.abs(x),
    "acos": lambda x: F.acos(d(x)),
    "asin": lambda x: F.asin(d(x)),
    "atan": lambda x: F.atan(d(x)),
    "atan2": lambda y, x: F.atan2(d(y), d(x)),
    "ceil": lambda x: F.ceil(d(x)).cast("double"),
    "copysign": lambda mag, sign: F.when(negative(sign), -F.abs(mag)).otherwise(F.abs(mag)),
    "cos": lambda x: F.cos(d(x)),
    "cosh": lambda x: F.cosh(d(x)),
    "exp": lambda x: F.exp(d(x)),
    "expm1": lambda x: F.expm1(d(x)),
    "floor": lambda x: F.floor(d(x)).cast("double"),
    "hypot": lambda x, y: F.hypot(d(x), d(y)),
    "ln": _ln,
    "log10": lambda x: _ln(x, F.log10),
    "log": log_base,
    "ln1p": lambda x: _ln(x, F.log1p, -1.0),
    "round": lambda x: (F.floor(d(x)) + F.when(d(x) - F.floor(d(x)) >= 0.5, 1).otherwise(0)).cast("long"),
    "rint": half_even,
    "signum": lambda x: i(F.signum(d(x))),
    "sin": lambda x: F.sin(d(x)),
    "sinh": lambda x: F.sinh(d(x)),
    "sqrt": _domain(F.sqrt, lambda x: x < 0),
    "tan": lambda x: F.tan(d(x)),
    "tanh": lambda x: F.tanh(d(x)),
})

#: The Lanczos coefficients for g = 7, n = 9.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def ln_gamma(x) -> Column:
    x = d(x)

    def upper(z: Column) -> Column:
        z = z - 1
        total = F.lit(LANCZOS[0])
        for k, c in enumerate(LANCZOS[1:], 1):
            total = total + c / (z + k)
        t = z + 7.5
        return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(t) - t + F.ln(total)

    return F.when(x <= 0, fail(23040, "domain error")).when(x < 0.5, math.log(math.pi) - F.ln(F.sin(math.pi * x)) - upper(1 - x)).otherwise(upper(x))


def _erf_near(x) -> Column:
    """The power series of the error function, by Horner's rule; for arguments below 2.2."""
    square, total = -(x * x), F.lit(0.0)
    for n in range(40, -1, -1):
        total = total * square + 1 / (math.factorial(n) * (2 * n + 1))
    return total * x * (2 / math.sqrt(math.pi))


def _erf_tail(a) -> Column:
    """What the error function lacks to one, by a continued fraction; for arguments of 2.2 and more."""
    f = a
    for k in range(40, 0, -1):
        f = a + (k / 2) / f
    return F.exp(-a * a) / (f * math.sqrt(math.pi))


def erf(x) -> Column:
    return let(d(x), lambda v: F.when(F.abs(v) < 2.2, _erf_near(v)).otherwise(F.signum(v) * (1 - _erf_tail(F.abs(v)))))


def erfc(x) -> Column:
    return let(d(x), lambda v: F.when(F.abs(v) < 2.2, 1 - _erf_near(v)).when(v > 0, _erf_tail(v)).otherwise(2 - _erf_tail(-v)))


define_all("m.special.", {
    "nChooseK": lambda n, k: guard((k < 0) | (n < k) | (n <= 0), 23000, "domain error", i(F.round(F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda a, j: a * (n - k + j) / j)))),
    "lnBeta": lambda a, b: guard((a <= 0) | (b <= 0), 23010, "domain error", ln_gamma(a) + ln_gamma(b) - ln_gamma(a + b)),
    "erf": erf,
    "erfc": erfc,
    "lnGamma": ln_gamma,
})


def clip_index(n, k) -> Column:
    """Negative indexes count from the end; both ends are clipped."""
    return F.least(F.greatest(F.when(k < 0, n + k).otherwise(k), F.lit(0)), n)


def substr(s, start, end):
    n = F.length(s)
    a, b = clip_index(n, start), clip_index(n, end)
    return F.when(b <= a, F.lit("")).otherwise(F.substring(s, a + 1, b - a))


def substrto(s, start, end, replacement):
    n = F.length(s)
    a = clip_index(n, start)
    b = F.greatest(clip_index(n, end), a)
    return F.concat(F.substring(s, F.lit(1), a), replacement, F.substring(s, b + 1, F.greatest(n - b, F.lit(0))))


def quote(s) -> Column:
    return F.concat(F.lit("\\Q"), s, F.lit("\\E"))


def count_of(s, needle):
    whole = F.length(s) - F.length(F.replace(s, needle, F.lit("")))
    return i(F.when(needle == "", F.length(s) + 1).otherwise(F.call_function("div", whole, F.greatest(F.length(needle), F.lit(1)))))


def rindex(s, needle):
    at = F.call_function("locate", F.reverse(needle), F.reverse(s))
    return i(F.when(at == 0, -1).otherwise(F.length(s) - at - F.length(needle) + 1))


def replace_first(s, old, new):
    at = F.call_function("locate", old, s)
    return F.when((at == 0) | (old == ""), s).otherwise(F.concat(F.substring(s, F.lit(1), at - 1), new, F.substring(s, at + F.length(old), F.length(s))))


def replace_last(s, old, new):
    at = rindex(s, old)
    return F.when(at < 0, s).otherwise(F.concat(F.substring(s, F.lit(1), at), new, F.substring(s, at + F.length(old) + 1, F.length(s))))


def padded(text, width, zero) -> Column:
    return F.when(F.length(text) >= F.abs(width), text).when(width < 0, F.rpad(text, -width, F.lit(" "))).when(zero, F.lpad(text, width, F.lit("0"))).otherwise(F.lpad(text, width, F.lit(" ")))


def number_text(x, width=None, zero=None):
    text = x.cast("string")
    if width is None:
        return text
    signed = F.when((x < 0) & zero & (width > 0), F.concat(F.lit("-"), F.lpad(F.abs(x).cast("string"), F.greatest(width - 1, F.length(text) - 1), F.lit("0"))))
    return F.coalesce(signed, padded(text, width, zero))


def hex_text(x, width=None, zero=None):
    text = F.lower(F.hex(x.cast("long")))
    return text if width is None else padded(text, width, zero)


def split_text(s, sep):
    return F.when(sep == "", F.array(s)).otherwise(F.split(s, quote(sep), -1))


define_all("s.", {
    "len": lambda s: F.length(s),
    "substr": substr,
    "substrto": substrto,
    "contains": lambda s, n: F.contains(s, n),
    "count": count_of,
    "index": lambda s, n: i(F.call_function("locate", n, s) - 1),
    "rindex": rindex,
    "startswith": lambda s, n: F.startswith(s, n),
    "endswith": lambda s, n: F.endswith(s, n),
    "join": lambda a, sep: F.call_function("array_join", a, sep),
    "split": split_text,
    "hex": hex_text,
    "int": number_text,
    "number": number_text,
    "concat": lambda x, y: F.concat(x, y),
    "repeat": lambda s, n: F.repeat(s, n),
    "lower": lambda s: F.lower(s),
    "upper": lambda s: F.upper(s),
    "lstrip": lambda s, c: F.call_function("ltrim", c, s),
    "rstrip": lambda s, c: F.call_function("rtrim", c, s),
    "strip": lambda s, c: F.call_function("btrim", s, c),
    "replaceall": lambda s, a, b: F.replace(s, a, b),
    "replacefirst": replace_first,
    "replacelast": replace_last,
    "translate": lambda s, a, b: F.call_function("translate", s, a, b),
})


def re_spans(s, p):
    """[start, end] of all matches, from the gaps between them."""
    found = F.regexp_extract_all(s, p, F.lit(0))
    gaps = F.split(s, p, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))

    def step(a, k):
        start = a["at"] + F.length(F.get(gaps, k))
        end = start + F.length(F.get(found, k))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.array(start, end))).alias("out"))

    n = F.size(found)
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), zero, step)["out"]


def re_groups_of_first(s, p):
    whole = F.regexp_substr(s, p)
    groups = lambda k: F.regexp_extract(s, p, k)
    n = F.regexp_count(p, F.lit(r"(?<!\\)\((?!\?)"))
    return F.when(whole.isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n), lambda k: F.call_function("regexp_extract", s, p, k)))


def _python_spans(find):
    """Group positions need a matcher that tells them: Python's, over batches."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType()))))
    def run(s: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([[[list(m.span(k)) for k in range(m.re.groups + 1)] for m in find(b, a)] for a, b in zip(s, p, strict=True)])

    return run


_all_groups = _python_spans(re.finditer)
_none = lambda t: F.array().cast(t)
define_all("re.", {
    "index": lambda s, p: F.coalesce(F.get(re_spans(s, p), F.lit(0)), _none("array<int>")),
    "rindex": lambda s, p: F.coalesce(F.try_element_at(re_spans(s, p), F.lit(-1)), _none("array<int>")),
    "contains": lambda s, p: F.rlike(s, p),
    "count": lambda s, p: F.regexp_count(s, p),
    "indexall": re_spans,
    "findall": lambda s, p: F.regexp_extract_all(s, p, F.lit(0)),
    "groups": lambda s, p: F.coalesce(F.get(_all_groups(s, p), F.lit(0)), _none("array<array<int>>")),
    "groupsall": lambda s, p: _all_groups(s, p),
    "findfirst": lambda s, p: F.regexp_substr(s, p),
    "findgroupsfirst": re_groups_of_first,
    "findgroupsall": lambda s, p: F.transform(F.regexp_extract_all(s, p, F.lit(0)), lambda m: re_groups_of_first(m, p)),
    "replacefirst": lambda s, p, r: F.when(F.rlike(s, p), replace_first(s, F.regexp_substr(s, p), r)).otherwise(s),
    "replacelast": lambda s, p, r: F.when(F.rlike(s, p), replace_last(s, F.element_at(F.regexp_extract_all(s, p, F.lit(0)), -1), r)).otherwise(s),
    "replaceall": lambda s, p, r: F.regexp_replace(s, p, r),
    "split": lambda s, p: F.split(s, p, -1),
})


def parse_int(s, base, low, high, kind, code):
    text = F.trim(s)
    valid = text.rlike(r"^[+-]?[0-9A-Za-z]+$")
    value = F.when(base == 10, text.try_cast("bigint")).otherwise(F.call_function("conv", text, base, F.lit(-10)).try_cast("bigint"))
    bad = ~valid | value.isNull() | (value < low) | (value > high)
    return F.when(bad, fail(code, "not an integer")).otherwise(value.cast(kind))


def parse_real(s, kind, code):
    value = F.trim(s).try_cast(kind)
    return F.when(value.isNull(), fail(code, "not a number")).otherwise(value)


define_all("parse.", {
    "int": lambda s, base: parse_int(s, base, -(2**31), 2**31 - 1, "int", 33000),
    "long": lambda s, base: parse_int(s, base, -(2**63), 2**63 - 1, "long", 33010),
    "float": lambda s: parse_real(s, "float", 33020),
    "double": lambda s: parse_real(s, "double", 33030),
})


def fan_int(x, low, high, other=None):
    ks = F.sequence(low, high - 1)
    out = F.transform(ks, lambda k: k == x)
    return out if other is None else F.when(other, F.concat(out, F.array((x < low) | (x >= high)))).otherwise(out)


def _fanout(kind):
    def f(x, a, b=None, c=None):
        if c is not None or (b is not None and not isinstance(a, Const)):
            made = fan_int(x, a, b, c)
        else:
            symbols = a.value if isinstance(a, Const) else a
            made = F.transform(a.column if isinstance(a, Const) else a, lambda s: s == x) if not isinstance(symbols, list) else F.array(*(x == F.lit(s) for s in symbols))
            if b is not None:
                made = F.when(b, F.concat(made, F.array(~F.array_contains(made, True)))).otherwise(made)
        return made if kind == "boolean" else F.transform(made, lambda v: v.cast(kind))

    return f


define_all("cast.", {
    "int": lambda x: i(F.rint(d(x))),
    "long": lambda x: F.rint(d(x)).cast("long"),
    "float": lambda x: x.cast("float"),
    "double": lambda x: d(x),
    "signed": lambda x, bits: F.when(bits == 64, x.cast("long")).otherwise(F.pmod(x.cast("long") + F.pow(F.lit(2.0), bits - 1).cast("long"), F.pow(F.lit(2.0), bits).cast("long")) - F.pow(F.lit(2.0), bits - 1).cast("long")),
    "unsigned": lambda x, bits: F.pmod(x.cast("long"), F.pow(F.lit(2.0), bits).cast("long")),
    "fanoutBoolean": _fanout("boolean"),
    "fanoutInt": _fanout("int"),
    "fanoutLong": _fanout("long"),
    "fanoutFloat": _fanout("float"),
    "fanoutDouble": _fanout("double"),
    "json": lambda x: F.when(F.typeof(x) == "string", x.cast("string")).otherwise(F.substring(F.to_json(F.struct(x.alias("v"))), 6, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.struct(x.alias("v")))) - 6)),
})


def _charset(name):
    return lambda b: F.decode(b, name)


def _encode(name):
    return lambda s: F.encode(s, name)


for _label, _charset_name in {"Utf8": "UTF-8", "Latin1": "ISO-8859-1", "Ascii": "US-ASCII", "Utf16": "UTF-16", "Utf16be": "UTF-16BE", "Utf16le": "UTF-16LE"}.items():
    LIBRARY[f"bytes.decode{_label}"] = _charset(_charset_name)
    LIBRARY[f"bytes.encode{_label}"] = _encode(_charset_name)


def is_utf16(b, little: Column) -> Column:
    """Whole 16-bit units, and every high surrogate is followed by a low one."""
    unit = lambda k: F.substring(b, 2 * k + 1, F.lit(2))
    high = lambda k: F.hex(F.substring(unit(k), F.when(little, F.lit(2)).otherwise(F.lit(1)), F.lit(1)))
    n = F.call_function("div", F.length(b), F.lit(2)).cast("int")
    kinds = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.when(high(k).between("D8", "DB"), F.lit("h")).when(high(k).between("DC", "DF"), F.lit("l")).otherwise(F.lit(".")))
    return (F.length(b) % 2 == 0) & (F.replace(F.array_join(kinds, ""), F.lit("hl"), F.lit("")).rlike("[hl]") == F.lit(False))


def byte_slice(b, start, end):
    n = F.length(b)
    a, z = clip_index(n, start), clip_index(n, end)
    return F.substring(b, a + 1, F.greatest(z - a, F.lit(0)))


define_all("bytes.", {
    "len": lambda b: F.length(b),
    "subseq": byte_slice,
    "subseqto": lambda b, start, end, r: F.concat(F.substring(b, F.lit(1), clip_index(F.length(b), start)), r, F.substring(b, F.greatest(clip_index(F.length(b), end), clip_index(F.length(b), start)) + 1, F.length(b))),
    "isAscii": lambda b: ~F.hex(b).rlike("^(?:..)*[89A-F]."),
    "isUtf8": lambda b: F.call_function("is_valid_utf8", b),
    "isLatin1": lambda b: b.isNotNull(),
    "isUtf16": lambda b: is_utf16(b, F.hex(F.substring(b, F.lit(1), F.lit(2))) == "FFFE"),
    "isUtf16be": lambda b: is_utf16(b, F.lit(False)),
    "isUtf16le": lambda b: is_utf16(b, F.lit(True)),
    "toBase64": lambda b: F.translate(F.base64(b), "\r\n", ""),
    "fromBase64": lambda s: F.unbase64(s),
})
define_all("fixed.", {"toBytes": lambda x: x, "fromBytes": lambda x, r: F.concat(F.substring(r, F.lit(1), F.length(x)), F.substring(x, F.length(r) + 1, F.length(x)))})
define_all("enum.", {
    "toString": lambda x, *_: x.column if isinstance(x, Const) else x,
    "toInt": lambda x, symbols: i(F.array_position(F.array(*map(F.lit, symbols.value)), x.column if isinstance(x, Const) else x) - 1),
    "numSymbols": lambda x, symbols: F.lit(len(symbols.value)),
})


def local(ts, zone) -> Column:
    """Local timestamp of epoch seconds in a zone ("" is UTC), whatever the session's zone is."""
    utc = F.timestamp_micros(F.round(d(ts) * 1_000_000).cast("long"))
    return F.convert_timezone(F.current_timezone(), F.when(zone == "", F.lit("UTC")).otherwise(zone), utc.cast("timestamp_ntz")) if not isinstance(zone, Const) else F.convert_timezone(F.current_timezone(), F.lit(zone.value or "UTC"), utc.cast("timestamp_ntz"))


def _second(t):
    return F.call_function("date_part", F.lit("SECOND"), t).cast("double")


def _minute(t):
    return F.minute(t) + _second(t) / 60


def _hour(t):
    return F.hour(t) + _minute(t) / 60


_weekday = lambda t: F.weekday(t)  # noqa: E731  Monday is 0
define_all("time.", {
    "year": lambda ts, z: F.year(local(ts, z)),
    "monthOfYear": lambda ts, z: F.month(local(ts, z)),
    "dayOfYear": lambda ts, z: F.dayofyear(local(ts, z)),
    "dayOfMonth": lambda ts, z: F.dayofmonth(local(ts, z)),
    "dayOfWeek": lambda ts, z: _weekday(local(ts, z)),
    "hourOfDay": lambda ts, z: F.hour(local(ts, z)),
    "minuteOfHour": lambda ts, z: F.minute(local(ts, z)),
    "secondOfMinute": lambda ts, z: i(F.floor(_second(local(ts, z)))),
    "makeTimestamp": lambda y, mo, day, h, mi, s, ms, z: F.unix_micros(F.call_function("make_timestamp", y, mo, day, h, mi, s + ms / 1000.0, F.when(z == "", F.lit("UTC")).otherwise(z))) / 1e6,
    "isSecondOfMinute": lambda ts, z, lo, hi: (_second(local(ts, z)) >= lo) & (_second(local(ts, z)) < hi),
    "isMinuteOfHour": lambda ts, z, lo, hi: (_minute(local(ts, z)) >= lo) & (_minute(local(ts, z)) < hi),
    "isHourOfDay": lambda ts, z, lo, hi: (_hour(local(ts, z)) >= lo) & (_hour(local(ts, z)) < hi),
    "isDayOfWeek": lambda ts, z, lo, hi: (_weekday(local(ts, z)) + _hour(local(ts, z)) / 24 >= lo) & (_weekday(local(ts, z)) + _hour(local(ts, z)) / 24 < hi),
    "isDayOfMonth": lambda ts, z, lo, hi: (F.dayofmonth(local(ts, z)) + _hour(local(ts, z)) / 24 >= lo) & (F.dayofmonth(local(ts, z)) + _hour(local(ts, z)) / 24 < hi),
    "isMonthOfYear": lambda ts, z, lo, hi: (F.month(local(ts, z)) + (F.dayofmonth(local(ts, z)) - 1) / 31 >= lo) & (F.month(local(ts, z)) + (F.dayofmonth(local(ts, z)) - 1) / 31 < hi),
    "isDayOfYear": lambda ts, z, lo, hi: (F.dayofyear(local(ts, z)) + _hour(local(ts, z)) / 24 >= lo) & (F.dayofyear(local(ts, z)) + _hour(local(ts, z)) / 24 < hi),
    "isWeekend": lambda ts, z: _weekday(local(ts, z)) >= 5,
    "isWorkHours": lambda ts, z: (_weekday(local(ts, z)) < 5) & (F.hour(local(ts, z)) >= 9) & (F.hour(local(ts, z)) < 17),
})

_isnum = lambda x: ~F.isnan(d(x)) & (F.abs(d(x)) != _inf())
define_all("impute.", {
    "errorOnNull": lambda x: guard(x.isNull(), 21000, "encountered null", x),
    "defaultOnNull": lambda x, v: F.coalesce(x, v),
    "isnan": lambda x: F.isnan(d(x)),
    "isinf": lambda x: F.abs(d(x)) == _inf(),
    "isnum": _isnum,
    "errorOnNonNum": lambda x: guard(~_isnum(x), 21060, "encountered non-number", x),
    "defaultOnNonNum": lambda x, v: F.when(_isnum(x), x).otherwise(v),
})
