"""Registered queries of the engine, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import operators as ops
from .plans.compiler import Compiler, Engine, mark

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def family(name: str, source: str, keys: list[str], bind: dict[str, tuple[str, str]], rows: list[tuple]) -> None:
    """A query with a column per expression: (column, document expression, SQL[, digits]) over bound input symbols."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source).select(*keys, *(F.expr(s).alias(f"in_{b}") for b, (s, _) in bind.items()))
        env = {b: mark(F.col(f"in_{b}"), df.schema[f"in_{b}"].dataType) for b in bind}
        out = []
        for column, expression, _, *digits in rows:
            c = Compiler({"input": "null", "output": "null", "action": None})
            value = c.column(c.expr(expression, dict(env)))
            out.append((value.cast("double") if digits else value).alias(column))
        # rounded above the values, so that each is evaluated once
        return df.select(*keys, *out).select(*keys, *(ops.rounded(column, digits[0]).alias(column) if digits else column for column, _, _, *digits in rows))

    QUERIES[name] = run
    columns = ", ".join(f"round(CAST({sql} AS DOUBLE), {d[0]}) AS {c}" if d else f"{sql} AS {c}" for c, _, sql, *d in rows)
    bound = ", ".join(f"{sql} AS {b}" for b, (_, sql) in bind.items())
    ORACLE[name] = f"WITH t AS (SELECT {', '.join(keys)}, {bound} FROM {source}) SELECT {', '.join(keys)}, {columns} FROM t"


LINE = ["l_orderkey", "l_linenumber"]
X = {"x": ("l_quantity", "l_quantity"), "y": ("l_discount", "l_discount"), "p": ("l_extendedprice", "l_extendedprice"), "n": ("l_linenumber", "l_linenumber"), "k": ("l_partkey", "l_partkey")}
family("fn_core", "lineitem", LINE, X, [
    ("add", {"+": ["x", "y"]}, "x + y", 6),
    ("sub", {"-": ["x", "p"]}, "x - p", 6),
    ("mul", {"*": ["x", "p"]}, "x * p", 4),
    ("div", {"/": ["p", "x"]}, "p / x", 9),
    ("div_zero", {"/": ["p", {"-": ["x", "x"]}]}, "CAST('inf' AS DOUBLE)"),
    ("floor_div", {"//": ["k", "n"]}, "k // n"),
    ("neg", {"u-": ["n"]}, "-n"),
    ("modulo", {"%": [{"u-": ["k"]}, "n"]}, "((-k % n) + n) % n"),
    ("remainder", {"%%": [{"u-": ["k"]}, "n"]}, "-k % n"),
    ("power", {"**": ["y", 2]}, "pow(y, 2)", 6),
    ("compare", {"cmp": ["x", "k"]}, "CASE WHEN x < k THEN -1 WHEN x > k THEN 1 ELSE 0 END"),
    ("eq", {"==": ["n", 1]}, "n = 1"),
    ("ne", {"!=": ["n", 1]}, "n <> 1"),
    ("lt", {"<": ["x", "k"]}, "x < k"),
    ("le", {"<=": ["x", 25]}, "x <= 25"),
    ("gt", {">": ["x", 25]}, "x > 25"),
    ("ge", {">=": ["x", 25]}, "x >= 25"),
    ("largest", {"max": ["x", "p"]}, "greatest(x, p)", 6),
    ("smallest", {"min": ["x", "p"]}, "least(x, p)", 6),
    ("both", {"&&": [{">": ["x", 10]}, {"<": ["n", 3]}]}, "x > 10 AND n < 3"),
    ("either", {"||": [{">": ["x", 10]}, {"<": ["n", 3]}]}, "x > 10 OR n < 3"),
    ("one", {"^^": [{">": ["x", 10]}, {"<": ["n", 3]}]}, "(x > 10) <> (n < 3)"),
    ("no", {"!": [{">": ["x", 10]}]}, "NOT x > 10"),
    ("kleene_and", {"&&&": [{">": ["x", 10]}, {"<": ["n", 3]}]}, "x > 10 AND n < 3"),
    ("kleene_or", {"|||": [{">": ["x", 10]}, {"<": ["n", 3]}]}, "x > 10 OR n < 3"),
    ("kleene_not", {"!!!": [{">": ["x", 10]}]}, "NOT x > 10"),
    ("bit_and", {"&": ["n", 5]}, "n & 5"),
    ("bit_or", {"|": ["n", 8]}, "n | 8"),
    ("bit_xor", {"^": ["n", 3]}, "xor(n, 3)"),
    ("bit_not", {"~": ["n"]}, "-n - 1"),
])
family("fn_math", "lineitem", LINE, X, [
    ("pi", {"m.pi": []}, "pi()", 9),
    ("e", {"m.e": []}, "exp(1.0)", 9),
    ("abs", {"m.abs": [{"-": ["x", 25]}]}, "abs(x - 25)", 6),
    ("acos", {"m.acos": ["y"]}, "acos(y)", 6),
    ("asin", {"m.asin": ["y"]}, "asin(y)", 6),
    ("atan", {"m.atan": ["x"]}, "atan(x)", 6),
    ("atan2", {"m.atan2": ["x", "p"]}, "atan2(x, p)", 6),
    ("ceil", {"m.ceil": [{"/": ["p", 7]}]}, "ceil(p / 7)", 6),
    ("floor", {"m.floor": [{"/": ["p", 7]}]}, "floor(p / 7)", 6),
    ("copysign", {"m.copysign": ["x", {"-": ["y", 0.05]}]}, "CASE WHEN y - 0.05::DOUBLE < 0 THEN -x ELSE x END", 6),
    ("cos", {"m.cos": ["x"]}, "cos(x)", 6),
    ("cosh", {"m.cosh": ["y"]}, "cosh(y)", 6),
    ("exp", {"m.exp": ["y"]}, "exp(y)", 6),
    ("expm1", {"m.expm1": ["y"]}, "exp(y) - 1", 6),
    ("hypot", {"m.hypot": ["x", "p"]}, "sqrt(x * x + p * p)", 5),
    ("ln", {"m.ln": ["x"]}, "ln(x)", 6),
    ("log10", {"m.log10": ["x"]}, "log10(x)", 6),
    ("log", {"m.log": ["x", 3]}, "ln(x) / ln(3)", 6),
    ("ln1p", {"m.ln1p": ["y"]}, "ln(1 + y)", 6),
    ("round", {"m.round": [{"/": ["p", 7]}]}, "CAST(floor(p / 7 + 0.5) AS BIGINT)"),
    ("rint", {"m.rint": [{"/": ["p", 7]}]}, "round_even(p / 7, 0)", 6),
    ("signum", {"m.signum": [{"-": ["x", 25]}]}, "sign(x - 25)", 6),
    ("sin", {"m.sin": ["x"]}, "sin(x)", 6),
    ("sinh", {"m.sinh": ["y"]}, "sinh(y)", 6),
    ("sqrt", {"m.sqrt": ["x"]}, "sqrt(x)", 6),
    ("tan", {"m.tan": ["y"]}, "tan(y)", 6),
    ("tanh", {"m.tanh": ["y"]}, "tanh(y)", 6),
    ("choose", {"m.special.nChooseK": [10, "n"]}, "factorial(10) / (factorial(n) * factorial(10 - n))", 3),
    ("lngamma", {"m.special.lnGamma": ["x"]}, "lgamma(x)", 6),
    ("lnbeta", {"m.special.lnBeta": ["x", "n"]}, "lgamma(x) + lgamma(n) - lgamma(x + n)", 6),
    ("sigmoid", {"m.link.logit": ["y"]}, "1 / (1 + exp(-y))", 6),
    ("cloglog", {"m.link.cloglog": ["y"]}, "1 - exp(-exp(y))", 6),
    ("loglog", {"m.link.loglog": ["y"]}, "exp(-exp(-y))", 6),
    ("cauchit", {"m.link.cauchit": ["y"]}, "0.5 + atan(y) / pi()", 6),
    ("softplus", {"m.link.softplus": ["y"]}, "ln(1 + exp(y))", 6),
    ("relu", {"m.link.relu": [{"-": ["y", 0.05]}]}, "greatest(y - 0.05::DOUBLE, 0)", 6),
    ("linktanh", {"m.link.tanh": ["y"]}, "tanh(y)", 6),
    ("absdiff", {"metric.absDiff": ["x", "p"]}, "abs(x - p)", 5),
    ("similar", {"metric.gaussianSimilarity": ["x", 25.0, 10.0]}, "exp(-ln(2) * pow((x - 25) / 10, 2))", 6),
    ("bin", {"interp.bin": ["x", 10, 0.0, 51.0]}, "CAST(floor(x / 51 * 10) AS INTEGER)"),
    ("cusum", {"stat.change.updateCUSUM": ["x", {"u-": ["y"]}, 0.0]}, "greatest(0, x - y)", 6),
    ("pull", {"stat.test.pull": ["x", 25.0, 2.0]}, "(x - 25) / 2", 6),
    ("residual", {"stat.test.residual": ["x", 25.0]}, "x - 25", 6),
])
PART = {"s": ("p_name", "p_name"), "t": ("p_type", "p_type"), "b": ("p_brand", "p_brand"), "k": ("p_partkey", "p_partkey"), "n": ("p_size", "p_size")}
LIT = lambda s: {"string": s}
family("fn_string", "part", ["p_partkey"], PART, [
    ("len", {"s.len": ["s"]}, "CAST(length(s) AS INTEGER)"),
    ("substr", {"s.substr": ["s", 1, -2]}, "substr(s, 2, greatest(length(s) - 3, 0))"),
    ("substrto", {"s.substrto": ["s", 1, 3, LIT("_")]}, "substr(s, 1, 1) || '_' || substr(s, 4)"),
    ("contains", {"s.contains": ["t", LIT("E")]}, "contains(t, 'E')"),
    ("count", {"s.count": ["t", LIT("E")]}, "CAST(length(t) - length(replace(t, 'E', '')) AS INTEGER)"),
    ("position", {"s.index": ["t", LIT("E")]}, "CAST(strpos(t, 'E') - 1 AS INTEGER)"),
    ("rposition", {"s.rindex": ["t", LIT("E")]}, "CAST(CASE WHEN contains(t, 'E') THEN length(t) - strpos(reverse(t), 'E') ELSE -1 END AS INTEGER)"),
    ("starts", {"s.startswith": ["t", LIT("S")]}, "starts_with(t, 'S')"),
    ("ends", {"s.endswith": ["t", LIT("L")]}, "ends_with(t, 'L')"),
    ("joined", {"s.join": [{"new": ["s", "b"], "type": {"type": "array", "items": "string"}}, LIT("-")]}, "s || '-' || b"),
    ("parts", {"a.len": [{"s.split": ["s", LIT(" ")]}]}, "CAST(len(string_split(s, ' ')) AS INTEGER)"),
    ("hex", {"s.hex": ["k"]}, "lower(to_hex(k))"),
    ("number", {"s.int": ["k", 8, True]}, "lpad(CAST(k AS VARCHAR), 8, '0')"),
    ("digits", {"s.number": ["k"]}, "CAST(k AS VARCHAR)"),
    ("concat", {"s.concat": ["s", "b"]}, "s || b"),
    ("twice", {"s.repeat": ["b", 2]}, "repeat(b, 2)"),
    ("low", {"s.lower": ["t"]}, "lower(t)"),
    ("up", {"s.upper": ["s"]}, "upper(s)"),
    ("lstrip", {"s.lstrip": ["b", LIT("Brand#")]}, "ltrim(b, 'Brand#')"),
    ("rstrip", {"s.rstrip": ["b", LIT("12345")]}, "rtrim(b, '12345')"),
    ("strip", {"s.strip": ["t", LIT("SLE")]}, "trim(t, 'SLE')"),
    ("all", {"s.replaceall": ["t", LIT("E"), LIT("3")]}, "replace(t, 'E', '3')"),
    ("first", {"s.replacefirst": ["t", LIT("E"), LIT("3")]}, "regexp_replace(t, 'E', '3')"),
    ("last", {"s.replacelast": ["t", LIT("E"), LIT("3")]}, "regexp_replace(t, '^(.*)E', '\\13')"),
    ("translated", {"s.translate": ["t", LIT("AE"), LIT("ae")]}, "translate(t, 'AE', 'ae')"),
    ("matches", {"re.contains": ["t", LIT("[AE]L")]}, "regexp_matches(t, '[AE]L')"),
    ("found", {"a.len": [{"re.findall": ["t", LIT("[AEIOU]")]}]}, "CAST(len(regexp_extract_all(t, '[AEIOU]')) AS INTEGER)"),
    ("counted", {"re.count": ["t", LIT("[AEIOU]+")]}, "CAST(len(regexp_extract_all(t, '[AEIOU]+')) AS INTEGER)"),
    ("replaced", {"re.replaceall": ["t", LIT("[AEIOU]+"), LIT("-")]}, "regexp_replace(t, '[AEIOU]+', '-', 'g')"),
    ("replaced1", {"re.replacefirst": ["t", LIT("[AEIOU]+"), LIT("-")]}, "regexp_replace(t, '[AEIOU]+', '-')"),
    ("splits", {"a.len": [{"re.split": ["t", LIT("[AEIOU]+")]}]}, "CAST(len(string_split_regex(t, '[AEIOU]+')) AS INTEGER)"),
    ("parsed", {"parse.int": [{"s.number": ["n"]}, 10]}, "n"),
    ("parsed_double", {"parse.double": [{"s.number": ["n"]}]}, "n", 6),
    ("as_int", {"cast.int": [{"/": ["n", 2]}]}, "CAST(round_even(n / 2, 0) AS INTEGER)"),
    ("as_long", {"cast.long": ["n"]}, "CAST(n AS BIGINT)"),
    ("signed", {"cast.signed": [{"*": ["k", 100]}, 8]}, "((k * 100 + 128) % 256) - 128"),
    ("unsigned", {"cast.unsigned": [{"*": ["k", 100]}, 8]}, "(k * 100) % 256"),
    ("coded", {"bytes.len": [{"bytes.encodeUtf8": ["s"]}]}, "CAST(strlen(s) AS INTEGER)"),
    ("round_trip", {"bytes.decodeUtf8": [{"bytes.encodeUtf8": ["s"]}]}, "s"),
    ("base64", {"bytes.toBase64": [{"bytes.encodeUtf8": ["b"]}]}, "base64(encode(b))"),
])
EVENT = {"t": ("unix_micros(cast(ts as timestamp)) / 1e6D", "epoch(ts)")}
Z = LIT("UTC")
family("fn_time", "events", ["event_id"], EVENT, [
    ("year", {"time.year": ["t", Z]}, "CAST(year(to_timestamp(t) AT TIME ZONE 'UTC') AS INTEGER)"),
    ("month", {"time.monthOfYear": ["t", Z]}, "CAST(month(to_timestamp(t) AT TIME ZONE 'UTC') AS INTEGER)"),
    ("yearday", {"time.dayOfYear": ["t", Z]}, "CAST(dayofyear(to_timestamp(t) AT TIME ZONE 'UTC') AS INTEGER)"),
    ("monthday", {"time.dayOfMonth": ["t", Z]}, "CAST(day(to_timestamp(t) AT TIME ZONE 'UTC') AS INTEGER)"),
    ("weekday", {"time.dayOfWeek": ["t", Z]}, "CAST(isodow(to_timestamp(t) AT TIME ZONE 'UTC') - 1 AS INTEGER)"),
    ("hour", {"time.hourOfDay": ["t", Z]}, "CAST(hour(to_timestamp(t) AT TIME ZONE 'UTC') AS INTEGER)"),
    ("minute", {"time.minuteOfHour": ["t", Z]}, "CAST(minute(to_timestamp(t) AT TIME ZONE 'UTC') AS INTEGER)"),
    ("second", {"time.secondOfMinute": ["t", Z]}, "CAST(second(to_timestamp(t) AT TIME ZONE 'UTC') AS INTEGER)"),
    ("weekend", {"time.isWeekend": ["t", Z]}, "isodow(to_timestamp(t) AT TIME ZONE 'UTC') >= 6"),
    ("work", {"time.isWorkHours": ["t", Z]}, "isodow(to_timestamp(t) AT TIME ZONE 'UTC') < 6 AND hour(to_timestamp(t) AT TIME ZONE 'UTC') BETWEEN 9 AND 16"),
    ("morning", {"time.isHourOfDay": ["t", Z, 6.0, 12.0]}, "hour(to_timestamp(t) AT TIME ZONE 'UTC') BETWEEN 6 AND 11"),
])
VEC = {"a": ("transform(embedding, v -> cast(round(v * 4) as int))", "list_transform(embedding, lambda v: CAST(round(CAST(v AS DOUBLE) * 4) AS INTEGER))"), "d": ("transform(embedding, v -> cast(v as double))", "list_transform(embedding, lambda v: CAST(v AS DOUBLE))")}
IDENT = {"params": [{"v": "int"}], "ret": "int", "do": [{"*": ["v", 2]}]}
POSITIVE = {"params": [{"v": "int"}], "ret": "boolean", "do": [{">": ["v", 0]}]}
PLUS = {"params": [{"v": "int"}, {"w": "int"}], "ret": "int", "do": [{"+": ["v", "w"]}]}
MORE = {"params": [{"v": "int"}, {"w": "int"}], "ret": "boolean", "do": [{">": ["v", "w"]}]}
family("fn_array", "embeddings", ["vec_id"], VEC, [
    ("len", {"a.len": ["a"]}, "CAST(len(a) AS INTEGER)"),
    ("head", {"a.head": ["a"]}, "a[1]"),
    ("last", {"a.last": ["a"]}, "a[-1]"),
    ("tail_sum", {"a.sum": [{"a.tail": ["a"]}]}, "list_sum(a[2:])", 6),
    ("init_sum", {"a.sum": [{"a.init": ["a"]}]}, "list_sum(a[:-2])", 6),
    ("part_sum", {"a.sum": [{"a.subseq": ["a", 1, 4]}]}, "list_sum(a[2:4])", 6),
    ("has", {"a.contains": ["a", 0]}, "list_contains(a, 0)"),
    ("zeros", {"a.count": ["a", 0]}, "CAST(len(list_filter(a, lambda v: v = 0)) AS INTEGER)"),
    ("place", {"a.index": ["a", 0]}, "CAST(coalesce(list_position(a, 0), 0) - 1 AS INTEGER)"),
    ("appended", {"a.len": [{"a.append": ["a", 1]}]}, "CAST(len(a) + 1 AS INTEGER)"),
    ("doubled", {"a.len": [{"a.concat": ["a", "a"]}]}, "CAST(2 * len(a) AS INTEGER)"),
    ("sorted_first", {"a.head": [{"a.sort": ["a"]}]}, "list_min(a)"),
    ("reversed_first", {"a.head": [{"a.reverse": ["a"]}]}, "a[-1]"),
    ("largest", {"a.max": ["a"]}, "list_max(a)"),
    ("smallest", {"a.min": ["a"]}, "list_min(a)"),
    ("largest_by", {"a.minLT": ["a", MORE]}, "list_max(a)"),
    ("top3", {"a.sum": [{"a.maxN": ["a", 3]}]}, "list_sum(list_reverse_sort(a)[:3])", 6),
    ("low3", {"a.sum": [{"a.minN": ["a", 3]}]}, "list_sum(list_sort(a)[:3])", 6),
    ("argmax", {"a.argmax": ["a"]}, "CAST(list_position(a, list_max(a)) - 1 AS INTEGER)"),
    ("argmin", {"a.argmin": ["a"]}, "CAST(list_position(a, list_min(a)) - 1 AS INTEGER)"),
    ("total", {"a.sum": ["d"]}, "list_sum(d)", 6),
    ("mean", {"a.mean": ["d"]}, "list_avg(d)", 6),
    ("median", {"a.median": ["d"]}, "list_median(d)", 6),
    ("quartile", {"a.ntile": ["d", 0.25]}, "list_aggregate(d, 'quantile_cont', 0.25)", 6),
    ("lse", {"a.logsumexp": ["d"]}, "ln(list_sum(list_transform(d, lambda v: exp(v))))", 6),
    ("distinct", {"a.len": [{"a.distinct": ["a"]}]}, "CAST(len(list_distinct(a)) AS INTEGER)"),
    ("mapped", {"a.sum": [{"a.map": ["a", IDENT]}]}, "2 * list_sum(a)", 6),
    ("filtered", {"a.len": [{"a.filter": ["a", POSITIVE]}]}, "CAST(len(list_filter(a, lambda v: v > 0)) AS INTEGER)"),
    ("reduced", {"a.reduce": ["a", PLUS]}, "list_sum(a)", 6),
    ("folded", {"a.fold": ["a", 0, PLUS]}, "list_sum(a)", 6),
    ("some", {"a.any": ["a", POSITIVE]}, "len(list_filter(a, lambda v: v > 0)) > 0"),
    ("each", {"a.all": ["a", POSITIVE]}, "len(list_filter(a, lambda v: v > 0)) = len(a)"),
    ("common", {"a.len": [{"a.intersection": ["a", {"a.map": ["a", IDENT]}]}]}, "CAST(len(list_intersect(list_distinct(a), list_transform(a, lambda v: v * 2))) AS INTEGER)"),
    ("windows", {"a.len": [{"a.slidingWindow": ["a", 3, 1]}]}, "CAST(len(a) - 2 AS INTEGER)"),
    ("norm", {"metric.simpleEuclidean": ["d", {"a.map": ["d", {"params": [{"v": "double"}], "ret": "double", "do": [0.0]}]}]}, "sqrt(list_sum(list_transform(d, lambda v: v * v)))", 6),
    ("linear", {"m.kernel.linear": ["d", "d"]}, "list_sum(list_transform(d, lambda v: v * v))", 6),
    ("rbf", {"m.kernel.rbf": ["d", {"a.reverse": ["d"]}, 0.1]}, "exp(-0.1::DOUBLE * list_sum(list_transform(list_zip(d, list_reverse(d)), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))", 6),
    ("poly", {"m.kernel.poly": ["d", "d", 0.5, 1.0, 2.0]}, "pow(0.5::DOUBLE * list_sum(list_transform(d, lambda v: v * v)) + 1, 2)", 5),
    ("scaled", {"a.sum": [{"la.scale": ["d", 3.0]}]}, "3 * list_sum(d)", 5),
    ("softmax", {"a.max": [{"m.link.softmax": ["d"]}]}, "exp(list_max(d)) / list_sum(list_transform(d, lambda v: exp(v)))", 6),
])


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def record(name: str, **fields: str) -> dict:
    return {"type": "record", "name": name, "fields": [{"name": k, "type": t} for k, t in fields.items()]}


LINEITEM = record("Line", l_quantity="double", l_extendedprice="double", l_discount="double", l_returnflag="string")


@register("score_map", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 25 THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice END, 4) AS output FROM lineitem")
def score_map(spark, sf_dir):
    net = {"*": ["input.l_extendedprice", {"-": [1.0, "input.l_discount"]}]}
    doc = {"input": LINEITEM, "output": "double", "action": {"if": {">": ["input.l_quantity", 25]}, "then": net, "else": "input.l_extendedprice"}}
    return Engine(doc).score(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumn("output", ops.rounded("output", 4))


@register("score_emit", "SELECT l_orderkey, l_linenumber, l_quantity AS output FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT l_orderkey, l_linenumber, -l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def score_emit(spark, sf_dir):
    doc = {"method": "emit", "input": LINEITEM, "output": "double", "action": [
        {"if": {">": ["input.l_quantity", 40]}, "then": {"emit": "input.l_quantity"}},
        {"if": {"==": ["input.l_returnflag", {"string": "R"}]}, "then": {"emit": {"u-": "input.l_quantity"}}},
    ]}
    return Engine(doc).score(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("score_fold", "SELECT sum(l_quantity) AS output FROM lineitem")
def score_fold(spark, sf_dir):
    doc = {"method": "fold", "zero": 0.0, "input": LINEITEM, "output": "double", "action": {"+": ["tally", "input.l_quantity"]}, "merge": {"+": ["tallyOne", "tallyTwo"]}}
    return Engine(doc).score(table(spark, sf_dir, "lineitem"))


@register("score_loops", "SELECT l_orderkey, l_linenumber, CAST(floor(log2(greatest(CAST(l_partkey AS DOUBLE), 1))) AS INTEGER) AS output FROM lineitem")
def score_loops(spark, sf_dir):
    doc = {"input": record("In", l_partkey="long"), "output": "int", "action": [
        {"let": {"n": "input.l_partkey", "k": 0}},
        {"while": {">": ["n", 1]}, "do": [{"set": {"n": {"//": ["n", {"long": 2}]}, "k": {"+": ["k", 1]}}}]},
        "k",
    ]}
    return Engine(doc, max_iterations=40).score(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


NODE = {"type": "record", "name": "Node", "fields": [{"name": "field", "type": "string"}, {"name": "operator", "type": "string"}, {"name": "value", "type": "double"}, {"name": "pass", "type": ["Node", "double"]}, {"name": "fail", "type": ["Node", "double"]}]}


@register("model_tree", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity < 20 THEN CASE WHEN l_discount <= 0.05 THEN 1.0 ELSE 2.0 END ELSE 3.0 END AS DOUBLE) AS output FROM lineitem")
def model_tree(spark, sf_dir):
    leaf = lambda v: {"double": v}
    tree = {"field": "l_quantity", "operator": "<", "value": 20.0, "pass": {"Node": {"field": "l_discount", "operator": "<=", "value": 0.05, "pass": leaf(1.0), "fail": leaf(2.0)}}, "fail": leaf(3.0)}
    doc = {"input": LINEITEM, "output": "double", "cells": {"tree": {"type": NODE, "init": tree}}, "action": {"model.tree.simpleTree": ["input", {"cell": "tree"}]}}
    return Engine(doc).score(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("model_linear", "SELECT l_orderkey, l_linenumber, round(1.5 + 2.0 * l_quantity - 3.0 * l_discount, 6) AS output FROM lineitem")
def model_linear(spark, sf_dir):
    model = {"type": record("Reg", const="double") | {"fields": [{"name": "coeff", "type": {"type": "array", "items": "double"}}, {"name": "const", "type": "double"}]}, "init": {"coeff": [2.0, -3.0], "const": 1.5}}
    x = {"new": ["input.l_quantity", "input.l_discount"], "type": {"type": "array", "items": "double"}}
    doc = {"input": LINEITEM, "output": "double", "cells": {"model": model}, "action": {"model.reg.linear": [x, {"cell": "model"}]}}
    return Engine(doc).score(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumn("output", ops.rounded("output", 6))


CLUSTERS = [{"center": [10.0, 0.02], "id": "a"}, {"center": [30.0, 0.05], "id": "b"}, {"center": [45.0, 0.08], "id": "c"}]


@register("model_cluster", "SELECT l_orderkey, l_linenumber, CASE WHEN pow(l_quantity-10,2)+pow(l_discount-0.02,2) <= least(pow(l_quantity-30,2)+pow(l_discount-0.05,2), pow(l_quantity-45,2)+pow(l_discount-0.08,2)) THEN 'a' WHEN pow(l_quantity-30,2)+pow(l_discount-0.05,2) <= pow(l_quantity-45,2)+pow(l_discount-0.08,2) THEN 'b' ELSE 'c' END AS output FROM lineitem")
def model_cluster(spark, sf_dir):
    kind = {"type": "array", "items": {"type": "record", "name": "Cluster", "fields": [{"name": "center", "type": {"type": "array", "items": "double"}}, {"name": "id", "type": "string"}]}}
    x = {"new": ["input.l_quantity", "input.l_discount"], "type": {"type": "array", "items": "double"}}
    doc = {"input": LINEITEM, "output": "string", "cells": {"clusters": {"type": kind, "init": CLUSTERS}}, "action": {"attr": {"model.cluster.closest": [x, {"cell": "clusters"}]}, "path": [["id"]]}}
    return Engine(doc).score(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("row_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def row_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@register("pool_lookup", "SELECT c_custkey, n_name, coalesce(r_name, 'none') AS r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def pool_lookup(spark, sf_dir):
    joined = ops.lookup(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", ["n_name", "n_regionkey"])
    joined = ops.lookup(joined, table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey", ["r_name"])
    return joined.select("c_custkey", "n_name", F.coalesce("r_name", F.lit("none")).alias("r_name"))


@register("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@register("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("group_by", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem GROUP BY ALL")
def group_by(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(ops.rounded(F.sum("l_quantity"), 2).alias("sum_qty"), ops.rounded(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count("*").alias("n"))


@register("distinct_rows", "SELECT DISTINCT p_brand, p_size FROM part")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", "p_size").distinct()


@register("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@register("set_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
def set_intersect(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return a.intersect(table(spark, sf_dir, "part").filter("p_size < 10").select("p_partkey"))


@register("set_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select("l_partkey"))


@register("top_n", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3")
def top_n(spark, sf_dir):
    return ops.top_per_key(table(spark, sf_dir, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@register("moving_window", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5 FROM events")
def moving_window(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, sf_dir, "events").select("event_id", F.avg("value").over(w).alias("mean5")).withColumn("mean5", ops.rounded("mean5", 6))


@register("ranking", "SELECT event_id, rank() OVER w AS r, dense_rank() OVER w AS dr FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)")
def ranking(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("value")
    return table(spark, sf_dir, "events").select("event_id", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"))


@register("histogram2d", "SELECT CAST(floor(l_quantity / 51 * 10) AS INTEGER) AS bx, CAST(floor(l_discount / 0.11 * 10) AS INTEGER) AS by_, count(*) AS n FROM lineitem GROUP BY ALL")
def histogram2d(spark, sf_dir):
    bx, by = F.floor(F.col("l_quantity") / 51 * 10).cast("int"), F.floor(F.col("l_discount") / 0.11 * 10).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(bx.alias("bx"), by.alias("by_")).agg(F.count("*").alias("n"))


@register("pivot_counts", "SELECT event_type, count(*) FILTER (WHERE value >= 50) AS high, count(*) FILTER (WHERE value < 50) AS low FROM events GROUP BY event_type")
def pivot_counts(spark, sf_dir):
    kind = F.when(F.col("value") >= 50, "high").when(F.col("value") < 50, "low")
    return table(spark, sf_dir, "events").withColumn("side", kind).groupBy("event_type").pivot("side", ["high", "low"]).count().na.fill(0)


@register("asof_join", "SELECT e.event_id, (SELECT max(f.ts) FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'purchase' AND f.ts <= e.ts) AS last_ts FROM events e WHERE e.event_type <> 'purchase'")
def asof_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left, right = events.filter("event_type <> 'purchase'"), events.filter("event_type = 'purchase'")
    return ops.as_of(left, right, "user_id", "ts", ["ts"], prefix="last_").select("event_id", "last_ts")


@register("sampling_histogram", "SELECT l_returnflag, true AS near FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1")
def sampling_histogram(spark, sf_dir):
    """A stratified sample: the share of each stratum is within five standard deviations of what was asked for."""
    lines, asked = table(spark, sf_dir, "lineitem"), {"R": 0.5, "A": 0.25}
    kept = lines.sampleBy("l_returnflag", asked, seed=7).groupBy("l_returnflag").agg(F.count("*").alias("k"))
    share = F.when(F.col("l_returnflag") == "R", asked["R"]).otherwise(asked["A"])
    near = F.abs(F.col("k") - share * F.col("n")) <= 5 * F.sqrt(F.col("n") * share * (1 - share))
    return lines.groupBy("l_returnflag").agg(F.count("*").alias("n")).join(kept, "l_returnflag").select("l_returnflag", near.alias("near"))


@register("score_fold_general", "SELECT round(sum(l_extendedprice), 2) AS total, count(*) AS rows FROM lineitem WHERE l_quantity > 10")
def score_fold_general(spark, sf_dir):
    """A tally that isn't a plain sum: a record, changed in a branch."""
    tally = record("Tally", total="double", rows="long")
    more = {"new": {"total": {"+": ["tally.total", "input.l_extendedprice"]}, "rows": {"+": ["tally.rows", {"long": 1}]}}, "type": "Tally"}
    both = {"new": {"total": {"+": ["tallyOne.total", "tallyTwo.total"]}, "rows": {"+": ["tallyOne.rows", "tallyTwo.rows"]}}, "type": "Tally"}
    doc = {"method": "fold", "zero": {"total": 0.0, "rows": 0}, "input": LINEITEM, "output": tally, "action": {"if": {">": ["input.l_quantity", 10]}, "then": more, "else": "tally"}, "merge": both}
    return Engine(doc).score(table(spark, sf_dir, "lineitem")).select(ops.rounded("output.total", 2).alias("total"), F.col("output.rows").alias("rows"))


@register("score_fold_max", "SELECT max(l_extendedprice * (1 - l_discount)) AS output FROM lineitem")
def score_fold_max(spark, sf_dir):
    net = {"*": ["input.l_extendedprice", {"-": [1, "input.l_discount"]}]}
    doc = {"method": "fold", "zero": 0.0, "input": LINEITEM, "output": "double", "action": {"max": ["tally", net]}, "merge": {"max": ["tallyOne", "tallyTwo"]}}
    return Engine(doc).score(table(spark, sf_dir, "lineitem"))


@register("online_moments", "SELECT l_returnflag, l_orderkey, l_linenumber, round(avg(l_quantity) OVER w, 6) AS mean, count(*) OVER w AS seen FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity ROWS UNBOUNDED PRECEDING)")
def online_moments(spark, sf_dir):
    """Running moments of each key's rows in order."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    out = ops.running_mean(lines, "l_returnflag", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"], "l_quantity")
    return out.select("l_returnflag", "l_orderkey", "l_linenumber", ops.rounded("mean", 6).alias("mean"), "seen")


@register("running_stats", "SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS count, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 4) AS variance FROM lineitem GROUP BY 1")
def running_stats(spark, sf_dir):
    return ops.moments(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity").select("l_returnflag", "count", ops.rounded("mean", 6).alias("mean"), ops.rounded("variance", 4).alias("variance"))


@register("cube_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


_ = T
from . import function_queries  # noqa: E402, F401  registers its queries
