"""Linear algebra, metrics, kernels, links, interpolation and random values as Column expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .collections import at, best_place, first_n, order, picks, size, some, total, upto
from .registry import Const, d, define_all, fail, guard, i, lam, let, trait
from .scalar import ln_gamma


def dot(x, y) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def rows_of(x, f) -> Column:
    return F.transform(x, lambda r: F.transform(r, lam(f, 1)))


def transpose(x) -> Column:
    return F.transform(upto(size(at(x, F.lit(0)))), lambda k: F.transform(x, lambda r: at(r, k)))


def numpy_udf(f, kind):
    """A vectorised function over matrices: f gets those of one shape in a batch as one array, and gives such an array."""

    @F.arrow_udf(kind)
    def run(x: pa.Array) -> pa.Array:
        high, wide = pc.list_value_length(x), pc.list_value_length(x.flatten())
        same = lambda n: len(n) > 0 and n.null_count == 0 and pc.min(n).as_py() == pc.max(n).as_py() > 0
        if same(high) and same(wide):
            out = f(x.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), high[0].as_py(), wide[0].as_py()))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[2], dtype=np.int32)), pa.array(out.reshape(-1)))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) + 1, out.shape[1], dtype=np.int32)), rows)
        return pa.array([None if v is None else f(np.array([v], float))[0].tolist() for v in x.to_pylist()], pa.list_(pa.list_(pa.float64())))

    return run


MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))


def _eigen_basis(m: np.ndarray):
    values, vectors = np.linalg.eigh((m + np.swapaxes(m, 1, 2)) / 2)
    down = np.argsort(-values, axis=1)
    values, vectors = np.take_along_axis(values, down, 1)[:, None, :], np.take_along_axis(vectors, down[:, None, :], 2)
    signs = np.where(vectors[:, :1, :] < 0, -1.0, 1.0)
    return np.swapaxes(vectors * signs / np.sqrt(np.where(values > 0, values, np.nan)), 1, 2)


def _eliminated(m, state, k):
    """One column of Gauss-Jordan elimination with row exchange: the new rows and the determinant so far."""
    worst = F.aggregate(upto(size(m)), k, lambda best, j: F.when((j > k) & (F.abs(at(at(m, j), k)) > F.abs(at(at(m, best), k))), j).otherwise(best))

    def exchanged(p):
        def reduced(head):
            lead = at(head, k)
            row = F.transform(head, lambda v: F.when(lead == 0, v).otherwise(v / lead))
            others = lambda row: F.transform(m, lambda r, j: F.when(j == k, row).otherwise(let(F.when(j == p, at(m, k)).otherwise(r), lambda own: F.zip_with(own, row, lambda v, w: v - at(own, k) * w))))
            return let(row, lambda row: F.struct(others(row).alias("rows"), (state["det"] * lead * F.when(p == k, 1.0).otherwise(-1.0)).alias("det")))

        return let(at(m, p), reduced)

    return let(worst, exchanged)


def solved(m, beside=True) -> Column:
    """The inverse beside the unit matrix, if wanted, and the determinant; a singular matrix has determinant 0."""
    unit = lambda r, j: F.concat(F.transform(r, lambda v: v.cast("double")), F.transform(r, lambda _, c: F.when(c == j, 1.0).otherwise(0.0)))
    start = F.struct(F.transform(m, unit if beside else lambda r: F.transform(r, lambda v: v.cast("double"))).alias("rows"), F.lit(1.0).alias("det"))
    return F.aggregate(upto(size(m)), start, lambda state, k: _eliminated(state["rows"], state, k))


def inverse(m) -> Column:
    return let(solved(m), lambda s: F.when(s["det"] == 0, fail(24050, "singular matrix")).otherwise(F.transform(s["rows"], lambda r: F.slice(r, size(s["rows"]) + 1, size(s["rows"])))))


def determinant(m) -> Column:
    return solved(m, beside=False)["det"]


eigen_basis = numpy_udf(_eigen_basis, MATRIX)


def is_matrix(x) -> bool:
    return trait(x, "_is_matrix")


def scale(x, k):
    return rows_of(x, lambda v: v * k) if is_matrix(x) else F.transform(x, lambda v: v * k)


def pairwise(f):
    def run(x, y):
        one = lambda a, b: F.zip_with(a, b, lam(f, 2))
        return F.zip_with(x, y, one) if is_matrix(x) else one(x, y)

    return run


def la_dot(x, y):
    if is_matrix(y):
        return let(transpose(y), lambda columns: F.transform(x, lambda r: F.transform(columns, lambda c: dot(r, c))))
    return F.transform(x, lambda r: dot(r, y))


define_all("la.", {
    "map": rows_of,
    "scale": scale,
    "zipmap": lambda x, y, f: F.zip_with(x, y, lambda a, b: F.zip_with(a, b, lam(f, 2))),
    "add": pairwise(lambda a, b: a + b),
    "sub": pairwise(lambda a, b: a - b),
    "dot": la_dot,
    "transpose": transpose,
    "inverse": lambda x: inverse(x),
    "trace": lambda x: total(F.transform(x, lambda r, k: at(r, k))),
    "det": lambda x: determinant(x),
    "symmetric": lambda x, tol: F.forall(upto(size(x)), lambda k: F.forall(upto(size(x)), lambda j: F.abs(at(at(x, k), j) - at(at(x, j), k)) < tol)),
    "eigenBasis": lambda x: eigen_basis(x),
    "truncate": lambda x, n: F.slice(x, F.lit(1), F.greatest(n, F.lit(0))),
})


def _metric(similarity, x, y, each, start=0.0, join=None, scaled=False):
    """Sum (or another join) of similarities over pairs without nulls, scaled up for the missing ones."""
    pairs = F.filter(F.zip_with(x, y, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    join = join or (lambda s, v: s + v)
    whole = lambda ps: F.aggregate(ps, F.lit(start), lambda s, p: join(s, each(similarity(p["a"], p["b"])).cast("double")))
    return let(pairs, lambda ps: whole(ps) * (size(x).cast("double") / F.greatest(size(ps), F.lit(1))) if scaled else whole(ps))


def _spread(power=1.0, root=1.0):
    def f(sim, x, y):
        return F.pow(_metric(sim, x, y, scaled=True, each=lambda v: F.pow(F.abs(v), F.lit(power))), F.lit(root))

    return f


def minkowski(sim, x, y, p):
    return F.pow(_metric(sim, x, y, scaled=True, each=lambda v: F.pow(F.abs(v), p)), 1.0 / p)


def counted(x, y, f) -> Column:
    """f of the numbers of pairs of booleans by kind: both false, only y, only x, both."""
    kinds = F.zip_with(x, y, lambda p, q: 2 * p.cast("int") + q.cast("int"))
    return let(kinds, lambda ks: f([size(F.filter(ks, lambda v: v == k)).cast("double") for k in range(4)]))


def ratio(top, bottom):
    return let(bottom, lambda b: F.when(b == 0, F.lit(float("nan"))).otherwise(top / b))


def binary(x, y, c00, c01, c10, c11, b00, b01, b10, b11):
    return counted(x, y, lambda n: ratio(c00 * n[0] + c01 * n[1] + c10 * n[2] + c11 * n[3], b00 * n[0] + b01 * n[1] + b10 * n[2] + b11 * n[3]))


define_all("metric.", {
    "simpleEuclidean": lambda x, y: F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))),
    "absDiff": lambda x, y: F.abs(x - y),
    "gaussianSimilarity": lambda x, y, s: F.exp(-math.log(2) * F.pow((x - y) / s, F.lit(2.0))),
    "euclidean": _spread(2.0, 0.5),
    "squaredEuclidean": _spread(2.0, 1.0),
    "chebyshev": lambda sim, x, y: _metric(sim, x, y, lambda v: v, join=lambda s, v: F.greatest(s, v)),
    "taxicab": _spread(1.0, 1.0),
    "minkowski": minkowski,
    "simpleMatching": lambda x, y: counted(x, y, lambda n: ratio(n[0] + n[3], size(x).cast("double"))),
    "jaccard": lambda x, y: counted(x, y, lambda n: ratio(n[3], n[1] + n[2] + n[3])),
    "tanimoto": lambda x, y: counted(x, y, lambda n: ratio(n[0] + n[3], n[3] + 2 * (n[1] + n[2]) + n[0])),
    "binarySimilarity": binary,
})

define_all("m.kernel.", {
    "linear": dot,
    "rbf": lambda x, y, g: F.exp(-g * total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))),
    "poly": lambda x, y, g, c, p: F.pow(g * dot(x, y) + c, p),
    "sigmoid": lambda x, y, g, c: F.tanh(g * dot(x, y) + c),
})


def link(f):
    """A link over a number, an array or a map; the compiler marks collections."""

    def run(x):
        if trait(x, "_is_map"):
            return F.transform_values(x, lambda _, v: f(v))
        return F.transform(x, lam(f, 1)) if trait(x, "_is_array") else f(x)

    return run


def softmax(x):
    if trait(x, "_is_map"):
        top = F.array_max(F.map_values(x))
        bottom = total(F.transform(F.map_values(x), lambda v: F.exp(v - top)))
        return F.transform_values(x, lambda _, v: F.exp(v - top) / bottom)
    powers = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return let(powers, lambda es: let(total(es), lambda bottom: F.transform(es, lambda e: e / bottom)))


def normal_cdf(z) -> Column:
    from .scalar import erf

    return 0.5 * (1 + erf(z / math.sqrt(2)))


define_all("m.link.", {
    "softmax": softmax,
    "logit": link(lambda v: 1 / (1 + F.exp(-v))),
    "probit": link(normal_cdf),
    "cloglog": link(lambda v: 1 - F.exp(-F.exp(v))),
    "loglog": link(lambda v: F.exp(-F.exp(-v))),
    "cauchit": link(lambda v: 0.5 + F.atan(v) / math.pi),
    "softplus": link(lambda v: F.log1p(F.exp(v))),
    "relu": link(lambda v: F.greatest(v, F.lit(0.0))),
    "tanh": link(lambda v: F.tanh(v)),
})


def interp_bin(x, *args):
    if len(args) == 3:
        n, low, high = args
        k = i(F.floor((x - low) / (high - low) * n))
        return guard((x < low) | (x >= high), 22000, "x out of range", k)
    origin, width = args
    return i(F.floor((x - origin) / width))


def table_order(table, x) -> Column:
    return picks(table, order(F.transform(table, lambda r: F.abs(r["x"] - x))))


def interp_nearest(x, table, metric=None):
    table = table.column if isinstance(table, Const) else table
    near = lambda r: metric(x, r["x"]) if metric else F.sqrt(total(F.zip_with(x, r["x"], lambda a, b: (a - b) * (a - b)))) if trait(x, "_is_array") else F.abs(r["x"] - x)
    return some(table, at(table, best_place(F.transform(table, near), lambda a, b: a < b))["to"], 22010, "table must have at least one entry")


def interp_linear(x, table, outside="extend"):
    table = table.column if isinstance(table, Const) else table
    sorted_rows = F.array_sort(F.transform(table, lambda r: F.struct(r["x"].alias("x"), r["to"].alias("to"))))

    def value_in(rows):
        n = size(rows)
        below = size(F.filter(rows, lambda r: r["x"] <= x))
        k = F.least(F.greatest(below - 1, F.lit(0)), F.greatest(n - 2, F.lit(0)))
        value = let(F.slice(rows, k + 1, F.lit(2)), lambda ab: line(at(ab, F.lit(0)), at(ab, F.lit(1))))
        lo, hi = at(rows, F.lit(0)), at(rows, n - 1)
        if outside == "flat":
            value = F.when(x <= lo["x"], lo["to"]).when(x >= hi["x"], hi["to"]).otherwise(value)
        if outside == "missing":
            value = F.when((x < lo["x"]) | (x > hi["x"]), F.lit(None)).otherwise(value)
        return F.when(n == 1, lo["to"]).otherwise(value)

    line = lambda a, b: a["to"] + (b["to"] - a["to"]) * (x - a["x"]) / (b["x"] - a["x"])
    return some(table, let(sorted_rows, value_in), 22020, "table must have at least one entry")


define_all("interp.", {
    "bin": interp_bin,
    "nearest": interp_nearest,
    "linear": interp_linear,
    "linearFlat": lambda x, t: interp_linear(x, t, "flat"),
    "linearMissing": lambda x, t: interp_linear(x, t, "missing"),
})


def pick_weighted(weights) -> Column:
    """A position with a chance in proportion to its weight."""
    u = F.rand() * total(weights)
    sums = F.transform(weights, lambda _, k: total(F.slice(weights, F.lit(1), k + 1)))
    return F.least(size(F.filter(sums, lambda s: s <= u)), size(weights) - 1)


def rand_string(n, *args):
    alphabet = args[0] if len(args) == 1 else None
    low, high = args if len(args) == 2 else (F.lit(32), F.lit(127))
    one = (lambda: F.substring(alphabet, i(F.rand() * F.length(alphabet)) + 1, F.lit(1))) if alphabet is not None else (lambda: F.call_function("char", low + i(F.rand() * (high - low))))
    return F.array_join(F.transform(upto(n), lambda _: one()), "")


def whole(low, high, kind):
    return F.floor(low.cast("double") + F.rand() * (high.cast("double") - low.cast("double"))).cast(kind)


define_all("rand.", {
    "int": lambda *a: whole(*a, "int") if a else whole(F.lit(-(2.0**31)), F.lit(2.0**31), "int"),
    "long": lambda *a: whole(*a, "long") if a else F.xxhash64(F.rand()),
    "float": lambda lo, hi: (lo + F.rand() * (hi - lo)).cast("float"),
    "double": lambda lo, hi: lo + F.rand() * (hi - lo),
    "choice": lambda a: some(a, at(F.shuffle(a), F.lit(0)), 34000, "empty population"),
    "choices": lambda n, a: F.transform(upto(n), lambda _: at(a, i(F.rand() * size(a)))),
    "sample": lambda n, a: guard(n > size(a), 34010, "population smaller than requested subsample", F.slice(F.shuffle(a), F.lit(1), n)),
    "histogram": lambda w: pick_weighted(w),
    "string": rand_string,
    "bytes": lambda n, *a: F.encode(rand_string(n, *([x if x is not None else x for x in a])), "ISO-8859-1"),
    "uuid": lambda: F.uuid(),
    "uuid4": lambda: F.uuid(),
    "gaussian": lambda mu, sigma: mu + sigma * F.randn(),
})
