"""Online statistics, change detection, tests and models.

State records are structs: an update is an expression from the old struct to the new one, so it runs in a projection,
in an ordered fold over an array, or in a stateful stream. Constant models (trees) are compiled into CASE expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .collections import at, best_place, first_n, order, picks, size, total, upto
from .numeric import dot, is_matrix
from .registry import LIBRARY, Const, d, define_all, fail, guard, i, lam, let, trait


def put(state, **fields) -> Column:
    for name, value in fields.items():
        state = state.withField(name, value)
    return state


def has(state, name) -> bool:
    known = trait(state, "_fields")
    return known is None or name in known


def sample_update(x, w, s):
    count = s["count"] + w
    out = put(s, count=count)
    if has(s, "mean"):
        delta = x - s["mean"]
        shift = delta * w / count
        out = put(out, mean=s["mean"] + shift)
        if has(s, "variance"):
            out = put(out, variance=(s["variance"] * s["count"] + w * delta * (x - s["mean"] - shift)) / count)
    return out


def update_covariance(x, w, s):
    count = s["count"] + w
    delta = F.zip_with(x, s["mean"], lambda a, b: a - b)
    mean = F.zip_with(s["mean"], delta, lambda m, v: m + v * w / count)
    cov = F.transform(s["covariance"], lambda r, k: F.transform(r, lambda c, j: (c * s["count"] + at(delta, k) * at(delta, j) * w * s["count"] / count) / count))
    return put(s, count=count, mean=mean, covariance=cov)


def update_window(x, w, state, n):
    """The last n weighted values with running moments, the newest last."""
    kept = F.slice(state, F.greatest(size(state) + 2 - n, F.lit(1)), F.greatest(n - 1, F.lit(0)))
    weights = total(F.transform(kept, lambda r: r["w"])) + w
    values = total(F.transform(kept, lambda r: r["x"] * r["w"])) + x * w
    mean = values / weights
    spread = (total(F.transform(kept, lambda r: r["w"] * (r["x"] - mean) * (r["x"] - mean))) + w * (x - mean) * (x - mean)) / weights
    new = F.struct(x.alias("x"), w.alias("w"), weights.alias("count"), mean.alias("mean"), spread.alias("variance"))
    full = lambda r: F.struct(r["x"].alias("x"), r["w"].alias("w"), r["count"].alias("count"), r["mean"].alias("mean"), r["variance"].alias("variance"))
    return F.concat(F.transform(kept, full), F.array(new))


def update_ewma(x, alpha, s):
    if has(s, "variance"):
        diff = x - s["mean"]
        step = alpha * diff
        return put(s, mean=s["mean"] + step, variance=(1 - alpha) * (s["variance"] + diff * step))
    return put(s, mean=alpha * x + (1 - alpha) * s["mean"])


def holt_winters(x, alpha, beta, s):
    level = alpha * x + (1 - alpha) * (s["level"] + s["trend"])
    return put(s, level=level, trend=beta * (level - s["level"]) + (1 - beta) * s["trend"])


def holt_winters_periodic(x, alpha, beta, gamma, s):
    """The cycle turns left by one; its new head is used and replaced."""
    turned = F.concat(F.slice(s["cycle"], F.lit(2), size(s["cycle"])), F.slice(s["cycle"], F.lit(1), F.lit(1)))
    head, many = at(turned, F.lit(0)), s["multiplicative"]
    level = alpha * F.when(many, x / head).otherwise(x - head) + (1 - alpha) * (s["level"] + s["trend"])
    trend = beta * (level - s["level"]) + (1 - beta) * s["trend"]
    new = gamma * F.when(many, x / level).otherwise(x - level) + (1 - gamma) * head
    return put(s, level=level, trend=trend, cycle=F.concat(F.array(new), F.slice(turned, F.lit(2), size(turned))))


def forecast(n, s):
    base = lambda k: s["level"] + (k + 1) * s["trend"]
    if has(s, "cycle") and trait(s, "_fields"):
        cycle = lambda k: at(s["cycle"], (k + 1) % size(s["cycle"]))
        return F.transform(upto(n), lambda k: F.when(s["multiplicative"], base(k) * cycle(k)).otherwise(base(k) + cycle(k)))
    return F.transform(upto(n), base)


def add_at(values, k, w) -> Column:
    return F.transform(values, lambda v, j: F.when(j == k, v + w).otherwise(v))


def fill_histogram(x, w, h):
    if has(h, "numbins") and trait(h, "_fields") is None or "numbins" in (trait(h, "_fields") or ()):
        k = i(F.floor((x - h["low"]) / (h["high"] - h["low"]) * h["numbins"]))
        return put(h, values=add_at(h["values"], F.when((x >= h["low"]) & (x < h["high"]), k).otherwise(-1), w))
    if "binsize" in h._fields:
        k = i(F.floor((x - h["low"]) / h["binsize"]))
        longer = F.concat(h["values"], F.transform(upto(F.greatest(k + 1 - size(h["values"]), F.lit(0))), lambda _: F.lit(0.0)))
        return put(h, values=F.when(k >= 0, add_at(longer, k, w)).otherwise(h["values"]))
    inside = lambda r: F.when(at(r, F.lit(0)) == at(r, F.lit(1)), x == at(r, F.lit(0))).otherwise((x >= at(r, F.lit(0))) & (x < at(r, F.lit(1))))
    return put(h, values=F.zip_with(h["values"], h["ranges"], lambda v, r: F.when(inside(r), v + w).otherwise(v)))


def fill_histogram2d(x, y, w, h):
    kx = F.floor((x - h["xlow"]) / (h["xhigh"] - h["xlow"]) * h["xnumbins"])
    ky = F.floor((y - h["ylow"]) / (h["yhigh"] - h["ylow"]) * h["ynumbins"])
    return put(h, values=F.transform(h["values"], lambda r, a: F.transform(r, lambda v, b: F.when((a == kx) & (b == ky), v + w).otherwise(v))))


def fill_counter(x, w, c):
    kept = F.map_filter(c["values"], lambda k, _: k != x)
    return put(c, values=F.map_concat(kept, F.create_map(x, F.coalesce(F.try_element_at(c["values"], x), F.lit(0.0)) + w)))


def top_n(x, top, n, less):
    return F.slice(picks(F.concat(top, F.array(x)), order(F.concat(top, F.array(x)), True, less)), F.lit(1), n)


define_all("stat.sample.", {
    "update": sample_update,
    "updateCovariance": update_covariance,
    "updateWindow": update_window,
    "updateEWMA": update_ewma,
    "updateHoltWinters": holt_winters,
    "updateHoltWintersPeriodic": holt_winters_periodic,
    "forecast1HoltWinters": lambda s: at(forecast(F.lit(1), s), F.lit(0)),
    "forecastHoltWinters": forecast,
    "fillHistogram": fill_histogram,
    "fillHistogram2d": fill_histogram2d,
    "fillCounter": fill_counter,
    "topN": top_n,
})


def update_trigger(hit, h):
    fresh = hit & (h["currentRun"] == 0)
    run = F.when(hit, h["currentRun"] + 1).otherwise(0)
    return put(h, numEvents=h["numEvents"] + hit.cast("int"), numRuns=h["numRuns"] + fresh.cast("int"), currentRun=run, longestRun=F.greatest(h["longestRun"], run))


def z_value(x, s, unbiased=None):
    z = (x - s["mean"]) / F.sqrt(s["variance"])
    return z if unbiased is None else F.when(unbiased, z * F.sqrt(s["count"] / (s["count"] - 1))).otherwise(z)


define_all("stat.change.", {
    "updateTrigger": update_trigger,
    "zValue": z_value,
    "updateCUSUM": lambda llr, last, reset: F.greatest(reset, last + llr),
})


def over(f):
    """A function of numbers, applied over arrays or maps of one shape too."""

    def run(*xs):
        if trait(xs[0], "_is_array"):
            return F.transform(upto(size(xs[0])), lambda k: f(*(at(x, k) for x in xs)))
        if trait(xs[0], "_is_map"):
            return F.transform_values(xs[0], lambda k, v: f(v, *(F.element_at(x, k) for x in xs[1:])))
        return f(*xs)

    return run


def kolmogorov(x, y):
    """Asymptotic probability that both samples come from one distribution."""
    x, y = (F.filter(v, lambda t: ~F.isnan(t)) for v in (x, y))
    share = lambda v, t: size(F.filter(v, lambda s: s <= t)) / F.greatest(size(v), F.lit(1))
    gap = F.array_max(F.transform(F.concat(x, y), lambda t: F.abs(share(x, t) - share(y, t))))
    n = size(x) * size(y) / F.greatest(size(x) + size(y), F.lit(1)).cast("double")
    z = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * gap
    decay = math.pi**2 / (8 * z * z)  # terms beyond exp(-745) are zero
    many = F.least(F.greatest(i(F.ceil(F.sqrt(745 / decay) / 2)) + 1, F.lit(1)), F.lit(100_000))
    terms = F.aggregate(F.sequence(F.lit(1), many), F.lit(0.0), lambda t, v: t + F.exp(-F.pow(2.0 * v - 1, F.lit(2)) * decay))
    chance = 1 - math.sqrt(2 * math.pi) / z * terms
    same = F.array_sort(x) == F.array_sort(y)
    return F.when(same | (z == 0), F.lit(1.0)).when((size(x) == 0) | (size(y) == 0), F.lit(0.0)).otherwise(chance)


def mahalanobis(x, mean, cov):
    from .numeric import inverse

    mean, cov = (v.column if isinstance(v, Const) else v for v in (mean, cov))
    diff = F.zip_with(x, mean, lambda a, b: a - b)
    inv = inverse(cov)
    return F.sqrt(dot(diff, F.transform(inv, lambda r: dot(r, diff))))


def update_chi2(pull, s, dof="dof"):
    terms = total(F.transform(pull, lambda v: v * v)) if trait(pull, "_is_array") else total(F.transform(F.map_values(pull), lambda v: v * v)) if trait(pull, "_is_map") else pull * pull
    n = size(pull) if trait(pull, "_is_array") or trait(pull, "_is_map") else F.lit(1)
    return put(s, chi2=s["chi2"] + terms, **{dof: s[dof] + n})


def chi2_prob(s, dof="dof"):
    return LIBRARY["prob.dist.chi2CDF"](s["chi2"], s[dof])


_tests = {
    "residual": over(lambda o, p: o - p),
    "pull": over(lambda o, p, u: (o - p) / u),
    "mahalanobis": mahalanobis,
}
define_all("stat.test.", _tests | {"kolmogorov": kolmogorov, "updateChi2": update_chi2, "reducedChi2": lambda s: s["chi2"] / s["dof"], "chi2Prob": chi2_prob})
define_all("model.reg.", _tests | {"updateChi2": lambda p, s: update_chi2(p, s, "DOF"), "reducedChi2": lambda s: s["chi2"] / s["DOF"], "chi2Prob": lambda s: chi2_prob(s, "DOF")})


def value_of(m):
    return m.column if isinstance(m, Const) else m


def reg_linear(x, m):
    c = value_of(m)
    if isinstance(m, Const) and isinstance(m.value["coeff"], list) and m.value["coeff"] and isinstance(m.value["coeff"][0], list):
        return F.transform(F.arrays_zip(c["coeff"].alias("w"), c["const"].alias("b")), lambda r: dot(x, r["w"]) + r["b"])
    if trait(x, "_is_map"):
        return total(F.transform(F.map_entries(x), lambda e: e["value"] * F.coalesce(F.try_element_at(c["coeff"], e["key"]), F.lit(0.0)))) + c["const"]
    return dot(x, c["coeff"]) + c["const"]


def linear_variance(x, m):
    """x' C x with a leading one for the constant."""
    c = value_of(m)
    return let(F.concat(x, F.array(F.lit(1.0))), lambda full: dot(full, F.transform(c["covar"], lambda r: dot(r, full))))


def gaussian_process(x, table, weight, kernel):
    """Kriging: kernel weights of the table's points solve the training system (numpy, one solve a batch row)."""
    from .numeric import inverse

    table = value_of(table)
    point = x if trait(x, "_is_array") else F.array(x)
    where = (lambda r: r["x"]) if trait(x, "_is_array") else (lambda r: F.array(r["x"]))
    noise = F.coalesce(weight, F.lit(0.0))
    gram = F.transform(table, lambda r, a: F.transform(table, lambda q, b: kernel(where(r), where(q)) + F.when(a == b, noise).otherwise(F.lit(0.0))))
    near = F.transform(table, lambda r: kernel(point, where(r)))
    inv = inverse(gram)
    return dot(near, F.transform(inv, lambda r: dot(r, F.transform(table, lambda q: q["to"]))))


define_all("model.reg.", {"linear": reg_linear, "linearVariance": linear_variance, "gaussianProcess": gaussian_process})

#: Comparison operators of tree nodes.
OPERATORS = {
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def plain(v):
    """A union's value without its tag."""
    return next(iter(v.values())) if isinstance(v, dict) and len(v) == 1 else v


def simple_test(datum, node) -> Column:
    c = node.value
    field, op, value = datum[plain(c["field"])], c["operator"], plain(c["value"])
    if op == "alwaysTrue":
        return F.lit(True)
    if op == "alwaysFalse":
        return F.lit(False)
    if op in ("in", "notIn"):
        inside = field.isin(*value)
        return inside if op == "in" else ~inside
    if op in ("isMissing", "notMissing"):
        return field.isNull() if op == "isMissing" else field.isNotNull()
    return OPERATORS[op](field, F.lit(value))


def is_node(v, need="pass") -> bool:
    return isinstance(v, dict) and need in v


def branch(v, need="pass"):
    """(node or None, score) of a child, which may be tagged."""
    inner = v if is_node(v, need) else plain(v)
    return (Const(inner), None) if is_node(inner, need) else (None, inner)


def tree_walk(datum, tree, test, missing=False):
    def go(child):
        node, score = branch(child)
        if node is None:
            return F.lit(score)
        t = test(datum, node)
        start = F.when(t.isNull(), go(node.value["missing"])) if missing else F
        return start.when(t, go(node.value["pass"])).otherwise(go(node.value["fail"]))

    return go(tree.value)


def compound_test(datum, operator, comparisons, test):
    op = operator.value if isinstance(operator, Const) else operator
    results = [test(datum, Const(c)) for c in comparisons.value]
    out = results[0]
    for r in results[1:]:
        out = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b}[op](out, r)
    return out


def surrogate_test(datum, comparisons, test):
    return guard(F.coalesce(*(test(datum, Const(c)) for c in comparisons.value)).isNull(), 32030, "no successful surrogate", F.coalesce(*(test(datum, Const(c)) for c in comparisons.value)))


define_all("model.tree.", {
    "simpleTest": simple_test,
    "missingTest": lambda x, c: F.when(x[plain(c.value["field"])].isNotNull(), simple_test(x, c)),
    "compoundTest": compound_test,
    "surrogateTest": surrogate_test,
    "simpleWalk": tree_walk,
    "missingWalk": lambda x, t, f: tree_walk(x, t, f, True),
    "simpleTree": lambda x, t: tree_walk(x, t, simple_test),
})


def squared(x, y) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def nearest(x, items, where, metric, n=None):
    near = order(F.transform(items, lambda c: metric(x, where(c))))
    return picks(items, near if n is None else first_n(near, n))


def kmeans_iteration(data, clusters, metric, update):
    """Each cluster updated with the points that it is closest to; empty clusters stay."""
    clusters = value_of(clusters)
    numbered = F.transform(data, lambda x: F.struct(x.alias("x"), best_place(F.transform(clusters, lambda c: metric(x, c["center"])), lambda a, b: a < b).alias("k")))
    mine = lambda points, k: F.transform(F.filter(points, lambda p: p["k"] == k), lambda p: p["x"])
    return let(numbered, lambda points: F.transform(clusters, lambda c, k: let(mine(points, k), lambda own: F.when(size(own) == 0, c).otherwise(update(own, c)))))


def centroid(points) -> Column:
    return F.transform(at(points, F.lit(0)), lambda _, k: total(F.transform(points, lambda p: at(p, k))) / size(points))


define_all("model.cluster.", {
    "closest": lambda x, cs, m=squared: at(nearest(x, value_of(cs), lambda c: c["center"], m), F.lit(0)),
    "closestN": lambda n, x, cs, m=squared: nearest(x, value_of(cs), lambda c: c["center"], m, n),
    "randomSeeds": lambda data, k, new: F.transform(F.slice(F.shuffle(F.array_distinct(data)), F.lit(1), k), lambda x, j: new(j, x)),
    "kmeansIteration": kmeans_iteration,
    "updateMean": lambda data, c, w: put(c, center=F.zip_with(c["center"], F.transform(c["center"], lambda _, k: total(F.transform(data, lambda p: at(p, k)))), lambda old, s: (old * w + s) / (w + size(data)))),
})


def neighbor_mean(points, weight=None):
    if weight is None:
        return centroid(points)
    weights = total(F.transform(points, lambda p: weight(p)))
    return F.transform(at(points, F.lit(0)), lambda _, k: total(F.transform(points, lambda p: at(p, k) * weight(p))) / weights)


define_all("model.neighbor.", {
    "mean": neighbor_mean,
    "nearestK": lambda k, x, book, m=squared: nearest(x, value_of(book), lambda c: c, m, k),
    "ballR": lambda r, x, book, m=LIBRARY["metric.simpleEuclidean"]: F.filter(value_of(book), lambda c: m(x, c) < r),
})


def naive_gaussian(x, model):
    ll = lambda v, p: -F.ln(2 * math.pi * p["variance"]) / 2 - (v - p["mean"]) * (v - p["mean"]) / (2 * p["variance"])
    model = value_of(model)
    if trait(x, "_is_map"):
        return total(F.transform(F.map_entries(x), lambda e: ll(e["value"], F.element_at(model, e["key"]))))
    return total(F.zip_with(x, model, ll))


def _values(model):
    return (value_of(model)["values"] if isinstance(model, Const) and isinstance(model.value, dict) and "values" in model.value else value_of(model))


def naive_multinomial(x, model):
    p = _values(model)
    if trait(x, "_is_map"):
        bottom = total(F.map_values(p))
        return total(F.transform(F.map_entries(x), lambda e: e["value"] * F.ln(F.element_at(p, e["key"]) / bottom)))
    return total(F.zip_with(x, p, lambda n, q: n * F.ln(q / total(p))))


def naive_bernoulli(words, model):
    p = _values(model)
    return total(F.transform(F.map_entries(p), lambda e: F.when(F.array_contains(words, e["key"]), F.ln(e["value"])).otherwise(F.ln(1 - e["value"]))))


define_all("model.naive.", {"gaussian": naive_gaussian, "multinomial": naive_multinomial, "bernoulli": naive_bernoulli})


def simple_layers(x, model, activation):
    """Constant layers: the last one has no activation."""
    layers = model.value
    for k, layer in enumerate(layers):
        rows = F.array(*(F.array(*map(F.lit, map(float, r))) for r in layer["weights"]))
        bias = F.array(*map(F.lit, map(float, layer["bias"])))
        x = F.zip_with(_product(rows, x), bias, lambda a, b: a + b)
        if k < len(layers) - 1:
            x = F.transform(x, lam(activation, 1))
    return x


def _product(rows, x):
    return F.transform(rows, lambda r: dot(x, r))


def svm(x, model, kernel):
    m = value_of(model)
    part = lambda side: total(F.transform(m[side], lambda v: v["coeff"] * kernel(x, v["supVec"])))
    return part("posClass") + part("negClass") + m["const"]


LIBRARY["model.neural.simpleLayers"] = simple_layers
LIBRARY["model.svm.score"] = svm
