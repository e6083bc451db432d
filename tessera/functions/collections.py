"""Arrays and maps, by higher-order functions inside a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import d, define_all, fail, guard, i, lam, let, trait
from .scalar import clip_index


def size(a) -> Column:
    return F.size(a)


def at(a, k) -> Column:
    return F.get(a, k)


def upto(n) -> Column:
    """0 .. n - 1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def some(a, value, code=15000, message="empty array") -> Column:
    return F.when(size(a) == 0, fail(code, message)).otherwise(value)


def subseq(a, start, end):
    n = size(a)
    lo, hi = clip_index(n, start), clip_index(n, end)
    return F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0)))


def subseqto(a, start, end, r):
    n = size(a)
    lo = clip_index(n, start)
    hi = F.greatest(clip_index(n, end), lo)
    return F.concat(F.slice(a, F.lit(1), lo), r, F.slice(a, hi + 1, n - hi))


def strict(a, k, code):
    """A position of a[k], counted from the end if negative; an error out of range."""
    p = F.when(k < 0, size(a) + k).otherwise(k)
    return F.when((p < 0) | (p >= size(a)), fail(code, "index out of range")).otherwise(p)


def places(a, needle) -> Column:
    """Positions where an item, a run of items or a predicate fits."""
    if callable(needle) and not isinstance(needle, Column):
        return F.filter(upto(size(a)), lambda k: needle(at(a, k)))
    return F.filter(upto(size(a)), lambda k: at(a, k).eqNullSafe(needle))


def run_places(a, b) -> Column:
    return F.filter(upto(size(a) - size(b) + 1), lambda k: F.slice(a, k + 1, size(b)) == b)


def _needle(one, many):
    def f(a, needle):
        hits = run_places(a, needle) if trait(needle, "_is_array") else places(a, needle)
        return (many if trait(needle, "_is_array") else one)(hits)

    return f


def compare(less):
    """A comparator for array_sort from a strict order."""
    return lambda x, y: F.when(less(x, y), -1).when(less(y, x), 1).otherwise(0)


def numbered(a) -> Column:
    return F.transform(a, lambda v, k: F.struct(v.alias("v"), k.alias("k")))


def order(a, down=False, less=None) -> Column:
    """Positions in sorted order; ties keep the first first."""
    if less is None:
        less = (lambda x, y: x > y) if down else (lambda x, y: x < y)
    elif down:
        up = less
        less = lambda x, y: up(y, x)
    by = lambda x, y: F.when(less(x["v"], y["v"]), -1).when(less(y["v"], x["v"]), 1).otherwise(F.when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(0))
    return F.transform(F.array_sort(numbered(a), by), lambda s: s["k"])


def best_place(a, less) -> Column:
    """The position of the first item that no other one is less than, by one pass."""
    return let(a, lambda a: F.aggregate(upto(size(a)), F.lit(0), lambda best, k: F.when(less(at(a, k), at(a, best)), k).otherwise(best)))


def first_n(a, n) -> Column:
    return guard(n < 0, 15160, "n < 0", F.slice(a, F.lit(1), F.greatest(n, F.lit(0))))


def picks(a, ks) -> Column:
    return F.transform(ks, lambda k: at(a, k))


def total(a, zero=0) -> Column:
    return F.aggregate(a, F.lit(zero).cast("double"), lambda x, y: x + y.cast("double"))


def mean(a) -> Column:
    return F.when(size(a) == 0, F.lit(float("nan"))).otherwise(total(a) / F.greatest(size(a), F.lit(1)))


def median(a):
    s, n = F.array_sort(a), size(a)
    half = F.call_function("div", n, F.lit(2)).cast("int")
    kind = trait(a, "_type")
    if kind is not None and kind.elementType.simpleString() not in ("float", "double"):  # whole numbers and others: the lower middle
        return some(a, at(s, F.call_function("div", n - 1, F.lit(2)).cast("int")), 15420)
    return some(a, F.when(n % 2 == 1, at(s, half).cast("double")).otherwise((at(s, half - 1).cast("double") + at(s, half).cast("double")) / 2), 15420)


def ntile(a, p):
    s, n = F.array_sort(a), size(a)
    k = (n - 1) * p
    lo = i(F.floor(k))
    inner = at(s, lo) + (at(s, F.least(lo + 1, n - 1)) - at(s, lo)) * (k - lo)
    return some(a, F.when(p <= 0, d(at(s, F.lit(0)))).when(p >= 1, d(at(s, n - 1))).otherwise(d(inner)), 15430)


def mode(a):
    """The item with the longest run in sorted order, the smallest one of several."""

    def longest(s):
        start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"), F.lit(0).alias("place"))

        def step(z, k):
            run = F.when((k > 0) & (at(s, k) == at(s, F.greatest(k - 1, F.lit(0)))), z["run"] + 1).otherwise(1)
            return F.struct(run.alias("run"), F.greatest(run, z["most"]).alias("most"), F.when(run > z["most"], k).otherwise(z["place"]).alias("place"))

        return at(s, F.aggregate(upto(size(s)), start, step)["place"])

    return some(a, let(F.array_sort(a), longest), 15440)


def sliding(a, n, step, partial=None):
    ks = F.filter(upto(size(a)), lambda k: (k % step == 0) & (k + n <= size(a)))
    return F.transform(ks, lambda k: F.slice(a, k + 1, n))


def groups(a, key):
    keyed = F.transform(a, lambda v: F.struct(key(v).alias("key"), v.alias("v")))
    keys = F.array_distinct(F.transform(keyed, lambda s: s["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(keyed, lambda s: s["key"] == k), lambda s: s["v"])))


def combinations(a, n):
    """All choices of n items in order, by bit masks; for short arrays."""
    masks = F.filter(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), size(a)) - 1), lambda m: F.bit_count(m) == n)
    taken = lambda m: F.filter(upto(size(a)), lambda k: F.call_function("shiftright", m, k).bitwiseAND(F.lit(1)) == 1)
    return F.transform(F.array_sort(F.transform(masks, taken)), lambda ks: picks(a, ks))


def permutations(a):
    """All orders of an array, the positions in lexicographic order, grown one place at a time; for short arrays."""
    n = size(a)
    start = F.array(F.array().cast("array<int>"))
    grow = lambda done, _: F.flatten(F.transform(done, lambda p: F.transform(F.filter(upto(n), lambda k: ~F.array_contains(p, k)), lambda k: F.concat(p, F.array(k)))))
    return F.transform(F.aggregate(upto(n), start, grow), lambda ks: picks(a, ks))


def fold(a, zero, f):
    return F.aggregate(a, zero, lam(f, 2))


def while_prefix(a, f):
    """The length of the longest prefix whose items all satisfy f."""
    bad = F.filter(upto(size(a)), lambda k: ~f(at(a, k)))
    return F.coalesce(F.get(bad, F.lit(0)), size(a))


def zipped(*arrays):
    """(arrays..., function) -> the arrays and the function; arrays must have one length."""
    *xs, f = arrays
    return xs, f


def zipmap(*args, index=False):
    xs, f = zipped(*args)
    same = F.lit(True)
    for x in xs[1:]:
        same = same & (size(x) == size(xs[0]))
    body = F.transform(upto(size(xs[0])), lambda k: f(*([k] if index else []), *(at(x, k) for x in xs)))
    return guard(~same, 15200, "misaligned arrays", body)


_first = lambda hits: F.coalesce(F.get(hits, F.lit(0)), F.lit(-1))
_last = lambda hits: F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit(-1))
non_null = lambda a: F.filter(a, lambda x: x.isNotNull())

define_all("a.", {
    "len": size,
    "subseq": subseq,
    "head": lambda a: some(a, at(a, F.lit(0)), 15020),
    "tail": lambda a: some(a, F.slice(a, F.lit(2), size(a)), 15030),
    "last": lambda a: some(a, at(a, size(a) - 1), 15040),
    "init": lambda a: some(a, F.slice(a, F.lit(1), size(a) - 1), 15050),
    "subseqto": subseqto,
    "contains": _needle(lambda h: size(h) > 0, lambda h: size(h) > 0),
    "count": _needle(size, size),
    "index": _needle(_first, _first),
    "rindex": _needle(_last, _last),
    "startswith": lambda a, b: F.slice(a, F.lit(1), size(b)) == b if trait(b, "_is_array") else F.coalesce(at(a, F.lit(0)) == b, F.lit(False)),
    "endswith": lambda a, b: F.slice(a, F.greatest(size(a) - size(b), F.lit(0)) + 1, size(b)) == b if trait(b, "_is_array") else F.coalesce(at(a, size(a) - 1) == b, F.lit(False)),
    "concat": lambda a, b: F.concat(a, b),
    "append": lambda a, x: F.concat(a, F.array(x)),
    "cycle": lambda a, x, n: guard(n < 0, 15150, "maxLength < 0", F.slice(F.concat(a, F.array(x)), F.greatest(size(a) + 2 - n, F.lit(1)), F.greatest(n, F.lit(0)))),
    "insert": lambda a, k, x: F.concat(F.slice(a, F.lit(1), strict(a, k, 15130)), F.array(x), F.slice(a, strict(a, k, 15130) + 1, size(a))),
    "replace": lambda a, k, x: F.transform(a, lambda v, j: F.when(j == strict(a, k, 15140), x).otherwise(v)),
    "remove": lambda a, k, end=None: subseqto(a, k, end, F.slice(a, F.lit(1), F.lit(0))) if end is not None else F.filter(a, lambda v, j: j != strict(a, k, 15145)),
    "rotate": lambda a, n: F.when(size(a) == 0, a).otherwise(F.concat(F.slice(a, F.pmod(n, F.greatest(size(a), F.lit(1))) + 1, size(a)), F.slice(a, F.lit(1), F.pmod(n, F.greatest(size(a), F.lit(1)))))),
    "sort": lambda a: F.array_sort(a),
    "sortLT": lambda a, f: picks(a, order(a, less=f)),
    "shuffle": lambda a: F.shuffle(a),
    "reverse": lambda a: F.reverse(a),
    "max": lambda a: some(a, F.array_max(a), 15170),
    "min": lambda a: some(a, F.array_min(a), 15180),
    "maxLT": lambda a, f: some(a, at(a, best_place(a, lambda x, y: f(y, x))), 15190),
    "minLT": lambda a, f: some(a, at(a, best_place(a, f)), 15200),
    "maxN": lambda a, n: some(a, picks(a, first_n(order(a, True), n)), 15210),
    "minN": lambda a, n: some(a, picks(a, first_n(order(a), n)), 15220),
    "maxNLT": lambda a, n, f: some(a, picks(a, first_n(order(a, True, f), n)), 15230),
    "minNLT": lambda a, n, f: some(a, picks(a, first_n(order(a, False, f), n)), 15240),
    "argmax": lambda a: some(a, i(F.array_position(a, F.array_max(a)) - 1), 15250),
    "argmin": lambda a: some(a, i(F.array_position(a, F.array_min(a)) - 1), 15260),
    "argmaxLT": lambda a, f: some(a, best_place(a, lambda x, y: f(y, x)), 15270),
    "argminLT": lambda a, f: some(a, best_place(a, f), 15280),
    "argmaxN": lambda a, n: some(a, first_n(order(a, True), n), 15290),
    "argminN": lambda a, n: some(a, first_n(order(a), n), 15300),
    "argmaxNLT": lambda a, n, f: some(a, first_n(order(a, True, f), n), 15310),
    "argminNLT": lambda a, n, f: some(a, first_n(order(a, False, f), n), 15320),
    "sum": lambda a: total(a),
    "product": lambda a: F.aggregate(a, F.lit(1.0), lambda x, y: x * y.cast("double")),
    "lnsum": lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + F.ln(d(y))),
    "mean": mean,
    "geomean": lambda a: F.exp(mean(F.transform(a, lambda x: F.ln(d(x))))),
    "median": median,
    "ntile": ntile,
    "mode": mode,
    "logsumexp": lambda a: some(a, let(F.array_max(a), lambda top: top + F.ln(total(F.transform(a, lambda x: F.exp(x - top))))), 15410),
    "distinct": lambda a: F.array_distinct(a),
    "seteq": lambda a, b: (size(F.array_except(a, b)) == 0) & (size(F.array_except(b, a)) == 0),
    "union": lambda a, b: F.array_union(a, b),
    "intersection": lambda a, b: F.array_intersect(a, b),
    "diff": lambda a, b: F.array_except(a, b),
    "symdiff": lambda a, b: F.concat(F.array_except(a, b), F.array_except(b, a)),
    "subset": lambda a, b: size(F.array_except(a, b)) == 0,
    "disjoint": lambda a, b: size(F.array_intersect(a, b)) == 0,
    "map": lambda a, f: F.transform(a, lam(f, 1)),
    "mapWithIndex": lambda a, f: F.transform(a, lambda x, k: f(k, x)),
    "filter": lambda a, f: F.filter(a, lam(f, 1)),
    "filterWithIndex": lambda a, f: F.filter(a, lambda x, k: f(k, x)),
    "filterMap": lambda a, f: non_null(F.transform(a, lam(f, 1))),
    "filterMapWithIndex": lambda a, f: non_null(F.transform(a, lambda x, k: f(k, x))),
    "flatMap": lambda a, f: F.flatten(F.transform(a, lam(f, 1))),
    "flatMapWithIndex": lambda a, f: F.flatten(F.transform(a, lambda x, k: f(k, x))),
    "zipmap": zipmap,
    "zipmapWithIndex": lambda *args: zipmap(*args, index=True),
    "reduce": lambda a, f: some(a, F.reduce(F.slice(a, F.lit(2), size(a)), at(a, F.lit(0)), lam(f, 2)), 15490),
    "reduceRight": lambda a, f: some(a, F.reduce(F.slice(F.reverse(a), F.lit(2), size(a)), at(a, size(a) - 1), lambda x, y: f(y, x)), 15500),
    "fold": fold,
    "foldRight": lambda a, zero, f: F.aggregate(F.reverse(a), zero, lambda x, y: f(y, x)),
    "takeWhile": lambda a, f: F.slice(a, F.lit(1), while_prefix(a, f)),
    "dropWhile": lambda a, f: F.slice(a, while_prefix(a, f) + 1, size(a)),
    "any": lambda a, f: F.exists(a, lam(f, 1)),
    "all": lambda a, f: F.forall(a, lam(f, 1)),
    "corresponds": lambda a, b, f: (size(a) == size(b)) & F.forall(upto(size(a)), lambda k: f(at(a, k), at(b, k))),
    "correspondsWithIndex": lambda a, b, f: (size(a) == size(b)) & F.forall(upto(size(a)), lambda k: f(k, at(a, k), at(b, k))),
    "slidingWindow": sliding,
    "combinations": combinations,
    "permutations": permutations,
    "flatten": lambda a: F.flatten(a),
    "groupby": groups,
})


def entries(m):
    return F.map_entries(m)


def by_value(m, down=False, less=None):
    """Keys by value, ties by key; the map is evaluated once."""
    less = less or (lambda x, y: x < y)
    first = (lambda x, y: less(y, x)) if down else less
    by = lambda x, y: F.when(first(x["value"], y["value"]), -1).when(first(y["value"], x["value"]), 1).otherwise(F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    return F.transform(F.array_sort(F.map_entries(m), by), lambda e: e["key"])


def merge(base, overlay):
    return let(overlay, lambda over: F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over))


def from_entries(es):
    return F.map_from_entries(es)


def set_key(x):
    return F.to_json(F.struct(x.alias("v")))


_has = lambda m, k: F.map_contains_key(m, k)
_singles = lambda m: F.transform(F.map_keys(m), lambda k: F.map_from_arrays(F.array(k), F.array(F.element_at(m, k))))


def _joined(maps_of_entries):
    """One map of several, later keys win."""
    keyed = lambda es, keys: F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(es, lambda e: e["key"] == k), -1)["value"]))
    return let(F.flatten(maps_of_entries), lambda es: let(F.array_distinct(F.transform(es, lambda e: e["key"])), lambda keys: keyed(es, keys)))


def _zip_keys(args, with_key):
    *ms, f = args
    keys = F.map_keys(ms[0])
    return F.map_from_arrays(keys, F.transform(keys, lambda k: f(*([k] if with_key else []), *(F.element_at(m, k) for m in ms))))


define_all("map.", {
    "len": lambda m: F.size(m),
    "keys": lambda m: F.map_keys(m),
    "values": lambda m: F.map_values(m),
    "containsKey": lambda m, k: F.exists(F.map_keys(m), lam(k, 1)) if callable(k) and not isinstance(k, Column) else _has(m, k),
    "containsValue": lambda m, v: F.exists(F.map_values(m), lam(v, 1)) if callable(v) and not isinstance(v, Column) else F.exists(F.map_values(m), lambda x: x.eqNullSafe(v)),
    "add": lambda m, k, v=None: merge(m, F.create_map(set_key(k), k)) if v is None else merge(m, F.create_map(k, v)),
    "remove": lambda m, k: F.map_filter(m, lambda x, _: x != k),
    "only": lambda m, ks: F.map_filter(m, lambda x, _: F.array_contains(ks, x)),
    "except": lambda m, ks: F.map_filter(m, lambda x, _: ~F.array_contains(ks, x)),
    "update": merge,
    "split": _singles,
    "join": lambda ms: _joined(F.transform(ms, lambda m: F.map_entries(m))),
    "argmax": lambda m: some(F.map_keys(m), at(by_value(m, True), F.lit(0)), 26080, "empty map"),
    "argmin": lambda m: some(F.map_keys(m), at(by_value(m), F.lit(0)), 26090, "empty map"),
    "argmaxLT": lambda m, f: some(F.map_keys(m), at(by_value(m, True, f), F.lit(0)), 26100, "empty map"),
    "argminLT": lambda m, f: some(F.map_keys(m), at(by_value(m, False, f), F.lit(0)), 26110, "empty map"),
    "argmaxN": lambda m, n: first_n(by_value(m, True), n),
    "argminN": lambda m, n: first_n(by_value(m), n),
    "argmaxNLT": lambda m, n, f: first_n(by_value(m, True, f), n),
    "argminNLT": lambda m, n, f: first_n(by_value(m, False, f), n),
    "toset": lambda a: F.map_from_arrays(F.transform(F.array_distinct(a), set_key), F.array_distinct(a)),
    "fromset": lambda m: F.map_values(m),
    "in": lambda m, x: _has(m, set_key(x)),
    "union": merge,
    "intersection": lambda a, b: F.map_filter(a, lambda k, _: _has(b, k)),
    "diff": lambda a, b: F.map_filter(a, lambda k, _: ~_has(b, k)),
    "symdiff": lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~_has(b, k)), F.map_filter(b, lambda k, _: ~_has(a, k))),
    "subset": lambda a, b: F.forall(F.map_keys(a), lambda k: _has(b, k)),
    "disjoint": lambda a, b: ~F.exists(F.map_keys(a), lambda k: _has(b, k)),
    "map": lambda m, f: F.transform_values(m, lambda _, v: f(v)),
    "mapWithKey": lambda m, f: F.transform_values(m, lambda k, v: f(k, v)),
    "filter": lambda m, f: F.map_filter(m, lambda _, v: f(v)),
    "filterWithKey": lambda m, f: F.map_filter(m, lambda k, v: f(k, v)),
    "filterMap": lambda m, f: F.map_filter(F.transform_values(m, lambda _, v: f(v)), lambda _, v: v.isNotNull()),
    "filterMapWithKey": lambda m, f: F.map_filter(F.transform_values(m, lambda k, v: f(k, v)), lambda _, v: v.isNotNull()),
    "flatMap": lambda m, f: _joined(F.transform(F.map_values(m), lambda v: F.map_entries(f(v)))),
    "flatMapWithKey": lambda m, f: _joined(F.transform(F.map_entries(m), lambda e: F.map_entries(f(e["key"], e["value"])))),
    "zipmap": lambda *args: _zip_keys(args, False),
    "zipmapWithKey": lambda *args: _zip_keys(args, True),
    "corresponds": lambda a, b, f: (F.size(a) == F.size(b)) & F.forall(F.map_keys(a), lambda k: _has(b, k) & f(F.try_element_at(a, k), F.try_element_at(b, k))),
    "correspondsWithKey": lambda a, b, f: (F.size(a) == F.size(b)) & F.forall(F.map_keys(a), lambda k: _has(b, k) & f(k, F.try_element_at(a, k), F.try_element_at(b, k))),
})
