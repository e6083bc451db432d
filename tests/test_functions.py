"""Functions at their edges, where tables have no such values, and documents that must be refused."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import operators as ops
from tessera import queries
from tessera.functions import LIBRARY as L
from tessera.functions import distributions
from tessera.functions.numeric import determinant, inverse
from tessera.plans.compiler import Engine, SemanticError, mark


def one(spark, expression, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(expression(*(mark(F.col(k), row.schema[k].dataType) for k in values)).alias("x")).first().x


def test_arithmetic_edges(spark):
    assert one(spark, L["m.special.erfc"], x=6.0) == pytest.approx(2.1519736712498913e-17, rel=1e-12)
    assert one(spark, L["m.special.erfc"], x=-3.0) == pytest.approx(math.erfc(-3), rel=1e-14)
    for x in (-5.0, -2.3, -2.1, 0.0, 0.4, 2.19, 2.21, 7.0):
        assert one(spark, L["m.special.erf"], x=x) == pytest.approx(math.erf(x), abs=2e-15)
    assert math.isnan(one(spark, L["%"], k=5.0, n=0.0)) and math.isnan(one(spark, L["%%"], k=5.0, n=0.0))
    assert one(spark, L["%"], k=-7, n=3) == 2 and one(spark, L["%%"], k=-7, n=3) == -1
    with pytest.raises(Exception, match="18060"):
        one(spark, L["%"], k=5, n=0)
    assert one(spark, L["**"], x=3, y=4) == 81 and one(spark, L["**"], x=2.0, y=0.5) == pytest.approx(2**0.5)
    with pytest.raises(Exception, match="18080"):
        one(spark, L["**"], x=2, y=40)
    assert math.copysign(1, one(spark, L["m.copysign"], x=3.0, y=-0.0)) == -1
    assert [one(spark, L["m.round"], x=x) for x in (0.49999999999999994, 0.5, -0.5, -1.5, 2.5)] == [0, 1, 0, -1, 3]


def test_utf16_needs_whole_pairs(spark):
    for text, ok in ((b"\xd8\x00", False), ("\U0001d11ex".encode("utf-16-be"), True), (b"\xdc\x00\xd8\x00", False), (b"\x00", False), (b"", True), (b"\xd8\x34\x00\x41", False)):
        assert one(spark, L["bytes.isUtf16be"], b=bytearray(text)) is ok, text
        swapped = b"".join(text[i : i + 2][::-1] for i in range(0, len(text), 2))
        assert one(spark, L["bytes.isUtf16le"], b=bytearray(swapped)) is ok, text
        assert one(spark, L["bytes.isUtf16"], b=bytearray(b"\xff\xfe" + swapped)) is ok


def test_distributions_have_no_bounds(spark):
    dist = lambda name, *v: one(spark, L[f"prob.dist.{name}"], **{f"a{k}": float(x) for k, x in enumerate(v)})
    assert dist("gaussianQF", 0.5, 1e12, 1) == 1e12
    assert dist("exponentialQF", 0.5, 1e-12) == pytest.approx(math.log(2) * 1e12)
    assert dist("lognormalQF", 0.5, 30, 1) == pytest.approx(math.exp(30))
    assert dist("poissonCDF", 2e8, 3e8) == 0
    assert dist("chi2CDF", 4e8 + 1e5, 4e8) == pytest.approx(0.99979631, abs=1e-7)
    assert dist("tQF", 0.5, 5) == pytest.approx(0, abs=1e-12)
    assert dist("chi2CDF", dist("chi2QF", 0.9, 4e8), 4e8) == pytest.approx(0.9, abs=1e-9)


def test_matrices(spark):
    rng = np.random.default_rng(0)
    made = [rng.normal(size=(n, n)) for n in (1, 2, 3, 5) for _ in range(4)] + [np.array([[0.0, 1.0], [1.0, 0.0]]), np.array([[0.0, 2.0, 1.0], [3.0, 0.0, 1.0], [1.0, 1.0, 0.0]])]
    df = spark.createDataFrame([(k, m.tolist()) for k, m in enumerate(made)], "k int, m array<array<double>>")
    for r in df.select("k", inverse(F.col("m")).alias("i"), determinant(F.col("m")).alias("d")).collect():
        assert np.allclose(np.array(r.i), np.linalg.inv(made[r.k])) and np.isclose(r.d, np.linalg.det(made[r.k]))
    singular = spark.createDataFrame([([[1.0, 2.0], [2.0, 4.0]],)], "m array<array<double>>")
    assert singular.select(determinant(F.col("m")).alias("d")).first().d == 0
    with pytest.raises(Exception, match="singular"):
        singular.select(inverse(F.col("m")).alias("i")).collect()


def test_mode_and_extremes(spark):
    for items, mode, place in (([3, 1, 3, 2, 1], 1, 0), ([2, 2, 9], 2, 2), ([5], 5, 0)):
        assert one(spark, lambda a: L["a.mode"](F.array(*map(F.lit, items))), z=1) == mode
        less = lambda x, y: x < y
        assert one(spark, lambda a: L["a.argmaxLT"](F.array(*map(F.lit, items)), less), z=1) == one(spark, lambda a: L["a.argmax"](F.array(*map(F.lit, items))), z=1) == place


def test_documents_that_are_not_supported_are_refused():
    doc = {"input": "double", "output": "double", "action": "input"}
    for key, value in (("begin", [{"error": "x"}]), ("end", ["x"]), ("randseed", 12345), ("surprise", 1)):
        with pytest.raises(SemanticError, match=key):
            Engine({**doc, key: value})
    Engine({**doc, "begin": [], "metadata": {"a": "b"}})


def test_models_from_files(spark, tmp_path):
    (tmp_path / "model.json").write_text(json.dumps(2.5))
    for place in (str(tmp_path / "model.json"), f"file://{tmp_path}/model.json"):
        doc = {"input": "double", "output": "double", "action": {"*": ["input", {"cell": "k"}]}, "cells": {"k": {"type": "double", "init": place, "source": "json"}}}
        got = Engine(doc).score(spark.createDataFrame([(2.0,)], "value double")).first()
        assert got.output == 5.0
    doc["cells"]["k"]["source"] = "avro"
    with pytest.raises(SemanticError, match="avro"):
        Engine(doc).score(spark.createDataFrame([(2.0,)], "value double"))


def test_folds(spark):
    df = spark.range(0, 10_000, 1, 7).selectExpr("cast(id as double) as value")
    longest = {"method": "fold", "zero": "", "input": "double", "output": "string", "action": {"if": {"<": ["input", 5.0]}, "then": {"s.concat": ["tally", {"s.number": [{"cast.int": ["input"]}]}]}, "else": "tally"}, "merge": {"s.concat": ["tallyOne", "tallyTwo"]}}
    assert Engine(longest).score(df).first().output == "01234"  # order is kept, though merging isn't commutative
    assert Engine(longest).score(df.filter("value < 0")).first().output == ""
    largest = {"method": "fold", "zero": -1.0, "input": "double", "output": "double", "action": {"max": ["tally", "input"]}, "merge": {"max": ["tallyOne", "tallyTwo"]}}
    plan = Engine(largest).score(df)
    assert plan.first().output == 9999.0 and "MapInArrow" not in plan._jdf.queryExecution().executedPlan().toString()
    assert Engine(largest).score(df.filter("value < 0")).first().output == -1.0


def test_loops_take_their_steps(spark):
    doc = {"input": "long", "output": "long", "action": [{"let": {"n": "input", "k": {"long": 0}}}, {"while": {">": ["n", {"long": 0}]}, "do": [{"set": {"n": {"-": ["n", {"long": 1}]}, "k": {"+": ["k", {"long": 2}]}}}]}, "k"]}
    df = spark.createDataFrame([(0,), (1,), (99,), (100,), (101,), (5000,)], "value long")
    assert [r.output for r in Engine(doc).score(df).collect()] == [0, 2, 198, 200, 202, 10_000]
    with pytest.raises(Exception, match="too many iterations"):
        Engine(doc, max_iterations=100).score(df).collect()


def test_rounding_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    values = [0.5e-6, -0.5e-6, 2.5, -2.5, 0.0, -0.0, -1e-12, 1e300, -1e15 - 0.5, 0.49999999999999994, 1.0000005, float("inf"), float("nan"), None]
    values += [(k + 0.5) / 1e9 + k / 7 for k in range(40_000, 60_000)]  # ties of the scaled number, not of its decimal digits
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    for digits in (0, 4, 6, 9):
        got = [r.v for r in df.select("k", ops.rounded("v", digits).alias("v")).orderBy("k").collect()]
        want = duckdb.execute(f"SELECT list(round(v, {digits})) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchone()[0]
        assert [str(v) for v in got] == [str(v) for v in want]


def test_quantiles_in_few_steps():
    p = np.concatenate([np.linspace(0.001, 0.999, 997), [1e-12, 1 - 1e-12]])
    for name, *params in (("chi2", 2.0), ("gamma", 30.0, 1.5), ("beta", 0.4, 0.3), ("f", 2.0, 4.0), ("t", 2.0), ("poisson", 500.0), ("hypergeometric", 8.0, 12.0, 9.0)):
        cdf, low, whole = distributions.CDFS[name]
        asked = []

        def counted(x, *a, cdf=cdf, asked=asked):
            asked.append(len(x))
            return cdf(x, *a)

        q = distributions.quantile(counted, p, low, 1.0, whole, params)
        assert sum(asked) < 40 * len(p)  # bisection took 50 and more each
        assert (cdf(q, *params) >= p - 1e-15).all()
        below = q - 1 if whole else q - 1e-12 * np.abs(q)
        assert (cdf(below, *params) < p + 1e-15).all()


def test_equal_rows_of_a_batch_are_evaluated_once():
    asked = []
    f = distributions.once_each(lambda x, a: (asked.append(len(x)), x * a)[1])
    x, nan = np.arange(1000.0) % 7, float("nan")
    assert (f(x, np.full(1000, 3.0)) == x * 3).all() and (f(x, x % 2) == x * (x % 2)).all() and (f(x[:0], x[:0]) == x[:0]).all()
    assert f(np.full(5, 2.0), np.full(5, 3.0)).tolist() == [6.0] * 5 and sum(asked[:2]) == 14
    assert np.isnan(distributions._quantile_of("chi2")(np.array([nan, 0.5]), np.array([2.0, 2.0]))).tolist() == [True, False]


def test_running_means_in_blocks(spark):
    rows = [(None if k % 11 == 0 else "ab"[k % 2], None if k % 97 == 0 else (k * 37) % 400, k, None if k % 5 == 0 else float(k % 9)) for k in range(2000)]
    df = spark.createDataFrame(rows, "f string, o int, i int, x double")
    out = ops.running_mean(df, "f", ["o", "i"], "x", rows=100)
    seen, want = {}, {}
    for f, o, i, x in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        n, m, total = seen.get(f, (0, 0, 0.0))
        seen[f] = n, m, total = n + 1, m + (x is not None), total + (x or 0.0)
        want[i] = (total / m if m else None, n)
    assert {r.i: (r.mean, r.seen) for r in out.collect()} == want
    number, n = ops.blocks(df, "o", 100)
    sizes = [r["count"] for r in df.groupBy("f", number.alias("b")).count().collect()]
    assert n > 15 and max(sizes) < 150  # a key's rows are in many groups, so in many tasks


@pytest.mark.parametrize("query, column, step", [("fn_map", "update_", "map_concat("), ("fn_map", "join_", "flatten("), ("fn_map_sets", "zipmap", "map_from_arrays("), ("fn_map_sets", "flat_map_key", "flatten(")])
def test_shared_maps_are_evaluated_once(spark, query, column, step):
    plan = queries.QUERIES[query](spark, "/root/testdata/sf0.001").select(column)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(step) == 1  # as many as places that name it, before


def test_matrices_of_a_batch_go_together(spark):
    from tessera.functions import numeric

    m = np.random.default_rng(5).normal(size=(50, 3, 3))
    got = numeric._eigen_basis(m)  # one call for the batch
    for a, basis in zip(m, got, strict=True):
        values, vectors = np.linalg.eigh((a + a.T) / 2)
        want = [np.abs(vectors[:, j]) / np.sqrt(values[j]) if values[j] > 0 else np.full(3, np.nan) for j in np.argsort(-values)]
        assert np.allclose(np.abs(basis), want, equal_nan=True)
    mixed = [([[4.0, 0.0], [0.0, 1.0]],), (None,), ([[9.0]],), ([[4.0, 0.0], [0.0, 1.0]],)]  # shapes differ, one is missing
    df = spark.createDataFrame(mixed, "m array<array<double>>").coalesce(1)
    assert [r.x for r in df.select(numeric.eigen_basis("m").alias("x")).collect()] == [[[0.5, 0.0], [0.0, 1.0]], None, [[1 / 3]], [[0.5, 0.0], [0.0, 1.0]]]


@pytest.mark.parametrize("query, column, step, most", [("fn_linear", "linear", "array_sort(", 1), ("fn_linear", "tanimoto", "zip_with(", 1), ("fn_model", "iteration", "filter(", 1)])
def test_models_walk_their_arrays_once(spark, query, column, step, most):
    plan = queries.QUERIES[query](spark, "/root/testdata/sf0.001").select(column)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(step) <= most
