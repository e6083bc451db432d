"""The document engine: forms, methods, functions, sources, state and the registered queries."""

import math

import pytest
from pyspark.sql import functions as F

import tessera
from tessera import queries, sources, streaming
from tessera.functions import LIBRARY
from tessera.plans import producers
from tessera.plans.compiler import SemanticError


def run(spark, action, kind="double", output="double", rows=(1.0, 4.0, 9.0), **more):
    df = spark.createDataFrame([(r,) for r in rows], f"value {kind}" if kind != "long" else "value bigint")
    out = tessera.engine({"input": kind, "output": output, "action": action, **more}).score(df, name="out")
    return [r.out for r in out.collect()]


def test_forms(spark):
    assert run(spark, {"m.sqrt": ["input"]}) == [1.0, 2.0, 3.0]
    assert run(spark, [{"let": {"x": {"*": ["input", 2]}}}, {"if": {">": ["x", 5]}, "then": {"set": {"x": 0.0}}}, "x"]) == [2.0, 0.0, 0.0]
    assert run(spark, {"cond": [{"if": {"<": ["input", 2]}, "then": ["a"]}, {"if": {"<": ["input", 5]}, "then": ["b"]}], "else": ["c"]}, output="string") == ["a", "b", "c"]
    assert run(spark, {"u.twice": ["input"]}, fcns={"twice": {"params": [{"x": "double"}], "ret": "double", "do": [{"*": ["x", 2]}]}}) == [2.0, 8.0, 18.0]
    assert run(spark, {"a.len": [{"a.filter": [{"value": [1, 2, 3], "type": {"type": "array", "items": "int"}}, {"params": [{"v": "int"}], "ret": "boolean", "do": [{">": ["v", 1]}]}]}]}, output="int") == [2, 2, 2]
    summed = [{"let": {"n": 0}}, {"for": {"i": 0}, "while": {"<": ["i", 4]}, "step": {"i": {"+": ["i", 1]}}, "do": [{"set": {"n": {"+": ["n", "i"]}}}]}, "n"]
    assert run(spark, summed, output="int") == [6, 6, 6]
    assert run(spark, [{"let": {"n": 0}}, {"do": [{"set": {"n": {"+": ["n", 2]}}}], "until": {">": ["n", 5]}}, "n"], output="int") == [6, 6, 6]
    assert run(spark, {"try": {"a.head": [{"value": [], "type": {"type": "array", "items": "double"}}]}}, output=["double", "null"]) == [None] * 3
    with pytest.raises(SemanticError):
        run(spark, {"no.such": ["input"]})
    with pytest.raises(Exception, match="15020"):
        run(spark, {"a.head": [{"value": [], "type": {"type": "array", "items": "double"}}]})


def test_methods(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("value"))
    fold = {"method": "fold", "zero": 0.0, "input": "double", "output": "double", "action": {"max": ["tally", "input"]}, "merge": {"max": ["tallyOne", "tallyTwo"]}}
    assert [r.output for r in tessera.engine(fold).score(df).collect()] == [99.0]
    emit = {"method": "emit", "input": "double", "output": "double", "action": [{"if": {">": ["input", 97]}, "then": {"emit": ["input"]}}]}
    assert sorted(r.output for r in tessera.engine(emit).score(df).collect()) == [98.0, 99.0]
    twice = {"input": "double", "output": "double", "action": {"*": ["input", 2]}}
    assert sorted(r.output for r in tessera.chain(twice, twice)(df).collect())[-1] == 396.0


def value(spark, name, *args):
    return spark.range(1).select(LIBRARY[name](*(F.lit(a) if not callable(a) else a for a in args)).alias("v")).first().v


def test_functions(spark):
    near = lambda a, b: math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)
    assert near(value(spark, "m.special.erf", 0.5), math.erf(0.5)) and near(value(spark, "m.special.erf", 3.0), math.erf(3.0))
    assert near(value(spark, "m.special.lnGamma", 7.5), math.lgamma(7.5))
    assert near(value(spark, "prob.dist.gaussianCDF", 1.0, 0.0, 1.0), 0.5 * (1 + math.erf(1 / math.sqrt(2))))
    assert near(value(spark, "prob.dist.gaussianQF", 0.975, 0.0, 1.0), 1.959963984540054)
    assert near(value(spark, "prob.dist.chi2CDF", 3.0, 2.0), 1 - math.exp(-1.5))
    assert near(value(spark, "prob.dist.tCDF", 0.0, 5.0), 0.5)
    assert near(value(spark, "prob.dist.betaCDF", 0.3, 1.0, 1.0), 0.3)
    assert near(value(spark, "prob.dist.binomialCDF", 1.0, 3.0, 0.5), 0.5)
    assert near(value(spark, "prob.dist.poissonPDF", 2, 3.0), math.exp(-3) * 4.5)
    assert value(spark, "prob.dist.poissonQF", 0.5, 3.0) == 3.0
    assert near(value(spark, "prob.dist.exponentialQF", 0.5, 2.0), math.log(2) / 2)
    assert value(spark, "s.hex", 255) == "ff" and value(spark, "s.substr", "hello", 1, -1) == "ell"
    assert value(spark, "/", 1, 0) == math.inf and value(spark, "%", -3, 5) == 2
    assert value(spark, "a.permutations", [1, 2, 3]) == [[1, 2, 3], [1, 3, 2], [2, 1, 3], [2, 3, 1], [3, 1, 2], [3, 2, 1]]
    assert value(spark, "a.combinations", [1, 2, 3], 2) == [[1, 2], [1, 3], [2, 3]]
    assert value(spark, "re.indexall", "abcab", "ab") == [[0, 2], [3, 5]]
    assert value(spark, "time.year", 0.0, "UTC") == 1970
    assert value(spark, "la.det", [[1.0, 2.0], [3.0, 4.0]]) == pytest.approx(-2)
    assert len(LIBRARY) >= 446


def test_sources(spark, tmp_path):
    schema = {"type": "record", "name": "R", "fields": [{"name": "a", "type": ["double", "null"]}, {"name": "b", "type": "string"}]}
    (tmp_path / "in.json").write_text('{"a": {"double": 1.5}, "b": "x"}\n{"a": null, "b": "y"}\n')
    df = sources.read_json(spark, str(tmp_path / "in.json"), schema)
    assert [tuple(r) for r in df.collect()] == [(1.5, "x"), (None, "y")]
    sources.write_csv(df, str(tmp_path / "out.csv"))
    assert sorted(map(str, (tuple(r) for r in sources.read_csv(spark, str(tmp_path / "out.csv"), schema).collect()))) == ["(1.5, 'x')", "(None, 'y')"]


def test_state(spark, tmp_path):
    rows = [("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 5.0), ("a", 3, 5.0)]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    out = {(r.k, r.t): r.mean for r in streaming.keyed_state(df, "k", ["t"], "x", "moments").collect()}
    assert out == {("a", 1): 1.0, ("a", 2): 2.0, ("a", 3): 3.0, ("b", 1): 5.0}
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming.keyed_state(stream, "k", ["t"], "x", "ewma", alpha=0.5).writeStream.format("memory").queryName("ewma").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.t): r.mean for r in spark.table("ewma").collect()}[("a", 3)] == 3.5


def test_producers(spark):
    rows = [(float(c * 10 + i % 3), float(c * 5 + i % 2)) for c in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "x double, y double")
    centres = producers.k_means(df, ["x", "y"], 3, seed=3)
    got = tessera.engine(producers.k_means_document(centres, ["x", "y"])).score(df)
    assert got.select("output").distinct().count() == len(centres)
    doc = producers.linear_document([2.0, 1.0], 3.0, ["x", "y"])
    assert tessera.engine(doc).score(df).first().output == 2 * rows[0][0] + rows[0][1] + 3


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    out = queries.QUERIES[name](spark, folder)
    cols = sorted(out.columns)
    got = sorted((tuple(r[c] for c in cols) for r in out.collect()), key=str)
    if name not in queries.ORACLE:
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("lineitem", "orders", "part", "customer", "supplier", "nation", "region", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=str)
    assert len(got) == len(want)
    flat = lambda rows: [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows]
    same = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-5)
    got, want = sorted(flat(got), key=str), sorted(flat(want), key=str)
    assert all(same(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))
