import tessera
from tessera.plans import frontends as fe


def test_python_expressions(spark):
    assert fe.from_python("m.sqrt(x) + 2 * (y if x > 1 else -y)") == {"+": [{"m.sqrt": ["x"]}, {"*": [2, {"if": {">": ["x", 1]}, "then": "y", "else": {"u-": ["y"]}}]}]}
    steps = fe.program("n = 0.0\nfor v in [input, 2.0]:\n    n += v * 2\nif n > 7:\n    n = 7.0\nn")
    df = spark.createDataFrame([(1.0,), (5.0,)], "value double")
    assert [r.output for r in tessera.engine({"input": "double", "output": "double", "action": steps}).score(df).collect()] == [6.0, 7.0]


def test_tools():
    doc = {"input": "double", "output": "double", "action": {"u.f": ["input"]}, "fcns": {"f": {"params": [{"x": "double"}], "ret": "double", "do": [{"+": ["x", {"u.f": ["x"]}]}]}}}
    assert fe.is_recursive(doc, "u.f") and fe.called(doc) == {"u.f", "+"}
    assert fe.search(doc, lambda v: v == "input") == [("action", "u.f", 0)]
    assert fe.get(fe.assign(doc, ("action", "u.f", 0), 3), ("action", "u.f")) == [3] and "fcns" not in fe.remove(doc, ("fcns",))
    assert "union(double, null)" in fe.pretty({"type": "record", "name": "R", "fields": [{"name": "a", "type": ["double", "null"]}]})
    assert '"u.f"' in fe.describe(doc)


def test_groups_and_statistics(spark):
    from pyspark.sql import functions as F

    from tessera.functions import LIBRARY as L

    row = spark.range(1).select(
        L["re.groups"](F.lit("xaby"), F.lit("a(b)")).alias("g"),
        L["stat.test.kolmogorov"](F.array(*map(F.lit, [1.0, 2.0, 3.0])), F.array(*map(F.lit, [1.0, 2.0, 3.0]))).alias("k"),
        L["stat.change.zValue"](F.lit(3.0), F.struct(F.lit(2.0).alias("count"), F.lit(1.0).alias("mean"), F.lit(4.0).alias("variance")), F.lit(True)).alias("z"),
    ).first()
    assert row.g == [[1, 3], [2, 3]] and row.k == 1.0 and abs(row.z - 2**0.5) < 1e-12


def test_infix(spark):
    from tessera.plans import infix

    assert infix.expression("1 + 2 * x ** 2 < 7 && !y") == {"&&": [{"<": [{"+": [1, {"*": [2, {"**": ["x", 2]}]}]}, 7]}, {"!": ["y"]}]}
    doc = infix.document(
        """
name: Example
input: record(In, x: double, y: double)
output: double
cells:
  weights(array(double)) = [2.0, 3.0]
fcns:
  square = fcn(v: double -> double) v * v;
action:
  s = 0.0;                       // a comment
  foreach (v : new(array(double), input.x, input.y)) { s = s + u.square(v) };
  if (s > 100.0) { s = 100.0 };
  s + a.sum(a.map(weights, fcn(w: double -> double) w + 1.0))
"""
    )
    df = spark.createDataFrame([(3.0, 4.0), (30.0, 4.0)], "x double, y double")
    assert [r.output for r in tessera.engine(doc).score(df).collect()] == [32.0, 107.0]


def test_pmml(spark):
    from tessera.plans.pmml import from_pmml

    text = """<PMML version="4.2" xmlns="http://www.dmg.org/PMML-4_2"><DataDictionary><DataField name="x" optype="continuous" dataType="double"/><DataField name="c" optype="categorical" dataType="string"/></DataDictionary>
    <TransformationDictionary><DerivedField name="z" optype="continuous" dataType="double"><Apply function="*"><FieldRef field="x"/><Constant dataType="double">2</Constant></Apply></DerivedField></TransformationDictionary>
    <TreeModel functionName="regression"><MiningSchema><MiningField name="x"/></MiningSchema><Node score="0"><True/>
    <Node score="1"><SimplePredicate field="z" operator="lessThan" value="4"/></Node><Node score="2"><SimplePredicate field="c" operator="equal" value="a"/></Node><Node score="3"><True/></Node></Node></TreeModel></PMML>"""
    df = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (3.0, "b")], "x double, c string")
    assert [r.output for r in tessera.engine(from_pmml(text)).score(df).collect()] == [1.0, 2.0, 3.0]


def test_binary_packing(spark):
    pack = {"pack": [{"int": 7}, {"null terminated": {"bytes.encodeUtf8": [{"string": "ab"}]}}, {"double": "input"}]}
    back = {"unpack": pack, "format": [{"a": "int"}, {"b": "null terminated"}, {"c": "double"}], "then": {"+": ["a", "c"]}, "else": -1.0}
    df = spark.createDataFrame([(1.5,)], "value double")
    assert tessera.engine({"input": "double", "output": "double", "action": back}).score(df).first().output == 8.5
