"""The pipeline against plain versions of its stages, and the queries' registration."""

import __spark_entry__
import corpus_pipeline
from tessera.llm import minhash

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    by_name = dict(corpus_pipeline.STAGES)
    kept = by_name["toxicity"](spark, docs, SF)
    assert kept.columns == columns and 0 < kept.count() <= docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {d for d, (_, c) in brute.components(texts, 5, 80).items() if d == c}
    assert {r.doc_id for r in by_name["near_dedup"](spark, docs, SF).collect()} == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d, t in texts.items() if not brute.contamination(t, items)[1]}
    assert {r.doc_id for r in by_name["decontamination"](spark, docs, SF).collect()} == clean
    for r in by_name["pii"](spark, docs, SF).collect():
        counts, _, listed = brute.pii(texts[r.doc_id])
        for span in filter(None, listed.split(",")):
            _, s, e = span.split(":")
            assert texts[r.doc_id][int(s) : int(e)] not in (r.text or "")
        if not listed and "<" not in (r.text or ""):
            assert r.text == texts[r.doc_id]


def test_stages_take_any_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, one very long text and columns named like those that the operators add."""
    plain = " ".join(f"word{i}" for i in range(80))
    texts = [None, "", " ", plain, plain, "ask me@x.org now", "ask me@x.org now", "five words of other text", "quite another " + "long " * 30000]
    ids = [None, 1, 2, 3, 3, 3, 3, None, 4]
    names = ["n_words", "contaminated", "_toxic_score", "_score", "_text", "_all", "_done", "_m0", "_hash", "_d", "_h", "n_shingles", "kept", "_row", "_block", "text_hash", "id", "rep", "group"]
    rows = [(d, t, "en", "s", len(t or ""), *(f"{c}{k}" for c in names)) for k, (d, t) in enumerate(zip(ids, texts, strict=True))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    (tmp_path / "sf").mkdir()
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / "sf" / f"{name}.parquet"))
    for n in (len(rows), 0):
        docs = spark.createDataFrame(rows[:n], schema).repartition(3)
        for name, stage in corpus_pipeline.STAGES[:4]:
            got = stage(spark, docs, str(tmp_path / "sf"))
            assert got.columns == docs.columns, name
            marks = sorted(r.n_words for r in got.collect())
            want = [f"n_words{k}" for k in range(n)]
            if name == "near_dedup" and n:
                assert len(marks) == n - 2 and {"n_words0", "n_words1", "n_words2", "n_words7", "n_words8"} <= set(marks)
            else:
                assert marks == want, name
        docs.write.mode("overwrite").parquet(str(tmp_path / "sf" / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
        assert len({(r.sequence_id, r.offset) for r in out}) == len(out) and (len(out) > 0) == (n > 0)
        if n:
            assert sorted({r.doc_id or 0 for r in out}) == [0, 1, 2, 3, 4] and sum(r.piece == 0 for r in out) == n - 2


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_bands_miss_little():
    for percent in (80, 85, 90):
        bands, rows = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands < 1e-6
