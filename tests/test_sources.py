"""Files, registries and streams."""

from pyspark.sql import functions as F

from vellum.plans import registry as G
from vellum.sources import files as S
from vellum.sources import store
from vellum.streaming import jobs as J


def test_dictionary(spark, tmp_path):
    (tmp_path / "a.dic").write_text("# note\n\n人: 几 乂\nno colon\n日:旦:x\n人: 八\nEMPTY:\n", encoding="utf-8")
    d = {r.key: list(r.vals) for r in S.dictionary(S.numbered_lines(spark, str(tmp_path / "a.dic"))).collect()}
    assert d == {"人": ["八"], "日": ["旦:x"], "EMPTY": []}


def test_batch_results(spark):
    ok = '{"key": "p1", "response": {"candidates": [{"content": {"parts": [{"text": "abc"}, {"text": "def"}]}}]}}'
    rows = [(0, ok), (1, '{"key": "p2", "error": "x"}'), (2, "junk"), (3, ""), (4, ok.replace("abc", "xyz"))]
    got = {r.key: r.text for r in S.batch_results(spark.createDataFrame(rows, "at int, value string")).collect()}
    assert got == {"p1": "xyzdef"}


def test_records_roundtrip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "百")], "id string, job_id long, han string")
    S.write_records(rows, str(tmp_path / "r"))
    back = S.read_records(spark, str(tmp_path / "r")).collect()[0]
    assert (back.id, back.job_id, back.han, back.meaning) == ("a", 1, "百", None)


def test_swap(spark, tmp_path):
    path = str(tmp_path / "t")
    store.create_if_missing(spark, path, "x int")
    store.swap(spark.createDataFrame([(1,)], "x int"), path)
    store.swap(spark.createDataFrame([(2,), (3,)], "x int"), path)
    assert {r.x for r in spark.read.parquet(path).collect()} == {2, 3}


def test_stream_handles_each_job_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("jobs", "out", "mark"))
    row = lambda i, kind: (i, None, None, None, "pending", None, None, 0.0, 0.0, kind, None, None)
    spark.createDataFrame([row(1, "extract"), row(2, "reocr")], J.JOB).write.parquet(src)
    handlers = {k: (lambda df: df.select("id")) for k in ("extract", "reocr")}
    for _ in range(2):
        J.run_available(J.incoming(spark, src), J.dispatch(handlers, out), mark)
    spark.createDataFrame([row(3, "extract")], J.JOB).write.mode("append").parquet(src)
    J.run_available(J.incoming(spark, src), J.dispatch(handlers, out), mark)
    assert sorted((r.id, r.kind) for r in spark.read.parquet(out).select("id", "kind").collect()) == [(1, "extract"), (2, "reocr"), (3, "extract")]


def test_registries(spark):
    G.LAYOUTS.register("wide", G.Layout(10, "wide", lambda: F.col("w") > 5, lambda d: d))
    G.LAYOUTS.register("first", G.Layout(0, "first", lambda: F.col("w") > 8, lambda d: d))
    got = [r.layout for r in G.route(spark.createDataFrame([(9,), (6,), (1,)], "w int")).collect()]
    assert got == ["first", "wide", None]
    G.TRANSLATORS.register("stub", G.batched(lambda ts: [None if t is None else f"[VI] {t}" for t in ts]))
    x = spark.createDataFrame([("平定營", "", ("a", "b", "")), ("x", "kept", ("a", "b", "m"))], "han string, meaning string, source_of struct<han:string,phonetic:string,meaning:string>")
    rows = G.translate(x, "stub").collect()
    assert (rows[0].meaning, rows[0].source_of.meaning, rows[1].meaning, rows[1].source_of.meaning) == ("[VI] 平定營", "stub", "kept", "m")
    G.CORRECTORS.register("stub", lambda c: F.regexp_replace(c, "調", "詣"))
    y = G.correct(spark.createDataFrame([("拜調", None)], "han string, han_raw string"), "stub").collect()[0]
    assert (y.han, y.han_raw) == ("拜詣", "拜調")


def test_xml_and_manifest(spark, tmp_path):
    S.corpus_xml(spark.createDataFrame([("a.1", "百")], "_id string, text string"), str(tmp_path / "x"))
    assert spark.read.format("xml").option("rowTag", "sentence").option("attributePrefix", "_").load(str(tmp_path / "x")).count() == 1
    m = S.manifest(spark.createDataFrame([("d", "s", 2, "k2"), ("d", "s", 1, "k1")], "doc_id string, source_pdf string, page_no int, object_key string")).collect()[0]
    assert m.total_pages == 2 and [p.page_no for p in m.pages] == [1, 2]
